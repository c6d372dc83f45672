"""Every operator as a query over the star-schema test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from periodica.functions.text import html_unescape
from periodica.operators import counts, grids, ingest, partials, streaks, tables, words
from periodica.operators.resolve import resolve_refs
from periodica.plans import driver_views as views
from periodica.plans.driver_views import GRID, Tables
from periodica.schemas import CORRUPT, REASON
from periodica.session import work_dir
from periodica.sources import documents, grids as grid_source, page_index, pages, search_index, sinks, store
from periodica.sources import partials as stored_partials
from periodica.streaming import arrivals, ingest as stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# The year that counts as the current one, and the date up to which the append
# query takes puzzles for already stored.
LAST_YEAR = 2025
STORED_UNTIL = "1999-01-01"
# A layout enters the grid catalogue if one of so many puzzles has it, at every size.
COMMON = 500
# Puzzles that must share a layout for it to be written and scanned as a grid file.
LEAST = 4
# Documents in a packed file at most: such a file does not split, so one task reads it.
PACKED = 50_000


def query(build: Callable[[SparkSession, Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(spark, Tables(spark, folder))

    QUERIES[build.__name__] = run
    return run


# ---- sources, ingest, sinks


def _text_files(spark: SparkSession, t: Tables, label: str) -> str:
    """The documents as text files of one JSON document per line."""
    path = work_dir(spark, label)
    views.document_texts(t).select("text").write.text(path)
    return path


def _parsed(t: Tables) -> DataFrame:
    texts = views.document_texts(t).withColumnRenamed("id", "doc_key")
    return documents.parse_json(texts, "text")


def _good(t: Tables) -> DataFrame:
    return documents.quarantine(_parsed(t))[0]


@query
def scan_json(spark, t):
    files = _text_files(spark, t, "scan")
    scanned = documents.scan_json(spark, roots=[files], lines=True, suffix="*.txt")
    good, _ = documents.quarantine(documents.stage(scanned, work_dir(spark, "staged")))
    return good.select(
        "id",
        "number",
        F.col("creator.name").alias("creator"),
        "crosswordType",
        F.size("entries").cast("bigint").alias("n_entries"),
    )


@query
def puzzle_norm(spark, t):
    return documents.puzzle_norm(_good(t))


@query
def entry_explode(spark, t):
    return documents.entry_explode(_good(t))


@query
def dedupe_first_wins(spark, t):
    docs = t.documents.withColumn("digest", F.sha2("text", 256))
    return ingest.dedupe_first_wins(
        docs.select("digest", "doc_id", "lang", "source", "n_chars"), "digest", ["doc_id"]
    )


@query
def append_new(spark, t):
    incoming = views.puzzles(t)
    stored = incoming.where(F.col("date") < F.lit(STORED_UNTIL).cast("date"))
    return ingest.append_new(incoming, stored)


@query
def quarantine(spark, t):
    files = _text_files(spark, t, "quarantine")
    scanned = documents.scan_json(spark, roots=[files], lines=True, suffix="*.txt")
    good, bad = documents.quarantine(documents.stage(scanned, work_dir(spark, "staged")))
    # A rejected document is known by its raw text alone.
    raw_id = F.regexp_extract(F.col(CORRUPT), r'\A\{"id":"([^"]*)"', 1)
    return good.select("id", F.lit("good").alias("status")).unionByName(
        bad.select(raw_id.alias("id"), F.lit("bad").alias("status"))
    )


def _key(column: str = "id") -> Column:
    return F.col(column).cast("bigint")


# What is done to the text of a document whose number leaves this rest by 16.
def _kinds(text: Column) -> dict[int, Column]:
    cut = F.expr("left(text, length(text) - 1)")
    opened = F.expr("substring(text, 2)")
    return {
        1: F.concat(text, text),
        2: F.concat(text, F.lit(" junk")),
        3: F.concat(F.lit("["), text, F.lit("]")),
        4: F.replace(text, F.lit('"id":'), F.lit('"Id" :')),
        5: F.regexp_replace(text, '"id":"([0-9]+)"', '"id":$1'),
        6: F.concat(F.lit('{"solutionAvailable":3,'), opened),
        7: F.concat(F.lit('{"group":5,"dateSolutionAvailable":1.16e12,'), opened),
        8: F.concat(cut, F.lit(',"date":1e19}')),
        9: F.concat(cut, F.lit(',"crosswordType":7}')),
        10: F.concat(cut, F.lit(',"NAME":"renamed"}')),
        11: F.concat(F.lit(" \n"), text, F.lit("\n\t ")),
        12: F.concat(text, F.lit("]")),
        13: F.concat(cut, F.lit(',"profile":{"note":["\\"id\\": 1"]}}')),
        14: F.concat(text, F.lit(","), text),
    }


@query
def quarantine_kinds(spark, t):
    """The outcome of every document after a change that depends on its number."""
    texts = views.document_texts(t)
    changed = F.col("text")
    for rest, to in _kinds(F.col("text")).items():
        changed = F.when(_key() % 16 == rest, to).otherwise(changed)
    judged = documents.parse_json(texts.select(F.col("id").alias("doc_key"), changed.alias("text")), "text")
    return judged.select("doc_key", "id", "name", F.col(REASON).alias("reason"))


def _put(rows: DataFrame, name: str, path: str) -> None:
    """The texts under another name as packed files of one JSON document per line."""
    renamed = F.replace("text", F.lit("Puzzle No"), F.lit(name))
    packed = rows.select(renamed.alias("value")).write.option("maxRecordsPerFile", PACKED)
    packed.text(path, compression="gzip")


def _two_roots(spark: SparkSession, t: Tables) -> list[str]:
    """Even documents twice in the first folder, and all in the second, under other names."""
    folder = work_dir(spark, "roots")
    whole = views.document_texts(t).where(F.col("text").endswith("}"))
    staged = work_dir(spark, "texts")
    texts = documents.stage(whole, staged)
    even = texts.where(_key() % 2 == 0)
    _put(even, "First No", f"{folder}/one/a")
    _put(even, "Again No", f"{folder}/one/b")
    _put(texts, "Other No", f"{folder}/two")
    store._remove(spark, staged)
    return [f"{folder}/one", f"{folder}/two"]


@query
def first_documents(spark, t):
    scanned = documents.scan_json(spark, roots=_two_roots(spark, t), lines=True, suffix="*.txt.gz")
    good, _ = documents.quarantine(documents.stage(scanned, work_dir(spark, "staged")))
    return documents.first_documents(good).select("id", "name")


@query
def import_documents(spark, t):
    """Two folders imported in turn, then both again, which changes nothing."""
    roots, target = _two_roots(spark, t), work_dir(spark, "store")
    for part in (roots[:1], roots, roots):
        store.import_documents(spark, target, part, lines=True, suffix="*.txt.gz")
    per_puzzle = store.read_entries(spark, target).groupBy(F.col("crossword_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_entries")
    )
    return (
        store.read_puzzles(spark, target)
        .join(per_puzzle, "id", "left")
        .select("id", "name", "batch", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))
    )


@query
def integrity_check(spark, t):
    p = views.puzzles(t)
    twice = p.where(F.col("crossword_type") == "prize")
    known = p.where(F.col("date") < F.lit(STORED_UNTIL).cast("date")).unionByName(twice)
    return ingest.integrity_check(known, views.entries(t))


@query
def stream_ingest(spark, t):
    files = _text_files(spark, t, "arrivals")
    target = work_dir(spark, "store")
    docs = stream.document_stream(spark, files, lines=True, suffix="*.txt")
    stream.stream_ingest(docs, target, f"{target}/mark").awaitTermination()
    per_puzzle = stream.read_entries(spark, target).groupBy(F.col("crossword_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_entries")
    )
    return (
        stream.read_puzzles(spark, target)
        .join(per_puzzle, "id", "left")
        .select(
            "id",
            "number",
            "creator_name",
            "date",
            "crossword_type",
            F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        )
    )


@query
def stream_ingest_state(spark, t):
    """Three deliveries with ids that come again inside and across them, after an import.

    The stream is started anew for each from its checkpoint.
    """
    files, target = work_dir(spark, "arrivals"), work_dir(spark, "store")
    whole = views.document_texts(t).where(F.col("text").endswith("}"))
    texts = documents.stage(whole, work_dir(spark, "texts"))

    _put(texts.where(_key() % 5 == 0), "Stored No", f"{files}-stored")
    store.import_documents(spark, target, [f"{files}-stored"], lines=True, suffix="*.txt.gz")
    even, third = texts.where(_key() % 2 == 0), texts.where(_key() % 3 == 0)
    for parts in (
        ((even, "First No", "1a"), (even, "Again No", "1b")),
        ((third, "Second No", "2a"), (even, "Again No", "2b")),
        ((texts, "Third No", "3a"), (third, "Again No", "3b")),
    ):
        for rows, name, folder in parts:
            _put(rows, name, f"{files}/{folder}")
        docs = stream.document_stream(spark, files, lines=True, suffix="*.txt.gz")
        arrivals.ingest_arrivals(docs, target, f"{target}/mark")
    per_puzzle = store.read_entries(spark, target).groupBy(F.col("crossword_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_entries")
    )
    return (
        store.read_puzzles(spark, target)
        .join(per_puzzle, "id", "left")
        .select("id", "name", "batch", F.coalesce("n_entries", F.lit(0)).alias("n_entries"))
    )


@query
def grid_scan(spark, t):
    folder = work_dir(spark, "grids")
    whites = F.split("fingerprint", ",")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") * F.col("n_cols") - 1),
        lambda i: F.when(F.array_contains(whites, i.cast("string")), "1").otherwise("0"),
    )
    lines = F.transform(
        F.sequence(F.lit(0), F.col("n_rows") - 1),
        lambda r: F.array_join(F.slice(cells, r * F.col("n_cols") + 1, F.col("n_cols")), ","),
    )
    shared = views.shared_grids(_fingerprints(t), LEAST)
    texts = shared.select("grid_name", F.array_join(lines, "\n").alias("value"))
    texts.repartition("grid_name").write.partitionBy("grid_name").text(folder)
    # Files that are no grids: ragged lines, words, and one of another kind.
    odd = spark.createDataFrame([("ragged", "1,0\n1"), ("words", "a,b")], "grid_name string, value string")
    odd.repartition(1).write.mode("append").partitionBy("grid_name").text(folder)
    stray = spark.createDataFrame([("README", "not looked at")], "grid_name string, value string")
    stray.write.mode("append").partitionBy("grid_name").csv(folder)
    in_path = F.regexp_extract(F.col("_metadata.file_path"), r"/grid_name=([^/]+)/", 1)
    good, bad = grid_source.grid_scan(spark, folder, name=in_path, suffix="*.txt")
    return good.unionByName(bad, allowMissingColumns=True)


@query
def sink_rows_json(spark, t):
    path = work_dir(spark, "rows")
    columns = ["creator_name", "link", "date_text"]
    sinks.sink_rows_json(words.doc_links(views.puzzles(t), sort=False), path)
    return sinks.read_rows_json(spark, path, columns)


@query
def sink_table(spark, t):
    path = work_dir(spark, "puzzles")
    sinks.write_puzzles(documents.puzzle_norm(_good(t)), path)
    return sinks.read_puzzles(spark, path)


@query
def sink_table_entries(spark, t):
    path = work_dir(spark, "entries")
    sinks.write_entries(documents.entry_explode(_good(t)), path)
    return sinks.read_entries(spark, path)


@query
def page_props(spark, t):
    page = F.col("html")
    items = F.transform(pages.list_items(page), lambda i: html_unescape(i))
    return t.pages.select(
        "page_id",
        pages.page_title(page).alias("title"),
        pages.page_lang(page).alias("lang"),
        F.array_join(items, "|").alias("items"),
        F.md5(html_unescape(page)).alias("text_digest"),
    )


@query
def page_documents(spark, t):
    """Documents put into pages as an escaped JSON island, and taken out again."""
    texts = views.document_texts(t)
    escaped = F.col("text")
    for sign, name in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    wrapped = texts.select(
        F.concat(F.lit("http://archive.example/"), "id").alias("url"),
        F.concat(
            F.lit("<html><body><x-island name='Other' props='{}'></x-island>"),
            F.lit('<x-island props="{&quot;data&quot;:'),
            escaped,
            # Duplicate keys are taken, text after the object is not.
            F.when(_key() % 7 == 1, ",&quot;data&quot;:null,&quot;data&quot;:{&quot;creator&quot;:{}}")
            .otherwise(F.lit("")),
            F.lit("}"),
            F.when(_key() % 7 == 2, " trailing").otherwise(F.lit("")),
            F.lit('" name="Record"></x-island></body></html>'),
        ).alias("html"),
    )
    path = work_dir(spark, "props")
    found, rejected = pages.page_props(wrapped, "x-island", "Record", path)
    taken = found.where(F.col(REASON).isNull()).select(
        "url",
        F.lit("accepted").alias("outcome"),
        F.col("creator.name").alias("creator"),
        F.size("entries").cast("bigint").alias("n_entries"),
    )
    return taken.unionByName(
        rejected.select("url", F.col("reason").alias("outcome")), allowMissingColumns=True
    )


# ---- cross-references


@query
def resolve_refs_prefix(spark, t):
    return resolve_refs(views.entries(t))


@query
def resolve_refs_full(spark, t):
    return resolve_refs(views.entries(t), match="full")


# ---- analytic sections


@query
def count_by_type(spark, t):
    return counts.count_by_type(views.puzzles(t))


@query
def yearly_matrix(spark, t):
    return counts.yearly_matrix(views.puzzles(t), LAST_YEAR)


@query
def max_repeat(spark, t):
    return words.max_repeat(views.entries(t), views.puzzles(t))


@query
def bio_range(spark, t):
    return counts.bio_range(views.puzzles(t))


@query
def self_ref(spark, t):
    return words.self_ref(views.entries(t), views.puzzles(t))


@query
def yearly_by_type(spark, t):
    return counts.yearly_by_type(views.puzzles(t))


@query
def bio_totals(spark, t):
    p = views.puzzles(t)
    return counts.bio_totals(p, words.self_ref(views.entries(t), p, sort=False))


@query
def bio_yearly(spark, t):
    return counts.bio_yearly(views.puzzles(t))


@query
def dup_answers(spark, t):
    return words.dup_answers(resolve_refs(views.entries(t)), views.puzzles(t))


@query
def dup_clues(spark, t):
    return words.dup_clues(resolve_refs(views.entries(t)), views.puzzles(t))


@query
def doc_links(spark, t):
    return words.doc_links(views.puzzles(t))


@query
def top_answers(spark, t):
    return words.top_answers(views.entries(t))


@query
def unique_ratio(spark, t):
    return words.unique_ratio(views.entries(t), views.puzzles(t))


@query
def unique_ratio_approx(spark, t):
    """Whether estimates from sketches, stored and read back, are within four standard errors."""
    path = work_dir(spark, "sketches")
    words.answer_sketches(views.entries(t), views.puzzles(t)).write.partitionBy("year").parquet(path)
    estimates = words.ratio_of_sketches(spark.read.parquet(path), sort=False).select(
        "creator_name", F.col("unique_solutions").alias("estimate"), F.col("total_solutions").alias("total")
    )
    exact = words.unique_ratio(views.entries(t), views.puzzles(t), sort=False).drop("ratio")
    error = 4 * 1.04 / 2 ** (words.SKETCH_LOG_SIZE / 2)
    close = F.abs(F.col("estimate") - F.col("unique_solutions")) <= F.ceil(error * F.col("unique_solutions"))
    return exact.join(estimates, "creator_name", "left").select(
        "creator_name", "unique_solutions", F.col("total").alias("total_solutions"), close.alias("close")
    )


@query
def avg_text_len(spark, t):
    return words.avg_text_len(views.entries(t), views.puzzles(t))


@query
def avg_document_len(spark, t):
    return words.avg_text_len(t.documents, setter="source", clue="text")


@query
def direction_balance(spark, t):
    return counts.direction_balance(views.entries(t), views.puzzles(t))


@query
def debuts(spark, t):
    return counts.debuts(views.puzzles(t), LAST_YEAR)


@query
def debuts_suppliers(spark, t):
    return counts.debuts(views.dated(t), LAST_YEAR)


@query
def debut_setters(spark, t):
    return counts.debut_setters(views.puzzles(t))


@query
def debut_setters_suppliers(spark, t):
    return counts.debut_setters(views.dated(t))


@query
def month_season(spark, t):
    return counts.month_season(views.puzzles(t))


@query
def week_streak(spark, t):
    return streaks.week_streak(views.dated(t))


@query
def week_streak_across_years(spark, t):
    return streaks.week_streak(views.dated(t), unit="week")


@query
def month_streak(spark, t):
    return streaks.month_streak(views.dated(t))


# ---- sections kept up to date by delivery


# The columns that tell a section's rows apart, and what the rows say.
SECTION_COLUMNS = {
    "count_by_type": (["creator_name"], ["cryptic", "prize"]),
    "yearly_matrix": (["creator_name", "year"], ["n"]),
    "max_repeat": (["creator_name"], ["max_count"]),
    "bio_range": (["creator_name"], ["first_date", "last_date", "duration"]),
    "bio_totals": (["creator_name"], ["total", "total_cryptic", "total_prize", "self_refs"]),
    "bio_yearly": (["creator_name", "year"], ["n", "per_month"]),
    "yearly_by_type": (["creator_name", "year", "crossword_type"], ["n", "per_month"]),
    "self_ref": (["creator_name"], ["n"]),
    "top_answers": (["solution"], ["n"]),
    "unique_ratio": (["creator_name"], ["unique_solutions", "total_solutions", "ratio"]),
    "avg_text_len": (["creator_name"], ["avg_len"]),
    "direction_balance": (["creator_name"], ["across", "down"]),
    "debuts": (["year"], ["n_setters"]),
    "debut_setters": (["creator_name"], ["year"]),
    "month_season": (["month"], ["n"]),
}


def _long(table: DataFrame, section: str, keys: list[str], values: list[str]) -> DataFrame:
    """A section as (section, row, part, value) texts."""
    each = F.array(*[F.struct(F.lit(v).alias("part"), F.col(v).cast("string").alias("value")) for v in values])
    row = F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])
    return table.select(F.lit(section).alias("section"), row.alias("row"), F.inline(each))


@query
def sections_incremental(spark, t):
    """The sections of three deliveries, each reduced by itself when it comes."""
    folder = work_dir(spark, "partials")
    p, e = views.puzzles(t), views.entries(t)
    part = F.pmod(F.hash(F.col("crossword_id")), F.lit(3))
    for k in range(3):
        mine = p.where(F.pmod(F.hash(F.col("id")), F.lit(3)) == k)
        stored_partials.write(folder, f"delivery-{k}", mine, e.where(part == k))
    found = partials.sections(stored_partials.read(spark, folder), LAST_YEAR)
    return reduce(
        DataFrame.unionByName, [_long(found[s], s, *columns) for s, columns in SECTION_COLUMNS.items()]
    )


@query
def streaks_incremental(spark, t):
    """Streaks from the runs of three deliveries: odd days, then later ones, then the rest.

    The second delivery lengthens runs of the first, and the third, whose dates are all
    earlier than some known ones, closes gaps between runs.
    """
    path = work_dir(spark, "runs")
    dated = views.dated(t)
    odd, late = F.dayofmonth("date") % 2 == 1, F.year("date") >= 1996
    for k, part in enumerate((odd & ~late, odd & late, ~odd)):
        partials.runs(dated.where(part)).write.parquet(f"{path}/delivery={k}")
    rows = spark.read.schema(stored_partials.SCHEMAS["runs"]).parquet(path)
    merged = partials.merged("runs", rows)
    best = [
        streaks.longest_of(merged.where(F.col("unit") == unit), unit, sort=False).select(
            F.lit(unit).alias("unit"),
            "creator_name",
            "streak_length",
            *[F.col(c).cast("string").alias(c) for c in ("streak_start", "streak_end")],
            "streak_puzzles",
        )
        for unit in streaks.UNITS
    ]
    return reduce(DataFrame.unionByName, best)


# ---- result tables


ANSWERS, CLUES, LINKS = (tables.TABLES[n] for n in ("dup_answers", "dup_clues", "doc_links"))


def _uses(spec: tables.NamedTable, t: Tables) -> DataFrame:
    return spec.rows(views.entries(t), views.puzzles(t))


def _stored_views(spark: SparkSession, t: Tables) -> tuple[DataFrame, DataFrame]:
    """Entries and puzzles, written once for queries that read them many times."""
    derived = {"entries": views.entries(t), "puzzles": views.puzzles(t)}
    e, p = (tables.stored_rows(rows, work_dir(spark, name)) for name, rows in derived.items())
    return e, p


@query
def table_dup_answers(spark, t):
    return tables.table_groups(ANSWERS, _uses(ANSWERS, t))


@query
def table_dup_clues(spark, t):
    return tables.table_groups(CLUES, _uses(CLUES, t))


@query
def table_doc_links(spark, t):
    return tables.table_doc_links(None, views.puzzles(t))


@query
def table_total(spark, t):
    e, p = _stored_views(spark, t)
    totals = [
        tables.table_counts(spec, spec.rows(e, p)).select(
            F.lit(name).alias("table_name"), "records_total"
        )
        for name, spec in tables.TABLES.items()
    ]
    return totals[0].unionByName(totals[1]).unionByName(totals[2])


@query
def table_search(spark, t):
    found = tables.search_condition("blue%NATION_", ANSWERS.searchable)
    return tables.table_groups(ANSWERS, _uses(ANSWERS, t), [found])


@query
def table_search_literal(spark, t):
    links = tables.table_doc_links(None, views.puzzles(t))
    return tables.table_search(links, "n_1", ["creator_name", "link"], literal=True)


@query
def table_filtered_count(spark, t):
    return tables.table_counts(ANSWERS, _uses(ANSWERS, t), "Ring")


@query
def table_sort(spark, t):
    groups = tables.table_groups(ANSWERS, _uses(ANSWERS, t))
    return tables.table_sort(groups, 1, "DESC").select("creator_name", "solution")


@query
def table_page(spark, t):
    """A page of groups, cut on their keys, with the uses of its groups joined."""
    uses = tables.stored_rows(_uses(ANSWERS, t), work_dir(spark, "answers"))
    page = tables.table_page(tables.table_groups(ANSWERS, uses), 1, "desc", start=20, length=15)
    return tables.page_texts(ANSWERS, uses, page)


# A row that need not be in the table: the page begins with what follows it.
CURSOR = {"creator_name": "NATION_12", "link": "", "date_text": "1996-06-30"}


@query
def table_page_after(spark, t):
    links = tables.table_doc_links(None, views.puzzles(t))
    return tables.page_after(links, CURSOR, 2, "desc", length=25)


@query
def table_page_deep(spark, t):
    """The first, a middle and the last page of a table stored in its order."""
    links = tables.table_doc_links(None, views.puzzles(t))
    stored = page_index.write_sorted(links, work_dir(spark, "sorted"), 2, "desc", ranges=16)
    places = {"first": (0, 25), "middle": (stored.total // 2, 25), "last": (max(stored.total - 7, 0), 25)}
    found = [stored.page(*place).select("*", F.lit(name).alias("page")) for name, place in places.items()]
    return reduce(DataFrame.unionByName, found)


def _request(spark: SparkSession, t: Tables, name: str, **request: object) -> DataFrame:
    page = tables.table_request(
        name, views.entries(t), views.puzzles(t), work_dir(spark, name), **request
    )
    return page.data.select(
        "*",
        F.lit(page.draw).alias("draw"),
        F.lit(page.records_total).cast("bigint").alias("records_total"),
        F.lit(page.records_filtered).cast("bigint").alias("records_filtered"),
    )


@query
def table_page_full(spark, t):
    return _request(spark, t, "dup_answers", draw=3, search="nation_2", column=1, start=30, length=0)


@query
def table_page_full_links(spark, t):
    return _request(spark, t, "doc_links", draw=3, search="nation_2", column=2, start=30, length=0)


@query
def column_search(spark, t):
    """Groups for which the setter and some clue match, and not only one of them."""
    searches = {"creator_name": "nation_1", "clue": "blue%NATION_1"}
    found = [tables.search_condition(s, [c]) for c, s in searches.items()]
    return tables.table_groups(ANSWERS, _uses(ANSWERS, t), found)


@query
def column_search_links(spark, t):
    links = tables.table_doc_links(None, views.puzzles(t))
    return tables.column_search(links, {"creator_name": "nation_1", "date_text": "-07-", "link": ""})


# What is searched for: wildcards, capitals, too short for the index, in no text.
SEARCHES = {"wildcards": "blue%NATION_", "capitals": "RING n", "short": "9", "absent": "zqzq", "wild": "l_e%sh"}


def _index(spark: SparkSession, spec: tables.NamedTable, t: Tables) -> search_index.SearchIndex:
    rows = spec.rows(*_stored_views(spark, t))
    return search_index.write_search_index(spec, rows, work_dir(spark, "search"), parts=64)


@query
def table_search_indexed(spark, t):
    """Searches of one stored table through its index of trigrams."""
    index = _index(spark, ANSWERS, t)
    found = [index.search(text).select("*", F.lit(name).alias("search")) for name, text in SEARCHES.items()]
    return reduce(DataFrame.unionByName, found)


@query
def column_search_indexed(spark, t):
    """Setter and clue by themselves; `_` is what it is, no wildcard."""
    index = _index(spark, CLUES, t)
    return index.column_search({"creator_name": "nation_1", "clue": "Blue"}, literal=True)


# ---- grids


def _fingerprints(t: Tables) -> DataFrame:
    return grids.grid_fingerprint(views.grid_entries(t), **GRID)


def _catalogue(t: Tables) -> DataFrame:
    return views.common_grids(_fingerprints(t), COMMON)


def _matches(t: Tables) -> DataFrame:
    return grids.grid_match(_fingerprints(t), _catalogue(t))


@query
def grid_fingerprint(spark, t):
    return _fingerprints(t)


@query
def grid_match(spark, t):
    return _matches(t)


@query
def grid_names(spark, t):
    return grids.catalogue_names(_catalogue(t))


@query
def grid_annotate(spark, t):
    docs = _good(t).select("id", "name")
    return grids.grid_annotate(docs, _matches(t))


@query
def grid_usage(spark, t):
    return grids.grid_usage(_matches(t))
