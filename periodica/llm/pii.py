"""Personal data by fixed patterns, and by contexts bootstrapped from what those find.

What the fixed patterns find are seeds.  The two words before a seed are a lexical pattern.
Looser candidates (number runs, addresses with an at sign) that follow the same words form,
with the seeds, a graph of patterns and instances.  It is scored in turns: a pattern by the
share of its instances that are known to be of a kind, an instance by its best pattern.
Instances of patterns of high confidence are accepted and join the seeds for the next turn,
until a turn accepts none.
Everything is built from Spark's own expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from periodica.llm.common import put_back, set_aside, staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns.  Two rewritings leave the matches as they are: repeats whose
# giving back could not help are possessive, so that long runs need neither stack nor
# retries; and a match does not begin inside a run whose first character has failed already,
# unless the match before ended there.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms: at least seven digits with single signs between, or text around an at sign.
CANDIDATE = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+|(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++"
# The last two words; a match begins where a word does, so that long words are read once.
CONTEXT = r"(?<!\S)(\S++\s++\S++)\s*+$"

LEAST_SEEDS = 3
CONFIDENCE = 0.8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.pmod(2 * d.cast("int"), F.lit(10)) + F.when(d.cast("int") > 4, 1).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255
        )
        return F.forall(F.split(value, r"\."), small)
    digits = _digits(value)
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    return n.between(10, 15)


_SPAN = "struct<start:int,kind:int,end:int,value:string,left:string>"
# Values of a running total that are reached by appending; larger arrays go by such chunks.
CHUNK = 128
# Code points of the pieces that a text is cut into before its spans are replaced.
PIECE = 4096


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _at(values: Column, i: Column, default: int = 0) -> Column:
    return F.coalesce(F.get(values, i), F.lit(default).cast("bigint"))


def _upto(n: Column) -> Column:
    """0 to n - 1; nothing for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _running(values: Column, merge) -> Column:
    """The running totals of an array of bigint, as `merge` unites two of them.

    Appending copies an array, so it is done by chunks, and again over what the chunks give.
    """

    def totals(of: Column, indexes: Column) -> Column:
        return F.aggregate(
            indexes,
            F.array().cast("array<bigint>"),
            lambda done, i: F.array_append(done, merge(_at(done, F.size(done) - 1), F.get(of, i))),
        )

    def whole(v: Column) -> Column:
        last = lambda k: F.least(F.size(v), (k + 1) * CHUNK) - 1
        chunks = F.transform(
            _upto(F.ceil(F.size(v) / CHUNK).cast("int")),
            lambda k: totals(v, F.sequence(k * CHUNK, last(k))),
        )
        return _let(
            chunks,
            lambda c: _let(
                _let(
                    F.transform(c, lambda one: F.get(one, F.size(one) - 1)),
                    lambda ends: totals(ends, _upto(F.size(ends))),
                ),
                lambda before: F.flatten(
                    F.transform(c, lambda one, k: F.transform(one, lambda x: merge(_at(before, k - 1), x)))
                ),
            ),
        )

    return _let(values, whole)


def _placed(hits: Column, parts: Column, kind: int) -> Column:
    """Spans of the hits, from the texts between them."""
    lengths = F.transform(hits, lambda hit, i: (F.length(F.get(parts, i)) + F.length(hit)).cast("bigint"))

    def span(end: Column, i: Column) -> Column:
        hit = F.get(hits, i)
        left = F.lower(F.regexp_extract(F.get(parts, i), CONTEXT, 1))
        return F.struct(
            (end.cast("int") - F.length(hit)).alias("start"),
            F.lit(kind).alias("kind"),
            end.cast("int").alias("end"),
            hit.alias("value"),
            F.regexp_replace(left, r"\s+", " ").alias("left"),
        )

    return F.when(
        F.size(hits) > 0, F.transform(_running(lengths, lambda a, b: a + b), span)
    ).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _apart(candidates: Column, base: Column) -> Column:
    """The candidates, which are in order and do not overlap, that no base span overlaps.

    As many spans overlap one as begin before its end, less those that end by its start.
    Starts and ends stand in one order with both questions, so running counts answer them.
    """
    begins, ends = 1 << 32, 1
    event = lambda at, turn, weight: F.struct(
        at.alias("at"), F.lit(turn).alias("turn"), F.lit(weight).cast("bigint").alias("weight")
    )
    events = F.array_sort(
        F.concat(
            F.transform(candidates, lambda c: event(c["end"], 0, 0)),
            F.transform(base, lambda s: event(s["end"], 1, ends)),
            F.transform(base, lambda s: event(s["start"], 2, begins)),
            F.transform(candidates, lambda c: event(c["start"], 3, 0)),
        )
    )

    def answers(e: Column, counts: Column, turn: int) -> Column:
        asked = F.filter(counts, lambda _, i: F.get(e, i)["turn"] == turn)
        return F.transform(asked, lambda n: F.shiftright(n, 32) if turn == 0 else n.bitwiseAND(F.lit(begins - 1)))

    def kept(begun: Column, ended: Column) -> Column:
        return F.filter(candidates, lambda _, i: F.get(begun, i) <= F.get(ended, i))

    found = _let(
        events,
        lambda e: _let(
            _running(F.transform(e, lambda x: x["weight"]), lambda a, b: a + b),
            lambda counts: _let(
                answers(e, counts, 0),
                lambda begun: _let(answers(e, counts, 3), lambda ended: kept(begun, ended)),
            ),
        ),
    )
    return F.when((F.size(candidates) > 0) & (F.size(base) > 0), found).otherwise(candidates)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base`, the valid spans of the fixed patterns, and `candidates` beside them."""
    none = F.array().cast("array<string>")
    digits, at = F.col("_text").rlike("[0-9]"), F.contains("_text", F.lit("@"))
    worth = {
        "email": at,
        "ip": digits & F.contains("_text", F.lit(".")),
        "card": digits,
        "phone": digits & F.contains("_text", F.lit("+")),
        "_": digits | at,
    }
    patterns = PATTERNS | {"_": CANDIDATE}
    found = docs.withColumn("_text", text_or_empty(text)).withColumns(
        {
            f"_hits_{k}": F.when(worth[k], F.regexp_extract_all("_text", F.lit(p), 0)).otherwise(none)
            for k, p in patterns.items()
        }
    )
    found = found.withColumns(
        {
            f"_parts_{k}": F.when(F.size(f"_hits_{k}") > 0, F.split("_text", p, -1)).otherwise(none)
            for k, p in patterns.items()
        }
    )
    found = found.withColumns(
        {
            f"_spans_{k}": _placed(F.col(f"_hits_{k}"), F.col(f"_parts_{k}"), n)
            for n, k in enumerate(patterns)
        }
    )

    def valid(kind: str) -> Column:
        return F.filter(f"_spans_{kind}", lambda s: _valid(kind, s["value"]))

    found = found.withColumn("base", F.array_sort(F.concat(*map(valid, KINDS))))
    apart = _apart(F.col("_spans__"), F.col("base"))
    return found.withColumn("candidates", apart).drop(
        "_text", *[f"_{part}_{k}" for k in patterns for part in ("hits", "parts", "spans")]
    )


def _normal(value: Column) -> Column:
    """What makes two findings the same instance."""
    return F.when(F.contains(value, F.lit("@")), F.lower(value)).otherwise(_digits(value))


def _edges(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("s")).select(
        F.col("s.left").alias("pattern"), _normal(F.col("s.value")).alias("instance"), F.col("s.kind").alias("kind")
    )


def accepted_instances(
    rows: DataFrame, least: int = LEAST_SEEDS, confidence: float = CONFIDENCE
) -> DataFrame:
    """(instance, kind) of the candidates that patterns of high confidence discover.

    rows: with base and candidates.  A pattern needs `least` different known instances of a
    kind, and these must be at least the share `confidence` of all its instances; a candidate
    takes the kind of its most confident pattern, the earlier kind on a tie, in the first
    turn that accepts it, and keeps it.  So every turn but the last adds an instance.
    """
    seeds = _edges(rows, "base").where("pattern <> ''").distinct()
    others = _edges(rows, "candidates").where("pattern <> ''").select("pattern", "instance").distinct()
    seeds, others = staged(seeds, "seeds"), staged(others, "candidates")
    graph = staged(seeds.select("pattern", "instance").union(others).distinct(), "graph")
    totals = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_all"))
    found = seeds.select("instance", "kind").limit(0)
    turn = 0
    while True:
        known = seeds.select("instance", "kind").union(found).distinct()
        strong = (
            graph.join(known, "instance")
            .groupBy("pattern", "kind")
            .agg(F.count(F.lit(1)).alias("n_known"))
            .where(F.col("n_known") >= least)
            .join(totals, "pattern")
            .withColumn("confidence", F.col("n_known") / F.col("n_all"))
            .where(F.col("confidence") >= confidence)
        )
        best = F.max_by("kind", F.struct("confidence", -F.col("kind")))
        fresh = others.join(found, "instance", "left_anti").join(strong, "pattern")
        fresh = staged(fresh.groupBy("instance").agg(best.alias("kind")), f"accepted-{turn}")
        if fresh.isEmpty():
            return found
        found = staged(found.union(fresh), f"found-{turn}") if turn else fresh
        turn += 1


def with_spans(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds `base` and `spans`, arrays of (start, kind, end, value, left) in order.

    Places are code points, the end exclusive.  Every row stays, whatever its id; a null
    text has no spans; an empty table gives an empty one.  Spans that the contexts add do
    not overlap the base spans, and base spans always stay.  The rows are staged once, with
    the text only on request.
    """
    rows = with_base(docs, text).withColumn("_row", F.monotonically_increasing_id())
    rows = staged(rows if keep_text else rows.drop(text), "spans")
    found = accepted_instances(rows).withColumnRenamed("kind", "_kind")
    added = (
        rows.where(F.size("candidates") > 0)
        .select("_row", F.explode("candidates").alias("s"))
        .withColumn("instance", _normal(F.col("s.value")))
        .join(found, "instance")
        .groupBy("_row")
        .agg(
            F.collect_list(
                F.struct("s.start", F.col("_kind").alias("kind"), "s.end", "s.value", "s.left")
            ).alias("_added")
        )
    )
    added = staged(added, "added")  # its size then decides how it is joined
    nothing = F.array().cast(f"array<{_SPAN}>")
    return (
        rows.join(added, "_row", "left")
        .withColumn("spans", F.array_sort(F.concat("base", F.coalesce("_added", nothing))))
        .drop("_row", "_added", "candidates")
    )


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, by start and then kind, joined by commas."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def redacted(text: str, spans: str) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping ones
    the first names them all."""
    spans = F.col(spans)

    def mark(kind: Column) -> Column:
        return reduce(
            lambda rest, i: F.when(kind == i, F.lit(f"<{KINDS[i].upper()}>")).otherwise(rest),
            range(len(KINDS)),
            F.lit(""),
        )

    def cut(pieces: Column, start: Column, end: Column) -> Column:
        """The text from start to end, of which only what it takes is walked over."""
        a, b = ((x / PIECE).cast("int") for x in (start, end))
        from_a = F.coalesce(F.get(pieces, a), F.lit(""))
        to_b = F.substring(F.coalesce(F.get(pieces, b), F.lit("")), F.lit(1), (end % PIECE).cast("int"))
        inner = F.when(
            b - a > 1, F.array_join(F.transform(F.sequence(a + 1, b - 1), lambda k: F.get(pieces, k)), "")
        ).otherwise("")
        first = (start % PIECE).cast("int") + 1
        return F.when(end <= start, "").when(
            a == b, F.substring(from_a, first, (end - start).cast("int"))
        ).otherwise(F.concat(F.substring(from_a, first, F.lit(PIECE)), inner, to_b))

    def whole(pieces: Column, reached: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            before = _at(reached, i - 1)
            return F.when(
                s["start"] >= before, F.concat(cut(pieces, before, s["start"]), mark(s["kind"]))
            ).otherwise("")

        n = ((F.size(pieces) - 1) * PIECE + F.length(F.get(pieces, F.size(pieces) - 1))).cast("bigint")
        rest = cut(pieces, _at(reached, F.size(reached) - 1), n)
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    ends = _running(F.transform(spans, lambda s: s["end"].cast("bigint")), F.greatest)
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)
    done = _let(pieces, lambda p: _let(ends, lambda reached: whole(p, reached)))
    return F.when(F.size(spans) > 0, done).otherwise(F.col(text))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with their personal data replaced in the text."""
    found = with_spans(set_aside(docs, "text"))
    return put_back(found.withColumn("text", redacted("text", "spans")), docs.columns)
