"""The same queries as plain SQL, written independently of the operators."""

from __future__ import annotations

from periodica.plans.queries import COMMON, LAST_YEAR, LEAST, SEARCHES, SECTION_COLUMNS, STORED_UNTIL

_FX_PUZZLE = """
fx_puzzle AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS id, CAST(o.o_orderkey AS VARCHAR) AS number,
         n.n_name AS creator_name, CAST(o.o_orderdate AS DATE) AS date,
         CASE o.o_orderstatus WHEN 'F' THEN 'cryptic' WHEN 'P' THEN 'prize' ELSE 'other' END
           AS crossword_type,
         CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
              ELSE 'http://pdf.example/' || CAST(o.o_orderkey AS VARCHAR) || '.pdf' END AS pdf
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

_FX_ENTRY = """
fx_entry AS (
  SELECT CAST(k.l_orderkey AS VARCHAR) AS crossword_id,
         CAST(k.l_linenumber AS VARCHAR)
           || CASE k.l_linestatus WHEN 'F' THEN '-across' ELSE '-down' END AS entry_id,
         k.l_linenumber AS number, CAST(k.l_linenumber AS VARCHAR) AS human_number,
         CASE k.l_linestatus WHEN 'F' THEN 'across' ELSE 'down' END AS direction,
         CASE k.pk % 13
              WHEN 0 THEN 'See ' || CAST(k.l_linenumber % 7 + 1 AS VARCHAR)
              WHEN 1 THEN 'See ' || CAST(k.l_linenumber % 7 + 1 AS VARCHAR) || ' across'
              WHEN 2 THEN ' (6)'
              WHEN 3 THEN ''
              ELSE p.p_name || ' ' || n.n_name || ' (' || CAST(p.p_size AS VARCHAR) || ')' END
           AS clue,
         CASE WHEN k.pk % 5 = 0 THEN '' ELSE upper(replace(p.p_name, ' ', '')) END AS solution
  FROM (SELECT l_orderkey, l_linenumber, l_linestatus, MIN(l_partkey) AS pk
        FROM lineitem GROUP BY l_orderkey, l_linenumber, l_linestatus) k
       JOIN part p ON k.pk = p.p_partkey JOIN nation n ON n.n_nationkey = k.pk % 25)"""

_FX_DATED = """
fx_dated AS (
  SELECT s.s_name AS creator_name, CAST(l.l_shipdate AS DATE) AS date
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""

_JOINED = """
joined AS (
  SELECT e.*, p.creator_name, p.crossword_type, p.date, p.number AS cw_number
  FROM fx_entry e JOIN fx_puzzle p ON e.crossword_id = p.id)"""


def _resolved(is_reference: str) -> str:
    return f"""
hits AS (
  SELECT r.crossword_id, r.entry_id,
         arg_min(t.clue, (regexp_full_match(t.clue, 'See\\s+\\d+.*'), t.direction, t.entry_id)) AS found
  FROM fx_entry r JOIN fx_entry t USING (crossword_id)
  WHERE {is_reference.format("r.clue")}
    AND regexp_extract(r.clue, '\\d+') = t.human_number
    AND regexp_extract(r.clue, '^See\\s+\\d+\\s+(across|down)', 1) IN ('', t.direction)
  GROUP BY r.crossword_id, r.entry_id),
resolved AS (
  SELECT * FROM fx_entry WHERE NOT {is_reference.format("clue")}
  UNION ALL
  SELECT e.* REPLACE (h.found AS clue) FROM fx_entry e JOIN hits h USING (crossword_id, entry_id))"""


_PREFIX = _resolved("regexp_matches({0}, '^See\\s+\\d+')")
_FULL = _resolved("regexp_full_match({0}, 'See\\s+\\d+')")

_REAL = """
        clue <> ''
    AND NOT regexp_full_match(clue, '\\s+\\(\\d+\\)')
    AND NOT regexp_full_match(clue, 'See\\s+\\d+.*')
    AND NOT regexp_full_match(clue, 'See\\s+(clues|special)\\s+.*')
    AND NOT regexp_full_match(
          clue, 'Follow\\s+the\\s+link\\s+below\\s+to\\s+see\\s+today''s\\s+clues.*')"""


def _uses(shared: str) -> str:
    columns = ["crossword_id", "clue"] if shared == "clue" else ["crossword_id", "solution", "clue"]
    return f"""
real AS (
  SELECT DISTINCT {", ".join("e." + c for c in columns)}, p.creator_name, p.crossword_type, p.number
  FROM resolved e JOIN fx_puzzle p ON e.crossword_id = p.id
  WHERE {_REAL.replace("clue", "e.clue").replace("e.clues", "clues")}),
uses AS (
  SELECT creator_name, {shared}, COUNT(*) OVER w AS n_uses, number,
         {", ".join(c for c in columns if c != shared)}, crossword_type,
         '<a href="https://archive.example/' || crossword_id || '">' || number || '</a>' AS link
  FROM real
  WINDOW w AS (PARTITION BY creator_name, {shared})
  QUALIFY MIN(crossword_id) OVER w <> MAX(crossword_id) OVER w)"""


_ANSWERS = ",".join([_FX_PUZZLE, _FX_ENTRY, _PREFIX, _uses("solution")]) + """, answers AS (
  SELECT creator_name, solution, n_uses, clue AS clues, crossword_type AS types, link AS links
  FROM uses
  QUALIFY ROW_NUMBER() OVER (PARTITION BY creator_name, solution ORDER BY number, crossword_id, clue) = 1)"""
_CLUES = ",".join([_FX_PUZZLE, _FX_ENTRY, _PREFIX, _uses("clue")]) + """, repeated AS (
  SELECT creator_name, clue, n_uses, crossword_type AS types, link AS links
  FROM uses
  QUALIFY ROW_NUMBER() OVER (PARTITION BY creator_name, clue ORDER BY number, crossword_id) = 1)"""
_JOINED_TEXTS = """texts AS (
  SELECT creator_name, solution, COUNT(*) AS n_uses,
         string_agg(clue, '<br />' ORDER BY number, crossword_id, clue) AS clues,
         string_agg(crossword_type, '<br />' ORDER BY number, crossword_id, clue) AS types,
         string_agg(link, '<br />' ORDER BY number, crossword_id, clue) AS links,
         bool_or(creator_name ILIKE '%nation_2%' OR solution ILIKE '%nation_2%'
                 OR clue ILIKE '%nation_2%') AS hit
  FROM uses GROUP BY creator_name, solution)"""
_LINKS = f"""{_FX_PUZZLE}, links AS (
  SELECT creator_name, '<a href="' || pdf || '">' || number || '</a>' AS link,
         CAST(date AS VARCHAR) AS date_text
  FROM fx_puzzle WHERE pdf IS NOT NULL)"""

# Orders as nested documents; the broken ones never parse.
_DOCS = f"""{_FX_PUZZLE}, {_FX_ENTRY}, docs AS (
  SELECT p.*, substr(o.o_orderpriority, 1, 1) AS level,
         p.crossword_type = 'other' AND o.o_totalprice < 100000 AS broken
  FROM fx_puzzle p JOIN orders o ON p.id = CAST(o.o_orderkey AS VARCHAR)),
entry_counts AS (SELECT crossword_id, COUNT(*) AS n FROM fx_entry GROUP BY crossword_id),
good AS (
  SELECT d.*, COALESCE(c.n, 0) AS n_entries
  FROM docs d LEFT JOIN entry_counts c ON c.crossword_id = d.id WHERE NOT broken),
normal AS (
  SELECT id, CASE WHEN level = '2' THEN '<nil>' ELSE number END AS number,
         'Puzzle No ' || id AS name,
         CASE level WHEN '5' THEN 'Unknown' WHEN '4' THEN '' ELSE creator_name END AS creator_name,
         'http://www.example.org' AS creator_weburl,
         CASE WHEN level = '2' THEN DATE '1970-01-01' ELSE date END AS date,
         crossword_type, pdf, n_entries
  FROM good),
items AS (
  SELECT e.crossword_id, e.entry_id, e.number, e.human_number, e.clue, e.direction,
         CAST(length(e.solution) AS INTEGER) AS length, e.solution,
         e.number - 1 AS pos_x, 0 AS pos_y
  FROM fx_entry e JOIN good g ON e.crossword_id = g.id)"""

_LAYOUTS = f"""
cells AS (
  SELECT DISTINCT crossword_id, unnest([number - 1,
           CASE WHEN direction = 'across' THEN number ELSE number + 7 END]) AS cell
  FROM fx_entry),
prints AS (
  SELECT crossword_id, CAST(2 AS INTEGER) AS n_rows, CAST(8 AS INTEGER) AS n_cols,
         string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS fingerprint
  FROM cells GROUP BY crossword_id),
common AS (
  SELECT n_rows, n_cols, fingerprint, COUNT(*) AS n, 'G' || substr(md5(fingerprint), 1, 12) AS base
  FROM prints GROUP BY n_rows, n_cols, fingerprint HAVING COUNT(*) * {COMMON} >= (SELECT COUNT(*) FROM prints)),
catalogue AS (
  SELECT base AS grid_name, n_rows, n_cols, fingerprint FROM common
  UNION ALL
  SELECT base || 'b', n_rows, n_cols, fingerprint FROM common WHERE n * {COMMON} >= 3 * (SELECT COUNT(*) FROM prints)),
matched AS (
  SELECT p.crossword_id, p.n_rows, p.n_cols, p.fingerprint,
         MIN(c.grid_name) AS grid_name, COUNT(c.grid_name) AS n_names
  FROM prints p LEFT JOIN catalogue c
    ON c.fingerprint = p.fingerprint AND c.n_rows = p.n_rows AND c.n_cols = p.n_cols
  GROUP BY p.crossword_id, p.n_rows, p.n_cols, p.fingerprint)"""

_GRIDS = f"{_FX_ENTRY}, {_LAYOUTS}"

_UNESCAPED = (
    "replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', '©'),"
    " '&middot;', '·'), '&amp;', '&')"
)


def _streak(ordinal: str, label: str = "{0}") -> str:
    return f"""WITH {_FX_DATED}, periods AS (
  SELECT creator_name, {ordinal} AS period, MIN(date) AS first_date, COUNT(*) AS n
  FROM fx_dated GROUP BY creator_name, {ordinal}),
gaps AS (
  SELECT *, CASE WHEN period - lag(period) OVER w = 1 THEN 0 ELSE 1 END AS opens
  FROM periods WINDOW w AS (PARTITION BY creator_name ORDER BY period)),
marked AS (
  SELECT *, SUM(opens) OVER (PARTITION BY creator_name ORDER BY period) AS run FROM gaps),
runs AS (
  SELECT creator_name, COUNT(*) AS streak_length, MIN(first_date) AS streak_start,
         MAX(first_date) AS streak_end, CAST(SUM(n) AS BIGINT) AS streak_puzzles
  FROM marked GROUP BY creator_name, run)
SELECT creator_name, streak_length, {label.format("streak_start")} AS streak_start,
       {label.format("streak_end")} AS streak_end, streak_puzzles
FROM runs
QUALIFY row_number() OVER (PARTITION BY creator_name
                           ORDER BY streak_length DESC, runs.streak_start) = 1"""


def _debuts(source: str, view: str, names: bool = False) -> str:
    firsts = f"""WITH {view}, firsts AS (
  SELECT CAST(EXTRACT(YEAR FROM MIN(date)) AS INTEGER) AS year, creator_name
  FROM {source} GROUP BY creator_name)"""
    if names:
        return f"{firsts} SELECT year, creator_name FROM firsts"
    return f"""{firsts}, spine AS (
  SELECT CAST(unnest(range((SELECT MIN(year) FROM firsts), {LAST_YEAR} + 1)) AS INTEGER) AS year)
SELECT s.year, COUNT(f.creator_name) AS n_setters
FROM spine s LEFT JOIN firsts f ON f.year = s.year GROUP BY s.year"""


_TWO = f"{_FX_PUZZLE}, {_FX_ENTRY}, {_JOINED}"

ORACLES: dict[str, str] = {
    "scan_json": f"""WITH {_DOCS}
SELECT id, CASE WHEN level = '2' THEN NULL ELSE number END AS number,
       CASE level WHEN '5' THEN NULL WHEN '4' THEN '  '
                  WHEN '3' THEN creator_name || ' ' || chr(9) ELSE creator_name END AS creator,
       crossword_type AS "crosswordType", n_entries
FROM good""",
    "puzzle_norm": f"WITH {_DOCS} SELECT * EXCLUDE (n_entries) FROM normal",
    "entry_explode": f"WITH {_DOCS} SELECT * FROM items",
    "dedupe_first_wins": """
SELECT sha256(text) AS digest, doc_id, lang, source, n_chars
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""",
    "append_new": f"""WITH {_FX_PUZZLE}
SELECT * FROM fx_puzzle
WHERE id NOT IN (SELECT id FROM fx_puzzle WHERE date < DATE '{STORED_UNTIL}')""",
    "quarantine": f"""WITH {_DOCS}
SELECT id, CASE WHEN broken THEN 'bad' ELSE 'good' END AS status FROM docs""",
    "quarantine_kinds": f"""WITH {_DOCS}, kinds AS (
  SELECT id, CAST(id AS BIGINT) % 16 AS kind,
         CASE WHEN broken OR CAST(id AS BIGINT) % 16 IN (1, 2, 3, 12, 14) THEN 'not one JSON object'
              WHEN CAST(id AS BIGINT) % 16 IN (5, 9) THEN 'wrong type'
              WHEN CAST(id AS BIGINT) % 16 = 8 THEN 'no such date' END AS reason
  FROM docs)
SELECT id AS doc_key, CASE WHEN reason IS NULL THEN id END AS id,
       CASE WHEN reason IS NULL THEN CASE kind WHEN 10 THEN 'renamed' ELSE 'Puzzle No ' || id END END
         AS name, reason
FROM kinds""",
    "first_documents": f"""WITH {_DOCS}
SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'First No ' ELSE 'Other No ' END || id AS name
FROM good""",
    "import_documents": f"""WITH {_DOCS}
SELECT id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'First No ' ELSE 'Other No ' END || id AS name,
       CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'import-000001' ELSE 'import-000002' END AS batch,
       n_entries
FROM good""",
    "integrity_check": f"""WITH {_FX_PUZZLE}, {_FX_ENTRY}, known AS (
  SELECT id FROM fx_puzzle WHERE date < DATE '{STORED_UNTIL}'
  UNION ALL SELECT id FROM fx_puzzle WHERE crossword_type = 'prize')
SELECT 'duplicate' AS problem, id AS key, COUNT(*) AS n FROM known GROUP BY id HAVING COUNT(*) > 1
UNION ALL
SELECT 'orphan', crossword_id, COUNT(*) FROM fx_entry
WHERE crossword_id NOT IN (SELECT id FROM known) GROUP BY crossword_id""",
    "stream_ingest": f"""WITH {_DOCS}
SELECT id, number, creator_name, date, crossword_type, n_entries FROM normal""",
    "grid_scan": f"""WITH {_GRIDS}, shared AS (
  SELECT n_rows, n_cols, fingerprint, COUNT(*) AS n, 'G' || substr(md5(fingerprint), 1, 12) AS base
  FROM prints GROUP BY n_rows, n_cols, fingerprint HAVING COUNT(*) >= {LEAST})
SELECT base AS grid_name, n_rows, n_cols, fingerprint, NULL::VARCHAR AS reason FROM shared
UNION ALL
SELECT base || 'b', n_rows, n_cols, fingerprint, NULL FROM shared WHERE n >= 3 * {LEAST}
UNION ALL
SELECT unnest(['ragged', 'words']), NULL, NULL, NULL,
       unnest(['lines of different lengths', 'not a number'])""",
    "sink_rows_json": f"WITH {_LINKS} SELECT * FROM links",
    "sink_table": f"""WITH {_DOCS}
SELECT * EXCLUDE (n_entries), CAST(EXTRACT(YEAR FROM date) AS INTEGER) AS year FROM normal""",
    "sink_table_entries": f"WITH {_DOCS} SELECT * FROM items",
    "page_props": f"""
SELECT page_id,
       {_UNESCAPED.format("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si')")} AS title,
       regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
       {_UNESCAPED.format('''array_to_string(
         regexp_extract_all(html, '<li(?:\\s[^>]*)?>(.*?)</li>', 1, 'si'), '|')''')} AS items,
       md5({_UNESCAPED.format("html")}) AS text_digest
FROM pages""",
    "page_documents": f"""WITH {_DOCS}
SELECT 'http://archive.example/' || d.id AS url,
       CASE WHEN broken OR CAST(d.id AS BIGINT) % 7 = 2 THEN 'not JSON'
            WHEN CAST(d.id AS BIGINT) % 7 = 1 THEN 'accepted'
            WHEN level = '5' THEN 'no creator' ELSE 'accepted' END AS outcome,
       CASE WHEN broken OR level = '5' OR CAST(d.id AS BIGINT) % 7 IN (1, 2) THEN NULL
            WHEN level = '4' THEN '  '
            WHEN level = '3' THEN creator_name || ' ' || chr(9) ELSE creator_name END AS creator,
       CASE WHEN broken OR CAST(d.id AS BIGINT) % 7 = 2 THEN NULL
            WHEN CAST(d.id AS BIGINT) % 7 = 1 OR level = '5' THEN NULL
            ELSE COALESCE(c.n, 0) END AS n_entries
FROM docs d LEFT JOIN entry_counts c ON c.crossword_id = d.id""",
    "resolve_refs_prefix": f"WITH {_FX_ENTRY}, {_PREFIX} SELECT * FROM resolved",
    "resolve_refs_full": f"WITH {_FX_ENTRY}, {_FULL} SELECT * FROM resolved",
    "count_by_type": f"""WITH {_FX_PUZZLE}
SELECT creator_name, COUNT(*) FILTER (WHERE crossword_type = 'cryptic') AS cryptic,
       COUNT(*) FILTER (WHERE crossword_type = 'prize') AS prize
FROM fx_puzzle GROUP BY creator_name""",
    "yearly_matrix": f"""WITH {_FX_PUZZLE}, spine AS (
  SELECT creator_name, CAST(unnest(range(1998, {LAST_YEAR} + 1)) AS INTEGER) AS year
  FROM (SELECT DISTINCT creator_name FROM fx_puzzle))
SELECT s.creator_name, s.year, COUNT(p.id) AS n
FROM spine s LEFT JOIN fx_puzzle p
  ON p.creator_name = s.creator_name AND EXTRACT(YEAR FROM p.date) = s.year
GROUP BY s.creator_name, s.year""",
    "max_repeat": f"""WITH {_TWO}
SELECT creator_name, MAX(n) AS max_count
FROM (SELECT creator_name, solution, COUNT(*) AS n FROM joined
      GROUP BY creator_name, solution HAVING COUNT(*) > 1)
GROUP BY creator_name""",
    # Whole months counted by the engine itself; the days are what is left beyond them.
    "bio_range": f"""WITH {_FX_PUZZLE}, spans AS (
  SELECT creator_name, MIN(date) AS first_date, MAX(date) AS last_date
  FROM fx_puzzle GROUP BY creator_name),
whole AS (
  SELECT *, datesub('month', first_date, last_date) AS m FROM spans),
rest AS (
  SELECT *, CASE WHEN day(last_date) >= day(first_date) THEN day(last_date) - day(first_date)
                 ELSE day(last_day(last_date - INTERVAL 1 MONTH)) - day(first_date) + day(last_date)
            END AS d
  FROM whole)
SELECT creator_name, first_date, last_date,
       CAST(m // 12 AS VARCHAR) || ' years, ' || CAST(m % 12 AS VARCHAR) || ' months, '
       || CAST(d + 1 AS VARCHAR) || ' days' AS duration
FROM rest""",
    "self_ref": f"""WITH {_TWO}
SELECT creator_name, COUNT(*) AS n FROM joined
WHERE position(creator_name IN clue) > 0 GROUP BY creator_name""",
    "yearly_by_type": f"""WITH {_FX_PUZZLE}
SELECT creator_name, CAST(EXTRACT(YEAR FROM date) AS INTEGER) AS year, crossword_type,
       COUNT(*) AS n, CAST(CEIL(CAST(COUNT(*) AS DOUBLE) / 12) AS INTEGER) AS per_month
FROM fx_puzzle GROUP BY 1, 2, 3""",
    "bio_totals": f"""WITH {_TWO}, refs AS (
  SELECT creator_name, COUNT(*) AS n FROM joined
  WHERE position(creator_name IN clue) > 0 GROUP BY creator_name)
SELECT p.creator_name, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE crossword_type = 'cryptic') AS total_cryptic,
       COUNT(*) FILTER (WHERE crossword_type = 'prize') AS total_prize,
       COALESCE(MAX(r.n), 0) AS self_refs
FROM fx_puzzle p LEFT JOIN refs r ON r.creator_name = p.creator_name
GROUP BY p.creator_name""",
    "bio_yearly": f"""WITH {_FX_PUZZLE}
SELECT creator_name, CAST(EXTRACT(YEAR FROM date) AS INTEGER) AS year, COUNT(*) AS n,
       CAST(CEIL(CAST(COUNT(*) AS DOUBLE) / 12) AS INTEGER) AS per_month
FROM fx_puzzle GROUP BY 1, 2""",
    "dup_answers": f"WITH {_ANSWERS} SELECT * FROM uses",
    "dup_clues": f"WITH {_CLUES} SELECT * FROM uses",
    "doc_links": f"WITH {_LINKS} SELECT * FROM links",
    "top_answers": f"""WITH {_FX_ENTRY}
SELECT solution, COUNT(*) AS n FROM fx_entry WHERE solution IS NOT NULL AND solution <> ''
GROUP BY solution ORDER BY n DESC, solution LIMIT 50""",
    "unique_ratio": f"""WITH {_TWO}
SELECT creator_name, COUNT(DISTINCT solution) AS unique_solutions,
       COUNT(solution) AS total_solutions,
       ROUND(100.0 * COUNT(DISTINCT solution) / COUNT(solution), 1) AS ratio
FROM joined WHERE solution IS NOT NULL AND solution <> '' GROUP BY creator_name""",
    "unique_ratio_approx": f"""WITH {_TWO}
SELECT creator_name, COUNT(DISTINCT solution) AS unique_solutions,
       COUNT(solution) AS total_solutions, TRUE AS close
FROM joined WHERE solution IS NOT NULL AND solution <> '' GROUP BY creator_name""",
    "avg_text_len": f"""WITH {_TWO}
SELECT creator_name,
       ROUND(AVG(LENGTH(TRIM(regexp_replace(clue, '\\s*\\([\\d,\\-]+\\)\\s*$', '')))), 1) AS avg_len
FROM joined WHERE clue IS NOT NULL AND clue <> '' GROUP BY creator_name""",
    "avg_document_len": """
SELECT source,
       ROUND(AVG(LENGTH(TRIM(regexp_replace(text, '\\s*\\([\\d,\\-]+\\)\\s*$', '')))), 1) AS avg_len
FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY source""",
    "direction_balance": f"""WITH {_TWO}
SELECT creator_name, COUNT(*) FILTER (WHERE direction = 'across') AS across,
       COUNT(*) FILTER (WHERE direction = 'down') AS down
FROM joined WHERE direction IN ('across', 'down') GROUP BY creator_name""",
    "debuts": _debuts("fx_puzzle", _FX_PUZZLE),
    "debuts_suppliers": _debuts("fx_dated", _FX_DATED),
    "debut_setters": _debuts("fx_puzzle", _FX_PUZZLE, names=True),
    "debut_setters_suppliers": _debuts("fx_dated", _FX_DATED, names=True),
    "month_season": f"""WITH {_FX_PUZZLE}, spine AS (
  SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month)
SELECT s.month, strftime(make_date(2000, s.month, 1), '%b') AS month_name, COUNT(p.id) AS n
FROM spine s LEFT JOIN fx_puzzle p ON EXTRACT(MONTH FROM p.date) = s.month
GROUP BY s.month""",
    "week_streak": _streak("EXTRACT(ISOYEAR FROM date) * 100 + EXTRACT(WEEK FROM date)"),
    "week_streak_across_years": _streak(
        "CAST(floor(datediff('day', DATE '1970-01-05', date) / 7.0) AS BIGINT)"
    ),
    "month_streak": _streak(
        "EXTRACT(YEAR FROM date) * 12 + EXTRACT(MONTH FROM date)", "strftime({0}, '%Y-%m')"
    ),
    "table_dup_answers": f"WITH {_ANSWERS} SELECT * FROM answers",
    "table_dup_clues": f"WITH {_CLUES} SELECT * FROM repeated",
    "table_doc_links": f"WITH {_LINKS} SELECT * FROM links",
    "table_total": f"""
SELECT 'dup_answers' AS table_name, COUNT(*) AS records_total FROM (WITH {_ANSWERS} SELECT * FROM answers)
UNION ALL
SELECT 'dup_clues', COUNT(*) FROM (WITH {_CLUES} SELECT * FROM repeated)
UNION ALL
SELECT 'doc_links', COUNT(*) FROM (WITH {_LINKS} SELECT * FROM links)""",
    "table_search": f"""WITH {_ANSWERS}
SELECT * FROM answers WHERE (creator_name, solution) IN (
  SELECT (creator_name, solution) FROM uses
  WHERE creator_name ILIKE '%blue%NATION_%' OR solution ILIKE '%blue%NATION_%'
     OR clue ILIKE '%blue%NATION_%')""",
    "table_search_literal": f"""WITH {_LINKS}
SELECT * FROM links WHERE contains(lower(creator_name), 'n_1') OR contains(lower(link), 'n_1')""",
    "table_filtered_count": f"""WITH {_ANSWERS}
SELECT (SELECT COUNT(*) FROM answers) AS records_total,
       (SELECT COUNT(DISTINCT (creator_name, solution)) FROM uses
        WHERE creator_name ILIKE '%Ring%' OR solution ILIKE '%Ring%' OR clue ILIKE '%Ring%')
         AS records_filtered""",
    "table_sort": f"""WITH {_ANSWERS}
SELECT creator_name, solution FROM answers ORDER BY solution DESC, creator_name""",
    "table_page": f"""WITH {_ANSWERS}, {_JOINED_TEXTS}
SELECT * EXCLUDE (hit) FROM texts ORDER BY solution DESC, creator_name LIMIT 15 OFFSET 20""",
    "table_page_after": f"""WITH {_LINKS}
SELECT * FROM links
WHERE date_text < '1996-06-30'
   OR date_text = '1996-06-30' AND (creator_name > 'NATION_12' OR creator_name = 'NATION_12' AND link > '')
ORDER BY date_text DESC, creator_name, link LIMIT 25""",
    "table_page_deep": f"""WITH {_LINKS}, numbered AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY date_text DESC, creator_name, link) - 1 AS place,
         COUNT(*) OVER () AS total FROM links)
SELECT creator_name, link, date_text, 'first' AS page FROM numbered WHERE place < 25
UNION ALL
SELECT creator_name, link, date_text, 'middle' FROM numbered
WHERE place >= total // 2 AND place < total // 2 + 25
UNION ALL
SELECT creator_name, link, date_text, 'last' FROM numbered WHERE place >= total - 7""",
    "table_page_full": f"""WITH {_ANSWERS}, {_JOINED_TEXTS}
SELECT creator_name, solution, clues, types, links, CAST(3 AS INTEGER) AS draw,
       (SELECT COUNT(*) FROM texts) AS records_total,
       (SELECT COUNT(*) FROM texts WHERE hit) AS records_filtered
FROM texts WHERE hit ORDER BY solution, creator_name LIMIT 10 OFFSET 30""",
    "table_page_full_links": f"""WITH {_LINKS}, hits AS (
  SELECT * FROM links WHERE creator_name ILIKE '%nation_2%' OR link ILIKE '%nation_2%'
                         OR date_text ILIKE '%nation_2%')
SELECT h.*, CAST(3 AS INTEGER) AS draw, (SELECT COUNT(*) FROM links) AS records_total,
       (SELECT COUNT(*) FROM hits) AS records_filtered
FROM hits h ORDER BY date_text, creator_name, link LIMIT 10 OFFSET 30""",
    "column_search": f"""WITH {_ANSWERS}
SELECT * FROM answers
WHERE creator_name ILIKE '%nation_1%' AND (creator_name, solution) IN (
  SELECT (creator_name, solution) FROM uses WHERE clue ILIKE '%blue%NATION_1%')""",
    "table_search_indexed": f"WITH {_ANSWERS}\n" + "\nUNION ALL\n".join(
        f"""SELECT *, '{name}' AS search FROM answers WHERE (creator_name, solution) IN (
  SELECT (creator_name, solution) FROM uses
  WHERE creator_name ILIKE '%{text}%' OR solution ILIKE '%{text}%' OR clue ILIKE '%{text}%')"""
        for name, text in SEARCHES.items()
    ),
    "column_search_indexed": f"""WITH {_CLUES}
SELECT * FROM repeated
WHERE contains(lower(creator_name), 'nation_1') AND contains(lower(clue), 'blue')""",
    "column_search_links": f"""WITH {_LINKS}
SELECT * FROM links WHERE creator_name ILIKE '%nation_1%' AND contains(date_text, '-07-')""",
    "grid_fingerprint": f"WITH {_GRIDS} SELECT * FROM prints",
    "grid_match": f"WITH {_GRIDS} SELECT * FROM matched",
    "grid_names": f"""WITH {_GRIDS}
SELECT grid_name, MIN(grid_name) OVER (PARTITION BY n_rows, n_cols, fingerprint) AS canonical_name
FROM catalogue""",
    "grid_annotate": f"""WITH {_DOCS}, {_LAYOUTS}
SELECT g.id, 'Puzzle No ' || g.id AS name, m.grid_name AS "_gridType"
FROM good g LEFT JOIN matched m ON m.crossword_id = g.id""",
    "grid_usage": f"""WITH {_GRIDS}
SELECT grid_name, COUNT(*) AS n FROM matched GROUP BY grid_name""",
}


def _long(section: str, keys: list[str], values: list[str]) -> str:
    row = " || ' ' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    parts = ", ".join(f"'{v}'" for v in values)
    texts = ", ".join(f"CAST({v} AS VARCHAR)" for v in values)
    return f"""SELECT '{section}' AS section, {row} AS "row", unnest([{parts}]) AS part,
       unnest([{texts}]) AS value FROM ({ORACLES[section]})"""


ORACLES["sections_incremental"] = "\nUNION ALL\n".join(
    _long(s, *columns) for s, columns in SECTION_COLUMNS.items()
)
ORACLES["streaks_incremental"] = "\nUNION ALL\n".join(
    f"""SELECT '{unit}' AS unit, creator_name, streak_length, CAST(streak_start AS VARCHAR) AS streak_start,
       CAST(streak_end AS VARCHAR) AS streak_end, streak_puzzles FROM ({ORACLES[key]})"""
    for unit, key in (
        ("isoweek_code", "week_streak"), ("week", "week_streak_across_years"), ("month", "month_streak")
    )
)
ORACLES["stream_ingest_state"] = f"""WITH {_DOCS}, numbered AS (
  SELECT id, CAST(id AS BIGINT) AS k, n_entries FROM good)
SELECT id,
       CASE WHEN k % 5 = 0 THEN 'Stored No ' WHEN k % 2 = 0 THEN 'First No '
            WHEN k % 3 = 0 THEN 'Second No ' ELSE 'Third No ' END || id AS name,
       CASE WHEN k % 5 = 0 THEN 'import-000001' WHEN k % 2 = 0 THEN 'arrival-000000'
            WHEN k % 3 = 0 THEN 'arrival-000001' ELSE 'arrival-000002' END AS batch,
       n_entries
FROM numbered"""
