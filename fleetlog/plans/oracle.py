"""ANSI SQL (DuckDB dialect) for every registered query.

The tables named in the SQL are the driver's parquet views; the log table
is derived inline with the same rules as :mod:`fleetlog.sources.fixtures`.
"""

from __future__ import annotations

from ..functions import porter
from ..functions.text import STOP_WORDS

_E_P = """e AS (
  SELECT event_id, ts, user_id, event_type, props,
         concat('node-', user_id % 5) AS node, user_id % 12 AS tid,
         CAST(row_number() OVER (PARTITION BY user_id % 5, user_id % 12 ORDER BY ts, event_id) - 1 AS BIGINT) AS k
  FROM events),
p AS (SELECT *, k % 8 AS pos, CAST(floor(k / 8.0) AS BIGINT) AS cyc FROM e)"""


def _logs_body(mismatched: bool, hard: bool = False) -> str:
    lost = "WHEN pos = 3 AND cyc % 11 = 5 THEN 'LostTask' " if mismatched or hard else ""
    time = "ts"
    if hard:
        lost = "WHEN pos = 7 AND cyc % 3 = 1 THEN 'ProcessOrderBatchFr' " + lost
        time = "CASE WHEN pos IN (4, 5) AND cyc % 7 = 3 THEN ts - INTERVAL 1 DAY ELSE ts END"
    return f"""SELECT event_id AS id, node,
       CASE WHEN event_type = 'error' THEN 'WARNING' WHEN pos IN (2, 6) THEN 'DEBUG' ELSE 'INFO' END AS level,
       tid, {time} AS puttime,
       CASE WHEN pos IN (0, 7) THEN 'rder/Processing.cpp' WHEN pos IN (4, 5) THEN 'tils/Totals.h'
            ELSE 'atch/Commit.cpp' END || ':' || CAST(100 + pos AS VARCHAR) AS fileline,
       CASE {lost}WHEN pos IN (0, 6, 7) THEN 'ProcessOrderBatchFro' WHEN pos IN (1, 2, 3) THEN 'CommitBatch'
            ELSE 'ComputeTotals' END AS function,
       CASE WHEN pos IN (0, 1, 4) THEN 'BEG' WHEN pos IN (3, 5, 7) THEN 'END'
            ELSE concat(event_type, ' user ', user_id, ' props ', props) END AS message
FROM p"""


def with_logs(body: str, mismatched: bool = False, hard: bool = False) -> str:
    """``WITH e, p, logs AS (...)`` followed by ``body``; body may add CTEs
    by starting with ``, name AS (...)``."""
    return f"WITH {_E_P},\nlogs AS ({_logs_body(mismatched, hard)})\n{body}"


SYMBOLS_SQL = """symbols AS (SELECT * FROM (VALUES
  ('CommitBatch', 'app/src/batch/Commit.cpp', 101, 1),
  ('CommitBatch', 'app/test/CommitTest.cpp', 102, 2),
  ('CommitBatchCore', 'app/src/batch/Commit.cpp', 105, 3),
  ('ComputeTotals', 'app/src/other/Totals.cpp', 7, 4),
  ('ProcessOrderBatchFromDisk', 'app/src/order/Processing.cpp', 300, 5),
  ('ProcessOrderBatchFromQueue', 'app/src/order/Processing.cpp', 98, 6)
) AS t(name, path, line, seq))"""

DEPTH_CTE = """, d AS (SELECT *, CAST(sum(CASE message WHEN 'BEG' THEN 1 ELSE -1 END) OVER (PARTITION BY node, tid
             ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS depth
           FROM logs WHERE message IN ('BEG', 'END')),
l AS (SELECT *, CASE message WHEN 'BEG' THEN depth ELSE depth + 1 END AS lvl FROM d)"""

ORACLE: dict[str, str] = {}


def sql(key: str, text: str) -> None:
    ORACLE[key] = text


SPAN_SQL = """,
w AS (SELECT *, lead(puttime) OVER q AS end_time, lead(function) OVER q AS end_function,
             lead({name}) OVER q AS end_name, lead({path}) OVER q AS end_path FROM l
      WINDOW q AS (PARTITION BY node, tid, lvl ORDER BY id))
SELECT node, tid, function, lvl, id, puttime, end_time, end_function,
       (epoch_us(end_time) - epoch_us(puttime)) / 1e6 AS duration,
       CASE WHEN end_time IS NOT NULL THEN {name} = end_name AND {path} = end_path END AS matched
FROM w WHERE message = 'BEG'"""
LOGGED_PATH = "split_part(fileline, ':', 1)"

sql("call_spans", with_logs(DEPTH_CTE + SPAN_SQL.format(name="function", path=LOGGED_PATH)))

sql("call_depth", with_logs("""
SELECT node, tid, id, message,
       CAST(sum(CASE message WHEN 'BEG' THEN 1 WHEN 'END' THEN -1 ELSE 0 END) OVER (PARTITION BY node, tid
            ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS depth
FROM logs"""))

MISMATCH_SQL = """,
w AS (SELECT *, lag(message) OVER q AS beg_message, lag(id) OVER q AS beg_id, lag(puttime) OVER q AS beg_time,
             lag(function) OVER q AS beg_function, lag(fileline) OVER q AS beg_fileline,
             lag({name}) OVER q AS beg_name, lag({path}) OVER q AS beg_path FROM l
      WINDOW q AS (PARTITION BY node, tid, lvl ORDER BY id))
SELECT node, tid, id, puttime, function, fileline, lvl, beg_id, beg_function, beg_fileline,
       (epoch_us(puttime) - epoch_us(beg_time)) / 1e6 AS duration
FROM w WHERE message = 'END' AND beg_message = 'BEG' AND ({name} <> beg_name OR {path} <> beg_path)"""

sql("call_mismatches", with_logs(DEPTH_CTE + MISMATCH_SQL.format(name="function", path=LOGGED_PATH), mismatched=True))

sql("function_time", with_logs(DEPTH_CTE + """,
w AS (SELECT *, lead(puttime) OVER q AS end_time FROM l
      WINDOW q AS (PARTITION BY node, tid, lvl ORDER BY id))
SELECT node, function, count(*) AS calls,
       round(sum((epoch_us(end_time) - epoch_us(puttime)) / 1e6), 6) AS total_s,
       round(max((epoch_us(end_time) - epoch_us(puttime)) / 1e6), 6) AS max_s
FROM w WHERE message = 'BEG' AND end_time IS NOT NULL GROUP BY node, function"""))


# ------------------------------------------------------------------- ingest

TEXT_LOGS = """, tl AS (SELECT id, node, level, tid, puttime, fileline, function,
       CASE WHEN function = 'CommitBatch' AND message NOT IN ('BEG', 'END')
            THEN message || chr(10) || '    at ' || fileline || chr(10) || '    tid ' || CAST(tid AS VARCHAR)
            ELSE message END AS message,
       strftime(puttime, '%y-%m-%dT%H:%M:%S.%f') AS t
FROM logs)"""

BAD_TEXT = """CASE tid % 3
  WHEN 0 THEN 'bad line ' || function
  WHEN 1 THEN level || '][' || printf('%5d', tid) || '][' || t || '][' || fileline || '][' || function || ' header cut short'
  ELSE level || '][t' || CAST(tid AS VARCHAR) || '][' || t || '][' || fileline || '][' || function || '] tid is not a number'
END || chr(10) || '  orphan line after a bad record'"""

ORPHAN = "'INFO][    1][24-01-01T00:00:00.000000][a.cpp:1][Lost                ] tail of a record of '"

BAD_REASON = "CASE tid % 3 WHEN 0 THEN 'too_few_fields' WHEN 1 THEN 'five_fields' ELSE 'bad_tid' END"

sql("scan_records", with_logs(TEXT_LOGS + f"""
SELECT node, level || '][' || printf('%5d', tid) || '][' || t || '][' || fileline || '][' || printf('%-20s', function)
             || '] ' || message AS text FROM tl
UNION ALL
SELECT node, {BAD_TEXT} AS text FROM tl WHERE level = 'WARNING' AND message = 'END'
UNION ALL
SELECT DISTINCT node, {ORPHAN} || node AS text FROM logs"""))

sql("parse_header", with_logs(TEXT_LOGS + """
SELECT node, level, tid, puttime, fileline, function, message FROM tl"""))

sql("quarantine", with_logs(TEXT_LOGS + f"""
SELECT node, {BAD_REASON} AS reason, {BAD_TEXT} AS text FROM tl WHERE level = 'WARNING' AND message = 'END'
UNION ALL
SELECT DISTINCT node, 'orphan' AS reason, {ORPHAN} || node AS text FROM logs"""))

sql("arrival_order", with_logs("""
SELECT node, row_number() OVER (PARTITION BY node ORDER BY puttime, id) AS seq, level, tid, puttime FROM logs"""))

sql("scan_nodes", with_logs("SELECT node, count(*) AS rows FROM logs GROUP BY node"))

sql("max_message", with_logs(TEXT_LOGS + """
SELECT node, CAST(max(length(message)) AS BIGINT) AS max_msg FROM tl GROUP BY node"""))

sql("write_read_back", with_logs("SELECT * FROM logs"))

sql("layout_roundtrip", with_logs("""
SELECT * FROM logs WHERE tid = 3
  AND puttime >= TIMESTAMP '2024-01-08 00:00:00' AND puttime < TIMESTAMP '2024-01-22 12:00:00'"""))

sql("items_catalog", with_logs("""
SELECT DISTINCT node, 'level' AS field, level AS value FROM logs
UNION
SELECT DISTINCT node, 'tid' AS field, CAST(tid AS VARCHAR) AS value FROM logs"""))

sql("list_items", with_logs("SELECT DISTINCT CAST(tid AS VARCHAR) AS value FROM logs WHERE node = 'node-1'"))

sql("list_nodes", with_logs("SELECT DISTINCT node FROM logs"))

sql("node_select", with_logs("SELECT * FROM logs WHERE node = 'node-2'"))

# Kept ctags lines follow from the rule that rendered them from `part`.
sql("load_symbols", """
SELECT CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 1) ELSE p_name END AS name,
       'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.cpp' AS path,
       CAST(p_size AS BIGINT) + CASE WHEN p_size % 10 = 7 THEN 10000000000 ELSE 0 END AS line
FROM part WHERE p_type NOT IN ('SMALL', 'LARGE')""")

# ------------------------------------------------------------------ select

sql("time_range", with_logs("""
SELECT * FROM logs WHERE node = 'node-1'
  AND puttime >= TIMESTAMP '2024-01-10 06:30:00' AND puttime < TIMESTAMP '2024-01-20 18:45:10'"""))

sql("time_range_default", with_logs("""
SELECT * FROM logs WHERE node = 'node-3'
  AND puttime >= TIMESTAMP '1970-01-01 00:00:00' AND puttime < CAST(date_trunc('second', now()) AS TIMESTAMP)"""))

sql("where_expr", with_logs("""
SELECT * FROM logs WHERE level <> 'INFO' AND (tid IN (1, 5, 9) OR function LIKE 'Commit%')"""))

sql("where_order_limit", with_logs("""
SELECT * FROM logs WHERE level = 'WARNING' ORDER BY puttime DESC, id LIMIT 100"""))

sql("task_entries", with_logs("""
SELECT * FROM logs WHERE tid = 3 AND function = 'ProcessOrderBatchFro' AND message = 'BEG'"""))

ANCHOR_SQL = """SELECT * FROM logs WHERE node = 'node-2' AND tid = 7 AND function = 'ProcessOrderBatchFro'
  AND message = 'BEG'
ORDER BY abs(epoch_us(puttime) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), id LIMIT 1"""

sql("nearest_entry", with_logs(ANCHOR_SQL))

sql("nearest_entry_many", with_logs("""
, pr AS (SELECT event_id AS probe_id, concat('node-', user_id % 5) AS node, user_id % 12 AS tid,
                substr(CASE WHEN user_id % 2 = 0 THEN 'CommitBatch' ELSE 'ProcessOrderBatchFromQueue' END, 1, 20) AS task,
                ts + INTERVAL 90 MINUTE AS at
         FROM events WHERE event_type = 'error'),
c AS (SELECT pr.probe_id, pr.node, pr.tid, pr.task, l.id, l.puttime,
             row_number() OVER (PARTITION BY pr.probe_id
                                ORDER BY abs(epoch_us(l.puttime) - epoch_us(pr.at)), l.id) AS rk
      FROM pr LEFT JOIN logs l ON l.node = pr.node AND l.tid = pr.tid AND l.function = pr.task AND l.message = 'BEG')
SELECT probe_id, node, tid, task, id, puttime FROM c WHERE rk = 1"""))

sql("rows_from", with_logs(f"""
, a AS ({ANCHOR_SQL})
SELECT l.* FROM logs l, a WHERE l.node = 'node-2' AND l.tid = 7
  AND l.id >= a.id"""))

sql("fleet_range", with_logs("""
SELECT * FROM logs WHERE puttime >= TIMESTAMP '2024-01-05 00:00:00' AND puttime < TIMESTAMP '2024-01-05 06:00:00'"""))

# ---------------------------------------------------------------- recovery


def resolve_sql(keys_cte: str, symbols: str = SYMBOLS_SQL) -> str:
    """CTEs ending in ``res(function, fileline, name, path, line)`` for the
    keys of ``keys_cte`` (a CTE named ``keys``)."""
    return f""", {symbols},
keys AS ({keys_cte}),
k AS (SELECT function, fileline, rtrim(function, '()') AS f,
             CASE WHEN len(string_split(fileline, ':')) = 2 THEN split_part(fileline, ':', 1) ELSE fileline END AS lpath,
             CASE WHEN len(string_split(fileline, ':')) = 2 THEN TRY_CAST(split_part(fileline, ':', 2) AS BIGINT) END AS lline
      FROM keys),
m AS (SELECT k.*, s.name, s.path, s.line AS sline, s.seq FROM k LEFT JOIN symbols s ON starts_with(s.name, k.f)),
n AS (SELECT function, fileline, count(name) AS n FROM m GROUP BY function, fileline),
o AS (SELECT function, fileline, name, path,
             row_number() OVER (PARTITION BY function, fileline ORDER BY seq) AS rk
      FROM m WHERE name IS NOT NULL),
b AS (SELECT function, fileline, name, path,
             row_number() OVER (PARTITION BY function, fileline ORDER BY abs(lline - sline), seq) AS rk
      FROM m WHERE name IS NOT NULL AND ends_with(path, lpath)),
res AS (SELECT k.function, k.fileline,
          CASE WHEN k.lline IS NOT NULL AND n.n = 1 THEN o.name
               WHEN k.lline IS NOT NULL AND n.n > 1 AND b.name IS NOT NULL THEN b.name ELSE k.function END AS name,
          CASE WHEN k.lline IS NOT NULL AND n.n = 1 THEN o.path
               WHEN k.lline IS NOT NULL AND n.n > 1 AND b.name IS NOT NULL THEN b.path ELSE k.lpath END AS path,
          k.lline AS line
        FROM k JOIN n ON n.function = k.function AND n.fileline = k.fileline
        LEFT JOIN o ON o.function = k.function AND o.fileline = k.fileline AND o.rk = 1
        LEFT JOIN b ON b.function = k.function AND b.fileline = k.fileline AND b.rk = 1)"""


LOG_KEYS = "SELECT DISTINCT function, fileline FROM logs"
CUT_KEYS = """SELECT function, fileline FROM logs
  UNION SELECT substr(function, 1, 1), fileline FROM logs
  UNION SELECT substr(function, 1, 6), fileline FROM logs
  UNION SELECT substr(function, 1, 11), fileline FROM logs"""

sql("recover_symbols", with_logs(resolve_sql(LOG_KEYS) + "\nSELECT * FROM res"))

sql("recover_ties", with_logs(resolve_sql(CUT_KEYS) + "\nSELECT * FROM res"))

RECOVERED = """, rl AS (SELECT l.*, r.name AS rec_function, r.path AS rec_path, r.line AS rec_line
             FROM logs l LEFT JOIN res r ON l.function = r.function AND l.fileline = r.fileline)"""
HARD_DEPTH = resolve_sql(LOG_KEYS) + RECOVERED + DEPTH_CTE.replace("FROM logs WHERE", "FROM rl WHERE")

sql("call_spans_hard", with_logs(HARD_DEPTH + SPAN_SQL.format(name="rec_function", path="rec_path"), hard=True))

sql("call_mismatches_hard", with_logs(HARD_DEPTH + MISMATCH_SQL.format(name="rec_function", path="rec_path"), hard=True))

PART_SYMBOLS = """symbols AS (
  SELECT CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 1) ELSE p_name END AS name,
         'src/' || lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '.cpp' AS path,
         CAST(p_size AS BIGINT) + CASE WHEN p_size % 10 = 7 THEN 10000000000 ELSE 0 END AS line, p_partkey AS seq
  FROM part WHERE p_type NOT IN ('SMALL', 'LARGE'))"""

sql("recover_parts", "WITH one AS (SELECT 1)" + resolve_sql("""SELECT DISTINCT left(name, 7) AS function,
       right(path, 14) || ':' || CAST(line + 3 AS VARCHAR) AS fileline FROM symbols""", PART_SYMBOLS) + """
SELECT * FROM res""")

sql("recover_logs", with_logs(resolve_sql(LOG_KEYS) + """
SELECT l.node, l.id, r.name AS rec_function, r.path AS rec_path, r.line AS rec_line
FROM logs l LEFT JOIN res r ON l.function = r.function AND l.fileline = r.fileline"""))

sql("render_rows", with_logs(resolve_sql(LOG_KEYS) + """
SELECT l.node, l.id,
       concat_ws('  ', l.level, printf('%5d', l.tid), strftime(l.puttime, '%Y-%m-%d %H:%M:%S.%f'),
                 printf('%-50s:%-4s', r.path, CAST(r.line AS VARCHAR)), printf('%-40s', r.name), l.message) AS line
FROM logs l LEFT JOIN res r ON l.function = r.function AND l.fileline = r.fileline"""))

sql("list_functions", with_logs(resolve_sql("SELECT DISTINCT function, fileline FROM logs WHERE message = 'BEG'") + """,
f AS (SELECT DISTINCT node, function, fileline FROM logs WHERE message = 'BEG')
SELECT f.node,
       printf('%-55s  %s', CASE WHEN length(r.name) > 20 THEN substr(r.name, 1, 20) || '[' || substr(r.name, 21) || ']'
                                ELSE r.name END,
              r.path || ':' || CAST(r.line AS VARCHAR)) AS line
FROM f JOIN res r ON f.function = r.function AND f.fileline = r.fileline"""))


# -------------------------------------------------------------------- text

PORTER_RE = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+"
PORTER_TOKS = (r"list_transform(regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
               r"'abcdefghijklmnopqrstuvwxyz'), '" + PORTER_RE + r"'), lambda x: CASE "
               r"WHEN regexp_full_match(x, '[a-z]{{3,20}}') THEN x "
               r"WHEN regexp_matches(x, '[0-9]') AND length(x) > 6 THEN left(x, 3) || right(x, 3) "
               r"WHEN NOT regexp_matches(x, '[0-9]') AND length(x) > 20 THEN left(x, 10) || right(x, 10) "
               r"ELSE x END)")
WS_RE = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
PUNCT = r"[!-/:-@\[-`{-~]"
ALNUM = r"[\p{L}\p{N}]+"


def words_sql(src: str, ids: str, text: str) -> str:
    """CTEs ``wm`` (main tokens) and ``wset`` (expanded set) of a words
    analysis of ``src``."""
    return f""", wa AS (SELECT {ids}, unnest(regexp_split_to_array(lower({text}), '{WS_RE}')) AS p FROM {src}),
wb AS (SELECT {ids}, unnest(regexp_split_to_array(p, '[=,]+')) AS q FROM wa),
wc AS (SELECT {ids}, regexp_replace(q, '^{PUNCT}+|{PUNCT}+$', '', 'g') AS t FROM wb),
wm AS (SELECT DISTINCT {ids}, t FROM wc WHERE length(t) >= 3 AND t NOT IN ({STOPS})),
ws AS (SELECT {ids}, unnest(regexp_extract_all(t, '(?s)(.[^[:punct:]]*)[[:punct:]]?', 1)) AS s
       FROM wm WHERE NOT regexp_full_match(t, '{ALNUM}')),
wset AS (SELECT {ids}, t AS term FROM wm
         UNION SELECT {ids}, s AS term FROM ws WHERE length(s) >= 3 AND s NOT IN ({STOPS})
         UNION SELECT {ids}, substr(t, 3) AS term FROM wm WHERE regexp_full_match(t, '{ALNUM}') AND starts_with(t, '0x'))"""


DOC_TOKS = "WITH d AS MATERIALIZED (SELECT doc_id, source, " + PORTER_TOKS.format(t="text") + " AS toks FROM documents)"

sql("tokens_porter", DOC_TOKS + """
SELECT doc_id, generate_subscripts(toks, 1) - 1 AS pos, unnest(toks) AS token FROM d""")

sql("tokens_words", "WITH x AS (SELECT 1)" + words_sql("documents", "doc_id", "text") + """
SELECT doc_id, t AS token FROM wm""")

sql("tokens_sub", "WITH x AS (SELECT 1)" + words_sql("documents", "doc_id", "text") + """
SELECT doc_id, term AS token FROM wset""")

sql("path_tokens", r"""
SELECT DISTINCT page_id, token FROM (
  SELECT page_id, unnest(string_split(replace(lower(url), '\', '/'), '/')) AS token FROM pages) WHERE token <> ''""")

sql("postings", with_logs(", msgs AS (SELECT * FROM logs WHERE message NOT IN ('BEG', 'END'))"
                          + words_sql("msgs", "node, id", "message") + """
SELECT node, id, term AS word, 0 AS type FROM wset"""))

sql("posting_lookup", DOC_TOKS + """,
p AS (SELECT doc_id, unnest(toks) AS term FROM d),
w AS (SELECT DISTINCT unnest(""" + PORTER_TOKS.format(t="text") + """) AS term FROM benchmark)
SELECT p.term, count(DISTINCT p.doc_id) AS docs, count(*) AS occurrences FROM p JOIN w ON p.term = w.term GROUP BY p.term""")

sql("search_term", DOC_TOKS + "\nSELECT doc_id, source FROM d WHERE list_contains(toks, 'license')")
sql("search_prefix", DOC_TOKS + """
SELECT doc_id, source FROM d WHERE len(list_filter(toks, lambda x: starts_with(x, 'licen'))) > 0""")
sql("search_and", DOC_TOKS + """
SELECT doc_id, source FROM d WHERE list_contains(toks, 'mit') AND list_contains(toks, 'license')""")
sql("search_or", DOC_TOKS + """
SELECT doc_id, source FROM d WHERE list_contains(toks, 'stupid') OR list_contains(toks, 'worthless')""")
sql("search_not", DOC_TOKS + """
SELECT doc_id, source FROM d WHERE list_contains(toks, 'license') AND NOT list_contains(toks, 'mit')""")
sql("search_phrase", DOC_TOKS + """,
p AS MATERIALIZED (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM d),
pa AS MATERIALIZED (SELECT doc_id, pos FROM p WHERE tok = 'thtionea'),
pb AS MATERIALIZED (SELECT doc_id, pos FROM p WHERE tok = 'from'),
pc AS MATERIALIZED (SELECT doc_id, pos FROM p WHERE tok = 'eainan'),
h AS (SELECT DISTINCT pa.doc_id FROM pa JOIN pb ON pa.doc_id = pb.doc_id AND pb.pos = pa.pos + 1
      JOIN pc ON pc.doc_id = pa.doc_id AND pc.pos = pa.pos + 2)
SELECT d.doc_id, d.source FROM d JOIN h ON d.doc_id = h.doc_id""")
sql("search_near", DOC_TOKS + """,
p AS MATERIALIZED (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM d),
pa AS MATERIALIZED (SELECT doc_id, pos FROM p WHERE tok = 'thtionea'),
pb AS MATERIALIZED (SELECT doc_id, pos FROM p WHERE tok = 'ertionnd'),
h AS (SELECT DISTINCT pa.doc_id FROM pa JOIN pb ON pa.doc_id = pb.doc_id AND abs(pa.pos - pb.pos) <= 4 AND pa.pos <> pb.pos)
SELECT d.doc_id, d.source FROM d JOIN h ON d.doc_id = h.doc_id""")
sql("search_semi", DOC_TOKS + """
SELECT * FROM labels WHERE doc_id IN (SELECT doc_id FROM d WHERE list_contains(toks, 'stupid'))""")

# levenshtein counts bytes here: every character outside ASCII is written as
# one of the ASCII ones that no token holds.
sql("fuzzy_functions", DOC_TOKS + """,
a AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part),
b AS MATERIALIZED (SELECT DISTINCT unnest(toks) AS target FROM d),
c AS (SELECT coalesce(string_agg(ch, '' ORDER BY ch), '') AS chars, count(ch) AS n FROM (
        SELECT DISTINCT unnest(regexp_extract_all(target, '[^\\x00-\\x7F]')) AS ch FROM b)),
t AS (SELECT chars, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^`{|}~', CAST(n AS INT)) AS ascii FROM c),
bb AS (SELECT target, translate(target, chars, ascii) AS one FROM b, t),
aa AS (SELECT word, translate(word, chars, ascii) AS one FROM a, t)
SELECT word, target, CAST(levenshtein(aa.one, bb.one) AS BIGINT) AS distance FROM aa, bb
WHERE abs(length(aa.one) - length(bb.one)) <= 2 AND levenshtein(aa.one, bb.one) <= 2""")


def _stem_sql(src: str) -> str:
    """CTE ``st(word, stem)`` of the distinct stemmable words of ``src(word)``:
    the steps of :mod:`fleetlog.functions.porter`."""
    steps: list[str] = []

    def step(expr: str, extra: str = "") -> None:
        k = len(steps)
        steps.append(f"p{k} AS (SELECT word, {expr} AS w{extra} FROM p{k - 1})")

    def test(text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def cut(n: int, text: str = "w") -> str:
        return f"left({text}, length({text}) - {n})"

    def replaced(table: dict[str, str]) -> None:
        pat = porter.ending(table)
        step("w", f", regexp_extract(w, '{pat}', 1) AS s, regexp_extract(w, '{pat}', 2) AS x")
        new = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
        step(f"CASE WHEN x <> '' AND {test('s', porter.MEASURE_OVER_0)} THEN s || {new} ELSE w END")

    steps.append(f"p0 AS (SELECT DISTINCT word, regexp_replace(word, '^y', 'Y') AS w FROM {src} "
                 "WHERE regexp_full_match(word, '[a-z]{3,20}'))")
    step(f"CASE WHEN {test('w', '^.*(ss|i)es$')} THEN {cut(2)} WHEN {test('w', '^.+[^s]s$')} THEN {cut(1)} ELSE w END")
    step("w", f", CASE WHEN {test('w', '^.*eed$')} THEN '' ELSE regexp_extract(w, '{porter.ending(['ed', 'ing'])}', 1) END AS s")
    step(f"""CASE WHEN {test('w', '^.*eed$')} THEN CASE WHEN {test(cut(3), porter.MEASURE_OVER_0)} THEN {cut(1)} ELSE w END
      WHEN s <> '' AND {test('s', porter.HAS_VOWEL)} THEN
        CASE WHEN {test('s', '(at|bl|iz)$')} THEN s || 'e'
             WHEN right(s, 1) = left(right(s, 2), 1) AND {test('s', '[^aeiouylsz]$')} THEN {cut(1, 's')}
             WHEN {test('s', porter.SHORT_END)} THEN s || 'e' ELSE s END
      ELSE w END""")
    step(f"CASE WHEN {test('w', '^.+y$')} AND {test(cut(1), porter.HAS_VOWEL)} THEN {cut(1)} || 'i' ELSE w END")
    replaced(porter.STEP_2)
    replaced(porter.STEP_3)
    step("w", f", regexp_extract(w, '{porter.ending(porter.STEP_4)}', 1) AS s, regexp_extract(w, '^(.+?[st])ion$', 1) AS i")
    step(f"""CASE WHEN s <> '' THEN CASE WHEN {test('s', porter.MEASURE_OVER_1)} THEN s ELSE w END
      WHEN i <> '' AND {test('i', porter.MEASURE_OVER_1)} THEN i ELSE w END""")
    step(f"""CASE WHEN {test('w', '^.+e$')} AND ({test(cut(1), porter.MEASURE_OVER_1)} OR (
      {test(cut(1), porter.MEASURE_IS_1)} AND NOT {test(cut(1), porter.SHORT_END)})) THEN {cut(1)} ELSE w END""")
    step(f"CASE WHEN {test('w', 'll$')} AND {test('w', porter.MEASURE_OVER_1)} THEN {cut(1)} ELSE w END")
    return ",\n".join(steps) + f",\nst AS (SELECT word, regexp_replace(w, '^Y', 'y') AS stem FROM p{len(steps) - 1})"


DOC_WORDS = DOC_TOKS + ",\ndw AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(toks) AS word FROM d),\n" + _stem_sql("dw")

sql("search_porter", DOC_WORDS + """
SELECT DISTINCT dw.doc_id FROM dw JOIN st ON dw.word = st.word WHERE st.stem = 'licens'""")

sql("stem_vocabulary_porter", DOC_WORDS + "\nSELECT word, stem FROM st")

LOG_WORDS = with_logs(", lt AS (SELECT *, " + PORTER_TOKS.format(t="message") + """ AS toks FROM logs
  WHERE node = 'node-1'),
lw AS (SELECT id, unnest(toks) AS word, generate_subscripts(toks, 1) AS pos FROM lt),
""" + _stem_sql("lw") + """,
li AS MATERIALIZED (SELECT id, pos, coalesce(stem, lw.word) AS word FROM lw LEFT JOIN st ON lw.word = st.word)
SELECT id, node, level, tid, puttime, fileline, function, message FROM lt WHERE """)


def _has(word: str) -> str:
    return f"id IN (SELECT id FROM li WHERE word = '{word}')"


sql("search_logs_term", LOG_WORDS + _has("purchas"))
sql("search_logs_prefix", LOG_WORDS + "id IN (SELECT id FROM li WHERE starts_with(word, 'sign'))")
sql("search_logs_and", LOG_WORDS + _has("error") + " AND " + _has("user"))
sql("search_logs_or", LOG_WORDS + "(" + _has("signup") + " OR " + _has("purchas") + ")")
sql("search_logs_not", LOG_WORDS + _has("user") + " AND NOT " + _has("error"))
sql("search_logs_phrase", LOG_WORDS + """id IN (
  SELECT a.id FROM li a JOIN li b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.word = 'error' AND b.word = 'user')""")

# words of one message side by side: of every occurrence, what stands at pos + n
ALL_WORDS = LOG_WORDS.replace("\n  WHERE node = 'node-1'", "").rsplit("\nSELECT", 1)[0]


def _side(*words: str, gap: str = "b{i}.pos = b{j}.pos + 1") -> str:
    frm = "li b0" + "".join(f" JOIN li b{i} ON b{i}.id = b0.id AND " + gap.format(i=i, j=i - 1)
                            for i in range(1, len(words)))
    where = " AND ".join(f"b{i}.word = '{w}'" if w[-1] != "*" else f"starts_with(b{i}.word, '{w[:-1]}')"
                         for i, w in enumerate(words))
    return f"id IN (SELECT b0.id FROM {frm} WHERE {where})"


def _near(a: str, b: str, k: int) -> str:
    return _side(a, b, gap=f"b{{i}}.pos <> b{{j}}.pos AND abs(b{{i}}.pos - b{{j}}.pos) <= {k + 1}")


MATCHES = {
    "term": _side("purchas"),
    "prefix": _side("sign*"),
    "phrase": _side("error", "user"),
    "prefix phrase": _side("user", "1*", "prop"),
    "near": _near("click", "prop", 1),
    "near chain": """id IN (SELECT a.id FROM li a JOIN li u ON u.id = a.id AND u.pos = a.pos + 1
      JOIN li p ON p.id = a.id AND (p.pos - u.pos BETWEEN 1 AND 2 OR u.pos - p.pos BETWEEN 1 AND 3)
      JOIN li k ON k.id = a.id AND abs(k.pos - p.pos) BETWEEN 1 AND 2
      WHERE a.word = 'view' AND u.word = 'user' AND p.word = 'prop' AND k.word = 'k')""",
    "brackets": f"({_side('error')} OR {_side('view')}) AND {_side('user')} AND NOT {_side('1*')}",
    "not": f"{_side('user')} AND NOT ({_near('user', 'k', 2)} OR {_side('error')} OR {_side('sign*')})",
}

sql("search_logs_match", ALL_WORDS + "\n" + " UNION ALL ".join(
    f"SELECT '{name}' AS query, node, id FROM lt WHERE {test}" for name, test in MATCHES.items()))


# ------------------------------------------------------- more call stacks

LP = """, lp AS (SELECT l.*, p.pos, p.cyc FROM logs l JOIN p ON l.id = p.event_id)"""

sql("call_spans_lenient", with_logs(LP + """,
b AS (SELECT * FROM lp WHERE message = 'BEG'),
en AS (SELECT * FROM lp WHERE message = 'END')
SELECT b.node, b.tid, b.id, b.function,
       CAST(2 * floor((b.cyc + 5) / 11) + CASE b.pos WHEN 0 THEN 1 WHEN 1 THEN 2
            ELSE CASE WHEN b.cyc % 11 = 5 THEN 3 ELSE 2 END END AS INTEGER) AS depth,
       en.id AS end_id, en.puttime AS end_time
FROM b LEFT JOIN en ON en.node = b.node AND en.tid = b.tid AND en.cyc = b.cyc
  AND en.pos = CASE b.pos WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 5 END
  AND NOT (b.pos IN (0, 1) AND b.cyc % 11 = 5)""", mismatched=True))

sql("call_mismatches_lenient", with_logs(LP + """
SELECT node, tid, id, puttime, function FROM lp WHERE message = 'END' AND cyc % 11 = 5 AND pos IN (3, 7)""",
                                        mismatched=True))

sql("callstack_one", with_logs(f"""
, a AS ({ANCHOR_SQL}),
t AS (SELECT l.*, CAST(sum(CASE l.message WHEN 'BEG' THEN 1 WHEN 'END' THEN -1 ELSE 0 END)
               OVER (ORDER BY l.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS depth
      FROM logs l, a WHERE l.node = 'node-2' AND l.tid = 7
        AND l.id >= a.id)
SELECT node, tid, id, message, depth FROM t
WHERE NOT EXISTS (SELECT 1 FROM t z WHERE z.depth = 0
                  AND z.id < t.id)"""))

sql("call_messages", with_logs("""
, d AS (SELECT *, CAST(sum(CASE message WHEN 'BEG' THEN 1 WHEN 'END' THEN -1 ELSE 0 END) OVER (PARTITION BY node, tid
             ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS depth FROM logs),
m AS (SELECT *,
        last_value(CASE WHEN message = 'BEG' THEN function END IGNORE NULLS) OVER q AS frame_function,
        last_value(CASE WHEN message = 'BEG' THEN id END IGNORE NULLS) OVER q AS frame_id
      FROM d WHERE message <> 'END'
      WINDOW q AS (PARTITION BY node, tid, depth ORDER BY id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT node, tid, id, depth, frame_function, frame_id FROM m WHERE message <> 'BEG'"""))

sql("render_callstack", with_logs(resolve_sql(LOG_KEYS) + DEPTH_CTE.replace("FROM logs WHERE", "FROM rl WHERE").replace(
    ", d AS (", """, rl AS (SELECT l.*, r.name AS rec_function, r.path AS rec_path, r.line AS rec_line
             FROM logs l LEFT JOIN res r ON l.function = r.function AND l.fileline = r.fileline),
d AS (""") + """,
w AS (SELECT *, lag(message) OVER q AS beg_message, lag(puttime) OVER q AS beg_time FROM l
      WINDOW q AS (PARTITION BY node, tid, lvl ORDER BY id)),
x AS (SELECT *, (epoch_us(puttime) - epoch_us(beg_time) + 5000) // 10000 AS c,
             repeat('    ', lvl - 1) || CASE WHEN lvl - 1 > 0 THEN '| ' ELSE '' END AS pad,
             '[' || rec_path || ':' || CAST(rec_line AS VARCHAR) || ']' AS loc,
             rtrim(strftime(puttime, '%H:%M:%S.%f'), '0') AS st
      FROM w WHERE message = 'BEG' OR beg_message = 'BEG')
SELECT node, tid, id,
       pad || CASE WHEN message = 'BEG'
                   THEN 'BEGIN  ' || rec_function || '()        [' || st || ']  ' || loc
                   ELSE 'END  ' || rec_function || '()        [duration:' || CAST(c // 100 AS VARCHAR) || '.'
                        || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || 's  ' || st || ']  ' || loc END AS text
FROM x"""))


sql("list_functions_raw", with_logs("""
SELECT DISTINCT node, printf('%-55s  %s', function, fileline) AS line FROM logs WHERE message = 'BEG'"""))


def _indent_sql(text: str, n: str) -> str:
    pad = f"(repeat('    ', {n}) || CASE WHEN {n} > 0 THEN '| ' ELSE '' END)"
    return f"regexp_replace({text}, '(^|\\n)', '\\1' || {pad}, 'g')"


sql("render_callstack_one", with_logs(resolve_sql(LOG_KEYS) + f"""
, a AS ({ANCHOR_SQL}),
rl AS (SELECT l.*, r.name AS rec_function, r.path AS rec_path, r.line AS rec_line
       FROM logs l LEFT JOIN res r ON l.function = r.function AND l.fileline = r.fileline),
t AS (SELECT rl.*, CAST(sum(CASE rl.message WHEN 'BEG' THEN 1 WHEN 'END' THEN -1 ELSE 0 END)
               OVER (ORDER BY rl.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INT) AS depth
      FROM rl, a WHERE rl.node = 'node-2' AND rl.tid = 7
        AND rl.id >= a.id),
c AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t z WHERE z.depth = 0
                  AND z.id < t.id)),
cm AS (SELECT *, CASE message WHEN 'BEG' THEN depth WHEN 'END' THEN depth + 1 END AS lvl FROM c),
cp AS (SELECT *, lag(message) OVER q AS beg_message, lag(puttime) OVER q AS beg_time FROM cm
      WHERE message IN ('BEG', 'END') WINDOW q AS (PARTITION BY lvl ORDER BY id)),
x AS (SELECT cm.*, cp.beg_time,
             '[' || cm.rec_path || ':' || CAST(cm.rec_line AS VARCHAR) || ']' AS loc,
             cm.rec_function || '()' AS fn,
             rtrim(strftime(cm.puttime, '%H:%M:%S.%f'), '0') AS st,
             (epoch_us(cm.puttime) - epoch_us(cp.beg_time) + 5000) // 10000 AS cc
      FROM cm LEFT JOIN cp ON cm.id = cp.id)
SELECT node, tid, id,
  CASE WHEN message = 'BEG' AND depth = 1
       THEN 'Start at ' || strftime(puttime, '%Y-%m-%d %H:%M:%S.%f') || chr(10) ELSE '' END ||
  CASE WHEN message = 'BEG' THEN {_indent_sql("'BEGIN  ' || fn || '        [' || st || ']  ' || loc", "depth - 1")}
       WHEN message = 'END' THEN {_indent_sql("'END  ' || fn || '        [duration:' || CAST(cc // 100 AS VARCHAR) || '.' || lpad(CAST(cc % 100 AS VARCHAR), 2, '0') || 's  ' || st || ']  ' || loc", "depth")}
       ELSE {_indent_sql("'[' || level || ']  ' || fn || '        [' || st || ']  ' || loc || chr(10) || " + _indent_sql("message", "depth"), "depth")}
  END AS text
FROM x"""))


BAD_ANCHOR_SQL = """SELECT * FROM logs WHERE node = 'node-2' AND tid = 7 AND function = 'CommitBatch'
  AND message = 'BEG'
ORDER BY abs(epoch_us(puttime) - epoch_us(TIMESTAMP '2024-01-17 16:22:00')), id LIMIT 1"""

# From any CommitBatch entry, the unlike ENDs are those of FIXTURES §3:
# positions 3 and 7 of the cycles with cyc % 11 = 5.
LENIENT_SEG = f""", lp AS (SELECT l.*, p.pos, p.cyc FROM logs l JOIN p ON l.id = p.event_id),
a AS ({BAD_ANCHOR_SQL}),
s AS (SELECT lp.*, (lp.message = 'END' AND lp.cyc % 11 = 5 AND lp.pos IN (3, 7)) AS unmatched,
             CASE WHEN lp.message = 'BEG' THEN 1
                  WHEN lp.message = 'END' AND NOT (lp.cyc % 11 = 5 AND lp.pos IN (3, 7)) THEN -1 ELSE 0 END AS delta
      FROM lp, a WHERE lp.node = 'node-2' AND lp.tid = 7
        AND lp.id >= a.id),
t AS (SELECT *, CAST(sum(delta) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                     AS INT) AS depth FROM s),
c AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t z WHERE z.depth = 0
                  AND z.id < t.id))"""

sql("callstack_lenient", with_logs(LENIENT_SEG + """
SELECT node, tid, id, message, depth, unmatched FROM c""", mismatched=True))

_END_TXT = ("'END  ' || fn || '        [duration:' || CAST(cc // 100 AS VARCHAR) || '.' || "
            "lpad(CAST(cc % 100 AS VARCHAR), 2, '0') || 's  ' || st || ']  ' || loc")

sql("render_callstack_lenient", with_logs(resolve_sql(LOG_KEYS) + LENIENT_SEG + f""",
cr AS (SELECT c.*, r.name AS rec_function, r.path AS rec_path, r.line AS rec_line
       FROM c LEFT JOIN res r ON c.function = r.function AND c.fileline = r.fileline),
mk AS (SELECT *, CASE WHEN message = 'BEG' THEN depth WHEN message = 'END' AND NOT unmatched THEN depth + 1 END AS lvl
       FROM cr),
pe AS (SELECT id, lag(puttime) OVER (PARTITION BY lvl ORDER BY id) AS beg_time
       FROM mk WHERE lvl IS NOT NULL),
tp AS (SELECT id, message,
              last_value(CASE WHEN message = 'BEG' THEN puttime END IGNORE NULLS) OVER (
                PARTITION BY depth ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top_time
       FROM mk WHERE message = 'BEG' OR (message = 'END' AND unmatched)),
x AS (SELECT mk.*,
             '[' || mk.rec_path || ':' || CAST(mk.rec_line AS VARCHAR) || ']' AS loc,
             mk.rec_function || '()' AS fn,
             rtrim(strftime(mk.puttime, '%H:%M:%S.%f'), '0') AS st,
             (epoch_us(mk.puttime) - epoch_us(coalesce(CASE WHEN mk.unmatched THEN NULL ELSE pe.beg_time END,
                                                        CASE WHEN tp.message = 'END' THEN tp.top_time END))
              + 5000) // 10000 AS cc
      FROM mk LEFT JOIN pe ON mk.id = pe.id LEFT JOIN tp ON mk.id = tp.id)
SELECT node, tid, id,
  CASE WHEN message = 'BEG' AND depth = 1
       THEN 'Start at ' || strftime(puttime, '%Y-%m-%d %H:%M:%S.%f') || chr(10) ELSE '' END ||
  CASE WHEN message = 'BEG' THEN {_indent_sql("'BEGIN  ' || fn || '        [' || st || ']  ' || loc", "depth - 1")}
       WHEN message = 'END' AND NOT unmatched THEN {_indent_sql(_END_TXT, "depth")}
       WHEN message = 'END' THEN {_indent_sql("'Unmatched function end:' || chr(10) || " + _END_TXT, "depth")}
       ELSE {_indent_sql("'[' || level || ']  ' || fn || '        [' || st || ']  ' || loc || chr(10) || " + _indent_sql("message", "depth"), "depth")}
  END AS text
FROM x""", mismatched=True))
