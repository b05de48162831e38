"""Fingerprints, classification, localisation and duplicates, over documents and a derived transcript.

The driver's conversations name no files, so these queries read a transcript that both engines
derive from `part` by the same expressions: numbered dumps, diffs, editor headers, test runs, prose.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import actions as A
from ..operators import metrics as M
from ..operators import spans as S

_N = "chr(10)"
_TEXT = f"""CASE p_partkey % 6
  WHEN 0 THEN concat('     1', chr(9), 'import os', {_N}, '     2', chr(9), 'x = ', CAST(p_size AS STRING), {_N}, '     3', chr(9), 'see pkg/mod_', CAST(p_size % 7 AS STRING), '.py', {_N})
  WHEN 1 THEN concat('diff --git a/pkg/mod_', CAST(p_size % 7 AS STRING), '.py b/pkg/mod_', CAST(p_size % 7 AS STRING), '.py', {_N}, '@@ -1,1 +1,1 @@', {_N}, '-old', {_N}, '+new ', CAST(p_size AS STRING))
  WHEN 2 THEN concat('python -m pytest tests/mod_', CAST(p_size % 3 AS STRING), '.py', {_N}, 'FAILED ', CAST(p_size AS STRING))
  WHEN 3 THEN concat('please look at the ', p_brand, ' again', {_N}, 'it is   slow')
  WHEN 4 THEN concat('*** Update File: /workspace/org__repo__1/pkg/mod_', CAST(p_size % 7 AS STRING), '.py', {_N}, 'then edit src/conf.json and x.cpp')
  ELSE concat('the name is ', p_type, {_N}, '  return x', {_N}, {_N}, 'Modified File: `pkg/mod_', CAST(p_size % 7 AS STRING), '.py` done') END"""
_SELECT = f"SELECT p_partkey % 40 AS session, CAST(floor(p_partkey / 40.0) AS BIGINT) AS turn, CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN 'tool' WHEN p_partkey % 6 = 3 THEN 'user' ELSE 'assistant' END AS role, {_TEXT} AS text, p_partkey, p_size FROM part"


def transcript(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr(*_columns())
    return rows


def _columns():
    return ["p_partkey % 40 AS session", "CAST(floor(p_partkey / 40.0) AS BIGINT) AS turn", "CASE WHEN p_partkey % 6 IN (0, 1, 2) THEN 'tool' WHEN p_partkey % 6 = 3 THEN 'user' ELSE 'assistant' END AS role", f"{_TEXT} AS text", "p_partkey", "p_size"]


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def doc_fingerprint_dups(spark, d):
    by = _docs(spark, d).where(F.col("text").isNotNull()).groupBy(X.fingerprint(F.col("text")).alias("fingerprint"))
    return by.agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def content_fingerprints(spark, d):
    return transcript(spark, d).select("p_partkey", X.content_fingerprint(F.col("text")).alias("content"), X.fingerprint(F.col("text")).alias("plain"))


def path_of(spark, d):
    return transcript(spark, d).select("p_partkey", X.path_of(F.col("text")).alias("path"), F.array_join(X.paths(F.col("text")), " ").alias("paths"))


def classify_spans(spark, d):
    return transcript(spark, d).select("p_partkey", X.classify(F.col("text")).alias("kind"), X.signature(F.col("text")).alias("signature"))


def verbatim_lines(spark, d):
    lines = transcript(spark, d).select("p_partkey", F.posexplode(X.lines_of(F.col("text"))).alias("line_no", "line"))
    return lines.select("p_partkey", "line_no", X.must_stay_verbatim(F.col("line")).alias("verbatim"))


def patch_files(spark, d):
    return transcript(spark, d).select("p_partkey", F.array_join(F.sort_array(X.patch_files(F.col("text"))), " ").alias("files"), F.array_join(F.sort_array(X.mentioned_files(F.col("text"))), " ").alias("mentioned"))


def session_patch_files(spark, d):
    """Set union over a session's messages."""
    return transcript(spark, d).select("session", F.explode(X.patch_files(F.col("text"))).alias("file")).groupBy("session").agg(F.array_join(F.sort_array(F.collect_set("file")), " ").alias("files"))


def localization_f1(spark, d):
    rows = transcript(spark, d)
    recorded = rows.select("session", F.explode(X.patch_files(F.col("text"))).alias("f")).groupBy("session").agg(F.sort_array(F.collect_set("f")).alias("recorded"))
    said = rows.where("role = 'assistant'").select("session", "p_partkey", X.mentioned_files(F.col("text")).alias("mentioned"))
    s = X.localisation(F.col("mentioned"), F.col("recorded"))
    return said.join(recorded, "session").withColumn("s", s).select("p_partkey", F.col("s.hits").alias("hits"), *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


def latest_per_key(spark, d):
    rows = transcript(spark, d).withColumn("span_id", F.col("p_partkey"))
    out = S.latest_per_key(rows, X.signature(F.col("text")))
    return out.select("session", "key", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("superseded", ",").alias("superseded"))


def near_dup_pairs(spark, d):
    return M.near_duplicate_pairs(_docs(spark, d))


def score_action(spark, d):
    """Recorded against generated actions, with null apart from false."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", *[F.expr(e) for e in _ACTIONS])
    return A.score_actions(rows)


_ACTIONS = (
    "CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 3 = 0 THEN 'bash' ELSE 'edit' END AS g_tool",
    "CASE WHEN l_suppkey % 4 = 0 THEN 'bash' ELSE 'edit' END AS r_tool",
    "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('src/mod_', CAST(l_partkey % 4 AS STRING), '.py') END AS g_target",
    "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('mod_', CAST(l_suppkey % 4 AS STRING), '.py') END AS r_target",
    "CASE WHEN l_partkey % 2 = 0 THEN 'view' ELSE 'create' END AS g_verb",
    "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'view' END AS r_verb",
)

_RX = X.PATH
_DUCK = _SELECT.replace("STRING", "VARCHAR")
_T = f"""WITH t0 AS ({_DUCK}),
t AS (SELECT *, regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\n') AS lines,
  list_distinct(list_transform(regexp_extract_all(text, '{_RX}'), lambda p: CASE WHEN regexp_matches(p, '^[ab]/') AND length(p) - length(replace(p, '/', '')) > 1 THEN substring(p, 3) ELSE p END)) AS ps FROM t0)"""


def _norm(p: str) -> str:
    p = f"regexp_replace(trim({p}), '^[`''\"]+|[`''\"]+$', '', 'g')"
    for prefix in ("/workspace/", "/testbed/", "./"):
        p = f"regexp_replace({p}, '^{prefix.replace('.', chr(92) + '.')}', '')"
    return f"regexp_replace(regexp_replace({p}, '^/+', ''), '^[^/]*__[^/]*/', '')"


def _extract(rx: str, g: int) -> str:
    rx = rx.replace("'", "''")
    return f"list_transform(regexp_extract_all(text, '{rx}', {g}), lambda p: {_norm('p')})"


def _whole(a: str) -> str:
    return f"list_filter({a}, lambda p: regexp_full_match(p, '{_RX}'))"


_FILES = f"list_sort(list_distinct(list_filter(flatten([{_extract(X.DIFF_FILE, 1)}, {_extract(X.DIFF_FILE, 2)}, {_extract(X.EDITOR_FILE, 1)}, {_whole(_extract(X.MODIFIED_FILE, 1))}, {_whole(_extract(X.ARG_PATH, 1))}]), lambda p: p <> '' AND NOT starts_with(p, '..'))))"
_MENTIONED = f"list_sort(list_distinct({_extract(_RX, 0)}))"
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_SIG = f"nullif(trim(regexp_extract(left({_FLAT}, 400), '{X.COMMAND}', 0)), '')"
_DUMPED = r"len(list_filter(lines, lambda x: regexp_matches(x, '^\s*\d+\t'))) >= greatest(3, floor(len(lines) / 2))"
_KEEP = " OR ".join("regexp_matches(line, '" + rx.replace("'", "''") + "')" for rx in (X.DUMP, X.ERROR, X.CODE, X.PATH, X.NUMBER_OR_ID))
_SAME = "(m = r OR ends_with(m, '/' || r) OR ends_with(r, '/' || m) OR (string_split(m, '/')[-1] = string_split(r, '/')[-1] AND length(string_split(m, '/')[-1]) > 3))"
_SAME_ACTION = _SAME
for _old, _new in (
    ("(m ", "(g_target "), ("m,", "g_target,"), ("|| m)", "|| g_target)"), ("= r ", "= r_target "), ("|| r)", "|| r_target)"),
    ("with(r,", "with(r_target,"), ("split(r,", "split(r_target,"), ("split(m,", "split(g_target,"),
):
    _SAME_ACTION = _SAME_ACTION.replace(_old, _new)

SQL = {
    "doc_fingerprint_dups": rf"""SELECT md5(trim(regexp_replace(text, '[{X.BLANK}]+', ' ', 'g'))) AS fingerprint, count(*) AS copies, min(doc_id) AS first_doc
      FROM documents
      WHERE text IS NOT NULL
      GROUP BY 1
      HAVING count(*) > 1""",
    "content_fingerprints": _T + r" SELECT p_partkey, md5(array_to_string(list_transform(lines, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '^\s*\d+\t', ''), '^\s*\d+\s{2,}', ''), '\s+', ' ', 'g'))), ' ')) AS content, md5(" + _FLAT + ") AS plain FROM t",
    "path_of": _T + " SELECT p_partkey, CASE WHEN len(ps) = 1 THEN ps[1] END AS path, array_to_string(list_transform(list_filter(regexp_extract_all(text, '" + _RX + "'), lambda p, i: true), lambda p: p), ' ') AS paths FROM t",
    "classify_spans": _T + rf""" SELECT p_partkey, CASE WHEN len(ps) = 1 AND ({_DUMPED} OR regexp_matches(text, '(?m)^<{{5,}} SEARCH') OR starts_with(ltrim(text, chr(9) || chr(10) || ' '), 'diff --git') OR contains(text, '@@ '))
        THEN 'file_event' WHEN {_SIG} IS NOT NULL THEN 'command_result' ELSE 'loose' END AS kind, {_SIG} AS signature FROM t""",
    "verbatim_lines": _T + f""",
      l AS (SELECT p_partkey, unnest(lines) AS line, unnest(range(len(lines))) AS line_no
      FROM t)
      SELECT p_partkey, line_no, trim(line) <> '' AND ({_KEEP}) AS verbatim
      FROM l""",
    "patch_files": _T + f" SELECT p_partkey, array_to_string({_FILES}, ' ') AS files, array_to_string({_MENTIONED}, ' ') AS mentioned FROM t",
    "session_patch_files": _T + f""",
      f AS (SELECT DISTINCT session, unnest({_FILES}) AS file
      FROM t)
      SELECT session, string_agg(file, ' ' ORDER BY file) AS files
      FROM f
      GROUP BY session""",
    "localization_f1": _T + f""", rec AS (SELECT session, list(DISTINCT file) AS recorded FROM (SELECT session, unnest({_FILES}) AS file FROM t) GROUP BY session),
      g AS (SELECT p_partkey, {_MENTIONED} AS mentioned, recorded FROM t JOIN rec USING (session) WHERE role = 'assistant'),
      x AS (SELECT p_partkey, len(mentioned) AS nm, len(recorded) AS nr, len(list_filter(recorded, lambda r: len(list_filter(mentioned, lambda m: {_SAME})) > 0)) AS hits FROM g),
      y AS (SELECT p_partkey, hits, CASE WHEN nm > 0 THEN hits / nm ELSE 0 END AS p, hits / nr AS r FROM x)
      SELECT p_partkey, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM y""",
    "latest_per_key": _T + f""",
      k AS (SELECT session, turn, text, {_SIG} AS key, row_number() OVER (PARTITION BY session, {_SIG} ORDER BY turn DESC, p_partkey DESC) AS n, turn AS tt
      FROM t),
      z AS (SELECT *
      FROM k
      WHERE key IS NOT NULL)
      SELECT session, key, max(turn) AS turn, md5(any_value(text) FILTER (n = 1)) AS text_md5, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (n > 1), '') AS superseded
      FROM z
      GROUP BY session, key""",
    "near_dup_pairs": r"""WITH l AS (SELECT DISTINCT doc_id, trim(regexp_replace(regexp_replace(line, '^\s*\d+\t', ''), '^\s*\d+\s{2,}', '')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
      p AS (SELECT * FROM l WHERE line <> ''), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
      i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM p a JOIN p b ON a.line = b.line AND a.doc_id < b.doc_id GROUP BY 1, 2)
      SELECT a, b, round(i / (x.n + y.n - i), 6) AS jaccard
        FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
        WHERE i / (x.n + y.n - i) >= 0.7 AND least(x.n, y.n) >= 0.7 * greatest(x.n, y.n)""",
    "score_action": f"""WITH a AS (SELECT l_orderkey, l_linenumber, {', '.join(_ACTIONS).replace('STRING', 'VARCHAR')} FROM lineitem),
      s AS (SELECT *, g_tool IS NOT NULL AS parseable, CASE WHEN g_tool IS NULL THEN NULL ELSE g_tool = r_tool END AS tool,
        CASE WHEN g_tool IS NULL OR g_target IS NULL OR r_target IS NULL THEN NULL ELSE {_SAME_ACTION} END AS target FROM a)
      SELECT l_orderkey, l_linenumber, parseable, tool, target, CASE WHEN NOT parseable THEN NULL ELSE tool AND target IS DISTINCT
        FROM FALSE AND (r_verb IS NULL OR g_verb IS NOT DISTINCT
        FROM r_verb) END AS exact
        FROM s""",
}
# The diff's side prefix is dropped and repeats removed in first-seen order.
SQL["path_of"] = _T + ", u AS (SELECT p_partkey, ps, unnest(list_transform(regexp_extract_all(text, '" + _RX + "'), lambda p: CASE WHEN regexp_matches(p, '^[ab]/') AND length(p) - length(replace(p, '/', '')) > 1 THEN substring(p, 3) ELSE p END)) AS p, unnest(range(len(regexp_extract_all(text, '" + _RX + "')))) AS i FROM t), f AS (SELECT p_partkey, p, min(i) AS i FROM u GROUP BY p_partkey, p), j AS (SELECT p_partkey, string_agg(p, ' ' ORDER BY i) AS paths FROM f GROUP BY p_partkey) SELECT t.p_partkey, CASE WHEN len(ps) = 1 THEN ps[1] END AS path, coalesce(j.paths, '') AS paths FROM t LEFT JOIN j USING (p_partkey)"

QUERIES = {f.__name__: f for f in (doc_fingerprint_dups, content_fingerprints, path_of, classify_spans, verbatim_lines, patch_files, session_patch_files, localization_f1, latest_per_key, near_dup_pairs, score_action)}
