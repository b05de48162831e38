"""Lookup, packing and session analytics over the conversations table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ladders
from ..functions import text as X
from ..operators import examples as E
from ..operators import lookup as L
from ..operators import metrics as M
from ..operators import pack as P
from ..operators import spans as S

#: A turn is asked about once it has so many spans before it.
MIN_PRIOR = 2
K, BUDGET = 8, 160


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return S.spans(spark.read.parquet(f"{d}/conversations.parquet"))


def _queries(rows: DataFrame) -> DataFrame:
    asked = S.asof_query(rows).where((F.col("role") == "assistant") & (F.trim("text") != "") & (F.col("span_id") >= MIN_PRIOR) & F.col("query").isNotNull())
    return asked.select("session", F.col("turn").alias("q_turn"), "query")


def _top(rows: DataFrame, k: int = K) -> DataFrame:
    return L.ranked(L.lookup(rows, _queries(rows)), k)


def span_terms(spark, d):
    t = X.terms(F.col("text"))
    return _spans(spark, d).select("session", "turn", "role", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"), "tokens")


def postings_df(spark, d):
    return S.document_frequency(_spans(spark, d))


def running_history(spark, d):
    h = F.col("history")
    lower = lambda bounds, name: ladders.lower_bucket(h * 100, bounds).alias(name)
    structural = ladders.upper_bucket(h * 100, ladders.STRUCTURAL).alias("structural")
    buckets = (lower(ladders.QUALITY, "quality"), lower(ladders.KILLER, "killer"), lower(ladders.AGE, "age"))
    return _spans(spark, d).select("session", "turn", "span_id", "history", structural, *buckets)


def asof_query(spark, d):
    return S.asof_query(_spans(spark, d)).select("session", "turn", F.md5(F.col("query").cast("binary")).alias("query_md5"))


def lookup_score(spark, d):
    rows = _spans(spark, d)
    return L.lookup(rows, _queries(rows)).select("session", "q_turn", "span_id", F.round("score", 6).alias("score"), "shared")


def lookup_topk(spark, d):
    return _top(_spans(spark, d)).select("session", "q_turn", "rank", "span_id", "turn", F.round("score", 6).alias("score"))


def lookup_stats(spark, d):
    rows = _spans(spark, d)
    q = _queries(rows)
    return L.stats(rows, q, L.lookup(rows, q))


def view_pack(spark, d):
    return P.truncating(_top(_spans(spark, d)), BUDGET, cap=BUDGET // 2).select("session", "q_turn", "span_id", "turn", "take", "cut")


def view_recency(spark, d):
    rows = _spans(spark, d)
    return P.recency(rows, _queries(rows), 4, BUDGET // 2).select("session", "q_turn", "span_id", "take", "cut")


def view_dedup(spark, d):
    rows = _spans(spark, d)
    top = _top(rows).join(rows.select("session", "span_id", "text"), ["session", "span_id"])
    return P.without_repeats(top).select("session", "q_turn", "rank", "span_id", "copies")


def tail_pack_skip(spark, d):
    rows = _spans(spark, d)
    return P.skipping(rows, _queries(rows), BUDGET).select("session", "q_turn", "used", F.size("kept").alias("kept"), F.aggregate("kept", F.lit(0), lambda a, x: a * 31 + x).alias("kept_key"))


def provenance_expand(spark, d):
    rows = _spans(spark, d)
    q = _queries(rows)
    return L.provenance(rows, q, L.ranked(L.lookup(rows, q), 3), 6)


def structural_summary(spark, d):
    rows = _spans(spark, d)
    q = _queries(rows)
    per = L.stats(rows, q, L.lookup(rows, q)).join(rows.select("session", F.col("turn").alias("q_turn"), "history"), ["session", "q_turn"])
    per = per.withColumn("bucket", ladders.upper_bucket(F.col("history") * 100, ladders.STRUCTURAL)).withColumn("depth", ladders.lower_bucket(F.col("total_spans"), (4, 6)))
    out = M.structural_summary(per, ["query_terms", "postings_visited", "candidate_spans"], [[], ["bucket"], ["depth"]])
    return out.withColumn("bucket", F.coalesce("bucket", F.lit("all"))).withColumn("depth", F.coalesce(F.col("depth").cast("string"), F.lit("all")))


def dead_state(spark, d):
    return M.dead_state(_spans(spark, d))


def evidence_mass(spark, d):
    rows = _spans(spark, d)
    return M.evidence_mass(rows, _queries(rows))


def spread_sample(spark, d):
    return S.evenly_spread(_spans(spark, d).select("session", "turn", "span_id", "tokens"), 3, ["session"], ["turn"]).select("session", "turn", "tokens")


def bucket_medians(spark, d):
    rows = _spans(spark, d)
    return M.bucket_medians(rows, "tokens", ladders.lower_bucket(F.col("history") * 100, ladders.KILLER), 5)


#: Options of the composed view: two newest spans, half a budget a span, three identifiers, copies once.
VIEW = {"k": K, "recent": 2, "recent_share": 0.4, "span_share": 0.5, "provenance": 3, "dedup": True}


def compile_view(spark, d):
    rows = _spans(spark, d)
    seen = P.view(rows, _queries(rows), BUDGET, **VIEW)
    return seen.select("session", "q_turn", "place", "span_id", "take", "cut", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def recency_view(spark, d):
    """The newest spans that fit, skipping what does not, the newest one included."""
    rows = _spans(spark, d)
    got = P.skipping(rows, _queries(rows), BUDGET // 4, first_always=False)
    return got.select("session", "q_turn", "used", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


def _example_summary(spark, d, mode, **options):
    got = E.build_examples(_spans(spark, d), mode, BUDGET, least_spans=MIN_PRIOR, view=options.pop("view", {"k": K}), **options)
    return got.select("session", "q_turn", "history", "turns", "active_tokens", "summary_tokens", F.md5(F.col("active").cast("binary")).alias("active_md5"), F.md5(F.col("target").cast("binary")).alias("target_md5"))


def examples_view(spark, d):
    return _example_summary(spark, d, "view")


def examples_recency(spark, d):
    return _example_summary(spark, d, "recency")


def examples_compact(spark, d):
    return _example_summary(spark, d, "compact")


def examples_consolidate(spark, d):
    return _example_summary(spark, d, "consolidate")


def examples_materialize(spark, d):
    return _example_summary(spark, d, "materialize")


def examples_state_first(spark, d):
    return _example_summary(spark, d, "state_first")


def examples_tail_state(spark, d):
    return _example_summary(spark, d, "tail_state")


def examples_action_window(spark, d):
    return _example_summary(spark, d, "action_window", compiler="raw")


def examples_tail_query(spark, d):
    return _example_summary(spark, d, "tail_query", compiler="materialize")


_CTE = """
WITH spans AS (
  SELECT conv_id AS session, turn, role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS span_id,
    list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_./:-]+'), lambda x: lower(x)) AS terms
  FROM conversations),
s AS (SELECT *, greatest(1, len(terms)) AS tokens FROM spans),
h AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history FROM s),
a AS (SELECT *, nullif(trim(last_value(CASE WHEN role IN ('user', 'tool') THEN text END IGNORE NULLS) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '') AS query FROM h),
q AS (SELECT session, turn AS q_turn, query FROM a WHERE role = 'assistant' AND trim(text) <> '' AND span_id >= 2 AND query IS NOT NULL),
st AS (SELECT session, turn, span_id, unnest(list_distinct(terms)) AS term FROM s),
qt AS (SELECT session, q_turn, unnest(list_distinct(list_transform(regexp_extract_all(query, '[A-Za-z0-9_./:-]+'), lambda x: lower(x)))) AS term FROM q),
m AS (SELECT qt.session, q_turn, term, span_id, turn, 1.0 / count(*) OVER (PARTITION BY qt.session, term, q_turn) AS w, count(*) OVER (PARTITION BY qt.session, term, q_turn) AS df FROM qt JOIN st USING (session, term) WHERE turn < q_turn),
hits AS (SELECT m.session, q_turn, m.span_id, m.turn, round(sum(w), 9) AS score, count(*) AS shared, any_value(s.tokens) AS tokens FROM m JOIN s ON s.session = m.session AND s.span_id = m.span_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session, q_turn ORDER BY score DESC, turn DESC, span_id DESC) AS rank FROM hits),
top AS (SELECT * FROM r WHERE rank <= 8),
stats AS (
  SELECT q.session, q.q_turn, (SELECT count(*) FROM qt WHERE qt.session = q.session AND qt.q_turn = q.q_turn) AS query_terms,
    CAST(coalesce((SELECT sum(shared) FROM hits WHERE hits.session = q.session AND hits.q_turn = q.q_turn), 0) AS BIGINT) AS postings_visited,
    (SELECT count(*) FROM hits WHERE hits.session = q.session AND hits.q_turn = q.q_turn) AS candidate_spans,
    (SELECT count(*) FROM s WHERE s.session = q.session AND s.turn < q.q_turn) AS total_spans
  FROM q),
prior AS (SELECT q.session, q.q_turn, s.span_id, s.turn, s.tokens, row_number() OVER (PARTITION BY q.session, q.q_turn ORDER BY s.turn DESC) AS rank FROM q JOIN s ON s.session = q.session AND s.turn < q.q_turn)
"""


def _pack_sql(source: str, need: int, budget: int, columns: str) -> str:
    return f"""{_CTE}, n AS (SELECT *, least(tokens, {need}) AS need FROM {source}),
b AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY session, q_turn ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n),
t AS (SELECT *, CAST(least(need, {budget} - used) AS BIGINT) AS take FROM b)
SELECT {columns}, take, take < tokens AS cut FROM t WHERE take > 0"""


def _lower(bounds: tuple, value: str = "history * 100") -> str:
    return " + ".join(f"CASE WHEN {value} >= {b} THEN 1 ELSE 0 END" for b in bounds)


_UPPER = "CASE " + " ".join(f"WHEN history * 100 <= {b} THEN '{i}'" for i, b in enumerate(ladders.STRUCTURAL)) + f" ELSE '{len(ladders.STRUCTURAL)}' END"
_SUMMARY = ", ".join(f"round(quantile_cont({m}, 0.5), 6) AS {m}_p50, round(quantile_cont({m}, 0.95), 6) AS {m}_p95" for m in ("query_terms", "postings_visited", "candidate_spans"))

_BY = "PARTITION BY session, q_turn"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_VIEW_SQL = (
    _CTE
    + f""", tx AS (SELECT session, span_id, md5(trim(regexp_replace(text, '[{X.BLANK}]+', ' ', 'g'))) AS f FROM s),
t1 AS (SELECT top.*, tx.f, min(rank) OVER (PARTITION BY top.session, q_turn, f) AS br FROM top JOIN tx ON tx.session = top.session AND tx.span_id = top.span_id),
t2 AS (SELECT * EXCLUDE (rank), row_number() OVER ({_BY} ORDER BY br, turn DESC, span_id DESC) AS rank FROM t1),
l1 AS (SELECT *, least(tokens, 80) AS need FROM prior WHERE rank <= 2),
l2 AS (SELECT *, least(need, 64 - coalesce(sum(need) OVER ({_BY} ORDER BY rank {_BEFORE}), 0)) AS take FROM l1),
late AS (SELECT l2.*, tx.f, row_number() OVER (PARTITION BY l2.session, q_turn, f ORDER BY rank) AS i FROM l2 JOIN tx ON tx.session = l2.session AND tx.span_id = l2.span_id WHERE take > 0),
o AS (SELECT session, q_turn, term FROM qt WHERE length(term) > 3 UNION SELECT t2.session, t2.q_turn, st.term FROM t2 JOIN st ON st.session = t2.session AND st.span_id = t2.span_id WHERE t2.rank <= 3 AND length(st.term) > 3 AND (contains(st.term, '/') OR contains(st.term, '.'))),
o2 AS (SELECT *, row_number() OVER ({_BY} ORDER BY term) AS n FROM o),
pv AS (SELECT o2.session, o2.q_turn, o2.term, st.span_id, st.turn, row_number() OVER (PARTITION BY o2.session, o2.q_turn, o2.term ORDER BY st.span_id) AS p FROM o2 JOIN st ON st.session = o2.session AND st.term = o2.term AND st.turn < o2.q_turn WHERE o2.n <= 3),
ex AS (SELECT session, q_turn, span_id, turn, row_number() OVER ({_BY} ORDER BY term, span_id) AS rank FROM pv WHERE p <= 8
  AND NOT EXISTS (SELECT 1 FROM t2 WHERE t2.session = pv.session AND t2.q_turn = pv.q_turn AND t2.span_id = pv.span_id)
  AND NOT EXISTS (SELECT 1 FROM late WHERE late.session = pv.session AND late.q_turn = pv.q_turn AND late.span_id = pv.span_id)),
fa AS (SELECT session, q_turn, span_id, turn, rank, 1 AS channel FROM t2 UNION ALL SELECT session, q_turn, span_id, turn, rank, 2 FROM ex WHERE rank <= 3),
fb AS (SELECT fa.*, tx.f, s.tokens FROM fa JOIN tx ON tx.session = fa.session AND tx.span_id = fa.span_id JOIN s ON s.session = fa.session AND s.span_id = fa.span_id
  WHERE NOT EXISTS (SELECT 1 FROM late WHERE late.session = fa.session AND late.q_turn = fa.q_turn AND (late.span_id = fa.span_id OR late.f = tx.f))),
fc AS (SELECT *, row_number() OVER (PARTITION BY session, q_turn, f ORDER BY channel, rank) AS i, least(tokens, 80) AS need FROM fb),
sp AS (SELECT session, q_turn, sum(take) AS spent FROM late WHERE i = 1 GROUP BY ALL),
fd AS (SELECT fc.*, least(need, {BUDGET} - coalesce(spent, 0) - coalesce(sum(need) OVER (PARTITION BY fc.session, fc.q_turn ORDER BY channel, rank {_BEFORE}), 0)) AS take FROM fc LEFT JOIN sp ON sp.session = fc.session AND sp.q_turn = fc.q_turn WHERE i = 1),
z AS (SELECT session, q_turn, span_id, turn, tokens, rank, channel, take FROM fd WHERE take > 0 UNION ALL SELECT session, q_turn, span_id, turn, tokens, rank, 0, take FROM late WHERE i = 1)
"""
)
_EXAMPLES_SQL = (
    (_CTE.replace("{", "{{").replace("}", "}}"))
    + f""", pa AS (SELECT *, least(tokens, {BUDGET}) AS need FROM top), pb AS (SELECT *, least(need, {BUDGET} - coalesce(sum(need) OVER ({_BY} ORDER BY rank {_BEFORE}), 0)) AS take FROM pa),
p AS (SELECT session, q_turn, span_id, take FROM pb WHERE take > 0),
ya AS (SELECT session, q_turn, list({{{{'k': [span_id], 't': tokens}}}} ORDER BY turn DESC) FILTER (tokens <= {BUDGET}) AS a FROM prior GROUP BY session, q_turn),
yb AS (SELECT session, q_turn, unnest(list_reduce(a, lambda x, y: CASE WHEN x.t + y.t <= {BUDGET} THEN {{{{'k': list_concat(x.k, y.k), 't': x.t + y.t}}}} ELSE x END).k) AS span_id FROM ya WHERE a IS NOT NULL),
y AS (SELECT yb.session, yb.q_turn, yb.span_id, s.tokens AS take FROM yb JOIN s ON s.session = yb.session AND s.span_id = yb.span_id),
g AS (SELECT v.session, v.q_turn, sum(take) AS t, string_agg('<' || role || '>' || chr(10) || CASE WHEN take < tokens THEN left(text, CAST(greatest(1, floor(length(text) * (take / CAST(tokens AS DOUBLE)))) AS BIGINT)) ELSE text END || chr(10), '' ORDER BY turn) AS active
  FROM {{active}} v JOIN s ON s.session = v.session AND s.span_id = v.span_id GROUP BY ALL)
SELECT a.session, a.turn AS q_turn, a.history, a.span_id AS turns, CAST(coalesce(g.t, 0) AS BIGINT) AS active_tokens, CAST(0 AS BIGINT) AS summary_tokens, md5(coalesce(g.active, '')) AS active_md5, md5(a.text) AS target_md5
FROM q JOIN a ON a.session = q.session AND a.turn = q.q_turn LEFT JOIN g ON g.session = q.session AND g.q_turn = q.q_turn"""
)

SQL = {
    "span_terms": _CTE + "SELECT session, turn, role, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct, tokens FROM s",
    "postings_df": _CTE + """,
      z AS (SELECT session, count(*) AS n
      FROM s
      GROUP BY session),
      f AS (SELECT session, term, count(*) AS df
      FROM st
      GROUP BY ALL)
      SELECT session, term, df, df <= greatest(2, floor(n * 0.1)) AS rare
      FROM f JOIN z USING (session)""",
    "running_history": _CTE + f"""SELECT session, turn, span_id, history, {_UPPER} AS structural, {_lower(ladders.QUALITY)} AS quality, {_lower(ladders.KILLER)} AS killer, {_lower(ladders.AGE)} AS age
      FROM h""",
    "asof_query": _CTE + "SELECT session, turn, md5(query) AS query_md5 FROM a",
    "lookup_score": _CTE + "SELECT session, q_turn, span_id, round(score, 6) AS score, shared FROM hits",
    "lookup_topk": _CTE + "SELECT session, q_turn, rank, span_id, turn, round(score, 6) AS score FROM top",
    "lookup_stats": _CTE + "SELECT * FROM stats",
    "view_pack": _pack_sql("top", BUDGET // 2, BUDGET, "session, q_turn, span_id, turn"),
    "view_recency": _pack_sql("(SELECT * FROM prior WHERE rank <= 4)", BUDGET // 2, BUDGET // 2, "session, q_turn, span_id"),
    "view_dedup": _CTE + r""",
      x AS (SELECT top.*, md5(trim(regexp_replace(s.text, '[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS f
      FROM top JOIN s ON s.session = top.session AND s.span_id = top.span_id)
      SELECT session, q_turn, min(rank) AS rank, arg_max(span_id, turn * 1000000 + span_id) AS span_id, count(*) AS copies
      FROM x
      GROUP BY session, q_turn, f""",
    "tail_pack_skip": _CTE + f""", l AS (SELECT session, q_turn, list({{'u': CAST(0 AS BIGINT), 'k': [span_id], 't': tokens}} ORDER BY turn DESC) AS a FROM prior GROUP BY session, q_turn),
      f AS (SELECT session, q_turn, list_reduce(a, lambda x, y: CASE WHEN (x.t + y.t) <= {BUDGET} THEN {{'u': CAST(0 AS BIGINT), 'k': list_concat(x.k, y.k), 't': x.t + y.t}} ELSE x END) AS z FROM l)
      SELECT session, q_turn, z.t AS used, len(z.k) AS kept, list_reduce(list_sort(z.k), lambda x, y: x * 31 + y, CAST(0 AS BIGINT)) AS kept_key FROM f""",
    "provenance_expand": _CTE + """, o AS (SELECT session, q_turn, term FROM qt WHERE length(term) > 3 UNION SELECT r.session, r.q_turn, st.term FROM r JOIN st ON st.session = r.session AND st.span_id = r.span_id WHERE r.rank <= 3 AND length(st.term) > 3 AND (contains(st.term, '/') OR contains(st.term, '.'))),
      o2 AS (SELECT *, row_number() OVER (PARTITION BY session, q_turn ORDER BY term) AS n FROM o),
      p AS (SELECT o2.session, o2.q_turn, o2.term, st.span_id, row_number() OVER (PARTITION BY o2.session, o2.q_turn, o2.term ORDER BY st.span_id) AS p
        FROM o2 JOIN st ON st.session = o2.session AND st.term = o2.term AND st.turn < o2.q_turn
        WHERE o2.n <= 6),
      e AS (SELECT session, q_turn, term, span_id, row_number() OVER (PARTITION BY session, q_turn ORDER BY term, span_id) AS extra
        FROM p
        WHERE p <= 8 AND NOT EXISTS (SELECT 1
        FROM r
        WHERE r.rank <= 3 AND r.session = p.session AND r.q_turn = p.q_turn AND r.span_id = p.span_id))
      SELECT * FROM e WHERE extra <= 6""",
    "structural_summary": _CTE + f""", g AS (SELECT stats.*, {_UPPER} AS bucket, CAST({_lower((4, 6), 'total_spans')} AS VARCHAR) AS depth FROM stats JOIN h ON h.session = stats.session AND h.turn = stats.q_turn)
      SELECT coalesce(bucket, 'all') AS bucket, coalesce(depth, 'all') AS depth, count(*) AS n, {_SUMMARY} FROM g GROUP BY GROUPING SETS ((), (bucket), (depth))""",
    "dead_state": _CTE + """,
      d AS (SELECT session, sum(tokens) AS t, count(*) AS spans, list(tokens ORDER BY tokens DESC) AS l, arg_max(tokens, turn) AS newest
      FROM s
      GROUP BY session)
      SELECT session, CAST(t AS BIGINT) AS history_tokens, spans, round(l[1] / t, 3) AS largest_span, round(list_sum(l[1:2]) / t, 3) AS top2_share, round(list_sum(l[1:5]) / t, 3) AS top5_share, round(newest / t, 3) AS tail_share
      FROM d""",
    "evidence_mass": _CTE + """,
      z AS (SELECT session, q_turn, count(*) AS n
      FROM prior
      GROUP BY ALL),
      e AS (SELECT m.session, m.q_turn, m.span_id, count(*) AS shared
      FROM m JOIN z ON z.session = m.session AND z.q_turn = m.q_turn
      WHERE m.df <= greatest(2, floor(z.n * 0.1))
      GROUP BY ALL)
      SELECT e.session, e.q_turn, CAST(sum(tokens) AS BIGINT) AS mass1, CAST(coalesce(sum(tokens) FILTER (shared >= 2), 0) AS BIGINT) AS mass2, coalesce(max(tokens) FILTER (shared >= 2), 0) AS largest2
      FROM e JOIN s ON s.session = e.session AND s.span_id = e.span_id
      GROUP BY ALL""",
    "spread_sample": _CTE + """,
      c AS (SELECT *, count(*) OVER (PARTITION BY session) AS m
      FROM s)
      SELECT session, turn, tokens
      FROM c
      WHERE m <= 3 OR span_id IN (0, CAST(round_even((m - 1) / 2.0, 0) AS BIGINT), m - 1)""",
    "bucket_medians": _CTE + f""",
      b AS (SELECT {_lower(ladders.KILLER)} AS bucket, tokens
      FROM h)
      SELECT CAST(i.range AS INTEGER) AS bucket, count(b.tokens) AS n, CAST(floor(quantile_cont(b.tokens, 0.5)) AS BIGINT) AS median
      FROM range(5) i LEFT JOIN b ON b.bucket = i.range
      GROUP BY 1""",
    "compile_view": _VIEW_SQL
    + """SELECT session, q_turn, row_number() OVER (PARTITION BY session, q_turn ORDER BY turn, span_id, channel, rank) AS place, span_id, CAST(take AS BIGINT) AS take, take < tokens AS cut, length(said) AS chars, md5(said) AS text_md5
      FROM (SELECT z.*, CASE WHEN take < z.tokens THEN left(s.text, CAST(greatest(1, floor(length(s.text) * (take / CAST(z.tokens AS DOUBLE)))) AS BIGINT)) ELSE s.text END AS said
        FROM z JOIN s ON s.session = z.session AND s.span_id = z.span_id)""",
    "recency_view": _CTE + f""", l AS (SELECT session, q_turn, list({{'k': [span_id], 't': tokens}} ORDER BY turn DESC) FILTER (tokens <= {BUDGET // 4}) AS a, count(*) AS n FROM prior GROUP BY session, q_turn),
      f AS (SELECT session, q_turn, CASE WHEN a IS NULL THEN {{'k': CAST([] AS BIGINT[]), 't': 0}} ELSE list_reduce(a, lambda x, y: CASE WHEN x.t + y.t <= {BUDGET // 4} THEN {{'k': list_concat(x.k, y.k), 't': x.t + y.t}} ELSE x END) END AS z
        FROM l)
      SELECT session, q_turn, CAST(z.t AS BIGINT) AS used, array_to_string(list_sort(z.k), ',') AS kept FROM f""",
    "examples_view": _EXAMPLES_SQL.format(active="p"),
    "examples_recency": _EXAMPLES_SQL.format(active="y"),
}
QUERIES = {
    f.__name__: f
    for f in (
        span_terms, postings_df, running_history, asof_query, lookup_score, lookup_topk, lookup_stats, view_pack, view_recency, view_dedup, tail_pack_skip,
        provenance_expand, structural_summary, dead_state, evidence_mass, spread_sample, bucket_medians, compile_view, recency_view, examples_view, examples_recency,
        examples_compact, examples_consolidate, examples_materialize, examples_state_first, examples_tail_state, examples_action_window, examples_tail_query,
    )
}
