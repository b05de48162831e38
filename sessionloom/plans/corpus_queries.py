"""Corpus operators: decoding, filters, checked joins, cuts; over rows that both engines derive alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cuts
from ..functions import text as X
from ..operators import receipts as V
from ..operators import replay as R
from ..sources import receipts as O
from ..sources import sessions as IO
from .text_queries import _FILES, _T, transcript

_META = "'{\"patch_present\": ' || CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END || ', \"instance_id\": \"repo' || CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey AS STRING) || '\"}'"
_LONG = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 4000 END"


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def _sessions(spark, d):
    """A session a part: its one message in one of the three columns, with metadata that may be malformed."""
    said = transcript(spark, d).select("p_partkey", "text")
    message = F.struct(F.lit("tool").alias("role"), F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_calls_json"), F.lit(None).cast("string").alias("tool_calls"))
    kind = F.col("p_partkey") % 3
    rows = _part(spark, d).join(said, "p_partkey")
    one = F.array(message)
    meta = F.when(F.col("p_partkey") % 11 == 0, F.lit("{not json")).otherwise(F.expr(_META))
    return rows.select(
        F.col("p_partkey").cast("string").alias("session_id"),
        F.expr(_LONG).cast("long").alias("max_isl"),
        meta.alias("ground_truth_meta_json"),
        F.when(kind == 0, F.to_json(one)).alias("messages_json"),
        F.when(kind == 1, one).alias("messages"),
        F.when((kind == 2) & (F.col("p_partkey") % 5 > 0), one).alias("trajectory"),
    )


def decoded_messages(spark, d):
    rows = IO.messages(_sessions(spark, d))
    return rows.select(F.col("session_id").cast("long").alias("session_id"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def flattened_content(spark, d):
    """Strings, lists of strings and parts, and tool calls."""
    parts = F.array(F.concat(F.lit('"a'), F.col("p_size").cast("string"), F.lit('"')), F.lit('{"text": "b"}'), F.lit('{"content": "c"}'), F.lit('{"image": 1}'), F.lit('""'))
    content = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))).otherwise(F.col("p_name"))
    calls = F.when(F.col("p_partkey") % 3 == 0, F.lit('{"name": "x"}'))
    return _part(spark, d).select("p_partkey", IO.content_text(content, calls).alias("text"))


def long_sessions(spark, d):
    return IO.long_enough(_sessions(spark, d), 65_536).select(F.col("session_id").cast("long").alias("session_id"))


def patched_sessions(spark, d):
    """Length cut, patch metadata and a recoverable set of files."""
    rows = IO.long_enough(_sessions(spark, d), 32_768)
    return IO.with_patch(rows).select(F.col("session_id").cast("long").alias("session_id"), IO.repo_of(F.col("ground_truth_meta_json")).alias("repo"))


def id_sets(spark, d):
    """Ids that only one of two derived corpora has."""
    rows = _part(spark, d).select(F.col("p_partkey").alias("session_id"))
    return IO.same_ids(rows.where("session_id % 10 <> 3"), rows.where("session_id % 15 <> 4"))


def _cells(spark, d, shift: int):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("position"), F.col("o_custkey").alias("history"), (F.col("o_custkey") % (10 + shift)).cast("double").alias("v"))


def paired_by_position(spark, d):
    return V.by_position(_cells(spark, d, 0), _cells(spark, d, 3), "history", "v")


def checked_join(spark, d):
    a, b = _cells(spark, d, 0), _cells(spark, d, 3).withColumnRenamed("v", "w")
    return V.checked(a.where("position % 2 = 0"), b, ["position"], "history").select("position", "history", "v", "w")


def citation_problems(spark, d):
    name = lambda cond: _part(spark, d).where(cond).select(F.col("p_name").alias("name"))
    return V.citations(name("p_partkey % 6 < 3"), name("p_partkey % 4 < 2"), name("p_partkey % 5 > 0"))


_ARM = "'{{\"f1\": ' || {f1} || CASE WHEN {has} THEN ', \"next_turn\": ' || {turn} ELSE '' END || '}}'"
_RAW = (
    "'{\"full\": ' || " + _ARM.format(f1="CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '0.5' END", has="p_partkey % 3 > 0", turn="'null'")
    + " || ', \"active\": ' || " + _ARM.format(f1="'1'", has="p_partkey % 7 > 0", turn="'3'") + " || '}'"
)


def scoreable_rows(spark, d):
    return V.scoreable(_part(spark, d).selectExpr("p_partkey", f"{_RAW} AS j"), "j").select("p_partkey")


def resumed_rows(spark, d):
    """What is left after an interrupted run, and the merged rows: earlier ones count before later ones."""
    rows = _part(spark, d).select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    done = rows.where("k % 3 = 0").withColumn("v", -F.col("v"))
    left = IO.resume(rows, done, ["k"]).where("k % 5 <> 0")
    return O.merged(done, left.unionByName(rows.where("k % 6 = 0")), ["k"])


def select_verbatim(spark, d):
    cut = cuts.verbatim_cut(F.col("text"), 6)
    return transcript(spark, d).select("p_partkey", cut.alias("c")).select("p_partkey", "c.cut", "c.verbatim")


def snippets(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select("doc_id", F.md5(cuts.snippet(F.col("text"), 0.25, ("the", "de")).cast("binary")).alias("snippet_md5"))


def suffixes(spark, d):
    """The longest ends of texts that count at most five tokens."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"], "suffix": [R.suffix_within(t, 5) for t in pdf["text"]]})

    return transcript(spark, d).select("p_partkey", "text").mapInPandas(run, "p_partkey long, suffix string")


_LINES = "list_transform(range(len(lines)), lambda i: {'i': i, 'x': lines[i + 1]})"
_KEEP = " OR ".join("regexp_matches(v.x, '" + rx.replace("'", "''") + "')" for rx in (X.DUMP, X.ERROR, X.CODE, X.PATH, X.NUMBER_OR_ID))
_ITEM = "{{'left': {left}, 'kept': {kept}, 'full': {full}, 'i': {i}, 'c': {c}, 'must': {must}, 'said': {said}}}"
_START = _ITEM.format(left="CAST(6 AS BIGINT)", kept="CAST([] AS BIGINT[])", full="false", i="CAST(-1 AS BIGINT)", c="CAST(0 AS BIGINT)", must="false", said="false")
_SKIP = _ITEM.format(left="CASE WHEN b.must AND b.c <= a.left THEN a.left - b.c ELSE a.left END", kept="CASE WHEN b.must AND b.c <= a.left THEN list_append(a.kept, b.i) ELSE a.kept END", full="false", i="a.i", c="a.c", must="a.must", said="a.said")
_OPEN = "(b.said AND NOT a.full AND NOT list_contains(a.kept, b.i))"
_FILL = _ITEM.format(
    left=f"CASE WHEN {_OPEN} AND b.c <= a.left THEN a.left - b.c ELSE a.left END",
    kept=f"CASE WHEN {_OPEN} AND b.c <= a.left THEN list_append(a.kept, b.i) ELSE a.kept END",
    full=f"a.full OR ({_OPEN} AND b.c > a.left)", i="a.i", c="a.c", must="a.must", said="a.said",
)

SQL = {
    "decoded_messages": _T + """
      SELECT p_partkey AS session_id, CAST(0 AS INTEGER) AS turn, 'tool' AS role, md5(text) AS text_md5
      FROM t
      WHERE NOT (p_partkey % 3 = 2 AND p_partkey % 5 = 0)""",
    "flattened_content": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' || CAST(p_size AS VARCHAR) || chr(10) || 'b' || chr(10) || 'c' ELSE p_name END || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || '{\"name\": \"x\"}' ELSE '' END AS text FROM part",
    "long_sessions": "SELECT p_partkey AS session_id FROM part WHERE p_partkey % 7 <> 0 AND p_size * 4000 >= 65536",
    "patched_sessions": _T + f"""
      SELECT p_partkey AS session_id, 'repo' || CAST(p_size % 5 AS VARCHAR) AS repo
      FROM t
      WHERE p_partkey % 7 <> 0 AND p_size * 4000 >= 32768 AND p_partkey % 11 <> 0 AND p_partkey % 4 <> 0 AND NOT (p_partkey % 3 = 2 AND p_partkey % 5 = 0) AND len({_FILES}) > 0""",
    "id_sets": """SELECT p_partkey AS session_id, CASE WHEN p_partkey % 10 <> 3 THEN 'left' ELSE 'right' END AS only
      FROM part
      WHERE (p_partkey % 10 = 3) <> (p_partkey % 15 = 4)""",
    "paired_by_position": "SELECT o_orderkey AS position, CAST(o_custkey % 10 AS DOUBLE) AS a, CAST(o_custkey % 13 AS DOUBLE) AS b FROM orders",
    "checked_join": """SELECT o_orderkey AS position, o_custkey AS history, CAST(o_custkey % 10 AS DOUBLE) AS v, CAST(o_custkey % 13 AS DOUBLE) AS w
      FROM orders
      WHERE o_orderkey % 2 = 0""",
    "citation_problems": """WITH c AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 6 < 3), t AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 4 < 2), p AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 5 > 0)
      SELECT name, 'absent' AS problem
        FROM (SELECT *
        FROM c EXCEPT
        SELECT *
        FROM p)
        UNION ALL
        SELECT name, 'not cited'
        FROM (SELECT *
        FROM t EXCEPT
        SELECT *
        FROM c)
        UNION ALL
        SELECT name, 'not tracked'
        FROM (SELECT *
        FROM c EXCEPT
        SELECT *
        FROM t)""",
    "scoreable_rows": "SELECT p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 > 0 AND p_partkey % 7 > 0",
    "resumed_rows": """SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN -p_size ELSE p_size END AS v
      FROM part
      WHERE p_partkey % 3 = 0 OR p_partkey % 5 <> 0""",
    "select_verbatim": _T + f""", l AS (SELECT p_partkey, text, lines, list_transform({_LINES}, lambda v: {_ITEM.format(left='CAST(0 AS BIGINT)', kept='CAST([] AS BIGINT[])', full='false', i='v.i', c=f"CAST(greatest(1, len(regexp_extract_all(v.x, '{X.TERM}'))) AS BIGINT)", must=f"(trim(v.x) <> '' AND ({_KEEP}))", said="trim(v.x) <> ''")}) AS it FROM t),
      a AS (SELECT *, list_reduce(it, lambda a, b: {_SKIP}, {_START}) AS f FROM l),
      b AS (SELECT *, list_sort(list_reduce(it, lambda a, b: {_FILL}, f).kept) AS k0 FROM a),
      c AS (SELECT *, CASE WHEN len(k0) > 0 THEN k0 ELSE range(least(len(it), 6)) END AS k, list_sum(list_transform(it, lambda v: v.c)) <= 6 AS fits FROM b)
      SELECT p_partkey, CASE WHEN fits THEN text ELSE array_to_string(list_transform(range(len(k)), lambda j: CASE WHEN j > 0 AND k[j + 1] <> k[j] + 1 THEN '... [compiled: unrelated lines omitted] ...' || chr(10) ELSE '' END || lines[k[j + 1] + 1]), chr(10))
        || CASE WHEN len(it) - 1 - k[-1] > 0 THEN chr(10) || '... [compiled: ' || CAST(len(it) - 1 - k[-1] AS VARCHAR) || ' trailing lines omitted] ...' ELSE '' END END AS cut,
        CASE WHEN fits THEN len(list_filter(it, lambda v: v.said AND NOT v.must)) = 0 ELSE len(list_filter(k, lambda j: NOT it[j + 1].must)) = 0 END AS verbatim FROM c""",
    "snippets": r"""WITH d AS (SELECT doc_id, text, regexp_split_to_array(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS l0 FROM documents WHERE text IS NOT NULL),
      l AS (SELECT *, CASE WHEN text = '' THEN [] ELSE l0 END AS lines FROM d),
      m AS (SELECT *, len(lines) AS n, CAST(greatest(1, floor(len(lines) * CAST(0.25 AS DOUBLE))) AS BIGINT) AS keep FROM l),
      u AS (SELECT doc_id, n, keep, unnest(range(n)) AS i, unnest(lines) AS x FROM m WHERE n > 3 AND keep < n),
      s AS (SELECT *, len(list_distinct(list_filter(list_transform(regexp_extract_all(x, '[A-Za-z0-9_./:-]+'), lambda q: lower(q)), lambda q: q IN ('the', 'de')))) / CAST(2 AS DOUBLE) + i * CAST(0.25 AS DOUBLE) / (n - 1) AS sc
        FROM u),
      b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sc DESC, i DESC) AS r FROM s),
      w AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(greatest(0, i - 2), least(n - 1, i + 2) + 1))))) AS wanted FROM b WHERE r <= keep GROUP BY doc_id),
      z AS (SELECT m.doc_id, lines, n, list_transform(wanted, lambda i: {'out': CAST([] AS VARCHAR[]), 'room': CAST(0 AS BIGINT), 'last': i, 'stop': false}) AS it, CAST(greatest(1, floor(length(text) * CAST(0.25 AS DOUBLE))) AS BIGINT) AS room
        FROM m JOIN w ON w.doc_id = m.doc_id),
      f AS (SELECT doc_id, list_reduce(it, lambda a, b: CASE WHEN a.stop THEN a
          WHEN a.last >= 0 AND length(lines[b.last + 1]) + 1 + CASE WHEN b.last <> a.last + 1 THEN 19 ELSE 0 END > a.room
            THEN {'out': CASE WHEN a.last < n - 1 THEN list_append(a.out, '... [truncated] ...') ELSE a.out END, 'room': a.room, 'last': a.last, 'stop': true}
          ELSE {'out': list_concat(a.out, CASE WHEN a.last >= 0 AND b.last <> a.last + 1 THEN ['... [truncated] ...', lines[b.last + 1]] ELSE [lines[b.last + 1]] END),
            'room': a.room - length(lines[b.last + 1]) - CASE WHEN a.last >= 0 THEN 1 ELSE 0 END - CASE WHEN a.last >= 0 AND b.last <> a.last + 1 THEN 19 ELSE 0 END, 'last': b.last, 'stop': false} END,
        {'out': CAST([] AS VARCHAR[]), 'room': room, 'last': CAST(-2 AS BIGINT), 'stop': false}) AS a FROM z)
      SELECT m.doc_id, md5(CASE WHEN f.doc_id IS NULL THEN m.text ELSE array_to_string(f.a.out, chr(10)) END) AS snippet_md5 FROM m LEFT JOIN f ON f.doc_id = m.doc_id""",
}
SQL["suffixes"] = _T + f""", c AS (SELECT p_partkey, text, unnest(range(length(text) + 1)) AS pos FROM t),
      m AS (SELECT p_partkey, min(pos) AS pos FROM c WHERE greatest(1, len(regexp_extract_all(substring(text, pos + 1), '{X.TERM}'))) <= 5 GROUP BY p_partkey)
      SELECT t.p_partkey, substring(text, pos + 1) AS suffix FROM t JOIN m ON m.p_partkey = t.p_partkey"""

QUERIES = {
    f.__name__: f
    for f in (
        decoded_messages, flattened_content, long_sessions, patched_sessions, id_sets, paired_by_position, checked_join, citation_problems, scoreable_rows,
        resumed_rows, select_verbatim, snippets, suffixes,
    )
}
