"""The canonical span table of ordered sessions, and windows over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def spans(turns: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """session, turn, role, text, span_id (dense append order), tokens, history (tokens before).

    Tokens are counted by X.token_estimate, or by the given Column of the turns (a pandas UDF of another counter, say).
    """
    counted = X.token_estimate(F.coalesce(F.col(text), F.lit(""))) if tokens is None else F.greatest(F.lit(1), tokens)
    rows = turns.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), counted.cast("long").alias("tokens"))
    w = Window.partitionBy("session").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("span_id", F.row_number().over(w) - 1).withColumn("history", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def asof_query(rows: DataFrame) -> DataFrame:
    """rows with `query`: the newest earlier user or tool text; an empty newest one is none."""
    before = Window.partitionBy("session").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("role").isin("user", "tool"), F.col("text")), ignorenulls=True).over(before)
    return rows.withColumn("query", F.nullif(F.trim(last), F.lit("")))


def spans_before(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(session, q_turn, before): how many spans a query's turn has before it, whether or not it is a span's turn.

    Spans are numbered from 0 in order, so the newest number tells; one window over both tables finds it.
    """
    marks = queries.select("session", F.col("q_turn").alias("turn"), F.lit(None).cast("int").alias("span_id")).distinct()
    both = rows.select("session", "turn", F.col("span_id").cast("int").alias("span_id")).unionByName(marks)
    earlier = Window.partitionBy("session").orderBy("turn", F.col("span_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counted = both.withColumn("before", F.coalesce(F.max("span_id").over(earlier) + 1, F.lit(0)).cast("long"))
    return counted.where("span_id IS NULL").select("session", F.col("turn").alias("q_turn"), "before")


def span_terms(rows: DataFrame) -> DataFrame:
    """A row per (session, span, distinct term)."""
    return rows.select("session", "turn", "span_id", F.explode(F.array_distinct(X.terms(F.col("text")))).alias("term"))


def document_frequency(rows: DataFrame, share: float = 0.10, least: int = 2) -> DataFrame:
    """(session, term, df, rare): rare where df <= max(least, int(share * spans))."""
    sizes = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    df = span_terms(rows).groupBy("session", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(sizes, "session").select("session", "term", "df", (F.col("df") <= F.greatest(F.lit(least), F.floor(F.col("n") * share))).alias("rare"))


def evenly_spread(rows: DataFrame, n: int, partition: list, order: list) -> DataFrame:
    """At most n rows a partition, evenly spaced in order; one row: the middle."""
    w = Window.partitionBy(*partition)
    ranked = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_m", F.count(F.lit(1)).over(w))
    if n == 1:
        picked = F.array(F.floor(F.col("_m") / 2).cast("long"))
    else:
        picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("_m") - 1) / F.lit(float(n - 1))).cast("long"))
    return ranked.where((F.col("_m") <= n) | F.array_contains(picked, F.col("_i").cast("long"))).drop("_i", "_m")


def latest_per_key(rows: DataFrame, key: Column) -> DataFrame:
    """(session, key, turn, text, superseded): the newest text of a key, and the turns before it."""
    keyed = rows.withColumn("key", key).where(F.col("key").isNotNull())
    by = keyed.groupBy("session", "key").agg(F.max_by("text", F.struct("turn", "span_id")).alias("text"), F.max("turn").alias("turn"), F.sort_array(F.collect_list("turn")).alias("turns"))
    return by.select("session", "key", "turn", "text", F.slice("turns", 1, F.greatest(F.lit(0), F.size("turns") - 1)).alias("superseded"))
