"""Rarity-weighted lookup over a session's earlier spans, as joins on (session, term)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .spans import span_terms, spans_before

#: Scores are rounded before they rank, so that the order of summation cannot decide.
DIGITS = 9


def lookup(rows: DataFrame, queries: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """A row per (query, earlier span that shares a term): session, q_turn, span_id, turn, tokens, score.

    `postings` (session, term, span_id, turn) of a saved index are read instead of cutting the texts again.
    queries: session, q_turn, query. A term's weight is one over the number of spans before the
    query that hold it, counted by a window over the same join: one exchange on (session, term).
    """
    asked = queries.select("session", "q_turn", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term"))
    found = span_terms(rows) if postings is None else postings
    hits = asked.join(found, ["session", "term"]).where(F.col("turn") < F.col("q_turn"))
    weight = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("session", "term", "q_turn"))
    scored = hits.withColumn("w", weight).groupBy("session", "q_turn", "span_id", "turn").agg(F.round(F.sum("w"), DIGITS).alias("score"), F.count(F.lit(1)).alias("shared"))
    return scored.join(rows.select("session", "span_id", "tokens"), ["session", "span_id"])


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties to the later turn, then span."""
    w = Window.partitionBy("session", "q_turn").orderBy(F.desc("score"), F.desc("turn"), F.desc("span_id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stats(rows: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """session, q_turn, query_terms, postings_visited, candidate_spans, total_spans."""
    n = queries.select("session", "q_turn", F.size(F.array_distinct(X.terms(F.col("query")))).cast("long").alias("query_terms"))
    seen = hits.groupBy("session", "q_turn").agg(F.sum("shared").alias("postings_visited"), F.count(F.lit(1)).alias("candidate_spans"))
    total = spans_before(rows, queries).withColumnRenamed("before", "total_spans")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return n.join(seen, ["session", "q_turn"], "left").join(total, ["session", "q_turn"], "left").select("session", "q_turn", "query_terms", zero("postings_visited"), zero("candidate_spans"), zero("total_spans"))


def provenance(rows: DataFrame, queries: DataFrame, top: DataFrame, n: int, per_term: int = 8, gone: DataFrame | None = None) -> DataFrame:
    """Spans that share an identifier with the query or with its three best hits.

    Seeds are terms of more than three characters of the query, and such terms with a slash or a
    dot of the three best; the first n by name count, each with its per_term oldest spans; spans
    already in `top` or in `gone` (session, q_turn, span_id) are left out, and the first n in (seed, span) order stay, repeats included.
    """
    own = queries.select("session", "q_turn", F.explode(F.array_distinct(X.terms(F.col("query")))).alias("term")).where(F.length("term") > 3)
    best = top.where("rank <= 3").select("session", "q_turn", "span_id").join(span_terms(rows).select("session", "span_id", "term"), ["session", "span_id"])
    best = best.where((F.length("term") > 3) & (F.col("term").contains("/") | F.col("term").contains("."))).select("session", "q_turn", "term")
    seeds = own.unionByName(best).distinct()
    seeds = seeds.withColumn("s", F.row_number().over(Window.partitionBy("session", "q_turn").orderBy("term"))).where(F.col("s") <= n)
    held = seeds.join(span_terms(rows), ["session", "term"]).where(F.col("turn") < F.col("q_turn"))
    held = held.withColumn("p", F.row_number().over(Window.partitionBy("session", "q_turn", "term").orderBy("span_id"))).where(F.col("p") <= per_term)
    fresh = held.join(top.select("session", "q_turn", "span_id"), ["session", "q_turn", "span_id"], "left_anti")
    if gone is not None:
        fresh = fresh.join(gone, ["session", "q_turn", "span_id"], "left_anti")
    order = Window.partitionBy("session", "q_turn").orderBy("term", "span_id")
    return fresh.withColumn("extra", F.row_number().over(order)).where(F.col("extra") <= n).select("session", "q_turn", "term", "span_id", "extra")
