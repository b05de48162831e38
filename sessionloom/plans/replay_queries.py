"""Order-dependent operators over the derived transcript; SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import replay as R
from .text_queries import transcript


def _rows(spark, d):
    rows = transcript(spark, d)
    return rows.select("session", "turn", F.col("p_partkey").cast("int").alias("span_id"), "text", X.token_estimate(F.col("text")).cast("long").alias("tokens"))


def consolidate_units(spark, d):
    return R.consolidated(_rows(spark, d))


def compiled_units(spark, d):
    return R.consolidated(_rows(spark, d), budget=200, keep_earlier_verbatim=True)


def replay_state(spark, d):
    return R.materialised(_rows(spark, d))


def executable_state(spark, d):
    return R.materialised(_rows(spark, d), budget=150, query=frozenset({"mod_1.py"}))


def state_first_view(spark, d):
    return R.state_first_views(_rows(spark, d), "fix pkg/mod_1.py please", 150)


def _composed(spark, d):
    rows = _rows(spark, d).groupBy("session").agg(F.sum("tokens").alias("total_tokens"))
    rows = rows.select(F.col("session").alias("session_id"), F.concat(F.lit("r"), (F.col("session") % 5).cast("string")).alias("repo"), "total_tokens")
    return R.composed_sessions(rows, {"s": 600, "m": 1500, "l": 4000})


def compose_sessions(spark, d):
    said = _rows(spark, d).select(F.col("session").alias("session_id"), "turn", "text")
    out = R.composed_rows(_composed(spark, d), said)
    return out.withColumn("composed_from", F.array_join("composed_from", ",")).withColumn("target_files", F.array_join("target_files", ","))


QUERIES = {f.__name__: f for f in (consolidate_units, compiled_units, replay_state, executable_state, state_first_view, compose_sessions)}
SQL: dict = {}
