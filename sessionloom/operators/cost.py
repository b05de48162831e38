"""Closed-form cost models and ladders, as expressions and joins to small measured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Measured ladders (tokens -> seconds) and declared rates.
LOOKUP_S = ((8192, 0.000087), (32768, 0.00015), (131072, 0.000246), (1048576, 0.0004))
ACTIVE_PREFILL_S = ((2048, 0.053), (4096, 0.095), (8192, 0.203), (16384, 0.485))
FULL_PREFILL_S = ((32768, 1.59), (131072, 14.32), (524288, None))
KV_BYTES, BANDWIDTH_GBS = 12_288, 23.3
PREFILL_TOKENS_S, COMPILE_TOKENS_S, INDEX_TOKENS_S, DECODE_TOKENS_S = 4000.0, 20000.0, 200000.0, 45.0
POLICIES = ("keep_hbm", "keep_dram", "keep_nvme", "recompute_full", "recompile_active")


def ceiling(value: Column, ladder: tuple) -> Column:
    """The entry of the smallest key not below the value, the last entry beyond all."""
    rungs = sorted(ladder)
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for key, seconds in rungs:
        out = out.when(value <= key, F.lit(seconds).cast("double"))
    return out.otherwise(F.lit(rungs[-1][1]).cast("double"))


def floor_scaled(value: Column, ladder: tuple, short: str = "scale") -> Column:
    """The largest measured entry not above the value, scaled in proportion.

    Below all measured keys: scaled down from the smallest (`scale`), or null (`none`).
    """
    rungs = [x for x in sorted(ladder) if x[1] is not None]
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for key, seconds in reversed(rungs):
        out = out.when(value >= key, F.lit(float(seconds)) * (value / F.lit(float(key))))
    key, seconds = rungs[0]
    return out.otherwise(F.lit(float(seconds)) * (value / F.lit(float(key))) if short == "scale" else F.lit(None).cast("double"))


def resume(value: Column, ladder: tuple = FULL_PREFILL_S) -> Column:
    """Full prefill of a history after a model change: null at or beyond an infeasible length."""
    gone = [k for k, s in ladder if s is None]
    out = F.bround(floor_scaled(value, ladder, "none"), 3)
    return F.when(value < min(gone), out) if gone else out


def capacity(geometries: DataFrame, residents: DataFrame, hbm_gib: float = 20.0) -> DataFrame:
    """Sessions that fit on a worker for each geometry (name, kv) and resident (what, tokens)."""
    size = F.col("tokens") * F.col("kv")
    return geometries.crossJoin(residents).select("name", "what", "tokens", size.alias("bytes"), F.round(F.lit(hbm_gib * 2**30) / size, 1).alias("sessions_per_worker"))


def crossover_tokens(kv_bytes: Column, link_gbs: Column, active: Column, lookup_ms: float = 10.0, prefill: float = PREFILL_TOKENS_S) -> Column:
    """The history at which moving a full cache costs as much as rebuilding the active set."""
    return ((lookup_ms / 1000.0 + active / prefill) * link_gbs * 1e9 / kv_bytes).cast("long")


def route_costs(history: Column, working: Column, kv_bytes: float, link_gbs: float, lookup_ms: float = 10.0) -> dict[str, Column]:
    """Cold-route seconds and resident bytes by name."""
    return {
        "full_kv_transfer_s": history * kv_bytes / (link_gbs * 1e9),
        "full_reprefill_s": history / PREFILL_TOKENS_S,
        "ephemeral_s": lookup_ms / 1000.0 + working / PREFILL_TOKENS_S,
        "full_kv_bytes": (history * kv_bytes).cast("long"),
        "active_bytes": (working * kv_bytes).cast("long"),
    }


def accounting(rows: DataFrame, kv_bytes: int, pcie_gbs: float, decode_tokens: int = 128) -> DataFrame:
    """A row per input row (history, request, working) and policy: seconds and bytes moved."""
    decode = decode_tokens / DECODE_TOKENS_S
    covered = F.least("request", "working")
    transfer = 2 * F.col("history") * kv_bytes / (pcie_gbs * 1e9)
    p = F.col("policy")
    seconds = (
        F.when(p == "keep_hbm", F.lit(decode))
        .when(p.isin("keep_dram", "keep_nvme"), transfer + decode)
        .when(p == "recompute_full", F.col("history") / PREFILL_TOKENS_S + decode)
        .otherwise(F.col("history") / INDEX_TOKENS_S + covered / COMPILE_TOKENS_S + covered / PREFILL_TOKENS_S + decode)
    )
    spread = rows.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES))))
    moved = F.when(p.isin("keep_dram", "keep_nvme"), 2 * F.col("history") * kv_bytes).otherwise(0)
    return spread.withColumn("seconds", F.round(seconds, 4)).withColumn("bytes_moved", moved)


def crossover(costs: DataFrame, candidate: str = "recompile_active") -> DataFrame:
    """The smallest history at which the candidate is cheaper than each other policy, else null."""
    own = costs.where(F.col("policy") == candidate).select("history", F.col("seconds").alias("own"))
    other = costs.where(F.col("policy") != candidate)
    return other.join(own, "history").groupBy("policy").agg(F.min(F.when(F.col("own") < F.col("seconds"), F.col("history"))).alias("crossing"))


def growth(rows: DataFrame, values: list[str], by: str = "history") -> DataFrame:
    """Each value at the largest key over that at the smallest; null where the latter is zero."""
    return rows.agg(*[(F.max_by(v, by) / F.nullif(F.min_by(v, by), F.lit(0))).alias(f"{v}_growth") for v in [by, *values]])


def placement(sessions: DataFrame, kv_bytes: int = 131_072, budget_s: float = 1.0, digits: int = 4) -> DataFrame:
    """Sessions (session, ordinal, history, state) ranked by measured cost and by footprint.

    The ranks are over all sessions given, so both sorts are one task's: this is a report on a choice
    of sessions, of narrow rows. Ranks within groups are `metrics.ranked_by_cost`.
    """
    from .metrics import ranked_by_cost

    true = ceiling(F.col("history"), LOOKUP_S) + ceiling(F.col("state"), ACTIVE_PREFILL_S)
    foot = F.col("history") * kv_bytes / (BANDWIDTH_GBS * 1e9)
    out = sessions.withColumn("one", F.lit(1)).withColumn("true_cost_s", F.round(true, digits)).withColumn("footprint_s", F.round(foot, digits))
    out = out.withColumn("served_by_truth", F.round(budget_s / true, 1)).withColumn("served_by_footprint", F.round(budget_s / foot, 1))
    out = ranked_by_cost(out, "true_cost_s", "ordinal", ["one"]).withColumnRenamed("rank", "rank_by_truth")
    return ranked_by_cost(out, "footprint_s", "ordinal", ["one"]).withColumnRenamed("rank", "rank_by_footprint").drop("one")


def quality_join(phase: DataFrame, points: DataFrame, tolerance_pp: float, slack: float, full_f1: float, retrieval_f1: float) -> DataFrame:
    """Cells and advances by active size, joined to quality points; sizes without one are kept."""
    cells = phase.groupBy("active_tokens").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("decision") == "advance").cast("long")).alias("advance"))
    out = cells.join(points, "active_tokens", "left")
    return out.withColumn("fidelity_ok", F.col("fidelity_pp") >= -tolerance_pp).withColumn("decision_ok", F.col("decision_f1") > full_f1).withColumn("parity_ok", F.col("decision_f1") >= retrieval_f1 - slack)


def phase_counts(phase: DataFrame) -> DataFrame:
    """advance and cells by active size, by regime and size, and by scale, in one pass."""
    n = [F.sum((F.col("decision") == "advance").cast("long")).alias("advance"), F.count(F.lit(1)).alias("cells")]
    a, r, s = F.col("active_tokens"), F.col("regime"), F.col("scale")
    return phase.groupingSets([[a], [r, a], [s]], a, r, s).agg(*n)
