"""Summaries of evaluation results: one row per group from rows of examples, cells or receipts.

Each is one aggregation, so partial sums and percentile sketches' inputs are combined before the
shuffle. Groups that a summary must show although they have no rows are joined from a small list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ladders
from .cost import ACTIVE_PREFILL_S, BANDWIDTH_GBS, KV_BYTES, LOOKUP_S, ceiling

# What counts as clearing the gate.
GOODPUT_BAR, P99_BAR = 1.5, 0.30
DEFAULT_REGIMES = ("balanced", "slow_worker", "worker_failure")


def _median(c: Column | str) -> Column:
    return F.percentile(c, 0.5)


def quality_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Active fraction, loss and accuracy deltas of rows(history, active, full_nll, active_nll, full_acc, active_acc).

    Rows without a loss in both arms do not count; an accuracy that one arm lacks leaves only the accuracy out.
    """
    valid = rows.where(F.col("full_nll").isNotNull() & F.col("active_nll").isNotNull())
    fraction = F.col("active") / F.greatest(F.lit(1), F.col("history"))
    loss, accuracy = F.col("active_nll") - F.col("full_nll"), F.col("active_acc") - F.col("full_acc")
    return valid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"),
        _median(fraction).alias("active_fraction_p50"),
        F.percentile(fraction, 0.95).alias("active_fraction_p95"),
        _median(loss).alias("nll_delta_p50"),
        F.percentile(loss, 0.95).alias("nll_delta_p95"),
        _median(accuracy).alias("accuracy_delta_p50"),
        F.percentile(accuracy, 0.05).alias("accuracy_delta_p05"),
    )


def localisation_means(rows: DataFrame, by: list[str], arms: tuple = ("full", "active"), keys: tuple = ("precision", "recall", "f1")) -> DataFrame:
    """Means of each arm's measures, nulls left out, for columns <arm>_<key> and <arm>_next_<key>."""
    have = [f"{a}_{n}{k}" for a in arms for n in ("", "next_") for k in keys if f"{a}_{n}{k}" in rows.columns]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("examples"), *[F.avg(c).alias(c) for c in have])


def killer_table(rows: DataFrame, bucket: Column, buckets: int, kind: str) -> DataFrame:
    """A row for each bucket, empty ones too: medians cut to whole numbers, and the paired differences.

    `fidelity` reads acc_delta and nll_delta (medians), `end_task` full_f1 and active_f1 (means).
    """
    aggs = [F.count(F.lit(1)).alias("n"), _median("history").cast("long").alias("raw_history_p50"), _median("active").cast("long").alias("compiled_state_p50")]
    if kind == "fidelity":
        aggs += [F.round(100 * _median("acc_delta"), 2).alias("acc_delta_pp_p50"), F.round(_median("nll_delta"), 3).alias("nll_delta_p50")]
    else:
        mean = lambda c: F.round(F.sum(c) / F.count(F.lit(1)), 3)
        aggs += [mean(F.col("active_f1") - F.col("full_f1")).alias("paired_f1_mean"), mean(F.col("full_f1")).alias("full_f1_mean"), mean(F.col("active_f1")).alias("active_f1_mean")]
    have = rows.groupBy(bucket.alias("bucket")).agg(*aggs)
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(have, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def killer_inversion(pairs: DataFrame, prefill: tuple = ACTIVE_PREFILL_S, lookup: tuple = LOOKUP_S, kv_bytes: int = KV_BYTES, bandwidth: float = BANDWIDTH_GBS) -> DataFrame:
    """Seconds to move each (history, compiled_state): by lookup and prefill, and with the whole cache.

    Figures are rounded as the decimals that they print as.
    """
    near, again = ceiling(F.col("history"), lookup), ceiling(F.col("compiled_state"), prefill)
    return pairs.select(
        "history",
        "compiled_state",
        F.bround(near, 6).alias("lookup_s"),
        F.bround(again, 4).alias("prefill_s"),
        F.bround(F.col("history") * kv_bytes / (bandwidth * 1e9), 4).alias("move_full_kv_s"),
        F.bround(near + again, 4).alias("mobility_s"),
    )


def clears(rows: DataFrame) -> DataFrame:
    """rows(goodput_ratio, p99_reduction) with clears_goodput and clears_p99; an infinite ratio clears, an absent cut does not."""
    cut = F.coalesce(F.nullif("p99_reduction", F.lit(0.0)), F.lit(-9.0))
    return rows.withColumn("clears_goodput", F.coalesce(F.col("goodput_ratio") >= GOODPUT_BAR, F.lit(False))).withColumn("clears_p99", cut >= P99_BAR)


def burst_sensitivity(rows: DataFrame) -> DataFrame:
    """By active size: cells, advances, cells that clear each bar, least, median and largest cut in p99."""
    n = lambda c: F.sum(c.cast("long"))
    return clears(rows).groupBy("active_tokens").agg(
        F.count(F.lit(1)).alias("cells"),
        n(F.col("decision") == "advance").alias("advance"),
        n(F.col("clears_p99")).alias("clear_p99"),
        n(F.col("clears_goodput")).alias("clear_goodput"),
        F.min("p99_reduction").alias("p99_min"),
        _median("p99_reduction").alias("p99_p50"),
        F.max("p99_reduction").alias("p99_max"),
    )


def long_age_cells(rows: DataFrame) -> DataFrame:
    """By regime: cells, advances and cells that clear the bar on p99."""
    n = lambda c: F.sum(c.cast("long"))
    return clears(rows).groupBy("regime").agg(F.count(F.lit(1)).alias("cells"), n(F.col("decision") == "advance").alias("advance"), n(F.col("clears_p99")).alias("clear_p99"))


def age_flatness(rows: DataFrame, rates: list[str]) -> DataFrame:
    """By policy: median cold rate in the youngest and in the oldest age that a cell has, and their median ratio.

    `rates` are the columns of the ages, youngest first; cells without any rate do not count, and
    cells whose youngest rate is zero not in the ratio.
    """
    have = rows.withColumn("young", F.coalesce(*rates)).withColumn("old", F.coalesce(*rates[::-1])).where(F.col("young").isNotNull())
    return have.groupBy("policy").agg(_median("young").alias("youngest_p50"), _median("old").alias("oldest_p50"), _median(F.col("old") / F.nullif("young", F.lit(0.0))).alias("ratio_p50"))


def quality_totals(joined: DataFrame) -> DataFrame:
    """Of a quality join: advancing cells in all and under each condition, and the sizes without points."""
    under = lambda c: F.coalesce(F.sum(F.when(F.coalesce(F.col(c), F.lit(False)), F.col("advance"))), F.lit(0))
    bare = F.sort_array(F.collect_list(F.when(F.col("fidelity_pp").isNull(), F.col("active_tokens"))))
    return joined.agg(F.sum("advance").alias("advancing"), under("fidelity_ok").alias("fidelity"), under("decision_ok").alias("decision"), under("parity_ok").alias("parity"), F.array_join(bare.cast("array<string>"), ",").alias("sizes_without_points"))


def pooled_differences(rows: DataFrame, receipt: str = "receipt", instance: str = "instance_id") -> DataFrame:
    """(receipt, delta): active minus full of each receipt's rows, and, as receipt POOLED, one mean per instance.

    Rows that one arm lacks do not count. The interval of each comes from `bootstrap` over these rows.
    """
    both = rows.where(F.col("full").isNotNull() & F.col("active").isNotNull()).withColumn("delta", F.col("active").cast("double") - F.col("full").cast("double"))
    pooled = both.groupBy(instance).agg(F.avg("delta").alias("delta")).select(F.lit("POOLED").alias(receipt), "delta")
    return both.select(F.col(receipt).cast("string").alias(receipt), "delta").unionByName(pooled)


def composed_summary(state: DataFrame, reference: DataFrame, by: str = "bucket") -> DataFrame:
    """By bucket: mean F1, median state tokens, and the paired accuracy difference in points (median and range).

    state and reference: bucket, position, history, tokens, f1, accuracy. Rows are paired by position;
    a bucket whose histories differ anywhere, or whose arms have different numbers of rows, has no
    paired figures.
    """
    other = reference.select(by, "position", F.col("history").alias("_h"), F.col("accuracy").alias("_a"), F.lit(True).alias("_there"))
    both = state.withColumn("_here", F.lit(True)).join(other, [by, "position"], "full_outer")
    off = F.max((F.col("_here").isNull() | F.col("_there").isNull() | ~F.col("history").eqNullSafe(F.col("_h"))).cast("int"))
    points = 100 * (F.col("accuracy") - F.col("_a"))
    got = both.groupBy(by).agg(
        off.alias("_off"),
        F.avg("f1").alias("f1_mean"),
        F.count("f1").alias("f1_n"),
        _median(F.nullif("tokens", F.lit(0))).alias("state_tokens_p50"),
        F.count(points).alias("pairs"),
        _median(points).alias("pp_p50"),
        F.min(points).alias("pp_min"),
        F.max(points).alias("pp_max"),
    )
    fine = F.col("_off") == 0
    return got.select(by, "f1_mean", "f1_n", "state_tokens_p50", F.when(fine, F.col("pairs")).otherwise(0).alias("pairs"), *[F.when(fine, F.col(c)).alias(c) for c in ("pp_p50", "pp_min", "pp_max")])


def declared_regimes(declared: Column) -> Column:
    """The regimes that a receipt's configuration names, separated by commas; three by default."""
    named = F.filter(F.transform(F.split(declared, ","), lambda x: F.trim(x)), lambda x: x != "")
    default = F.array(*[F.lit(x) for x in DEFAULT_REGIMES])
    return F.when(F.coalesce(F.length(declared), F.lit(0)) > 0, named).otherwise(default)


def union_cells(*receipts: DataFrame) -> DataFrame:
    """The cells of several receipts, repeats kept, columns by name."""
    out = receipts[0]
    for more in receipts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def load_costs(moves: DataFrame, warm: DataFrame, full: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """(ladder, tokens, seconds): the measured ladders of a routing replay.

    moves(gbps) gives the link's median rate (ladder `bandwidth_gbs`); warm(tokens, seconds) the
    active prefill; full(tokens, status, seconds) the full prefill, null where it was not measured;
    structural(bucket, lookup_ms) replaces the declared lookup times of the buckets that it has.
    """
    spark = moves.sparkSession
    rows = lambda d, name: d.select(F.lit(name).alias("ladder"), F.col("tokens").cast("long").alias("tokens"), F.col("seconds").cast("double").alias("seconds"))
    declared = spark.createDataFrame([(k, s) for k, s in LOOKUP_S], "tokens long, declared double")
    if structural is None:
        lookup = declared.withColumnRenamed("declared", "seconds")
    else:
        own = structural.where("bucket IN (0, 1, 2)").select(F.element_at(F.array(*[F.lit(k).cast("long") for k, _ in LOOKUP_S[:3]]), F.col("bucket").cast("int") + 1).alias("tokens"), (F.col("lookup_ms") / 1000.0).alias("own"))
        lookup = declared.join(own, "tokens", "left").select("tokens", F.coalesce("own", "declared").alias("seconds"))
    measured = full.withColumn("seconds", F.when(F.col("status") == "measured", F.col("seconds")))
    rate = moves.agg(_median("gbps").alias("seconds")).withColumn("tokens", F.lit(None).cast("long"))
    return union_cells(rows(lookup, "lookup_s"), rows(warm, "active_prefill_s"), rows(measured, "full_prefill_s"), rows(rate, "bandwidth_gbs"))


def turns_bucket(turns: Column) -> Column:
    return ladders.lower_bucket(turns, ladders.TURNS)
