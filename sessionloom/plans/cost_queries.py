"""Cost models, ladders, grids, joins of measured points, pairings, gates and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ladders
from ..operators import cost as C
from ..operators import metrics as M
from ..operators import routing as R

_POINTS = ((2048, "a", -3.0, 0.10), (4096, "a", -0.96, 0.165), (8192, "b", 0.0, 0.165))


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def capacity(spark, d):
    g = spark.createDataFrame([("small", 12_288), ("medium", 131_072), ("large", 327_680)], "name string, kv long")
    r = spark.createDataFrame([("history", 32_768), ("history", 131_072), ("history", 1_048_576), ("state", 4096), ("state", 8192), ("state", 16_384)], "what string, tokens long")
    return C.capacity(g, r)


def phase_grid(spark, d):
    axis = lambda name, values, kind: spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    grid = axis("kv_kib", (32, 64, 128, 256), "long").crossJoin(axis("link_gbs", (12.5, 25.0, 50.0, 100.0), "double")).crossJoin(axis("active", (2048, 4096, 8192), "long"))
    cross = C.crossover_tokens(F.col("kv_kib") * 1024, F.col("link_gbs"), F.col("active"))
    return grid.withColumn("crossover_tokens", cross).withColumn("wins_by_1m", cross <= 1_000_000)


def _histories(spark, d):
    return _orders(spark, d).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") * 4).cast("long").alias("history"), (F.col("o_custkey") % 16_000 + 500).alias("working"))


def route_costs(spark, d):
    costs = C.route_costs(F.col("history"), F.col("working"), 131_072.0, 25.0)
    return _histories(spark, d).select("id", *[F.round(v, 9).alias(k) if k.endswith("_s") else v.alias(k) for k, v in costs.items()])


def prefill_floor(spark, d):
    h = F.col("history")
    return _histories(spark, d).select(
        "id",
        F.round(C.floor_scaled(h, C.FULL_PREFILL_S), 9).alias("scaled"),
        F.round(C.floor_scaled(h, C.FULL_PREFILL_S, "none"), 9).alias("compat"),
        C.resume(h).isNull().alias("cannot_resume"),
        C.resume(h).alias("resume_s"),
        C.ceiling(h, C.LOOKUP_S).alias("lookup_s"),
        C.ceiling(F.col("working"), C.ACTIVE_PREFILL_S).alias("prefill_s"),
    )


def accounting_crossover(spark, d):
    rows = spark.range(1, 65).select((F.col("id") * 16_384).alias("history"), F.lit(2048).alias("request"), F.lit(8192).alias("working"))
    return C.crossover(C.accounting(rows, 131_072, 25.0))


def cost_growth(spark, d):
    rows = spark.createDataFrame([(32_768, 4096), (262_144, 4096), (1_048_576, 4096)], "history long, working long")
    costs = C.route_costs(F.col("history"), F.col("working"), 131_072.0, 25.0)
    out = C.growth(rows.select("history", *[v.alias(k) for k, v in costs.items()]), list(costs))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def placement_inversion(spark, d):
    s = spark.createDataFrame([("young big", 0, 32_768, 16_384), ("old small", 1, 1_048_576, 4096), ("old mid", 2, 1_048_576, 8192), ("mid", 3, 262_144, 8192)], "session string, ordinal int, history long, state long")
    return C.placement(s, digits=6)


def _phase(spark, d):
    size = F.element_at(F.array(*[F.lit(x) for x in (2048, 4096, 8192, 16_384)]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return _orders(spark, d).select(size.alias("active_tokens"), F.col("o_orderpriority").alias("regime"), F.when(F.col("o_totalprice") > 200_000, "long").otherwise("short").alias("scale"), F.when(F.col("o_orderstatus") == "F", "advance").otherwise("kill").alias("decision"))


def quality_join(spark, d):
    points = spark.createDataFrame(list(_POINTS), "active_tokens int, arm string, fidelity_pp double, decision_f1 double")
    return C.quality_join(_phase(spark, d), points, 1.0, 0.01, 0.089, 0.169)


def phase_grouping_sets(spark, d):
    return C.phase_counts(_phase(spark, d))


def paired_delta(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("instance_id"), (F.col("l_linenumber") * F.lit(1e7) + F.col("l_extendedprice")).alias("position"), F.col("l_discount").alias("f1"), "l_returnflag")
    left, right = rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'")
    return M.paired(left, right).select("instance_id", "a", "b", F.round("delta", 6).alias("delta"))


def cost_rank(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_partkey", "p_size")
    return M.ranked_by_cost(rows, "p_size", "p_partkey", ["p_brand"])


def verdict(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("l_discount") - 0.05), 6).alias("delta"), F.round(F.avg("l_tax"), 6).alias("fraction"))
    return M.verdict(rows.withColumnRenamed("l_linenumber", "bucket"))


def gate(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("ephemeral", "full_kv_move", "sticky_saturated", "strict_sticky")]), (F.col("o_custkey") % 4 + 1).cast("int"))
    by = _orders(spark, d).select(F.col("o_orderpriority").alias("regime"), name.alias("policy"), (F.col("o_orderstatus") == "F").cast("double").alias("g"), "o_totalprice")
    rows = by.groupBy("regime", "policy").agg(F.round(F.avg("g"), 6).alias("goodput"), F.round(F.max("o_totalprice"), 2).alias("p99"))
    return M.gate(rows).select("regime", "baseline", F.round("ratio", 6).alias("ratio"), F.round("p99_cut", 6).alias("p99_cut"), "verdict")


def nearest_rank_percentiles(spark, d):
    return M.latency_stats(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], "value")


def routing_replay(spark, d):
    return R.summary(R.simulate(R.cells(spark)))


def routing_replay_compat(spark, d):
    return R.summary(R.simulate(R.cells(spark, compat=True)))


def routing_gate(spark, d):
    s = R.summary(R.simulate(R.cells(spark)))
    return M.gate(s)


def bootstrap_ci(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return M.bootstrap_counts(rows.select("l_returnflag", (F.col("l_discount") - 0.05).alias("delta")), ["l_returnflag"])


def _step(value: str, ladder: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {k} THEN {s}" for k, s in ladder) + f" ELSE {ladder[-1][1]} END"


_H = "h AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 4) AS BIGINT) AS history, o_custkey % 16000 + 500 AS working FROM orders)"
_FLOOR = "CASE WHEN history >= 131072 THEN 14.32 * (history / 131072.0) WHEN history >= 32768 THEN 1.59 * (history / 32768.0)"
_DEC = "128 / 45.0"
_PH = "ph AS (SELECT [2048, 4096, 8192, 16384][o_custkey % 4 + 1] AS active_tokens, o_orderpriority AS regime, CASE WHEN o_totalprice > 200000 THEN 'long' ELSE 'short' END AS scale, CASE WHEN o_orderstatus = 'F' THEN 'advance' ELSE 'kill' END AS decision FROM orders)"
_RC = "history * CAST(131072.0 AS DOUBLE) / 25e9 AS full_kv_transfer_s, history / CAST(4000 AS DOUBLE) AS full_reprefill_s, CAST(0.01 AS DOUBLE) + working / CAST(4000 AS DOUBLE) AS ephemeral_s, history * CAST(131072 AS BIGINT) AS full_kv_bytes, working * CAST(131072 AS BIGINT) AS active_bytes"

SQL = {
    "capacity": """SELECT name, what, tokens, CAST(tokens AS BIGINT) * kv AS bytes, round(CAST(20 AS DOUBLE) * 1073741824 / (CAST(tokens AS BIGINT) * kv), 1) AS sessions_per_worker
      FROM (VALUES ('small', 12288), ('medium', 131072), ('large', 327680)) g(name, kv), (VALUES ('history', 32768), ('history', 131072), ('history', 1048576), ('state', 4096), ('state', 8192), ('state', 16384)) r(what, tokens)""",
    "phase_grid": """SELECT kv_kib, link_gbs, active, CAST(trunc((CAST(0.01 AS DOUBLE) + active / CAST(4000 AS DOUBLE)) * link_gbs * 1e9 / (kv_kib * 1024)) AS BIGINT) AS crossover_tokens, trunc((CAST(0.01 AS DOUBLE) + active / CAST(4000 AS DOUBLE)) * link_gbs * 1e9 / (kv_kib * 1024)) <= 1000000 AS wins_by_1m
      FROM (VALUES (32), (64), (128), (256)) a(kv_kib), (VALUES (CAST(12.5 AS DOUBLE)), (25), (50), (100)) b(link_gbs), (VALUES (2048), (4096), (8192)) c(active)""",
    "route_costs": f"""WITH {_H},
      r AS (SELECT id, {_RC}
      FROM h)
      SELECT id, round(full_kv_transfer_s, 9) AS full_kv_transfer_s, round(full_reprefill_s, 9) AS full_reprefill_s, round(ephemeral_s, 9) AS ephemeral_s, full_kv_bytes, active_bytes
      FROM r""",
    "prefill_floor": f"""WITH {_H}
      SELECT id, round({_FLOOR} ELSE 1.59 * (history / 32768.0) END, 9) AS scaled, round({_FLOOR} END, 9) AS compat, history < 32768 OR history >= 524288 AS cannot_resume, CASE WHEN history < 524288 THEN round_even({_FLOOR} END, 3) END AS resume_s, {_step('history', C.LOOKUP_S)} AS lookup_s, {_step('working', C.ACTIVE_PREFILL_S)} AS prefill_s
      FROM h""",
    "accounting_crossover": f"""WITH r AS (SELECT range * 16384 AS history
      FROM range(1, 65)),
      c AS (SELECT history, round({_DEC}, 4) AS keep_hbm, round(2 * history * 131072 / 25e9 + {_DEC}, 4) AS keep_dram, round(2 * history * 131072 / 25e9 + {_DEC}, 4) AS keep_nvme, round(history / 4000.0 + {_DEC}, 4) AS recompute_full, round(history / 200000.0 + 2048 / 20000.0 + 2048 / 4000.0 + {_DEC}, 4) AS own
      FROM r),
      u AS (UNPIVOT c ON keep_hbm, keep_dram, keep_nvme, recompute_full INTO NAME policy VALUE seconds)
      SELECT policy, min(CASE WHEN own < seconds THEN history END) AS crossing
      FROM u
      GROUP BY policy""",
    "cost_growth": f"WITH v AS (SELECT * FROM (VALUES (32768, 4096), (262144, 4096), (1048576, 4096)) t(history, working)), r AS (SELECT history, {_RC} FROM v) SELECT " + ", ".join(f"round(arg_max({c}, history) / CAST(arg_min({c}, history) AS DOUBLE), 6) AS {c}_growth" for c in ("history", "full_kv_transfer_s", "full_reprefill_s", "ephemeral_s", "full_kv_bytes", "active_bytes")) + " FROM r",
    "placement_inversion": f"""WITH s AS (SELECT *
      FROM (VALUES ('young big', 0, 32768, 16384), ('old small', 1, 1048576, 4096), ('old mid', 2, 1048576, 8192), ('mid', 3, 262144, 8192)) t(session, ordinal, history, state)),
      c AS (SELECT *, CAST({_step('history', C.LOOKUP_S)} AS DOUBLE) + {_step('state', C.ACTIVE_PREFILL_S)} AS t, history * CAST(131072 AS BIGINT) / (CAST(23.3 AS DOUBLE) * 1e9) AS f
      FROM s),
      r AS (SELECT session, ordinal, history, state, round(t, 6) AS true_cost_s, round(f, 6) AS footprint_s, round(1 / t, 1) AS served_by_truth, round(1 / f, 1) AS served_by_footprint
      FROM c)
      SELECT *, row_number() OVER (ORDER BY true_cost_s, ordinal) - 1 AS rank_by_truth, row_number() OVER (ORDER BY footprint_s, ordinal) - 1 AS rank_by_footprint
      FROM r""",
    "quality_join": f"""WITH {_PH},
      c AS (SELECT active_tokens, count(*) AS cells, count(*) FILTER (decision = 'advance') AS advance
      FROM ph
      GROUP BY 1),
      p AS (SELECT *
      FROM (VALUES (2048, 'a', -3.0, 0.10), (4096, 'a', -0.96, 0.165), (8192, 'b', 0.0, 0.165)) t(active_tokens, arm, fidelity_pp, decision_f1))
      SELECT active_tokens, cells, advance, arm, CAST(fidelity_pp AS DOUBLE) AS fidelity_pp, CAST(decision_f1 AS DOUBLE) AS decision_f1, fidelity_pp >= -1.0 AS fidelity_ok, decision_f1 > 0.089 AS decision_ok, decision_f1 >= 0.159 AS parity_ok
      FROM c LEFT JOIN p USING (active_tokens)""",
    "phase_grouping_sets": f"""WITH {_PH}
      SELECT active_tokens, regime, scale, count(*) FILTER (decision = 'advance') AS advance, count(*) AS cells
      FROM ph
      GROUP BY GROUPING SETS ((active_tokens), (regime, active_tokens), (scale))""",
    "paired_delta": """WITH l AS (SELECT l_orderkey AS instance_id, arg_max(l_discount, l_linenumber * CAST(1e7 AS DOUBLE) + l_extendedprice) AS a
      FROM lineitem
      WHERE l_returnflag = 'R'
      GROUP BY 1),
      r AS (SELECT l_orderkey AS instance_id, arg_max(l_discount, l_linenumber * CAST(1e7 AS DOUBLE) + l_extendedprice) AS b
      FROM lineitem
      WHERE l_returnflag = 'N'
      GROUP BY 1)
      SELECT instance_id, a, b, round(b - a, 6) AS delta
      FROM l JOIN r USING (instance_id)""",
    "cost_rank": "SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS rank FROM part",
    "verdict": """WITH b AS (SELECT l_linenumber AS bucket, count(*) AS n, round(avg(l_discount - 0.05), 6) AS delta, round(avg(l_tax), 6) AS fraction
      FROM lineitem
      GROUP BY 1
      HAVING count(*) >= 8),
      v AS (SELECT count(*) AS readable, min(delta) AS w, arg_min(fraction, bucket) AS f, arg_max(fraction, bucket) AS l
      FROM b)
      SELECT readable, CASE WHEN readable < 2 THEN 'inconclusive' WHEN w >= -0.02 AND l <= f + 1e-9 THEN 'advance' ELSE 'kill' END AS verdict
      FROM v""",
    "gate": """WITH p AS (SELECT o_orderpriority AS regime, ['ephemeral', 'full_kv_move', 'sticky_saturated', 'strict_sticky'][o_custkey % 4 + 1] AS policy, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS goodput, round(max(o_totalprice), 2) AS p99
      FROM orders
      GROUP BY 1, 2),
      b AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY goodput DESC, policy) AS n
      FROM p
      WHERE policy <> 'ephemeral'),
      j AS (SELECT e.regime, b.policy AS baseline, CASE WHEN b.goodput > 0 THEN e.goodput / b.goodput WHEN e.goodput > 0 THEN CAST('inf' AS DOUBLE) END AS ratio, CASE WHEN b.p99 > 0 THEN 1 - e.p99 / b.p99 END AS cut
      FROM p e JOIN b ON b.regime = e.regime AND b.n = 1
      WHERE e.policy = 'ephemeral')
      SELECT regime, baseline, round(ratio, 6) AS ratio, round(cut, 6) AS p99_cut, CASE WHEN coalesce(ratio, 0) >= 1.5 OR coalesce(cut, 0) >= 0.3 THEN 'advance' ELSE 'kill' END AS verdict
      FROM j""",
    "nearest_rank_percentiles": "WITH l AS (SELECT event_type, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v, count(*) AS n, min(value) AS least FROM events GROUP BY 1) SELECT event_type, n, " + ", ".join(f"v[least(len(v), CAST(floor(len(v) * {q}) AS BIGINT) + 1)] AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + ", v[greatest(1, CAST(floor(len(v) * 0.95) AS BIGINT))] AS p95_truncated, least FROM l",
}
QUERIES = {
    f.__name__: f
    for f in (
        capacity, phase_grid, route_costs, prefill_floor, accounting_crossover, cost_growth, placement_inversion, quality_join, phase_grouping_sets,
        paired_delta, cost_rank, verdict, gate, nearest_rank_percentiles, routing_replay, routing_replay_compat, routing_gate, bootstrap_ci,
    )
}
