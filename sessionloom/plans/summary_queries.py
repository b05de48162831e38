"""Summaries of evaluation results, over rows that both engines derive from orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ladders
from ..operators import cost as C
from ..operators import summaries as S

_EXAMPLE = """
  o_orderkey AS id,
  CAST(floor(o_totalprice * 4) AS BIGINT) AS history,
  o_custkey % 16000 + 500 AS active,
  o_orderkey % 130 AS turns,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 97 AS DOUBLE) / 97 END AS full_nll,
  CAST(o_orderkey % 89 AS DOUBLE) / 89 AS active_nll,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 101 END AS full_acc,
  CAST(o_custkey % 103 AS DOUBLE) / 103 AS active_acc,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 11 AS DOUBLE) / 10 END AS full_f1,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 13 AS DOUBLE) / 12 END AS active_f1"""
_CELL = """
  CASE o_custkey % 4 WHEN 0 THEN 2048 WHEN 1 THEN 4096 WHEN 2 THEN 8192 ELSE 16384 END AS active_tokens,
  o_orderpriority AS regime,
  CASE WHEN o_orderkey % 19 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(o_custkey % 30 AS DOUBLE) / 10 END AS goodput_ratio,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 - 0.25 END AS p99_reduction,
  CASE WHEN o_orderstatus = 'F' THEN 'advance' ELSE 'kill' END AS decision"""
_RATES = """
  CASE o_custkey % 4 WHEN 0 THEN 'ephemeral' WHEN 1 THEN 'full_kv_move' WHEN 2 THEN 'sticky_saturated' ELSE 'strict_sticky' END AS policy,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS cold_0,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS DOUBLE) / 9 END AS cold_1,
  CASE WHEN o_orderkey % 5 < 4 THEN NULL ELSE CAST(o_custkey % 7 AS DOUBLE) / 7 END AS cold_2"""
_PAIRS = """
  l_returnflag AS receipt, l_partkey AS instance_id,
  CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_linenumber % 2 END AS a_full,
  CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE l_suppkey % 2 END AS a_active"""
_LOCAL = """
  l_returnflag AS grp,
  CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_discount END AS full_f1,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_tax END AS active_f1,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity / 50 END AS active_next_recall"""


def _read(spark, d, table, columns):
    return spark.read.parquet(f"{d}/{table}.parquet").selectExpr(*[c.strip() for c in _cut(columns)])


def _cut(columns: str) -> list[str]:
    """The select list's items: commas outside of brackets and of CASE ... END part them."""
    out, depth, item = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]


def _rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _examples(spark, d):
    return _read(spark, d, "orders", _EXAMPLE)


def quality_summary(spark, d):
    rows = _examples(spark, d).withColumn("bucket", ladders.lower_bucket(F.col("history"), ladders.QUALITY))
    return _rounded(S.quality_summary(rows, ["bucket"]))


def localisation_means(spark, d):
    return _rounded(S.localisation_means(_read(spark, d, "lineitem", _LOCAL), ["grp"]))


def _measured(spark, d):
    rows = _examples(spark, d).where("full_acc IS NOT NULL AND full_nll IS NOT NULL")
    return rows.select("history", "turns", "active", (F.col("active_acc") - F.col("full_acc")).alias("acc_delta"), (F.col("active_nll") - F.col("full_nll")).alias("nll_delta"))


def killer_fidelity(spark, d):
    return S.killer_table(_measured(spark, d), ladders.lower_bucket(F.col("history"), ladders.KILLER), 5, "fidelity")


def killer_by_turns(spark, d):
    return S.killer_table(_measured(spark, d), S.turns_bucket(F.col("turns")), 4, "fidelity")


def killer_end_task(spark, d):
    rows = _examples(spark, d).where("full_f1 IS NOT NULL AND active_f1 IS NOT NULL")
    return S.killer_table(rows, ladders.lower_bucket(F.col("history"), ladders.KILLER), 5, "end_task")


def killer_inversion(spark, d):
    return S.killer_inversion(_examples(spark, d).select("history", F.col("active").alias("compiled_state")))


def burst_sensitivity(spark, d):
    return _rounded(S.burst_sensitivity(_read(spark, d, "orders", _CELL)))


def long_age_cells(spark, d):
    return S.long_age_cells(_read(spark, d, "orders", _CELL))


def age_flatness(spark, d):
    return _rounded(S.age_flatness(_read(spark, d, "orders", _RATES), ["cold_0", "cold_1", "cold_2"]))


def quality_totals(spark, d):
    from .cost_queries import quality_join

    return S.quality_totals(quality_join(spark, d))


def pooled_pairing(spark, d):
    rows = S.pooled_differences(_read(spark, d, "lineitem", _PAIRS).withColumnsRenamed({"a_full": "full", "a_active": "active"}))
    sign = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("receipt").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 6).alias("mean"), sign(F.col("delta") > 0).alias("wins"), sign(F.col("delta") < 0).alias("losses"))


def composed_summary(spark, d):
    rows = _examples(spark, d).select(
        ladders.lower_bucket(F.col("history"), ladders.COMPOSED).alias("bucket"), F.col("id").alias("position"), "history", F.col("active").alias("tokens"), F.col("full_f1").alias("f1"), F.col("full_acc").alias("accuracy"), "active_acc"
    )
    # One bucket's reference has another history at some positions.
    moved = F.when((F.col("bucket") == 1) & (F.col("position") % 1000 == 1), F.col("history") + 1).otherwise(F.col("history"))
    reference = rows.select("bucket", "position", moved.alias("history"), F.col("active_acc").alias("accuracy"))
    return _rounded(S.composed_summary(rows.drop("active_acc"), reference))


def declared_regimes(spark, d):
    said = F.expr("CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' balanced, burst ,' ELSE p_brand END")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(S.declared_regimes(said), "|").alias("regimes"))


def load_costs(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    moves = spark.read.parquet(f"{d}/supplier.parquet").select(F.abs("s_acctbal").alias("gbps"))
    warm = nation.where("n_nationkey < 4").select(((F.col("n_nationkey") + 1) * 2048).alias("tokens"), (F.col("n_nationkey") * 0.1).alias("seconds"))
    full = nation.where("n_nationkey < 4").select(((F.col("n_nationkey") + 1) * 32768).alias("tokens"), F.expr("CASE WHEN n_nationkey = 3 THEN 'oom' ELSE 'measured' END").alias("status"), (F.col("n_nationkey") * 1.5).alias("seconds"))
    structural = nation.where("n_nationkey IN (1, 2)").select(F.col("n_nationkey").alias("bucket"), (F.col("n_nationkey") * 0.25).alias("lookup_ms"))
    return _rounded(S.load_costs(moves, warm, full, structural))


def receipts_union(spark, d):
    """Bag union of three receipts' cells, and the advances of each size over all of them."""
    cells = _read(spark, d, "orders", _CELL).select("active_tokens", "regime", "decision")
    parts = [cells.where(F.col("regime").startswith(str(i))) for i in (1, 2, 2)]
    return S.union_cells(*parts).groupBy("active_tokens").agg(F.count(F.lit(1)).alias("cells"), F.sum((F.col("decision") == "advance").cast("long")).alias("advance"))


def _table(name: str, columns: str, source: str = "orders") -> str:
    return f"{name} AS (SELECT {columns} FROM {source})"


def _lower(value: str, bounds: tuple) -> str:
    return " + ".join(f"CASE WHEN {value} >= {b} THEN 1 ELSE 0 END" for b in bounds)


def _step(value: str, ladder: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {k} THEN CAST({s} AS DOUBLE)" for k, s in ladder) + f" ELSE CAST({ladder[-1][1]} AS DOUBLE) END"


_EX = _table("ex", _EXAMPLE)
_MEASURED = "m AS (SELECT *, active_acc - full_acc AS acc_delta, active_nll - full_nll AS nll_delta FROM ex WHERE full_acc IS NOT NULL AND full_nll IS NOT NULL)"
_BARS = "c AS (SELECT *, goodput_ratio >= 1.5 AS good, coalesce(nullif(p99_reduction, 0), -9) >= 0.30 AS cut FROM cell)"


def _killer(source: str, bucket: str, buckets: int, figures: str) -> str:
    return f"""SELECT CAST(i.range AS INTEGER) AS bucket, count(g.history) AS n, CAST(floor(quantile_cont(g.history, 0.5)) AS BIGINT) AS raw_history_p50,
      CAST(floor(quantile_cont(g.active, 0.5)) AS BIGINT) AS compiled_state_p50, {figures}
      FROM range({buckets}) i LEFT JOIN (SELECT *, {bucket} AS bucket FROM {source}) g ON g.bucket = i.range GROUP BY i.range"""


_FIDELITY = "round(100 * quantile_cont(acc_delta, 0.5), 2) AS acc_delta_pp_p50, round(quantile_cont(nll_delta, 0.5), 3) AS nll_delta_p50"
_MEANS = "round(avg(active_f1 - full_f1), 3) AS paired_f1_mean, round(avg(full_f1), 3) AS full_f1_mean, round(avg(active_f1), 3) AS active_f1_mean"


def _sql() -> dict[str, str]:
    from .cost_queries import SQL as cost

    q = lambda c, p, name: f"round(quantile_cont({c}, {p}), 6) AS {name}"
    return {
        "quality_summary": f"""WITH {_EX}, v AS (SELECT {_lower('history', ladders.QUALITY)} AS bucket, active / CAST(greatest(1, history) AS DOUBLE) AS f, active_nll - full_nll AS n, active_acc - full_acc AS a FROM ex WHERE full_nll IS NOT NULL)
          SELECT bucket, count(*) AS examples, {q('f', 0.5, 'active_fraction_p50')}, {q('f', 0.95, 'active_fraction_p95')}, {q('n', 0.5, 'nll_delta_p50')},
          {q('n', 0.95, 'nll_delta_p95')}, {q('a', 0.5, 'accuracy_delta_p50')}, {q('a', 0.05, 'accuracy_delta_p05')} FROM v GROUP BY bucket""",
        "localisation_means": f"""WITH {_table('l', _LOCAL, 'lineitem')}
      SELECT grp, count(*) AS examples, round(avg(full_f1), 6) AS full_f1, round(avg(active_f1), 6) AS active_f1, round(avg(active_next_recall), 6) AS active_next_recall
      FROM l
      GROUP BY grp""",
        "killer_fidelity": f"WITH {_EX}, {_MEASURED} {_killer('m', _lower('history', ladders.KILLER), 5, _FIDELITY)}",
        "killer_by_turns": f"WITH {_EX}, {_MEASURED} {_killer('m', _lower('turns', ladders.TURNS), 4, _FIDELITY)}",
        "killer_end_task": f"""WITH {_EX},
      e AS (SELECT *
      FROM ex
      WHERE full_f1 IS NOT NULL AND active_f1 IS NOT NULL) {_killer('e', _lower('history', ladders.KILLER), 5, _MEANS)}""",
        "killer_inversion": f"""WITH {_EX}, s AS (SELECT history, active, {_step('history', C.LOOKUP_S)} AS l, {_step('active', C.ACTIVE_PREFILL_S)} AS p FROM ex)
          SELECT history, active AS compiled_state, round_even(l, 6) AS lookup_s, round_even(p, 4) AS prefill_s, round_even(history * CAST(12288 AS DOUBLE) / 23300000000, 4) AS move_full_kv_s, CAST(round(CAST(CAST(l + p AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE) AS mobility_s
            FROM s""",
        "burst_sensitivity": f"""WITH {_table('cell', _CELL)}, {_BARS} SELECT active_tokens, count(*) AS cells, count(*) FILTER (decision = 'advance') AS advance, count(*) FILTER (cut) AS clear_p99, count(*) FILTER (good) AS clear_goodput,
          round(min(p99_reduction), 6) AS p99_min, {q('p99_reduction', 0.5, 'p99_p50')}, round(max(p99_reduction), 6) AS p99_max FROM c GROUP BY active_tokens""",
        "long_age_cells": f"""WITH {_table('cell', _CELL)}, {_BARS}
      SELECT regime, count(*) AS cells, count(*) FILTER (decision = 'advance') AS advance, count(*) FILTER (cut) AS clear_p99
      FROM c
      GROUP BY regime""",
        "age_flatness": f"""WITH {_table('r', _RATES)}, y AS (SELECT policy, coalesce(cold_0, cold_1, cold_2) AS young, coalesce(cold_2, cold_1, cold_0) AS old FROM r)
          SELECT policy, {q('young', 0.5, 'youngest_p50')}, {q('old', 0.5, 'oldest_p50')}, round(quantile_cont(old / young, 0.5) FILTER (young <> 0), 6) AS ratio_p50
            FROM y
            WHERE young IS NOT NULL
            GROUP BY policy""",
        "quality_totals": f"""WITH j AS ({cost['quality_join']}) SELECT CAST(sum(advance) AS BIGINT) AS advancing, CAST(coalesce(sum(advance) FILTER (fidelity_ok), 0) AS BIGINT) AS fidelity,
          CAST(coalesce(sum(advance) FILTER (decision_ok), 0) AS BIGINT) AS decision, CAST(coalesce(sum(advance) FILTER (parity_ok), 0) AS BIGINT) AS parity,
          coalesce(string_agg(CAST(active_tokens AS VARCHAR), ',' ORDER BY active_tokens) FILTER (fidelity_pp IS NULL), '') AS sizes_without_points FROM j""",
        "pooled_pairing": f"""WITH {_table('l', _PAIRS, 'lineitem')}, b AS (SELECT receipt, instance_id, CAST(a_active - a_full AS DOUBLE) AS delta FROM l WHERE a_active IS NOT NULL AND a_full IS NOT NULL),
          u AS (SELECT receipt, delta FROM b UNION ALL SELECT 'POOLED', avg(delta) FROM b GROUP BY instance_id)
          SELECT receipt, count(*) AS n, round(avg(delta), 6) AS mean, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses FROM u GROUP BY receipt""",
        "composed_summary": f"""WITH {_EX}, b AS (SELECT {_lower('history', ladders.COMPOSED)} AS bucket, id, history, active, full_f1, 100 * (full_acc - active_acc) AS pp FROM ex),
          o AS (SELECT bucket, bool_or(bucket = 1 AND id % 1000 = 1) AS moved, avg(full_f1) AS f1_mean, count(full_f1) AS f1_n, quantile_cont(nullif(active, 0), 0.5) AS state_tokens_p50,
            count(pp) AS pairs, quantile_cont(pp, 0.5) AS p50, min(pp) AS lo, max(pp) AS hi FROM b GROUP BY bucket)
          SELECT bucket, round(f1_mean, 6) AS f1_mean, f1_n, round(state_tokens_p50, 6) AS state_tokens_p50, CASE WHEN moved THEN 0 ELSE pairs END AS pairs, CASE WHEN NOT moved THEN round(p50, 6) END AS pp_p50,
          CASE WHEN NOT moved THEN round(lo, 6) END AS pp_min, CASE WHEN NOT moved THEN round(hi, 6) END AS pp_max FROM o""",
        "declared_regimes": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'balanced|slow_worker|worker_failure' WHEN 1 THEN 'balanced|burst' ELSE p_brand END AS regimes
      FROM part""",
        "load_costs": """SELECT 'bandwidth_gbs' AS ladder, CAST(NULL AS BIGINT) AS tokens, round(quantile_cont(abs(s_acctbal), 0.5), 6) AS seconds FROM supplier
          UNION ALL SELECT 'active_prefill_s', (n_nationkey + 1) * 2048, round(n_nationkey * 0.1, 6) FROM nation WHERE n_nationkey < 4
          UNION ALL SELECT 'full_prefill_s', (n_nationkey + 1) * 32768, CASE WHEN n_nationkey < 3 THEN n_nationkey * 1.5 END FROM nation WHERE n_nationkey < 4
          UNION ALL SELECT * FROM (VALUES ('lookup_s', 8192, 0.000087), ('lookup_s', 32768, 0.00025), ('lookup_s', 131072, 0.0005), ('lookup_s', 1048576, 0.0004)) t(a, b, c)""",
        "receipts_union": f"""WITH {_table('cell', _CELL)},
      u AS (SELECT *
      FROM cell
      WHERE starts_with(regime, '1')
      UNION ALL
      SELECT *
      FROM cell
      WHERE starts_with(regime, '2')
      UNION ALL
      SELECT *
      FROM cell
      WHERE starts_with(regime, '2'))
      SELECT active_tokens, count(*) AS cells, count(*) FILTER (decision = 'advance') AS advance
      FROM u
      GROUP BY active_tokens""",
    }


SQL = _sql()
QUERIES = {
    f.__name__: f
    for f in (
        quality_summary, localisation_means, killer_fidelity, killer_by_turns, killer_end_task, killer_inversion, burst_sensitivity, long_age_cells,
        age_flatness, quality_totals, pooled_pairing, composed_summary, declared_regimes, load_costs, receipts_union,
    )
}
