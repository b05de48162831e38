"""Discrete-event replay of routing policies over a cost table: one task per (regime, policy).

Placement is a sequential decision over one simulated fleet, so a cell runs inside one grouped
function; cells are independent of each other and spread over the cluster. `compat` keeps two
behaviours of published results: short histories cannot be prefilled, and a failed worker ends all
service. By default short histories cost in proportion and the remaining workers go on serving.
"""

from __future__ import annotations

import math
import random
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ladders import AGE
from .cost import ACTIVE_PREFILL_S, BANDWIDTH_GBS, FULL_PREFILL_S, KV_BYTES, LOOKUP_S

POLICIES = ("strict_sticky", "sticky_saturated", "full_kv_move", "full_reprefill", "ephemeral")
# Latency objective, service of a turn, and the queue that a saturated worker may have.
SLO_S, SERVICE_S, ESCAPE_S = 5.0, 0.6, 2.0


def arrivals(sessions: int, turns: int, seed: int = 0, choices: tuple = (32_768, 131_072, 262_144), active: int = 4096, bursty: bool = True, skew: float = 0.0, burst: tuple | None = None) -> list[tuple]:
    """(session, arrival, history, active) in order of arrival; burst: (at, window, share).

    A session's history starts at 2,048 and grows by 1.7 and 512 a turn up to its target.
    """
    rng, ordered, out = random.Random(seed), sorted(choices), []
    at, window, share = burst or (0.0, 0.0, 0.0)
    crowd = round(sessions * share)
    for s in range(sessions):
        target = rng.choices(ordered, weights=[(i + 1) ** -skew for i in range(len(ordered))])[0] if skew > 0 else rng.choice(choices)
        clock, history = rng.random() * 2.0, 2048
        if s < crowd:
            clock = at + rng.random() * max(window, 1e-6)
        for t in range(turns):
            out.append((s, clock, history, active))
            mean = 2.0 if s < crowd or not bursty else (0.4 if t % 2 == 0 else 6.0)
            clock += rng.expovariate(1 / mean)
            history = min(target, int(history * 1.7) + 512)
    return sorted(out, key=lambda x: x[1])


class Lru:
    """Keys in order of use, bounded."""

    def __init__(self, room: int):
        self.room, self.keys = room, OrderedDict()

    def touch(self, key) -> None:
        if self.room > 0:
            self.keys[key] = None
            self.keys.move_to_end(key)
            while len(self.keys) > self.room:
                self.keys.popitem(last=False)

    def __contains__(self, key) -> bool:
        return key in self.keys


def _prefill(history: int, compat: bool) -> float | None:
    measured = [(k, s) for k, s in FULL_PREFILL_S if s is not None]
    below = [x for x in measured if x[0] <= history]
    if not below and compat:
        return None
    k, s = below[-1] if below else measured[0]
    return s * history / k


def _rebuild(history: int, active: int) -> float:
    lookup = next((s for k, s in LOOKUP_S if history <= k), LOOKUP_S[-1][1])
    table = dict(ACTIVE_PREFILL_S)
    return lookup + table.get(active, table[max(table)] * active / max(table))


def replay(turns: list[tuple], policy: str, workers: int = 4, warm: int = 4, tier: int = 8, bandwidth: float = BANDWIDTH_GBS, slow: int | None = None, slow_speed: float = 0.35, fail_at: float | None = None, fail: int | None = None, compat: bool = False) -> list[tuple]:
    """(session, arrival, history, completion or None, cold or None) for each turn.

    Each turn goes to the worker with the least wait and service; strict_sticky never leaves a
    session's warm worker, sticky_saturated leaves it only when its queue is longer than ESCAPE_S.
    """
    fleet = {i: [0.0, Lru(warm), slow_speed if i == slow else 1.0] for i in range(workers)}
    shared, out = Lru(tier), []
    for session, arrival, history, active in turns:
        if fail_at is not None and fail is not None and arrival >= fail_at:
            fleet.pop(fail, None)
            if compat:
                continue
        if policy == "ephemeral":
            cold = _rebuild(history, active)
        elif policy != "full_reprefill" and session in shared and bandwidth > 0:
            cold = history * KV_BYTES / (bandwidth * 1e9)
        else:
            cold = _prefill(history, compat)
        homes = [i for i, w in fleet.items() if session in w[1]]
        queue = {i: max(w[0] - arrival, 0.0) for i, w in fleet.items()}
        stay = bool(homes) and (policy == "strict_sticky" or policy == "sticky_saturated" and queue[homes[0]] <= ESCAPE_S)
        best = None
        for i in homes[:1] if stay else fleet:
            tax = 0.0 if session in fleet[i][1] else cold
            if tax is not None:
                total = queue[i] + (tax + SERVICE_S) / fleet[i][2]
                if best is None or total < best[0]:
                    best = (total, i)
        if best is None:
            out.append((session, arrival, history, None, None))
            continue
        total, i = best
        was_cold = session not in fleet[i][1]
        fleet[i][0] = arrival + total
        if compat and stay and policy == "sticky_saturated":
            was_cold = None  # a turn that stays is no placement there: it counts in no cold rate
        else:
            fleet[i][1].touch(session)
            shared.touch(session)
        out.append((session, arrival, history, arrival + total, was_cold))
    return out


_CELL = "regime string, policy string, sessions int, turns int, seed int, skew double, burst_at double, burst_share double, slow int, fail_at double, fail int, compat boolean"
_TURN = "regime string, policy string, session int, arrival double, history long, completion double, cold boolean"


def cells(spark: SparkSession, sessions: int = 16, turns: int = 8, seed: int = 0, compat: bool = False) -> DataFrame:
    """The default regimes by every policy."""
    regimes = [("balanced", 0.0, None, 0.0, None, None, None), ("burst", 0.0, 4.0, 0.6, None, None, None), ("size_skew", 1.5, None, 0.0, None, None, None), ("slow_worker", 0.0, None, 0.0, 1, None, None), ("worker_failure", 0.0, None, 0.0, None, 6.0, 0)]
    rows = [(r, p, sessions, turns, seed, skew, at, share, slow, fail_at, fail, compat) for r, skew, at, share, slow, fail_at, fail in regimes for p in POLICIES]
    return spark.createDataFrame(rows, _CELL)


def simulate(grid: DataFrame) -> DataFrame:
    """Every turn of every cell, cells in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in pdf.itertuples(index=False):
            burst = None if pd.isna(c.burst_at) else (c.burst_at, 1.0, c.burst_share)
            turns = arrivals(c.sessions, c.turns, c.seed, skew=c.skew, burst=burst)
            none = lambda v, f: None if pd.isna(v) else f(v)
            out += [(c.regime, c.policy, *x) for x in replay(turns, c.policy, slow=none(c.slow, int), fail_at=none(c.fail_at, float), fail=none(c.fail, int), compat=bool(c.compat))]
        return pd.DataFrame(out, columns=[x.split()[0] for x in _TURN.split(", ")])

    return grid.groupBy("regime", "policy").applyInPandas(run, _TURN)


def summary(turns: DataFrame) -> DataFrame:
    """Served, unserved, nearest-rank latencies, goodput by served and by offered, cold rates by age."""
    from ..functions import ladders

    served = F.col("completion").isNotNull()
    late = F.collect_list(F.when(served, F.col("completion") - F.col("arrival")))
    on_time = F.sum(F.when(served & (F.col("completion") - F.col("arrival") <= SLO_S), 1).otherwise(0))
    age = ladders.lower_bucket(F.col("history"), AGE)
    by = turns.groupBy("regime", "policy").agg(
        F.sum(served.cast("long")).alias("requests"), F.sum((~served).cast("long")).alias("unserved"),
        *[F.round(ladders.nearest_rank(late, q), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)],
        (on_time / F.greatest(F.lit(1), F.sum(served.cast("long")))).alias("goodput"), (on_time / F.count(F.lit(1))).alias("goodput_offered"),
        F.sum(F.coalesce("cold", F.lit(False)).cast("long")).alias("migrations"),
        *[F.avg(F.when(age == i, F.col("cold").cast("double"))).alias(f"cold_{i}") for i in range(len(AGE) + 1)],
    )
    rates = [F.col(f"cold_{i}") for i in range(len(AGE) + 1)]
    young, old = F.coalesce(*rates), F.coalesce(*rates[::-1])
    return by.withColumn("cold_oldest_over_youngest", old / F.nullif(young, F.lit(0.0))).withColumn("cold_spread", F.greatest(*rates) - F.least(*rates))
