"""Structured Streaming forms of the append-only index, of latest state per key and of state replay."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as X
from ..operators import replay as R


def postings(turns: DataFrame) -> DataFrame:
    """(session, turn, term, tokens) of a stream of turns; stateless, append mode."""
    t = F.coalesce("text", F.lit(""))
    return turns.select("session", "turn", X.token_estimate(t).alias("tokens"), F.explode(F.array_distinct(X.terms(t))).alias("term"))


_STATE = "turn long, text string, superseded array<long>"
_OUT = f"session string, key string, {_STATE}"


def latest(turns: DataFrame, key) -> DataFrame:
    """The newest text of each (session, key) and the turns that it replaced, in update mode.

    State is one row a key, so it grows with the keys and not with the events; the list of
    replaced turns is what the contract asks for and grows with a key's events.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, text, gone = state.get if state.exists else (None, None, [])
        gone = list(gone)
        for pdf in batches:
            for t, x in sorted(zip(pdf["turn"], pdf["text"])):
                if turn is None or t >= turn:
                    gone += [turn] if turn is not None else []
                    turn, text = int(t), x
                else:
                    gone.append(int(t))
        state.update((turn, text, sorted(gone)))
        yield pd.DataFrame([(str(group[0]), group[1], turn, text, sorted(gone))], columns=["session", "key", "turn", "text", "superseded"])

    keyed = turns.withColumn("key", key).where(F.col("key").isNotNull())
    return keyed.select(F.col("session").cast("string").alias("session"), "key", "turn", "text").groupBy("session", "key").applyInPandasWithState(step, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


_CHANGE = "session string, key string, turn long, text string, superseded array<long>"


def latest_changes(turns: DataFrame, key) -> DataFrame:
    """As `latest`, with only the turns that this batch replaced: state is one text a key, whatever its events."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, text = state.get if state.exists else (None, None)
        gone: list[int] = []
        for pdf in batches:
            for t, x in sorted(zip(pdf["turn"], pdf["text"])):
                if turn is None or t >= turn:
                    gone += [] if turn is None else [turn]
                    turn, text = int(t), x
                else:
                    gone.append(int(t))
        state.update((turn, text))
        yield pd.DataFrame([(str(group[0]), group[1], turn, text, sorted(gone))], columns=["session", "key", "turn", "text", "superseded"])

    keyed = turns.withColumn("key", key).where(F.col("key").isNotNull())
    rows = keyed.select(F.col("session").cast("string").alias("session"), "key", "turn", "text").groupBy("session", "key")
    return rows.applyInPandasWithState(step, _CHANGE, "turn long, text string", "update", GroupStateTimeout.NoTimeout)


def replayed(turns: DataFrame, budget: int = 1 << 40) -> DataFrame:
    """The state of each session that got events: its units after them, in update mode.

    turns: session, turn, span_id, text, tokens. A session's events are replayed in the order of the
    batches, and by turn within one; what is kept is the replay's own state (files, latest results,
    distinct other texts), not the events. A restart goes on from the checkpoint.
    """
    unit = f"session string, {R.UNIT.split(', ', 1)[1]}"
    names = [x.split()[0] for x in unit.split(", ")]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = R.State()
        if state.exists:
            own.load(state.get[0])
        events = [e for pdf in batches for e in zip(pdf["turn"], pdf["span_id"], pdf["text"], pdf["tokens"])]
        for turn, _, text, tokens in sorted(events):
            own.event(int(turn), text, int(tokens))
        state.update((own.dump(),))
        yield pd.DataFrame([u.row(str(group[0])) for u in R.fit(own.units(), budget)], columns=names)

    rows = turns.select(F.col("session").cast("string").alias("session"), "turn", "span_id", "text", "tokens").groupBy("session")
    return rows.applyInPandasWithState(step, unit, "state string", "update", GroupStateTimeout.NoTimeout)
