"""Examples for quality measurements: what a model would see before each assistant turn, by mode.

An assistant turn with enough spans before it asks with the newest user or tool text; its own text
is the target and is never looked at. Modes differ in the context that they build:

| mode | context |
|---|---|
| view | the compiled view of the query |
| recency | the newest spans that fit, skipping what does not |
| compact | a window of the newest spans, and a summary of what is older |
| consolidate | a generous view, consolidated, then cut to the budget |
| materialize | a generous view, replayed into file states and results |
| state_first | states and results of the whole log, then texts near the query |
| tail_state | a window of the newest spans, the rest of the budget for the compiled far field |
| action_window | the same, the window holding actions before other spans |
| tail_query | the newest span alone, the rest of the budget for the compiled far field |

Selection (lookup, windows, folds) is joins and windows. Only what depends on order inside a
selection (consolidation, replay, summaries) runs in Python: by row for a query's selected spans,
by session where the whole log is replayed, and then in one pass over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import actions as A
from . import pack as P
from . import replay as R
from . import spans as S

MODES = ("view", "recency", "compact", "consolidate", "materialize", "state_first", "tail_state", "action_window", "tail_query")
#: Share of the budget that a window gets, and that the newest span may take alone.
TAIL_SHARE, TAIL_CAP = 0.6, 0.5
#: Summaries: tokens, tokens of older text read, and spans that the older text grows by before a new one is made.
SUMMARY, SUMMARY_INPUT, SUMMARY_STRIDE, WINDOW_STEP = 1536, 8192, 8, 512
#: How much more than the budget a generous view holds.
GENEROUS = 2.0
_SPAN = "array<struct<turn:long,span_id:long,role:string,text:string,tokens:long>>"


def asked_turns(rows: DataFrame, least_spans: int = 8) -> DataFrame:
    """session, q_turn, query, target, history, turns: the assistant turns that examples are made of."""
    asked = S.asof_query(rows).where((F.col("role") == "assistant") & (F.trim("text") != "") & (F.col("span_id") >= least_spans) & F.col("query").isNotNull())
    return asked.select("session", F.col("turn").alias("q_turn"), "query", F.col("text").alias("target"), "history", F.col("span_id").cast("long").alias("turns"))


def _window(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(session, q_turn, used, tail): the kept spans in order, with their texts."""
    by = ["session", "q_turn"]
    each = kept.select(*by, F.explode("kept").alias("span_id")).join(rows.select("session", "span_id", "turn", "role", "text", "tokens"), ["session", "span_id"])
    spans = F.sort_array(F.collect_list(F.struct("turn", F.col("span_id").cast("long").alias("span_id"), "role", "text", "tokens"))).cast(_SPAN)
    return kept.select(*by, "used").join(each.groupBy(*by).agg(spans.alias("tail")), by, "left")


def _far(rows: DataFrame, queries: DataFrame, budget: int | str, options: dict) -> DataFrame:
    """(session, q_turn, far): the view's spans in order."""
    seen = P.view(rows, queries, budget, **options)
    spans = F.sort_array(F.collect_list(F.struct("place", F.struct("turn", F.col("span_id").cast("long").alias("span_id"), "role", "text", F.col("take").alias("tokens")).alias("s"))))
    return seen.groupBy("session", "q_turn").agg(F.transform(spans, lambda x: x["s"]).cast(_SPAN).alias("far"))


_ACTIVE = "session {kind}, q_turn long, active string, active_tokens long, summary_tokens long"


def _compiled(rows: DataFrame, compile_one: Callable) -> DataFrame:
    """Each row's context, from compile_one(query, far, tail, room, used)."""
    kind = dict(rows.dtypes)["session"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = []
            for r in pdf.itertuples(index=False):
                tuples = lambda a: [] if a is None else [(x["turn"], x["span_id"], x["role"], x["text"], x["tokens"]) for x in a]
                said.append(compile_one(r.query, tuples(r.far), tuples(r.tail), int(r.room), int(r.used)))
            yield pd.DataFrame({"session": pdf["session"], "q_turn": pdf["q_turn"], "active": said, "active_tokens": [R.count_tokens(x) for x in said], "summary_tokens": 0})

    return rows.select("session", "q_turn", "query", "far", "tail", "room", "used").mapInPandas(run, _ACTIVE.format(kind=kind))


def _units(far: list[tuple], budget: int, query: str, compiler: str, options: dict) -> list[R.Unit]:
    spans = [(t, i, text, tokens) for t, i, _, text, tokens in far]
    if compiler == "materialize":
        state = R.State()
        for t, _, text, tokens in sorted(spans):
            state.event(t, text, tokens)
        return R.fit(state.units(frozenset(R.terms_of(query))), budget)
    return R.compile_units(R.consolidate(spans, **options), budget)


def _plain(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """Contexts of spans as they are: picked has session, q_turn, tail (in order)."""
    text = F.array_join(F.transform(F.coalesce("tail", F.array().cast(_SPAN)), lambda x: F.concat(F.lit("<"), x["role"], F.lit(">\n"), x["text"], F.lit("\n"))), "")
    tokens = F.aggregate(F.coalesce("tail", F.array().cast(_SPAN)), F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return picked.select("session", "q_turn", text.alias("active"), tokens.alias("active_tokens"), F.lit(0).cast("long").alias("summary_tokens"))


def _by_session(rows: DataFrame, queries: DataFrame, one_pass: Callable) -> DataFrame:
    """Contexts from one pass over each session's spans: one_pass(spans, asked) yields (q_turn, active, summary tokens)."""
    kind = dict(rows.dtypes)["session"]
    asked = queries.select("session", F.col("q_turn").alias("turn"), "query")
    log = rows.select("session", "turn", "span_id", "role", "text", "tokens").join(asked, ["session", "turn"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "span_id"])
        spans = list(zip(pdf["turn"].tolist(), pdf["span_id"].tolist(), pdf["role"].tolist(), pdf["text"].tolist(), pdf["tokens"].tolist()))
        asks = {t: q for t, q in zip(pdf["turn"].tolist(), pdf["query"].tolist()) if isinstance(q, str)}
        out = [(pdf["session"].iloc[0], t, a, R.count_tokens(a), s) for t, a, s in one_pass(spans, asks)]
        return pd.DataFrame(out, columns=["session", "q_turn", "active", "active_tokens", "summary_tokens"])

    return log.groupBy("session").applyInPandas(run, _ACTIVE.format(kind=kind))


def _states(budget: int) -> Callable:
    def one_pass(spans: list[tuple], asks: dict) -> Iterator[tuple]:
        for at, (turn, *_) in enumerate(spans):
            if turn in asks:
                units = R.state_first([(t, i, text, tokens) for t, i, _, text, tokens in spans[:at]], asks[turn], budget)
                yield turn, R.render_units(units), 0

    return one_pass


def _compacting(budget: int, tail_budget: int, summarise: Callable[[str, int], str]) -> Callable:
    """A window, and a summary that is kept while neither the older spans nor the window change much."""

    def one_pass(spans: list[tuple], asks: dict) -> Iterator[tuple]:
        memo: dict[tuple[int, int], str] = {}
        for at, (turn, *_) in enumerate(spans):
            if turn not in asks:
                continue
            used, window, older = 0, [], []
            for s in reversed(spans[:at]):
                if used + s[4] <= tail_budget:
                    used += s[4]
                    window.append(s)
                else:
                    older.append(s)
            pieces, left = [], SUMMARY_INPUT
            for s in older:  # newest first; of the first that does not fit, its end
                piece = R.render_span(s[2], s[3])
                cost = R.count_tokens(piece)
                if cost > left:
                    if left > 0:
                        pieces.append(R.suffix_within(piece, left, marker=R.ELIDED))
                    break
                pieces.append(piece)
                left -= cost
            text, key, summary = "".join(reversed(pieces)), (len(older) // SUMMARY_STRIDE, used // WINDOW_STEP), ""
            if text.strip():
                if key not in memo:
                    memo[key] = (summarise(text, max(64, min(SUMMARY, budget - used))) or "").strip()
                summary = memo[key]
            head = f"<summary of earlier history>\n{summary}\n" if summary else ""
            yield turn, head + "".join(R.render_span(s[2], s[3]) for s in reversed(window)), R.count_tokens(summary) if summary else 0

    return one_pass


def head_summary(text: str, budget: int) -> str:
    """A summariser that needs no model: the executable lines, then prose, that fit the budget."""
    return R.select_verbatim(text, budget)[0]


def build_examples(
    rows: DataFrame,
    mode: str,
    budget: int,
    least_spans: int = 8,
    least_history: int = 0,
    tail_tokens: int | None = None,
    compiler: str = "consolidate",
    summarise: Callable[[str, int], str] = head_summary,
    view: dict | None = None,
    consolidation: dict | None = None,
) -> DataFrame:
    """session, q_turn, target, active, history, active_tokens, summary_tokens, turns: an example per asked turn.

    rows: spans. `compiler` is what the far field of the tail modes goes through: consolidate,
    materialize or raw. `view` and `consolidation` are options of `pack.view` and
    `replay.consolidate`. Turns with less than least_history tokens before them are left out.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    view, consolidation = view or {}, consolidation or {}
    asked, by = asked_turns(rows, least_spans), ["session", "q_turn"]
    tail_budget = tail_tokens or int(budget * TAIL_SHARE)
    nothing = F.lit(None).cast(_SPAN)
    if mode == "view":
        active = _plain(rows, _far(rows, asked, budget, view).withColumnRenamed("far", "tail"))
    elif mode == "recency":
        active = _plain(rows, _window(rows, P.skipping(rows, asked, budget, first_always=False)))
    elif mode == "compact":
        active = _by_session(rows, asked, _compacting(budget, tail_budget, summarise))
    elif mode == "state_first":
        active = _by_session(rows, asked, _states(budget))
    elif mode in ("consolidate", "materialize"):
        got = asked.join(_far(rows, asked, max(budget + 1, int(budget * GENEROUS)), view), by, "left").withColumns({"tail": nothing, "room": F.lit(budget), "used": F.lit(0)})
        active = _compiled(got, lambda q, far, tail, room, used: R.render_units(_units(far, room, q, mode, consolidation)))
    else:
        if mode == "tail_query":
            newest = P.newest(rows, asked, 1)
            kept = newest.select(*by, F.col("tokens").alias("used"), F.array("span_id").alias("kept"))
            limit = max(1, int(budget * TAIL_CAP))
            far_options = view | {"recent": 0, "span_share": 1.0}
        else:
            is_action = (F.col("role") == "assistant") & A.parse_action(F.col("text")).isNotNull() if mode == "action_window" else None
            kept = P.skipping(rows, asked, tail_budget, first=is_action)
            limit, far_options = budget, view | {"recent": 0}
        tail = _window(rows, kept).withColumn("used", F.least("used", F.lit(limit))).withColumn("room", F.greatest(F.lit(0), F.lit(budget) - F.col("used")).cast("long"))
        queries = asked.join(tail, by)
        got = queries.join(_far(rows, queries, "room", far_options), by, "left")

        def compile_one(query: str, far: list, tail_: list, room: int, used: int) -> str:
            mine = {s[1] for s in tail_}
            if len(tail_) == 1 and tail_[0][4] > limit:
                t, i, role, text, _ = tail_[0]
                tail_ = [(t, i, role, R.suffix_within(text, limit, marker=R.ELIDED), limit)]
            far = [s for s in far if s[1] not in mine]
            head = "".join(R.render_span(s[2], s[3]) for s in far) if compiler == "raw" else R.render_units(_units(far, room, query, compiler, consolidation))
            return head + "".join(R.render_span(s[2], s[3]) for s in tail_)

        active = _compiled(got, compile_one)
    out = asked.join(active, by, "left").where(F.col("history") >= least_history)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(*by, "target", F.coalesce("active", F.lit("")).alias("active"), "history", zero("active_tokens"), zero("summary_tokens"), "turns")
