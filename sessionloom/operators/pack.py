"""Budgeted packing: prefix sums where a pack truncates, folds where it skips and goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import lookup as L
from .spans import spans_before


def truncating(candidates: DataFrame, budget: int, cap: int | None = None, by: tuple = ("session", "q_turn"), order: str = "rank") -> DataFrame:
    """Candidates that fit in rank order with `take` tokens; the one that overflows is cut.

    take_i = min(need_i, budget - what those before need), need_i = min(tokens_i, cap): an
    over-size candidate consumes all the room it is given, so a prefix sum says it all.
    """
    need = F.least(F.col("tokens"), F.lit(budget if cap is None else min(cap, budget)))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = candidates.withColumn("_need", need).withColumn("_before", F.coalesce(F.sum("_need").over(w), F.lit(0)))
    out = out.withColumn("take", F.least(F.col("_need"), F.lit(budget) - F.col("_before"))).where(F.col("take") > 0)
    return out.withColumn("cut", F.col("take") < F.col("tokens")).drop("_need", "_before")


def newest(rows: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """The n newest spans before each query, ranked from 1, newest first.

    Their numbers follow from how many there are before the query: a session's spans never meet each other.
    """
    back = spans_before(rows, queries).withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(n)))).where(F.col("rank") <= F.col("before"))
    numbers = back.select("session", "q_turn", "rank", (F.col("before") - F.col("rank")).cast("int").alias("span_id"))
    return numbers.join(rows.select("session", "span_id", "turn", "tokens"), ["session", "span_id"]).select("session", "q_turn", "span_id", "turn", "tokens", "rank")


def recency(rows: DataFrame, queries: DataFrame, n: int, budget: int) -> DataFrame:
    """The n newest spans before each query, newest first, within the budget; the last one is cut."""
    return truncating(newest(rows, queries, n), budget)


def without_repeats(candidates: DataFrame, by: tuple = ("session", "q_turn")) -> DataFrame:
    """One span per content: the newest, at the rank of the content's best-ranked span."""
    keyed = candidates.withColumn("_f", X.fingerprint(F.col("text")))
    one = keyed.groupBy(*by, "_f").agg(F.min("rank").alias("rank"), F.max_by(F.struct("span_id", "turn", "tokens"), F.struct("turn", "span_id")).alias("s"), F.count(F.lit(1)).alias("copies"))
    return one.select(*by, "rank", "s.*", "copies")


def skipping(rows: DataFrame, queries: DataFrame, budget: int, first_always: bool = True, first: Column | None = None) -> DataFrame:
    """Newest first, a span that does not fit is skipped and older ones still tried.

    With first_always the newest span is taken whatever its size. `first` marks spans (a boolean
    Column of rows) that are tried before all others but the newest. A session's sizes are gathered
    once, and each query folds over those before it, as an array expression.
    """
    marked = rows.withColumn("_first", F.lit(0) if first is None else F.coalesce(first, F.lit(False)).cast("int"))
    item = F.struct("_first", "turn", "span_id", "tokens")
    sizes = marked.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("span_id", item.alias("x")))).alias("all"))
    at = spans_before(rows, queries).where("before > 0").join(sizes, "session")
    prior = F.transform(F.slice("all", F.lit(1), F.col("before").cast("int")), lambda x: x["x"])
    at = at.select("session", "q_turn", prior.alias("a")).withColumn("newest", F.element_at("a", -1))
    # The newest comes first; without first_always it must fit like any other.
    head = F.filter(F.array("newest"), lambda x: F.lit(first_always) | (x["tokens"] <= budget))
    older = F.sort_array(F.slice("a", F.lit(1), F.size("a") - 1), asc=False)

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], x["span_id"])).otherwise(acc["kept"]).alias("kept"))

    begun = F.aggregate(head, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    start = F.struct(begun.alias("used"), F.transform(head, lambda x: x["span_id"]).cast("array<int>").alias("kept"))
    folded = at.select("session", "q_turn", F.aggregate(older, start, step).alias("r"))
    return folded.select("session", "q_turn", F.col("r.used").alias("used"), F.sort_array("r.kept").alias("kept"))


def view(rows: DataFrame, queries: DataFrame, budget: int | str, k: int = 64, recent: int = 0, recent_share: float = 0.5, span_share: float = 1.0, provenance: int = 0, dedup: bool = False) -> DataFrame:
    """The compiled view of each query: session, q_turn, place, span_id, turn, role, take, cut, text.

    In this order until the budget is spent: the `recent` newest spans, within their share of it;
    the k best-scored spans; up to `provenance` spans that share an identifier with the query or the
    three best. A span takes no more than span_share of the budget and is cut at its end where it
    overflows. With dedup, of equal texts the newest stands for all, at the place of the best. The
    view is returned in order of turns. Each channel is a prefix sum, so the whole is joins and
    windows on (session, q_turn). The budget is a number, or a column of the queries.
    """
    by = ["session", "q_turn"]
    whole = F.lit(budget) if isinstance(budget, int) else F.col("_budget")
    budgets = queries.select(*by) if isinstance(budget, int) else queries.select(*by, F.col(budget).cast("long").alias("_budget"))
    most = F.floor(whole * span_share).cast("long") if span_share < 1.0 else whole
    own = rows.select("session", "span_id", X.fingerprint(F.col("text")).alias("f")) if dedup else None
    order = Window.partitionBy(*by)
    hits = L.ranked(L.lookup(rows, queries), k)
    if dedup:
        best = F.min("rank").over(Window.partitionBy(*by, "f"))
        hits = hits.join(own, ["session", "span_id"]).withColumn("_r", best)
        hits = hits.withColumn("rank", F.row_number().over(order.orderBy("_r", F.desc("turn"), F.desc("span_id")))).drop("_r", "f")
    parts = [hits.withColumn("channel", F.lit(1))]
    late = kept = None
    before = lambda c, *o: F.coalesce(F.sum(c).over(order.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if recent > 0:
        late = newest(rows, queries, recent).join(budgets, by).withColumn("need", F.least("tokens", most))
        late = late.withColumn("take", F.least("need", F.floor(whole * recent_share).cast("long") - before("need", "rank"))).where("take > 0")
        kept = late
        if dedup:
            first = F.row_number().over(Window.partitionBy(*by, "f").orderBy("rank"))
            kept = late.join(own, ["session", "span_id"]).withColumn("_i", first).where("_i = 1").drop("_i")
    if provenance > 0:
        extra = L.provenance(rows, queries, hits, provenance, gone=None if late is None else late.select(*by, "span_id"))
        extra = extra.join(rows.select("session", "span_id", "turn", "tokens"), ["session", "span_id"])
        parts.append(extra.withColumnRenamed("extra", "rank").withColumn("channel", F.lit(2)))
    columns = [*by, "span_id", "turn", "tokens", "rank", "channel"]
    far = parts[0].select(*columns)
    for more in parts[1:]:
        far = far.unionByName(more.select(*columns))
    far, spent = far.join(budgets, by), F.lit(0)
    if late is not None:
        far = far.join(late.select(*by, "span_id"), [*by, "span_id"], "left_anti")
        far, spent = far.join(kept.groupBy(*by).agg(F.sum("take").alias("_spent")), by, "left"), F.coalesce("_spent", F.lit(0))
    if dedup:
        far = far.join(own, ["session", "span_id"])
        if late is not None:
            far = far.join(kept.select(*by, "f"), [*by, "f"], "left_anti")
        far = far.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "f").orderBy("channel", "rank"))).where("_i = 1")
    far = far.withColumn("need", F.least("tokens", most)).withColumn("room", whole - spent)
    far = far.withColumn("take", F.least("need", F.col("room") - before("need", "channel", "rank"))).where("take > 0")
    taken = far.select(*columns, "take")
    if late is not None:
        taken = taken.unionByName(kept.withColumn("channel", F.lit(0)).select(*columns, "take"))
    texts = taken.join(rows.select("session", "span_id", "role", "text"), ["session", "span_id"]).withColumn("cut", F.col("take") < F.col("tokens"))
    head = F.greatest(F.lit(1), F.floor(F.length("text") * (F.col("take") / F.col("tokens"))).cast("int"))
    place = F.row_number().over(order.orderBy("turn", "span_id", "channel", "rank"))
    said = F.when(F.col("cut"), F.substring(F.col("text"), F.lit(1), head)).otherwise(F.col("text"))
    return texts.select(*by, place.alias("place"), "span_id", "turn", "role", F.col("take").cast("long").alias("take"), "cut", said.alias("text"))


def rendered(view_rows: DataFrame, by: tuple = ("session", "q_turn")) -> DataFrame:
    """(session, q_turn, tokens, spans, active): a view's spans as one text, each under its role's tag, in order."""
    piece = F.struct("place", F.concat(F.lit("<"), F.col("role"), F.lit(">\n"), F.col("text"), F.lit("\n")).alias("t"))
    one = view_rows.groupBy(*by).agg(F.sum("take").alias("tokens"), F.count(F.lit(1)).alias("spans"), F.sort_array(F.collect_list(piece)).alias("p"))
    return one.select(*by, "tokens", "spans", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("active"))
