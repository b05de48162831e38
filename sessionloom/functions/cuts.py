"""Cuts of texts to a budget as Column expressions: folds over a text's lines, no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

# What stands for lines left out.
GAP = "... [compiled: unrelated lines omitted] ..."
TAIL_BEGIN, TAIL_END = "... [compiled: ", " trailing lines omitted] ..."
CUT = "... [truncated] ..."


def let(value: Column, use) -> Column:
    """use(value), with the value evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def verbatim_cut(text: Column, room: int) -> Column:
    """struct(cut, verbatim): a text within `room` tokens, prose first to go; gaps and a cut tail are marked.

    Executable lines that fit are kept in order, skipping those that do not; then prose is added in
    order up to the first line that overflows (an executable line passed over before can be it).
    """
    item = lambda x, i: F.struct(
        i.cast("int").alias("i"), x.alias("x"), X.must_stay_verbatim(x).alias("must"), (F.regexp_replace(x, f"[{X.BLANK}]+", "") != "").alias("said"), X.token_estimate(x).cast("int").alias("c")
    )
    none = F.array().cast("array<int>")

    def skip(acc: Column, v: Column) -> Column:
        fits = v["must"] & (v["c"] <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - v["c"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(acc["kept"], v["i"])).otherwise(acc["kept"]).alias("kept"), F.lit(False).alias("full"))

    def fill(acc: Column, v: Column) -> Column:
        open_ = v["said"] & ~acc["full"] & ~F.array_contains(acc["kept"], v["i"])
        fits = open_ & (v["c"] <= acc["left"])
        return F.struct(F.when(fits, acc["left"] - v["c"]).otherwise(acc["left"]).alias("left"), F.when(fits, F.array_append(acc["kept"], v["i"])).otherwise(acc["kept"]).alias("kept"), (acc["full"] | (open_ & ~fits)).alias("full"))

    def said(lines: Column) -> Column:
        first = F.aggregate(lines, F.struct(F.lit(room).alias("left"), none.alias("kept"), F.lit(False).alias("full")), skip)
        kept = let(first, lambda f: F.array_sort(F.aggregate(lines, f, fill)["kept"]))
        head = F.sequence(F.lit(0), F.least(F.size(lines), F.lit(max(1, room))) - 1)
        return let(let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(head)), lambda k: joined(lines, k))

    def joined(lines: Column, kept: Column) -> Column:
        line = lambda i: F.get(lines, i)
        pieces = F.transform(kept, lambda i, at: F.when((at > 0) & (i != F.get(kept, at - 1) + 1), F.concat(F.lit(GAP + "\n"), line(i)["x"])).otherwise(line(i)["x"]))
        missing = F.size(lines) - 1 - F.element_at(kept, -1)
        tail = F.when(missing > 0, F.concat(F.lit("\n" + TAIL_BEGIN), missing.cast("string"), F.lit(TAIL_END))).otherwise("")
        return F.struct(F.concat(F.array_join(pieces, "\n"), tail).alias("cut"), F.forall(kept, lambda i: line(i)["must"]).alias("verbatim"))

    def whole(lines: Column) -> Column:
        fits = F.aggregate(lines, F.lit(0), lambda a, v: a + v["c"]) <= room
        pure = F.forall(lines, lambda v: v["must"] | ~v["said"])
        return F.when(fits, F.struct(text.alias("cut"), pure.alias("verbatim"))).otherwise(said(lines))

    return let(F.transform(X.lines_of(text), item), whole)


def snippet(text: Column, share: float, query: tuple[str, ...], context: int = 2) -> Column:
    """The lines that a query needs of an oversized text, with context, inside a character budget.

    A line scores its part of the query's terms and a quarter of its relative position; the best
    lines and their neighbours are put out in order until the characters are spent.
    """
    asked, part = F.array(*[F.lit(q) for q in sorted(query)]), min(1.0, max(0.0, share))

    def of_lines(lines: Column) -> Column:
        n = F.size(lines)
        keep = F.greatest(F.lit(1), F.floor(n * max(0.02, part)).cast("int"))
        score = lambda x, i: F.size(F.array_intersect(asked, X.terms(x))) / F.lit(float(max(1, len(query)))) + i * 0.25 / (n - 1)
        best = F.slice(F.sort_array(F.transform(lines, lambda x, i: F.struct(score(x, i).alias("s"), i.cast("int").alias("i"))), asc=False), F.lit(1), keep)
        near = F.transform(best, lambda b: F.sequence(F.greatest(F.lit(0), b["i"] - context), F.least(n - 1, b["i"] + context)))
        wanted = F.array_sort(F.array_distinct(F.flatten(near)))
        return F.when((n <= 3) | (keep >= n), text).otherwise(let(wanted, lambda w: put(lines, w)))

    def put(lines: Column, wanted: Column) -> Column:
        room = F.greatest(F.lit(1), F.floor(F.length(text) * part).cast("int"))
        start = F.struct(F.array().cast("array<string>").alias("out"), room.alias("room"), F.lit(-2).alias("last"), F.lit(False).alias("full"))

        def step(acc: Column, i: Column) -> Column:
            line, begun = F.get(lines, i), acc["last"] >= 0
            jump = begun & (i != acc["last"] + 1)
            size = F.length(line) + begun.cast("int") + F.when(jump, F.lit(len(CUT))).otherwise(0)
            stop = begun & (size > acc["room"])
            more = F.when(jump, F.array(F.lit(CUT), line)).otherwise(F.array(line))
            end = F.when(acc["last"] < F.size(lines) - 1, F.array_append(acc["out"], F.lit(CUT))).otherwise(acc["out"])
            out = F.when(acc["full"], acc["out"]).when(stop, end).otherwise(F.concat(acc["out"], more))
            on = ~acc["full"] & ~stop
            return F.struct(out.alias("out"), F.when(on, acc["room"] - size).otherwise(acc["room"]).alias("room"), F.when(on, i).otherwise(acc["last"]).alias("last"), (acc["full"] | stop).alias("full"))

        return F.array_join(F.aggregate(wanted, start, step)["out"], "\n")

    return let(X.lines_of(text), of_lines)
