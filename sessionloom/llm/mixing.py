"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected number of copies is its source's target over its source's size. Whole copies
are certain; what is left is a copy probability. Two fractional documents of a source meet, and
mass moves between them so that the sum of size times probability stays what it was and neither
expectation changes, until one of the two becomes whole. Documents meet first in blocks dealt by a
hash of the row, in order of size; each block leaves at most one fractional document a source, and
these meet in a reduction tree. The words a source gives therefore differ from its target by less
than one document.

The random choices are hashes of the rows and the seed: reruns agree, whatever the partitioning.
Rows are told apart by two 64-bit hashes of (doc_id, source, size) and an ordinal among equal ones.

Defined cases: a null text has size 0; a document of size 0 is taken 0 words (its copies: the whole
part of the expectation); a null source is a source of its own, last in order; rows that are
entirely equal are drawn separately; an empty table gives an empty result; a source whose
documents are all empty has target 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, few_rows, free_name

#: Documents that meet in one block, residuals that meet in one node of the tree.
BLOCK, FANOUT = 20_000, 64
#: Parts that rows of one (doc_id, source, size) are numbered in.
PARTS = 64
#: A probability within this of a whole number is whole.
EPS = 1e-12


def shared_targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Targets in proportion to the weights, none above cap times the source's size.

    What a capped source cannot take is shared again by weight among the others until none is above.
    """
    out, open_, left = {}, set(sizes), float(total)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if unit * weights[s] > cap * sizes[s]]
        if not over:
            out.update({s: unit * weights[s] for s in open_})
            break
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def cycled_weights(sources: list, cycle: tuple = (5, 2, 1)) -> dict:
    """Weights by the sources' code point order, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sources if s is None]
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def _draw(seed: int, a: int, b: int) -> float:
    return xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (seed, a, b)) / 2.0**64


def pivotal(keys: list[int], sizes: list[float], probs: list[float], seed: int) -> tuple[list[int], int | None, float]:
    """(whole outcomes by position, position of the one still fractional, its probability).

    Sequential pivotal steps in the given order. A step moves `d` words' worth of probability from
    one document to the other, up or down with chances that keep both expectations.
    """
    out, held, p = [0] * len(keys), None, 0.0
    for j, q in enumerate(probs):
        if q <= EPS or q >= 1 - EPS:
            out[j] = int(q > 0.5)
            continue
        if held is None:
            held, p = j, q
            continue
        si, sj = sizes[held], sizes[j]
        up = min(si * (1 - p), sj * q)  # words that can move to the held one
        down = min(si * p, sj * (1 - q))  # and away from it
        if _draw(seed, keys[held], keys[j]) * (up + down) < down:
            p, q = p + up / si, q - up / sj
        else:
            p, q = p - down / si, q + down / sj
        whole_i, whole_j = not EPS < p < 1 - EPS, not EPS < q < 1 - EPS
        if whole_i:
            out[held] = int(p > 0.5)
        if whole_j:
            out[j] = int(q > 0.5)
        if whole_i and whole_j:
            held, p = None, 0.0
        elif whole_i:
            held, p = j, q
    return out, held, p


def _node(seed: int, level: int):
    """The steps of one block or node; `held` rows are still fractional."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "size", "key", "key2", "ordinal"], kind="stable", na_position="last").reset_index(drop=True)
        outcome, p, held = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf)), np.zeros(len(pdf), dtype=bool)
        label = pdf["source_no"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, label[1:] != label[:-1], True]) if len(pdf) else np.array([0])
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[a:b]
            got, at, rest = pivotal(part["key"].tolist(), part["size"].astype(float).tolist(), part["p"].tolist(), seed + level)
            outcome[a:b] = got
            if at is not None:
                held[a + at], p[a + at] = True, rest
        return pdf.assign(extra=outcome, p=p, held=held)[_NODE_NAMES]

    return run


_NODE = "key long, key2 long, ordinal long, source string, source_no long, size long, p double, node long, extra long, held boolean"
_PLAN = pa.schema([("of", pa.string()), ("source_no", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("expected", pa.float64())])
_NODE_NAMES = [x.split()[0] for x in _NODE.split(", ")]


def _sizes(docs: DataFrame, text: str, source: str, doc_id: str) -> list[Column]:
    words = F.regexp_count(F.col(f"`{text}`"), F.lit(WORD))
    return [F.col(f"`{doc_id}`").cast("long"), F.col(f"`{source}`").cast("string"), F.coalesce(words, F.lit(0)).cast("long")]


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cycle: tuple = (5, 2, 1), share: float = 1.0, cap: float = 3.0, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, times and ordinal for every row of docs.

    `times` is how many rows have the same doc_id, source and size, `ordinal` (from 1) which of them this is.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(*[c.alias(n) for c, n in zip(_sizes(docs, text, source, doc_id), ("doc_id", "source", "size"))])
    # Rows that are equal in id, source and size are interchangeable: they are counted once and told apart by an ordinal.
    rows = scratch.keep(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    per = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("words"), F.sum("times").alias("rows")).collect()  # a row a source
    sizes, n_rows = {r["source"]: r["words"] for r in per}, sum(r["rows"] for r in per)
    targets = shared_targets(sizes, cycled_weights(list(sizes), cycle), share * sum(sizes.values()), cap) if sizes else {}
    numbered = {s: i for i, s in enumerate(cycled_weights(list(sizes)))}
    plan = [(s, numbered[s], int(sizes[s]), float(targets[s]), min(float(cap), targets[s] / sizes[s]) if sizes[s] else 0.0) for s in sizes]
    plan = few_rows(spark, _PLAN, plan)
    rows = rows.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")  # a row a source
    whole = F.floor(F.col("expected") + EPS)
    rows = rows.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - whole))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "source", "size")).withColumn("key2", F.xxhash64("size", "source", "doc_id", F.lit(seed)))
    blocks = max(1, math.ceil(n_rows / BLOCK))
    open_ = rows.where((F.col("p") > EPS) & (F.col("size") > 0))
    of_row, carried = ["key", "key2", "ordinal"], ["source", "source_no", "size", "p"]
    dealt = open_.select(*of_row, *carried, F.pmod(F.xxhash64(*of_row, F.lit(seed)), F.lit(blocks)).alias("node"))
    done, level, nodes = [], 0, blocks
    while True:
        step = scratch.keep(dealt.groupBy("node").applyInPandas(_node(seed, level), _NODE), f"level{level}")
        done.append(step.where("not held").select(*of_row, "extra"))
        if nodes == 1:
            # One fractional document a source is left: an independent draw ends it.
            drawn = F.pmod(F.xxhash64(*of_row, F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
            done.append(step.where("held").select(*of_row, F.when(drawn < F.col("p"), 1).otherwise(0).cast("long").alias("extra")))
            break
        nodes, level = math.ceil(nodes / FANOUT), level + 1
        dealt = step.where("held").select(*of_row, *carried, F.pmod(F.col("node"), F.lit(nodes)).alias("node"))
    drawn = done[0]
    for more in done[1:]:
        drawn = drawn.unionByName(more)
    out = rows.join(drawn, of_row, "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", taken, "times", "ordinal")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs' rows, each as often as the mix takes it; documents that it does not take go."""
    text, source, doc_id = (options.get(k, k) for k in ("text", "source", "doc_id"))
    scratch = Scratch(docs.sparkSession)
    picked = scratch.keep(mix(docs, **options).select("doc_id", "source", "size", "copies", "times", "ordinal"), "picked")
    names = [free_name(docs, k) for k in ("_i", "_s", "_w", "_ji", "_js", "_jw", "_c", "_o", "_p", "_r")]
    i, s, w, ji, js, jw, c, o, p, r = names
    own = docs.withColumns(dict(zip((i, s, w), _sizes(docs, text, source, doc_id))))
    renamed = {"doc_id": ji, "source": js, "size": jw, "copies": c}
    same = F.col(i).eqNullSafe(F.col(ji)) & F.col(s).eqNullSafe(F.col(js)) & (F.col(w) == F.col(jw))
    both = own.join(picked.where("times = 1").drop("times", "ordinal").withColumnsRenamed(renamed), same)
    groups = picked.where("times > 1 and ordinal = 1").select("doc_id", "source", "size").withColumnsRenamed(renamed)
    if not groups.isEmpty():
        # Rows of one (doc_id, source, size) are numbered in parts, so that no group is one task's.
        whole_row = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
        several = scratch.keep(own.join(groups, same, "left_semi").withColumn(p, F.pmod(whole_row, F.lit(PARTS))), "several")
        within = F.row_number().over(Window.partitionBy(i, s, w, p).orderBy(whole_row, F.col(f"`{text}`")))
        before = F.coalesce(F.sum(o).over(Window.partitionBy(i, s, w).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = several.groupBy(i, s, w, p).agg(F.count(F.lit(1)).alias(o)).withColumn(o, before)  # PARTS rows a group
        starts = starts.select(F.col(i).alias(ji), F.col(s).alias(js), F.col(w).alias(jw), F.col(p).alias(c), o)
        at = several.withColumn(r, within).join(starts, same & (F.col(p) == F.col(c))).withColumn(o, F.col(o) + F.col(r)).drop(ji, js, jw, c, r, p)
        copies = picked.where("times > 1").drop("times").withColumnsRenamed(renamed | {"ordinal": p})
        both = both.unionByName(at.join(copies, same & (F.col(o) == F.col(p))).drop(o, p))
    taken = both.where(F.col(c) > 0).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c))))
    return taken.select(*[F.col(f"`{x}`") for x in docs.columns])
