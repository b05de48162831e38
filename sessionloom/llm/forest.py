"""Nearest neighbours by inner product with a forest of random-projection trees.

Every tree splits by the median of a projection on the difference of two sample points. Trees,
search breadth and score floors are fitted on a bounded sample (SAMPLE vectors); every vector is
then routed to one leaf of each tree. A query walks all trees at once through one priority queue,
most promising branch first (smallest margin against it), until it has visited as many leaves as
the sample needed for TARGET recall; the vectors of those leaves are reranked by exact inner
products in double precision.

Leaves are gathered into blocks (subtrees of about BLOCK vectors), and a query meets a block once,
with the list of its leaves. Trees are no deeper than the sample can fit, so a block grows with the
vectors beyond some hundred thousand, and every block's queries grow with the queries: both sides are
dealt by hashes into parts of about MOST vectors and QUERIES queries, known from two counts, and
every two parts of a block meet in a task. No task holds more, whatever the table. A block reports a candidate only if it reaches the query's floor, the
(K + 1)-th best inner product among the sample vectors of the leaves that the query visits: these
are found in any case, so nothing below can be among the nearest found. Equal vectors are one
entry that carries its K + 1 smallest ids, enough for any top K without the query's own id.

Defined cases: vectors that are null, all zero, or hold null or non-finite components take no part,
nor do rows without an id or with another number of components than most rows; a repeated row
counts once; ties go to the smaller id; with K or fewer candidates all are returned; no query or no
candidate gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K, TREES, LEAF, BLOCK = 20, 4, 256, 4096
#: Vectors and queries of one part of a block, about.
MOST, QUERIES = 8192, 20_000
#: Vectors and floats of the fitting sample, at most; sample queries that set the search breadth.
SAMPLE, SAMPLE_FLOATS, TRIALS = 16_384, 4_000_000, 300
TARGET = 0.95


class Forest:
    """Complete trees of one depth, stored level by level."""

    def __init__(self, x: np.ndarray, depth: int, trees: int = TREES, seed: int = 4):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        inner = (1 << depth) - 1
        self.normal = np.zeros((trees, inner, x.shape[1]), dtype=np.float32)
        self.cut = np.zeros((trees, inner), dtype=np.float32)
        for t in range(trees):
            at = np.zeros(len(x), dtype=np.int64)  # node, from 0 at the root
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows) > 1:
                    a, b = rng.choice(rows, 2, replace=False)
                    w = x[a] - x[b]
                else:
                    w = rng.standard_normal(x.shape[1])
                n = np.linalg.norm(w)
                w = w / n if n > 0 else rng.standard_normal(x.shape[1]) / math.sqrt(x.shape[1])
                self.normal[t, node] = w
                p = x[rows] @ self.normal[t, node]
                self.cut[t, node] = np.median(p) if len(rows) else 0
                at[rows] = 2 * node + 1 + (p > self.cut[t, node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf (0 to 2^depth - 1) of each vector in each tree: (trees, n)."""
        out = np.zeros((self.trees, len(x)), dtype=np.int64)
        for t in range(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.normal[t][at]) > self.cut[t][at])
            out[t] = at - ((1 << self.depth) - 1)
        return out

    def visit(self, q: np.ndarray, most: int) -> list[list[tuple[int, int]]]:
        """For each query the first `most` (tree, leaf)s in the order of one shared queue."""
        inner = (1 << self.depth) - 1
        margins = np.stack([q @ self.normal[t].T - self.cut[t] for t in range(self.trees)], axis=1) if inner else np.zeros((len(q), self.trees, 0))
        out = []
        for m in margins.tolist():
            heap, found = [(-math.inf, t, 0) for t in range(self.trees)], []
            while heap and len(found) < most:
                far, t, node = heapq.heappop(heap)
                if node >= inner:
                    found.append((t, node - inner))
                    continue
                d = m[t][node]
                heapq.heappush(heap, (max(far, -d), t, 2 * node + 2))
                heapq.heappush(heap, (max(far, d), t, 2 * node + 1))
            out.append(found)
        return out


def breadth(forest: Forest, x: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS, seed: int = 5) -> int:
    """Leaves to visit for `target` recall of the k nearest in the sample."""
    total = forest.trees << forest.depth
    if len(x) <= k + 1:
        return total
    rows = np.random.default_rng(seed).permutation(len(x))[:trials]
    scores = x[rows] @ x.T
    scores[np.arange(len(rows)), rows] = -np.inf
    best = np.argpartition(-scores, k, axis=1)[:, :k]
    leaves = forest.leaves(x)
    order = forest.visit(x[rows], total)
    found = np.zeros(total + 1)
    for i, seen in enumerate(order):
        rank = np.zeros((forest.trees, 1 << forest.depth), dtype=np.int64)
        for at, (t, leaf) in enumerate(seen):
            rank[t, leaf] = at
        first = np.min([rank[t, leaves[t, best[i]]] for t in range(forest.trees)], axis=0)
        found[1:] += np.bincount(first, minlength=total)[:total]
    return int(np.argmax(np.cumsum(found) >= target * len(rows) * k))


def neighbours(vectors: DataFrame, every: int = 20, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id `every` divides."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.coalesce(F.forall("v", fine), F.lit(False)) & F.exists("v", lambda x: x != 0))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not most:
        return empty
    dim = most[0]["dim"]
    rows = rows.where(F.size("v") == dim)
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(4)).alias("b"))
    rows = scratch.keep(rows.withColumn("key", key).dropDuplicates(["id", "key"]), "rows")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = scratch.keep(ranked.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    n = entries.count()
    size = min(SAMPLE, max(64, SAMPLE_FLOATS // dim))
    pick = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30))
    chosen = entries.select("v", pick.alias("p")).where(F.col("p") <= int(min(1.0, 1.1 * size / n) * (1 << 30))).orderBy("p", "v").limit(size)
    x = np.array([r["v"] for r in chosen.select("v").collect()])  # a bounded sample
    depth = max(0, min(round(math.log2(max(1, n / LEAF))), int(math.log2(max(1, len(x) / 8)))))
    forest = Forest(x, depth)
    wide = breadth(forest, x, k)
    up = min(depth, max(0, round(math.log2(BLOCK / max(1.0, n / (1 << depth))))))  # levels from leaf to block
    sent = spark.sparkContext.broadcast((forest, x, forest.leaves(x)))  # bounded by SAMPLE_FLOATS and the trees on it
    cells = "t int, block int, leaf array<int>, side int, id long, a long, b long, v array<double>, floor double"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sample, places = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                v = np.array(b.column("v").to_pylist(), dtype=np.float64).reshape(b.num_rows, dim)
                ids, ka, kb, own = (b.column(c).to_pylist() for c in ("id", "a", "b", "v"))
                out = []
                if ids[0] is None:
                    for t, leaves in enumerate(trees.leaves(v).tolist()):
                        out += [(t, leaf >> up, [leaf], 0, None, ka[i], kb[i], own[i], None) for i, leaf in enumerate(leaves)]
                else:
                    scores = v @ sample.T
                    for i, seen in enumerate(trees.visit(v, wide)):
                        # The (k+1)-th best of the sample in the visited leaves: the query itself may be one of them.
                        visited = np.zeros((trees.trees, 1 << trees.depth), dtype=bool)
                        visited[tuple(np.array(seen).T)] = True
                        met_ = scores[i][visited[np.arange(trees.trees)[:, None], places].any(axis=0)]
                        floor = float(np.partition(met_, -k - 1)[-k - 1] - 1e-9 * np.abs(met_).max()) if len(met_) > k else -math.inf
                        by: dict[tuple[int, int], list[int]] = {}
                        for t, leaf in seen:
                            by.setdefault((t, leaf >> up), []).append(leaf)
                        out += [(t, block, leaf, 1, ids[i], None, None, own[i], floor) for (t, block), leaf in by.items()]
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.int32())), pa.array(c[3], pa.int32()), *[pa.array(z, pa.int64()) for z in c[4:7]], pa.array(c[7], pa.list_(pa.float64())), pa.array(c[8], pa.float64())], names=[z.split()[0] for z in cells.split(", ")])

    wanted = rows.where(F.col("id") % every == 0)
    vector_parts, query_parts = max(1, math.ceil(n / ((1 << (depth - up)) * MOST))), max(1, math.ceil(wanted.count() / QUERIES))
    each_of = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    index = entries.select(F.lit(None).cast("long").alias("id"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), "v").mapInArrow(route, cells)
    index = index.withColumn("vp", F.pmod(F.hash("a", "b"), F.lit(vector_parts))).withColumn("qp", each_of(query_parts))
    asked = wanted.select("id", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "v").mapInArrow(route, cells)
    asked = asked.withColumn("qp", F.pmod(F.hash("id"), F.lit(query_parts))).withColumn("vp", each_of(vector_parts))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Exact products of one block's queries with the vectors of the leaves that each visits."""
        got: list[tuple] = []
        if len(left) and len(right):
            leaf = np.array([x[0] for x in left["leaf"]])
            order = np.argsort(leaf, kind="stable")
            leaf, v = leaf[order], np.stack(left["v"].to_numpy())[order]
            a, b = left["a"].to_numpy()[order], left["b"].to_numpy()[order]
            names, first = np.unique(leaf, return_index=True)
            last = np.append(first[1:], len(leaf))
            asked_by: dict[int, list[int]] = {}
            for i, seen in enumerate(right["leaf"]):
                for x in seen:
                    asked_by.setdefault(int(x), []).append(i)
            q, floor, ids = np.stack(right["v"].to_numpy()), right["floor"].to_numpy(), right["id"].to_numpy()
            for name, lo, hi in zip(names.tolist(), first, last):
                for at in range(0, len(asked_by.get(name, ())), 1024):
                    who = np.array(asked_by[name][at : at + 1024])
                    r, c = np.nonzero(q[who] @ v[lo:hi].T >= floor[who][:, None])
                    exact = (q[who[r]] * v[lo + c]).sum(axis=1)
                    got.append((ids[who[r]], a[lo + c], b[lo + c], exact))
        cols = [np.concatenate(z) for z in zip(*got)] if got else [np.zeros(0, dtype=np.int64)] * 3 + [np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "a", "b", "score"), cols)))

    part = ["t", "block", "vp", "qp"]
    met = index.groupBy(*part).cogroup(asked.groupBy(*part)).applyInPandas(rerank, "query_id long, a long, b long, score double")
    met = met.groupBy("query_id", "a", "b").agg(F.max("score").alias("score"))
    names = entries.select(F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.col("ids"))
    each = met.join(names, ["a", "b"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A query may stand on several rows of its id with different vectors: the better score counts.
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
