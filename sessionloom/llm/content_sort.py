"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised text, an external sort inside each range puts
equal texts next to each other, and every row is compared in full with its neighbour. The sort
order is (first 64 characters, two 64-bit hashes, whole text, id), so splitters stay short whatever
the texts, and a group of any size is cut into ranges at its ids. Runs that touch the edge of a
range are joined by their whole text: at most two rows a range.

Defined cases: a null text counts as empty, and empty texts equal each other; a null id sorts
after all others and is the keeper only where no row of the group has an id; of repeated rows that
tie for the smallest id, exactly one stays. Other columns are carried untouched, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, Scratch, shuffle_partitions, tidy

#: Characters of the text that take part in the splitters.
SPLITTER_CHARS = 64
#: Rows that a task holds before it hands them on.
ROWS_OUT = 20_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _keys(norm: Column) -> list[Column]:
    """What stands before the text in the order: ranges are cut by these and the id."""
    return [F.substring(norm, 1, SPLITTER_CHARS), F.xxhash64(norm), F.xxhash64(norm, F.lit(7))]


def _sorted(docs: DataFrame) -> DataFrame:
    """Rows (id, norm) in content order."""
    keys, last = _keys(F.col("norm")), F.col("id").asc_nulls_last()
    return docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *keys, last).sortWithinPartitions(*keys, "norm", last)


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_MEMBERS = pa.schema([("id", pa.int64()), ("run", pa.int64()), ("first_id", pa.int64()), ("head", pa.bool_()), ("n", pa.int64()), ("sha", pa.string()), ("edge", pa.bool_()), ("text", pa.string())])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of each run, and one more with the text for the first and last run."""
    base, k, cur, ids, out, first_done = TaskContext.get().partitionId() << 36, 0, None, [], [], False

    def close(edge: bool) -> None:
        run, sha = base + k, hashlib.sha256(cur.encode("utf-8", "surrogatepass")).hexdigest()
        out.extend((i, run, ids[0], at == 0, len(ids), sha, False, None) for at, i in enumerate(ids))
        if edge:
            out.append((None, run, ids[0], False, len(ids), sha, True, cur))

    for b in batches:
        for text, i in zip(b.column("norm").to_pylist(), b.column("id").to_pylist()):
            if text == cur and cur is not None:
                ids.append(i)
                continue
            if cur is not None:
                close(not first_done)
                first_done, k = True, k + 1
                while len(out) >= ROWS_OUT:
                    yield _emit(_MEMBERS, out[:ROWS_OUT])
                    del out[:ROWS_OUT]
            cur, ids = text, [i]
    if cur is not None:
        close(True)
    while out:
        yield _emit(_MEMBERS, out[:ROWS_OUT])
        del out[:ROWS_OUT]


def _stitched(runs: DataFrame) -> DataFrame:
    """(run, keep_id, total, keeper_run) of the runs at range edges whose text several ranges hold.

    At most two runs a range take part, whatever the rows.
    """
    edges = runs.where("edge").select("run", "first_id", "n", "text")
    by = edges.groupBy("text").agg(F.min(F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("run"))).alias("best"), F.sum("n").alias("total"), F.collect_set("run").alias("runs")).where(F.size("runs") > 1)
    return by.select(F.explode("runs").alias("run"), F.col("best.first_id").alias("keep_id"), "total", F.col("best.run").alias("keeper_run"))


def content_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), normalised(F.col(text)).alias("norm"))
    types = T.StructType([T.StructField("id", T.LongType()), T.StructField("run", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("head", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("edge", T.BooleanType()), T.StructField("text", T.StringType())])
    runs = scratch.keep(_sorted(rows).mapInArrow(tidy("content_sort", _members), types), "runs")
    join = F.broadcast(_stitched(runs))  # at most two rows a range
    out = runs.where("not edge").drop("text").join(join, "run", "left")
    across = F.col("keeper_run").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(across, F.col("keep_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("total", "n").alias("group_size"),
        (F.col("head") & (~across | (F.col("keeper_run") == F.col("run")))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def content_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with docs' own columns: of equal texts, the smallest doc_id.

    Rows travel whole through the sort, so a doc_id that repeats cannot bring a dropped row back.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), normalised(F.col(text)).alias("norm"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    heads_type = T.StructType([T.StructField("run", T.LongType()), T.StructField("first_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("edge", T.BooleanType()), T.StructField("text", T.StringType()), T.StructField("row", rows.schema["row"].dataType, True)])
    n_range = shuffle_partitions(docs.sparkSession)
    # The normalised text decides the order but is not shipped: a task derives it from the row again.
    norm, last = normalised(F.col(f"row.`{text}`")), F.col("id").asc_nulls_last()
    dealt = rows.select("id", "row").repartitionByRange(n_range, *_keys(norm), last).withColumn("norm", norm)
    ordered = dealt.sortWithinPartitions(*_keys(F.col("norm")), "norm", last)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, cur, first_id, size, first_done = TaskContext.get().partitionId() << 36, -1, None, None, 0, False
        row_type = None

        def edge() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([first_id], pa.int64()), pa.array([size], pa.int64()), pa.array([True]), pa.array([cur], pa.string()), pa.nulls(1, row_type)], names=["run", "first_id", "n", "edge", "text", "row"])

        for b in batches:
            row = b.column("row")
            row_type, at, runs, ids = row.type, [], [], []
            for j, (text_, i) in enumerate(zip(b.column("norm").to_pylist(), b.column("id").to_pylist())):
                if text_ == cur and cur is not None:
                    size += 1
                    continue
                if cur is not None and not first_done:
                    yield edge()
                    first_done = True
                k, cur, first_id, size = k + 1, text_, i, 1
                at.append(j)
                runs.append(base + k)
                ids.append(i)
            if at:
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(ids, pa.int64()), pa.nulls(m, pa.int64()), pa.array([False] * m), pa.nulls(m, pa.string()), row.take(pa.array(at))], names=["run", "first_id", "n", "edge", "text", "row"])
        if cur is not None:
            yield edge()

    runs = scratch.keep(ordered.mapInArrow(tidy("content_sort", heads), heads_type), "heads")
    gone = _stitched(runs).where("keeper_run <> run").select("run")
    return runs.where("not edge").join(F.broadcast(gone), "run", "left_anti").select("row.*")
