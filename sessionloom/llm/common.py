"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a character class of Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one Arrow batch.
BATCH_ROWS = 2000
#: How each operator lets go of what it remembers in a worker between tasks.
_forget: dict[str, Callable[[], object]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a temporary folder serves a local master; on a cluster that is an error,
    as executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sessionloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(sc: SparkContext, path: str) -> None:
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most so many rows from here on in this session, if it has not set fewer.

    Rows hold whole texts: with the default of 10,000 rows, batches of some ten megabytes stay in
    the buffers of every executor and worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor loses none of them.

    `keep` writes a frame and reads it back. `drop` removes tables that no later plan reads. What an
    operator's result still reads goes with `clear_scratch`, at the latest when the driver ends.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.roots.append(self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := getattr(df, "_scratch_path", None):
                _delete(self.spark.sparkContext, path)


def clear_scratch() -> None:
    """Removes all scratch tables of this driver; results that have not been written yet are lost."""
    sc = SparkContext._active_spark_context
    while Scratch.roots:
        root = Scratch.roots.pop()
        if sc is not None and sc._jsc is not None:
            _delete(sc, root)
        else:  # the session has ended: what the driver reaches as a file still goes
            shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


atexit.register(clear_scratch)


def remembers(operator: str, forget: Callable[[], object]) -> None:
    """`forget` lets go of what the operator keeps in the memory of a worker."""
    _forget[operator] = forget


def forget_others(operator: str) -> None:
    for name, forget in _forget.items():
        if name != operator:
            forget()


def give_back() -> None:
    """Memory that is free in this process goes back to the system, where the allocators can do that."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run` for mapInArrow, in a worker that lives on between tasks and serves all operators.

    What other operators remember goes before, free memory goes back after. Functions inside others
    are sent with copies of the module's variables that they name, so they reach a worker's own
    variables by way of functions of a module only.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def few_rows(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """A frame of some rows. Sent as an Arrow table: lists of rows start Python workers of their own kind on all executors."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def steps(batch: pa.RecordBatch, column: str, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for a single row, bytes of the column's texts."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right"))
        end = min(max(end, at + 1), at + most_rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_rows(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of df has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(value: int | None, modulus: int) -> int:
    """fold_rows for one id, for tests and drivers."""
    import zlib

    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus
