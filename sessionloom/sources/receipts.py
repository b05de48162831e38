"""Writers of results and durable objects: receipts, partial receipts, derived caches, failover objects.

Every path goes through Hadoop's file systems, so a shared store works like a local folder. Receipts
are single documents for people: their rows are bounded by MOST_ROWS and checked before they come to
the driver. Tables (caches, objects) are written by the executors.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Rows of one receipt at most, and rows between two partial receipts.
MOST_ROWS, EVERY = 100_000, 16


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a file: written aside first, so that a reader never sees half of it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.writing")
    fs = to.getFileSystem(conf)
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(to, False)
    if not fs.rename(aside, to):
        raise OSError(f"cannot write {path}")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def write_receipt(spark: SparkSession, path: str, schema: str, rows: DataFrame | list[dict], **fields) -> None:
    """One indented JSON document with the schema's tag, the fields and the rows."""
    if isinstance(rows, DataFrame):
        got = [json.loads(r["j"]) for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).limit(MOST_ROWS + 1).collect()]
        if len(got) > MOST_ROWS:
            raise ValueError(f"a receipt holds at most {MOST_ROWS} rows; write a table")
        rows = got
    _put(spark, path, json.dumps({"schema": schema, **fields, "rows": rows}, indent=2) + "\n")


class PartialReceipt:
    """Rows of a long run, written every EVERY rows as a receipt that says it is partial, whole at the end."""

    def __init__(self, spark: SparkSession, path: str, schema: str, every: int = EVERY, **fields):
        self.spark, self.path, self.schema, self.every, self.fields = spark, path, schema, every, fields
        self.rows: list[dict] = []

    def add(self, row: dict) -> None:
        self.rows.append(row)
        if len(self.rows) % self.every == 0:
            write_receipt(self.spark, self.path, self.schema, self.rows, partial=True, **self.fields)

    def finish(self, **more) -> None:
        write_receipt(self.spark, self.path, self.schema, self.rows, **self.fields, **more)


def cached(spark: SparkSession, root: str, name: str, version: str, key: dict, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A derived table, kept under its key: read where one of this version is there, else made and written.

    The key's values and the version are part of the folder's name; a run that broke off leaves no
    `_SUCCESS` and is made again.
    """
    tag = hashlib.sha256(json.dumps([version, key], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root.rstrip('/')}/{name}-{version}-{tag}"
    if rebuild or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def merged(done: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """A resumed run's rows with the earlier ones, in order of the keys; an earlier row counts before a later one."""
    fresh = more.join(done.select(*keys).distinct(), keys, "left_anti")
    return done.unionByName(fresh, allowMissingColumns=True).orderBy(*keys)


def failover_objects(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """session, example, spans, query, target, recorded_files, history: what another worker needs to go on.

    One object for each session whose messages name changed files: its first example, and its spans
    before the last message. rows: spans; examples: of `build_examples`, with `active` as the query.
    """
    files = rows.select("session", F.explode(X.patch_files(F.col("text"))).alias("f")).groupBy("session").agg(F.sort_array(F.collect_set("f")).alias("recorded_files"))
    first = examples.groupBy("session").agg(F.min_by(F.struct("active", "target", "history"), "q_turn").alias("e"))
    said = F.sort_array(F.collect_list(F.struct("turn", "span_id", "role", "text")))
    spans = rows.groupBy("session").agg(said.alias("s")).select("session", F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - 1)).alias("spans"))
    query = F.expr("right(e.active, 2000)")
    joined = first.join(files, "session").join(spans, "session")
    return joined.select("session", F.lit(0).alias("example"), "spans", query.alias("query"), F.col("e.target").alias("target"), "recorded_files", F.col("e.history").alias("history"))


def expand_braces(name: str) -> list[str]:
    """The names that alternatives in braces stand for; braces without a comma are a placeholder and stand for none."""
    out, todo = [], [name]
    while todo:
        now = todo.pop(0)
        ends = (i for i, c in enumerate(now) if c == "}" and "{" in now[:i])
        end = next(ends, None)
        if end is None:
            out.append(now)
            continue
        begin = now.rindex("{", 0, end)
        choices = now[begin + 1 : end].split(",")
        todo = ([now[:begin] + c + now[end + 1 :] for c in choices] if len(choices) > 1 else []) + todo
    return out
