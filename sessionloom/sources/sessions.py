"""Session corpora and result files: readers, writers, filters. Paths go to Spark's readers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.spans import span_terms

_STRING, _LONG = T.StringType(), T.LongType()
#: The session row; a message column is a JSON string or an array of messages.
MESSAGE = T.StructType([T.StructField("role", _STRING), T.StructField("content", _STRING), T.StructField("tool_calls_json", _STRING), T.StructField("tool_calls", _STRING)])
SESSION = T.StructType([
    *[T.StructField(c, _STRING) for c in ("source_dataset", "source_id", "session_id", "agent_framework", "recorded_model", "ground_truth_meta_json", "messages_json")],
    *[T.StructField(c, _LONG) for c in ("max_isl", "n_turns", "total_tokens")],
    T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("trajectory", T.ArrayType(MESSAGE)),
])
META = "patch_present boolean, instance_id string, resolved boolean"
INDEX_VERSION = "span-table-v1"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = SESSION) -> DataFrame:
    """Lines of JSON; blank lines are no rows, malformed ones are rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str, limit: int | None = None) -> None:
    """Rows with messages, the session row's fields only, nulls left out; a limit takes the first by session_id."""
    rows = rows.select(*[c for c in SESSION.names if c in rows.columns])
    present = [c for c in ("messages_json", "messages", "trajectory") if c in rows.columns]
    rows = rows.where(F.coalesce(*[F.col(c).isNotNull() for c in present]) if len(present) == 1 else " OR ".join(f"{c} IS NOT NULL" for c in present))
    if limit is not None:
        rows = rows.orderBy("session_id").limit(limit)
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def messages(rows: DataFrame) -> DataFrame:
    """session_id, turn, role, text: the first message column that a row has, decoded and flattened.

    Content that is a JSON list of strings or of parts with `text` or `content` is joined by line
    ends, tool calls after it. Rows without messages give none.
    """
    parsed = F.coalesce(F.from_json("messages_json", T.ArrayType(MESSAGE)), F.col("messages"), F.col("trajectory"))
    one = rows.select("session_id", F.posexplode(parsed).alias("turn", "m"))
    return one.select("session_id", "turn", F.coalesce("m.role", F.lit("unknown")).alias("role"), content_text(F.col("m.content"), F.coalesce("m.tool_calls_json", "m.tool_calls")).alias("text"))


def content_text(content: Column, tool_calls: Column) -> Column:
    parts = F.from_json(content, "array<string>")
    piece = lambda p: F.coalesce(F.get_json_object(p, "$.text"), F.get_json_object(p, "$.content"), F.when(~p.startswith("{"), p))
    flat = F.when(content.startswith("[") & parts.isNotNull(), F.transform(parts, piece)).otherwise(F.array(content))
    return X.flatten_content(flat, tool_calls)


def long_enough(rows: DataFrame, least: int) -> DataFrame:
    return rows.where(F.coalesce("max_isl", F.lit(0)) >= least)


def with_patch(rows: DataFrame) -> DataFrame:
    """Rows whose metadata says a patch is present and whose messages name a changed file."""
    meta = F.from_json("ground_truth_meta_json", META)
    changed = messages(rows).where(F.col("role").isin("tool", "assistant", "user") & (F.size(X.patch_files(F.col("text"))) > 0)).select("session_id").distinct()
    return rows.where(F.coalesce(meta["patch_present"], F.lit(False))).join(changed, "session_id", "left_semi")


def repo_of(meta_json: Column) -> Column:
    """The part of the instance id before its first dot; `unknown` without one."""
    head = F.split_part(F.from_json(meta_json, META)["instance_id"], F.lit("."), F.lit(1))
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("unknown"))


def restricted(corpus: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The corpus' rows whose keys are wanted."""
    return corpus.join(wanted.select(*keys).distinct(), keys, "left_semi")


def first_examples(examples: DataFrame, sessions: int | None = None, rows: int | None = None) -> DataFrame:
    """At most so many sessions, and rows, in order of session and turn: the same ones in every run."""
    if sessions is not None:
        chosen = examples.select("session").distinct().orderBy("session").limit(sessions)
        examples = examples.join(chosen, "session", "left_semi")
    return examples if rows is None else examples.orderBy("session", "q_turn").limit(rows)


def same_ids(a: DataFrame, b: DataFrame, key: str = "session_id") -> DataFrame:
    """Keys that only one of two corpora has, and which."""
    x, y = a.select(F.col(key).alias("x")).distinct(), b.select(F.col(key).alias("y")).distinct()
    return x.join(y, F.col("x") == F.col("y"), "full_outer").where("x IS NULL OR y IS NULL").select(F.coalesce("x", "y").alias(key), F.when(F.col("y").isNull(), "left").otherwise("right").alias("only"))


def read_receipts(spark: SparkSession, pattern: str, schema: str, exclude: str | None = None, tag: str | None = None) -> DataFrame:
    """Multi-line JSON files of a pattern, with their names; partial ones and other tags are left out."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("receipt", F.element_at(F.split("_metadata.file_path", "/"), -1))
    if exclude:
        rows = rows.where(~F.col("receipt").rlike(exclude))
    if tag and "schema" in rows.columns:
        rows = rows.where(F.col("schema") == tag)
    return rows.where(~F.coalesce("partial", F.lit(False))) if "partial" in rows.columns else rows


def write_commented_csv(rows: DataFrame, path: str, comments: list[str]) -> None:
    """CSV files whose first lines are comments, as text; for small results."""
    cells = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns])
    head = [*(f"# {c}" for c in comments), ",".join(rows.columns)]
    body = rows.select(cells.alias("value")).coalesce(1)
    spark = rows.sparkSession
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(head)], "i long, value string").unionByName(body.withColumn("i", F.monotonically_increasing_id() + len(head)))
    lines.coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def read_commented_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("comment", "#").option("header", True).csv(path)


def save_index(spans: DataFrame, path: str, postings: bool = False) -> None:
    """The span table, by session; kinds are not kept. With postings, these too, beside it."""
    spans.select("session", "turn", "span_id", "role", "text", "tokens").withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite").parquet(path)
    if postings:
        span_terms(spans).select("session", "term", "span_id", "turn").repartition("session").sortWithinPartitions("session", "term").write.mode("overwrite").parquet(f"{path}-postings")


def load_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-postings")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """The span table; fails on rows of another version when they are read."""
    rows = spark.read.parquet(path)
    ok = F.when(F.col("version") == INDEX_VERSION, F.col("span_id")).otherwise(F.raise_error(F.lit("unsupported index version")).cast("int"))
    return rows.withColumn("span_id", ok).drop("version").withColumn("kind", X.classify(F.col("text")))


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do after an interrupted run."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
