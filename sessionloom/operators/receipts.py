"""Joins that check what they join: ordinal pairing, control columns, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_position(a: DataFrame, b: DataFrame, guard: str, value: str, position: str = "position") -> DataFrame:
    """(position, a, b) where both have as many rows and equal guards, else no rows at all."""
    x = a.select(position, F.col(guard).alias("_ga"), F.col(value).alias("a"))
    y = b.select(position, F.col(guard).alias("_gb"), F.col(value).alias("b"))
    both = x.join(y, position, "full_outer")
    bad = both.agg(F.coalesce(F.max((~F.col("_ga").eqNullSafe(F.col("_gb"))).cast("int")), F.lit(0)).alias("_bad"))
    return both.crossJoin(F.broadcast(bad)).where("_bad = 0").select(position, "a", "b")


def checked(a: DataFrame, b: DataFrame, keys: list[str], control: str) -> DataFrame:
    """Inner join on the keys; reading a row whose control columns differ fails the job."""
    x = a.withColumnRenamed(control, "_x")
    joined = x.join(b.withColumnRenamed(control, "_y"), keys)
    same = F.when(F.col("_x").eqNullSafe(F.col("_y")), F.col("_x")).otherwise(F.raise_error(F.concat(F.lit("control differs: "), F.coalesce("_x", F.lit("null")))))
    return joined.withColumn(control, same).drop("_x", "_y")


def checked_by_position(a: DataFrame, b: DataFrame, checks: list[str], position: str = "position") -> DataFrame:
    """a with b's other columns, row by row; a missing partner or a check that differs fails the job when the row is read."""
    other = b.select(position, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in checks], *[c for c in b.columns if c not in (position, *checks)])
    both = a.withColumn("_here", F.lit(True)).join(other, position, "full_outer")
    fine = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    for c in checks:
        fine &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    said = F.concat(F.lit("rows differ at position "), F.coalesce(F.col(position).cast("string"), F.lit("null")))
    kept = F.when(fine, F.col(position)).otherwise(F.raise_error(said).cast(a.schema[position].dataType))
    return both.withColumn(position, kept).drop("_here", "_there", *[f"_{c}" for c in checks])


def citations(cited: DataFrame, tracked: DataFrame, present: DataFrame, key: str = "name") -> DataFrame:
    """(name, problem): cited but absent, tracked but not cited, cited but not tracked."""
    label = lambda d, p: d.select(key).distinct().withColumn("problem", F.lit(p))
    return label(cited.join(present, key, "left_anti"), "absent").unionByName(label(tracked.join(cited, key, "left_anti"), "not cited")).unionByName(label(cited.join(tracked, key, "left_anti"), "not tracked"))


def scoreable(rows: DataFrame, raw: str, arms: tuple = ("full", "active"), key: str = "next_turn") -> DataFrame:
    """Rows whose raw JSON has an f1 in both arms and the key in each, null values of the key included."""
    cond = F.lit(True)
    for arm in arms:
        cond &= F.get_json_object(raw, f"$.{arm}.f1").isNotNull() & F.array_contains(F.json_object_keys(F.get_json_object(raw, f"$.{arm}")), key)
    return rows.where(F.coalesce(cond, F.lit(False)))
