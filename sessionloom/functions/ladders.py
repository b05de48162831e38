"""Bucket ladders, percentiles and other numeric expressions. Every ladder is its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of the ladders.
STRUCTURAL = (8_000, 16_000, 32_000, 64_000, 128_000)
QUALITY = (8_192, 32_768, 131_072)
KILLER = (32_768, 65_536, 131_072, 262_144)
TURNS = (24, 48, 96)
AGE = (32_768, 131_072, 262_144)
COMPOSED = (131_072, 262_144, 524_288, 1_048_576)


def upper_bucket(value: Column, bounds: tuple, unknown: str = "unknown") -> Column:
    """0, 1, ... by inclusive upper bounds; null is `unknown`."""
    out = F.when(value.isNull(), unknown)
    for i, b in enumerate(bounds):
        out = out.when(value <= b, str(i))
    return out.otherwise(str(len(bounds)))


def lower_bucket(value: Column, bounds: tuple) -> Column:
    """0, 1, ... by inclusive lower bounds."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(value >= b, 1).otherwise(0)
    return out


def nearest_rank(values: Column, q: float) -> Column:
    """The value at index floor(q n) of the sorted array, the last at most."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.element_at(s, F.least(F.size(s), (F.floor(F.size(s) * q) + 1).cast("int"))))


def truncated_rank(values: Column, q: float) -> Column:
    """The value at index int(q n) - 1 of the sorted array, the first at least."""
    s = F.sort_array(values)
    return F.when(F.size(s) > 0, F.element_at(s, F.greatest(F.lit(1), F.floor(F.size(s) * q).cast("int"))))
