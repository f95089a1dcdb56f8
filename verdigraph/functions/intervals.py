"""Probability intervals as struct<l: double, u: double> columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "struct<l:double,u:double>"


def _clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def closed(lower: Column | float, upper: Column | float) -> Column:
    """Interval with both ends in [0, 1]; [0, 1] if the ends are crossed."""
    low, high = (x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in (lower, upper))
    crossed = low > high
    return F.struct(F.when(crossed, 0.0).otherwise(_clamp01(low)).alias("l"), F.when(crossed, 1.0).otherwise(_clamp01(high)).alias("u"))


def unknown() -> Column:
    return closed(0.0, 1.0)


def intersection(a: Column, b: Column) -> Column:
    """Common part; [0, 1] where there is none, so the order of a chain of intersections matters."""
    low, high = F.greatest(a["l"], b["l"]), F.least(a["u"], b["u"])
    apart = low > high
    return F.struct(F.when(apart, 0.0).otherwise(low).alias("l"), F.when(apart, 1.0).otherwise(high).alias("u"))


def contains(outer: Column, inner: Column) -> Column:
    return (outer["l"] <= inner["l"]) & (inner["u"] <= outer["u"])


def same(a: Column, b: Column) -> Column:
    return (a["l"] == b["l"]) & (a["u"] == b["u"])


def width(a: Column) -> Column:
    return a["u"] - a["l"]


def change(a: Column, b: Column) -> Column:
    """The larger move of the two ends."""
    return F.greatest(F.abs(a["l"] - b["l"]), F.abs(a["u"] - b["u"]))


def fold_intersection(items: Column) -> Column:
    """Intersection of an array of intervals from left to right; [0, 1] for an empty array."""
    first = F.coalesce(F.get(items, F.lit(0)), unknown())
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), first.cast(TYPE), lambda acc, x: intersection(acc, x).cast(TYPE))


def least_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def greatest_of(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
