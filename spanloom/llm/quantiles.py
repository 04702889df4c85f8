"""Percentiles of very large numeric columns from mergeable bucket counts.

A value goes to the bucket ``ceil(log(|v|) / log(g))`` of its sign with ``g = (1 + a) / (1 - a)``, so every value of a
bucket lies within the fraction ``a`` of the bucket's middle: a percentile read from the counts is off by at most ``a``
of its own value. A sketch is a plain table of (group, bucket, count). Sketches of days, loads or partitions are merged
by adding the counts of equal buckets, which is exact and may be done in any order.

Nulls and NaN don't count. Infinite values have buckets of their own and come back as infinity. A group without any
countable value has no row. All group columns may be null; null is a group like any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.01
BUCKET, COUNT = "bucket", "n_values"


def _shift(accuracy: float) -> int:
    """Added to a bucket's number to make it positive: over the exponent range of doubles, subnormal ones included."""
    return math.ceil(1080 * math.log(2) / math.log((1 + accuracy) / (1 - accuracy))) + 1


def bucket_of(value: Column, accuracy: float = ACCURACY) -> Column:
    """The signed bucket of ``value``; buckets sort as their values do. Null for null and NaN."""
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    v, width, shift = value.cast("double"), math.log((1 + accuracy) / (1 - accuracy)), _shift(accuracy)
    size = F.when(F.abs(v) == float("inf"), F.lit(2 * shift + 1)).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(width)) + shift)
    return F.when(v.isNull() | F.isnan(v), None).when(v == 0, 0).otherwise(F.signum(v) * size).cast("int")


def value_of(bucket: Column, accuracy: float = ACCURACY) -> Column:
    """The value that stands for a bucket: within ``accuracy`` of each value in it."""
    g, shift = (1 + accuracy) / (1 - accuracy), _shift(accuracy)
    size = F.when(F.abs(bucket) > 2 * shift, float("inf")).otherwise(F.exp((F.abs(bucket) - shift) * math.log(g)) * (2 / (1 + g)))
    return F.when(bucket == 0, 0.0).otherwise(F.signum(bucket) * size)


def sketch(df: DataFrame, value: str, by: Sequence[str], accuracy: float = ACCURACY) -> DataFrame:
    """Bucket counts of ``value`` per group: ``(*by, bucket, n_values)``.

    Counts are added up before the shuffle, so a group that holds a third of all rows sends one row per bucket and task.
    """
    b = bucket_of(F.col(value), accuracy)
    return df.select(*by, b.alias(BUCKET)).where(F.col(BUCKET).isNotNull()).groupBy(*by, BUCKET).agg(F.count(F.lit(1)).alias(COUNT))


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add up the sketches of finer groups, or of a union of loads, to those of ``by``."""
    return sketches.groupBy(*by, BUCKET).agg(F.sum(COUNT).alias(COUNT))


def percentiles(sketches: DataFrame, by: Sequence[str], pcts: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """``(*by, n_values, p<pct>...)``: the value of rank ``floor(pct / 100 * (n - 1))`` in each group, within ``accuracy``.

    The window orders buckets, not values: their number is bounded by the exponent range of a double.
    """
    group = Window.partitionBy(*by)
    upto = F.sum(COUNT).over(group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketches.withColumn("__upto", upto).withColumn("__all", F.sum(COUNT).over(group))
    at = [F.min(F.when(F.col("__upto") > F.floor(F.lit(p / 100.0) * (F.col("__all") - 1)), F.col(BUCKET))) for p in pcts]
    names = [f"p{p:g}" for p in pcts]
    found = ranked.groupBy(*by).agg(F.first("__all").alias(COUNT), *[a.alias(n) for a, n in zip(at, names)])
    return found.select(*by, COUNT, *[value_of(F.col(n), accuracy).alias(n) for n in names])


def outlying_days(day_sketches: DataFrame, group: str, day: str, pcts: Sequence[int], factor: float = 2.0, min_count: int = 60, accuracy: float = ACCURACY) -> DataFrame:
    """``(group, day, pct)`` where a day's percentile is at least ``factor`` times that of all days, or at most its part.

    For a negative percentile of all days the sides swap; where it is zero, any other value counts. The sketch of all
    days is the merge of the days' sketches.
    """
    level = F.explode(F.array(F.struct(F.lit(True).alias("of_day"), F.col(day).alias("d")), F.struct(F.lit(False).alias("of_day"), F.lit(None).cast(day_sketches.schema[day].dataType).alias("d"))))
    both = day_sketches.where(F.col(group).isNotNull()).select(group, level.alias("level"), BUCKET, COUNT).select(group, "level.of_day", "level.d", BUCKET, COUNT)
    keys = [group, "of_day", "d"]
    stats = percentiles(merge(both, keys), keys, pcts, accuracy)
    rows = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pct"), F.col(f"p{p:g}").alias("v")) for p in pcts]))
    long = stats.select(*keys, COUNT, rows.alias("r")).select(*keys, COUNT, "r.pct", "r.v")
    whole = F.max(F.when(~F.col("of_day"), F.col("v"))).over(Window.partitionBy(group, "pct"))
    d, a = F.col("v"), F.col("whole")
    off = F.when(a > 0, (d >= a * factor) | (d <= a / factor)).when(a < 0, (d <= a * factor) | (d >= a / factor)).otherwise(d != 0)
    return long.withColumn("whole", whole).where("of_day").where(F.col(COUNT) >= min_count).where(off).select(F.col(group), F.col("d").alias(day), F.col("pct"))
