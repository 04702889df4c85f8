"""Prefix sums and row numbers over long groups, in blocks, so that no window covers a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def carried(df: DataFrame, by: Sequence[str], block: str, total: Column, out: str, combine=F.sum) -> DataFrame:
    """``(*by, block, out)``: ``total`` of each block combined over all earlier blocks of its group; null for the first."""
    totals = df.groupBy(*by, block).agg(total.alias("__total"))
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, block, combine("__total").over(earlier).alias(out))


def numbered(df: DataFrame, order: str, block_size: int = 1 << 16, out: str = "row_no", ties: Sequence[str] = ()) -> DataFrame:
    """Add ``out``, the place (from 0) of each row in the order of the integer column ``order``; equal ones in that of ``ties``, else in any.

    Rows with null ``order`` come first. The window covers one block of ``block_size`` values of ``order``.
    """
    blocked = df.withColumn("__block", F.coalesce(F.floor(F.col(order) / block_size), F.lit(-(1 << 62))))
    before = carried(blocked, [], "__block", F.count(F.lit(1)), "__before")
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(order, *ties)) - 1
    return blocked.withColumn("__inside", inside).join(before, "__block").withColumn(out, F.coalesce("__before", F.lit(0)) + F.col("__inside")).drop("__block", "__inside", "__before")
