"""Runs of consecutive, almost equal events, collapsed to one event each.

A row continues the run of its predecessor in the same group if it starts at most ``max_gap`` after the predecessor's
end and differs from it in value by at most ``tolerance``. Flags from a lag window, summed up, number the runs.

A group may hold a third of all rows, so no window covers a whole group: the position axis is cut into blocks, runs are
found per (group, block), and only the first and the last run of a block, at most two rows a block, meet in a second
window that joins what the cuts separated.

Rows lacking a group column, start, end or value, or with NaN, are left out first. Rows that repeat another one in all
of ``same`` count once. Equal starts are ordered by end, then value. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 22
OUT = ("run_start", "run_end", "n_rows", "value_min", "value_max")


def collapse_runs(df: DataFrame, by: Sequence[str] = ("track_id", "chrom"), same: Sequence[str] = ("run_day",), max_gap: int = 5, tolerance: float = 0.01, min_rows: int = 1, block: int = BLOCK) -> DataFrame:
    """``(*by, run_start, run_end, n_rows, value_min, value_max)``, one row per longest run of ``min_rows`` rows or more.

    ``run_start`` is the first row's start, ``run_end`` the last row's end. One shuffle of the rows, by (group, block).
    """
    named, by, same = list(by), [f"__k{i}" for i in range(len(by))], list(same)
    value = F.col("value").cast("double")
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(named, by)], F.col("start").alias("s"), F.col("end").alias("e"), value.alias("v"), *[F.col(c).alias(f"__same{i}") for i, c in enumerate(same)])
    rows = rows.dropna(subset=[*by, "s", "e", "v"]).where(~F.isnan("v"))
    rows = rows.withColumn("block", F.floor(F.col("s") / F.lit(block)))
    extra = [f"__same{i}" for i in range(len(same))]
    w = Window.partitionBy(*by, "block").orderBy("s", "e", "v", *extra)

    def before(c: str) -> Column:
        return F.lag(c).over(w)

    repeated = F.lit(True)
    for c in ("s", "e", "v", *extra):
        repeated = repeated & F.col(c).eqNullSafe(before(c))
    rows = rows.withColumn("again", repeated).where(~F.col("again")).drop("again", *extra)

    w = Window.partitionBy(*by, "block").orderBy("s", "e", "v")
    new = F.coalesce((F.col("s") > F.lag("e").over(w) + max_gap) | (F.abs(F.col("v") - F.lag("v").over(w)) > tolerance), F.lit(True))
    rows = rows.withColumn("new", new.cast("int")).withColumn("n", F.row_number().over(w)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*by, "block", "run").agg(
        F.min("s").alias("run_start"), F.max_by("e", "n").alias("last_e"), F.min_by("v", "n").alias("first_v"), F.max_by("v", "n").alias("last_v"),
        F.count(F.lit(1)).alias("n_rows"), F.min("v").alias("value_min"), F.max("v").alias("value_max"),
    )
    parts = parts.withColumn("runs", F.max("run").over(Window.partitionBy(*by, "block")))
    parts = parts.withColumn("edge", (F.col("run") == 1) | (F.col("run") == F.col("runs"))).where(F.col("edge") | (F.col("n_rows") >= min_rows))

    # edge runs, at most two a block, meet in one window per group; all others stay with their block
    parts = parts.withColumn("place", F.when(~F.col("edge"), F.col("block")))
    w = Window.partitionBy(*by, "place").orderBy("block", "run")
    joins = (
        F.col("edge") & (F.col("run") == 1) & (F.lag("block").over(w) < F.col("block"))
        & (F.col("run_start") <= F.lag("last_e").over(w) + max_gap) & (F.abs(F.col("first_v") - F.lag("last_v").over(w)) <= tolerance)
    )
    parts = parts.withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("n", F.row_number().over(w))
    parts = parts.withColumn("whole", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy(*by, "place", "whole").agg(
        F.min("run_start").alias("run_start"), F.max_by("last_e", "n").alias("run_end"), F.sum("n_rows").alias("n_rows"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"),
    )
    return whole.where(F.col("n_rows") >= min_rows).select(*[F.col(k).alias(c) for c, k in zip(named, by)], *OUT)
