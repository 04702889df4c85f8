"""Overlap joins of half-open intervals, binned; pruning by extents; segmented binary search as counting.

Both sides are listed under every bin they touch and joined on (key, bin) with the overlap as a residual condition. A
pair that shares several bins is kept in the first one only, so no distinct is needed. Bins spread a hot chromosome
over its length. Which side is broadcast, if any, is left to the sizes Spark measures at run time.

Rows lacking a key, start or end, or with end <= start, overlap nothing. Repeated rows give repeated pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.blocks import carried, join_on_same

BIN = 1 << 12


def _binned(df: DataFrame, start: str, end: str, width: int, out: str) -> DataFrame:
    valid = df.where(F.col(end) > F.col(start))
    return valid.withColumn(out, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))


def overlap_join(queries: DataFrame, intervals: DataFrame, key: str = "chrom", q: Sequence[str] = ("q_start", "q_end"), i: Sequence[str] = ("start", "end"), bin_size: int = BIN) -> DataFrame:
    """Pairs with ``start < q_end and end > q_start`` on equal ``key``; all columns of both, ``key`` once.

    ``bin_size`` should be of the order of the longer of the typical lengths. Columns of ``intervals`` whose names
    ``queries`` has too end in ``_right``; the position columns must have different names.
    """
    if set(q) & set(i):
        raise ValueError("the position columns of both sides have different names")
    intervals = intervals.withColumnsRenamed({c: f"{c}_right" for c in intervals.columns if c != key and c in queries.columns})
    left = _binned(queries, *q, bin_size, "__bin")
    right = _binned(intervals, *i, bin_size, "__bin")
    met = left.join(right, [key, "__bin"])
    first = F.floor(F.greatest(F.col(q[0]), F.col(i[0])) / bin_size)
    return met.where((F.col(i[0]) < F.col(q[1])) & (F.col(i[1]) > F.col(q[0])) & (F.col("__bin") == first)).drop("__bin")


def touched(intervals: DataFrame, queries: DataFrame, key: str = "chrom", q: Sequence[str] = ("q_start", "q_end"), i: Sequence[str] = ("start", "end"), bin_size: int = BIN, once: bool = False) -> DataFrame:
    """Intervals that overlap any query, each row once: the pruning of chunks by the queries to be answered.

    Queries are merged to the distinct bins and stretches they cover by the semi-join itself. ``once`` tells that no
    interval is repeated.
    """
    if not once:
        intervals = intervals.withColumn("__id", F.struct(*intervals.columns)).groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).select("__id.*", "__n")
    here = _binned(intervals, *i, bin_size, "__bin")
    wanted = _binned(queries.select(key, *q).distinct(), *q, bin_size, "__bin").withColumnsRenamed({key: "__key", q[0]: "__qs", q[1]: "__qe", "__bin": "__qbin"})
    semi = here.join(wanted, (F.col(key) == F.col("__key")) & (F.col("__bin") == F.col("__qbin")) & (F.col(i[0]) < F.col("__qe")) & (F.col(i[1]) > F.col("__qs")), "left_semi")
    semi = semi.drop("__bin").distinct()
    return semi if once else semi.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def locate(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, bin_size: int) -> DataFrame:
    """Each point with the span ``start <= point < end`` that holds it: a lookup in a cumulative index."""
    spread = _binned(spans, start, end, bin_size, "__bin")
    met = points.withColumn("__bin", F.floor(F.col(point) / bin_size)).join(spread, "__bin")
    return met.where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bin")


def searchsorted(values: DataFrame, queries: DataFrame, segment: str, value: str, query: str, side: str = "left", bin_size: int = BIN, absolute: bool = False) -> DataFrame:
    """Add ``position``: where each query would be inserted into the sorted values of its segment.

    ``left``: the number of smaller values; ``right``: of smaller or equal ones. ``absolute`` adds the number of values
    in all earlier segments. Values and queries run together through one window per (segment, bin); what earlier bins
    hold comes from a table of their counts. Null values and null queries are left out; a segment may have no value.
    """
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    order = 0 if side == "left" else 1  # among equal ones, a query before or after the values
    v = values.where(F.col(value).isNotNull()).select(F.col(segment), F.col(value).alias("__v"), F.lit(1 - order).alias("__o"), F.lit(1).alias("__n"), F.lit(None).cast("struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in queries.schema) + ">").alias("__row"))
    q = queries.where(F.col(query).isNotNull()).select(F.col(segment), F.col(query).alias("__v"), F.lit(order).alias("__o"), F.lit(0).alias("__n"), F.struct(*queries.columns).alias("__row"))
    both = v.unionByName(q).withColumn("__bin", F.floor(F.col("__v") / bin_size))
    inside = F.sum("__n").over(Window.partitionBy(segment, "__bin").orderBy("__v", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = carried(both, [segment], "__bin", F.sum("__n"), "__before")
    found = join_on_same(both.withColumn("__inside", inside).where(F.col("__n") == 0), before, [segment, "__bin"])
    found = found.select("__row.*", (F.coalesce("__before", F.lit(0)) + F.col("__inside")).alias("position"))
    if not absolute:
        return found
    starts = carried(values.where(F.col(value).isNotNull()).select(segment), [], segment, F.count(F.lit(1)), "__first")
    return join_on_same(found, starts, [segment], "left").withColumn("position", F.col("position") + F.coalesce("__first", F.lit(0))).drop("__first")
