"""Query batches: windows around positions, batch numbers, limits, slices."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.blocks import numbered

QUERY_SCHEMA = "query_id long, chrom string, start long, end long"


def windows(df: DataFrame, length: int, center: str = "center") -> DataFrame:
    """Add ``start`` and ``end``: ``length`` bases around a position, half of them, rounded down, before it."""
    return df.withColumn("start", F.col(center) - length // 2).withColumn("end", F.col("start") + length)


def cropped(df: DataFrame, crop: int, center: str = "center") -> DataFrame:
    """The bases to be predicted: the middle ``crop`` around the same position."""
    return windows(df, crop, center)


def batched(df: DataFrame, batch_size: int, order: str = "query_id", drop_remainder: bool = False) -> DataFrame:
    """Add ``batch_id``: rows in order, ``batch_size`` to a batch; a last batch that isn't full may be dropped."""
    if batch_size < 1:
        raise ValueError("a batch has one row at least")
    out = numbered(df, order, out="__row_no").withColumn("batch_id", F.floor(F.col("__row_no") / batch_size))
    if drop_remainder:
        full = df.agg(F.floor(F.count(F.lit(1)) / batch_size).alias("n")).scalar()
        out = out.where(F.col("batch_id") < full)
    return out.drop("__row_no")


def resliced(df: DataFrame, slice_size: int, order: str = "query_id", super_batch: str = "batch_id") -> DataFrame:
    """Add ``slice_id``: each super-batch cut into equal slices, the rows that fill none dropped.

    A super-batch smaller than ``slice_size`` is one slice. A super-batch is of bounded size by its definition.
    """
    group = Window.partitionBy(super_batch)
    n = F.count(F.lit(1)).over(group)
    out = df.withColumn("__n", n).withColumn("__size", F.least(F.lit(slice_size), F.col("__n"))).withColumn("slice_id", F.floor((F.row_number().over(group.orderBy(order)) - 1) / F.col("__size")))
    return out.where(F.col("slice_id") < F.floor(F.col("__n") / F.col("__size"))).drop("__n", "__size")


def epoch(df: DataFrame, batches: int) -> DataFrame:
    """The first ``batches`` batches; 0 gives none."""
    return df.where(F.col("batch_id") < batches)


def sliced(df: DataFrame, first: int, last: int) -> DataFrame:
    """Queries ``first`` to ``last`` by id, the last one not included."""
    return df.where((F.col("query_id") >= first) & (F.col("query_id") < last))


def queries_from(spark: SparkSession, batch: DataFrame | Mapping | Iterable) -> DataFrame:
    """Queries from a DataFrame, a mapping with chromosomes, starts and ends, or those three in a row."""
    if isinstance(batch, DataFrame):
        return batch
    if isinstance(batch, Mapping):
        parts = [batch.get(k) for k in ("chromosomes", "starts", "ends")]
    elif isinstance(batch, (tuple, list)) and len(batch) >= 3:
        parts = list(batch[:3])
    else:
        raise ValueError("a batch is a DataFrame, a mapping, or chromosomes, starts and ends")
    if any(p is None for p in parts) or len({len(p) for p in parts}) != 1:
        raise ValueError("chromosomes, starts and ends must be equally many")
    return spark.createDataFrame([(i, str(c), int(s), int(e)) for i, (c, s, e) in enumerate(zip(*parts))], QUERY_SCHEMA)
