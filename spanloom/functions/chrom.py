"""Chromosome names: standard list, sort order, spelling, offsets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t"
AUTOSOMES = 22
SPECIAL = ("chrX", "chrY", "chrM")


def standard_chromosomes(exclude: Iterable[str] | None = SPECIAL) -> list[str]:
    """chr1 to chr22, chrX, chrY and chrM, less ``exclude``; ``None`` excludes nothing."""
    dropped = set(exclude or ())
    return [c for c in [f"chr{n}" for n in range(1, AUTOSOMES + 1)] + list(SPECIAL) if c not in dropped]


def is_standard(chrom: Column) -> Column:
    return chrom.isin(standard_chromosomes(None))


def chrom_order(chrom: Column) -> list[Column]:
    """Sort columns: standard ones first, numbers by value, then X, Y, M, then all others by their natural order.

    Natural order compares the first run of digits as a number; equal numbers fall back to the name.
    """
    number = F.regexp_extract(chrom, r"(\d+)", 1)
    rank = (
        F.when(chrom == "chrX", AUTOSOMES + 1).when(chrom == "chrY", AUTOSOMES + 2).when(chrom == "chrM", AUTOSOMES + 3)
        .otherwise(F.when(number != "", number.cast("bigint")))
    )
    stem = F.when(is_standard(chrom), F.lit("")).otherwise(F.regexp_extract(chrom, r"^(\D*)", 1))
    return [F.when(is_standard(chrom), 0).otherwise(1), stem, rank.asc_nulls_last(), chrom]


def spelling(name: Column) -> Column:
    """How a name is compared: letter case and surrounding blanks and tabs don't count."""
    return F.lower(F.btrim(name, F.lit(BLANKS)))


def names(chroms: DataFrame) -> DataFrame:
    """``(spelled, chrom)``: every name of ``chroms``, its own before an alias where two sequences share one."""
    both = F.array(F.struct(spelling(F.col("chrom")).alias("spelled"), F.lit(0).alias("alias")), F.struct(spelling(F.col("alt_name")).alias("spelled"), F.lit(1).alias("alias")))
    return (
        chroms.select("chrom", F.explode(both).alias("n")).where(F.col("n.spelled").isNotNull())
        .groupBy(F.col("n.spelled").alias("spelled")).agg(F.min_by("chrom", F.struct("n.alias", "chrom")).alias("chrom"))
    )


def resolve(df: DataFrame, chroms: DataFrame, column: str = "chr", out: str = "chrom", how: str = "inner") -> DataFrame:
    """Add ``out``, the sequence of ``chroms`` that ``column`` spells. Rows that spell none go, or get null with ``left``.

    ``chroms`` is a dictionary of sequences; Spark broadcasts it while it is under the session's threshold.
    """
    key = "__spelled"
    keyed = names(chroms).select(F.col("spelled").alias(key), F.col("chrom").alias("__resolved"))
    joined = df.drop(out).withColumn(key, spelling(F.col(column))) if out != column else df.withColumn(key, spelling(F.col(column))).drop(column)
    return joined.join(keyed, key, how).drop(key).withColumnRenamed("__resolved", out)


def chrom_sizes(per_track: DataFrame) -> DataFrame:
    """``(chrom, chrom_size)``: the largest size any track states for a chromosome."""
    return per_track.groupBy("chrom").agg(F.max("chrom_size").alias("chrom_size"))


def chrom_offsets(sizes: DataFrame) -> DataFrame:
    """Add ``chrom_offset``, the total size of all chromosomes that sort earlier. One row per chromosome, so one small task."""
    before = Window.orderBy(*chrom_order(F.col("chrom"))).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("chrom_offset", F.coalesce(F.sum("chrom_size").over(before), F.lit(0)).cast("bigint"))


def with_global_position(df: DataFrame, offsets: DataFrame, position: str = "start", out: str = "global_position") -> DataFrame:
    """Add ``out``: ``position`` counted over all chromosomes one after another."""
    return df.join(offsets.select("chrom", "chrom_offset"), "chrom").withColumn(out, F.col(position) + F.col("chrom_offset")).drop("chrom_offset")
