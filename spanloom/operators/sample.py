"""Seeded sampling that any engine repeats: every draw is arithmetic on the row's number, never ``rand()``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators.blocks import numbered
from spanloom.operators.overlap import locate

# Fixed values of a linear congruential step, applied twice.
FACTOR, STEP, MODULUS = 1103515245, 12345, 1 << 31
SECOND = 1_000_003


def mixed(number: Column, seed: int = 0) -> Column:
    """A pseudorandom number in [0, 2^31) from an integer column."""
    once = F.pmod(F.pmod(number, F.lit(MODULUS)) * FACTOR + (STEP + seed % MODULUS), F.lit(MODULUS))
    twice = F.pmod((F.floor(once / 65536) + F.pmod(once, F.lit(65536)) * 32768) * FACTOR + STEP, F.lit(MODULUS))
    return F.pmod(F.floor(twice / 4096) + F.pmod(twice, F.lit(4096)) * 524288, F.lit(MODULUS))


def uniform(number: Column, total: Column, seed: int = 0) -> Column:
    """A pseudorandom integer in [0, total), from 62 random bits, so a total may exceed the length of any genome."""
    return F.pmod(mixed(number, seed) * MODULUS + mixed(number + SECOND, seed + 1), total)


def cumulative_index(regions: DataFrame) -> DataFrame:
    """Add ``cum_start`` and ``cum_end``: each region's stretch of the total length, in order of chrom, start, end.

    Rows lacking a position, or without length, have no stretch and go. Chromosomes are few; a region's place is the
    sum within its chromosome plus the totals of earlier ones.
    """
    rows = regions.where("chrom is not null and end > start").withColumn("__len", F.col("end") - F.col("start")).withColumn("__block", F.floor(F.col("start") / (1 << 22)))
    totals = rows.groupBy("chrom", "__block").agg(F.sum("__len").alias("__w"))
    before = totals.select("chrom", "__block", F.coalesce(F.sum("__w").over(Window.orderBy("chrom", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__len").over(Window.partitionBy("chrom", "__block").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("__in", inside).join(before, ["chrom", "__block"]).withColumn("cum_start", F.col("__before") + F.col("__in"))
    return placed.withColumn("cum_end", F.col("cum_start") + F.col("__len")).drop("__len", "__block", "__before", "__in")


def epoch_batches(regions: DataFrame, sequence_length: int, batch_size: int) -> DataFrame:
    """``(total_length, batches)``: how many batches of sequences the regions hold."""
    total = F.coalesce(F.sum(F.when(F.col("chrom").isNotNull() & (F.col("end") > F.col("start")), F.col("end") - F.col("start"))), F.lit(0))
    return regions.agg(total.alias("total_length")).withColumn("batches", F.floor(F.floor(F.col("total_length") / sequence_length) / batch_size))


def positions(spark: SparkSession, regions: DataFrame, n: int, seed: int = 0, first: int = 0, repeat_same: int | None = None) -> DataFrame:
    """``(draw, chrom, center)``: ``n`` positions, each base of the regions equally likely, the same for the same seed.

    Draws are numbered from ``first``, so a later range of numbers goes on where an earlier one ended. With
    ``repeat_same`` the first so many positions come again and again. ``regions`` may be indexed already.
    """
    index = (regions if "cum_end" in regions.columns else cumulative_index(regions)).select("chrom", "start", "cum_start", "cum_end")
    total = index.agg(F.max("cum_end").alias("t")).scalar()
    draws = spark.range(first, first + n).select(F.col("id").alias("draw"), uniform(F.pmod(F.col("id"), F.lit(repeat_same)) if repeat_same else F.col("id"), total, seed).alias("r")).where("r is not null")
    width = 1 << 16
    return locate(draws, index, "r", "cum_start", "cum_end", width).select("draw", "chrom", (F.col("start") + F.col("r") - F.col("cum_start")).alias("center"))


def numbered_positions(positions: DataFrame) -> DataFrame:
    """``(draw, chrom, center)`` of given positions, in an order that depends on nothing but them: that of a hash, cut into a million blocks."""
    spread = positions.select("chrom", "center").withColumn("__o", F.shiftrightunsigned(F.xxhash64("chrom", "center"), 44))
    return numbered(spread, "__o", 1, "draw", ["chrom", "center"]).select("draw", "chrom", "center")


def track_subsets(batches: DataFrame, tracks: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``(batch_id, track_ids)``: ``size`` different tracks for each batch, in order; all of them if there are fewer."""
    every = tracks.agg(F.array_sort(F.collect_set("track_id")).alias("ids")).scalar()
    listed = batches.select("batch_id").distinct().withColumn("__ids", every)
    ranked = F.transform("__ids", lambda t: F.struct(mixed(t.cast("bigint") * 7919 + F.col("batch_id") * 104729, seed).alias("h"), t.alias("t")))
    chosen = F.array_sort(F.transform(F.slice(F.array_sort(ranked), 1, size), lambda x: x["t"]))
    return listed.select("batch_id", chosen.alias("track_ids"))
