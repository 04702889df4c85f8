"""The tables as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.chrom import resolve
from spanloom.functions.sequence import ONE_HOT
from spanloom.session import table

STEP = ["track_id", "chrom", "start", "end", "value", "run_day"]


def sent_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Complete steps of all tracks as they were sent, some of them twice."""
    known = " and ".join(f"`{c}` is not null" for c in STEP)  # in this form it reaches the scan
    return table(spark, folder, "track_intervals").select(*STEP).where(known).where(~F.isnan("value") & (F.col("end") > F.col("start")))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps of all tracks, each once: rows sent twice are told by all columns but loaded_at; incomplete rows are left out."""
    return sent_steps(spark, folder).distinct().select("track_id", "chrom", "start", "end", F.col("value").cast("double").alias("value"))


def repeated_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The same with its repeats, for operators that drop them among what they hit."""
    return sent_steps(spark, folder).select("track_id", "chrom", "start", "end", F.col("value").cast("double").alias("value"))


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tracks")


def track_chroms(spark: SparkSession, folder: str) -> DataFrame:
    """``(track_id, chrom, chrom_size)``: chromosomes that a track has steps on, with their size."""
    seen = table(spark, folder, "track_intervals").select("track_id", "chrom").dropna().distinct()
    return seen.join(table(spark, folder, "chroms").select("chrom", F.col("chrom_size")), "chrom")


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals with a known chromosome and positive length: ``interval_id, chrom, start, end``."""
    known = resolve(table(spark, folder, "some_intervals"), table(spark, folder, "chroms"))
    return known.where("end > start").select("interval_id", "chrom", "start", "end")


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions with a known chromosome: ``position_id, chrom, center``."""
    known = resolve(table(spark, folder, "some_positions"), table(spark, folder, "chroms"))
    return known.where("center is not null").select("position_id", "chrom", "center")


def queries(spark: SparkSession, folder: str) -> DataFrame:
    """Stream queries as a static table, tracks included."""
    return table(spark, folder, "stream_queries")


def sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Texts read as sequences: ``doc_id, sequence``, letters outside the alphabet as N.

    ASCII is translated letter by letter, which is much cheaper than matching each by a pattern; the rest is matched.
    """
    common = "".join(chr(c) for c in range(1, 128))
    mapped = "".join(c.upper() if c.upper() in ONE_HOT else "N" for c in common)
    letters = F.regexp_replace(F.translate("text", common, mapped), "[^A-Z]", "N")
    return table(spark, folder, "documents").where(F.length("text") > 0).select("doc_id", letters.alias("sequence"))
