"""Interval algebra: filters, scale, padding, merging with a gap, subtraction.

Intervals are half-open. Rows lacking chrom, start or end, or with end <= start, are dropped by ``merge`` and
``subtract``. Columns that an operator doesn't name pass through the row-wise ones and are dropped by ``merge``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.chrom import standard_chromosomes

BLOCK = 1 << 22
#: Bases of a bin in which intervals meet holes: much longer than most intervals, so that few cross a border.
HOLE_BIN = 1 << 16


def select_chromosomes(df: DataFrame, include: str | Sequence[str] = "all", exclude: str | Iterable[str] | None = None) -> DataFrame:
    """Keep chromosomes: 'all', 'standard', one name or a list; then drop the excluded ones. Both filters reach the scan."""
    if include == "standard":
        df = df.where(F.col("chrom").isin(standard_chromosomes(None)))
    elif include != "all":
        df = df.where(F.col("chrom").isin([include] if isinstance(include, str) else list(include)))
    dropped = [exclude] if isinstance(exclude, str) else list(exclude or ())
    return df.where(~F.col("chrom").isin(dropped)) if dropped else df


def above(df: DataFrame, threshold: float | None) -> DataFrame:
    """Rows with a value over ``threshold``; 0 and None filter nothing."""
    return df.where(F.col("value") > threshold) if threshold else df


def scaled(df: DataFrame, tracks: DataFrame) -> DataFrame:
    """Values times their track's ``scale``; a track without one keeps its values. ``tracks`` has one row per track."""
    factor = tracks.select("track_id", F.coalesce(F.nanvl(F.col("scale").cast("double"), F.lit(1.0)), F.lit(1.0)).alias("__scale"))
    return df.join(factor, "track_id", "left").withColumn("value", F.col("value") * F.coalesce("__scale", F.lit(1.0))).drop("__scale")


def padded(df: DataFrame, padding: int) -> DataFrame:
    """Both ends moved outwards, the start not below 0."""
    if padding < 0:
        raise ValueError("padding is not negative")
    return df.withColumns({"start": F.greatest(F.col("start") - padding, F.lit(0)), "end": F.col("end") + padding})


def first_tracks(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` tracks by number."""
    return df if n is None else df.where(F.col("track_id") < n)


def merge(df: DataFrame, by: Sequence[str] = ("chrom",), allow_gap: int = 0, block: int = BLOCK) -> DataFrame:
    """``(*by, start, end, value)``: rows joined while the next start is at most ``allow_gap`` past the furthest end so far.

    ``value`` is the largest of the joined rows, null if none has one; it is left out if ``df`` has none. Rows are cut at
    the borders of blocks, so windows cover a (group, block) and need nothing of other blocks; the first and last
    islands of blocks then meet in a second window of at most two rows a block. The input is read once. Repeated rows
    change nothing.
    """
    if allow_gap < 0:
        raise ValueError("a gap is not negative")
    named, by = list(by), [f"__k{i}" for i in range(len(by))]
    valued = "value" in df.columns
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(named, by)], F.col("start").alias("s"), F.col("end").alias("e"), *([F.col("value").alias("v")] if valued else [])).where("e > s")
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor((F.col("e") - 1) / block))))
    rows = rows.withColumns({"s": F.greatest("s", F.col("block") * block), "e": F.least("e", (F.col("block") + 1) * block)})
    largest = [F.max("v").alias("v")] if valued else []
    inside = Window.partitionBy(*by, "block").orderBy("s", "e")
    far = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("s") > far + allow_gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*by, "block", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), *largest)
    # the first and the last island of each block meet in one window per group, all others keep their block
    edge = (F.col("island") == 1) | (F.col("island") == F.max("island").over(Window.partitionBy(*by, "block")))
    parts = parts.withColumn("place", F.when(~edge, F.col("block")))
    order = Window.partitionBy(*by, "place").orderBy("s")
    parts = parts.withColumn("new", F.coalesce((F.col("s") > F.lag("e").over(order) + allow_gap).cast("int"), F.lit(1)))
    joined = parts.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "place", "group").agg(F.min("s").alias("s"), F.max("e").alias("e"), *largest)
    return joined.select(*[F.col(k).alias(c) for c, k in zip(named, by)], F.col("s").alias("start"), F.col("e").alias("end"), *([F.col("v").alias("value")] if valued else []))


def subtract(df: DataFrame, holes: DataFrame, buffer: int = 0, bin_size: int = HOLE_BIN) -> DataFrame:
    """Intervals without the bases ``holes`` cover; an interval may fall into several, each keeping all other columns.

    ``buffer`` widens the holes first, their starts not below 0. Holes may overlap one another and name chromosomes
    that the intervals lack. Repeated intervals stay repeated.

    A table lists for each bin of a chromosome, up to its last hole, the holes in it, at most one for every two bases,
    and where the next one beyond it starts; a genome has some fifty thousand bins. An interval meets the bins it
    touches, usually one. What is left of it begins at its start or at a hole's end, ends at the next hole, and is given
    by the bin it begins in. So each bin decides alone, and nothing has to be put together again.
    """
    if buffer:
        holes = padded(holes, buffer)
    columns = df.columns
    cut = merge(holes.select("chrom", "start", "end")).select(F.col("chrom").alias("__hchrom"), F.col("start").alias("__hs"), F.col("end").alias("__he"))
    # every bin up to the last hole's is listed, for each hole those it touches and those from the one before it
    bins = F.sequence(F.floor(F.col("__hs") / bin_size), F.floor(F.col("__he") / bin_size))  # that of the base behind it too, where something may begin
    listed = cut.withColumn("__hbin", F.explode(bins)).groupBy("__hchrom", "__hbin").agg(
        F.array_sort(F.collect_list(F.struct("__hs", "__he"))).alias("__all"), F.min(F.when(F.col("__hs") >= F.col("__hbin") * bin_size, F.col("__hs"))).alias("__first"))
    chrom = Window.partitionBy("__hchrom").orderBy("__hbin")
    listed = listed.withColumns({"__next": F.min("__first").over(chrom.rowsBetween(1, Window.unboundedFollowing)), "__gap": F.coalesce(F.lag("__hbin").over(chrom) + 1, F.lit(0))})
    own = F.struct(F.col("__hbin").alias("b"), F.col("__all").alias("all"), F.col("__next").alias("next"))
    empty = F.transform(F.when(F.col("__gap") < F.col("__hbin"), F.sequence("__gap", F.col("__hbin") - 1)).otherwise(F.array().cast("array<bigint>")), lambda b: F.struct(b.alias("b"), F.lit(None).cast(listed.schema["__all"].dataType).alias("all"), F.col("__all")[0]["__hs"].alias("next")))
    dense = listed.select("__hchrom", F.explode(F.concat(empty, F.array(own))).alias("__d")).select("__hchrom", F.col("__d.b").alias("__hbin"), F.col("__d.all").alias("__all"), F.col("__d.next").alias("__next"))

    rows = df.where("end > start and chrom is not null").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    met = rows.join(dense, (F.col("chrom") == F.col("__hchrom")) & (F.col("__bin") == F.col("__hbin")), "left")
    low, high = F.col("__bin") * bin_size, (F.col("__bin") + 1) * bin_size
    met = met.withColumn("__holes", F.filter("__all", lambda h: (h["__hs"] < F.col("end")) & (h["__he"] > F.col("start")) & (h["__he"] >= low)))
    first, tail = low <= F.col("start"), F.least("end", "__next")  # the least of what isn't null
    starts = F.concat(F.array("start"), F.transform("__holes", lambda h: h["__he"]))
    ends = F.concat(F.transform("__holes", lambda h: h["__hs"]), F.array(tail))
    zipped = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    left = F.filter(F.when(first, zipped).otherwise(F.slice(zipped, 2, 1 << 30)), lambda p: (p["s"] < p["e"]) & (p["s"] < high))
    whole = F.when(first, F.array(F.struct(F.col("start").alias("s"), tail.alias("e"))))
    met = met.withColumn("__piece", F.explode(F.when(F.size("__holes") > 0, left).otherwise(whole)))
    return met.withColumns({"start": F.col("__piece.s"), "end": F.col("__piece.e")}).select(*columns)


def intervals(
    tracks: DataFrame, include: str | Sequence[str] = "all", exclude: str | Iterable[str] | None = None, blacklist: DataFrame | None = None, blacklist_buffer: int = 0,
    padding: int = 0, merged: bool = False, threshold: float | None = 0.0, merge_allow_gap: int = 0,
) -> DataFrame:
    """Regions built from all tracks: per track filter, threshold, merge and subtract; then pad, merge and subtract over all.

    Without ``merged`` the track number stays with each row.
    """
    kept = above(select_chromosomes(tracks, include, exclude), threshold).select("track_id", "chrom", "start", "end", "value")
    if merged:
        kept = merge(kept, ["track_id", "chrom"], merge_allow_gap)
    if blacklist is not None:
        kept = subtract(kept, blacklist, blacklist_buffer)
    if padding:
        kept = padded(kept, padding)
    if merged:
        kept = merge(kept, ["chrom"], merge_allow_gap)
    if blacklist is not None and (padding or merged):
        kept = subtract(kept, blacklist, blacklist_buffer)
    return kept


def covered(df: DataFrame, by: Sequence[str] = ("track_id",)) -> DataFrame:
    """Summary of a file of steps: bases covered, least and greatest value, sums of value and its square over bases."""
    n, v = F.col("end") - F.col("start"), F.col("value").cast("double")
    return df.groupBy(*by).agg(F.sum(n).alias("bases_covered"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v * n).alias("sum_values"), F.sum(v * v * n).alias("sum_squares"))


def zoomed(df: DataFrame, level: int, by: Sequence[str] = ("track_id", "chrom")) -> DataFrame:
    """Summary of each stretch of ``level`` bases: bases covered, least, greatest, sum and sum of squares."""
    cells = df.where("end > start").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / level), F.floor((F.col("end") - 1) / level))))
    lo, hi = F.greatest(F.col("start"), F.col("cell") * level), F.least(F.col("end"), (F.col("cell") + 1) * level)
    v, n = F.col("value").cast("double"), hi - lo
    return cells.groupBy(*by, "cell").agg(F.sum(n).alias("valid_count"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.sum(v * n).alias("sum_values"), F.sum(v * v * n).alias("sum_squares"))
