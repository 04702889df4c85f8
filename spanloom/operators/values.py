"""Values of tracks over query ranges: per base, or the mean of windows, with a default where nothing is covered.

The plan joins queries with steps first, spreads each overlap over the windows it touches, and adds up. Only partial
sums are shuffled; the full grid of windows is made at the end, inside one array per (query, track), so uncovered
windows cost no shuffle. Scales apply to data; the default is a constant of the output.

Steps of one track must not overlap, but may be repeated if ``repeats`` says so. Steps lacking a key, position or value are left out; a NaN value makes its window
NaN. Window k of a query covers ``[start + k w, start + (k + 1) w)``; a last partial window is dropped. Bases
beyond a chromosome's ends, and queries on unknown chromosomes, are uncovered. Repeated queries give repeated rows only
if their ids differ: query_id identifies a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.overlap import BIN, overlap_join

NAN = float("nan")


def require_equal_lengths(queries: DataFrame) -> int:
    """The one length of all queries; ValueError if there are several. 0 for no query. One small aggregate is run."""
    low, high = queries.agg(F.min(F.col("end") - F.col("start")), F.max(F.col("end") - F.col("start"))).first()
    if low != high:
        raise ValueError(f"queries must have one length, not {low} to {high}")
    return int(low or 0)


def chosen_tracks(queries: DataFrame, tracks: DataFrame) -> DataFrame:
    """``(query columns, track_id, track_no)``: the tracks of each query, in the order it names them.

    A query with null ``track_ids``, or a table without that column, takes all tracks in order of their number. The
    list of all track numbers is one value, read once.
    """
    every = tracks.agg(F.array_sort(F.collect_set("track_id")).alias("ids")).scalar()
    named = F.coalesce(F.col("track_ids"), every) if "track_ids" in queries.columns else every
    return queries.select(*[c for c in queries.columns if c != "track_ids"], F.posexplode(named).alias("track_no", "track_id"))


def hits(queries: DataFrame, steps: DataFrame, bin_size: int = BIN, repeats: bool = False) -> DataFrame:
    """``(query_id, track_id, q_start, n_bases, lo, hi, value)``: what of each step lies in each query, from the query's start.

    ``queries`` has query_id, chrom, start, end and maybe track_id to restrict it to some tracks. Rows are partitioned
    by (query_id, track_id), so all that follows needs no further shuffle of them. With ``repeats``, steps that are
    there more than once are dropped here, among the few that are hit.
    """
    some = "track_id" in queries.columns
    q = queries.select("query_id", "chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"), *([F.col("track_id").alias("q_track")] if some else []))
    s = steps.select("track_id", "chrom", "start", "end", F.col("value").cast("double").alias("value")).dropna(subset=["track_id", "chrom", "start", "end"]).where(F.col("value").isNotNull())
    if some:
        # a query's tracks are a list while it is joined, so its range is matched with the steps once
        q = q.groupBy("query_id", "chrom", "q_start", "q_end").agg(F.collect_set("q_track").alias("q_tracks"))
    met = overlap_join(q, s, bin_size=bin_size)
    if some:
        met = met.where(F.array_contains("q_tracks", F.col("track_id")))
    lo, hi = F.greatest("start", "q_start") - F.col("q_start"), F.least("end", "q_end") - F.col("q_start")
    # what is made of the hits may be many times their size, so the number of partitions isn't left to it
    n = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = met.select("query_id", "track_id", (F.col("q_end") - F.col("q_start")).alias("n_bases"), lo.alias("lo"), hi.alias("hi"), "value").repartition(n, "query_id", "track_id")
    return found.distinct() if repeats else found


def window_sums(queries: DataFrame, steps: DataFrame, window_size: int, bin_size: int = BIN, repeats: bool = False) -> DataFrame:
    """``(query_id, track_id, bin, total, covered)`` of the windows that any step touches."""
    w = F.lit(window_size)
    cells = hits(queries, steps, bin_size, repeats).withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / w), F.floor((F.col("hi") - 1) / w)))).where(F.col("bin") < F.floor(F.col("n_bases") / w))
    n = F.least("hi", (F.col("bin") + 1) * w) - F.greatest("lo", F.col("bin") * w)
    return cells.groupBy("query_id", "track_id", "bin").agg(F.sum(F.col("value") * n).alias("total"), F.sum(n).alias("covered"))


def _mean(window_size: int, default: float) -> Column:
    """Mean over a touched window with the default in uncovered bases; with a NaN default, mean over the covered ones."""
    total, covered = F.col("total"), F.col("covered")
    return total / covered if default != default else (total + (window_size - covered) * default) / window_size


def _filled(runs: Column, length: Column, default: float) -> Column:
    """An array of ``length`` cells from sorted runs (lo, hi, v), the default before, between and after them."""
    blank = F.lit(float(default))

    def cells(run: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(runs, i - 1)["hi"]).otherwise(F.lit(0))
        return F.concat(F.array_repeat(blank, (run["lo"] - before).cast("int")), F.array_repeat(run["v"], (run["hi"] - run["lo"]).cast("int")))

    last = F.coalesce(F.get(runs, F.size(runs) - 1)["hi"], F.lit(0))
    return F.concat(F.flatten(F.transform(runs, cells)), F.array_repeat(blank, (length - last).cast("int")))


def value_arrays(queries: DataFrame, tracks: DataFrame, steps: DataFrame, window_size: int = 1, default: float = 0.0, bin_size: int = BIN, repeats: bool = False) -> DataFrame:
    """``(query_id, track_no, track_id, values)``: one array over all windows for each query and track.

    ``tracks`` lists the tracks there are; ``queries`` may name its own in ``track_ids``.
    """
    if window_size < 1:
        raise ValueError("a window has one base at least")
    grid = chosen_tracks(queries, tracks).select("query_id", "chrom", "start", "end", "track_no", "track_id")
    asked = grid if "track_ids" in queries.columns else queries
    if window_size == 1:  # a step is a run of equal cells as it is
        runs = hits(asked, steps, bin_size, repeats).select("query_id", "track_id", "lo", "hi", F.col("value").alias("v"))
    else:
        runs = window_sums(asked, steps, window_size, bin_size, repeats).select("query_id", "track_id", F.col("bin").alias("lo"), (F.col("bin") + 1).alias("hi"), _mean(window_size, default).alias("v"))
    per_track = runs.groupBy("query_id", "track_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "v"))).alias("runs"))
    joined = grid.join(per_track, ["query_id", "track_id"], "left")
    length = F.greatest(F.floor((F.col("end") - F.col("start")) / window_size), F.lit(0))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint,v:double>>")
    joined = joined.withColumn("runs", F.coalesce("runs", none)).withColumn("length", length)
    return joined.select("query_id", "track_no", "track_id", _filled(F.col("runs"), F.col("length"), default).alias("values"))


def values(queries: DataFrame, tracks: DataFrame, steps: DataFrame, window_size: int = 1, default: float = 0.0, bin_size: int = BIN) -> DataFrame:
    """``(query_id, track_no, track_id, bin, value)``, one row per window, defaults filled in."""
    arrays = value_arrays(queries, tracks, steps, window_size, default, bin_size)
    # the outer form, as Spark would else build each array a second time to see that it isn't empty
    return arrays.select("query_id", "track_no", "track_id", F.posexplode_outer("values").alias("bin", "value")).where(F.col("bin").isNotNull())


def dense(arrays: DataFrame) -> DataFrame:
    """``(query_id, values)``: bins x tracks, tracks in each query's own order, from ``value_arrays``."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("track_no", "values"))), lambda t: t["values"])
    cube = arrays.groupBy("query_id").agg(rows.alias("t"))
    turned = F.transform(F.sequence(F.lit(0), F.size(F.col("t")[0]) - 1), lambda k: F.transform("t", lambda v: F.get(v, k)))
    return cube.select("query_id", F.when(F.size(F.col("t")[0]) > 0, turned).otherwise(F.array().cast("array<array<double>>")).alias("values"))


def smoothed(arrays: DataFrame, window_size: int) -> DataFrame:
    """``values`` replaced by their centred moving average along the bins, zeros beyond the ends, always divided by the width.

    For an even width the window reaches one bin further back than ahead. More than the number of bins is refused.
    """
    if window_size < 1:
        raise ValueError("a window has one bin at least")
    if window_size == 1:
        return arrays
    back, ahead = window_size // 2, (window_size - 1) // 2
    schema = arrays.schema
    place = arrays.columns.index("values")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(place)
            n = np.diff(lines.offsets.to_numpy())
            if (n < window_size).any():
                raise ValueError("the window is wider than the values")
            flat = lines.flatten().to_numpy(zero_copy_only=False)
            out = np.empty(len(flat))
            for length in np.unique(n):  # lines of one length are the rows of a matrix
                at = np.flatnonzero(np.repeat(n, n) == length)
                rows = np.pad(flat[at].reshape(-1, length), ((0, 0), (back, ahead)))
                out[at] = (np.lib.stride_tricks.sliding_window_view(rows, window_size, 1).sum(2) / window_size).ravel()
            columns = batch.columns
            columns[place] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrays.mapInArrow(means, schema)


def check_steps(steps: DataFrame) -> DataFrame:
    """Steps that overlap their predecessor in the same track and chromosome: what ``values`` takes for granted is absent."""
    rows = steps.select("track_id", "chrom", "start", "end").dropna().distinct()
    pairs = overlap_join(rows.withColumnsRenamed({"start": "q_start", "end": "q_end", "track_id": "q_track"}), rows)
    later = (F.col("start") > F.col("q_start")) | ((F.col("start") == F.col("q_start")) & (F.col("end") > F.col("q_end")))
    return pairs.where((F.col("track_id") == F.col("q_track")) & later).select("track_id", "chrom", "start", "end").distinct()
