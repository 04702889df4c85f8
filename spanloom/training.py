"""The training loop's table: sampled positions, their sequences, and the tracks' values in the middle of each."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.collection import TrackCollection
from spanloom.functions.encode import bfloat16_bits, check_bfloat16_default, encoded
from spanloom.functions.sequence import known_enough, slices
from spanloom.operators import sample
from spanloom.operators.batch import batched, epoch
from spanloom.operators.values import smoothed, value_arrays
from spanloom.session import checkpoint

# So many draws of which none can be used are an error; a further range is at most so many times all earlier ones.
HOPELESS, GROWTH = 1 << 20, 8


def filled(spark: SparkSession, regions: DataFrame, need: int, usable: Callable[[DataFrame], DataFrame], seed: int = 0, oversample: float = 2.0, repeat_same: int | None = None) -> DataFrame:
    """What ``usable`` keeps of positions drawn over the regions, ``need`` rows or more.

    Draws go on in further ranges of their numbers, sized by the share kept so far, until there are enough; so the
    first ``need`` rows by ``draw`` are those that drawing one by one would give. Each range is written once. If the
    regions hold nothing usable, or the generator's numbers are used up, it raises.
    """
    indexed = checkpoint(sample.cumulative_index(regions.select("chrom", "start", "end")))
    kept, drawn, have, more = None, 0, 0, min(math.ceil(need * oversample), sample.MODULUS)
    while kept is None or have < need:
        part = checkpoint(usable(sample.positions(spark, indexed, more, seed, drawn, repeat_same)))
        kept = part if kept is None else kept.unionByName(part)
        drawn, have = drawn + more, have + part.count()
        if have < need and (drawn >= sample.MODULUS or (not have and (drawn >= HOPELESS or sample.epoch_batches(regions, 1, 1).first()["batches"] == 0))):
            raise ValueError(f"an epoch needs {need} sequences; of {drawn} positions drawn, {have} have one that is whole and known well enough")
        wanted = math.ceil((need - have) * drawn / have * 1.05) + 1 if have else GROWTH * drawn
        more = min(max(wanted, 1), max(GROWTH * drawn, 1), sample.MODULUS - drawn)
    return kept


def training_table(
    collection: TrackCollection, regions: DataFrame, genome: DataFrame, chunk_size: int, sequence_length: int = 1000, center_bin_to_predict: int | None = None, window_size: int = 1,
    moving_average_window_size: int = 1, batch_size: int = 256, super_batch_size: int | None = None, batches_per_epoch: int | None = None, maximum_unknown_bases_fraction: float = 0.1,
    sequence_encoder: str | Callable[[Column], Column] | None = "onehot", default_value: float = 0.0, sub_sample_tracks: int | None = None, positions: DataFrame | None = None,
    track_subsets: DataFrame | None = None, dtype: str = "float32", seed: int = 0, oversample: float = 2.0, repeat_same: int | None = None,
) -> DataFrame:
    """``(batch_id, query_id, chrom, center, sequence, track_ids, values)``: one epoch; ``values`` lists one array per track.

    Positions are drawn over the regions, ``oversample`` times as many as needed at first, or given as (chrom, center);
    those whose sequence is short or has too many unknown bases are left out and more are drawn until the epoch is full,
    or ``filled`` raises. The rest is numbered in the order drawn and cut to the epoch. Given positions are all there
    are: if too few can be used, the epoch is short; they come in the order of a column ``draw``, else in one of a hash
    that depends on nothing but them. ``repeat_same`` draws the first so many positions again and again. Tracks are drawn
    per super-batch. The same seed gives the same table.
    """
    if dtype not in ("float32", "bfloat16"):
        raise ValueError("dtype is float32 or bfloat16")
    if dtype == "bfloat16":
        check_bfloat16_default(default_value)
    spark, crop, super_size = collection.spark, center_bin_to_predict or sequence_length, super_batch_size or batch_size
    if batches_per_epoch is None:
        batches_per_epoch = int(sample.epoch_batches(regions, sequence_length, batch_size).first()["batches"])
    need = batches_per_epoch * batch_size

    def usable(drawn: DataFrame) -> DataFrame:
        ranged = drawn.select("draw", "chrom", "center").withColumn("start", F.col("center") - sequence_length // 2).withColumn("end", F.col("start") + sequence_length).where("start >= 0")
        return known_enough(slices(ranged, genome, chunk_size), sequence_length, maximum_unknown_bases_fraction)

    if positions is None:
        kept = filled(spark, regions, need, usable, seed, oversample, repeat_same)
    else:
        kept = usable(positions if "draw" in positions.columns else sample.numbered_positions(positions))
    rows = epoch(batched(kept.withColumnRenamed("draw", "query_id"), batch_size), batches_per_epoch)
    rows = rows.withColumn("super_id", F.floor(F.col("batch_id") * batch_size / super_size))
    if track_subsets is None and sub_sample_tracks:
        track_subsets = sample.track_subsets(rows.select(F.col("super_id").alias("batch_id")), collection.tracks, sub_sample_tracks, seed)
    if track_subsets is not None:
        rows = rows.join(track_subsets.select(F.col("batch_id").alias("super_id"), "track_ids"), "super_id", "left")
    first = F.col("center") - crop // 2
    ask = rows.select("query_id", "chrom", first.alias("start"), (first + crop).alias("end"), *(["track_ids"] if track_subsets is not None else []))
    ask = checkpoint(ask)  # it tells what to read of the tracks, and then meets it
    arrays = smoothed(value_arrays(ask, collection.tracks, collection.steps_near(ask), window_size, default_value, repeats=collection.repeats), moving_average_window_size)
    cell = bfloat16_bits(F.col("values")) if dtype == "bfloat16" else F.col("values").cast("array<float>")
    per_query = arrays.withColumn("values", cell).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("track_no", "track_id", "values"))).alias("t"))
    out = rows.drop("track_ids", "super_id", "start", "end").join(per_query, "query_id")
    out = out.select("batch_id", "query_id", "chrom", "center", "sequence", F.transform("t", lambda t: t["track_id"]).alias("track_ids"), F.transform("t", lambda t: t["values"]).alias("values"))
    return encoded(out, sequence_encoder)
