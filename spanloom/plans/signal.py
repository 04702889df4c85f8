"""Queries of the operators on tracks, regions, positions and sequences, with the SQL that gives the same results.

Sums of values are rounded where engines may add in another order.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.collection import TrackCollection
from spanloom.export import distinct_stems, read_tsv, write_tsv
from spanloom.functions import chrom, sequence
from spanloom.functions.encode import bfloat16_bits, encoded, register_encoder
from spanloom.operators import algebra, batch, overlap, sample
from spanloom.operators import values as val
from spanloom.plans import tables
from spanloom.session import new_folder, table
from spanloom.sources import bigwig, fasta
from spanloom.sources.bigwig_writer import write_tracks
from spanloom.sources.paths import find_files, tracks_with_scale
from spanloom.streaming import queries as stream
from spanloom.training import training_table

KEYS = [("liver", 2.0), ("old/liver", 3.0), ("TRK700013", 7.0), ("kidney/accx", 5.0), ("Nerve", 4.0), ("signal", 1.5), ("colon/TRK700143.bigWig", 9.0)]
WINDOW, BATCH, DRAWS, SEQUENCE, PIECE = 128, 256, 5000, 400, 256
# The invented genome: chunks of repeated units, half of them soft-masked or unknown, so that most sequences are rejected.
ZOOM, SAME, GIVEN_BATCHES = 10_000, 700, 40_000
GENOME_CHUNK, UNITS, EPOCH_LENGTH, EPOCH_CROP = 1024, ("ACGT", "GATTACA", "CCGGTTAA", "TGCA", "acgt", "gattaca", "N", "NN"), 1000, 512


def _r(c, digits: int = 6):
    return F.round(c, digits)


def track_scan(s: SparkSession, d: str) -> DataFrame:
    return tables.steps(s, d)


def chrom_include_exclude(s: SparkSession, d: str) -> DataFrame:
    return algebra.select_chromosomes(tables.steps(s, d), "standard", ["chrX", "chrY", "chrM"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def standard_chromosomes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chroms").select("chrom", chrom.is_standard(F.col("chrom")).alias("is_standard"))


def threshold_strict(s: SparkSession, d: str) -> DataFrame:
    return algebra.above(tables.steps(s, d), 5.0)


def scale_then_threshold(s: SparkSession, d: str) -> DataFrame:
    kept = algebra.above(algebra.scaled(tables.steps(s, d), tables.tracks(s, d)), 10.0)
    return kept.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


def scale_by_path_key(s: SparkSession, d: str) -> DataFrame:
    return tracks_with_scale(tables.tracks(s, d), s.createDataFrame(KEYS, "key string, scale double")).select("track_id", "path", "scale")


def pad_intervals(s: SparkSession, d: str) -> DataFrame:
    return algebra.padded(tables.regions(s, d), 20_000)


def first_n_tracks(s: SparkSession, d: str) -> DataFrame:
    return algebra.first_tracks(tables.steps(s, d), 3)


def chrom_max_size(s: SparkSession, d: str) -> DataFrame:
    return chrom.chrom_sizes(tables.track_chroms(s, d))


def chrom_offsets(s: SparkSession, d: str) -> DataFrame:
    return chrom.chrom_offsets(chrom.chrom_sizes(table(s, d, "chroms")))


def global_position(s: SparkSession, d: str) -> DataFrame:
    return chrom.with_global_position(tables.positions(s, d), chrom_offsets(s, d), "center")


def center_crop(s: SparkSession, d: str) -> DataFrame:
    return batch.cropped(tables.positions(s, d), 201)


def overlap_join(s: SparkSession, d: str) -> DataFrame:
    """Every pair of region and step that overlap."""
    r = tables.regions(s, d).withColumnsRenamed({"start": "q_start", "end": "q_end"})
    met = overlap.overlap_join(r, tables.steps(s, d))
    return met.select("interval_id", "track_id", "chrom", "start", "end", (F.least("end", "q_end") - F.greatest("start", "q_start")).alias("shared"))


def chunk_prune_semi(s: SparkSession, d: str) -> DataFrame:
    """Stretches of a track's steps, as chunks of a file, that some query touches."""
    chunks = tables.steps(s, d).groupBy("track_id", "chrom", F.floor(F.col("start") / 100_000).alias("chunk")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    q = tables.queries(s, d).select("chrom", F.col("start").alias("q_start"), F.col("end").alias("q_end"))
    return overlap.touched(chunks, q, bin_size=1 << 17)


def _searched(s: SparkSession, d: str, side: str, absolute: bool) -> DataFrame:
    segment = F.concat_ws(":", "track_id", "chrom")
    every = tables.tracks(s, d).agg(F.array_sort(F.collect_set("track_id")).alias("t")).scalar()
    q = tables.positions(s, d).select("position_id", "chrom", "center", F.explode(every).alias("track_id")).withColumn("segment", segment)
    v = tables.steps(s, d).select(segment.alias("segment"), "start")
    return overlap.searchsorted(v, q, "segment", "start", "center", side, 1 << 20, absolute).select("position_id", "track_id", "center", "position")


def segmented_searchsorted_left(s: SparkSession, d: str) -> DataFrame:
    return _searched(s, d, "left", False)


def segmented_searchsorted_right(s: SparkSession, d: str) -> DataFrame:
    return _searched(s, d, "right", False)


def searchsorted_absolute(s: SparkSession, d: str) -> DataFrame:
    return _searched(s, d, "left", True)


def merge_gap0(s: SparkSession, d: str) -> DataFrame:
    return algebra.merge(tables.regions(s, d))


def merge_gap_n(s: SparkSession, d: str) -> DataFrame:
    return algebra.merge(tables.repeated_steps(s, d), ["track_id", "chrom"], 50)


def merge_cross_track(s: SparkSession, d: str) -> DataFrame:
    return algebra.merge(tables.repeated_steps(s, d), ["chrom"], 0)


def subtract_blacklist(s: SparkSession, d: str) -> DataFrame:
    return algebra.subtract(tables.regions(s, d), table(s, d, "blacklist"))


def subtract_blacklist_buffer(s: SparkSession, d: str) -> DataFrame:
    return algebra.subtract(tables.steps(s, d), table(s, d, "blacklist"), 1000)


def intervals_pipeline(s: SparkSession, d: str) -> DataFrame:
    """Scale, threshold, merge and subtract per track, then pad, merge and subtract over all; merging takes repeats as one."""
    steps = algebra.scaled(tables.repeated_steps(s, d), tables.tracks(s, d))
    return algebra.intervals(steps, "standard", ["chrM"], table(s, d, "blacklist"), 100, 50, True, 5.0, 10)


def track_summary(s: SparkSession, d: str) -> DataFrame:
    a = algebra.covered(tables.steps(s, d))
    return a.withColumns({"sum_values": _r("sum_values", 2), "sum_squares": _r(F.col("sum_squares") / F.col("bases_covered"), 3)})


def zoom_summary(s: SparkSession, d: str) -> DataFrame:
    a = algebra.zoomed(tables.steps(s, d), 10_000)
    return a.withColumns({"sum_values": _r("sum_values", 3), "sum_squares": _r(F.col("sum_squares") / F.col("valid_count"), 3)})


def segment_starts(s: SparkSession, d: str) -> DataFrame:
    """Number of steps of each track, and of those of all earlier ones."""
    n = tables.steps(s, d).groupBy("track_id").agg(F.count(F.lit(1)).alias("size"))
    return n.withColumn("first", F.coalesce(F.sum("size").over(Window.orderBy("track_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


def overlapping_steps(s: SparkSession, d: str) -> DataFrame:
    """Steps that break the rule that a track's steps don't overlap."""
    return val.check_steps(tables.steps(s, d))


def _arrays(s: SparkSession, d: str, window: int, default: float, scaled: bool = False) -> DataFrame:
    steps = tables.repeated_steps(s, d)
    steps = algebra.scaled(steps, tables.tracks(s, d)) if scaled else steps
    return val.value_arrays(tables.queries(s, d), tables.tracks(s, d), steps, window, default, repeats=True)


def _long(arrays: DataFrame) -> DataFrame:
    rows = arrays.select("query_id", "track_id", F.posexplode_outer("values").alias("bin", "v")).where(F.col("bin").isNotNull())
    return rows.select("query_id", "track_id", "bin", F.when(F.isnan("v"), None).otherwise(_r("v")).alias("value"))


def values_per_base(s: SparkSession, d: str) -> DataFrame:
    """One array per query and track of its own list: the value at each base."""
    return _arrays(s, d, 1, 0.0).select("query_id", "track_id", "values")


def window_mean_default0(s: SparkSession, d: str) -> DataFrame:
    return _long(_arrays(s, d, WINDOW, 0.0))


def window_mean_default_const(s: SparkSession, d: str) -> DataFrame:
    return _long(_arrays(s, d, WINDOW, 2.5))


def window_nanmean(s: SparkSession, d: str) -> DataFrame:
    """Mean over covered bases; NaN, where nothing is covered, shown as null."""
    return _long(_arrays(s, d, WINDOW, val.NAN))


def window_mean_scaled(s: SparkSession, d: str) -> DataFrame:
    return _long(_arrays(s, d, WINDOW, 2.5, scaled=True))


def dense_batch_array(s: SparkSession, d: str) -> DataFrame:
    """Bins x tracks per query, flattened row by row."""
    return val.dense(_arrays(s, d, WINDOW, 0.0)).select("query_id", F.transform(F.flatten("values"), lambda x: F.round(x, 6)).alias("values"))


def moving_average_odd(s: SparkSession, d: str) -> DataFrame:
    return _long(val.smoothed(_arrays(s, d, WINDOW, 0.0), 3))


def moving_average_even(s: SparkSession, d: str) -> DataFrame:
    return _long(val.smoothed(_arrays(s, d, WINDOW, 0.0), 4))


def chrom_sort(s: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.orderBy(*chrom.chrom_order(F.col("chrom"))))
    return table(s, d, "chroms").select("chrom", place.alias("place"))


def sort_intervals(s: SparkSession, d: str) -> DataFrame:
    """Intervals in order, each with the chromosome, start and number of the one before it in the result.

    Which one that is comes from where a row stands: rows are numbered in each sorted partition, and the last row of
    each meets the first of the next one.
    """
    rows = tables.regions(s, d).orderBy(*chrom.chrom_order(F.col("chrom")), "start", "end", "interval_id")
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    part = F.shiftright("place", 33)
    inside = Window.partitionBy(part).orderBy("place")
    placed = placed.withColumn("before", F.lag("interval_id").over(inside)).withColumn("part", part)
    last = placed.groupBy("part").agg(F.max_by("interval_id", "place").alias("last"))
    border = last.select(F.lead("part").over(Window.orderBy("part")).alias("next"), "last")
    met = placed.join(border, F.col("part") == F.col("next"), "left")
    return met.select("interval_id", "chrom", "start", "end", F.coalesce("before", "last").alias("before"))


def _collection(s: SparkSession, d: str) -> TrackCollection:
    return TrackCollection(s, tables.repeated_steps(s, d), tables.tracks(s, d), tables.track_chroms(s, d), repeats=True)


def chrom_union_labels(s: SparkSession, d: str) -> DataFrame:
    return _collection(s, d).chromosomes(exclude=["chrM"])


def chrom_in_all_tracks(s: SparkSession, d: str) -> DataFrame:
    return _collection(s, d).chromosomes_in_all()


def cumulative_region_index(s: SparkSession, d: str) -> DataFrame:
    return sample.cumulative_index(tables.regions(s, d).select("chrom", "start", "end"))


def epoch_batches(s: SparkSession, d: str) -> DataFrame:
    return sample.epoch_batches(tables.regions(s, d), 1000, BATCH)


def batch_assignment_drop_remainder(s: SparkSession, d: str) -> DataFrame:
    q = tables.queries(s, d).select("query_id", "chrom", "start", "end")
    return batch.batched(q, BATCH, drop_remainder=True)


def super_batch_slices(s: SparkSession, d: str) -> DataFrame:
    return batch.resliced(tables.queries(s, d).select("batch_id", "query_id"), 5)


def epoch_limit(s: SparkSession, d: str) -> DataFrame:
    return batch.epoch(batch.batched(tables.queries(s, d).select("query_id", "chrom", "start", "end"), BATCH), 2)


def query_slice(s: SparkSession, d: str) -> DataFrame:
    return batch.sliced(tables.queries(s, d), 100, 400).select("query_id", "chrom", "start", "end")


def track_subset_ordered(s: SparkSession, d: str) -> DataFrame:
    """Tracks of each query in the order it names them."""
    return val.chosen_tracks(tables.queries(s, d).select("query_id", "track_ids"), tables.tracks(s, d))


def unknown_base_fraction(s: SparkSession, d: str) -> DataFrame:
    return tables.sequences(s, d).select("doc_id", _r(sequence.unknown_fraction(F.col("sequence"))).alias("fraction"))


def filter_unknown_bases(s: SparkSession, d: str) -> DataFrame:
    return tables.sequences(s, d).where(sequence.unknown_fraction(F.col("sequence")) <= 0.915).select("doc_id", F.length("sequence").alias("n"))


def _chunked(seqs: DataFrame) -> DataFrame:
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / PIECE).cast("int")), lambda i: F.substring("sequence", i * PIECE + 1, F.lit(PIECE)))
    return seqs.select(F.col("doc_id").cast("string").alias("chrom"), F.posexplode_outer(pieces).alias("chunk", "letters"))


def sequence_slice(s: SparkSession, d: str) -> DataFrame:
    """Windows of texts read as sequences stored in chunks."""
    seqs = tables.sequences(s, d)
    first = F.pmod(F.col("doc_id") * 37, F.lit(1500))
    ranges = seqs.select(F.col("doc_id").cast("string").alias("chrom"), first.alias("start"), (first + SEQUENCE).alias("end"))
    return sequence.slices(ranges, _chunked(seqs), PIECE)


def sequence_tiles(s: SparkSession, d: str) -> DataFrame:
    """Whole texts as slices in a row, read as sequences stored in chunks."""
    seqs = tables.sequences(s, d)
    tiles = F.explode(F.sequence(F.lit(0), F.floor((F.length("sequence") - 1) / SEQUENCE))).alias("tile")
    ranges = seqs.select(F.col("doc_id").cast("string").alias("chrom"), tiles).select("chrom", (F.col("tile") * SEQUENCE).alias("start"), ((F.col("tile") + 1) * SEQUENCE).alias("end"))
    return sequence.slices(ranges, _chunked(seqs), PIECE)


def onehot_iupac(s: SparkSession, d: str) -> DataFrame:
    """Weight of each base over a whole sequence, from its one-hot rows."""
    hot = tables.sequences(s, d).select("doc_id", F.length("sequence").alias("n"), sequence.one_hot(F.col("sequence")).alias("h"))

    def total(i: int):
        return _r(F.aggregate("h", F.lit(0.0), lambda a, x: a + x[i]), 3)

    return hot.select("doc_id", "n", *[total(i).alias(b) for i, b in enumerate("acgt")])


def bfloat16_bits_of_values(s: SparkSession, d: str) -> DataFrame:
    """Values of steps as bfloat16 bit patterns."""
    rows = tables.steps(s, d).select("track_id", "chrom", "start", F.array(F.col("value").cast("float")).alias("v"))
    return rows.select("track_id", "chrom", "start", bfloat16_bits(F.col("v"))[0].alias("bits"))


def sample_positions_hash(s: SparkSession, d: str) -> DataFrame:
    return sample.positions(s, tables.regions(s, d), DRAWS, 3)


def sample_tracks_hash(s: SparkSession, d: str) -> DataFrame:
    return sample.track_subsets(tables.queries(s, d), tables.tracks(s, d), 3, 5)


def _query_batches(s: SparkSession, d: str, n: int) -> DataFrame:
    drawn = batch.windows(sample.positions(s, tables.regions(s, d), n, 3), 1000).withColumnRenamed("draw", "query_id")
    rows = batch.batched(drawn, BATCH)
    picked = sample.track_subsets(rows, tables.tracks(s, d), 3, 5)
    return rows.join(picked, "batch_id").select("batch_id", "query_id", "chrom", "start", "end", "track_ids")


def query_batches(s: SparkSession, d: str) -> DataFrame:
    """Sampled positions as numbered batches of windows, with the tracks drawn for each batch."""
    return _query_batches(s, d, DRAWS)


def query_batches_epoch(s: SparkSession, d: str) -> DataFrame:
    """The batches of a whole epoch: as many as the regions hold, all of them full."""
    return _query_batches(s, d, int(epoch_batches(s, d).first()["batches"]) * BATCH)


def invented_genome(s: SparkSession, d: str, places: DataFrame, length: int) -> DataFrame:
    """``(chrom, chunk, letters)`` of the chunks that sequences of ``length`` around the bases of places touch."""
    reach = places.select("chrom", F.greatest(F.floor((F.col("start") - length) / GENOME_CHUNK), F.lit(0)).alias("a"), F.floor((F.col("end") + length) / GENOME_CHUNK).alias("b"))
    chunks = reach.select("chrom", F.explode(F.sequence("a", "b")).alias("chunk")).distinct().join(table(s, d, "chroms").select("chrom", "chrom_rank", "chrom_size"), "chrom")
    unit = F.element_at(F.array(*[F.lit(u * GENOME_CHUNK) for u in UNITS]), (F.pmod(sample.mixed(F.col("chrom_rank") * 1_000_003 + F.col("chunk"), 7), F.lit(len(UNITS))) + 1).cast("int"))
    n = F.least(F.lit(GENOME_CHUNK), F.col("chrom_size") - F.col("chunk") * GENOME_CHUNK).cast("int")
    return chunks.where(n > 0).select("chrom", "chunk", F.substring(unit, F.lit(1), n).alias("letters"))


def training_epoch(s: SparkSession, d: str) -> DataFrame:
    """A whole epoch of the training pipeline: positions, sequences, tracks of each batch and their windowed means, flattened."""
    regions = tables.regions(s, d)
    parts = _collection(s, d), regions, invented_genome(s, d, regions, EPOCH_LENGTH)
    rows = training_table(*parts, GENOME_CHUNK, EPOCH_LENGTH, EPOCH_CROP, WINDOW, batch_size=BATCH, sequence_encoder=None, sub_sample_tracks=3, seed=3)
    return rows.withColumn("values", F.transform(F.flatten("values"), lambda x: F.round(x.cast("double"), 3)))


def training_epoch_given(s: SparkSession, d: str) -> DataFrame:
    """The pipeline over given positions, as numbered there, and given tracks for each batch; those of short or unknown sequences go."""
    given = tables.positions(s, d).withColumnRenamed("position_id", "draw")
    reach = given.select("chrom", F.col("center").alias("start"), (F.col("center") + 1).alias("end"))
    batches = s.range(GIVEN_BATCHES).select(F.col("id").alias("batch_id"), F.array(F.pmod("id", F.lit(3)), F.pmod("id", F.lit(3)) + 3).cast("array<int>").alias("track_ids"))
    rows = training_table(
        _collection(s, d), tables.regions(s, d), invented_genome(s, d, reach, EPOCH_LENGTH), GENOME_CHUNK, EPOCH_LENGTH, EPOCH_CROP, WINDOW, batch_size=BATCH, batches_per_epoch=GIVEN_BATCHES,
        sequence_encoder=None, positions=given, track_subsets=batches,
    )
    return rows.drop("sequence").withColumn("values", F.transform(F.flatten("values"), lambda x: F.round(x.cast("double"), 3)))


_written: dict[tuple[str, str], str] = {}


def _files(s: SparkSession, d: str) -> str:
    """A folder with the steps of each track in a file of its own, written once a session."""
    key = s.sparkContext.applicationId, d
    if key not in _written or not os.path.isdir(_written[key]):
        sizes = {r.chrom: r.chrom_size for r in table(s, d, "chroms").select("chrom", "chrom_size").collect()}
        folder = new_folder(s, "tracks")
        write_tracks(tables.steps(s, d), sizes, folder, zooms=(ZOOM,)).collect()
        _written[key] = folder
    return _written[key]


def _file_table(s: SparkSession, d: str, name: str) -> DataFrame:
    """A table about the files; tracks by the number in their file's name."""
    bigwig.register(s)
    path = s.read.format("bigwig").option("table", "files").load(_files(s, d)).select("track_id", F.regexp_extract("path", r"track_(\d+)", 1).cast("int").alias("__t"))
    return s.read.format("bigwig").option("table", name).load(_files(s, d)).join(path, "track_id").drop("track_id").withColumnRenamed("__t", "track_id")


def file_headers(s: SparkSession, d: str) -> DataFrame:
    """Version, number of zoom levels and summary in each file's header."""
    return _file_table(s, d, "files").select("track_id", "version", "zoom_levels", "bases_covered", "min_value", "max_value", _r("sum_values", 2).alias("sum_values"))


def file_chroms(s: SparkSession, d: str) -> DataFrame:
    return _file_table(s, d, "chroms").select("track_id", "chrom", "chrom_size")


def file_chunks(s: SparkSession, d: str) -> DataFrame:
    """The stretch that the chunks of each track and chromosome cover, and whether they follow one another."""
    earlier = Window.partitionBy("track_id", "chrom").orderBy("data_offset").rowsBetween(Window.unboundedPreceding, -1)
    chunks = _file_table(s, d, "chunks").withColumn("follows", F.coalesce(F.max("end").over(earlier) <= F.col("start"), F.lit(True)))
    return chunks.groupBy("track_id", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.every("follows").alias("in_order"))


def file_zooms(s: SparkSession, d: str) -> DataFrame:
    """Cells of the zoom level stored in the files."""
    cells = _file_table(s, d, "zoom_records").where(F.col("level") == ZOOM)
    return cells.select("track_id", "chrom", F.floor(F.col("start") / ZOOM).alias("cell"), "valid_count", "min_value", "max_value")


def file_zoom_levels(s: SparkSession, d: str) -> DataFrame:
    return _file_table(s, d, "zooms").select("track_id", "level")


def found_files(s: SparkSession, d: str) -> DataFrame:
    """Files found in a folder, by name."""
    return s.createDataFrame([(p.rsplit("/", 1)[1],) for p in find_files(_files(s, d))], "name string")


def file_collection(s: SparkSession, d: str) -> TrackCollection:
    """The files as a collection whose tracks have the numbers in their names."""
    return TrackCollection.open(s, _files(s, d))


def values_from_files(s: SparkSession, d: str) -> DataFrame:
    """The value at each base of each query, from the chunks of the files that queries touch."""
    return file_collection(s, d).values(tables.queries(s, d)).select("query_id", "track_id", "values")


def values_from_tiles(s: SparkSession, d: str) -> DataFrame:
    """Windowed means from steps stored by tiles, of which those that queries touch are read."""
    folder, whole = new_folder(s, "tiles"), TrackCollection(s, tables.steps(s, d), tables.tracks(s, d), tables.track_chroms(s, d))
    whole.store(folder)
    return _long(TrackCollection.stored(s, folder, whole.tracks, whole.chroms).values(tables.queries(s, d), WINDOW))


def tsv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Regions written as tab-separated text and read again."""
    folder = f"{new_folder(s, 'tsv')}/regions"
    write_tsv(tables.regions(s, d), folder)
    return read_tsv(s, folder, "interval_id long, chrom string, start long, end long")


def onehot_lenient(s: SparkSession, d: str) -> DataFrame:
    """Weight of each base over a text taken as it is, with zeros for letters that are no base, lower-case ones included."""
    hot = table(s, d, "documents").where(F.length("text") > 0).select("doc_id", sequence.one_hot(F.col("text"), strict=False).alias("h"))

    def total(i: int):
        return _r(F.aggregate("h", F.lit(0.0), lambda a, x: a + x[i]), 3)

    return hot.select("doc_id", *[total(i).alias(b) for i, b in enumerate("acgt")])


def letter_places(s: SparkSession, d: str) -> DataFrame:
    """How often each place of the alphabet occurs in the sequences."""
    letters = tables.sequences(s, d).select(F.explode(F.split("sequence", "")).alias("letter"))
    return letters.groupBy("letter").agg(F.count(F.lit(1)).alias("n")).select(sequence.letter_index(F.col("letter")).alias("place"), "n")


def whole_sequences(s: SparkSession, d: str) -> DataFrame:
    """Tiles of texts that are whole and known well enough; the shorter last ones go."""
    return sequence.known_enough(sequence_tiles(s, d), SEQUENCE, 0.915).select("chrom", "start", "end")


def registered_encoder(s: SparkSession, d: str) -> DataFrame:
    """Sequences encoded by a function of that name."""
    register_encoder("backwards", F.reverse)
    return encoded(tables.sequences(s, d), "backwards")


def queries_from_mapping(s: SparkSession, d: str) -> DataFrame:
    """Queries made of lists of chromosomes, starts and ends."""
    rows = table(s, d, "chroms").orderBy("chrom_rank").collect()
    return batch.queries_from(s, {"chromosomes": [r.chrom for r in rows], "starts": [5 for _ in rows], "ends": [r.chrom_size // 2 for r in rows]})


def query_length(s: SparkSession, d: str) -> DataFrame:
    """The one length that all queries have."""
    return s.createDataFrame([(val.require_equal_lengths(tables.queries(s, d)),)], "length long")


def repeat_same_positions(s: SparkSession, d: str) -> DataFrame:
    """The same positions drawn again and again."""
    return sample.positions(s, tables.regions(s, d), DRAWS, 3, repeat_same=SAME)


def ambiguous_stems(s: SparkSession, d: str) -> DataFrame:
    """Names of tracks, without folder and suffix, that several have."""
    return distinct_stems(tables.tracks(s, d))


def bigwig_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Steps written to one file per track and read again."""
    bigwig.register(s)
    return s.read.format("bigwig").load(_files(s, d)).withColumn("value", F.col("value").cast("double"))


def fasta_scan(s: SparkSession, d: str) -> DataFrame:
    """Sequences written as text files and read in chunks."""
    fasta.register(s)
    folder = new_folder(s, "sequences")
    fasta.write_sequences(tables.sequences(s, d).select(F.col("doc_id").cast("string").alias("chrom"), "sequence"), folder).collect()
    return s.read.format("fasta").option("chunk_size", PIECE).option("partition_chunks", 8192).load(folder)


def stream_query_batches(s: SparkSession, d: str) -> DataFrame:
    """Windowed means of the queries, answered in micro-batches."""
    out, state = new_folder(s, "answers"), new_folder(s, "state")
    stream.answer(stream.read_queries(s, f"{d}/stream_queries.parquet"), _collection(s, d), out, state, WINDOW).awaitTermination()
    rows = stream.answers(s, out).select("batch_id", "query_id", "track_id", F.posexplode("values").alias("bin", "v"))
    return rows.select("batch_id", "query_id", "track_id", "bin", _r("v").alias("value"))


def late_queries(s: SparkSession, d: str) -> DataFrame:
    return stream.late(tables.queries(s, d), 1).select("batch_id", "query_id")


_STEPS = """s0 AS (SELECT DISTINCT track_id, chrom, start, "end", value, run_day FROM track_intervals WHERE track_id IS NOT NULL AND chrom IS NOT NULL AND start IS NOT NULL
  AND "end" IS NOT NULL AND run_day IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND "end" > start),
s AS (SELECT track_id, chrom, start, "end", CAST(value AS DOUBLE) AS value FROM s0)"""
_SCALED = """sc AS (SELECT s.track_id, chrom, start, "end", value * CASE WHEN scale IS NULL OR isnan(scale) THEN 1.0 ELSE scale END AS value FROM s LEFT JOIN tracks t ON s.track_id = t.track_id)"""
_NAMES = """n AS (SELECT chrom, lower(trim(chrom, ' ' || chr(9))) AS k FROM chroms UNION SELECT chrom, lower(trim(alt_name, ' ' || chr(9))) FROM chroms)"""
_REGIONS = f"""{_NAMES}, r AS (SELECT interval_id, n.chrom, start, "end" FROM some_intervals i JOIN n ON lower(trim(i.chr, ' ' || chr(9))) = n.k WHERE "end" > start)"""
_POSITIONS = f"""{_NAMES}, p AS (SELECT position_id, n.chrom, center FROM some_positions i JOIN n ON lower(trim(i.chr, ' ' || chr(9))) = n.k WHERE center IS NOT NULL)"""
_OFFSETS = """o AS (SELECT chrom, chrom_size, CAST(coalesce(sum(chrom_size) OVER (ORDER BY chrom_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chrom_offset FROM chroms)"""
_SEQ = """q AS (SELECT doc_id, regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^ACGTRYKMSWBDHVN]', 'N', 'g') AS sequence FROM documents WHERE length(text) > 0)"""


def _merge(src: str, name: str, by: str, gap: int) -> str:
    """CTEs that merge ``src`` into ``name``."""
    return f"""{name}_a AS (SELECT *, max("end") OVER (PARTITION BY {by} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src}),
{name}_b AS (SELECT *, sum(CASE WHEN start <= pe + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY start, "end", pe NULLS FIRST ROWS UNBOUNDED PRECEDING) AS g FROM {name}_a),
{name} AS (SELECT {by}, min(start) AS start, max("end") AS "end", max(value) AS value FROM {name}_b GROUP BY {by}, g)"""


def _holes(buffer: int) -> str:
    return f"""bl AS (SELECT chrom, greatest(start - {buffer}, 0) AS start, "end" + {buffer} AS "end", 0 AS value FROM blacklist),
{_merge("bl", "hole", "chrom", 0)}"""


def _subtract(src: str, name: str, cols: str) -> str:
    return f"""{name}_i AS (SELECT row_number() OVER () AS id, * FROM {src}),
{name}_h AS (SELECT i.*, h.start AS hs, h."end" AS he FROM {name}_i i JOIN hole h ON i.chrom = h.chrom AND i.start < h."end" AND h.start < i."end"),
{name}_p AS (SELECT {cols}, coalesce(lag(he) OVER (PARTITION BY id ORDER BY hs), start) AS ps, hs AS pe FROM {name}_h
  UNION ALL SELECT {cols}, max(he) OVER (PARTITION BY id) AS ps, "end" AS pe FROM {name}_h QUALIFY row_number() OVER (PARTITION BY id ORDER BY hs) = 1
  UNION ALL SELECT {cols}, start, "end" FROM {name}_i WHERE id NOT IN (SELECT id FROM {name}_h)),
{name} AS (SELECT {cols}, ps AS start, pe AS "end" FROM {name}_p WHERE ps < pe)"""


def _windows(w: int, scaled: bool = False) -> str:
    """CTEs up to ``c``: query, track, bin, total and covered, uncovered windows included."""
    src = "sc" if scaled else "s"
    return f"""WITH {_STEPS}{", " + _SCALED if scaled else ""}, qt AS (SELECT query_id, chrom, start, "end", unnest(coalesce(track_ids, (SELECT list(track_id ORDER BY track_id) FROM tracks))) AS track_id FROM stream_queries),
grid AS (SELECT *, unnest(range(CAST(("end" - start) // {w} AS BIGINT))) AS bin FROM qt),
hit AS (SELECT qt.query_id, qt.track_id, qt.start AS q0, greatest(x.start, qt.start) AS lo, least(x."end", qt."end") AS hi, x.value FROM qt JOIN {src} x ON x.track_id = qt.track_id AND x.chrom = qt.chrom AND x.start < qt."end" AND x."end" > qt.start),
cut AS (SELECT *, unnest(range((lo - q0) // {w}, (hi - 1 - q0) // {w} + 1)) AS bin FROM hit),
cell AS (SELECT query_id, track_id, bin, sum(value * (least(hi, q0 + (bin + 1) * {w}) - greatest(lo, q0 + bin * {w}))) AS total, sum(least(hi, q0 + (bin + 1) * {w}) - greatest(lo, q0 + bin * {w})) AS covered FROM cut GROUP BY ALL),
c AS (SELECT g.query_id, g.track_id, g.bin, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered FROM grid g LEFT JOIN cell ON g.query_id = cell.query_id AND g.track_id = cell.track_id AND g.bin = cell.bin)"""


def _mean(default: float) -> str:
    return f"round((total + ({WINDOW} - covered) * {default}) / {WINDOW}, 6)"


def _smooth(back: int, ahead: int) -> str:
    return f"""{_windows(WINDOW)}, m AS (SELECT query_id, track_id, bin, (total + ({WINDOW} - covered) * 0.0) / {WINDOW} AS v FROM c)
SELECT query_id, track_id, bin, round(sum(v) OVER (PARTITION BY query_id, track_id ORDER BY bin ROWS BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) / {back + ahead + 1}, 6) AS value FROM m"""


def _search(op: str, absolute: bool = False) -> str:
    first = "+ coalesce((SELECT sum(k) FROM z WHERE z.seg < a.seg), 0)" if absolute else ""
    return f"""WITH {_STEPS}, {_POSITIONS}, v AS (SELECT concat(track_id, ':', chrom) AS seg, start FROM s), z AS (SELECT seg, count(*) AS k FROM v GROUP BY seg),
a AS (SELECT position_id, track_id, center, concat(track_id, ':', chrom) AS seg FROM p, (SELECT DISTINCT track_id FROM tracks)),
f AS (SELECT a.position_id, a.track_id, a.center, a.seg, count(v.start) AS k FROM a LEFT JOIN v ON a.seg = v.seg AND v.start {op} a.center GROUP BY ALL)
SELECT position_id, track_id, center, CAST(k {first} AS BIGINT) AS position FROM f a"""


def _mixed(x: str, seed: int) -> str:
    m, a, c = sample.MODULUS, sample.FACTOR, sample.STEP
    once = f"(((({x}) % {m}) * {a} + {c + seed}) % {m})"
    twice = f"((({once} // 65536 + ({once} % 65536) * 32768) * {a} + {c}) % {m})"
    return f"(({twice} // 4096 + ({twice} % 4096) * 524288) % {m})"


_CUM = f"""{_REGIONS}, ci AS (SELECT chrom, start, "end", CAST(coalesce(sum("end" - start) OVER (ORDER BY chrom, start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_start FROM r),
cx AS (SELECT *, cum_start + "end" - start AS cum_end FROM ci)"""
_DRAWN = f"""{_CUM}, dr AS (SELECT i AS draw, ({_mixed("i", 3)} * {sample.MODULUS} + {_mixed(f"i + {sample.SECOND}", 4)}) % (SELECT max(cum_end) FROM cx) AS rr FROM range({DRAWS}) t(i)),
dp AS (SELECT draw, chrom, start + rr - cum_start AS center FROM dr JOIN cx ON rr >= cum_start AND rr < cum_end)"""
_PICK = f"(SELECT list(t ORDER BY t) FROM (SELECT track_id AS t FROM tracks ORDER BY {_mixed('track_id * 7919 + b.batch_id * 104729', 5)}, track_id LIMIT 3))"


def _chunk(at: str) -> str:
    kinds = ", ".join(f"'{u}'" for u in UNITS)
    return f"substr(repeat([{kinds}][CAST({_mixed(f'chrom_rank * 1000003 + {at}', 7)} % {len(UNITS)} + 1 AS INTEGER)], {GENOME_CHUNK}), 1, greatest(least({GENOME_CHUNK}, chrom_size - ({at}) * {GENOME_CHUNK}), 0))"


def _training_epoch() -> str:
    """Draws 64 numbers for each sequence needed, far more than are rejected; takes the first that can be used."""
    half = EPOCH_LENGTH // 2
    pick = f"(SELECT list(t ORDER BY t) FROM (SELECT track_id AS t FROM tracks ORDER BY {_mixed('track_id * 7919 + b.batch_id * 104729', 3)}, track_id LIMIT 3))"
    return f"""WITH {_STEPS}, {_CUM}, ep AS (SELECT CAST(sum("end" - start) AS BIGINT) // {EPOCH_LENGTH} // {BATCH} * {BATCH} AS need, CAST(sum("end" - start) AS BIGINT) AS total FROM r),
di AS (SELECT unnest(range(need * 64)) AS i, total FROM ep), dr AS (SELECT i AS draw, ({_mixed("i", 3)} * {sample.MODULUS} + {_mixed(f"i + {sample.SECOND}", 4)}) % total AS rr FROM di),
dp AS (SELECT draw, cx.chrom, start + rr - cum_start AS center, chrom_rank, chrom_size, start + rr - cum_start - {half} AS a FROM dr JOIN cx ON rr >= cum_start AND rr < cum_end JOIN chroms ON cx.chrom = chroms.chrom),
{_epoch_values(pick)}"""


def _training_epoch_given() -> str:
    """Positions as they are numbered; tracks of a batch by its number."""
    return f"""WITH {_STEPS}, {_POSITIONS}, ep AS (SELECT {GIVEN_BATCHES * BATCH} AS need),
dp AS (SELECT position_id AS draw, p.chrom, center, chrom_rank, chrom_size, center - {EPOCH_LENGTH // 2} AS a FROM p JOIN chroms ON p.chrom = chroms.chrom),
{_epoch_values("CAST([b.batch_id % 3, b.batch_id % 3 + 3] AS INTEGER[])").replace(", sequence, track_ids, list(", ", track_ids, list(")}"""


def _epoch_values(pick: str) -> str:
    """From drawn positions with the start of their sequences: those that can be used, in batches, with their tracks' values."""
    crop, bins = EPOCH_CROP // 2, EPOCH_CROP // WINDOW
    return f"""ds AS (SELECT draw, chrom, center, substr({_chunk(f"a // {GENOME_CHUNK}")} || {_chunk(f"a // {GENOME_CHUNK} + 1")}, a % {GENOME_CHUNK} + 1, {EPOCH_LENGTH}) AS sequence FROM dp WHERE a >= 0),
dk AS (SELECT *, row_number() OVER (ORDER BY draw) - 1 AS n FROM ds WHERE length(sequence) = {EPOCH_LENGTH} AND length(regexp_replace(sequence, '[ACGT]', '', 'g')) <= 0.1 * {EPOCH_LENGTH}),
w AS (SELECT *, n // {BATCH} AS batch_id FROM dk WHERE n < (SELECT need FROM ep)), b AS (SELECT DISTINCT batch_id FROM w), pk AS (SELECT batch_id, {pick} AS track_ids FROM b),
qt AS (SELECT w.*, track_ids, unnest(track_ids) AS track_id FROM w JOIN pk ON w.batch_id = pk.batch_id), grid AS (SELECT *, unnest(range({bins})) AS bin FROM qt),
gb AS (SELECT *, center - {crop} + bin * {WINDOW} AS lo, center - {crop} + (bin + 1) * {WINDOW} AS hi FROM grid),
hit AS (SELECT draw, gb.track_id, bin, sum(value * (least(hi, s."end") - greatest(lo, s.start))) AS total FROM gb JOIN s ON s.track_id = gb.track_id AND s.chrom = gb.chrom AND s.start < hi AND s."end" > lo GROUP BY ALL)
SELECT batch_id, gb.draw AS query_id, chrom, center, sequence, track_ids, list(round(CAST(CAST(coalesce(total, 0) / {WINDOW} AS FLOAT) AS DOUBLE), 3) ORDER BY gb.track_id, gb.bin) AS values
FROM gb LEFT JOIN hit ON gb.draw = hit.draw AND gb.track_id = hit.track_id AND gb.bin = hit.bin GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    merge_out = 'SELECT chrom, start, "end" FROM m'
    path_keys = ", ".join(f"('{k}', {v})" for k, v in KEYS)
    iupac = {b: " + ".join(f"{w[i]} * (n - length(replace(sequence, '{letter}', '')))" for letter, w in sequence.ONE_HOT.items() if w[i]) for i, b in enumerate("acgt")}
    return {
        "track_scan": f"WITH {_STEPS} SELECT * FROM s",
        "chrom_include_exclude": f"WITH {_STEPS} SELECT chrom, count(*) AS n FROM s WHERE regexp_matches(chrom, '^chr([1-9]|1[0-9]|2[0-2])$') GROUP BY chrom",
        "standard_chromosomes": "SELECT chrom, regexp_matches(chrom, '^chr([1-9]|1[0-9]|2[0-2]|X|Y|M)$') AS is_standard FROM chroms",
        "threshold_strict": f"WITH {_STEPS} SELECT * FROM s WHERE value > 5",
        "scale_then_threshold": f"WITH {_STEPS}, {_SCALED} SELECT track_id, count(*) AS n, min(value) AS low, max(value) AS high FROM sc WHERE value > 10 GROUP BY track_id",
        "scale_by_path_key": f"""WITH k(key, scale) AS (VALUES {path_keys}), t AS (SELECT track_id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM tracks),
e AS (SELECT *, unnest(range(1, len(parts) + 1)) AS last FROM t), f AS (SELECT *, unnest(range(1, last + 1)) AS first FROM e),
c AS (SELECT track_id, last, first, array_to_string(parts[first:last], '/') AS run, 0 AS bare FROM f UNION ALL SELECT track_id, last, first, regexp_replace(array_to_string(parts[first:last], '/'), '\\.[^./]*$', ''), 1 FROM f WHERE last = len(parts)),
b AS (SELECT c.track_id, arg_min(CAST(k.scale AS DOUBLE), (-c.last, c.first, c.bare)) AS scale FROM c JOIN k ON c.run = k.key GROUP BY c.track_id)
SELECT t.track_id, t.path, coalesce(b.scale, 1.0) AS scale FROM t LEFT JOIN b ON t.track_id = b.track_id""",
        "pad_intervals": f'WITH {_REGIONS} SELECT interval_id, chrom, greatest(start - 20000, 0) AS start, "end" + 20000 AS "end" FROM r',
        "first_n_tracks": f"WITH {_STEPS} SELECT * FROM s WHERE track_id < 3",
        "chrom_max_size": "SELECT chrom, chrom_size FROM chroms WHERE chrom IN (SELECT chrom FROM track_intervals)",
        "chrom_offsets": f"WITH {_OFFSETS} SELECT * FROM o",
        "global_position": f"WITH {_POSITIONS}, {_OFFSETS} SELECT position_id, p.chrom, center, center + chrom_offset AS global_position FROM p JOIN o ON p.chrom = o.chrom",
        "center_crop": f'WITH {_POSITIONS} SELECT position_id, chrom, center, center - 100 AS start, center + 101 AS "end" FROM p',
        "overlap_join": f"""WITH {_STEPS}, {_REGIONS} SELECT interval_id, track_id, s.chrom, s.start, s."end", least(s."end", r."end") - greatest(s.start, r.start) AS shared
FROM r JOIN s ON r.chrom = s.chrom AND s.start < r."end" AND s."end" > r.start""",
        "chunk_prune_semi": f"""WITH {_STEPS}, h AS (SELECT track_id, chrom, start // 100000 AS chunk, min(start) AS start, max("end") AS "end" FROM s GROUP BY ALL)
SELECT * FROM h WHERE EXISTS (SELECT 1 FROM stream_queries q WHERE q.chrom = h.chrom AND h.start < q."end" AND h."end" > q.start)""",
        "segmented_searchsorted_left": _search("<"),
        "segmented_searchsorted_right": _search("<="),
        "searchsorted_absolute": _search("<", True),
        "merge_gap0": f"WITH {_REGIONS}, rv AS (SELECT *, 0 AS value FROM r), {_merge('rv', 'm', 'chrom', 0)} {merge_out}",
        "merge_gap_n": f"WITH {_STEPS}, {_merge('s', 'm', 'track_id, chrom', 50)} SELECT * FROM m",
        "merge_cross_track": f"WITH {_STEPS}, {_merge('s', 'm', 'chrom', 0)} SELECT * FROM m",
        "subtract_blacklist": f"WITH {_REGIONS}, {_holes(0)}, {_subtract('r', 'x', 'interval_id, chrom')} SELECT * FROM x",
        "subtract_blacklist_buffer": f"WITH {_STEPS}, {_holes(1000)}, {_subtract('s', 'x', 'track_id, chrom, value')} SELECT * FROM x",
        "intervals_pipeline": f"""WITH {_STEPS}, {_SCALED}, k AS (SELECT * FROM sc WHERE value > 5 AND regexp_matches(chrom, '^chr([1-9]|1[0-9]|2[0-2]|X|Y)$')),
{_merge("k", "m1", "track_id, chrom", 10)}, {_holes(100)}, {_subtract("m1", "x1", "track_id, chrom, value")},
pd AS (SELECT chrom, greatest(start - 50, 0) AS start, "end" + 50 AS "end", value FROM x1), {_merge("pd", "m2", "chrom", 10)}, {_subtract("m2", "x2", "chrom, value")} SELECT * FROM x2""",
        "track_summary": f"""WITH {_STEPS} SELECT track_id, CAST(sum("end" - start) AS BIGINT) AS bases_covered, min(value) AS min_value, max(value) AS max_value,
round(sum(value * ("end" - start)), 2) AS sum_values, round(sum(value * value * ("end" - start)) / sum("end" - start), 3) AS sum_squares FROM s GROUP BY track_id""",
        "zoom_summary": f"""WITH {_STEPS}, z AS (SELECT *, unnest(range(start // 10000, ("end" - 1) // 10000 + 1)) AS cell FROM s), y AS (SELECT track_id, chrom, cell, value, least("end", (cell + 1) * 10000) - greatest(start, cell * 10000) AS n FROM z)
SELECT track_id, chrom, cell, CAST(sum(n) AS BIGINT) AS valid_count, min(value) AS min_value, max(value) AS max_value, round(sum(value * n), 3) AS sum_values, round(sum(value * value * n) / sum(n), 3) AS sum_squares FROM y GROUP BY ALL""",
        "segment_starts": f"WITH {_STEPS}, z AS (SELECT track_id, count(*) AS size FROM s GROUP BY track_id) SELECT track_id, size, CAST(coalesce(sum(size) OVER (ORDER BY track_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM z",
        "overlapping_steps": f"""WITH {_STEPS}, u AS (SELECT DISTINCT track_id, chrom, start, "end" FROM s) SELECT DISTINCT b.track_id, b.chrom, b.start, b."end" FROM u a JOIN u b
ON a.track_id = b.track_id AND a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" AND (b.start > a.start OR (b.start = a.start AND b."end" > a."end"))""",
        "values_per_base": f"{_windows(1)} SELECT query_id, track_id, list(total ORDER BY bin) AS values FROM c GROUP BY ALL",
        "window_mean_default0": f"{_windows(WINDOW)} SELECT query_id, track_id, CAST(bin AS INTEGER) AS bin, {_mean(0.0)} AS value FROM c",
        "window_mean_default_const": f"{_windows(WINDOW)} SELECT query_id, track_id, CAST(bin AS INTEGER) AS bin, {_mean(2.5)} AS value FROM c",
        "window_nanmean": f"{_windows(WINDOW)} SELECT query_id, track_id, CAST(bin AS INTEGER) AS bin, CASE WHEN covered > 0 THEN round(total / covered, 6) END AS value FROM c",
        "window_mean_scaled": f"{_windows(WINDOW, True)} SELECT query_id, track_id, CAST(bin AS INTEGER) AS bin, {_mean(2.5)} AS value FROM c",
        "dense_batch_array": f"""{_windows(WINDOW)}, o AS (SELECT query_id, unnest(t) AS track_id, generate_subscripts(t, 1) AS k FROM (SELECT query_id, coalesce(track_ids, (SELECT list(track_id ORDER BY track_id) FROM tracks)) AS t FROM stream_queries))
SELECT c.query_id, list({_mean(0.0)} ORDER BY bin, k) AS values FROM c JOIN o ON c.query_id = o.query_id AND c.track_id = o.track_id GROUP BY c.query_id""",
        "moving_average_odd": _smooth(1, 1).replace("track_id, bin, round(sum", "track_id, CAST(bin AS INTEGER) AS bin, round(sum"),
        "moving_average_even": _smooth(2, 1).replace("track_id, bin, round(sum", "track_id, CAST(bin AS INTEGER) AS bin, round(sum"),
        "chrom_sort": "SELECT chrom, chrom_rank AS place FROM chroms",
        "sort_intervals": f"""WITH {_REGIONS} SELECT interval_id, r.chrom, start, "end", lag(interval_id) OVER (ORDER BY chrom_rank, start, "end", interval_id) AS before FROM r JOIN chroms ON r.chrom = chroms.chrom""",
        "chrom_union_labels": "SELECT DISTINCT concat(i.chrom, '_', t.stem) AS label FROM track_intervals i JOIN tracks t ON i.track_id = t.track_id JOIN chroms c ON i.chrom = c.chrom WHERE i.chrom <> 'chrM'",
        "chrom_in_all_tracks": "SELECT i.chrom FROM track_intervals i JOIN chroms c ON i.chrom = c.chrom GROUP BY i.chrom HAVING count(DISTINCT track_id) = (SELECT count(DISTINCT track_id) FROM tracks)",
        "cumulative_region_index": f"WITH {_CUM} SELECT * FROM cx",
        "epoch_batches": f'WITH {_REGIONS} SELECT CAST(sum("end" - start) AS BIGINT) AS total_length, CAST(sum("end" - start) AS BIGINT) // 1000 // {BATCH} AS batches FROM r',
        "batch_assignment_drop_remainder": f"""WITH a AS (SELECT query_id, chrom, start, "end", (row_number() OVER (ORDER BY query_id) - 1) // {BATCH} AS batch_id FROM stream_queries)
SELECT * FROM a WHERE batch_id < (SELECT count(*) // {BATCH} FROM stream_queries)""",
        "super_batch_slices": """WITH a AS (SELECT batch_id, query_id, count(*) OVER (PARTITION BY batch_id) AS n, row_number() OVER (PARTITION BY batch_id ORDER BY query_id) - 1 AS i FROM stream_queries)
SELECT batch_id, query_id, i // least(5, n) AS slice_id FROM a WHERE i // least(5, n) < n // least(5, n)""",
        "epoch_limit": f"""WITH a AS (SELECT query_id, chrom, start, "end", (row_number() OVER (ORDER BY query_id) - 1) // {BATCH} AS batch_id FROM stream_queries) SELECT * FROM a WHERE batch_id < 2""",
        "query_slice": 'SELECT query_id, chrom, start, "end" FROM stream_queries WHERE query_id >= 100 AND query_id < 400',
        "track_subset_ordered": """SELECT query_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS track_no, unnest(t) AS track_id FROM (SELECT query_id, coalesce(track_ids, (SELECT list(track_id ORDER BY track_id) FROM tracks)) AS t FROM stream_queries)""",
        "unknown_base_fraction": f"WITH {_SEQ} SELECT doc_id, round(length(regexp_replace(sequence, '[ACGT]', '', 'g')) / length(sequence), 6) AS fraction FROM q",
        "filter_unknown_bases": f"WITH {_SEQ} SELECT doc_id, CAST(length(sequence) AS INTEGER) AS n FROM q WHERE length(regexp_replace(sequence, '[ACGT]', '', 'g')) / length(sequence) <= 0.915",
        "sequence_slice": f"WITH {_SEQ} SELECT CAST(doc_id AS VARCHAR) AS chrom, doc_id * 37 % 1500 AS start, doc_id * 37 % 1500 + {SEQUENCE} AS \"end\", substr(sequence, doc_id * 37 % 1500 + 1, {SEQUENCE}) AS sequence FROM q",
        "onehot_iupac": f"WITH {_SEQ}, l AS (SELECT *, CAST(length(sequence) AS INTEGER) AS n FROM q) SELECT doc_id, n, " + ", ".join(f"CAST(round({e}, 3) AS DOUBLE) AS {b}" for b, e in iupac.items()) + " FROM l",
        "sample_positions_hash": f"WITH {_DRAWN} SELECT * FROM dp",
        "sample_tracks_hash": f"SELECT batch_id, {_PICK} AS track_ids FROM (SELECT DISTINCT batch_id FROM stream_queries) b",
        "bigwig_roundtrip": f"WITH {_STEPS} SELECT * FROM s",
        "fasta_scan": f"WITH {_SEQ}, k AS (SELECT doc_id, sequence, unnest(range((length(sequence) - 1) // {PIECE} + 1)) AS chunk FROM q) SELECT CAST(doc_id AS VARCHAR) AS chrom, CAST(chunk AS INTEGER) AS chunk, substr(sequence, chunk * {PIECE} + 1, {PIECE}) AS letters FROM k",
        "stream_query_batches": f"{_windows(WINDOW)} SELECT q.batch_id, c.query_id, track_id, CAST(bin AS INTEGER) AS bin, {_mean(0.0)} AS value FROM c JOIN stream_queries q ON c.query_id = q.query_id",
        "late_queries": "SELECT batch_id, query_id FROM (SELECT *, min(received_at) OVER (PARTITION BY batch_id) AS f FROM stream_queries) WHERE received_at > f + INTERVAL 1 MINUTE",
        "query_batches": f"""WITH {_DRAWN}, w AS (SELECT draw AS query_id, chrom, center - 500 AS start, center + 500 AS "end", draw // {BATCH} AS batch_id FROM dp), b AS (SELECT DISTINCT batch_id FROM w), pk AS (SELECT batch_id, {_PICK} AS track_ids FROM b)
SELECT w.batch_id, query_id, chrom, start, "end", track_ids FROM w JOIN pk ON w.batch_id = pk.batch_id""",
        "query_batches_epoch": f"""WITH {_CUM}, di AS (SELECT unnest(range(CAST(sum("end" - start) AS BIGINT) // 1000 // {BATCH} * {BATCH})) AS i, CAST(sum("end" - start) AS BIGINT) AS total FROM r),
dr AS (SELECT i AS draw, ({_mixed("i", 3)} * {sample.MODULUS} + {_mixed(f"i + {sample.SECOND}", 4)}) % total AS rr FROM di),
w AS (SELECT draw AS query_id, chrom, start + rr - cum_start - 500 AS start, start + rr - cum_start + 500 AS "end", draw // {BATCH} AS batch_id FROM dr JOIN cx ON rr >= cum_start AND rr < cum_end),
b AS (SELECT DISTINCT batch_id FROM w), pk AS (SELECT batch_id, {_PICK} AS track_ids FROM b)
SELECT w.batch_id, query_id, chrom, start, "end", track_ids FROM w JOIN pk ON w.batch_id = pk.batch_id""",
        "sequence_tiles": f"""WITH {_SEQ}, k AS (SELECT *, unnest(range((length(sequence) - 1) // {SEQUENCE} + 1)) AS tile FROM q)
SELECT CAST(doc_id AS VARCHAR) AS chrom, tile * {SEQUENCE} AS start, (tile + 1) * {SEQUENCE} AS "end", substr(sequence, tile * {SEQUENCE} + 1, {SEQUENCE}) AS sequence FROM k""",
        "training_epoch": _training_epoch(),
        "training_epoch_given": _training_epoch_given(),
        "values_from_files": f"{_windows(1)} SELECT query_id, track_id, list(total ORDER BY bin) AS values FROM c GROUP BY ALL",
        "values_from_tiles": f"{_windows(WINDOW)} SELECT query_id, track_id, CAST(bin AS INTEGER) AS bin, {_mean(0.0)} AS value FROM c",
        "file_headers": f"""WITH {_STEPS} SELECT track_id, 4 AS version, 1 AS zoom_levels, CAST(sum("end" - start) AS BIGINT) AS bases_covered, min(value) AS min_value, max(value) AS max_value,
round(sum(value * ("end" - start)), 2) AS sum_values FROM s GROUP BY track_id""",
        "file_chroms": f"WITH {_STEPS} SELECT track_id, chrom, chrom_size FROM (SELECT DISTINCT track_id FROM s), chroms",
        "file_chunks": f"""WITH {_STEPS} SELECT track_id, chrom, min(start) AS start, max("end") AS "end", true AS in_order FROM s GROUP BY track_id, chrom""",
        "file_zooms": f"""WITH {_STEPS}, z AS (SELECT *, unnest(range(start // {ZOOM}, ("end" - 1) // {ZOOM} + 1)) AS cell FROM s)
SELECT track_id, chrom, cell, CAST(sum(least("end", (cell + 1) * {ZOOM}) - greatest(start, cell * {ZOOM})) AS BIGINT) AS valid_count, min(value) AS min_value, max(value) AS max_value FROM z GROUP BY ALL""",
        "file_zoom_levels": f"WITH {_STEPS} SELECT DISTINCT track_id, CAST({ZOOM} AS BIGINT) AS level FROM s",
        "found_files": f"WITH {_STEPS} SELECT DISTINCT printf('track_%05d.bw', track_id) AS name FROM s",
        "tsv_roundtrip": f'WITH {_REGIONS} SELECT interval_id, chrom, start, "end" FROM r',
        "onehot_lenient": "WITH l AS (SELECT doc_id, text AS sequence, length(text) AS n FROM documents WHERE length(text) > 0) SELECT doc_id, " + ", ".join(f"CAST(round({e}, 3) AS DOUBLE) AS {b}" for b, e in iupac.items()) + " FROM l",
        "letter_places": f"WITH {_SEQ}, l AS (SELECT unnest(string_split(sequence, '')) AS x FROM q) SELECT CAST(ascii(x) - 65 AS INTEGER) AS place, count(*) AS n FROM l GROUP BY x",
        "whole_sequences": f"""WITH {_SEQ}, k AS (SELECT *, unnest(range(length(sequence) // {SEQUENCE})) AS tile FROM q), t AS (SELECT doc_id, tile, substr(sequence, tile * {SEQUENCE} + 1, {SEQUENCE}) AS x FROM k)
SELECT CAST(doc_id AS VARCHAR) AS chrom, tile * {SEQUENCE} AS start, (tile + 1) * {SEQUENCE} AS "end" FROM t WHERE length(regexp_replace(x, '[ACGT]', '', 'g')) / {SEQUENCE} <= 0.915""",
        "registered_encoder": f"WITH {_SEQ} SELECT doc_id, reverse(sequence) AS sequence FROM q",
        "queries_from_mapping": 'SELECT CAST(chrom_rank - (SELECT min(chrom_rank) FROM chroms) AS BIGINT) AS query_id, chrom, CAST(5 AS BIGINT) AS start, chrom_size // 2 AS "end" FROM chroms',
        "query_length": 'SELECT max("end" - start) AS length FROM stream_queries',
        "repeat_same_positions": f"WITH {_DRAWN.replace('SELECT i AS draw', 'SELECT j AS draw').replace(f'FROM range({DRAWS}) t(i)', f'FROM (SELECT j, j % {SAME} AS i FROM range({DRAWS}) t(j))')} SELECT * FROM dp",
        "ambiguous_stems": "SELECT stem, count(*) AS n FROM tracks GROUP BY stem HAVING count(*) > 1",
        "bfloat16_bits_of_values": f"""WITH {_STEPS}, b AS (SELECT track_id, chrom, start, CAST(CAST(CAST(CAST(value AS FLOAT) AS BIT) AS UINTEGER) AS BIGINT) AS x FROM s)
SELECT track_id, chrom, start, CAST((x + 32767 + (x // 65536) % 2) // 65536 AS INTEGER) AS bits FROM b""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        track_scan, chrom_include_exclude, standard_chromosomes, threshold_strict, scale_then_threshold, scale_by_path_key, pad_intervals, first_n_tracks, chrom_max_size, chrom_offsets,
        global_position, center_crop, overlap_join, chunk_prune_semi, segmented_searchsorted_left, segmented_searchsorted_right, searchsorted_absolute, merge_gap0, merge_gap_n,
        merge_cross_track, subtract_blacklist, subtract_blacklist_buffer, intervals_pipeline, track_summary, zoom_summary, segment_starts, overlapping_steps, values_per_base, window_mean_default0, window_mean_default_const,
        window_nanmean, window_mean_scaled, dense_batch_array, moving_average_odd, moving_average_even, chrom_sort, sort_intervals, chrom_union_labels, chrom_in_all_tracks,
        cumulative_region_index, epoch_batches, batch_assignment_drop_remainder, super_batch_slices, epoch_limit, query_slice, track_subset_ordered, unknown_base_fraction,
        filter_unknown_bases, sequence_slice, sequence_tiles, onehot_iupac, bfloat16_bits_of_values, sample_positions_hash, sample_tracks_hash, query_batches, query_batches_epoch, training_epoch, training_epoch_given, bigwig_roundtrip, values_from_files, values_from_tiles, file_headers, file_chroms, file_chunks, file_zooms, file_zoom_levels, found_files,
        tsv_roundtrip, onehot_lenient, letter_places, whole_sequences, registered_encoder, queries_from_mapping, query_length, repeat_same_positions, ambiguous_stems, fasta_scan, stream_query_batches, late_queries,
    ]
    return {f.__name__: f for f in found}
