"""A collection of tracks as one relation, and the calls that batches of queries and regions are made with."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.chrom import chrom_offsets, chrom_order, chrom_sizes, with_global_position
from spanloom.operators import algebra
from spanloom.operators.batch import queries_from
from spanloom.operators.overlap import touched
from spanloom.operators.values import dense, require_equal_lengths, value_arrays
from spanloom.session import checkpoint
from spanloom.sources import bigwig
from spanloom.sources.paths import EXTENSIONS


#: Bases of a tile of stored steps, and of a bin in which chunks of files are met.
TILE = 1 << 20
CHUNK_BIN = 1 << 17
Q = {"start": "q_start", "end": "q_end"}


class TrackCollection:
    """Tracks ``(track_id, chrom, start, end, value)`` with their dimension ``(track_id, path, stem, scale)``.

    From files (``open``), from steps stored by tiles (``store`` and ``stored``), or from DataFrames of steps, tracks
    and chromosomes (``track_id, chrom, chrom_size``, or without track). ``repeats`` tells that a step may be there more
    than once and counts once; values then drop repeats among what a query hits, without a shuffle of all steps.

    Queries read what they touch: the chunks of files that overlap any of them, or the tiles that do.
    """

    def __init__(self, spark: SparkSession, steps: DataFrame, tracks: DataFrame, chroms: DataFrame, repeats: bool = False, chunks: DataFrame | None = None, tile: int | None = None):
        self.spark, self.steps, self.tracks, self.chroms, self.repeats = spark, steps, tracks, chroms, repeats
        self._chunks, self._index, self._tile = chunks, None, tile

    @classmethod
    def open(cls, spark: SparkSession, path: Any, file_extensions: Sequence[str] = EXTENSIONS, crawl: bool = True, scale: Mapping[str, float] | None = None, first_n_files: int | None = None) -> TrackCollection:
        """Files of a folder, a path or URI, or nested lists of them; tracks are numbered in the order of their sorted paths."""
        bigwig.register(spark)
        paths = [path] if isinstance(path, str) else [str(p) for p in _flat(path)]
        options = {"paths": json.dumps(paths), "extensions": ",".join(file_extensions), "crawl": str(crawl).lower(), "scales": json.dumps(dict(scale or {}))}
        if first_n_files is not None:
            options["first_n"] = str(first_n_files)
        load = lambda table: spark.read.format("bigwig").options(**options).option("table", table).load()
        stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
        return cls(spark, load("steps"), load("files").select("track_id", "path", stem.alias("stem")), load("chroms"), chunks=load("chunks"))

    def store(self, path: str, tile: int = TILE) -> None:
        """Write the steps as Parquet, one folder a tile; steps that cross a tile's border are cut there.

        Rows are spread by ranges of position, so a hot chromosome is many tasks and files are sorted by start.
        """
        cut = F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile)))
        rows = self.steps.select("track_id", "chrom", "start", "end", "value").dropna(subset=["track_id", "chrom", "start", "end"]).where("end > start").withColumn("__t", cut)
        rows = rows.withColumns({"start": F.greatest("start", F.col("__t") * tile), "end": F.least("end", (F.col("__t") + 1) * tile), "tile": F.concat_ws(":", "chrom", "__t")}).drop("__t")
        rows.repartitionByRange("chrom", "start").sortWithinPartitions("tile", "start", "track_id").write.mode("overwrite").partitionBy("tile").parquet(path)

    @classmethod
    def stored(cls, spark: SparkSession, path: str, tracks: DataFrame, chroms: DataFrame, tile: int = TILE, repeats: bool = False) -> TrackCollection:
        """What ``store`` wrote with the same ``tile``."""
        return cls(spark, spark.read.parquet(path), tracks, chroms, repeats, tile=tile)

    def queries(self, queries: Any) -> DataFrame:
        """Queries from a DataFrame, a mapping, or chromosomes, starts and ends."""
        return queries_from(self.spark, queries)

    def chunks_near(self, queries: DataFrame) -> DataFrame:
        """Chunks of the files that any query touches. The table of all chunks is made once, by tasks, and written."""
        if self._index is None:
            self._index = checkpoint(self._chunks)
        return touched(self._index, queries.select("chrom", *[F.col(c).alias(n) for c, n in Q.items()]), bin_size=CHUNK_BIN, once=True)

    def steps_near(self, queries: DataFrame) -> DataFrame:
        """The steps from which the queries can be answered: read by chunk or by tile, or those of the stretch and chromosomes that queries span.

        The tiles, or chromosomes, that queries touch are listed on the driver; a genome has a few thousand.
        """
        if self._chunks is not None:
            return bigwig.steps_of(self.chunks_near(queries))
        if self._tile is not None:
            tiles = F.explode(F.sequence(F.floor(F.col("start") / self._tile), F.floor((F.col("end") - 1) / self._tile)))
            near = queries.where("end > start").select("chrom", tiles.alias("t")).select(F.concat_ws(":", "chrom", "t").alias("tile")).distinct()
            return self.steps.where(F.col("tile").isin([r.tile for r in near.collect()])).drop("tile")
        low, high, names = queries.agg(F.min("start"), F.max("end"), F.collect_set("chrom")).first()
        if low is None:
            return self.steps.where(F.lit(False))
        return self.steps.where((F.col("start") < high) & (F.col("end") > low) & F.col("chrom").isin(names))

    @property
    def n_tracks(self) -> int:
        return self.tracks.count()

    def intervals(self, include: str | Sequence[str] = "all", exclude: str | Iterable[str] | None = None, blacklist: DataFrame | None = None, blacklist_buffer: int = 0, padding: int = 0, merge: bool = False, threshold: float | None = 0.0, merge_allow_gap: int = 0) -> DataFrame:
        """Regions of all tracks; see ``operators.algebra.intervals``. Repeats change nothing where intervals are merged, else they are dropped first."""
        steps = self.steps.drop("tile")
        if self.repeats and not merge:
            steps = steps.select("track_id", "chrom", "start", "end", "value").distinct()
        return algebra.intervals(steps, include, exclude, blacklist, blacklist_buffer, padding, merge, threshold, merge_allow_gap)

    def values(self, queries: Any, window_size: int = 1, default_value: float = 0.0, as_cube: bool = False) -> DataFrame:
        """Value arrays per query and track, or with ``as_cube`` one bins x tracks array per query.

        Queries must have one length.
        """
        q = self.queries(queries)
        require_equal_lengths(q)
        arrays = value_arrays(q, self.tracks, self.steps_near(q), window_size, default_value, repeats=self.repeats)
        return dense(arrays) if as_cube else arrays

    def chromosomes(self, include: str | Sequence[str] = "all", exclude: str | Iterable[str] | None = None) -> DataFrame:
        """``(label)``: the distinct ``<chrom>_<stem>`` of all tracks."""
        kept = algebra.select_chromosomes(self.chroms, include, exclude)
        return kept.join(self.tracks.select("track_id", "stem"), "track_id").select(F.concat_ws("_", "chrom", "stem").alias("label")).distinct()

    def chromosomes_in_all(self, include: str | Sequence[str] = "all", exclude: str | Iterable[str] | None = None) -> DataFrame:
        """``(chrom)``: chromosomes that every track has."""
        kept = algebra.select_chromosomes(self.chroms, include, exclude)
        every = self.tracks.agg(F.count_distinct("track_id").alias("n")).scalar()
        return kept.groupBy("chrom").agg(F.count_distinct("track_id").alias("n")).where(F.col("n") == every).select("chrom")

    def sorted_intervals(self, **options: Any) -> DataFrame:
        """Intervals in the order of chromosomes, then of starts."""
        return self.intervals(**options).orderBy(*chrom_order(F.col("chrom")), "start")

    def with_global_position(self, df: DataFrame, position: str = "start") -> DataFrame:
        """Positions counted over all chromosomes one after another."""
        return with_global_position(df, chrom_offsets(chrom_sizes(self.chroms)), position)


def _flat(path: Any) -> Iterable[Any]:
    for p in [path] if isinstance(path, (str, bytes)) or not isinstance(path, Iterable) else path:
        if isinstance(p, Iterable) and not isinstance(p, (str, bytes)):
            yield from _flat(p)
        else:
            yield p
