"""A Spark data source for BigWig files: ``spark.read.format("bigwig").load(path)``.

The driver only looks at the files' sizes. Small files share a partition; of a larger one it reads the upper nodes of
the index, which are given to tasks in runs. Tasks walk the index below their nodes, then read, inflate and decode the
chunks to Arrow. Filters on track_id, chrom, start and end drop files, nodes and chunks before they are read, and are
left to Spark for the rows themselves. ``table`` chunks lists all chunks, ``steps_of`` reads those that are chosen among
them. All three section types, deep trees, both byte orders and uncompressed files are read.

Layout after Kent et al., Bioinformatics 26 (2010). Options: ``path`` (or ``paths``, a JSON list), ``extensions``,
``crawl``, ``scales`` (JSON, by partial path), ``first_n``, ``partition_bytes``, ``table`` (steps, chunks, chroms, files, zooms for the stored levels, zoom_records for their cells).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from spanloom.sources.files import opened, size
from spanloom.sources.paths import EXTENSIONS, find_files, value_for_path

MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
PARTITION_BYTES = 32 << 20
BATCH_ROWS = 1 << 16
#: Neighbouring chunks of a file that one task reads one after another.
RUN_BYTES = 1 << 20
OPENING_THREADS = 16
SCHEMAS = {
    "steps": "track_id int, chrom string, start bigint, end bigint, value float",
    "chunks": "track_id int, chrom string, start bigint, end bigint, data_offset bigint, data_size bigint, chrom_id int, path string, scale double, byte_order string, packed boolean",
    "chroms": "track_id int, chrom string, chrom_id int, chrom_size bigint",
    "zooms": "track_id int, level bigint, data_offset bigint, index_offset bigint",
    "zoom_records": "track_id int, level bigint, chrom string, start bigint, end bigint, valid_count bigint, min_value double, max_value double, sum_values double, sum_squares double",
    "files": "track_id int, path string, version int, zoom_levels int, bases_covered bigint, min_value double, max_value double, sum_values double, sum_squares double",
}


@dataclass
class Header:
    order: str
    version: int
    zooms: int
    chrom_tree: int
    data: int
    index: int
    summary: int
    buffer: int


def _unpack(f, form: str, at: int | None = None) -> tuple:
    if at is not None:
        f.seek(at)
    raw = f.read(struct.calcsize(form))
    if len(raw) < struct.calcsize(form):
        raise ValueError("the file ends within a header")
    return struct.unpack(form, raw)


def read_header(f) -> Header:
    raw = f.read(4)
    order = "<" if raw == struct.pack("<I", MAGIC) else ">" if raw == struct.pack(">I", MAGIC) else ""
    if not order:
        raise ValueError("not a BigWig file")
    version, zooms, tree, data, index, _, _, _, summary, buffer, _ = _unpack(f, order + "HHQQQHHQQIQ")
    return Header(order, version, zooms, tree, data, index, summary, buffer)


def read_summary(f, h: Header) -> tuple[int, float, float, float, float] | None:
    return _unpack(f, h.order + "Q4d", h.summary) if h.summary else None


def read_zooms(f, h: Header) -> list[dict[str, int]]:
    """Reduction level, data and index offset of each stored zoom level."""
    f.seek(64)
    return [dict(zip(("level", "data", "index"), (lv, d, i))) for lv, _, d, i in (_unpack(f, h.order + "IIQQ") for _ in range(h.zooms))]


def read_chroms(f, h: Header) -> dict[int, tuple[str, int]]:
    """Number to (name, size), from all leaves of the chromosome tree."""
    magic, _, key_size, _, _, _ = _unpack(f, h.order + "IIIIQQ", h.chrom_tree)
    if magic != TREE_MAGIC:
        raise ValueError("no chromosome tree")
    found: dict[int, tuple[str, int]] = {}
    todo = [h.chrom_tree + 32]
    while todo:
        leaf, _, n = _unpack(f, h.order + "BBH", todo.pop())
        items = [_unpack(f, f"{h.order}{key_size}s" + ("II" if leaf else "Q")) for _ in range(n)]
        if leaf:
            found |= {number: (key.rstrip(b"\0").decode(), size) for key, number, size in items}
        else:
            todo += [child for _, child in items]
    return found


Chunk = tuple[int, int, int, int, int, int]


def index_root(f, h: Header, at: int | None = None) -> int:
    """Where the root node of an index is, of the data or of a zoom level."""
    at = h.index if at is None else at
    if _unpack(f, h.order + "I", at)[0] != INDEX_MAGIC:
        raise ValueError("no index")
    return at + 48


def _node(f, h: Header, at: int) -> tuple[int, list[tuple]]:
    """Whether a node is a leaf, and its items: first and last chromosome with their start and end, then the child, or data offset and size."""
    leaf, _, n = _unpack(f, h.order + "BBH", at)
    form = struct.Struct(h.order + ("IIIIQQ" if leaf else "IIIIQ"))
    return leaf, list(form.iter_unpack(f.read(form.size * n)))


def read_chunks(f, h: Header, nodes: list[int], wanted: Callable[[tuple], bool] = lambda item: True) -> list[Chunk]:
    """Chunks below some nodes of an index whose extent is wanted, in the order of the file."""
    out, todo = [], list(nodes)
    while todo:
        leaf, items = _node(f, h, todo.pop())
        if leaf:
            out += [i for i in items if wanted(i)]
        else:
            todo += [i[4] for i in items if wanted(i)]
    return sorted(out, key=lambda c: c[4])


def upper_nodes(f, h: Header, least: int) -> list[int]:
    """``least`` nodes or more that the whole index lies below, if it has so many inner ones."""
    nodes = [index_root(f, h)]
    while len(nodes) < least:
        read = [_node(f, h, at) for at in nodes]
        if any(leaf for leaf, _ in read):
            break
        nodes = [i[4] for _, items in read for i in items]
    return nodes


def decode_section(raw: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome number, starts, ends and values of one inflated chunk."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", raw)
    if kind == 1:
        rows = np.frombuffer(raw, np.dtype([("s", order + "u4"), ("e", order + "u4"), ("v", order + "f4")]), n, 24)
        return chrom, rows["s"].astype(np.int64), rows["e"].astype(np.int64), rows["v"].astype(np.float32)
    if kind == 2:
        rows = np.frombuffer(raw, np.dtype([("s", order + "u4"), ("v", order + "f4")]), n, 24)
        return chrom, rows["s"].astype(np.int64), rows["s"].astype(np.int64) + span, rows["v"].astype(np.float32)
    if kind == 3:
        starts = start + np.arange(n, dtype=np.int64) * step
        return chrom, starts, starts + span, np.frombuffer(raw, order + "f4", n, 24).astype(np.float32)
    raise ValueError(f"unknown section type {kind}")


@dataclass
class Files(InputPartition):
    #: track, path, the index nodes to walk, all if None, and which share of the chunks below them is meant
    parts: list[tuple[int, str, list[int] | None, tuple[int, int]]]


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}


def _schema(table: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split(" ") for c in SCHEMAS[table].split(", "))])


def _frame(rows: list[tuple], table: str) -> pa.RecordBatch:
    schema = _schema(table)
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Steps:
    """Decoded chunks gathered to batches."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, track: int, name: str, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, scale: float) -> bool:
        """Whether there are enough rows for a batch."""
        self.parts.append((track, name, starts, ends, values if scale == 1.0 else (values * np.float32(scale)).astype(np.float32)))
        self.rows += len(starts)
        return self.rows >= BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        parts, self.parts, self.rows = self.parts, [], 0
        n = [len(p[2]) for p in parts]
        names = sorted({p[1] for p in parts})
        which = np.repeat(np.array([names.index(p[1]) for p in parts], np.int32), n)
        chrom = pa.DictionaryArray.from_arrays(pa.array(which), pa.array(names, pa.string())).cast(pa.string())
        whole = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in (2, 3, 4)]
        track = np.repeat(np.array([p[0] for p in parts], np.int32), n)
        return pa.RecordBatch.from_arrays([pa.array(track, pa.int32()), chrom, pa.array(whole[0], pa.int64()), pa.array(whole[1], pa.int64()), pa.array(whole[2], pa.float32())], names=["track_id", "chrom", "start", "end", "value"])


class BigWigReader(DataSourceReader):
    """Plans and reads one load."""

    def __init__(self, options: dict[str, str], table: str):
        self.table = table
        paths = json.loads(options["paths"]) if "paths" in options else [p for p in [options.get("path")] if p]
        extensions = tuple(options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.paths = find_files(paths, extensions, options.get("crawl", "true").lower() == "true")
        if "first_n" in options:
            self.paths = self.paths[: int(options["first_n"])]
        self.scales: dict[str, float] = json.loads(options.get("scales", "{}"))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.chroms: set[str] | None = None
        self.tracks: set[int] | None = None
        self.least_end, self.greatest_start = -1, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what prunes files and chunks; every filter still goes back to Spark, as pruning is by whole chunks."""
        for f in filters:
            column = getattr(f, "attribute", ())
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("chrom",) and values is not None:
                self.chroms = values if self.chroms is None else self.chroms & values
            elif column == ("track_id",) and values is not None:
                self.tracks = values if self.tracks is None else self.tracks & values
            elif column == ("end",) and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.least_end = max(self.least_end, f.value)
            elif column == ("start",) and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.greatest_start = min(self.greatest_start, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        """Small files together, larger ones in runs of index nodes; nothing is opened but those larger ones."""
        files = [(track, path) for track, path in enumerate(self.paths) if self.tracks is None or track in self.tracks]
        sizes = list(self._threads(lambda f: size(f[1]), files))
        large = [f for f, n in zip(files, sizes) if self.table == "steps" and n > self.partition_bytes]
        parts: list[InputPartition] = []
        few: list[tuple[int, str, list[int] | None, tuple[int, int]]] = []
        room = self.partition_bytes
        for (track, path), n in zip(files, sizes):
            if self.table == "steps" and n > self.partition_bytes:
                continue
            cost = n if self.table == "steps" else n // 64 + self.partition_bytes // 64  # the index is a small part
            if few and cost > room:
                parts.append(Files(few))
                few, room = [], self.partition_bytes
            few.append((track, path, None, (0, 1)))
            room -= cost
        if few:
            parts.append(Files(few))
        for (track, path), runs in zip(large, self._threads(lambda f: self._runs(f[1]), large)):
            parts += [Files([(track, path, *run)]) for run in runs]
        return parts or [Files([])]

    @staticmethod
    def _threads(made: Callable, over: list) -> Iterator:
        with ThreadPoolExecutor(OPENING_THREADS) as pool:
            yield from pool.map(made, over)

    def _runs(self, path: str) -> list[tuple[list[int], tuple[int, int]]]:
        """The index nodes of a file in as many runs as its size asks for; of too few nodes, shares of what lies below."""
        n = -(-size(path) // self.partition_bytes)
        with opened(path) as f:
            nodes = upper_nodes(f, read_header(f), n)
        if len(nodes) < n:
            return [(nodes, (k, n)) for k in range(n)]
        return [(nodes[len(nodes) * k // n : len(nodes) * (k + 1) // n], (0, 1)) for k in range(n)]

    def _wanted(self, item: tuple, chroms: dict[int, tuple[str, int]]) -> bool:
        first, start, last, end = item[:4]
        if self.chroms is not None and not any(chroms[c][0] in self.chroms for c in range(first, last + 1) if c in chroms):
            return False
        return first != last or (end >= self.least_end and start <= self.greatest_start)

    def chunks_of(self, f, h: Header, chroms: dict[int, tuple[str, int]], nodes: list[int] | None = None, share: tuple[int, int] = (0, 1)) -> list[Chunk]:
        """The chunks of a partition's part that the filters leave."""
        found = read_chunks(f, h, [index_root(f, h)] if nodes is None else nodes, lambda item: self._wanted(item, chroms))
        return found[len(found) * share[0] // share[1] : len(found) * (share[0] + 1) // share[1]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Files)
        if self.table == "steps":
            steps = _Steps()
            for track, path, nodes, share in partition.parts:
                scale = float(value_for_path(path, self.scales, 1.0))
                with opened(path) as f:
                    h = read_header(f)
                    chroms = read_chroms(f, h)
                    for c in self.chunks_of(f, h, chroms, nodes, share):
                        number, starts, ends, values = decode_section(_inflated(f, c[4], c[5], h.buffer > 0), h.order)
                        if steps.add(track, chroms[number][0], starts, ends, values, scale):
                            yield steps.batch()
            yield steps.batch()
            return
        rows: list[tuple] = []
        for track, path, _, _ in partition.parts:
            with opened(path) as f:
                h = read_header(f)
                if self.table == "zoom_records":
                    for z in read_zooms(f, h):
                        yield from self._zoom_rows(f, h, track, z)
                    continue
                rows += self._rows(f, h, track, path)
        if self.table != "zoom_records":
            yield _frame(rows, self.table)

    def _rows(self, f, h: Header, track: int, path: str) -> list[tuple]:
        """Rows of a file for the tables about it."""
        if self.table == "zooms":
            return [(track, z["level"], z["data"], z["index"]) for z in read_zooms(f, h)]
        if self.table == "files":
            return [(track, path, h.version, h.zooms, *(read_summary(f, h) or (None,) * 5))]
        chroms = read_chroms(f, h)
        if self.table == "chroms":
            return [(track, name, number, length) for number, (name, length) in sorted(chroms.items())]
        scale = float(value_for_path(path, self.scales, 1.0))
        tail = (path, scale, h.order, h.buffer > 0)
        # a chunk of several chromosomes is listed for each of them
        return [
            (track, chroms[c][0], s if c == a else 0, e if c == b else chroms[c][1], offset, n, c, *tail)
            for a, s, b, e, offset, n in self.chunks_of(f, h, chroms) for c in range(a, b + 1) if c in chroms
        ]

    def _zoom_rows(self, f, h: Header, track: int, zoom: dict[str, int]) -> Iterator[pa.RecordBatch]:
        chroms = read_chroms(f, h)
        names = {k: n for k, (n, _) in chroms.items()}
        kind = np.dtype([(n, h.order + t) for n, t in (("c", "u4"), ("s", "u4"), ("e", "u4"), ("n", "u4"), ("low", "f4"), ("high", "f4"), ("sum", "f4"), ("squares", "f4"))])
        for c in read_chunks(f, h, [index_root(f, h, zoom["index"])], lambda item: self._wanted(item, chroms)):
            r = np.frombuffer(_inflated(f, c[4], c[5], h.buffer > 0), kind)
            if (r["low"] > r["high"]).any() or (r["s"] > r["e"]).any():
                raise ValueError("a zoom record is out of order")
            n = len(r)
            whole = [r[k].astype(np.int64) for k in ("s", "e", "n")] + [r[k].astype(np.float64) for k in ("low", "high", "sum", "squares")]
            chrom = pa.array([names[x] for x in r["c"].tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, track, np.int32)), pa.array(np.full(n, zoom["level"], np.int64)), chrom, *map(pa.array, whole)], schema=_schema("zoom_records"))


def _inflated(f, offset: int, n: int, packed: bool) -> bytes:
    f.seek(offset)
    raw = f.read(n)
    return zlib.decompress(raw) if packed else raw


def steps_of(chunks: DataFrame) -> DataFrame:
    """The steps of chosen rows of the table ``chunks``, each chunk once however often it is listed.

    Chunks are spread over the session's number of shuffle partitions by file and stretch, and read in the order of
    the file. Their rows are small but what they stand for isn't, so the number isn't left to the rows' size.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["track_id", "chrom", "chrom_id", "path", "scale", "byte_order", "packed", "data_offset", "data_size"]
    rows = chunks.select(*columns).distinct().repartition(n, "path", F.floor(F.col("data_offset") / RUN_BYTES)).sortWithinPartitions("path", "data_offset")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, f, at = _Steps(), None, None
        try:
            for batch in batches:
                for track, chrom, number, path, scale, order, packed, offset, size_ in zip(*(c.to_pylist() for c in batch.columns)):
                    if path != at:
                        if f is not None:
                            f.close()
                        f, at = opened(path), path
                    own, starts, ends, values = decode_section(_inflated(f, offset, size_, packed), order)
                    if own == number and steps.add(track, chrom, starts, ends, values, scale):
                        yield steps.batch()
        finally:
            if f is not None:
                f.close()
        yield steps.batch()

    return rows.mapInArrow(decoded, SCHEMAS["steps"])


class BigWigSource(DataSource):
    """Steps of signal files; ``option("table", ...)`` gives their chunks, chromosomes or headers instead."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def _table(self) -> str:
        table = self.options.get("table", "steps")
        if table not in SCHEMAS:
            raise ValueError(f"table is one of {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return BigWigReader(dict(self.options), self._table())


def register(spark: SparkSession) -> None:
    """Make the format known to a session and allow filters to reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWigSource)
