"""A Spark data source for FASTA files: ``spark.read.format("fasta").load(path)`` gives ``(chrom, chunk, letters)``.

The driver takes where each sequence starts from the ``.fai`` index beside the file; ``write_indexes`` makes those by
tasks. Of a file without one it looks for the lines that begin a sequence, which reads the file's bytes but none of its
lines. Of a folder, all files with one of the extensions are read. Tasks then read the bytes of their chunks. Only sequences whose lines have one length can be read by position, as an index
demands; tasks check that of every byte they read. Options: ``path``, ``extensions``, ``chunk_size``,
``partition_chunks``. A filter on chrom reaches the planning.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from spanloom.sources.files import exists, is_uri, opened, size
from spanloom.sources.paths import find_files

EXTENSIONS = (".fa", ".fasta")
CHUNK = 1 << 16
PARTITION_CHUNKS = 256
SCAN_BYTES = 8 << 20
RANGE_BYTES = 64 << 20
FOUND = {"path": pa.string(), "size": pa.int64(), "at": pa.int64(), "breaks": pa.int32(), "name": pa.string(), "offset": pa.int64(), "line": pa.int64(), "width": pa.int64()}


@dataclass
class Entry:
    """A sequence: letters, byte where they start, letters and bytes of a line."""

    name: str
    length: int
    offset: int
    line: int
    width: int


@dataclass
class Stretches(InputPartition):
    #: path, sequence, first chunk and the one behind the last
    parts: list[tuple[str, Entry, int, int]]


def _headers(f) -> tuple[list[int], int]:
    """Where the lines that begin a sequence are, and where the file ends."""
    found, at, before = [], 0, b"\n"
    while block := f.read(SCAN_BYTES):
        found += [at + i for i in _begins(before + block)]
        at += len(block)
        before = block[-1:]
    return found, at


def _begins(text: bytes) -> Iterator[int]:
    hit = text.find(b"\n>")
    while hit >= 0:
        yield hit
        hit = text.find(b"\n>", hit + 1)


def _layout(f, start: int, size: int) -> tuple[str, int, int, int]:
    """Name of the sequence whose first line is at ``start``, byte where its letters start, letters and bytes of a line."""
    f.seek(start)
    head = f.read(min(1 << 10, size - start))
    while head.count(b"\n") < 2 and start + len(head) < size:
        head += f.read(min(len(head), size - start - len(head)))
    name, _, rest = head.partition(b"\n")
    first, newline, _ = rest.partition(b"\n")
    if first.startswith(b">"):  # no letters at all
        first = newline = b""
    return (name[1:].split() or [b""])[0].decode(), start + len(name) + 1, len(first.rstrip(b"\r")), len(first) + len(newline)


def _breaks(f, end: int) -> int:
    """How many bytes before ``end`` end lines."""
    f.seek(max(end - 4, 0))
    tail = f.read(end - max(end - 4, 0))
    return len(tail) - len(tail.rstrip(b"\r\n"))


def _entry(name: str, offset: int, line: int, width: int, end: int) -> Entry:
    body = max(end - offset, 0)
    return Entry(name, body // width * line + min(body % width, line) if line else 0, offset, line, width)


def index(path: str) -> list[Entry]:
    """The sequences of a file, from its index if there is one. Lines are taken to have the first one's length."""
    if exists(path + ".fai"):
        with opened(path + ".fai") as f:
            return [Entry(x[0], *map(int, x[1:5])) for x in (line.split("\t") for line in f.read().decode().splitlines()) if len(x) >= 5]
    with opened(path) as f:
        starts, size = _headers(f)
        return [_entry(*_layout(f, start, size), end - _breaks(f, end)) for start, end in zip(starts, [*starts[1:], size])]


def write_indexes(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``<file>.fai`` beside each file, found by tasks over ranges of bytes; returns ``(path, n)`` when acted on.

    Where a sequence starts is found by the task whose range holds its first line; what a file's index lists is then
    sorted on disk and streamed through one task, as an index is one file. A task that is run again replaces its file.
    """
    files = [(p, size(p)) for p in find_files(path, extensions)]
    if any(is_uri(p) for p, _ in files):
        raise ValueError("indexes are written to a mounted file system")
    ranges = [(p, n, at, min(at + range_bytes, n)) for p, n in files for at in range(0, max(n, 1), range_bytes)]
    wanted = spark.createDataFrame(ranges, "path string, size long, lo long, hi long").repartition(max(1, min(len(ranges), 10_000)), "path", "lo")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(name) as f:
                    f.seek(max(lo - 1, 0))
                    text = b"\n" * (lo == 0) + f.read(hi - max(lo - 1, 0))
                    rows = [(name, n, lo + i, _breaks(f, lo + i), *_layout(f, lo + i, n)) for i in _begins(text)]
                    if hi == n:  # the end of the file, after all sequences
                        rows.append((name, n, n, _breaks(f, n), None, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), FOUND.values())] if rows else [pa.array([], k) for k in FOUND.values()], names=list(FOUND))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, done, n, begun, lines = "", [], 0, None, None
        for batch in batches:
            for name, _, at, breaks, seq, *layout in zip(*(c.to_pylist() for c in batch.columns)):
                if lines is None:
                    target, n, begun = f"{name}.fai", 0, None
                    lines = open(f"{target}.{os.getpid()}", "w")
                if begun is not None:
                    e = _entry(*begun, at - breaks)
                    lines.write(f"{e.name}\t{e.length}\t{e.offset}\t{e.line}\t{e.width}\n")
                    n += 1
                begun = (seq, *layout)
                if seq is None:
                    lines.close()
                    os.replace(lines.name, target)
                    done.append((name, n))
                    lines = None
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n"])

    kinds = "path string, size bigint, at bigint, breaks int, name string, offset bigint, line bigint, width bigint"
    return wanted.mapInArrow(find, kinds).repartition("path").sortWithinPartitions("path", "at", F.col("name").isNull()).mapInArrow(write, "path string, n bigint")


def _letters(f, e: Entry, lo: int, hi: int) -> str:
    """Letters ``lo`` to ``hi`` of a sequence; ValueError if its lines have different lengths."""
    start, end = (p // e.line * e.width + p % e.line for p in (lo, hi))
    f.seek(e.offset + start)
    raw = np.frombuffer(f.read(end - start), np.uint8)
    breaks = (start + np.arange(len(raw))) % e.width >= e.line
    if len(raw) != end - start or ((raw == 10) | (raw == 13) != breaks).any():
        raise ValueError(f"the lines of {e.name} have different lengths")
    return raw[~breaks].tobytes().decode("ascii")


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = find_files(options["path"], options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.chunk = int(options.get("chunk_size", CHUNK))
        self.per_partition = int(options.get("partition_chunks", PARTITION_CHUNKS))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", ()) == ("chrom",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = wanted if self.names is None else self.names & wanted
            yield f

    def partitions(self) -> list[InputPartition]:
        """Runs of chunks; short sequences share a partition, long ones are split over several."""
        done: list[InputPartition] = []
        parts: list[tuple[str, Entry, int, int]] = []
        room = self.per_partition
        for path in self.paths:
            for e in index(path):
                if self.names is not None and e.name not in self.names:
                    continue
                at, n = 0, -(-e.length // self.chunk)
                while at < n:
                    upto = min(at + room, n)
                    parts.append((path, e, at, upto))
                    room -= upto - at
                    at = upto
                    if not room:
                        done.append(Stretches(parts))
                        parts, room = [], self.per_partition
        return [*done, Stretches(parts)] if parts or not done else done

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Stretches)
        names, numbers, texts, held, at, f = [], [], [], 0, None, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["chrom", "chunk", "letters"])

        try:
            for path, e, first, last in partition.parts:
                if path != at:
                    if f is not None:
                        f.close()
                    f, at = opened(path), path
                for n in range(first, last):
                    text = _letters(f, e, n * self.chunk, min((n + 1) * self.chunk, e.length))
                    names.append(e.name), numbers.append(n), texts.append(text)
                    held += len(text)
                    if held >= SCAN_BYTES:
                        yield batch()
                        names, numbers, texts, held = [], [], [], 0
        finally:
            if f is not None:
                f.close()
        yield batch()


def write_sequences(df: DataFrame, folder: str, width: int = 60) -> DataFrame:
    """Write (chrom, sequence) rows as ``<folder>/part_<n>.fa``, one file a partition; returns ``(path, n)`` when acted on.

    A task that is run again replaces its file. Null names or sequences are left out. The folder is one that all
    executors share.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        target = f"{folder}/part_{TaskContext.get().partitionId():05d}.fa"
        with open(f"{target}.{os.getpid()}", "w") as out:
            for batch in batches:
                for name, letters in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out.write(f">{name}\n" + "".join(letters[i : i + width] + "\n" for i in range(0, len(letters), width)))
                    n += 1
        os.replace(f"{target}.{os.getpid()}", target)
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], names=["path", "n"])

    return df.select("chrom", "sequence").dropna().mapInArrow(write, "path string, n bigint")


class FastaSource(DataSource):
    """Chunks of the sequences of a FASTA file."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "chrom string, chunk int, letters string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FastaReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session and allow filters to reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
