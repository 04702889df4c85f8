"""Writing steps to BigWig files, one per track, from sorted partitions."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.bigwig import INDEX_MAGIC, MAGIC, TREE_MAGIC

FAN_OUT = 256


class Writer:
    """One file. Steps come in order of chromosome number and start; only the index and zoom cells are kept in memory.

    ``zooms`` are the reduction levels, in bases, for which summaries are stored.
    """

    def __init__(self, path: str, chroms: dict[str, int], rows_per_section: int = 1024, packed: bool = True, kind: int = 1, zooms: tuple[int, ...] = ()):
        self.path, self.packed, self.rows, self.kind, self.zooms = path, packed, rows_per_section, kind, zooms
        self.cells: dict[int, dict[tuple[int, int], list[float]]] = {level: {} for level in zooms}
        self.names = sorted(chroms)
        self.ids = {n: i for i, n in enumerate(self.names)}
        self.f = open(path, "wb")
        self.summary_at = 64 + 24 * len(zooms)
        self.f.write(b"\0" * (self.summary_at + 40))
        self.tree_at = self.f.tell()
        self._tree(chroms)
        self.data_at = self.f.tell()
        self.f.write(b"\0" * 8)
        self.leaves: list[tuple[int, int, int, int, int, int]] = []
        self.largest = 0
        self.total = np.zeros(5)
        self.total[1], self.total[2] = np.inf, -np.inf

    def _tree(self, chroms: dict[str, int]) -> None:
        key = max([len(n) for n in self.names], default=1)
        self.f.write(struct.pack("<IIIIQQ", TREE_MAGIC, FAN_OUT, key, 8, len(self.names), 0))
        # nodes of each level from the leaves up, each with its first name and its items
        levels = [[(self.names[i], self.names[i : i + FAN_OUT]) for i in range(0, len(self.names), FAN_OUT)] or [("", [])]]
        while len(levels[-1]) > 1:
            levels.append([(g[0][0], g) for g in (levels[-1][i : i + FAN_OUT] for i in range(0, len(levels[-1]), FAN_OUT))])
        at = self.f.tell()
        for depth in range(len(levels) - 1, -1, -1):
            at += sum(4 + len(items) * (key + 8) for _, items in levels[depth])
            child = at
            for _, items in levels[depth]:
                self.f.write(struct.pack("<BBH", depth == 0, 0, len(items)))
                for item in items:
                    if depth == 0:
                        self.f.write(struct.pack(f"<{key}sII", item.encode(), self.ids[item], chroms[item]))
                    else:
                        self.f.write(struct.pack(f"<{key}sQ", item[0].encode(), child))
                        child += 4 + len(item[1]) * (key + 8)

    def add(self, chrom: str, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> None:
        """Steps of one chromosome."""
        for i in range(0, len(start), self.rows):
            s, e, v = start[i : i + self.rows], end[i : i + self.rows], value[i : i + self.rows].astype("<f4")
            span = step = 0
            if self.kind == 1:
                body = np.rec.fromarrays([s.astype("<u4"), e.astype("<u4"), v]).tobytes()
            else:
                span = int(e[0] - s[0])
                step = int(s[1] - s[0]) if len(s) > 1 else span
                if (e - s != span).any() or (self.kind == 3 and (np.diff(s) != step).any()):
                    raise ValueError("steps of this section type have one length")
                body = np.rec.fromarrays([s.astype("<u4"), v]).tobytes() if self.kind == 2 else v.tobytes()
            raw = struct.pack("<IIIIIBBH", self.ids[chrom], int(s[0]), int(e[-1]), step, span, self.kind, 0, len(s)) + body
            self.largest = max(self.largest, len(raw))
            out = zlib.compress(raw) if self.packed else raw
            self.leaves.append((self.ids[chrom], int(s[0]), self.ids[chrom], int(e.max()), self.f.tell(), len(out)))
            self.f.write(out)
            n, x = (e - s).astype(float), v.astype(float)
            self.total += [n.sum(), 0, 0, (n * x).sum(), (n * x * x).sum()]
            self.total[1], self.total[2] = min(self.total[1], x.min()), max(self.total[2], x.max())
            for level, cells in self.cells.items():
                for a, b, y in zip(s.tolist(), e.tolist(), x.tolist()):
                    for cell in range(a // level, (b - 1) // level + 1):
                        k = min(b, (cell + 1) * level) - max(a, cell * level)
                        got = cells.setdefault((self.ids[chrom], cell), [0, y, y, 0.0, 0.0])
                        got[:] = got[0] + k, min(got[1], y), max(got[2], y), got[3] + k * y, got[4] + k * y * y

    def _index(self, leaves: list[tuple[int, int, int, int, int, int]]) -> int:
        """Write an index over the leaves; returns where it starts."""
        index_at = self.f.tell()
        tree: list[list[list]] = [[leaves[i : i + FAN_OUT] for i in range(0, len(leaves), FAN_OUT)] or [[]]]
        while len(tree[-1]) > 1:
            extents = [(g[0][0], g[0][1], g[-1][2], max(x[3] for x in g)) for g in tree[-1]]
            tree.append([extents[i : i + FAN_OUT] for i in range(0, len(extents), FAN_OUT)])
        first, last = (leaves[0], leaves[-1]) if leaves else ((0,) * 6, (0,) * 6)
        self.f.write(struct.pack("<IIQIIIIQII", INDEX_MAGIC, FAN_OUT, len(leaves), first[0], first[1], last[2], last[3], index_at, self.rows, 0))
        at = self.f.tell()
        for depth in range(len(tree) - 1, -1, -1):
            leaf = depth == 0
            at += sum(4 + len(g) * (32 if leaf else 24) for g in tree[depth])
            children = iter(tree[depth - 1]) if depth else None
            child = at
            for g in tree[depth]:
                self.f.write(struct.pack("<BBH", leaf, 0, len(g)))
                for item in g:
                    self.f.write(struct.pack("<IIIIQQ", *item) if leaf else struct.pack("<IIIIQ", *item, child))
                    if children:
                        child += 4 + len(next(children)) * (32 if depth == 1 else 24)
        return index_at

    def _zoom(self, level: int) -> tuple[int, int]:
        """Write the cells of one level and their index; returns where both start."""
        data_at, rows, leaves = self.f.tell(), sorted(self.cells[level].items()), []
        self.f.write(struct.pack("<I", len(rows)))
        for i in range(0, len(rows), self.rows):
            part = rows[i : i + self.rows]
            raw = b"".join(struct.pack("<IIIIffff", c, cell * level, (cell + 1) * level, *got) for (c, cell), got in part)
            self.largest = max(self.largest, len(raw))
            out = zlib.compress(raw) if self.packed else raw
            leaves.append((part[0][0][0], part[0][0][1] * level, part[-1][0][0], (part[-1][0][1] + 1) * level, self.f.tell(), len(out)))
            self.f.write(out)
        return data_at, self._index(leaves)

    def close(self) -> None:
        """Write the indexes and the headers."""
        index_at = self._index(self.leaves)
        zooms = [struct.pack("<IIQQ", level, 0, *self._zoom(level)) for level in self.zooms]
        t = self.total if self.leaves else np.zeros(5)
        self.f.seek(0)
        self.f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(zooms), self.tree_at, self.data_at, index_at, 0, 0, 0, self.summary_at, self.largest if self.packed else 0, 0))
        self.f.write(b"".join(zooms) + struct.pack("<Q4d", int(t[0]), *t[1:]))
        self.f.seek(self.data_at)
        self.f.write(struct.pack("<Q", len(self.leaves)))
        self.f.close()


def write_tracks(steps: DataFrame, chrom_sizes: dict[str, int], folder: str, rows_per_section: int = 1024, zooms: tuple[int, ...] = ()) -> DataFrame:
    """Write ``<folder>/track_<id>.bw`` for every track; returns ``(track_id, path, n_steps)`` when acted on.

    A file is one track by its format, so a track's steps go to one task, sorted on disk and streamed through it. The
    folder must be one that all executors share. Steps of unknown chromosomes are left out.
    """
    sizes = dict(chrom_sizes)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer: Writer | None = None
        track, n, done = None, 0, []
        for batch in batches:
            frame = batch.to_pandas()
            frame = frame[frame["chrom"].isin(sizes)]
            for (t, chrom), own in frame.groupby(["track_id", "chrom"], sort=False):
                if t != track:
                    if writer:
                        writer.close()
                        os.replace(writer.path, target)
                        done.append((track, target, n))
                    track, n, target = t, 0, f"{folder}/track_{int(t):05d}.bw"
                    writer = Writer(f"{target}.{os.getpid()}", sizes, rows_per_section, zooms=zooms)
                writer.add(chrom, own["start"].to_numpy(np.int64), own["end"].to_numpy(np.int64), own["value"].to_numpy(np.float32))
                n += len(own)
        if writer:
            writer.close()
            os.replace(writer.path, target)
            done.append((track, target, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.int64())], names=["track_id", "path", "n_steps"])

    rows = steps.select(F.col("track_id").cast("int").alias("track_id"), "chrom", "start", "end", F.col("value").cast("float").alias("value")).dropna(subset=["track_id", "chrom", "start", "end"])
    return rows.repartition("track_id").sortWithinPartitions("track_id", "chrom", "start").mapInArrow(write, "track_id int, path string, n_steps bigint")
