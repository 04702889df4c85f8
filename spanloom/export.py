"""Results for consumers: interval lists as text, batches as arrays or tensors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.files import opened
from spanloom.sources.paths import find_files

READ_ROWS = 1024


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated text with a header, one file per partition."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark, path: str, schema: str) -> DataFrame:
    """Regions or positions from tab-separated text with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema)


def batches(table: DataFrame, track_names: DataFrame | None = None) -> Iterator[dict[str, Any]]:
    """Batches of a training table one after another: sequences, values (batch x bins x tracks), track_ids, names if asked.

    The table is sorted by batch and read partition by partition, the next one being fetched meanwhile; the driver
    holds one batch and one partition. Tracks are the same within a batch.
    """
    names = {r.track_id: r.stem for r in track_names.select("track_id", "stem").toLocalIterator()} if track_names is not None else None
    rows: list[Any] = []
    for row in table.orderBy("batch_id", "query_id").toLocalIterator(prefetchPartitions=True):
        if rows and rows[0].batch_id != row.batch_id:
            yield _batch(rows, names)
            rows = []
        rows.append(row)
    if rows:
        yield _batch(rows, names)


def _batch(rows: list[Any], names: dict[int, str] | None) -> dict[str, Any]:
    values = np.array([r["values"] for r in rows])
    cube = np.moveaxis(values, 1, 2) if values.ndim == 3 else values
    cube = cube.astype(np.uint16) if np.issubdtype(cube.dtype, np.integer) else cube.astype(np.float32)
    text = rows[0]["sequence"] is None or isinstance(rows[0]["sequence"], str)
    sequences = [r["sequence"] for r in rows] if text else np.array([r["sequence"] for r in rows], np.float32)
    out = {"batch_id": rows[0]["batch_id"], "sequences": sequences, "values": cube, "track_ids": list(rows[0]["track_ids"])}
    if names is not None:
        out["track_names"] = [names.get(t) for t in out["track_ids"]]
    return out


def write_batches(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a training table as Parquet so that each batch lies in one file, in the order of its queries."""
    table.repartitionByRange("batch_id").sortWithinPartitions("batch_id", "query_id").write.mode(mode).parquet(path)


class StoredBatches:
    """Batches that ``write_batches`` stored, for one reader or several in parallel; iterated over, it begins anew.

    Reader ``worker`` of ``workers`` takes every so-manieth file, so readers share the batches among them without
    talking to each other. One file's row groups are read one after another; a reader holds one batch and one group.
    """

    def __init__(self, path: str, worker: int = 0, workers: int = 1, names: dict[int, str] | None = None):
        if not 0 <= worker < workers:
            raise ValueError("a worker is one of the workers")
        self.path, self.worker, self.workers, self.names = path, worker, workers, names

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for file in find_files(self.path, [".parquet"])[self.worker :: self.workers]:
            rows: list[Any] = []
            with opened(file) as f:
                for part in pq.ParquetFile(f).iter_batches(batch_size=READ_ROWS):
                    for row in part.to_pylist():
                        if rows and rows[0]["batch_id"] != row["batch_id"]:
                            yield _batch(rows, self.names)
                            rows = []
                        rows.append(row)
            if rows:
                yield _batch(rows, self.names)


def torch_dataset(path: str, names: dict[int, str] | None = None):
    """Stored batches as a torch ``IterableDataset`` of tensors, shared among the workers of its loader. torch is needed only here."""
    from torch.utils.data import IterableDataset, get_worker_info

    class Batches(IterableDataset):
        def __iter__(self) -> Iterator[dict[str, Any]]:
            info = get_worker_info()
            yield from map(to_torch, StoredBatches(path, info.id if info else 0, info.num_workers if info else 1, names))

    return Batches()


def to_torch(batch: dict[str, Any]) -> dict[str, Any]:
    """The arrays of a batch as tensors; bfloat16 bits as bfloat16. torch is needed only here."""
    import torch

    def tensor(x: np.ndarray):
        return torch.from_numpy(np.ascontiguousarray(x).view(np.int16)).view(torch.bfloat16) if x.dtype == np.uint16 else torch.from_numpy(np.ascontiguousarray(x))

    return {k: tensor(v) if isinstance(v, np.ndarray) else v for k, v in batch.items()}


def distinct_stems(tracks: DataFrame) -> DataFrame:
    """Tracks whose stem another track has too, which would make labels ambiguous."""
    return tracks.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
