"""Finding signal files, and per-path settings by partial path."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.sources.files import below, is_uri

EXTENSIONS = (".bigWig", ".bw")


def find_files(path: Any, extensions: Iterable[str] = EXTENSIONS, crawl: bool = True) -> list[str]:
    """Signal files of a file, a folder (with sub-folders if ``crawl``), or a nested iterable of both, sorted, each once.

    A path may be the URI of a remote store. FileNotFoundError for what doesn't exist, ValueError for what is no path.
    """
    if is_uri(path):
        found = below(path, crawl)
        if found is None:
            raise FileNotFoundError(f"no such file or folder: {path}")
        return sorted(f for f in found if f == path or f.split("?")[0].endswith(tuple(extensions)))
    if isinstance(path, (str, os.PathLike)):
        p = Path(path)
        if p.is_file():
            return [str(p)]
        if not p.is_dir():
            raise FileNotFoundError(f"no such file or folder: {p}")
        return sorted({str(f) for e in extensions for f in (p.rglob(f"*{e}") if crawl else p.glob(f"*{e}")) if f.is_file()})
    if isinstance(path, Iterable):
        return sorted({f for part in path for f in find_files(part, extensions, crawl)})
    raise ValueError(f"not a path: {path!r}")


def partial_paths(path: str) -> list[str]:
    """Runs of consecutive parts of a path, the most telling first.

    Runs that end with the file come first, the longer before the shorter, each followed by itself without the file's
    suffix; then those that end with its folder, and so on upwards.
    """
    parts = [p for p in PurePosixPath(path).parts if p != "/"]
    bare = parts[:-1] + [PurePosixPath(path).stem]
    out = []
    for end in range(len(parts), 0, -1):
        for start in range(end):
            out.append("/".join(parts[start:end]))
            if end == len(parts) and bare != parts:
                out.append("/".join(bare[start:]))
    return out


def value_for_path(path: str, values: Mapping[str, Any], default: Any = None) -> Any:
    """The value of the first key met among the partial paths of ``path``."""
    keys = {str(PurePosixPath(k)).strip("/"): v for k, v in values.items()}
    return next((keys[p] for p in partial_paths(path) if p in keys), default)


def tracks_with_scale(tracks: DataFrame, scales: DataFrame, default: float = 1.0) -> DataFrame:
    """``tracks`` with ``scale`` from ``(key, scale)`` rows: the first key met among a track's partial paths wins.

    Every track is exploded to its few partial paths, which are joined on equality with the keys.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    last = F.regexp_replace(F.element_at("__parts", -1), r"\.[^.]*$", "")
    n = F.size("__parts")
    run = lambda i, k: F.array_join(F.slice("__parts", i + 1, k - i), "/")
    bare = lambda i, k: F.when(k == n, F.array_join(F.concat(F.slice("__parts", i + 1, k - i - 1), F.array(last)), "/"))
    every = F.flatten(F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.array(run(i, k), bare(i, k))))))
    listed = tracks.select("track_id", "path").withColumn("__parts", parts).where(n > 0).select("track_id", F.posexplode(every).alias("__at", "__key"))
    keyed = scales.select(F.regexp_replace("key", "^/+|/+$", "").alias("__key"), F.col("scale").alias("__scale"))
    best = listed.join(keyed, "__key").groupBy("track_id").agg(F.min_by("__scale", "__at").alias("__scale"))
    return tracks.drop("scale").join(best, "track_id", "left").withColumn("scale", F.coalesce("__scale", F.lit(default))).drop("__scale")
