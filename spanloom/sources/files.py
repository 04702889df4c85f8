"""Opening files by path, or by the URI of any store that pyarrow knows (file, s3, gs, hdfs, ...)."""

from __future__ import annotations

import os
from typing import Any

from pyarrow import fs


def is_uri(path: Any) -> bool:
    return isinstance(path, str) and "://" in path


def opened(path: str):
    """A binary file to read and seek in."""
    if not is_uri(path):
        return open(path, "rb")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def size(path: str) -> int:
    if not is_uri(path):
        return os.stat(path).st_size
    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).size


def exists(path: str) -> bool:
    if not is_uri(path):
        return os.path.exists(path)
    store, inner = fs.FileSystem.from_uri(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def below(uri: str, crawl: bool) -> list[str] | None:
    """URIs of the files of a folder, with sub-folders if ``crawl``; the file itself if it is one; None if there is neither."""
    store, inner = fs.FileSystem.from_uri(uri)
    at = uri.rindex(inner)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        return None
    if info.type == fs.FileType.File:
        return [uri]
    listed = store.get_file_info(fs.FileSelector(inner, recursive=crawl))
    return [uri[:at] + f.path + uri[at + len(inner) :] for f in listed if f.type == fs.FileType.File]
