"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only a session that names none, as in tests, gets one of its own, and only in local mode.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spanloom-")
        context.setCheckpointDir(shared)
    return shared


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    shared = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a path of the file system that all executors mount."""
    shared = shared_folder(spark)
    if "://" in shared and not shared.startswith("file://"):
        raise ValueError("files of these formats are written to a mounted file system")
    folder = Path("/" + shared.removeprefix("file:").lstrip("/")) / f"{name}-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return str(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
