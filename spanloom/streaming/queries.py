"""Query batches as a stream: each micro-batch of queries is answered against the static tracks.

Each micro-batch reads of the tracks what its queries touch, chunks of files or stored tiles; no state is kept and late
queries are answered like any others.
Back-pressure is the source's limit on files or rows per trigger. Each micro-batch is written under its own number and
replaced when it is run again, so a restart after a failure leaves every result once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.collection import TrackCollection
from spanloom.operators.values import value_arrays

NUMBER = "micro_batch"


def read_queries(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Queries as a stream of Parquet files of a folder, or of one file, of the schema the files already there have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(path):  # a stream watches folders
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def answer(queries: DataFrame, collection: TrackCollection, out: str, checkpoint: str, window_size: int = 1, default: float = 0.0, available_now: bool = True) -> StreamingQuery:
    """Start writing ``value_arrays`` of a stream of queries, with their batch_id, below ``out``.

    With ``available_now`` the stream ends when it has answered what is there; ``stop()`` ends it at any time, and it
    may be started again. A micro-batch is kept while it is answered, as it is read several times.
    """

    def one(batch: DataFrame, number: int) -> None:
        valid = batch.dropna(subset=["query_id", "chrom", "start", "end"]).persist()
        try:
            arrays = value_arrays(valid, collection.tracks, collection.steps_near(valid), window_size, default, repeats=collection.repeats)
            named = arrays.join(valid.select("query_id", "batch_id"), "query_id")
            named.write.mode("overwrite").parquet(f"{out}/{NUMBER}={number}")
        finally:
            valid.unpersist()

    writer = queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def answers(spark: SparkSession, out: str) -> DataFrame:
    """What has been answered so far."""
    return spark.read.parquet(out).drop(NUMBER)


def late(queries: DataFrame, minutes: int = 60) -> DataFrame:
    """Queries received over ``minutes`` after the first of their batch, from a static table."""
    first = F.min("received_at").over(Window.partitionBy("batch_id"))
    return queries.withColumn("first_at", first).where(F.col("received_at") > F.col("first_at") + F.make_dt_interval(mins=F.lit(minutes)))
