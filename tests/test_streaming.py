from pyspark.sql import functions as F

from spanloom.collection import TrackCollection
from spanloom.operators.values import value_arrays
from spanloom.streaming import queries as stream


def test_micro_batches_answer_like_one_batch(spark, rows, tmp_path):
    q = spark.range(30).select((F.col("id") % 5).alias("batch_id"), F.col("id").alias("query_id"), F.lit("c").alias("chrom"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 8).alias("end"))
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    steps = spark.createDataFrame([(t, "c", s, s + 4, float(s + t)) for t in (0, 1) for s in range(0, 100, 6)], "track_id int, chrom string, start long, end long, value double")
    tracks = spark.createDataFrame([(0,), (1,)], "track_id int")
    collection = TrackCollection(spark, steps.union(steps), tracks, tracks, repeats=True)
    running = stream.answer(stream.read_queries(spark, str(tmp_path / "in")), collection, str(tmp_path / "out"), str(tmp_path / "state"), 2)
    running.awaitTermination(120)
    assert running.lastProgress is not None and len(list((tmp_path / "out").glob("micro_batch=*"))) == 3
    got = stream.answers(spark, str(tmp_path / "out"))
    assert rows(got.drop("batch_id")) == rows(value_arrays(q, tracks, steps, 2))
    assert got.where(F.col("batch_id") != F.col("query_id") % 5).count() == 0


def test_stopping_and_going_on(spark, rows, tmp_path):
    """A stream that is stopped and started again answers each query once; steps are read by stored tiles."""
    q = spark.range(12).select((F.col("id") % 3).alias("batch_id"), F.col("id").alias("query_id"), F.lit("c").alias("chrom"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 8).alias("end"))
    q.where("query_id < 6").coalesce(1).write.parquet(str(tmp_path / "in"))
    steps = spark.createDataFrame([(t, "c", s, s + 4, float(s + t)) for t in (0, 1) for s in range(0, 100, 6)], "track_id int, chrom string, start long, end long, value double")
    tracks = spark.createDataFrame([(0,), (1,)], "track_id int")
    TrackCollection(spark, steps, tracks, tracks).store(str(tmp_path / "tiles"), 16)
    collection = TrackCollection.stored(spark, str(tmp_path / "tiles"), tracks, tracks, 16)
    start = lambda now: stream.answer(stream.read_queries(spark, str(tmp_path / "in")), collection, str(tmp_path / "out"), str(tmp_path / "state"), 2, available_now=now)
    running = start(False)
    running.processAllAvailable()
    running.stop()
    assert not running.isActive and stream.answers(spark, str(tmp_path / "out")).select("query_id").distinct().count() == 6
    q.where("query_id >= 6").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start(True).awaitTermination(120)
    assert rows(stream.answers(spark, str(tmp_path / "out")).drop("batch_id")) == rows(value_arrays(q, tracks, steps, 2))


def test_late_queries(spark, rows):
    q = spark.createDataFrame([(1, 1, "2020-01-01 00:00:00"), (1, 2, "2020-01-01 00:30:00"), (1, 3, "2020-01-01 02:00:00")], "batch_id long, query_id long, t string")
    q = q.withColumn("received_at", F.to_timestamp("t"))
    assert rows(stream.late(q).select("query_id")) == [(3,)]
