from spanloom.plans import signal


def test_batches_grow_with_the_regions(spark, tmp_path):
    spark.createDataFrame([("chr1", "1", 1 << 40, 1)], "chrom string, alt_name string, chrom_size long, chrom_rank int").write.parquet(str(tmp_path / "chroms.parquet"))
    spark.createDataFrame([(t,) for t in range(4)], "track_id int").write.parquet(str(tmp_path / "tracks.parquet"))
    for n in (1, 21, 50):  # batches, below and above those of a fixed number of draws
        spark.createDataFrame([(1, "1", 1000, 1000 + n * signal.BATCH * 1000 + 7)], "interval_id long, chr string, start long, end long").write.mode("overwrite").parquet(str(tmp_path / "some_intervals.parquet"))
        got = signal.queries()["query_batches_epoch"](spark, str(tmp_path)).groupBy("batch_id").count().collect()
        assert sorted(tuple(r) for r in got) == [(i, signal.BATCH) for i in range(n)]
