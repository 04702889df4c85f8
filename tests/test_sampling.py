import pytest

from spanloom.operators import batch, sample

REGIONS = [("chr1", 0, 10), ("chr1", 100, 130), ("chr2", 5, 6), ("chr2", 9, 9), (None, 1, 5)]


def regions(spark):
    return spark.createDataFrame(REGIONS, "chrom string, start long, end long")


def test_positions_cover_all_regions_evenly(spark):
    got = sample.positions(spark, regions(spark), 4000, 1).collect()
    assert len(got) == 4000
    hits = [sum(r.chrom == c and s <= r.center < e for r in got) for c, s, e in REGIONS[:3]]
    assert sum(hits) == 4000 and all(abs(h / 4000 - (e - s) / 41) < 0.03 for h, (_, s, e) in zip(hits, REGIONS)) and hits[2] > 0


def test_regions_longer_than_31_bits(spark):
    long = spark.createDataFrame([(f"chr{i}", 0, 1 << 32) for i in range(4)], "chrom string, start long, end long")
    got = sample.positions(spark, long, 400, 1).collect()
    assert {r.chrom for r in got} == {f"chr{i}" for i in range(4)} and max(r.center for r in got) > 3 << 30


def test_same_seed_same_draw(spark, rows):
    a, b, c = (rows(sample.positions(spark, regions(spark), 50, seed)) for seed in (1, 1, 2))
    assert a == b != c
    assert sample.positions(spark, regions(spark).limit(0), 50).count() == 0


def test_cumulative_index_and_epoch(spark, rows):
    assert rows(sample.cumulative_index(regions(spark)).select("cum_start", "cum_end")) == [(0, 10), (10, 40), (40, 41)]
    assert tuple(sample.epoch_batches(regions(spark), 2, 4).first()) == (41, 5)
    assert tuple(sample.epoch_batches(regions(spark).limit(0), 2, 4).first()) == (0, 0)


def test_track_subsets(spark):
    tracks = spark.createDataFrame([(t,) for t in range(6)], "track_id int")
    ids = [r.track_ids for r in sample.track_subsets(spark.range(40).withColumnRenamed("id", "batch_id"), tracks, 2).collect()]
    assert all(len(t) == 2 and t == sorted(set(t)) for t in ids) and len({tuple(t) for t in ids}) > 5
    assert {len(r.track_ids) for r in sample.track_subsets(spark.range(3).withColumnRenamed("id", "batch_id"), tracks, 9).collect()} == {6}


def test_batches(spark, rows):
    q = spark.range(11).withColumnRenamed("id", "query_id")
    assert [r[1] for r in rows(batch.batched(q, 4).select("query_id", "batch_id")) if r[0] == 10] == [2]
    assert batch.batched(q, 4, drop_remainder=True).count() == 8
    assert batch.epoch(batch.batched(q, 4), 1).count() == 4 and batch.epoch(batch.batched(q, 4), 0).count() == 0
    assert batch.sliced(q, 2, 5).count() == 3


def test_reslicing_drops_what_fills_no_slice(spark):
    q = spark.range(32 + 3).selectExpr("id as query_id", "id div 32 as batch_id")
    got = batch.resliced(q, 5).groupBy("batch_id", "slice_id").count().collect()
    assert sorted((r.batch_id, r.slice_id, r["count"]) for r in got) == [(0, i, 5) for i in range(6)] + [(1, 0, 3)]


def test_queries_from(spark, rows):
    expected = [(0, "a", 1, 3), (1, "b", 2, 4)]
    for given in ((["a", "b"], [1, 2], [3, 4]), {"chromosomes": ["a", "b"], "starts": [1, 2], "ends": [3, 4]}):
        assert rows(batch.queries_from(spark, given)) == expected
    for wrong in (5, (["a"], [1]), {"chromosomes": ["a"]}, (["a"], [1, 2], [3])):
        with pytest.raises(ValueError):
            batch.queries_from(spark, wrong)


def test_windows(spark):
    df = batch.windows(spark.createDataFrame([(100,)], "center long"), 7)
    assert tuple(df.first()) == (100, 97, 104)
