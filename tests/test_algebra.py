import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import algebra

SCHEMA = "chrom string, start long, end long, value double"


def frame(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


MERGES = [
    ([("1", 1, 4, 1.0), ("1", 4, 9, 2.0), ("1", 12, 16, 3.0), ("1", 16, 19, 1.0)], 0, [("1", 1, 9, 2.0), ("1", 12, 19, 3.0)]),
    ([("1", 1, 4, 1.0), ("1", 4, 9, 2.0), ("1", 12, 16, 3.0), ("1", 16, 19, 1.0), ("1", 40, 45, 7.0)], 0, [("1", 1, 9, 2.0), ("1", 12, 19, 3.0), ("1", 40, 45, 7.0)]),
    ([("1", 1, 6, -1.0), ("1", 4, 9, -2.0), ("1", 12, 16, 0.0)], 0, [("1", 1, 9, -1.0), ("1", 12, 16, 0.0)]),
    ([("1", 1, 6, 1.0), ("2", 4, 9, 1.0), ("3", 12, 16, 1.0), ("3", 16, 19, 1.0), ("3", 40, 45, 1.0)], 0, [("1", 1, 6, 1.0), ("2", 4, 9, 1.0), ("3", 12, 19, 1.0), ("3", 40, 45, 1.0)]),
    ([("1", 1, 6, 1.0), ("2", 4, 9, 1.0), ("3", 12, 16, 1.0), ("3", 20, 25, 1.0), ("3", 29, 32, 1.0)], 4, [("1", 1, 6, 1.0), ("2", 4, 9, 1.0), ("3", 12, 32, 1.0)]),
    ([("1", 1, 90, 1.0), ("1", 4, 9, 5.0), ("1", 50, 60, None)], 0, [("1", 1, 90, 5.0)]),
    ([("1", 1, 2, 3.0)], 0, [("1", 1, 2, 3.0)]),
    ([], 0, []),
]


@pytest.mark.parametrize("data, gap, expected", MERGES)
@pytest.mark.parametrize("block", [4, 1 << 22])
def test_merge(spark, rows, data, gap, expected, block):
    assert rows(algebra.merge(frame(spark, data), allow_gap=gap, block=block)) == sorted(expected, key=repr)


def test_merge_random_over_blocks(spark, rows):
    rnd = random.Random(1)
    data = [(rnd.choice("ab"), s := rnd.randrange(2000), s + rnd.choice([1, 3, 20, 300]), float(rnd.randrange(-9, 9))) for _ in range(300)]
    expected = []
    for c in "ab":
        own = sorted(x for x in data if x[0] == c)
        joined = []
        for _, s, e, v in own:
            if joined and s <= joined[-1][2] + 2:
                joined[-1][2], joined[-1][3] = max(joined[-1][2], e), max(joined[-1][3], v)
            else:
                joined.append([c, s, e, v])
        expected += map(tuple, joined)
    for block in (16, 500):
        assert rows(algebra.merge(frame(spark, data), allow_gap=2, block=block)) == sorted(expected, key=repr)


SUBTRACTIONS = [
    ((4, 20), (4, 20), []), ((4, 22), (4, 20), [(20, 22)]), ((4, 20), (4, 22), []), ((6, 20), (4, 20), []), ((4, 20), (6, 20), [(4, 6)]), ((4, 20), (6, 22), [(4, 6)]),
    ((6, 22), (4, 20), [(20, 22)]), ((6, 20), (4, 22), []), ((4, 22), (6, 20), [(4, 6), (20, 22)]), ((4, 20), (100, 200), [(4, 20)]), ((4, 20), (8, 40), [(4, 8)]),
    ((4, 20), (4, 10), [(10, 20)]), ((4, 100), (10, 40), [(4, 10), (40, 100)]),
]


def test_subtract_relations(spark, rows):
    left, right, expected = [], [], []
    for i, (a, b, pieces) in enumerate(SUBTRACTIONS):
        left.append((f"c{i}", *a, float(i)))
        right.append((f"c{i}", *b))
        expected += [(f"c{i}", *p, float(i)) for p in pieces]
    left.append(("alone", 4, 20, 1.0))
    right.append(("unknown", 8, 40))
    expected.append(("alone", 4, 20, 1.0))
    got = algebra.subtract(frame(spark, left), frame(spark, right, "chrom string, start long, end long"))
    assert rows(got) == sorted(expected, key=repr)


def test_subtract_covers_difference(spark):
    rnd = random.Random(2)
    left = [("a", s := rnd.randrange(4000), s + rnd.randrange(1, 60), 1.0) for _ in range(200)]
    right = [("a", s := rnd.randrange(4000), s + rnd.randrange(1, 40)) for _ in range(120)]
    got = algebra.subtract(frame(spark, left), frame(spark, right, "chrom string, start long, end long"), buffer=3, bin_size=64).collect()
    holes = {p for _, s, e in right for p in range(max(s - 3, 0), e + 3)}
    assert sorted(p for r in got for p in range(r.start, r.end)) == sorted(p for _, s, e, _ in left for p in range(s, e) if p not in holes)


def test_subtract_of_long_and_repeated_intervals(spark, rows):
    left = [("a", 0, 1000, 1.0), ("a", 0, 1000, 1.0), ("a", 5, 1000, None), ("a", 64, 128, 2.0), ("b", 0, 640, 1.0), (None, 0, 9, 1.0), ("a", 9, 9, 1.0)]
    holes = frame(spark, [("a", 60, 70), ("a", 128, 256), ("a", 999, 1200), ("c", 0, 9), ("b", 0, 640)], "chrom string, start long, end long")
    whole = [(0, 60), (70, 128), (256, 999)]
    expected = [("a", *p, 1.0) for p in whole] * 2 + [("a", *p, None) for p in [(5, 60), *whole[1:]]] + [("a", 70, 128, 2.0)]
    for bin_size in (16, 64, 1 << 12):
        assert rows(algebra.subtract(frame(spark, left), holes, bin_size=bin_size)) == sorted(expected, key=repr)
    assert algebra.subtract(frame(spark, left), holes.limit(0)).count() == 5 and algebra.subtract(frame(spark, []), holes).count() == 0


def test_subtract_equals_brute_force_at_every_bin_size(spark, rows):
    """Holes and intervals that begin and end on borders of bins, span many, lie beyond the last hole or before the first."""
    rnd = random.Random(7)
    edge = lambda: rnd.choice([rnd.randrange(0, 60) * 8, rnd.randrange(0, 480)])
    left = [(rnd.choice("ab"), s := edge(), s + rnd.choice([1, 7, 8, 9, 16, 100, 300]), float(i)) for i in range(150)]
    right = [("a", s := edge(), s + rnd.choice([1, 8, 16, 24, 40])) for _ in range(14)] + [("b", 64, 72)]
    expected = []
    for c, s, e, v in left:
        free = [p for p in range(s, e) if not any(h[0] == c and h[1] <= p < h[2] for h in right)]
        for p in free:
            if p - 1 not in free:
                expected.append((c, p, next(q for q in range(p, e + 1) if q not in free), v))
    for bin_size in (8, 16, 48, 1 << 16):
        assert rows(algebra.subtract(frame(spark, left), frame(spark, right, "chrom string, start long, end long"), bin_size=bin_size)) == sorted(expected, key=repr), bin_size


def test_filters_and_padding(spark, rows):
    df = frame(spark, [("chr1", 3, 9, 1.0), ("chrX", 20, 30, 0.0), ("chrZ", 40, 50, -2.0)])
    assert [r[0] for r in rows(algebra.select_chromosomes(df, "standard"))] == ["chr1", "chrX"]
    assert [r[0] for r in rows(algebra.select_chromosomes(df, "chr1"))] == ["chr1"]
    assert [r[0] for r in rows(algebra.select_chromosomes(df, exclude="chr1"))] == ["chrX", "chrZ"]
    assert algebra.above(df, 0.0).count() == 3 and algebra.above(df, 0.5).count() == 1
    assert rows(algebra.padded(df.limit(1), 5))[0][1:3] == (0, 14)
    with pytest.raises(ValueError):
        algebra.padded(df, -1)


def test_scale_keeps_tracks_without_one(spark, rows):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "track_id int, value double")
    tracks = spark.createDataFrame([(1, 3.0), (2, None)], "track_id int, scale double")
    assert rows(algebra.scaled(df, tracks).select("track_id", "value")) == [(1, 6.0), (2, 2.0), (3, 2.0)]


def test_pipeline_never_touches_blacklist(spark):
    rnd = random.Random(4)
    steps = spark.createDataFrame([(t, "chr1", s, s + 20, float(rnd.randrange(9))) for t in range(3) for s in range(0, 3000, 37)], "track_id int, " + SCHEMA)
    black = spark.createDataFrame([("chr1", 500, 900), ("chr1", 850, 1000)], "chrom string, start long, end long")
    got = algebra.intervals(steps, blacklist=black, padding=30, merged=True, threshold=2.0).collect()
    assert got and all(r.end <= 500 or r.start >= 1000 for r in got)


def test_summaries(spark):
    df = spark.createDataFrame([(0, "a", 0, 10, 2.0), (0, "a", 95, 105, 4.0)], "track_id int, " + SCHEMA)
    assert tuple(algebra.covered(df).first())[1:] == (20, 2.0, 4.0, 60.0, 200.0)
    zoom = {r.cell: r for r in algebra.zoomed(df, 100).collect()}
    assert zoom[0].valid_count == 15 and zoom[1].sum_values == 20.0
    assert df.where(F.lit(False)).transform(algebra.covered).count() == 0
