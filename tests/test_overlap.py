import bisect
import random

import pytest

from spanloom.operators import blocks, overlap


def test_join_equals_brute_force(spark, rows):
    rnd = random.Random(3)
    span = lambda n: (s := rnd.randrange(5000), s + rnd.choice([0, 1, 9, 60, 900]))
    q = [(i, rnd.choice(["a", "b", None]), *span(i)) for i in range(60)]
    x = [(rnd.choice(["a", "b", None]), *span(i), i) for i in range(120)]
    qd = spark.createDataFrame(q, "qid int, chrom string, q_start long, q_end long")
    xd = spark.createDataFrame(x, "chrom string, start long, end long, xid int")
    expected = sorted(((i, j) for i, c, a, b in q for d, s, e, j in x if c is not None and c == d and s < b and e > a and e > s and b > a), key=repr)
    for size in (16, 128, 4096):
        assert rows(overlap.overlap_join(qd, xd, bin_size=size).select("qid", "xid")) == expected


def test_clashing_names_and_empty_sides(spark):
    qd = spark.createDataFrame([("a", 0, 9, 1)], "chrom string, q_start long, q_end long, value int")
    xd = spark.createDataFrame([("a", 3, 5, 2)], "chrom string, start long, end long, value int")
    got = overlap.overlap_join(qd, xd).first()
    assert (got["value"], got["value_right"]) == (1, 2)
    assert overlap.overlap_join(qd.limit(0), xd).count() == 0
    with pytest.raises(ValueError):
        overlap.overlap_join(xd, xd, q=("start", "end"))


def test_touched_keeps_repeats(spark, rows):
    x = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 50, 60)], "chrom string, start long, end long")
    q = spark.createDataFrame([("a", 5, 7), ("a", 6, 30), ("b", 50, 60)], "chrom string, q_start long, q_end long")
    assert rows(overlap.touched(x, q, bin_size=8)) == [("a", 0, 10), ("a", 0, 10)]


SEGMENTS = {1: [5, 10, 12, 18], 2: [1, 3, 5, 7, 9, 10], 3: list(range(1, 15)), 4: [4, 100]}


@pytest.mark.parametrize("side, absolute", [("left", False), ("right", False), ("left", True), ("right", True)])
@pytest.mark.parametrize("size", [4, 4096])
def test_searchsorted(spark, rows, side, absolute, size):
    values = spark.createDataFrame([(s, v) for s, vs in SEGMENTS.items() for v in [*vs, None]], "segment int, v long")
    queries = spark.createDataFrame([(s, q) for s in SEGMENTS for q in (7, 9, 11)] + [(9, 7), (1, None)], "segment int, q long")
    find = bisect.bisect_left if side == "left" else bisect.bisect_right
    firsts, total = {}, 0
    for s, vs in SEGMENTS.items():
        firsts[s] = total
        total += len(vs)
    expected = [(s, q, find(vs, q) + (firsts[s] if absolute else 0)) for s, vs in SEGMENTS.items() for q in (7, 9, 11)]
    got = rows(overlap.searchsorted(values, queries, "segment", "v", "q", side, size, absolute))
    assert [r for r in got if r[0] != 9] == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        overlap.searchsorted(values, queries, "segment", "v", "q", "middle")


def test_row_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (5, 900, 3, 70, None, 3)], "k long")
    got = blocks.numbered(df, "k", 64).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(6)) and [r.k for r in got] == [None, 3, 3, 5, 70, 900]
