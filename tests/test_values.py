import math
import random

import numpy as np
import pytest

from spanloom.collection import TrackCollection
from spanloom.operators import values as val

T0 = [(0, 5, 10, 20.0), (0, 10, 12, 30.0), (0, 12, 14, 40.0), (0, 18, 20, 50.0)]
T1 = [(1, 8, 9, 60.0), (1, 9, 10, 70.0), (1, 10, 14, 80.0), (1, 18, 22, 90.0), (1, 25, 55, 100.0)]
T2 = [(2, 10, 20, 110.0), (2, 100, 200, 120.0), (2, 1000, 2000, 130.0)]
FULL = [(0, 1, 3, 20.0), (0, 3, 10, 15.0), (0, 10, 12, 30.0), (0, 12, 16, 40.0), (0, 16, 20, 50.0)]
GAP = [(0, 1, 3, 20.0), (0, 10, 12, 30.0), (0, 12, 16, 40.0), (0, 16, 20, 50.0)]


def run(spark, steps, queries, window=1, default=0.0, tracks=(0,), track_ids=None):
    s = spark.createDataFrame([(t, "c", a, b, v) for t, a, b, v in steps], "track_id int, chrom string, start long, end long, value double")
    q = [(i, "c", a, b) for i, (a, b) in enumerate(queries)]
    qdf = spark.createDataFrame(q, "query_id long, chrom string, start long, end long")
    if track_ids is not None:
        qdf = spark.createDataFrame([(*x, t) for x, t in zip(q, track_ids)], "query_id long, chrom string, start long, end long, track_ids array<int>")
    dim = spark.createDataFrame([(t,) for t in tracks], "track_id int")
    return val.value_arrays(qdf, dim, s, window, default)


def arrays(df):
    return {(r.query_id, r.track_id): r["values"] for r in df.collect()}


@pytest.mark.parametrize("default", [0.0, math.nan])
@pytest.mark.parametrize(
    "steps, query, expected",
    [
        (FULL, (2, 17), [20] + [15] * 7 + [30] * 2 + [40] * 4 + [50]), (GAP, (6, 18), ["x"] * 4 + [30] * 2 + [40] * 4 + [50] * 2), (GAP, (10, 18), [30] * 2 + [40] * 4 + [50] * 2),
        (T0, (9, 16), [20, 30, 30, 40, 40, "x", "x"]), (T0, (9, 14), [20, 30, 30, 40, 40]), (T0, (9, 20), [20, 30, 30, 40, 40] + ["x"] * 4 + [50, 50]),
    ],
)
def test_per_base(spark, steps, query, expected, default):
    got = arrays(run(spark, steps, [query], 1, default))[(0, 0)]
    np.testing.assert_array_equal(got, [default if x == "x" else x for x in expected])


@pytest.mark.parametrize(
    "steps, query, w, zero, nan",
    [
        (FULL, (2, 17), 5, [16, 21, 42], [16, 21, 42]), (GAP, (6, 18), 3, [0, 20, 40, 140 / 3], [math.nan, 30, 40, 140 / 3]), (GAP, (10, 18), 4, [35, 45], [35, 45]),
        (T0, (8, 16), 4, [25, 20], [25, 40]), (T0, (8, 14), 3, [70 / 3, 110 / 3], [70 / 3, 110 / 3]), (T0, (8, 20), 3, [70 / 3, 110 / 3, 0, 100 / 3], [70 / 3, 110 / 3, math.nan, 50]),
    ],
)
def test_windows(spark, steps, query, w, zero, nan):
    np.testing.assert_allclose(arrays(run(spark, steps, [query], w))[(0, 0)], zero)
    np.testing.assert_allclose(arrays(run(spark, steps, [query], w, math.nan))[(0, 0)], nan)
    d = 2.5
    covered = arrays(run(spark, [(t, a, b, 1.0) for t, a, b, _ in steps], [query], w))[(0, 0)]
    np.testing.assert_allclose(arrays(run(spark, steps, [query], w, d))[(0, 0)], [z + (1 - c) * d for z, c in zip(zero, covered)])


def test_cube_of_tracks_and_queries(spark):
    queries = [(7, 18), (9, 20), (20, 31), (99, 110)]
    got = arrays(run(spark, T0 + T1 + T2, queries, 1, math.nan, (0, 1, 2)))
    for q, (a, b) in enumerate(queries):
        for t, steps in enumerate((T0, T1, T2)):
            expected = [next((v for _, s, e, v in steps if s <= p < e), math.nan) for p in range(a, b)]
            np.testing.assert_array_equal(got[(q, t)], expected)


@pytest.mark.parametrize("length, w", [(8, 3), (9, 2), (10, 4), (13, 10), (23, 11), (5, 9)])
def test_last_partial_window_is_dropped(spark, length, w):
    one = arrays(run(spark, T0 + T1, [(7, 7 + length)], 1, math.nan, (0, 1)))
    some = arrays(run(spark, T0 + T1, [(7, 7 + length)], w, math.nan, (0, 1)))
    for t in (0, 1):
        base = np.array(one[(0, t)])[: length // w * w].reshape(-1, w)
        expected = [np.nan if np.isnan(x).all() else np.nanmean(x) for x in base]
        np.testing.assert_allclose(some[(0, t)], expected)


def test_random_tracks(spark):
    rnd = random.Random(9)
    steps = []
    for t in range(3):
        at = 0
        for _ in range(15):
            at += rnd.randrange(1, 50)
            end = at + rnd.randrange(1, 100)
            steps.append((t, at, end, float(rnd.randrange(-50, 50))))
            at = end
    queries = [(a := rnd.randrange(1, 900), a + 200) for _ in range(6)]
    for w, default in ((1, 0.0), (7, 5.6), (3, math.nan)):
        got = arrays(run(spark, steps, queries, w, default, (0, 1, 2)))
        for q, (a, b) in enumerate(queries):
            for t in range(3):
                line = np.full(b - a, np.nan)
                for tt, s, e, v in steps:
                    if tt == t:
                        line[max(s - a, 0) : max(min(e, b) - a, 0)] = v
                cut = line[: len(line) // w * w].reshape(-1, w)
                expected = [(np.nan if np.isnan(x).all() else np.nanmean(x)) if default != default else np.where(np.isnan(x), default, x).mean() for x in cut]
                np.testing.assert_allclose(got[(q, t)], expected)


def test_own_tracks_in_their_order_and_cube(spark):
    df = run(spark, T0 + T1, [(9, 12), (9, 12)], 1, 0.0, (0, 1), [[1, 0], None])
    cube = {r.query_id: r["values"] for r in val.dense(df).collect()}
    assert cube[0] == [[70.0, 20.0], [80.0, 30.0], [80.0, 30.0]]
    assert cube[1] == [[20.0, 70.0], [30.0, 80.0], [30.0, 80.0]]


def test_null_and_nan_steps(spark):
    steps = [(0, 0, 5, None), (0, 5, 10, math.nan), (None, 10, 12, 1.0), (0, 12, None, 1.0)]
    got = arrays(run(spark, steps, [(0, 12)], 4))[(0, 0)]
    assert got[0] == 0.0 and math.isnan(got[1]) and math.isnan(got[2])


def test_repeated_steps_count_once(spark):
    steps = [(0, 0, 5, 2.0), (0, 0, 5, 2.0), (0, 5, 7, 3.0), (0, 5, 7, 3.0), (0, 5, 7, 3.0)]
    s = spark.createDataFrame([(t, "c", a, b, v) for t, a, b, v in steps], "track_id int, chrom string, start long, end long, value double")
    q = spark.createDataFrame([(0, "c", 0, 8), (1, "c", 4, 12)], "query_id long, chrom string, start long, end long")
    for w, expected in ((1, [2.0] * 5 + [3.0] * 2 + [0.0]), (4, [2.0, 2.0])):
        assert arrays(val.value_arrays(q, s.select("track_id").distinct(), s, w, repeats=True))[(0, 0)] == expected


@pytest.mark.parametrize("tile", [7, 64, 1 << 20])
def test_stored_tiles_give_the_same_values(spark, rows, tmp_path, tile):
    steps = spark.createDataFrame([(t, c, s, s + 9, float(s + t)) for t in (0, 1) for c in ("c", "d") for s in range(0, 300, 11)] + [(0, "c", 400, None, 1.0)], "track_id int, chrom string, start long, end long, value double")
    tracks = spark.createDataFrame([(0,), (1,)], "track_id int")
    whole = TrackCollection(spark, steps, tracks, tracks)
    whole.store(str(tmp_path), tile)
    parts = TrackCollection.stored(spark, str(tmp_path), tracks, tracks, tile)
    asked = (["c", "d", "c", "x"], [0, 50, 295, 0], [20, 70, 315, 20])
    assert rows(parts.values(asked, 4)) == rows(whole.values(asked, 4))
    if tile == 7:
        assert parts.steps_near(parts.queries((["c"], [14], [21]))).select("start").distinct().count() < 4
    assert parts.values(([], [], [])).count() == 0


def test_query_without_any_step(spark):
    assert arrays(run(spark, [], [(0, 4)], 2, 1.5)) == {(0, 0): [1.5, 1.5]}


def test_equal_lengths(spark):
    q = spark.createDataFrame([(0, "c", 2, 4), (1, "c", 2, 5)], "query_id long, chrom string, start long, end long")
    with pytest.raises(ValueError):
        val.require_equal_lengths(q)
    assert val.require_equal_lengths(q.limit(0)) == 0


@pytest.mark.parametrize("w", [1, 2, 3, 4, 5])
def test_smoothing_like_convolution(spark, w):
    line = [1.0, 5.0, -2.0, 0.0, 7.0, 3.0]
    df = spark.createDataFrame([(0, 0, 0, line)], "query_id long, track_no int, track_id int, values array<double>")
    np.testing.assert_allclose(val.smoothed(df, w).first()["values"], np.convolve(line, np.ones(w) / w, "same"))


def test_smoothing_lines_of_several_lengths(spark):
    lines = [[1.0, 5.0, -2.0], [], [4.0, math.nan, 1.0, 2.0, 9.0], [3.0, 3.0, 3.0]]
    df = spark.createDataFrame([(i, 0, 0, x) for i, x in enumerate(lines) if x], "query_id long, track_no int, track_id int, values array<double>")
    for r in val.smoothed(df, 3).collect():
        np.testing.assert_allclose(r["values"], np.convolve(lines[r.query_id], np.ones(3) / 3, "same"))
    with pytest.raises(Exception, match="wider than the values"):
        val.smoothed(df, 4).collect()
    assert val.smoothed(df.limit(0), 3).count() == 0


def test_overlapping_steps_are_found(spark):
    s = spark.createDataFrame([(0, "c", 0, 5, 1.0), (0, "c", 4, 9, 1.0), (1, "c", 4, 9, 1.0)], "track_id int, chrom string, start long, end long, value double")
    assert [tuple(r) for r in val.check_steps(s).collect()] == [(0, "c", 4, 9)]
