import math
import random

from spanloom.llm.runs import collapse_runs

SCHEMA = "track_id int, chrom string, start long, end long, value float, run_day int, n_rows long"


def brute(data, min_rows=1):
    kept = sorted({r[:6] for r in data if None not in r[:6] and not math.isnan(r[4])}, key=lambda r: (r[0], r[1], r[2], r[3], r[4]))
    out = []
    for t, c, s, e, v, _ in kept:
        if out and out[-1][:2] == [t, c] and s <= out[-1][3] + 5 and abs(v - out[-1][5]) <= 0.01:
            out[-1][3], out[-1][4], out[-1][5] = e, out[-1][4] + 1, v
        else:
            out.append([t, c, s, e, 1, v])
    return sorted(tuple(r[:5]) for r in out if r[4] >= min_rows)


def got(spark, data, **k):
    df = collapse_runs(spark.createDataFrame(data, SCHEMA), **k)
    return sorted(tuple(r) for r in df.select("track_id", "chrom", "run_start", "run_end", "n_rows").collect())


def sample(seed, n):
    rnd = random.Random(seed)
    data = []
    for t in (0, 1):
        at, v = 0, 1.0
        for _ in range(n):
            at += rnd.choice([0, 0, 3, 5, 6, 40])
            end = at + rnd.randrange(1, 30)
            v = rnd.choice([v, v, v, v + 0.005, v + 1.0])
            row = (t, "c", at, end, v, 1, 7)
            data += [row] * rnd.choice([1, 1, 2])
            at = end
    return data


def test_random_over_blocks(spark):
    data = sample(1, 250)
    for block in (32, 200, 1 << 22):
        assert got(spark, data, block=block) == brute(data)
        assert got(spark, data, block=block, min_rows=3) == brute(data, 3)


def test_one_run_over_many_blocks(spark):
    data = [(0, "c", s, s + 10, 2.0, 1, 0) for s in range(0, 1000, 10)]
    assert got(spark, data, block=64) == [(0, "c", 0, 1000, 100)]


def test_incomplete_and_empty(spark):
    data = [(0, "c", 0, 5, 1.0, 1, 0), (0, "c", 5, None, 1.0, 1, 0), (0, "c", None, 9, 1.0, 1, 0), (0, None, 5, 9, 1.0, 1, 0), (0, "c", 5, 9, math.nan, 1, 0), (0, "c", 20, 24, 1.0, 1, 0)]
    assert got(spark, data) == brute(data) == [(0, "c", 0, 5, 1), (0, "c", 20, 24, 1)]
    assert got(spark, []) == []


def test_group_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, 5, 1.0, 2), (1, 5, 9, 1.0, 2)], "block int, start long, end long, value float, run int")
    r = collapse_runs(df, ["block", "run"], []).first()
    assert (r.block, r.run, r.run_start, r.run_end, r.n_rows) == (1, 2, 0, 9, 2)
