import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm import quantiles as q

SCHEMA = "g string, d int, v double, bucket int"


def nearest(values, pct):
    return sorted(values)[math.floor(pct / 100 * (len(values) - 1))]


def test_bounded_error_and_merging(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "b", None]), rnd.randrange(3), rnd.choice([0.0, rnd.gauss(0, 10), -rnd.random() * 1e-9, rnd.random() * 1e12]), 5) for _ in range(3000)]
    df = spark.createDataFrame(data + [("a", 0, None, 1), ("a", 0, math.nan, 1), ("none", 0, None, 1)], SCHEMA)
    days = q.sketch(df, "v", ["g", "d"])
    merged = q.merge(days, ["g"])
    direct = q.sketch(df, "v", ["g"])
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, direct.collect()))
    for r in q.percentiles(merged, ["g"], [0, 20, 50, 80, 100]).collect():
        own = [v for g, _, v, _ in data if g == r.g]
        assert r.n_values == len(own)
        for p in (0, 20, 50, 80, 100):
            true = nearest(own, p)
            assert abs(r[f"p{p}"] - true) <= q.ACCURACY * abs(true) * 1.0001 + 1e-300


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False))
def test_bucket_arithmetic(v):
    width, shift = math.log((1 + q.ACCURACY) / (1 - q.ACCURACY)), q._shift(q.ACCURACY)
    if v not in (0.0, math.inf, -math.inf):
        assert 0 < math.ceil(math.log(abs(v)) / width) + shift <= 2 * shift


def test_infinities_and_order(spark):
    values = [-math.inf, -1e300, -1.0, -1e-310, 0.0, 5e-324, 2.0, 1e308, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", q.bucket_of(F.col("v")).alias("b"), q.value_of(q.bucket_of(F.col("v"))).alias("w")).collect()
    b = {r.v: r.b for r in df}
    assert [b[v] for v in values] == sorted(b.values()) and len(set(b.values())) == len(values)
    w = {r.v: r.w for r in df}
    assert w[math.inf] == math.inf and w[-math.inf] == -math.inf and w[0.0] == 0.0 and abs(w[2.0] - 2) < 0.02


def test_empty_and_wrong_accuracy(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert q.percentiles(q.sketch(df, "v", ["g"]), ["g"], [50]).count() == 0
    with pytest.raises(ValueError):
        q.bucket_of(F.col("v"), 0.0)


def test_outlying_days(spark):
    data = [("a", d, float(v), 0) for d in range(4) for v in range(1, 101)] + [("a", 9, v * 3.0, 0) for v in range(1, 101)] + [("a", 8, v * 9.0, 0) for v in range(1, 20)]
    data += [("n", d, -float(v), 0) for d in range(4) for v in range(1, 101)] + [("n", 9, -v * 3.0, 0) for v in range(1, 101)] + [(None, 9, 1.0, 0)] * 99
    got = q.outlying_days(q.sketch(spark.createDataFrame(data, SCHEMA), "v", ["g", "d"]), "g", "d", [50]).collect()
    assert sorted(tuple(r) for r in got) == [("a", 9, 50), ("n", 9, 50)]
