import random

from spanloom.operators.periods import periods_and_gaps

SCHEMA = "panel long, chrom string, start long, end long, kind string"


def brute(data):
    groups = {}
    for p, c, s, e, _ in data:
        if s is not None and e is not None and e > s:
            groups.setdefault((p, c), []).append((s, e))
    out = []
    for (p, c), spans in groups.items():
        joined = []
        for s, e in sorted(spans):
            if joined and s <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], e)
            else:
                joined.append([s, e])
        out += [(p, c, "period", s, e) for s, e in joined] + [(p, c, "gap", a[1], b[0]) for a, b in zip(joined, joined[1:])]
    return sorted(out, key=repr)


def test_touching_nested_repeated_and_incomplete(spark, rows):
    data = [(1, "a", 0, 5, "x"), (1, "a", 5, 7, "x"), (1, "a", 1, 2, "x"), (1, "a", 1, 2, "x"), (1, "a", 10, 12, "x"), (1, "b", 3, 3, "x"), (1, "b", None, 3, "x"), (None, None, 4, 6, None), (None, None, 8, 9, None)]
    got = rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["panel", "chrom"]))
    assert got == brute(data)
    assert (None, None, "gap", 6, 8) in got


def test_random_over_small_blocks(spark, rows):
    rnd = random.Random(5)
    data = [(rnd.choice([1, 2, None]), rnd.choice("ab"), s := rnd.randrange(0, 3000), s + rnd.choice([0, 1, 5, 30, 400]), "k") for _ in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(periods_and_gaps(df, ["panel", "chrom"], block=64)) == brute(data)


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA), ["panel", "chrom"]).count() == 0
