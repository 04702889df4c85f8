import hashlib
import random

import pytest

from spanloom.llm import group_split as g


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            parent[root(u)] = root(v)
    return {x: root(x) for x in parent}


def same_partition(a, b):
    assert set(a) == set(b)
    assert len(set(a.values())) == len(set(b.values())) == len({(a[x], b[x]) for x in a})


def test_components_of_random_graphs(spark):
    rnd = random.Random(1)
    edges = [(f"v{rnd.randrange(300)}", f"v{rnd.randrange(300)}") for _ in range(220)] + [("lone", "lone"), (None, "v1"), ("v2", None)]
    edges += [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [("hub", "h1")]
    got = {r.vertex: r.component for r in g.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    same_partition(got, union_find(edges))
    assert all(got[c] == c for c in set(got.values()))


def test_no_edges(spark):
    assert g.components(spark.createDataFrame([], "u string, v string")).count() == 0
    assert [tuple(r) for r in g.components(spark.createDataFrame([("a", "a")], "u string, v string")).collect()] == [("a", "a")]


def test_record_edges_keep_columns_apart(spark):
    df = spark.createDataFrame([("x", "x", None), ("x", None, "s"), (None, None, None), ("y", None, None), ("x", "x", None)], "author string, source string, entity string")
    assert sorted(tuple(r) for r in g.record_edges(df, ["author", "source", "entity"]).collect()) == [("author=x", "entity=s"), ("author=x", "source=x")]


def test_shares(spark):
    rnd = random.Random(3)
    weights = [(f"c{i}", rnd.randrange(1, 50)) for i in range(400)] + [("big", 4000)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.08), ("test", 0.12), ("none", None)], "split_name string, target_share double")
    given = g.split_components(spark.createDataFrame(weights, "component string, weight long"), targets).collect()
    assert sorted((r.component, r.weight) for r in given) == sorted(weights)
    total = sum(w for _, w in weights)
    for name, share in (("train", 0.8), ("validation", 0.08), ("test", 0.12)):
        assert abs(sum(r.weight for r in given if r.split_name == name) / total - share) < 0.01
    assert g.split_components(spark.createDataFrame([], "component string, weight long"), targets).count() == 0


def test_components_named_by_least(spark):
    edges = [(f"v{i % 7}", f"v{i}") for i in range(60)] + [("z", "b"), ("b", "q"), ("w", "w")]
    labels = g.components(spark.createDataFrame(edges, "u string, v string"))
    got = {r.vertex: r.component for r in g.named_by_least(labels).collect()}
    same_partition(got, union_find(edges))
    assert all(c == min(v for v in got if got[v] == c) for c in got.values())


@pytest.mark.parametrize("piece_rows", [1 << 16, 7])
def test_cumulative_is_a_prefix_sum(spark, piece_rows):
    """The second value of the first column has most of the rows, all alike, and is cut into many pieces."""
    data = [(i % 5, f"k{i}", i) for i in range(200)] + [(1, f"s{i}", 1) for i in range(900)]
    df = spark.createDataFrame(data, "a int, b string, w long")
    got = {r.b: r["at"] for r in g.cumulative(df, ["a", "b"], "w", "at", piece_rows).collect()}
    total = 0
    for _, b, w in sorted(data, key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest())):
        assert got[b] == total
        total += w
    assert len(got) == len(data)


def test_misplaced(spark):
    data = [(1, "a", "train"), (2, "a", "train"), (3, "a", "test"), (4, "b", "test"), (5, "b", "train"), (6, None, "test"), (7, "a", None)]
    got = g.misplaced(spark.createDataFrame(data, "id int, component string, split string"), "component", "split")
    assert sorted(r.id for r in got.collect()) == [3, 5]
