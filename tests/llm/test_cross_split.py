import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import cross_split as c

SCHEMA = "id long, key string, s long, e long, split string, source string, edits int"


def share(a, b):
    return min(a[1], b[1]) - max(a[0], b[0]) >= 0.9 * max(a[1] - a[0], b[1] - b[0]) - 1e-9


def brute(data):
    good = [r for r in data if None not in r[:5] and r[3] > r[2]]
    return sorted((a[0], b[0]) for a in good if a[4] == "train" for b in good if b[4] != "train" and a[1] == b[1] and share(a[2:4], b[2:4]))


def rows(seed, n):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        s = rnd.randrange(60)
        e = s + rnd.choice([0, -3, 1, 2, 9, 10, 11, 30, 33, 100, 111, rnd.randrange(1, 3000)])
        data.append((i, rnd.choice(["a", "b", None]), s, rnd.choice([e, e, e, None]), rnd.choice(["train", "train", "test", "validation", None]), rnd.choice(["x", None]), 1))
    return data


def test_pairs_equal_brute_force(spark):
    data = rows(1, 700)
    got = sorted((r.train_id, r.held_id) for r in c.row_pairs(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == brute(data) and len(got) > 100


def test_lengths_near_every_class_border(spark):
    data, i = [], 0
    for length in range(1, 130):
        for move in (0, length // 10, length // 10 + 1):
            data.append((i, f"k{length}", 1000, 1000 + length, "train", None, 0))
            data.append((i + 1, f"k{length}", 1000 + move, 1000 + length, "test", None, 0))
            data.append((i + 2, f"k{length}", 1000 - move, 1000 + length, "test", None, 0))
            i += 3
    got = sorted((r.train_id, r.held_id) for r in c.row_pairs(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == brute(data)


def test_counts(spark):
    data = rows(2, 500)
    pairs = brute(data)
    got = {(r.split, r.source): (r.n_held, r.n_leaked, r.n_pairs) for r in c.leak_counts(spark.createDataFrame(data, SCHEMA)).collect()}
    expected = {}
    for r in data:
        if None not in r[:5] and r[3] > r[2] and r[4] != "train":
            n = sum(h == r[0] for _, h in pairs)
            old = expected.get(r[4:6], (0, 0, 0))
            expected[r[4:6]] = (old[0] + 1, old[1] + (n > 0), old[2] + n)
    assert got == expected


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=9), st.text("ab", max_size=9)), min_size=1, max_size=8), st.integers(0, 5))
def test_banded_distances(pairs, k):
    def matrix(words):
        out = np.full((len(words), max(map(len, words))), -1)
        for i, w in enumerate(words):
            out[i, : len(w)] = [ord(x) for x in w]
        return out, np.array([len(w) for w in words])

    got = c.banded_distances(*matrix([a for a, _ in pairs]), *matrix([b for _, b in pairs]), k)
    assert got.tolist() == [min(plain_distance(a, b), k + 1) for a, b in pairs]


def damaged(rnd, text, n):
    for _ in range(n):
        at = rnd.randrange(len(text) + 1)
        text = text[:at] + rnd.choice(["", "a", "b", "ab"]) + text[at + rnd.choice([0, 1]) :]
    return text


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_texts_equal_brute_force(spark, similarity):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.choice([1, 2, 4, 7, 12, 20, 33, 60]))) for _ in range(60)]
    train = base + [damaged(rnd, t, rnd.randrange(4)) for t in base] + [None, "", base[0]]
    held = [damaged(rnd, t, rnd.randrange(1 + len(t) // 4)) for t in base] + base[:9] + [None, ""]
    found = c.near_texts(*[spark.createDataFrame([(t, 1) for t in x], "text string, n int") for x in (train, held)], similarity)
    got = sorted((r.train_text, r.held_text, r.edits) for r in found.collect())
    every = sorted((t, h, plain_distance(t, h)) for t in {t for t in train if t} for h in {h for h in held if h})
    assert got == [p for p in every if p[2] <= len(p[1]) * (1 - similarity) + 1e-9] and len(got) > 40


def test_long_texts_and_no_texts(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    near, far = damaged(rnd, text, 40), damaged(rnd, text, 400)
    held = spark.createDataFrame([(text,)], "text string")
    got = c.near_texts(spark.createDataFrame([(near,), (far,)], "text string"), held, 0.9).collect()
    assert [(r.train_text, r.edits) for r in got] == [(near, plain_distance(near, text))]
    assert c.near_texts(held.limit(0), held).count() == 0 and c.near_texts(held, held.limit(0)).count() == 0
    with pytest.raises(ValueError):
        c.near_texts(held, held, 0.5)


@pytest.mark.parametrize("scale", [1, 1000, 100_000_007])
def test_intervals_of_every_size(spark, scale):
    rnd = random.Random(scale)
    data = []
    for i in range(900):
        length = max(1, int(scale * rnd.choice([1, 2, 3, 5, 8, 13, 40]) * rnd.uniform(0.85, 1.15)))
        s = int(scale * rnd.choice([0, 100, 200]) + length * rnd.uniform(-0.15, 0.15))
        data.append((i, rnd.choice("ab"), s, s + length, rnd.choice(["train", "test"]), None, 0))
    got = sorted((r.train_id, r.held_id) for r in c.row_pairs(spark.createDataFrame(data, SCHEMA)).collect())
    assert got == brute(data) and len(got) > 300


def test_empty_and_share(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.row_pairs(df).count() == 0 and c.leak_counts(df).count() == 0
    with pytest.raises(ValueError):
        c.near_pairs(df, df, 0.4)
