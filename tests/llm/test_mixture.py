from collections import Counter

import numpy as np
import pytest

from spanloom.llm import mixture as m

SIZES = [(i, s, n) for i, (s, n) in enumerate([(" A\t", 700), ("a", 301), ("a", 0), ("B", 90), ("b", 33), ("other", 999), (None, 50), ("a", 2000), ("b", 1), ("c", 400)])]
SIZES_SCHEMA = "doc_id long, source string, n_tokens long"
TARGETS = [("A", 0.2, 3), ("b", 0.5, 2), ("c", 0.2, 4), ("none", 0.1, 4)]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(SIZES, "doc_id long, source string, n_tokens long"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_capacity(tables):
    got = {r.source: r for r in m.capacity(*tables).collect()}
    assert {s: (r.n_docs, r.n_tokens) for s, r in got.items()} == {"A": (4, 3001), "b": (3, 124), "c": (1, 400), "none": (0, 0)}
    assert all(r.all_tokens == 3525 for r in got.values())
    assert {s for s, r in got.items() if r.short} == {"b", "none"}


def test_blocks_hold_every_token_once(tables):
    parts = m.pack(*tables, block_tokens=64).collect()
    seen, sizes = {}, Counter()
    for r in parts:
        assert 0 <= r.from_token < r.to_token
        seen.setdefault(r.doc_id, []).append((r.from_token, r.to_token))
        sizes[(r.source, r.block)] += r.to_token - r.from_token
    for doc, source, n in SIZES:
        if source and source.strip().lower() in "abc" and n:
            spans = sorted(seen[doc])
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        else:
            assert doc not in seen
    for source, total in (("A", 3001), ("b", 124), ("c", 400)):
        blocks = [sizes[(source, i)] for i in range(-(-total // 64))]
        assert blocks[:-1] == [64] * (len(blocks) - 1) and sum(blocks) == total


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5):
            assert sorted(m.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    a, b = (m.permuted(np.arange(500), np.full(500, 500), np.full(500, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(500)).mean() > 0.9


def test_slots_respect_repeats_and_shares(tables):
    slots = m.slots(*tables, block_tokens=8, shard_slots=50).collect()
    assert len(slots) == sum(-(-n // 8) for n in (3001, 124, 400))
    assert Counter(r.shard for r in slots).most_common(1)[0][1] == 50
    for source, cap, blocks in (("A", 3, 376), ("b", 2, 16), ("c", 4, 50)):
        used = Counter(r.block for r in slots if r.source == source and r.block is not None)
        drawn = sum(r.source == source for r in slots)
        assert max(used.values()) <= cap and max(used) < blocks and sum(used.values()) == min(drawn, cap * blocks)
        if source != "A":
            assert max(used.values()) - min(used[i] for i in range(blocks)) <= 1
    assert all(r.block is None for r in slots if r.source == "none")
    report = {r.source: r for r in m.shares(*tables, block_tokens=8, shard_slots=50).collect()}
    assert abs(sum(r.reached_share for r in report.values()) - 1) < 1e-9 and report["b"].short and report["b"].tokens_used == 248
    joined = m.mixture(*tables, block_tokens=8, shard_slots=50).groupBy("source").agg({"to_token": "sum", "from_token": "sum"}).collect()
    assert {r.source: r["sum(to_token)"] - r["sum(from_token)"] for r in joined} == {s: r.tokens_used for s, r in report.items() if r.tokens_used}


def test_many_pieces_of_one_source(spark, tables):
    sizes = spark.createDataFrame([(i, "a" if i % 9 else "b", 1 + i % 13) for i in range(3000)], SIZES_SCHEMA)
    parts = m.pack(sizes, tables[1], 64, piece_docs=50).collect()
    for source in "Ab":
        n = Counter()
        for r in parts:
            if r.source == source:
                n[r.block] += r.to_token - r.from_token
        assert sorted(n) == list(range(len(n))) and all(n[i] == 64 for i in range(len(n) - 1))
        assert sum(n.values()) == sum(1 + i % 13 for i in range(3000) if bool(i % 9) == (source == "A"))


def test_slots_are_numbered_over_pieces_of_shards(spark, monkeypatch):
    monkeypatch.setattr(m, "PIECE_SHARDS", 4)
    sizes, targets = spark.createDataFrame([(i, "a", 40) for i in range(50)], SIZES_SCHEMA), spark.createDataFrame([("a", 0.7, 9), ("x", 0.3, 1)], "source string, target_share double, max_repeats int")
    slots = m.slots(sizes, targets, block_tokens=8, shard_slots=10).collect()
    for source in ("a", "x"):
        own = sorted((r.slot, r.shard) for r in slots if r.source == source)
        assert [s for s, _ in own] == list(range(len(own))) and [h for _, h in own] == sorted(h for _, h in own)
    assert len({r.shard for r in slots}) == 25


def test_short_sources_and_checks(tables):
    assert {r.source for r in m.fallen_short(*tables, block_tokens=8, shard_slots=50).collect()} == {"b", "none"}
    assert all(r.tokens_once and r.within_repeats and r.near_target for r in m.checked(*tables, block_tokens=8, shard_slots=50).collect())


def test_empty(spark, tables):
    none = tables[0].limit(0)
    assert m.fallen_short(none, tables[1]).count() == 0 and m.shares(none, tables[1]).count() == 4
    assert m.slots(none, tables[1]).count() == 0 and m.pack(none, tables[1]).count() == 0 and m.capacity(none, tables[1]).count() == 4
    assert m.capacity(tables[0], tables[1].limit(0)).count() == 0
