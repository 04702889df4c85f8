import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import export
from spanloom.collection import TrackCollection
from spanloom.operators import sample
from spanloom.training import training_table

CHUNK = 50


@pytest.fixture(scope="module")
def parts(spark):
    letters = ("ACGT" * 500)[:1900] + "N" * 100
    genome = spark.createDataFrame([("chr1", i, letters[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(letters) // CHUNK)], "chrom string, chunk int, letters string")
    steps = spark.createDataFrame([(t, "chr1", s, s + 10, float(s * (t + 1))) for t in range(4) for s in range(0, 2000, 10)], "track_id int, chrom string, start long, end long, value double")
    tracks = spark.createDataFrame([(t, f"/x/t{t}.bw", f"t{t}") for t in range(4)], "track_id int, path string, stem string")
    chroms = spark.createDataFrame([(t, "chr1", 2000) for t in range(4)], "track_id int, chrom string, chrom_size long")
    regions = spark.createDataFrame([("chr1", 50, 1000), ("chr1", 1200, 2000)], "chrom string, start long, end long")
    return TrackCollection(spark, steps, tracks, chroms), regions, genome


def test_epoch(spark, parts):
    table = training_table(*parts, CHUNK, sequence_length=100, center_bin_to_predict=40, window_size=10, batch_size=4, batches_per_epoch=3, sub_sample_tracks=2, seed=1)
    got = list(export.batches(table, parts[0].tracks))
    assert [b["batch_id"] for b in got] == [0, 1, 2]
    for b in got:
        assert b["sequences"].shape == (4, 100, 4) and b["values"].shape == (4, 4, 2) and b["values"].dtype == np.float32
        assert len(b["track_names"]) == 2 and b["track_ids"] == sorted(b["track_ids"])
    rows = table.collect()
    for r in rows:
        first = r.center - 20
        line = [(p // 10 * 10) * (r.track_ids[0] + 1) for p in range(first, first + 40)]
        np.testing.assert_allclose(r["values"][0], np.array(line).reshape(4, 10).mean(1))
    again = training_table(*parts, CHUNK, sequence_length=100, center_bin_to_predict=40, window_size=10, batch_size=4, batches_per_epoch=3, sub_sample_tracks=2, seed=1)
    assert sorted(r.center for r in again.collect()) == sorted(r.center for r in rows)


def test_unknown_bases_are_left_out_and_text_stays(parts):
    table = training_table(*parts, CHUNK, sequence_length=100, batch_size=8, batches_per_epoch=4, sequence_encoder=None, maximum_unknown_bases_fraction=0.0, dtype="bfloat16", moving_average_window_size=3)
    got = list(export.batches(table))
    assert all(len(s) == 100 and "N" not in s for b in got for s in b["sequences"])
    assert got[0]["values"].dtype == np.uint16
    with pytest.raises(ValueError):
        training_table(*parts, CHUNK, dtype="bfloat16", default_value=1.0)
    with pytest.raises(ValueError):
        training_table(*parts, CHUNK, dtype="float16")


def test_given_positions(spark, parts):
    centers = spark.createDataFrame([("chr1", 300), ("chr1", 10), ("chr1", 500)], "chrom string, center long")
    table = training_table(*parts, CHUNK, sequence_length=100, batch_size=2, batches_per_epoch=1, positions=centers)
    assert sorted(r.center for r in table.collect()) == [300, 500]


def test_given_positions_are_numbered_alike_however_they_are_partitioned(spark, parts):
    data = [("chr1", 100 + 7 * i) for i in range(60)] + [("chr1", 107), (None, 3), ("chr1", None)]
    one = spark.createDataFrame(data, "chrom string, center long")
    asked = dict(sequence_length=100, batch_size=8, batches_per_epoch=5)
    got = [sorted((r.batch_id, r.query_id, r.center) for r in training_table(*parts, CHUNK, positions=p, **asked).collect()) for p in (one.coalesce(1), one.orderBy(F.desc("center")).repartition(5))]
    assert got[0] == got[1] and len(got[0]) == 40


def test_the_same_positions_again(spark, parts):
    centers = [r.center for r in sample.positions(spark, parts[1], 20, 4, repeat_same=6).orderBy("draw").collect()]
    assert centers == [centers[i % 6] for i in range(20)] and len(set(centers)) > 3
    assert centers[:6] == [r.center for r in sample.positions(spark, parts[1], 6, 4).orderBy("draw").collect()]
    table = training_table(*parts, CHUNK, sequence_length=100, batch_size=4, batches_per_epoch=3, seed=4, repeat_same=4, maximum_unknown_bases_fraction=1.0)
    assert len({r.center for r in table.collect()}) <= 4


def test_epoch_is_full_though_most_draws_are_rejected(spark, parts):
    collection, regions, _ = parts
    letters = ("acgt" * 500)[:1500] + ("ACGT" * 500)[:300] + "N" * 200  # under a seventh of the positions can be used
    genome = spark.createDataFrame([("chr1", i, letters[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(letters) // CHUNK)], "chrom string, chunk int, letters string")
    asked = dict(sequence_length=100, batch_size=8, batches_per_epoch=4, sequence_encoder=None, window_size=100, seed=2)
    got = training_table(collection, regions, genome, CHUNK, **asked).collect()
    assert sorted(r.batch_id for r in got) == [i // 8 for i in range(32)]
    assert all(sum(c in "ACGT" for c in r.sequence) >= 90 for r in got)
    wide = training_table(collection, regions, genome, CHUNK, oversample=40.0, **asked).collect()
    assert sorted((r.batch_id, r.query_id, r.center) for r in got) == sorted((r.batch_id, r.query_id, r.center) for r in wide)


def test_epoch_that_nothing_can_fill_raises(spark, parts, monkeypatch):
    collection, regions, genome = parts
    monkeypatch.setattr("spanloom.training.HOPELESS", 1000)
    with pytest.raises(ValueError, match="epoch needs 4"):
        training_table(collection, regions, genome.withColumn("letters", F.lower("letters")), CHUNK, sequence_length=100, batch_size=4, batches_per_epoch=1)
    with pytest.raises(ValueError, match="epoch needs 4"):
        training_table(collection, regions.limit(0), genome, CHUNK, sequence_length=100, batch_size=4, batches_per_epoch=1)


def same_batches(a, b):
    assert [x["batch_id"] for x in a] == [x["batch_id"] for x in b]
    for x, y in zip(a, b):
        np.testing.assert_array_equal(x["values"], y["values"])
        np.testing.assert_array_equal(x["sequences"], y["sequences"])
        assert x["track_ids"] == y["track_ids"] and x["values"].dtype == y["values"].dtype


@pytest.mark.parametrize("dtype", ["float32", "bfloat16"])
def test_stored_batches_are_shared_by_readers(parts, tmp_path, monkeypatch, dtype):
    table = training_table(*parts, CHUNK, sequence_length=100, window_size=10, batch_size=4, batches_per_epoch=7, sub_sample_tracks=2, seed=1, dtype=dtype)
    export.write_batches(table.repartition(5), str(tmp_path / "t"))
    monkeypatch.setattr(export, "READ_ROWS", 3)
    expected = list(export.batches(table, parts[0].tracks))
    stored = export.StoredBatches(f"file://{tmp_path}/t", names={t: f"t{t}" for t in range(4)})
    got = sorted(stored, key=lambda b: b["batch_id"])
    same_batches(got, expected)
    assert [b["track_names"] for b in got] == [b["track_names"] for b in expected] and len(list(stored)) == 7
    shared = [b for w in range(3) for b in export.StoredBatches(str(tmp_path / "t"), w, 3)]
    same_batches(sorted(shared, key=lambda b: b["batch_id"]), expected)
    with pytest.raises(ValueError):
        export.StoredBatches("x", 2, 2)


def test_tensors(parts, tmp_path):
    torch = pytest.importorskip("torch")
    table = training_table(*parts, CHUNK, sequence_length=100, batch_size=4, batches_per_epoch=3, seed=1, dtype="bfloat16")
    export.write_batches(table, str(tmp_path / "t"))
    got = list(torch.utils.data.DataLoader(export.torch_dataset(str(tmp_path / "t")), batch_size=None, num_workers=2))
    assert sorted(b["batch_id"] for b in got) == [0, 1, 2] and got[0]["values"].dtype == torch.bfloat16 and got[0]["sequences"].shape == (4, 100, 4)


def test_tensors_hold_the_bits(monkeypatch):
    """With a stand-in for torch, as it may be missing: arrays are handed over as they are, bfloat16 as 16-bit words."""

    class Tensor:
        def __init__(self, array):
            self.array = array

        def view(self, kind):
            self.kind = kind
            return self

    monkeypatch.setitem(sys.modules, "torch", types.SimpleNamespace(from_numpy=Tensor, bfloat16="bfloat16"))
    batch = {"batch_id": 3, "values": np.array([[0x3F80, 0xC000]], np.uint16), "sequences": np.ones((1, 2), np.float32)}
    got = export.to_torch(batch)
    assert got["batch_id"] == 3 and got["values"].kind == "bfloat16" and got["values"].array.view(np.uint16).tolist() == [[0x3F80, 0xC000]]
    np.testing.assert_array_equal(got["sequences"].array, batch["sequences"])


def test_tsv(spark, rows, parts, tmp_path):
    export.write_tsv(parts[1], str(tmp_path / "r"))
    assert rows(export.read_tsv(spark, str(tmp_path / "r"), "chrom string, start long, end long")) == rows(parts[1])
