import random

import numpy as np
import pytest

from spanloom.collection import TrackCollection
from spanloom.operators.algebra import zoomed
from spanloom.sources import bigwig, fasta, paths
from spanloom.sources.bigwig_writer import Writer, write_tracks

SIZES = {"chr1": 100_000, "chr2": 50_000, "chrX": 7_000}
STEP = "track_id int, chrom string, start long, end long, value float"


def made(path, seed, packed=True, kind=1, sizes=SIZES, section=16, zooms=()):
    rnd = random.Random(seed)
    w = Writer(str(path), sizes, section, packed, kind, zooms)
    out = []
    for c in w.names:
        at, s, e = rnd.randrange(50), [], []
        while at < sizes[c] - 200 and len(s) < 300:
            length = 10 if kind > 1 else rnd.randrange(1, 90)
            s.append(at), e.append(at + length)
            at += 20 if kind == 3 else length + rnd.randrange(0, 60)
        v = [float(np.float32(rnd.uniform(-5, 5))) for _ in s]
        w.add(c, np.array(s), np.array(e), np.array(v))
        out += [(c, a, b, x) for a, b, x in zip(s, e, v)]
    w.close()
    return out


@pytest.mark.parametrize("packed, kind", [(True, 1), (False, 1), (True, 2), (True, 3)])
def test_round_trip(spark, rows, tmp_path, packed, kind):
    bigwig.register(spark)
    expected = made(tmp_path / "a.bw", 1, packed, kind)
    got = spark.read.format("bigwig").option("partition_bytes", 2000).load(str(tmp_path))
    assert rows(got.drop("track_id")) == sorted(expected, key=repr)
    assert got.rdd.getNumPartitions() > 1


def test_many_chromosomes_and_deep_index(spark, rows, tmp_path):
    bigwig.register(spark)
    sizes = {f"scaffold{i:04d}": 1000 for i in range(700)}
    expected = made(tmp_path / "a.bw", 2, sizes=sizes, section=1)
    assert len(expected) > 2000
    assert rows(spark.read.format("bigwig").load(str(tmp_path)).drop("track_id")) == sorted(expected, key=repr)
    assert spark.read.format("bigwig").option("table", "chroms").load(str(tmp_path)).count() == 700


def test_filters_reach_the_files(spark, rows, tmp_path):
    bigwig.register(spark)
    expected = made(tmp_path / "a.bw", 3)
    made(tmp_path / "b.bw", 4)
    df = spark.read.format("bigwig").load(str(tmp_path)).where("track_id = 0 and chrom = 'chr2' and start < 3000 and end > 2000")
    assert rows(df.drop("track_id")) == sorted((r for r in expected if r[0] == "chr2" and r[1] < 3000 and r[2] > 2000), key=repr)
    reader = bigwig.BigWigReader({"path": str(tmp_path)}, "steps")
    every = n_chunks(reader)
    list(reader.pushFilters([bigwig.EqualTo(("chrom",), "chr2"), bigwig.LessThan(("start",), 3000), bigwig.GreaterThan(("end",), 2000), bigwig.EqualTo(("track_id",), 0)]))
    assert 0 < n_chunks(reader) < every / 10


def n_chunks(reader):
    n = 0
    for part in reader.partitions():
        for _, path, nodes, share in part.parts:
            with open(path, "rb") as f:
                h = bigwig.read_header(f)
                n += len(reader.chunks_of(f, h, bigwig.read_chroms(f, h), nodes, share))
    return n


def test_many_small_files_share_partitions_and_are_not_opened(tmp_path):
    for i in range(2000):
        (tmp_path / f"{i}.bw").write_bytes(b"not yet read" * 100)
    assert len(bigwig.BigWigReader({"path": str(tmp_path)}, "steps").partitions()) == 1
    assert len(bigwig.BigWigReader({"path": str(tmp_path), "partition_bytes": "120000"}, "steps").partitions()) == 20


def test_large_files_are_split_by_index_nodes(spark, rows, tmp_path):
    bigwig.register(spark)
    expected = made(tmp_path / "a.bw", 11, sizes={f"c{i:03d}": 9000 for i in range(40)}, section=2)
    small = {"path": str(tmp_path), "partition_bytes": "4000"}
    parts = bigwig.BigWigReader(small, "steps").partitions()
    assert len(parts) > 5 and n_chunks(bigwig.BigWigReader(small, "steps")) == n_chunks(bigwig.BigWigReader({"path": str(tmp_path)}, "steps"))
    assert rows(spark.read.format("bigwig").options(**small).load().drop("track_id")) == sorted(expected, key=repr)


def test_over_65536_chromosomes(tmp_path):
    sizes = {f"s{i:06d}": 100 + i for i in range(66_000)}
    Writer(str(tmp_path / "a.bw"), sizes).close()
    with open(tmp_path / "a.bw", "rb") as f:
        assert dict(bigwig.read_chroms(f, bigwig.read_header(f)).values()) == sizes


def test_files_by_uri(spark, rows, tmp_path):
    bigwig.register(spark)
    (tmp_path / "sub").mkdir()
    expected = made(tmp_path / "a.bw", 12) + made(tmp_path / "sub" / "b.bw", 13)
    uri = f"file://{tmp_path}"
    assert paths.find_files(uri) == [f"{uri}/a.bw", f"{uri}/sub/b.bw"] and paths.find_files(uri, crawl=False) == [f"{uri}/a.bw"]
    assert paths.find_files(f"{uri}/a.bw", [".other"]) == [f"{uri}/a.bw"]
    assert rows(spark.read.format("bigwig").load(uri).drop("track_id")) == sorted(expected, key=repr)
    with pytest.raises(FileNotFoundError):
        paths.find_files(f"{uri}/none")


def test_scattered_queries_read_few_chunks(spark, tmp_path):
    """Queries on a hundredth of the bases, spread over a chromosome, and every base of the answer."""
    sizes = {"chr1": 2_000_000, "chr2": 500_000}
    made_ = []
    for name in "ab":
        w = Writer(str(tmp_path / f"{name}.bw"), sizes, 32)
        for c, n in sizes.items():
            s = np.arange(0, n - 50, 50)
            v = (s % 977 + ord(name)).astype(np.float32)
            w.add(c, s, s + 30, v)
            made_.append((name, c, s, v))
        w.close()
    c = TrackCollection.open(spark, str(tmp_path))
    starts = list(range(1000, 1_990_000, 100_000))
    asked = (["chr1"] * len(starts), starts, [s + 1000 for s in starts])
    read, every = c.chunks_near(c.queries(asked)), spark.read.format("bigwig").option("table", "chunks").load(str(tmp_path))
    assert 0 < read.select("path", "data_offset").distinct().count() < 0.05 * every.count()
    for r in c.values(asked).collect():
        line = np.zeros(1000)
        for name, chrom, s, v in made_:
            if chrom == "chr1" and "ab"[r.track_id] == name:
                for k in range((starts[r.query_id] - 30) // 50, (starts[r.query_id] + 1000) // 50 + 1):
                    a = s[k] - starts[r.query_id]
                    line[max(a, 0) : max(a + 30, 0)] = v[k]
        np.testing.assert_array_equal(r["values"], line)


def test_tables_of_a_file(spark, tmp_path):
    bigwig.register(spark)
    expected = made(tmp_path / "a.bw", 5)
    load = lambda t: spark.read.format("bigwig").option("table", t).load(str(tmp_path))
    head = load("files").first()
    assert head.bases_covered == sum(e - s for _, s, e, _ in expected) and head.max_value == max(v for *_, v in expected)
    assert sorted(r.chrom_size for r in load("chroms").collect()) == sorted(SIZES.values())
    assert load("chunks").count() == sum(-(-sum(r[0] == c for r in expected) // 16) for c in SIZES)
    with pytest.raises(Exception, match="table is one of"):
        load("nonsense").count()


def test_stored_zooms_equal_derived_ones(spark, tmp_path):
    bigwig.register(spark)
    made(tmp_path / "a.bw", 5, zooms=(500, 4000))
    load = lambda t: spark.read.format("bigwig").option("table", t).load(str(tmp_path))
    assert sorted(r.level for r in load("zooms").collect()) == [500, 4000]
    for level in (500, 4000):
        stored = {(r.chrom, r.start // level): r for r in load("zoom_records").where(f"level = {level}").collect()}
        derived = {(r.chrom, r.cell): r for r in zoomed(load("steps"), level).collect()}
        assert set(stored) == set(derived)
        for k, r in derived.items():
            np.testing.assert_allclose([stored[k][c] for c in ("valid_count", "min_value", "max_value", "sum_values", "sum_squares")], [r[c] for c in ("valid_count", "min_value", "max_value", "sum_values", "sum_squares")], rtol=1e-5, atol=1e-3)


def test_not_a_bigwig(tmp_path):
    (tmp_path / "a.bw").write_bytes(b"nothing at all")
    with pytest.raises(ValueError):
        reader = bigwig.BigWigReader({"path": str(tmp_path)}, "steps")
        list(reader.read(reader.partitions()[0]))


def test_collection_of_files(spark, rows, tmp_path):
    (tmp_path / "liver").mkdir()
    a, b = made(tmp_path / "a.bw", 6), made(tmp_path / "liver" / "b.bigWig", 7, sizes={"chr1": 100_000, "chr9": 400})
    c = TrackCollection.open(spark, str(tmp_path), scale={"liver": 10.0})
    assert c.n_tracks == 2
    assert rows(c.chromosomes_in_all()) == [("chr1",)]
    assert ("chr9_b",) in rows(c.chromosomes()) and ("chrX_a",) in rows(c.chromosomes())
    got = {(r.query_id, r.track_id): r["values"] for r in c.values((["chr1", "chr1"], [0, 500], [400, 900])).collect()}
    for t, (steps, scale) in enumerate(((a, 1.0), (b, 10.0))):
        for q, first in enumerate((0, 500)):
            line = np.zeros(400)
            for chrom, s, e, v in steps:
                if chrom == "chr1":
                    line[max(s - first, 0) : max(e - first, 0)] = v * scale
            np.testing.assert_allclose(got[(q, t)], line, rtol=1e-6)
    assert c.intervals(include="chr1", merge=True).count() < c.intervals(include="chr1").count()
    assert TrackCollection.open(spark, [str(tmp_path / "a.bw"), [str(tmp_path / "liver")]], first_n_files=1).n_tracks == 1
    twice = TrackCollection(spark, c.steps.union(c.steps), c.tracks, c.chroms, repeats=True)
    for options in ({}, {"merge": True, "threshold": 1.0, "padding": 3}):
        assert rows(twice.intervals(**options)) == rows(c.intervals(**options))


def test_writing_tracks(spark, rows, tmp_path):
    bigwig.register(spark)
    data = [(t, c, s, s + 5, float(s % 7)) for t in range(3) for c in ("chr1", "chrX") for s in range(0, 3000, 11)] + [(1, "none", 0, 5, 1.0), (None, "chr1", 0, 5, 1.0)]
    written = write_tracks(spark.createDataFrame(data, STEP), SIZES, str(tmp_path)).collect()
    assert sorted(r.track_id for r in written) == [0, 1, 2]
    assert rows(spark.read.format("bigwig").load(str(tmp_path))) == sorted((r for r in data if r[0] is not None and r[1] != "none"), key=repr)


@pytest.mark.parametrize("with_index", [False, True])
def test_fasta(spark, tmp_path, with_index):
    rnd = random.Random(8)
    seqs = {n: "".join(rnd.choice("ACGTN") for _ in range(k)) for n, k in (("chr1", 1003), ("chr2", 60), ("tiny", 7))}
    path = tmp_path / "g.fa"
    path.write_text("".join(f">{n} words\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for n, s in seqs.items()))
    if with_index:
        (tmp_path / "g.fa.fai").write_text("".join(f"{e.name}\t{e.length}\t{e.offset}\t{e.line}\t{e.width}\n" for e in fasta.index(str(path))))
    fasta.register(spark)
    got = {}
    for r in sorted(spark.read.format("fasta").option("chunk_size", 100).option("partition_chunks", 3).load(str(path)).collect()):
        got[r.chrom] = got.get(r.chrom, "") + r.letters
    assert got == seqs
    assert {r.chrom for r in spark.read.format("fasta").load(str(path)).where("chrom = 'tiny'").collect()} == {"tiny"}


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nACGT\nACGTA\nACG\n", ">a\nACGT\n\nACGT\nA"])
def test_uneven_fasta_is_refused(tmp_path, text):
    (tmp_path / "g.fa").write_text(text)
    reader = fasta.FastaReader({"path": str(tmp_path / "g.fa")})
    with pytest.raises(ValueError, match="different lengths"):
        list(reader.read(reader.partitions()[0]))


@pytest.mark.parametrize("end", ["\n", "\r\n", ""])
def test_layouts_of_fasta(tmp_path, monkeypatch, end):
    monkeypatch.setattr(fasta, "SCAN_BYTES", 5)
    seqs = {"a": "ACGTACGTAC", "none": "", "b": "A", "c": "ACGT" * 5000}
    new = end or "\n"
    (tmp_path / "g.fa").write_bytes(("x" * 3 + new + "".join(f">{n} w > w{new}" + "".join(s[i : i + 9000] + new for i in range(0, len(s), 9000)) for n, s in seqs.items())).removesuffix("" if end else new).encode())
    assert {e.name: e.length for e in fasta.index(str(tmp_path / "g.fa"))} == {n: len(s) for n, s in seqs.items()}
    reader = fasta.FastaReader({"path": f"file://{tmp_path}/g.fa", "chunk_size": "7"})
    got = dict.fromkeys(seqs, "")
    for part in reader.partitions():
        for batch in reader.read(part):
            for name, _, letters in zip(*(c.to_pylist() for c in batch.columns)):
                got[name] += letters
    assert got == seqs


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 20])
def test_indexes_written_by_tasks(spark, tmp_path, range_bytes):
    rnd = random.Random(3)
    for k, new in enumerate(("\n", "\r\n")):
        seqs = [(f"s{i}", "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 1, 19, 20, 21, 60])))) for i in range(9)]
        (tmp_path / f"{k}.fa").write_bytes("".join(f">{n} {'w' * rnd.randrange(9)}{new}" + "".join(x[i : i + 20] + new for i in range(0, len(x), 20)) for n, x in seqs).encode())
    (tmp_path / "none.fa").write_bytes(b"")
    (tmp_path / "open.fasta").write_bytes(b">a\nACGT\nAC")
    expected = {p: fasta.index(p) for p in paths.find_files(tmp_path, fasta.EXTENSIONS)}
    got = {r.path: r.n for r in fasta.write_indexes(spark, str(tmp_path), range_bytes=range_bytes).collect()}
    assert got == {p: len(e) for p, e in expected.items()}
    for p, e in expected.items():
        assert fasta.exists(p + ".fai") and fasta.index(p) == e
    assert len(paths.find_files(tmp_path, [""])) == 8


def test_finding_files(tmp_path):
    for name in ("top.bw", "deep/er/x.bw", "deep/y.bigWig", "deep/er/z.bw", "notes.txt", "deep/x.bw.bak"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).touch()
    found = lambda *a, **k: [p.removeprefix(str(tmp_path) + "/") for p in paths.find_files(*a, **k)]
    assert found(tmp_path) == ["deep/er/x.bw", "deep/er/z.bw", "deep/y.bigWig", "top.bw"]
    assert found(tmp_path, crawl=False) == ["top.bw"]
    assert found([tmp_path / "deep" / "er", [tmp_path / "top.bw"], tmp_path / "deep" / "er"]) == ["deep/er/x.bw", "deep/er/z.bw", "top.bw"]
    assert found(tmp_path, [".bak", ".txt"]) == ["deep/x.bw.bak", "notes.txt"]
    with pytest.raises(FileNotFoundError):
        paths.find_files(tmp_path / "none")
    with pytest.raises(ValueError):
        paths.find_files(5)


# a file's own name beats any folder, the longer run of parts the shorter, the inner folder the outer
KEYS = {"run7": 7, "run8": 8, "skin": 50, "day1": 60, "skin/run9": 9, "day1/run9": 10, "day1/whole.bw": 11, "raw/day1": 12}
EXPECTED = {
    "skin/run7": 7, "day1/run7": 7, "skin/run8": 8, "skin/run9": 9, "day1/run9": 10, "skin/other": 50, "skin/day1/other": 60, "day1/skin/other": 50, "raw/day1/other": 12, "day1/raw/other": 60,
    "day1/whole": 11, "bone/other": None,
}


def test_values_for_paths(spark):
    full = {f"/mnt/all/{k}.bw": v for k, v in EXPECTED.items()}
    for path, value in full.items():
        assert paths.value_for_path(path, KEYS) == value
    tracks = spark.createDataFrame(list(enumerate(full)), "track_id int, path string")
    keys = spark.createDataFrame([(k, float(v)) for k, v in KEYS.items()], "key string, scale double")
    got = {r.path: r.scale for r in paths.tracks_with_scale(tracks, keys).collect()}
    assert got == {p: float(v or 1) for p, v in full.items()}
