import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import chrom, encode, sequence


def test_chromosome_order(spark):
    names = ["chrUn_10", "chrM", "chr10", "chrX", "chr2", "chrY", "chrUn_9", "chr1", "alt", "scaffold"]
    df = spark.createDataFrame([(n,) for n in names], "chrom string").orderBy(*chrom.chrom_order(F.col("chrom")))
    assert [r.chrom for r in df.collect()] == ["chr1", "chr2", "chr10", "chrX", "chrY", "chrM", "alt", "chrUn_9", "chrUn_10", "scaffold"]
    assert len(chrom.standard_chromosomes()) == 22 and len(chrom.standard_chromosomes(None)) == 25


def test_spelling(spark, rows):
    chroms = spark.createDataFrame([("chr1", "1", 10), ("chrX", "X", 20)], "chrom string, alt_name string, chrom_size long")
    df = spark.createDataFrame([(1, " CHR1\t", "other"), (2, "x", None), (3, "chr9", None), (4, None, None)], "id int, chr string, chrom string")
    assert rows(chrom.resolve(df, chroms).select("id", "chrom")) == [(1, "chr1"), (2, "chrX")]
    assert chrom.resolve(df, chroms, how="left").count() == 4


def test_offsets(spark, rows):
    sizes = chrom.chrom_sizes(spark.createDataFrame([("chr2", 5), ("chr10", 7), ("chr2", 6), ("chrX", 1)], "chrom string, chrom_size long"))
    offsets = chrom.chrom_offsets(sizes)
    assert rows(offsets.select("chrom", "chrom_offset")) == [("chr10", 6), ("chr2", 0), ("chrX", 13)]
    at = spark.createDataFrame([("chrX", 3), ("none", 1)], "chrom string, start long")
    assert rows(chrom.with_global_position(at, offsets).select("global_position")) == [(16,)]


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), (None,), ("acgt",)], "sequence string")
    assert [r[0] for r in df.select(sequence.unknown_fraction(F.col("sequence"))).collect()] == [0.2, None, None, 1.0]
    assert sequence.known_enough(df, 5, 0.2).count() == 1 and sequence.known_enough(df, 5, 0.1).count() == 0
    hot = df.where("sequence is null or sequence not rlike '[a-z]'").orderBy(F.length("sequence").desc()).select(sequence.one_hot(F.col("sequence")).alias("h")).collect()
    assert hot[0].h[1] == [0.0, 1.0, 0.0, 0.0] and hot[0].h[4] == [0.25] * 4 and hot[1].h == [] and hot[2].h is None
    assert all(abs(sum(w) - 1) < 0.01 for w in sequence.ONE_HOT.values())
    odd = spark.createDataFrame([("AJ",)], "sequence string")
    assert odd.select(sequence.one_hot(F.col("sequence"), strict=False)).first()[0][1] == [0.0] * 4
    with pytest.raises(Exception, match="no base"):
        odd.select(sequence.one_hot(F.col("sequence"))).collect()


def test_slices(spark, rows):
    whole = "ACGTACGTTTGGA"
    genome = spark.createDataFrame([("c", i, whole[i * 4 : i * 4 + 4]) for i in range(4)], "chrom string, chunk int, letters string")
    asked = [("c", 0, 4), ("c", 2, 9), ("c", 2, 9), ("c", 10, 40), ("c", -3, 2), ("d", 0, 4), ("c", 5, 5)]
    got = rows(sequence.slices(spark.createDataFrame(asked, "chrom string, start long, end long"), genome, 4))
    assert got == sorted([(c, s, e, whole[max(s, 0) : max(e, 0)] if c == "c" else "") for c, s, e in asked], key=repr)


def test_bfloat16(spark):
    bits = encode.bfloat16_of(np.array([0.0, 1.0, -2.0, math.nan, 3.140625, 1e38], np.float32))
    assert list(bits[:4]) == [0, 0x3F80, 0xC000, 0x7FC0]
    back = (bits.astype(np.uint32) << 16).view(np.float32)
    assert abs(back[4] - 3.140625) < 0.01
    df = spark.createDataFrame([([1.0, None],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(encode.bfloat16_bits(F.col("v"))).collect()] == [[0x3F80, 0x7FC0], None]
    many = spark.createDataFrame([([float(i)] * (i % 4) if i % 5 else None,) for i in range(50)], "v array<float>")
    for v, b in many.select("v", encode.bfloat16_bits(F.col("v"))).collect():
        assert b == (None if v is None else encode.bfloat16_of(np.array(v, np.float32)).tolist())
    encode.check_bfloat16_default(math.nan)
    with pytest.raises(ValueError):
        encode.check_bfloat16_default(1.0)


def test_encoders(spark):
    df = spark.createDataFrame([("AC",)], "sequence string")
    encode.register_encoder("size", lambda c: F.length(c))
    assert encode.encoded(df, "size").first()[0] == 2 and encode.encoded(df, None).first()[0] == "AC"
    encode.register_encoder("doubled", lambda c: F.concat(c, c), spark, lambda x: None if x is None else x + x)
    assert encode.encoded(df, "doubled").first()[0] == "ACAC"
    df.createOrReplaceTempView("encoded_letters")
    assert spark.sql("select doubled(sequence), doubled(null) from encoded_letters").first()[:] == ("ACAC", None)
    with pytest.raises(ValueError):
        encode.encoded(df, "unheard of")
