from spanloom.plans import signal, tables


def test_slices_cover_whole_texts(spark, tmp_path):
    texts = [(1, "acgt" * 3000 + "n"), (2, "GATTACA" * 100), (3, "x"), (4, "acgt" * 100), (5, ""), (6, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    whole = {str(r.doc_id): r.sequence for r in tables.sequences(spark, str(tmp_path)).collect()}
    rows = sorted(signal.queries()["sequence_tiles"](spark, str(tmp_path)).collect(), key=lambda r: (r.chrom, r.start))
    assert set(whole) == {"1", "2", "3", "4"} and all(r.end - r.start == signal.SEQUENCE and r.sequence for r in rows)
    assert {c: "".join(r.sequence for r in rows if r.chrom == c) for c in whole} == whole
