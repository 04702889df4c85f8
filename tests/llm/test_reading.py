import random

import pytest

from spanloom.llm import reading

SYLLABLES = ["dor", "mil", "kes", "tan", "vol", "bex", "pra", "zug"]


def corpus(seed, n):
    """Each level has words of its own and those of the levels below."""
    rnd = random.Random(seed)
    words = {lv: [f"{a}{b}{'xyzv'[lv - 1]}" for a in SYLLABLES for b in SYLLABLES] for lv in (1, 2, 3, 4)}
    out = []
    for i in range(n):
        level = 1 + i % 4
        body = [rnd.choice(words[level] if rnd.random() < 0.5 else words[rnd.randint(1, level)]) for _ in range(80)]
        out.append((i, "1\n00:00:01,000 --> 00:00:02,000\n" + " ".join(body) + "\n", level))
    return out


def test_held_out_accuracy(spark):
    data = corpus(1, 320)
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in data] + [(900, None, 9), (901, "", 9), (902, "1\n00:00:01,000 --> 00:00:02,000\n[SIGHS]\n", 9), (903, data[5][1], 9), (904, "qqqq wwww", 9)], "doc_id long, text string, level int")
    rnd = random.Random(2)
    labels = [(i, r, lv if r else max(1, min(4, lv + rnd.choice([-1, 1])))) for i, _, lv in data[:160] for r in range(3)] + [(5000, 1, 2), (1, 9, None)]
    model = reading.fit(docs, spark.createDataFrame(labels, "doc_id long, reader_id int, reading_level int"))
    got = {r.doc_id: r.reading_level for r in reading.predict(docs, model).collect()}
    assert set(got) == {i for i, _, _ in data} | {903, 904}
    held = [got[i] == lv for i, _, lv in data[160:]]
    assert sum(held) / len(held) > 0.9 and got[903] == got[5] and got[904] == model.middle
    assert sum(r.n_docs for r in reading.profile(reading.predict(docs, model)).collect()) == 322


def test_sample_is_bounded(spark):
    labels = spark.createDataFrame([(i, r, 1 + (i + r) % 2) for i in range(50) for r in range(2)], "doc_id long, reader_id int, reading_level int")
    assert reading.labelled(labels, 7).count() == 7
    assert {r.level for r in reading.labelled(labels).collect()} == {2}


def test_grades_rise_with_level():
    g = reading.acquisition_grades({"early": {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5}, "late": {4: 0.1}, "mid": {2: 0.2, 3: 0.2}}, [1, 2, 3, 4])
    assert g["early"] < g["mid"] < g["late"] <= 4


def test_nothing_to_fit(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    with pytest.raises(ValueError):
        reading.fit(docs, spark.createDataFrame([], "doc_id long, reader_id int, reading_level int"))


def test_one_level_only(spark):
    docs = spark.createDataFrame([(i, "some words here", 1) for i in range(4)], "doc_id long, text string, level int")
    model = reading.fit(docs, spark.createDataFrame([(i, 1, 3) for i in range(4)], "doc_id long, reader_id int, reading_level int"))
    assert {r.reading_level for r in reading.predict(docs, model).collect()} == {3}
