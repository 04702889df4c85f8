"""Reading level of each document from the grades at which its words are acquired.

Fitting takes a bounded sample of labelled documents. For each word the rates at which it occurs in the texts of each
level are set against each other; its acquisition grade is the level, between levels by interpolation, at which
``ACQUIRED`` of that distribution is reached: low for a word met early and often, high for one that only demanding
texts use. A document is then described by quantiles of the grades of its known words. The quantile used, and its cut
points between levels, are those that tell the labelled documents' levels apart best; for this, each document is
described by grades made without its own fold of the sample. Prediction uses the grades of all of it.

Fitting reads the corpus once, for the labelled documents' word counts, which are written; prediction reads every
document whole, once, with the fitted table, whose size the sample bounds, sent to each task.
Copies get the level of their text. Null, empty and speechless texts have no row. A text without any known word gets
the middle level of the sample. Opinions on one document are joined by their median, null ones left out; labels of
unknown documents are ignored. Without any label nothing can be fitted: a ValueError says so.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm import spoken
from spanloom.session import checkpoint

#: Bound on the labelled documents that fitting uses; which ones is chosen by a hash of the id.
MAX_LABELLED = 20_000
#: A word is known if it occurs in so many labelled documents.
MIN_DOCS = 3
ACQUIRED = 0.3
#: Parts of the sample, by a hash of the id, that are held out in turn.
FOLDS = 5
QUANTILES = tuple(round(0.05 * i, 2) for i in range(1, 20))


@dataclass
class Model:
    """Acquisition grade by word, the quantile that serves as feature, its cut points between levels, and the held-out accuracy."""

    grades: dict[str, float]
    quantile: float
    cuts: list[float]
    levels: list[int]
    middle: int
    accuracy: float = field(default=float("nan"))

    def level(self, words_grades: list[float]) -> int:
        if not words_grades:
            return self.middle
        at = float(np.quantile(words_grades, self.quantile))
        return self.levels[int(np.searchsorted(self.cuts, at, side="right"))]


def labelled(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, level)``: the median opinion, rounded half up, on at most ``limit`` documents."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("reading_level").isNotNull()).groupBy("doc_id").agg(F.floor(F.median("reading_level") + 0.5).cast("int").alias("level"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _cuts(x: np.ndarray, level: np.ndarray, levels: list[int]) -> list[float]:
    order = np.argsort(x, kind="stable")
    xs, ls = x[order], level[order]
    cuts = []
    for low in levels[:-1]:
        right = np.concatenate([[0], np.cumsum(ls <= low)]) + (np.sum(ls > low) - np.concatenate([[0], np.cumsum(ls > low)]))
        valid = np.concatenate([[True], xs[1:] > xs[:-1], [True]])
        best = np.flatnonzero(valid & (right == right[valid].max()))
        i = int(best[len(best) // 2])
        cuts.append(float(xs[0] - 1 if i == 0 else xs[-1] + 1 if i == len(xs) else (xs[i - 1] + xs[i]) / 2))
    return list(np.maximum.accumulate(cuts)) if cuts else []


def acquisition_grades(rates: dict[str, dict[int, float]], levels: list[int], acquired: float = ACQUIRED) -> dict[str, float]:
    """Grade per word from its rate in the texts of each level."""
    grades = {}
    for word, by_level in rates.items():
        share = np.array([by_level.get(lv, 0.0) for lv in levels])
        upto = np.cumsum(share / share.sum())
        i = int(np.searchsorted(upto, acquired))
        below = upto[i - 1] if i else 0.0
        step = levels[i] - (levels[i - 1] if i else levels[0] - 1)
        grades[word] = levels[i] - step + step * (acquired - below) / (upto[i] - below)
    return grades


def _word_counts(documents: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``(level, fold, words, counts)`` of each labelled document, written once."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(FOLDS)).cast("int")
    sample = documents.select("doc_id", "text").join(F.broadcast(labelled(labels, limit)), "doc_id").select("text", "level", fold)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(f for f in spoken.forms(text.as_py()) if "*" not in f) for text in batch.column(0)]
            words, ns = pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), words, ns], names=["level", "fold", "words", "counts"])

    return checkpoint(sample.mapInArrow(counted, "level int, fold int, words array<string>, counts array<int>"))


def _known(counts: DataFrame) -> DataFrame:
    """``(word, cells)``: how often each known word occurs in each level and fold; the sample's size bounds the words."""
    each = counts.select("level", "fold", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word"), "level", "fold")
    cells = each.agg(F.sum("w.counts").alias("n"), F.count(F.lit(1)).alias("docs"))
    words = cells.groupBy("word").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("level", "fold", "n")).alias("cells"))
    most = counts.select(F.explode("words").alias("word")).groupBy("word").count().agg(F.max("count").alias("m")).scalar()
    return words.where(F.col("docs") >= F.least(F.lit(MIN_DOCS), most)).select("word", "cells")


def fit(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """The model of the labelled documents.

    Their words are counted in Spark; the driver gets one row per known word, and then, per document, the quantiles of
    its words' grades.
    """
    spark = documents.sparkSession
    counts = _word_counts(documents, labels, limit)
    sums = counts.select("level", "fold", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n")).groupBy("level", "fold").agg(F.sum("n").alias("n")).where("n > 0").collect()
    if not sums:
        raise ValueError("no labelled document has spoken words")
    levels = sorted({r.level for r in sums})
    words = {r.word: [(c.level, c.fold, c.n) for c in r.cells] for r in _known(counts).toLocalIterator()}

    def grades_without(fold: int | None) -> dict[str, float]:
        total = Counter()
        for r in sums:
            if r.fold != fold:
                total[r.level] += r.n
        rates: dict[str, dict[int, float]] = {}
        for word, cells in words.items():
            for level, f, n in cells:
                if f != fold:
                    own = rates.setdefault(word, {})
                    own[level] = own.get(level, 0.0) + n / total[level]
        return acquisition_grades(rates, levels)

    grades = grades_without(None)
    tables = spark.sparkContext.broadcast([grades_without(f) for f in range(FOLDS)])

    def quantiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lv, qs = [], []
            for level, fold, ws, ns in zip(*(c.to_pylist() for c in batch.columns)):
                table = tables.value[fold]
                own = [g for w, n in zip(ws, ns) if (g := table.get(w)) is not None for _ in range(n)]
                if own:
                    lv.append(level), qs.append(np.quantile(own, QUANTILES).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(lv, pa.int32()), pa.array(qs, pa.list_(pa.float64()))], names=["level", "q"])

    described = counts.mapInArrow(quantiles, "level int, q array<double>").collect()
    x, y = np.array([r.q for r in described]), np.array([r.level for r in described], dtype=int)
    middle = int(np.sort(y)[len(y) // 2]) if len(y) else levels[len(levels) // 2]
    best = Model(grades, 0.5, [], levels[:1], middle)
    best_score = -1.0
    for i, q in enumerate(QUANTILES if len(y) else ()):
        cuts = _cuts(x[:, i], y, levels)
        hit = np.array(levels)[np.searchsorted(cuts, x[:, i], side="right")] == y
        margin = sum(np.abs(x[:, i] - c).clip(max=0.5).mean() for c in cuts) if cuts else 0.0
        score = hit.mean() + 1e-3 * margin
        if score > best_score:
            best_score, best = score, Model(grades, q, cuts, levels, middle, float(hit.mean()))
    return best


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, reading_level, n_words, n_known)`` of every document with spoken words."""
    table = documents.sparkSession.sparkContext.broadcast(model)
    kind = to_arrow_type(documents.schema["doc_id"].dataType)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        grade_of = spoken.Memo(lambda w: -1.0 if not (f := spoken.fine[w]) else m.grades.get(f))
        for batch in batches:
            docs, lv, n_words, n_known = [], [], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                found = [g for g in map(grade_of.__getitem__, spoken.tokens(text.as_py())) if g != -1.0]
                if found:
                    known = [g for g in found if g is not None]
                    docs.append(doc.as_py()), lv.append(m.level(known)), n_words.append(len(found)), n_known.append(len(known))
            yield pa.RecordBatch.from_arrays([pa.array(docs, kind), pa.array(lv, pa.int32()), pa.array(n_words, pa.int64()), pa.array(n_known, pa.int64())], names=["doc_id", "reading_level", "n_words", "n_known"])

    schema = documents.select("doc_id").schema.add("reading_level", T.IntegerType()).add("n_words", T.LongType()).add("n_known", T.LongType())
    return documents.select("doc_id", "text").where(F.length("text") > 0).mapInArrow(levels, schema)


def profile(levels: DataFrame) -> DataFrame:
    """``(reading_level, n_docs, n_words)`` of a predicted corpus."""
    return levels.groupBy("reading_level").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_words").alias("n_words"))
