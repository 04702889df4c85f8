"""Records of held-out splits that lie, exactly or almost, in the train split: an edit-distance segment join.

Records are read as strings of letters. A held-out string is cut into k + 1 segments. If a train string is within k
edits of it, the edits before, in and after the segments can't all hit: for some segment i, counted from 0, exactly i
edits lie before it, none in it, and at most k - i behind. So the segment occurs in the train string, at most i letters
from its own place, and at most k - i letters from its place counted from the end. Those are the allowed positions:
train strings list their substrings there, both sides are joined on the content, and what meets is verified by a
dynamic programme within a band of k, over whole Arrow batches at once.

``near_texts`` joins texts letter by letter. ``near_pairs`` joins intervals. Its letters are cells of a grid: an
interval is the string of the cells it touches, cells being a power of two over a fifth of the train interval's length.
Bases that two intervals sharing nine tenths of the longer one don't share are less than one cell, so each end moves by
one cell at most: k = 2, and as an interval has three letters at least and seven at most, a segment is one letter. The exact test on bases comes
last. An interval under five bases is spelled in bases and must be met exactly, as no base may be missing.

A pair is kept for its first segment and position only, so no distinct follows. Copies are collapsed before the join
and only classes meet; ids are put back where pairs of rows are asked for. Rows lacking a key, start or end (a text),
or without positive length, have no string and take no part. A letter that many strings have at one place is a join
key of many rows, which the session's skew join splits; nothing is collected by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.session import checkpoint

SHARE = 0.9
SIMILARITY = 0.8
#: Letters of an interval are so long that a train one has less than this many whole ones.
CELLS = 5
FAR = 1 << 29


def banded_distances(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, k: int) -> np.ndarray:
    """Edit distances of many pairs of strings at once, ``k`` + 1 for all above ``k``.

    Strings are rows of letter numbers, ``n_a`` and ``n_b`` long. Row i of the programme holds, for each pair, the
    distances of the first i letters of one to the first i - k to i + k letters of the other.
    """
    found = np.full(len(n_a), k + 1)
    width = 2 * k + 1
    row = np.tile(np.where(np.arange(width) >= k, np.arange(width) - k, FAR), (len(n_a), 1))
    for i in range(int(n_a.max(initial=0)) + 1):
        if i:
            new = np.full_like(row, FAR)
            for x in range(width):
                j = i + x - k
                if j < 0:
                    continue
                best = row[:, x + 1] + 1 if x + 1 < width else np.full(len(row), FAR)
                if j and x:
                    best = np.minimum(best, new[:, x - 1] + 1)
                if j and j <= b.shape[1]:
                    best = np.minimum(best, row[:, x] + (a[:, i - 1] != b[:, j - 1]))
                new[:, x] = best
            row = new
            if row.min(initial=FAR) > k:
                break
        ends = np.flatnonzero((n_a == i) & (np.abs(n_b - i) <= k))
        found[ends] = np.minimum(row[ends, n_b[ends] - i + k], k + 1)
    return found


def _matrix(letters: pa.Array, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, with their lengths; ``numbers`` are the numbers of all their letters."""
    n = np.diff(letters.offsets.to_numpy()).astype(np.int64)
    out = np.full((len(n), int(n.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = numbers
    return out, n


def _spelled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Train and held-out strings of a batch as matrices of letter numbers, with their lengths."""
    both = [batch.column("t_letters"), batch.column("h_letters")]
    flat = [x.flatten() for x in both]
    numbers = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy()
    a, n_a = _matrix(both[0], numbers[: len(flat[0])])
    b, n_b = _matrix(both[1], numbers[len(flat[0]) :])
    return a, n_a, b, n_b


def _earliest(t: np.ndarray, n_t: np.ndarray, h: np.ndarray, n_h: np.ndarray, i: np.ndarray, at: np.ndarray, k: int, w: int) -> np.ndarray:
    """Whether a pair's segment ``i`` occurs at ``at``, and no earlier segment, or the same at an earlier place, does."""
    rows, longer = np.arange(len(n_t)), n_t - n_h

    def occurs(j: np.ndarray, q: np.ndarray) -> np.ndarray:
        own = j * n_h // (k + 1)
        ok = (np.abs(q - own) <= j) & (np.abs(q - own - longer) <= k - j) & (q >= 0) & (q + w <= n_t)
        for x in range(w):
            ok &= t[rows, np.clip(q + x, 0, t.shape[1] - 1)] == h[rows, np.clip(own + x, 0, h.shape[1] - 1)]
        return ok

    first = occurs(i, at)
    for j in range(int(i.max(initial=0)) + 1):
        each = np.full(len(rows), j)
        for move in range(-j, j + 1):
            q = j * n_h // (k + 1) + move
            before = (j < i) | ((j == i) & (q < at))
            first &= ~(before & occurs(each, q))
    return first


def _verified(pairs: DataFrame, keep: Sequence[str], dedupe: bool) -> DataFrame:
    """``keep`` and ``edits`` of the pairs within their ``k``, in Arrow batches; with ``dedupe`` each by its first segment only."""
    schema = T.StructType([pairs.schema[c] for c in keep] + [T.StructField("edits", T.IntegerType())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, n_a, b, n_b = _spelled(batch)
            k, w = batch.column("k").to_numpy(), batch.column("w").to_numpy()
            ok, edits = np.zeros(len(k), bool), np.zeros(len(k), np.int32)
            for kind in {(int(x), int(y)) for x, y in zip(k, w)}:
                here = np.flatnonzero((k == kind[0]) & (w == kind[1]))
                if dedupe:
                    i, at = batch.column("i").to_numpy()[here].astype(np.int64), batch.column("at").to_numpy()[here].astype(np.int64)
                    here = here[_earliest(a[here], n_a[here], b[here], n_b[here], i, at, *kind)]
                edits[here] = banded_distances(a[here], n_a[here], b[here], n_b[here], kind[0])
                ok[here] = edits[here] <= kind[0]
            out = [*[batch.column(c) for c in keep], pa.array(edits)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "edits"]).filter(pa.array(ok))

    return pairs.mapInArrow(verify, schema)


def segment_join(train: DataFrame, held: DataFrame, same: Sequence[str], carried: Sequence[str], letters: Callable[[str], Column], k: Column, w: Column) -> DataFrame:
    """Pairs of which a segment of ``held`` occurs in ``train`` at an allowed position: ``(*same, t_*, h_*, t_n, h_n, i, at, k, w)``.

    Both tables have the columns ``same``, which must be equal, and ``carried``. ``letters(prefix)`` is the array of
    letters, made of columns that may be prefixed by ``t_`` or ``h_``; ``k`` edits and the width ``w`` of a segment depend
    on ``same`` only. Held-out strings have ``(k + 1) * w`` letters at least.
    """

    def listed(df: DataFrame, prefix: str) -> DataFrame:
        rows = df.select(*same, *[F.col(c).alias(prefix + c) for c in carried], k.alias("k"), w.alias("w"), letters("").alias("__l"))
        return rows.withColumn(f"{prefix}n", F.size("__l"))

    def content(at: Column) -> Column:
        return F.xxhash64(F.slice("__l", at + 1, F.col("w")))

    def place(i: Column, n: Column) -> Column:
        return F.floor(i * n / (F.col("k") + 1)).cast("int")

    h = listed(held, "h_").withColumn("i", F.explode(F.sequence(F.lit(0), "k"))).withColumn("own", place(F.col("i"), F.col("h_n")))
    h = h.withColumn("__key", content(F.col("own"))).drop("__l", "k", "w")  # both depend on ``same``
    t = listed(train, "t_")
    n, kk, zero = F.col("t_n"), F.col("k"), F.lit(0)

    def allowed(i: Column) -> Column:
        few, many = place(i, F.greatest(n - kk, zero)), place(i, n + kk)
        first = F.greatest(zero, few - i, many - kk - (kk - i))
        last = F.least(n - F.col("w"), many + i, few + kk + (kk - i))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    places = F.array_distinct(F.flatten(F.transform(F.sequence(zero, kk), allowed)))
    t = t.withColumn("at", F.explode(places)).withColumn("__key", content(F.col("at"))).drop("__l", "k", "w")
    move, longer = F.col("at") - F.col("own"), F.col("t_n") - F.col("h_n")
    met = t.join(h, [*same, "__key"]).withColumns({"k": k, "w": w})
    return met.where((F.abs(move) <= F.col("i")) & (F.abs(move - longer) <= F.col("k") - F.col("i"))).drop("__key", "own")


def _bits(x: Column) -> Column:
    """How many binary digits a positive number has; 0 for 0."""
    return F.when(x > 0, F.length(F.bin(x))).otherwise(0)


def near_texts(train: DataFrame, held: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(train_text, held_text, edits)``: distinct texts within ``1 - similarity`` of the held-out one's letters in edits.

    Texts meet within classes of nearly equal length, eight to a doubling, which give the edits and the segments'
    width. Texts themselves are joined to the pairs last, by a digest. Null and empty texts take no part.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("similarity is 0.8 or more")

    def length_class(n: Column) -> Column:
        more = F.greatest(_bits(n) - 4, F.lit(0))
        return (more * 8 + F.call_function("shiftright", n, more)).cast("int")

    def texts(df: DataFrame) -> DataFrame:
        known = df.select("text").where(F.length("text") > 0).distinct().withColumn("id", F.md5("text"))
        return known.withColumn("n", F.length("text").cast("bigint"))

    more = F.greatest(F.floor(F.col("cls") / 8).cast("int") - 1, F.lit(0))
    low = F.call_function("shiftleft", F.col("cls") - 8 * more, more)
    high = F.call_function("shiftleft", F.col("cls") - 8 * more + 1, more) - 1
    k = F.floor(high * (1 - similarity) + 1e-9).cast("int")
    t, h = texts(train), texts(held)
    near = F.explode(F.sequence(length_class(F.greatest(F.floor(F.col("n") / (2 - similarity)), F.lit(1))), length_class(F.ceil(F.col("n") / similarity))))
    letters = lambda p: F.split(F.col(f"{p}text"), "")
    kept = [t.select("id", "text", near.alias("cls")), h.select("id", "text", length_class(F.col("n")).alias("cls"))]
    pairs = segment_join(*kept, ["cls"], ["id"], letters, k, F.greatest(F.floor(low / (k + 1)), F.lit(1)).cast("int"))
    pairs = pairs.select("t_id", "h_id", "cls", "k", "w").distinct()
    pairs = pairs.join(t.select(F.col("id").alias("t_id"), F.col("text").alias("t_text")), "t_id").join(h.select(F.col("id").alias("h_id"), F.col("text").alias("h_text")), "h_id")
    spelled = pairs.select(F.col("t_text").alias("train_text"), F.col("h_text").alias("held_text"), letters("t_").alias("t_letters"), letters("h_").alias("h_letters"), "k", "w")
    return _verified(spelled, ["train_text", "held_text"], False).where(F.col("edits") <= F.length("held_text") * (1 - similarity) + 1e-9)


def _grid(length: Column) -> Column:
    """Which power of two a cell is, for a train interval of ``length``: the least that makes it shorter than ``CELLS`` cells."""
    return _bits(F.floor(length / CELLS).cast("bigint")).cast("int")


def near_pairs(train: DataFrame, held: DataFrame, share: float = SHARE) -> DataFrame:
    """``(key, train_s, train_e, held_s, held_e, edits)``: pairs of classes sharing ``share`` of the longer one, each once.

    ``train`` and ``held`` have one row per class: key, s, e. ``edits`` counts cells. A held-out interval, of which there
    are fewer, is spelled on the grid, or both grids, that train ones near it have.
    """
    if not SHARE <= share <= 1:
        raise ValueError(f"share is {SHARE} or more, else an end may move by over one cell")
    length = F.col("e") - F.col("s")
    grids = F.sequence(_grid(F.floor(length * SHARE)), _grid(F.ceil(length / SHARE)))
    t = train.select("key", "s", "e", _grid(length).alias("grid"))
    h = held.select("key", "s", "e", F.explode(grids).alias("grid"))

    def letters(p: str) -> Column:
        return F.sequence(F.call_function("shiftright", F.col(f"{p}s"), F.col("grid")), F.call_function("shiftright", F.col(f"{p}e") - 1, F.col("grid")))

    k = F.when(F.col("grid") > 0, 2).otherwise(0)
    met = segment_join(t, h, ["key", "grid"], ["s", "e"], letters, k, F.lit(1))
    met = met.select("key", "t_s", "t_e", "h_s", "h_e", letters("t_").alias("t_letters"), letters("h_").alias("h_letters"), "k", "w", "i", "at")
    near = _verified(met, ["key", "t_s", "t_e", "h_s", "h_e"], True)
    shared = F.least("t_e", "h_e") - F.greatest("t_s", "h_s")
    longer = F.greatest(F.col("t_e") - F.col("t_s"), F.col("h_e") - F.col("h_s"))
    named = [F.col(f"{p[0]}_{c}").alias(f"{p}_{c}") for p in ("train", "held") for c in "se"]
    return near.where(shared >= longer * share - 1e-9).select("key", *named, "edits")


def _written(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train and held-out rows that have a string, written once as they are read several times."""
    rows = checkpoint(rows.select("id", "key", "s", "e", "split", "source").where("e > s").dropna(subset=["id", "key", "s", "e", "split"]))
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


def row_pairs(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """``(train_id, held_id, edits, and the held row's split and source)``, one row per pair of rows.

    ``rows`` has id, key, s, e, split (train or any other) and source. Pairs of copies are all given here, as the
    result asks for them; ``near_pairs`` with ``leak_counts`` is the form that doesn't multiply copies.
    """
    train, held = _written(rows)
    pairs = near_pairs(train.select("key", "s", "e").distinct(), held.select("key", "s", "e").distinct(), share)
    a = train.select("key", F.col("s").alias("train_s"), F.col("e").alias("train_e"), F.col("id").alias("train_id"))
    b = held.select("key", F.col("s").alias("held_s"), F.col("e").alias("held_e"), F.col("id").alias("held_id"), "split", "source")
    return pairs.join(a, ["key", "train_s", "train_e"]).join(b, ["key", "held_s", "held_e"]).select("train_id", "held_id", "edits", "split", "source")


def leak_counts(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """``(split, source, n_held, n_leaked, n_pairs)``: held-out rows, those with a partner in train, and their pairs.

    Counted over classes, so copies are weighted, not joined.
    """
    train, held = _written(rows)
    train = train.groupBy("key", "s", "e").agg(F.count(F.lit(1)).alias("n_train"))
    held = held.groupBy("key", "s", "e", "split", "source").agg(F.count(F.lit(1)).alias("n_held"))
    pairs = near_pairs(train.select("key", "s", "e"), held.select("key", "s", "e").distinct(), share)
    t = train.select("key", F.col("s").alias("train_s"), F.col("e").alias("train_e"), "n_train")
    links = pairs.join(t, ["key", "train_s", "train_e"]).groupBy("key", F.col("held_s").alias("s"), F.col("held_e").alias("e")).agg(F.sum("n_train").alias("links"))
    n = F.col("n_held")
    return held.join(links, ["key", "s", "e"], "left").groupBy("split", "source").agg(
        F.sum(n).alias("n_held"), F.sum(F.when(F.col("links") > 0, n).otherwise(0)).alias("n_leaked"), F.sum(n * F.coalesce("links", F.lit(0))).alias("n_pairs"),
    )
