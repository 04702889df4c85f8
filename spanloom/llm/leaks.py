"""Held-out passages that are spoken, wholly or partly, in a corpus.

Patterns are all stretches of ``WORDS`` consecutive words of the passages. They are searched all at once by the method
of Wu and Manber over words instead of letters: a table of shifts, by the block of the last ``BLOCK`` words in the
window, tells how far the window may move without missing a pattern; where the shift is zero, the hash bucket of that
block names the patterns that end so, and their skeletons and then their words are compared directly. A word that no
passage has moves the window behind itself. Search works on skeletons, which damaged characters don't change, so
nothing is missed; the comparison of ``spoken.fine`` forms then rejects chance matches.

A hidden character that stands alone may be a word of one accented letter or punctuation. The search above leaves it
out. Then each run of them is tried as a word as well: wherever a passage has such a word between the same neighbours,
the stretch is followed to both sides, each further hidden character being left out or taken, until it has ``WORDS``
words or ends.

What is doubtful in a document, such as a line that reads like an advert, is left out of its words; then the stretch
around each doubtful part is searched as it reads if that part is spoken.

The corpus isn't shuffled: each task scans its documents against the table. The table is a broadcast of bounded
size: passages are taken in blocks of at most ``BLOCK_CHARS`` characters, one scan of the corpus per block. A Python
worker makes its tables from it once.

Null, empty and speechless texts leak nothing; a passage of fewer than ``words`` words has no pattern. Repeated items
and documents are reported like any other row; a pair is reported once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.llm import spoken

WORDS = 12
BLOCK = 3
BLOCK_CHARS = 8_000_000
HIDDEN = -2


class Searcher:
    """Shift table and suffix buckets over one block of passages."""

    def __init__(self, passages: list[tuple[int, str]], words: int = WORDS, block: int = BLOCK):
        if words < block:
            raise ValueError("a pattern is at least one block long")
        self.words, self.block = words, block
        self.ids: dict[str, int] = {}
        self.passages: list[tuple[int, list[str], list[int]]] = []
        self.hidable: list[list[bool]] = []
        for item, text in passages:
            known = [w for w in spoken.words_of(text or "") if spoken.fine[w]]
            fine = [spoken.fine[w] for w in known]
            self.passages.append((item, fine, [self.ids.setdefault(spoken.skeleton(f), len(self.ids)) for f in fine]))
            self.hidable.append([spoken.may_be_hidden(w) for w in known])
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for n, (_, _, code) in enumerate(self.passages):
            for at in range(len(code) - words + 1):
                for end in range(block, words + 1):
                    key = tuple(code[at + end - block : at + end])
                    self.shift[key] = min(self.shift.get(key, words), words - end)
                self.buckets.setdefault(tuple(code[at + words - block : at + words]), []).append((n, at))

        # Of a stretch around a word that may be hidden, one side has ``near`` words at least.
        self.near = min(block, words // 2)
        self.beside: dict[tuple[int, tuple[int, ...]], list[tuple[int, int]]] = {}
        for n, (_, _, code) in enumerate(self.passages):
            may = self.hidable[n]
            for at in (i for i, h in enumerate(may) if h):
                for step in (1, -1):
                    keys: set[tuple[int, ...]] = {()}
                    for i in range(at + step, at + step * (self.near + 1), step):
                        keys = {(*k, c) for k in keys for c in ((code[i], HIDDEN) if may[i] else (code[i],))} if 0 <= i < len(code) else set()
                    for key in keys:
                        self.beside.setdefault((step, key), []).append((n, at))

    def _sides(self, codes: list[int], at: int, step: int) -> set[tuple[int, ...]]:
        """The ``near`` codes that may follow ``at`` in a direction, hidden words left out or taken."""
        open_, done = {()}, set()
        i = at + step
        while open_ and 0 <= i < len(codes):
            longer = {(*k, codes[i]) for k in open_}
            open_ = open_ | longer if codes[i] == HIDDEN else longer
            done |= {k for k in open_ if len(k) == self.near}
            open_ = {k for k in open_ if len(k) < self.near}
            i += step
        return done

    def _reach(self, words: list[str], codes: list[int], at: int, which: int, place: int, step: int) -> int:
        """How many words beyond ``at`` in a direction are those beyond ``place`` in the passage, ``words`` - 1 at most."""
        _, fine, _ = self.passages[which]
        may, best, lengths = self.hidable[which], 0, {0}
        i = at + step
        while lengths and best < self.words - 1 and 0 <= i < len(codes):
            longer = set()
            for n in lengths:
                j = place + step * (n + 1)
                if 0 <= j < len(fine) and (may[j] if codes[i] == HIDDEN else codes[i] >= 0 and spoken.alike(spoken.fine[words[i]], fine[j])):
                    longer.add(n + 1)
            lengths = lengths | longer if codes[i] == HIDDEN else longer
            best = max(best, *longer) if longer else best
            i += step
        return best

    def _found_hidden(self, words: list[str], codes: list[int], out: set[int]) -> None:
        """Add the items found where hidden characters that stand alone are words.

        Of a run of them no more than ``words`` can be taken, so longer runs are as good as cut to that.
        """
        kept, run = [], 0
        for i, c in enumerate(codes):
            run = run + 1 if c == HIDDEN else 0
            if run <= self.words:
                kept.append(i)
        words, codes = [words[i] for i in kept], [codes[i] for i in kept]
        for at in (i for i, c in enumerate(codes) if c == HIDDEN):
            for which, place in {p for step in (1, -1) for k in self._sides(codes, at, step) for p in self.beside.get((step, k), ())}:
                item = self.passages[which][0]
                if item not in out and 1 + self._reach(words, codes, at, which, place, -1) + self._reach(words, codes, at, which, place, 1) >= self.words:
                    out.add(item)

    def found(self, texts: list[str], code_of: spoken.Memo) -> set[int]:
        """Items of which ``words`` consecutive words are spoken in ``texts``."""
        out: set[int] = set()
        m, block, longest = self.words, self.block, self.words - self.block + 1
        words, codes = texts, [code_of[w] for w in texts]
        if None in codes:
            words = [w for w, c in zip(texts, codes) if c is not None]
            codes = [c for c in codes if c is not None]
        if HIDDEN in codes:
            if self.beside:
                self._found_hidden(words, codes, out)
            words = [w for w, c in zip(words, codes) if c != HIDDEN]
            codes = [c for c in codes if c != HIDDEN]
        end, n = m, len(words)
        shift, buckets = self.shift, self.buckets
        while end <= n:
            for back in range(1, block + 1):
                if codes[end - back] < 0:  # no passage has this word
                    end += m - back + 1
                    break
            else:
                key = tuple(codes[end - block : end])
                step = shift.get(key, longest)
                if step:
                    end += step
                    continue
                window = codes[end - m : end]
                for which, at in buckets.get(key, ()):
                    item, fine, code = self.passages[which]
                    if item not in out and code[at : at + m] == window and all(spoken.alike(spoken.fine[words[end - m + i]], fine[at + i]) for i in range(m)):
                        out.add(item)
                end += 1
        return out

    def spoken_in(self, text: str | None, code_of: spoken.Memo) -> set[int]:
        """Items of which ``words`` consecutive words are spoken in a document, whether or not its doubtful parts are spoken."""
        words, parts = spoken.read(text)
        if not any(parts):
            return self.found(words, code_of)
        out = self.found([w for w, p in zip(words, parts) if not p], code_of)
        for stretch in spoken.stretches(words, parts, self.words - 1):
            out |= self.found(stretch, code_of)
        return out

    def codes(self) -> spoken.Memo:
        """Word as written to its skeleton's number: -1 if no passage has it, ``HIDDEN`` if it may be a word all hidden, None if it is no word."""
        return spoken.Memo(lambda w: self.ids.get(spoken.skeleton(f), -1) if (f := spoken.fine[w]) else HIDDEN if spoken.hides_a_word(w) else None)


_made: dict[str, tuple[Searcher, spoken.Memo]] = {}


def _searcher(name: str, passages: list[tuple[int, str]], words: int) -> tuple[Searcher, spoken.Memo]:
    """The tables of a block of passages and its codes, kept by the Python worker for its next task."""
    if name not in _made:
        _made.clear()
        made = Searcher(passages, words)
        _made[name] = made, made.codes()
    return _made[name]


def _blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most ``limit`` characters; a longer passage is a block of its own."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select("item_id", "passage").dropna().toLocalIterator():
        if block and size + len(row.passage) > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.passage))
        size += len(row.passage)
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame, words: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(item_id, doc_id)`` for each document in which ``words`` consecutive words of the item's passage are spoken."""
    spark: SparkSession = documents.sparkSession
    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("doc_id", documents.schema["doc_id"].dataType)])
    corpus = documents.select("doc_id", "text").where(F.length("text") > 0)
    arrow = [to_arrow_type(f.dataType) for f in schema]
    result: DataFrame | None = None
    for passages in _blocks(items, block_chars):
        table, name = spark.sparkContext.broadcast(passages), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], table=table, name=name) -> Iterator[pa.RecordBatch]:
            searcher, code_of = _searcher(name, table.value, words)
            for batch in batches:
                ids, docs = [], []
                for doc, text in zip(batch.column(0), batch.column(1)):
                    for item in searcher.spoken_in(text.as_py(), code_of):
                        ids.append(item)
                        docs.append(doc.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(ids, arrow[0]), pa.array(docs, arrow[1])], names=["item_id", "doc_id"])

        part = corpus.mapInArrow(scan, schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], schema)
    return result.distinct()


def leak_report(pairs: DataFrame, items: DataFrame, documents: DataFrame) -> DataFrame:
    """``(suite, n_items, n_leaked_items, n_docs)``: how many items of each suite leak, into how many documents."""
    known = items.select("item_id", "suite")
    leaked = pairs.join(known, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("n_leaked_items"), F.countDistinct("doc_id").alias("n_docs"))
    return known.groupBy("suite").agg(F.countDistinct("item_id").alias("n_items")).join(leaked, "suite", "left").na.fill(0, ["n_leaked_items", "n_docs"])
