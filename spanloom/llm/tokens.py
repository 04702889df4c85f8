"""Token counts of texts under a public byte-level BPE vocabulary, whose files stay where they are installed.

Byte-level BPE cuts a text into pieces by a pattern and encodes each piece by itself, so a text's count is the sum over
its pieces. Pieces are cut by the pattern spelled out for Western letters and their counts remembered; a text with any
other character goes to the tokenizer whole. Both ways give the tokenizer's own count, which the tests check.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spanloom.llm.spoken import Memo

FILE = "byte_bpe_50k.tiktoken"
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
#: Times of cues are cut into a few chunks, each a whole number of pieces, as there are few different ones.
_TIME = r" ?[0-9]{2}:[0-9]{2}(?::[0-9]{2})?(?=[,.][0-9]{3}[ \n\r])|(?<=:[0-9]{2})[,.][0-9]{3}(?: -->(?= [0-9])|(?=[ \n\r]))"
_PIECE = re.compile(rf"{_TIME}|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^\x00-\x1b\x20-ɏ‐-‧♪♫�]")


def default_file() -> str:
    """Where the installed vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(FILE))


@cache
def encoding(path: str):
    """The tokenizer of a rank file, loaded once a process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("spanloom", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _piece_counts(path: str) -> Memo:
    encode = encoding(path).encode_ordinary
    return Memo(lambda piece: len(encode(piece)))


def count(text: str | None, path: str) -> int:
    """Number of tokens of the whole text; 0 for null and empty."""
    if not text:
        return 0
    if _OTHER.search(text):
        return len(encoding(path).encode_ordinary(text))
    return sum(map(_piece_counts(path).__getitem__, _PIECE.findall(text)))


def token_sizes(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)`` of all documents; a null text has none."""
    path = path or default_file()
    kinds = documents.select("doc_id", "source").schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([count(text.as_py(), path) for text in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(counted, kinds.add("n_tokens", T.LongType()))
