"""A mixture of sources with target shares, in tokens, each source repeated at most so often.

The tokens of a source's documents, in an order shuffled by a hash, are packed into blocks of fixed length. The mixture
has as many slots as all sources together have blocks. Each output shard draws from a multinomial distribution how many
of its slots each source gets; the k-th slot of a source, counted over all shards, takes the block at the place k of the
source's permutation, one permutation after another for each repeat, so no block is used a second time before all were
used once, and none more often than ``max_repeats``. Slots beyond that stay empty and are reported. Permutations are
Feistel networks on the index, walked until it falls in the range: nothing is sorted or stored. Blocks are joined to
slots by (source, index), which is unique on the blocks' side and evenly spread whatever a source's size.

Sources are spelled as in the targets; the documents' are read ignoring letter case and surrounding blanks and tabs.
Documents of other or null sources take no part; empty and null texts have no tokens. A source without documents
gets no blocks and falls short. Shares that don't sum up to one are drawn in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.blocks import carried, join_on_same

BLOCK_TOKENS = 1024
SHARD_SLOTS = 4096
SEED = 11
#: Documents, or shards, that one window of a running total may cover; the number of windows grows with them.
PIECE_DOCS = 1 << 16
PIECE_SHARDS = 1 << 12
FEISTEL_ROUNDS = 4


def _key(name: Column) -> Column:
    return F.lower(F.btrim(name, F.lit(" \t")))


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull())
    return t.groupBy(_key(F.col("source")).alias("key")).agg(F.min("source").alias("source"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def capacity(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: ``source, target_share, max_repeats, n_docs, n_tokens, all_tokens, short``.

    ``all_tokens`` is the total over all target sources; ``short`` tells that ``max_repeats`` times the source's tokens
    are less than its share of that. Sums are made before the shuffle, so a large source sends one row a task.
    """
    sums = sizes.groupBy(_key(F.col("source")).alias("key")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    known = _targets(targets).join(sums, "key", "left").na.fill(0, ["n_docs", "n_tokens"])
    known = known.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy()))
    short = F.col("n_tokens") * F.col("max_repeats") < F.col("target_share") * F.col("all_tokens")
    return known.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "all_tokens", F.coalesce(short, F.lit(False)).alias("short"))


def pack(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, piece_docs: int = PIECE_DOCS) -> DataFrame:
    """``(source, block, doc_id, from_token, to_token)``: the parts of documents that make up each block.

    A document's place is the sum of those before it in its (source, hash piece), plus the pieces' totals. A source has
    as many pieces as keep them at about ``piece_docs`` documents, so no window covers a source. The last block of a
    source may be shorter.
    """
    key = _key(F.col("source"))
    docs = sizes.where("n_tokens > 0").select(key.alias("key"), "doc_id", "n_tokens").join(_targets(targets).select("key", "source"), "key")
    pieces = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / piece_docs).alias("pieces"))
    docs = docs.join(pieces, "source").withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).drop("pieces")
    totals = docs.groupBy("source", "piece").agg(F.sum("n_tokens").alias("w"))
    earlier = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "piece", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "piece").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(totals, ["source", "piece"])
    docs = docs.withColumn("at", F.col("before") + F.col("within")).withColumn("to", F.col("at") + F.col("n_tokens"))
    size = F.lit(block_tokens)
    parts = docs.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("to") - 1) / size))))
    start = F.col("block") * size
    return parts.select("source", "block", "doc_id", (F.greatest("at", start) - F.col("at")).alias("from_token"), (F.least("to", start + size) - F.col("at")).alias("to_token"))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``index`` in a pseudorandom permutation of ``0 .. size - 1`` that ``key`` chooses."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    key, size = key.astype(np.uint64), size.astype(np.uint64)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in range(FEISTEL_ROUNDS):
            mixed = (right + k + np.uint64(r * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & m)
        out[todo] = (left << h) | right
        todo = out >= size
    return out.astype(np.int64)


def slots(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(shard, source, slot, epoch, block)``: every slot of the mixture; epoch and block are null where it stays empty.

    The table of sources is small by its nature, one row each, and is read once by the driver for the draw's
    probabilities; shards are drawn in parallel, each from its own seed.
    """
    spark = sizes.sparkSession
    per_source = capacity(sizes, targets).select("source", "target_share", "max_repeats", "n_tokens").orderBy("source").collect()
    blocks = np.array([-(-r.n_tokens // block_tokens) for r in per_source], dtype=np.int64)
    weights = np.array([max(r.target_share or 0.0, 0.0) for r in per_source])
    total = int(blocks.sum())
    shards = -(-total // shard_slots)
    if not total or not weights.sum():
        return spark.createDataFrame([], "shard long, source string, slot long, epoch long, block long")
    names, weights = [r.source for r in per_source], weights / weights.sum()

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                here = min(shard_slots, total - int(shard) * shard_slots)
                n = np.random.default_rng([seed, int(shard)]).multinomial(here, weights)
                yield pd.DataFrame({"shard": int(shard), "source": names, "n": n})

    drawn = spark.range(shards).mapInPandas(draw, "shard long, source string, n long")
    drawn = drawn.withColumn("piece", F.floor(F.col("shard") / PIECE_SHARDS))
    inside = F.sum("n").over(Window.partitionBy("source", "piece").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    drawn = join_on_same(drawn.withColumn("inside", inside), carried(drawn, ["source"], "piece", F.sum("n"), "before"), ["source", "piece"])
    rows = drawn.withColumn("first", F.coalesce("inside", F.lit(0)) + F.coalesce("before", F.lit(0))).where("n > 0").select("shard", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    of = {r.source: (i, int(blocks[i]), int(blocks[i]) * int(r.max_repeats or 0)) for i, r in enumerate(per_source)}

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            which = frame["source"].map(lambda s: of[s][0]).to_numpy(np.int64)
            n = frame["source"].map(lambda s: of[s][1]).to_numpy(np.int64)
            slot, room = frame["slot"].to_numpy(np.int64), frame["source"].map(lambda s: of[s][2]).to_numpy(np.int64)
            fits = slot < room
            safe = np.where(fits, n, 1)
            epoch = slot // safe
            block = permuted(slot % safe, safe, (which * 1_000_003 + epoch) * 1_000_003 + seed)
            gone = pd.array(np.where(fits, 0, 1), dtype="boolean")
            yield frame.assign(epoch=pd.array(epoch, dtype="Int64").copy(), block=pd.array(block, dtype="Int64").copy()).mask(pd.DataFrame({"shard": False, "source": False, "slot": False, "epoch": gone, "block": gone}, index=frame.index))

    return rows.mapInPandas(placed, "shard long, source string, slot long, epoch long, block long")


def mixture(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``(shard, source, slot, epoch, block, doc_id, from_token, to_token)``: what to write to each shard, in parts of documents."""
    filled = slots(sizes, targets, block_tokens, shard_slots, seed).where(F.col("block").isNotNull())
    return filled.join(pack(sizes, targets, block_tokens), ["source", "block"]).select("shard", "source", "slot", "epoch", "block", "doc_id", "from_token", "to_token")


def shares(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Per source: target and reached share of the mixture's tokens, slots drawn and filled, and whether it falls short.

    What was reached is counted in the blocks that the slots were filled with. Empty slots are spread by their number.
    """
    drawn = slots(sizes, targets, block_tokens, shard_slots, seed).select("source", F.coalesce("block", -1 - F.col("slot")).alias("block"))
    packed = pack(sizes, targets, block_tokens).groupBy("source", "block").agg(F.sum(F.col("to_token") - F.col("from_token")).alias("size"))
    used = drawn.join(packed, ["source", "block"], "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("slots_drawn"), F.count("size").alias("slots_filled"), F.coalesce(F.sum("size"), F.lit(0)).cast("bigint").alias("tokens_used"))
    full = capacity(sizes, targets).join(used, "source", "left").na.fill(0, ["slots_drawn", "slots_filled", "tokens_used"])
    return full.withColumn("reached_share", F.col("tokens_used") / F.sum("tokens_used").over(Window.partitionBy())).drop("all_tokens")


def fallen_short(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``shares`` of the sources with slots that stayed empty and, by their exact number of tokens, can't reach their share.

    A draw is random, so of few slots a source just below its share may by chance get none too many; a slot more or
    less matters only near the limit.
    """
    return shares(sizes, targets, block_tokens, shard_slots, seed).where("slots_filled < slots_drawn and short")


def checked(sizes: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """What must hold of every mixture, per source: ``tokens_once``, ``within_repeats``, ``near_target``.

    Each token lies in one block; no block is used more than ``max_repeats`` times; the slots drawn are within six
    standard deviations of the target share of all slots.
    """
    key = _key(F.col("source"))
    parts = pack(sizes, targets, block_tokens)
    docs = parts.groupBy("source", "doc_id").agg(F.min("from_token").alias("lo"), F.max("to_token").alias("hi"), F.sum(F.col("to_token") - F.col("from_token")).alias("n"), F.count(F.lit(1)).alias("parts"), (F.max("block") - F.min("block") + 1).alias("blocks"))
    docs = docs.withColumn("whole", (F.col("lo") == 0) & (F.col("hi") == F.col("n")) & (F.col("parts") == F.col("blocks")))
    packed = docs.groupBy(key.alias("key")).agg(F.every("whole").alias("whole"), F.sum("n").alias("packed"))
    used = slots(sizes, targets, block_tokens, shard_slots, seed).where("block is not null").groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    most = used.groupBy(key.alias("key")).agg(F.max("n").alias("most"))
    one = Window.partitionBy()
    known = shares(sizes, targets, block_tokens, shard_slots, seed).withColumn("key", key).join(packed, "key", "left").join(most, "key", "left")
    p, n = F.col("target_share") / F.sum("target_share").over(one), F.sum("slots_drawn").over(one)
    return known.select(
        "source", (F.coalesce("whole", F.lit(True)) & (F.coalesce("packed", F.lit(0)) == F.col("n_tokens"))).alias("tokens_once"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), (F.abs(F.col("slots_drawn") - n * p) <= 6 * F.sqrt(n * p * (1 - p)) + 1).alias("near_target"),
    )
