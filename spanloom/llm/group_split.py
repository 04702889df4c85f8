"""Train, validation and test splits that keep related records together.

Records are related if they share a value in a key column, or if their key values are linked, directly or over others.
Vertices are key values, edges link the key values of one record (or are given). Components are found by random-mate
contraction: each round every vertex tosses a coin, those with heads that have a neighbour with tails collapse into
one such neighbour, and edges are relabelled and made distinct, until none is left. A round removes about a quarter of
the vertices that still have edges. The rounds' mappings are then unwound, last first, into one label per vertex.
Components are given to splits by cumulative weight, heaviest first; equal weights in the order of a digest.

Every round is a few SQL joins; its tables are checkpointed in the shared folder, so a lost executor costs a re-read.
Nothing but a count per round reaches the driver. Null key values link nothing; a record with no key value at all is a
component of its own. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import checkpoint

SEED = 7
#: Rows that one window of a running total may cover; the number of windows grows with the rows.
PIECE_ROWS = 1 << 16
MAX_ROUNDS = 200


def _coin(vertex: Column, step: int, seed: int) -> Column:
    return F.xxhash64(vertex, F.lit(seed * 1_000_003 + step)) % 2 == 0


def record_edges(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(u, v)``: distinct links between the key values of a record, each column's values kept apart by its name.

    A record with m key values gives m - 1 links, from its first value to the others, which connect the same values as
    all pairs would.
    """
    values = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in keys]), lambda x: x.isNotNull())
    linked = records.select(values.alias("k")).where(F.size("k") > 1).distinct()
    return linked.select(F.col("k")[0].alias("u"), F.explode(F.slice("k", 2, len(keys))).alias("v")).distinct()


def components(edges: DataFrame, seed: int = SEED) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges`` ``(u, v)``; the component is named by one of its vertices.

    Edges with a null end and loops link nothing; a vertex that has only loops is its own component.
    """
    given = edges.select("u", "v").dropna()
    vertices = given.select(F.col("u").alias("vertex")).union(given.select(F.col("v").alias("vertex"))).distinct()
    live = checkpoint(given.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        if len(rounds) >= MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds")
        step = len(rounds)
        both = live.select("u", "v").union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mates = both.where(_coin(F.col("u"), step, seed) & ~_coin(F.col("v"), step, seed)).groupBy("u").agg(F.min("v").alias("into"))
        mates = checkpoint(mates)
        rounds.append(mates)
        one = live.join(mates, "u", "left").select(F.coalesce("into", "u").alias("u"), "v")
        two = one.join(mates.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("into", "v").alias("v"))
        live = checkpoint(two.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    # unwind: the last round's survivors are labels; each earlier mapping is carried through the later ones
    labels: DataFrame | None = None
    for mates in reversed(rounds):
        if labels is None:
            labels = mates.select(F.col("u").alias("vertex"), F.col("into").alias("component"))
            continue
        later = labels.select(F.col("vertex").alias("into"), "component")
        moved = mates.join(later, "into", "left").select(F.col("u").alias("vertex"), F.coalesce("component", "into").alias("component"))
        labels = checkpoint(moved.union(labels))
    if labels is None:
        return vertices.select("vertex", F.col("vertex").alias("component"))
    return vertices.join(labels, "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def named_by_least(labels: DataFrame) -> DataFrame:
    """``(vertex, component)`` with each component named by its least vertex, whatever the coins were.

    The least names are found by partial minima, so a component that holds a third of all vertices is no hot group.
    """
    least = labels.groupBy("component").agg(F.min("vertex").alias("__least"))
    return labels.join(least, "component").select("vertex", F.col("__least").alias("component"))


def cumulative(df: DataFrame, order: Sequence[str], weight: str, out: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``out``, the total weight of all earlier rows in a total order, without a window over the whole table.

    Rows are ordered by the first column, then by the MD5 digest of the second, which is unique. Those of one value of
    the first are cut by their digest into as many pieces as ``piece_rows`` asks for, so a window covers about that many
    rows however many share a value; totals of pieces, one row each, are summed up among themselves. The first column
    has few values.
    """
    first, second = order
    df = df.withColumn("__digest", F.md5(F.col(second).cast("string")))
    sizes = df.groupBy(first).agg(F.ceil(F.count(F.lit(1)) / piece_rows).alias("__pieces"))
    at = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("bigint")
    df = df.join(sizes, first).withColumn("__piece", F.floor(at * F.col("__pieces") / (1 << 32))).drop("__pieces")
    totals = df.groupBy(first, "__piece").agg(F.sum(weight).alias("__w"))
    before = totals.select(first, "__piece", F.coalesce(F.sum("__w").over(Window.orderBy(first, "__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy(first, "__piece").orderBy("__digest").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__in", inside).join(before, [first, "__piece"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__piece", "__digest", "__in", "__before")


def split_components(weights: DataFrame, targets: DataFrame) -> DataFrame:
    """Add ``split_name`` to ``weights`` ``(component, weight)``: components in falling order of weight fill the splits.

    Splits are filled in falling order of their share. A component goes where the middle of its stretch of the
    cumulative weight lies, so a split misses its share by at most half the weight of the component on its border,
    which falling order keeps small. Weights are rounded down to powers of 1.02 for the order, which leaves at most some
    2,200 different ones; those alike are ordered by a digest. ``weights`` is written once. ``targets`` has split_name and target_share; shares are
    taken relative to their sum, null or non-positive ones left out.
    """
    weights = checkpoint(weights.select("component", "weight"))
    rank = (-F.floor(F.log(F.greatest(F.col("weight"), F.lit(1)).cast("double")) / F.log(F.lit(1.02)))).cast("int")
    placed = cumulative(weights.withColumn("__rank", rank), ["__rank", "component"], "weight", "__at")
    total = weights.agg(F.sum("weight").alias("__total"))
    shares = targets.where("target_share > 0").groupBy("split_name").agg(F.sum("target_share").alias("share"))
    upto = Window.orderBy(F.desc("share"), "split_name").rowsBetween(Window.unboundedPreceding, 0)
    bounds = shares.withColumn("hi", F.sum("share").over(upto)).withColumn("sum", F.sum("share").over(Window.partitionBy()))
    bounds = bounds.agg(F.array_sort(F.collect_list(F.struct((F.col("hi") / F.col("sum")).alias("hi"), "split_name"))).alias("__bounds"))
    middle = (F.col("__at") + F.col("weight") / 2) / F.col("__total")
    placed = placed.withColumn("__total", total.scalar()).withColumn("__bounds", bounds.scalar()).withColumn("__m", middle)
    fit = F.coalesce(F.get(F.filter("__bounds", lambda b: b["hi"] > F.col("__m")), F.lit(0)), F.element_at("__bounds", -1))
    return placed.select("component", "weight", fit["split_name"].alias("split_name"))


def misplaced(records: DataFrame, component: str, split: str) -> DataFrame:
    """Records whose split isn't the one that holds most records of their component.

    Null components or splits don't count. Of equally large splits the first by name is taken as the one that holds
    most. Counts are added up before the shuffle; the counts, not the records, are grouped by component.
    """
    known = records.where(F.col(component).isNotNull() & F.col(split).isNotNull())
    counts = known.groupBy(component, split).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(component).agg(F.min_by(split, F.struct(-F.col("n"), F.col(split))).alias("__top"))
    return known.join(top, component).where(F.col(split) != F.col("__top")).drop("__top")
