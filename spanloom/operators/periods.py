"""Continuous periods and the gaps between them, by a sweep over interval boundaries.

Each interval gives an event +1 at its start and -1 at its end. Summed up in order they count the intervals that are
active; a period starts where the count leaves zero and ends where it comes back, and from there to the next start is
a gap. Events at one position are added first, so touching intervals are one period.

A group may hold a third of all rows, so no window covers a group. Intervals are cut at the borders of blocks of
positions, so the count of every block begins and ends with zero and the window that runs over events covers one block.
Where one block's last period ends on the border on which the next block's first one starts, neither boundary is one:
of each block the first and the last two boundaries meet in a second window, which drops such pairs and links what is
left. The input is read once and its rows are shuffled once, as intervals.

Rows lacking start or end, or with end <= start, don't count. Null keys form groups like any other value. Repeated rows
change nothing. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 22


def periods_and_gaps(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", block: int = BLOCK) -> DataFrame:
    """``(*by, kind, from_base, to_base)`` with kind 'period' or 'gap'."""
    by = list(by)
    names = [f"__k{i}" for i in range(len(by))]
    keys = [*names, "block"]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(start).alias("s"), F.col(end).alias("e")).where("e > s")
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor((F.col("e") - 1) / block))))
    cut = rows.select(*keys, F.greatest("s", F.col("block") * block).alias("s"), F.least("e", (F.col("block") + 1) * block).alias("e")).repartition(*keys)

    event = F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("d")))).alias("ev")
    events = cut.select(*keys, event).groupBy(*keys, F.col("ev.pos").alias("pos")).agg(F.sum("ev.d").alias("d"))
    inside = Window.partitionBy(*keys).orderBy("pos")
    counted = events.withColumn("active", F.sum("d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    edges = counted.where((F.col("d") != 0) & ((F.col("active") == 0) | (F.col("active") == F.col("d"))))
    kind = F.when(F.col("active") == 0, "gap").otherwise("period")
    edges = edges.select(*keys, "pos", kind.alias("kind"), F.lead("pos").over(inside).alias("next"), F.row_number().over(inside).alias("n"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("m"))

    # boundaries alternate, so a block has an even number of them; what follows the second up to the third last is certain
    certain = (F.col("n") > 1) & (F.col("n") < F.col("m") - 1)
    within = edges.where(certain).select(*names, "kind", F.col("pos").alias("from_base"), F.col("next").alias("to_base"))
    border = edges.where((F.col("n") <= 2) | (F.col("n") >= F.col("m") - 1))
    onward = Window.partitionBy(*names).orderBy("pos", "block")
    lost = F.when(F.col("kind") == "gap", F.lead("pos").over(onward) == F.col("pos")).otherwise(F.lag("pos").over(onward) == F.col("pos"))
    linked = border.withColumn("lost", F.coalesce(lost, F.lit(False))).where(~F.col("lost")).withColumn("onward", F.lead("pos").over(onward))
    across = linked.where(~certain & F.col("onward").isNotNull()).select(*names, "kind", F.col("pos").alias("from_base"), F.col("onward").alias("to_base"))
    return within.unionAll(across).select(*[F.col(n).alias(c) for n, c in zip(names, by)], "kind", "from_base", "to_base")
