"""Sequence columns: slices, unknown bases, one-hot encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weight of A, C, G and T in each letter of the IUPAC alphabet.
ONE_HOT = {
    "A": (1.0, 0.0, 0.0, 0.0), "C": (0.0, 1.0, 0.0, 0.0), "G": (0.0, 0.0, 1.0, 0.0), "T": (0.0, 0.0, 0.0, 1.0),
    "R": (0.5, 0.0, 0.5, 0.0), "Y": (0.0, 0.5, 0.0, 0.5), "K": (0.0, 0.0, 0.5, 0.5), "M": (0.5, 0.5, 0.0, 0.0), "S": (0.0, 0.5, 0.5, 0.0), "W": (0.5, 0.0, 0.0, 0.5),
    "B": (0.0, 0.333, 0.333, 0.333), "D": (0.333, 0.0, 0.333, 0.333), "H": (0.333, 0.333, 0.0, 0.333), "V": (0.333, 0.333, 0.333, 0.0),
    "N": (0.25, 0.25, 0.25, 0.25),
}


def unknown_fraction(sequence: Column) -> Column:
    """Share of letters other than A, C, G and T; lower case is unknown. Null for a null or empty sequence."""
    return F.when(F.length(sequence) > 0, F.length(F.regexp_replace(sequence, "[ACGT]", "")) / F.length(sequence))


def known_enough(df: DataFrame, length: int, maximum_unknown: float = 0.1, sequence: str = "sequence") -> DataFrame:
    """Rows whose sequence has the full length and at most the given share of unknown bases."""
    s = F.col(sequence)
    return df.where((F.length(s) == length) & (unknown_fraction(s) <= maximum_unknown))


def one_hot(sequence: Column, strict: bool = True) -> Column:
    """Length x 4 array of weights. An unlisted letter raises, or is all zeros if not ``strict``. Null stays null."""
    table = F.create_map(*[c for letter, v in ONE_HOT.items() for c in (F.lit(letter), F.array(*[F.lit(w) for w in v]))])
    zero = F.array(*[F.lit(0.0)] * 4)

    def weights(letter: Column) -> Column:
        found = F.try_element_at(table, letter)
        return F.coalesce(found, F.raise_error(F.concat(F.lit("no base: "), letter)).cast("array<double>")) if strict else F.coalesce(found, zero)

    return F.when(F.length(sequence) > 0, F.transform(F.split(sequence, ""), weights)).when(sequence.isNotNull(), F.array().cast("array<array<double>>"))


def letter_index(letter: Column) -> Column:
    """Place of an upper-case letter in the alphabet, from 0."""
    return F.ascii(letter) - 65


def slices(ranges: DataFrame, genome: DataFrame, chunk_size: int, out: str = "sequence") -> DataFrame:
    """Add ``out``, the letters of ``[start, end)`` on ``chrom``; what lies beyond the chromosome is cut off.

    ``genome`` has (chrom, chunk, letters), chunks of ``chunk_size`` letters in a row, the last one shorter. Each range
    meets the few chunks it touches; rows are grouped by all their columns, so repeated ranges come back as often.
    """
    columns = ranges.columns
    rows = ranges.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    first, last = F.greatest(F.floor(F.col("start") / chunk_size), F.lit(0)), F.floor((F.col("end") - 1) / chunk_size)
    want = rows.withColumn("__chunk", F.explode_outer(F.when(last >= first, F.sequence(first, last))))
    met = want.join(genome.select("chrom", F.col("chunk").alias("__chunk"), F.col("letters").alias("__letters")), ["chrom", "__chunk"], "left")
    base = F.col("__chunk") * chunk_size
    lo = F.greatest(F.col("start") - base, F.lit(0)).cast("int")
    hi = F.least(F.col("end") - base, F.lit(chunk_size)).cast("int")
    piece = F.coalesce(F.substring(F.col("__letters"), lo + 1, hi - lo), F.lit(""))
    parts = met.groupBy(*columns).agg(F.max("__n").alias("__n"), F.array_sort(F.collect_list(F.struct(F.col("__chunk"), piece.alias("p")))).alias("__parts"))
    whole = parts.withColumn(out, F.array_join(F.transform("__parts", lambda p: p["p"]), ""))
    return whole.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*columns, out)
