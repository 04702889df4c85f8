"""Encodings for export: bfloat16 bit patterns and a registry of sequence encoders."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.sequence import one_hot

ENCODERS: dict[str, Callable[[Column], Column]] = {"onehot": one_hot}


def bfloat16_of(values: np.ndarray) -> np.ndarray:
    """Upper halves of 32-bit floats, rounded to the nearest even; NaN becomes 0x7FC0."""
    bits = np.asarray(values, np.float32).view(np.uint32).astype(np.uint64)
    out = ((bits + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(values), np.uint16(0x7FC0), out)


def bfloat16_bits(values: Column) -> Column:
    """Array column of floats to bfloat16 bits, as Spark has no such type; null stays null, null cells are NaN."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def bits(column: pa.Array) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))])
        cells = bfloat16_of(column.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cells), mask=column.is_null())

    return bits(values)


def check_bfloat16_default(default: float) -> None:
    """Only 0 and NaN serve as defaults of a bfloat16 result."""
    if not (default == 0 or default != default):
        raise ValueError("with bfloat16 the default is 0 or NaN")


def register_encoder(name: str, encoder: Callable[[Column], Column], spark: SparkSession | None = None, sql_function: Callable | None = None) -> None:
    """Make an encoder, a function of a string column, known by name; with ``spark`` its UDF also to SQL."""
    ENCODERS[name] = encoder
    if spark is not None and sql_function is not None:
        spark.udf.register(name, sql_function)


def encoded(df: DataFrame, encoder: str | Callable[[Column], Column] | None = "onehot", sequence: str = "sequence") -> DataFrame:
    """The sequence column encoded by name or function; None leaves it as text."""
    if encoder is None:
        return df
    if isinstance(encoder, str):
        if encoder not in ENCODERS:
            raise ValueError(f"no encoder is called {encoder!r}")
        encoder = ENCODERS[encoder]
    return df.withColumn(sequence, encoder(F.col(sequence)))
