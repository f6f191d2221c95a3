"""Column hygiene shared by the operators: required columns, typed nulls, clash-free names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Exactly the named columns, cast to the given types.

    Operators start from this projection, so extra input columns (whatever their names) never reach
    the plan; a missing required column raises ``ValueError``.
    """
    have = set(df.columns)
    missing = [c for c in columns if c not in have]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by the Spark reader (any path that Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: Column, divisor: int) -> Column:
    """``crc32(column as text) mod divisor``; NULL stays NULL."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def text_or_empty(column: pa.Array) -> pa.Array:
    """Arrow strings with null read as the empty text."""
    return pc.fill_null(column, pa.scalar("", column.type))


def byte_slices(column: pa.Array, limit: int) -> Iterable[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each (one row at least)."""
    offsets = string_offsets(column)
    start = 0
    rows = len(column)
    while start < rows:
        stop = start + 1
        while stop < rows and offsets[stop + 1] - offsets[start] <= limit:
            stop += 1
        yield start, stop
        start = stop


def string_offsets(column: pa.Array):
    """The rows' byte offsets (one more than rows) of an Arrow string or binary array."""
    import numpy as np

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset:column.offset + len(column) + 1].astype(np.int64)
