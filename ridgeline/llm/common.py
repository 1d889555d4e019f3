"""What the operators of this package share: intermediate tables, row keys, sizes of joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import BROADCAST_ROWS, importable, staged

__all__ = ["BROADCAST_ROWS", "as_row", "back", "importable", "row_key", "slices", "small_or_not", "staged", "text_or_empty", "trim", "with_value"]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(text: Column, doc_id: str = "doc_id") -> Column:
    """Two longs that tell rows apart: the id (null: 0, told apart by the hash) and a hash of id and text. Repeated rows share a key."""
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("k1"), F.xxhash64(F.col(doc_id), text).alias("k2"))


def as_row(df: DataFrame) -> Column:
    """All columns of df in one named row, so that none clashes with what an operator adds beside it."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def back(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of df out of its row (see as_row()), those named in `new` replaced."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in df.columns]


def with_value(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for each row even where f uses it for each element of an array."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def small_or_not(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small enough, else as it is (Spark then shuffles). df should be staged."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """texts in order, in slices of about so many bytes: a worker's memory then hangs on this, not on the size of Spark's batches."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end
    trim()


def trim() -> None:
    """Gives memory that is free in this worker back to the system; Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
