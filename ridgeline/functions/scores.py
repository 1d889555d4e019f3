"""Column expressions of the scoring and of profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimals of the binary logarithm of a weight that decide the order.
DIGITS = 9


def decayed(position: Column, factor: float) -> Column:
    return F.exp(F.lit(-float(factor)) * position)


def log_weight(weight: Column) -> Column:
    """Quantised binary logarithm, null for a weight of 0, so that the order does not hang on the order of summation.

    operators.local computes it with the same operations of doubles.
    """
    return F.when(weight > 0, F.rint(F.log2(weight) * 10.0**DIGITS) / 10.0**DIGITS)


def binned(position: Column, vertices: Column, most: int = 1000) -> Column:
    """Row or column of a position in a matrix of at most `most` bins."""
    bins = F.least(F.lit(most).cast("long"), vertices)
    return F.floor(position * bins / vertices).cast("long")
