"""Ranks of very many rows without gathering them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

_LOW = (1 << 33) - 1


def ranked(df: DataFrame, order: Sequence[Column], name: str, group: str | None = None) -> DataFrame:
    """df with a LONG column `name`: 0, 1, ... in the given order, in each group if there is one.

    Rows are dealt to partitions by range and sorted there; a row's rank is its place in its partition plus what
    earlier partitions hold of its group. Only those counts, one for each partition and group in it, are joined.
    """
    keys = [F.col(group), *order] if group else list(order)
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    serial = F.monotonically_increasing_id()
    spread = staged(spread.withColumn("__serial", serial), "ranked")
    part, place = F.shiftright("__serial", 33), F.col("__serial").bitwiseAND(_LOW)
    of = [F.col(group).alias("__g")] if group else [F.lit(0).alias("__g")]
    counts = spread.groupBy(part.alias("__part"), *of).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    earlier = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).select("__part", "__g", "__base")
    own = F.col(group) if group else F.lit(0)
    joined = spread.join(counts, (part == F.col("__part")) & own.eqNullSafe(F.col("__g")))
    return joined.withColumn(name, (place + F.col("__base")).cast("long")).drop("__serial", "__part", "__g", "__base")


def hashed_order(seed: int, key: Column) -> Column:
    """A reproducible shuffle: the same for any partitioning, and in any SQL dialect that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
