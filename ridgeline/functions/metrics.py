"""Agreement of two clusterings, and profiles of sorted weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def adjusted_rand_index(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row with ari: 1 for clusterings equal but for names, about 0 for unrelated ones (Hubert and Arabie 1985)."""
    cells = df.groupBy(F.col(left).alias("a"), F.col(right).alias("b")).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").alias("total"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    # Three tables of one row each.
    one = both.withColumn("k", F.lit(1)).join(rows.withColumn("k", F.lit(1)), "k").join(columns.withColumn("k", F.lit(1)), "k")
    expected = F.when(F.col("total") > 1, F.col("i") * F.col("j") / pairs(F.col("total"))).otherwise(0.0)
    spread = (F.col("i") + F.col("j")) / 2 - expected
    return one.select(F.when(spread == 0, 1.0).otherwise((F.col("ij") - expected) / F.when(spread != 0, spread)).alias("ari"))


def differences(df: DataFrame, value: str, order: str, group: str) -> DataFrame:
    """group, order, value, and d1 and d2, its first and second differences along order, which numbers the rows of a group from 0.

    Neighbours meet by a shuffle on their numbers, however large a group is.
    """
    shifted = df.select(group, F.explode(F.array(*[F.struct((F.col(order) + k).alias(order), F.lit(k).alias("k"), F.col(value).alias("x")) for k in range(3)])).alias("s")).select(group, "s.*")
    own, before, earlier = (F.max(F.when(F.col("k") == k, F.col("x"))) for k in range(3))
    rows = shifted.groupBy(group, order).agg(own.alias(value), (own - before).alias("d1"), (own - before - (before - earlier)).alias("d2"), F.count_if(F.col("k") == 0).alias("n"))
    return rows.where("n > 0").drop("n")
