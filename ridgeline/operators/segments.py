"""Cutting a sorted segment where its scores drop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kinds(scored: DataFrame, threshold: float) -> DataFrame:
    """seg, p, lw, d, strong of the connected positions (lw not null).

    d is the drop to the position before; the first position takes the second one's. A position is strong if d is
    above threshold. Neighbours are brought together by a shuffle on positions, not by a window over the segment.
    """
    at = scored.where(F.col("lw").isNotNull()).select("seg", "lw", F.explode(F.array(*[F.struct((F.col("p") + k).alias("p"), F.lit(k).alias("k")) for k in (-1, 0, 1)])).alias("x")).select("seg", "x.*", "lw")
    side = {name: F.max(F.when(F.col("k") == k, F.col("lw"))).alias(name) for name, k in (("after", -1), ("lw", 0), ("before", 1))}
    rows = at.groupBy("seg", "p").agg(*side.values()).where(F.col("lw").isNotNull())
    rows = rows.withColumn("d", F.coalesce(F.col("lw") - F.col("before"), F.col("after") - F.col("lw")))
    return rows.select("seg", "p", "lw", "d", F.coalesce(F.col("d") > threshold, F.lit(False)).alias("strong"))


def runs(marked: DataFrame) -> DataFrame:
    """seg, start, end, strong of the maximal runs of equal marks; marked: seg, p, strong."""
    both = marked.select("seg", F.explode(F.array(F.struct("p", "strong", F.lit(True).alias("own")), F.struct((F.col("p") + 1).alias("p"), "strong", F.lit(False).alias("own")))).alias("x")).select("seg", "x.*")
    rows = both.groupBy("seg", "p").agg(F.max(F.when(F.col("own"), F.col("strong"))).alias("strong"), F.max(F.when(~F.col("own"), F.col("strong"))).alias("before"))
    # A start of a run, or (strong null) the end of the last one.
    edges = rows.where(F.col("strong").isNull() | F.col("before").isNull() | (F.col("strong") != F.col("before")))
    along = Window.partitionBy("seg").orderBy("p")
    return edges.withColumn("end", F.lead("p").over(along)).where(F.col("strong").isNotNull()).select("seg", F.col("p").alias("start"), "end", "strong")


def demoted(found: DataFrame, min_size: int) -> DataFrame:
    """The runs after strong ones shorter than min_size have become border runs and neighbours are put together."""
    along = Window.partitionBy("seg").orderBy("start")
    found = found.withColumn("strong", F.col("strong") & (F.col("end") - F.col("start") >= min_size))
    change = F.when(F.col("strong") != F.coalesce(F.lag("strong").over(along), ~F.col("strong")), 1).otherwise(0)
    found = found.withColumn("change", change).withColumn("island", F.sum("change").over(along))
    return found.groupBy("seg", "island", "strong").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("seg", "start", "end", "strong")


def first_strong(found: DataFrame) -> DataFrame:
    """seg, k (strong runs), start and end of the first one."""
    strong = F.when(F.col("strong"), F.struct("start", "end"))
    return found.groupBy("seg").agg(F.count_if("strong").alias("k"), F.min(strong).alias("x")).select("seg", "k", "x.start", "x.end")
