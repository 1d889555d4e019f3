"""Attaching leftover vertices to the clusters that they share most edges with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affinity_counts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """vid, cluster, n: edges between vertices without and with a cluster. members: vid, cluster (null: none)."""
    s, d = (members.select(F.col("vid").alias(f"{x}v"), F.col("cluster").alias(f"{x}c")) for x in "sd")
    both = edges.join(s, F.col("src") == F.col("sv")).join(d, F.col("dst") == F.col("dv")).where("(sc IS NULL) <> (dc IS NULL)")
    return both.groupBy(F.when(F.col("sc").isNull(), F.col("src")).otherwise(F.col("dst")).alias("vid"), F.coalesce("sc", "dc").alias("cluster")).agg(F.count("*").alias("n"))


def best_cluster(counts: DataFrame) -> DataFrame:
    """vid, cluster: the one with most edges, the lowest among equals."""
    return counts.groupBy("vid").agg(F.max_by("cluster", F.struct("n", -F.col("cluster"))).alias("cluster"))


def affinity_round(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members after one round, in which all vertices choose at once."""
    chosen = best_cluster(affinity_counts(members, edges)).select(F.col("vid").alias("v"), F.col("cluster").alias("c"))
    return members.join(chosen, F.col("vid") == F.col("v"), "left").withColumn("cluster", F.coalesce("cluster", "c")).drop("v", "c")
