"""Scores of vertices and the order they give.

A vertex scores the sum of exp(-factor * position) over its neighbours, positions counted from the start of its
segment. Vertices of a segment are then sorted by score, highest first; equal ones keep their order.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ranked
from ..functions.scores import decayed, log_weight

if TYPE_CHECKING:
    from ..graph import Graph


def checked_factor(factor: float) -> float:
    if not math.isfinite(factor):
        raise ValueError("factor must be finite")
    return float(factor)


def weights(vertices: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """vertices (vid, seg, p) with weight; edges: src, dst, those within segments only are counted."""
    s, d = (vertices.select(F.col("vid").alias(f"{x}v"), F.col("seg").alias(f"{x}g"), F.col("p").alias(f"{x}p")) for x in "sd")
    inside = edges.join(s, F.col("src") == F.col("sv")).join(d, F.col("dst") == F.col("dv")).where("sg = dg")
    halves = F.array(F.struct(F.col("src").alias("v"), F.col("dp").alias("q")), F.struct(F.col("dst").alias("v"), F.col("sp").alias("q")))
    sums = inside.select(F.explode(halves).alias("x")).groupBy(F.col("x.v").alias("v")).agg(F.sum(decayed(F.col("x.q"), factor)).alias("w"))
    return vertices.join(sums, F.col("vid") == F.col("v"), "left").select("vid", "seg", "p", F.coalesce("w", F.lit(0.0)).alias("weight"))


def step(vertices: DataFrame, edges: DataFrame, factor: float) -> DataFrame:
    """vid, seg, p (the new one), weight, lw."""
    scored = weights(vertices, edges, factor).withColumn("lw", log_weight(F.col("weight"))).withColumnRenamed("p", "was")
    return ranked(scored, [F.col("lw").desc_nulls_last(), F.col("was")], "p", "seg").select("vid", "seg", "p", "weight", "lw")


def step_range(graph: Graph, factor: float, lo: int, hi: int) -> tuple[Graph, DataFrame]:
    factor = checked_factor(factor)
    if not 0 <= lo <= hi <= graph.num_vertices():
        raise ValueError("the range must lie within the positions")
    inside = F.col("pos").between(lo, hi - 1)
    moved = step(graph.vertices.where(inside).select("vid", F.lit(lo).cast("long").alias("seg"), (F.col("pos") - lo).alias("p")), graph.edges, factor)
    moved = moved.select("vid", (F.col("p") + F.col("seg")).alias("pos"), "weight")
    rest = graph.vertices.where(~inside).select("vid", "pos")
    return graph.with_positions(moved.select("vid", "pos").unionByName(rest)), moved.select("pos", "weight")
