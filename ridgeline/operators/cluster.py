"""Communities: sort, cut, recurse, attach.

All segments of one level are worked on together. Segments with few enough edges go to a task each, which finishes
all their levels in numpy; the others take a level of DataFrame steps and are looked at again. Edges between segments
never count again, so each level carries only those within.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ranked
from ..plans.staging import importable, staged
from .affinity import affinity_round
from .local import BORDER, STRONG, WEAK, attached, segmented
from .scoring import checked_factor, step
from .segments import demoted, first_strong, kinds, runs

if TYPE_CHECKING:
    from ..graph import Graph

#: Edges, and vertices, of a segment that one task may take in numpy.
TASK_EDGES = 12_000_000
TASK_VERTICES = 4_000_000

PLACED = "vid long, pos long, start long, end long, kind long"


def _task(factor: float, steps: int, threshold: float, min_size: int):
    """Rows of one segment, vertices (x = vid, y = place) and edges (x = -1 - place, y = place), to PLACED."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        del table
        edge = x < 0
        vids = np.empty(x.size - np.count_nonzero(edge), np.int64)
        vids[y[~edge]] = x[~edge]
        src, dst = -1 - x[edge], y[edge]
        del x, y, edge
        start = key[0].as_py()
        final, found = segmented(src, dst, vids.size, factor, steps, threshold, min_size)
        size = [e - s for s, e, _ in found]
        of = np.repeat(np.array(found, np.int64).reshape(-1, 3), size, axis=0)
        return pa.table({"vid": vids[final], "pos": start + np.arange(vids.size), "start": start + of[:, 0], "end": start + of[:, 1], "kind": of[:, 2]})

    return run


def _level(vertices: DataFrame, edges: DataFrame, factor: float, steps: int, threshold: float, min_size: int) -> tuple[DataFrame, DataFrame]:
    """One level of large segments (vid, seg, p): what is placed (PLACED), and the segments to go on with (vid, seg, p)."""
    done, now = [], vertices
    for _ in range(steps):
        now = staged(step(now.select("vid", "seg", "p"), edges, factor), "step")
        few = now.groupBy("seg").agg(F.count("lw").alias("c"), F.count("*").alias("n")).select(F.col("seg").alias("g"), "c", "n")
        sized = staged(now.join(few, F.col("seg") == F.col("g")).drop("g"), "sized")
        done.append(sized.where(F.col("c") <= min_size).select("vid", (F.col("seg") + F.col("p")).alias("pos"), F.col("seg").alias("start"), (F.col("seg") + F.col("n")).alias("end"), F.lit(WEAK).cast("long").alias("kind")))
        now = sized.where(F.col("c") > min_size)
    pieces = staged(demoted(runs(kinds(now, threshold)), min_size), "pieces")
    first = first_strong(pieces).select(F.col("seg").alias("g"), "k", F.col("start").alias("fs"), F.col("end").alias("fe"))
    rows = now.join(first, F.col("seg") == F.col("g"))
    ends = (F.col("c") == F.col("n")) & (F.col("k") <= 1)
    handled = F.when(ends, F.col("n")).when(F.col("k") == 0, F.col("c")).otherwise(F.col("fe"))
    p = F.col("p")
    in_first = (F.col("k") > 0) & (p >= F.col("fs")) & (p < F.col("fe"))
    low = F.when(p >= handled, handled).when(in_first, F.col("fs")).when((F.col("k") > 0) & (p >= F.col("fe")), F.col("fe")).otherwise(F.lit(0))
    high = F.when(p >= handled, F.col("n")).when(in_first, F.col("fe")).when((F.col("k") > 0) & (p < F.col("fs")), F.col("fs")).otherwise(handled)
    kind = F.when(in_first, STRONG).otherwise(BORDER).cast("long")
    again = (p >= handled) | (in_first & (F.col("k") > 1))
    rows = rows.select("vid", "seg", "p", low.cast("long").alias("low"), high.cast("long").alias("high"), kind.alias("kind"), again.alias("again"))
    rows = staged(rows, "cut")
    done.append(rows.where("NOT again").select("vid", (F.col("seg") + p).alias("pos"), (F.col("seg") + F.col("low")).alias("start"), (F.col("seg") + F.col("high")).alias("end"), "kind"))
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    return placed, rows.where("again").select("vid", (F.col("seg") + F.col("low")).alias("seg"), (p - F.col("low")).alias("p"))


def segments(vertices: DataFrame, edges: DataFrame, factor: float, steps: int, threshold: float, min_size: int, task_edges: int = TASK_EDGES, task_vertices: int = TASK_VERTICES) -> DataFrame:
    """PLACED for connected vertices (vid, p from 0): final positions, and the segment and its kind for each."""
    active, inner, out = vertices.select("vid", F.lit(0).cast("long").alias("seg"), "p"), edges.select("src", "dst"), []
    while True:
        s, d = (active.select(F.col("vid").alias(f"{x}v"), F.col("seg").alias(f"{x}g"), F.col("p").alias(f"{x}p")) for x in "sd")
        inner = staged(inner.join(s, F.col("src") == F.col("sv")).join(d, F.col("dst") == F.col("dv")).where("sg = dg").select("src", "dst", F.col("sg").alias("seg"), "sp", "dp"), "inner")
        weight = active.groupBy("seg").agg(F.count("*").alias("n")).join(inner.groupBy("seg").agg(F.count("*").alias("m")), "seg", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        small = (F.col("m") <= task_edges) & (F.col("n") <= task_vertices)
        weight = staged(weight.select(F.col("seg").alias("g"), small.alias("small"), (F.col("n") <= min_size).alias("tiny")), "weights")
        sized = staged(active.join(weight, F.col("seg") == F.col("g")).drop("g"), "active")
        lone = sized.where("small")
        rows = lone.select("seg", F.col("vid").alias("x"), F.col("p").cast("int").alias("y"))
        own = inner.join(weight.where("small").select("g"), F.col("seg") == F.col("g"), "left_semi")
        rows = rows.unionByName(own.select("seg", (-1 - F.col("sp")).alias("x"), F.col("dp").cast("int").alias("y")))
        # Each level is computed and written as it comes, so the plan does not grow with the levels.
        out.append(staged(rows.groupBy("seg").applyInArrow(_task(factor, steps, threshold, min_size), PLACED), "lone"))
        large = sized.where("NOT small").select("vid", "seg", "p")
        if large.limit(1).count() == 0:
            break
        inner = inner.join(weight.where("NOT small").select("g"), F.col("seg") == F.col("g"), "left_semi").select("src", "dst")
        placed, active = _level(large, inner, factor, steps, threshold, min_size)
        out.append(staged(placed, "placed"))
        if active.limit(1).count() == 0:
            break
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _attach_task(key: tuple, table: pa.Table) -> pa.Table:
    """Rows of one task, vertices (a = vid, b = pos, c = cluster or null) and edges (a, b = vids), to vid, cluster."""
    edge = table["edge"].to_numpy()
    vids, pos = (table[c].to_numpy()[~edge] for c in "ab")
    order = np.argsort(pos)
    vids, cluster = vids[order], table["c"].fill_null(-1).to_numpy()[~edge][order]
    by_vid = np.argsort(vids).astype(np.int32)
    local = [by_vid[np.searchsorted(vids, table[c].to_numpy()[edge], sorter=by_vid)] for c in "ab"]
    return pa.table({"vid": vids, "cluster": attached(cluster, *local, int(cluster.max(initial=-1)) + 1)})


def attach(members: DataFrame, edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """vid, pos, cluster with no nulls left. members: vid, pos, cluster.

    Rounds run as DataFrame steps while the edges at vertices without a cluster are too many for one task.
    """
    while True:
        members = staged(members, "members")
        free = members.where("cluster IS NULL").select("vid")
        left = free.count()
        if not left:
            return members
        s, d = (free.select(F.col("vid").alias(x)) for x in ("sv", "dv"))
        near = edges.join(s, F.col("src") == F.col("sv"), "left").join(d, F.col("dst") == F.col("dv"), "left").where("sv IS NOT NULL OR dv IS NOT NULL").select("src", "dst")
        near = staged(near, "near")
        if near.count() + left <= task_edges:
            ends = near.select(F.explode(F.array("src", "dst")).alias("v")).union(free).distinct()
            top = members.agg(F.max_by(F.struct("vid", "pos", "cluster"), F.col("cluster")).alias("x")).where("x.cluster IS NOT NULL").select(F.col("x.vid").alias("v"))
            needed = members.join(ends.union(top).distinct(), F.col("vid") == F.col("v"), "left_semi")
            rows = needed.select(F.lit(0).alias("task"), F.lit(False).alias("edge"), F.col("vid").alias("a"), F.col("pos").alias("b"), F.col("cluster").alias("c"))
            rows = rows.unionByName(near.select(F.lit(0).alias("task"), F.lit(True).alias("edge"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("long").alias("c")))
            found = rows.groupBy("task").applyInArrow(_attach_task, "vid long, cluster long").select(F.col("vid").alias("v"), F.col("cluster").alias("k"))
            return staged(members.join(found, F.col("vid") == F.col("v"), "left").select("vid", "pos", F.coalesce("cluster", "k").alias("cluster")), "members")
        after = staged(affinity_round(members, near), "round")
        if after.where("cluster IS NULL").count() == left:
            founder, next_id = after.agg(F.min(F.when(F.col("cluster").isNull(), F.col("pos"))), F.coalesce(F.max("cluster") + 1, F.lit(0))).first()
            after = after.withColumn("cluster", F.when(F.col("pos") == founder, F.lit(next_id)).otherwise(F.col("cluster")))
        members = after


def clustered(graph: Graph, factor: float, steps: int, threshold: float, min_size: int, task_edges: int = TASK_EDGES, task_vertices: int = TASK_VERTICES) -> Graph:
    """graph with clusters: vertices without edges alone, first; then communities, in order of position."""
    importable(graph.vertices.sparkSession)
    factor = checked_factor(factor)
    n = graph.num_vertices()
    if n == 0:
        raise ValueError("the graph is empty")
    if min_size < 1:
        raise ValueError("min_size must be at least 1")
    if steps < 1:
        raise ValueError("steps must be at least 1")
    threshold = -threshold if threshold > 0 else threshold
    lone = staged(ranked(graph.isolated().select("vid", F.col("pos").alias("was")), [F.col("was")], "r"), "isolated")
    k = lone.count()
    m = n - k
    connected = graph.vertices.join(lone.select(F.col("vid").alias("v")), F.col("vid") == F.col("v"), "left_anti")
    connected = staged(ranked(connected.select("vid", F.col("pos").alias("was")), [F.col("was")], "p").select("vid", "p"), "connected")
    if m <= min_size:
        members = connected.select("vid", F.col("p").alias("pos"), F.lit(0).cast("long").alias("cluster"))
    else:
        placed = segments(connected, graph.edges, factor, steps, threshold, min_size, task_edges, task_vertices)
        strong = placed.where(F.col("kind") == STRONG).select("start").distinct()
        numbers = ranked(strong, [F.col("start")], "cluster").select(F.col("start").alias("s"), "cluster")
        members = placed.join(numbers, (F.col("start") == F.col("s")) & (F.col("kind") == STRONG), "left").select("vid", "pos", "cluster")
        members = attach(members, graph.edges, task_edges)
    final = ranked(members.withColumnRenamed("pos", "was"), [F.col("cluster"), F.col("was")], "pos")
    alone = lone.select("vid", (F.col("r") + m).alias("pos"), F.col("r").alias("cluster_id"))
    whole = staged(final.select("vid", "pos", (F.col("cluster") + k).alias("cluster_id")).unionByName(alone), "clusters")
    moved = graph.with_positions(whole)
    return type(graph)(moved.vertices, moved.edges, whole.select("cluster_id", "pos", "vid"))
