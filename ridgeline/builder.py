"""Synthetic graphs with known communities. The seed decides everything, whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ranking import hashed_order, ranked
from .graph import Graph
from .plans.staging import importable, staged


def scale_free_edges(n: int, m: int, seed: int) -> np.ndarray:
    """Edges of one growing cluster: m nodes to begin with, then m edges from each new node, to different nodes by degree.

    A node is drawn by degree as the end of an edge drawn evenly; ends that lead to a node again are left out. So a new
    node takes time in proportion to m, but for the first ones, which weigh all nodes.
    """
    r = np.random.default_rng(seed)
    degree = np.zeros(n)
    edges: list[tuple[int, int]] = []
    if m > 1:
        for v in r.permutation(m).tolist():
            if degree[v] == 0:
                other = int(r.integers(m - 1))
                other += other >= v
                edges.append((v, other))
                degree[v] += 1
                degree[other] += 1
    ends = np.empty(2 * len(edges) + 2 * m * max(n - m, 0), np.int64)
    ends[: 2 * len(edges)] = np.array(edges, np.int64).ravel()
    size, grown = 2 * len(edges), []
    for v in range(m, n):
        if v <= m:
            chosen = np.arange(v)
        elif v < 4 * m:
            # The m smallest of exponential times over weights are a draw without replacement.
            with np.errstate(divide="ignore"):
                times = r.exponential(size=v) / (degree[:v] if v > 1 else np.ones(1))
            chosen = np.argpartition(times, m - 1)[:m]
        else:
            drawn = ends[r.integers(size, size=2 * m)]
            while (first := np.unique(drawn, return_index=True)[1]).size < m:
                drawn = np.r_[drawn, ends[r.integers(size, size=2 * m)]]
            chosen = drawn[np.sort(first)[:m]]
        forward = r.random(chosen.size) < 0.5
        grown.append(np.stack([np.where(forward, v, chosen), np.where(forward, chosen, v)], axis=1))
        ends[size : size + 2 * chosen.size] = grown[-1].ravel()
        size += 2 * chosen.size
        degree[chosen] += 1
        degree[v] += chosen.size
    return np.concatenate([np.array(edges, np.int64).reshape(-1, 2), *grown])


def dense_pairs(spark: SparkSession, base: int, n: int, density: float, seed: int) -> DataFrame:
    """src, dst: each ordered pair of different nodes base..base+n-1, kept with probability density."""
    i, j = spark.range(n).withColumnRenamed("id", "i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    all_pairs = i.select("i", j.alias("j")).where("i <> j")
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string"), F.lit(":"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return all_pairs.where(chance < density).select((F.col("i") + base).alias("src"), (F.col("j") + base).alias("dst"))


def unused_pairs(left: DataFrame, right: DataFrame, used: DataFrame, k: int, seed: int) -> DataFrame:
    """a, b: k of the pairs of nodes of left and right (column v each) that used (a, b) does not hold; needs enough of them.

    Nodes are put in a shuffled order, and pairs drawn along a walk that visits every pair of the two orders once, so
    never are all pairs made: k more than are used already suffice.
    """
    n, m = left.count(), right.count()
    a = ranked(left.select(F.col("v").alias("a")), [hashed_order(seed, F.col("a")), F.col("a")], "x")
    b = ranked(right.select(F.col("v").alias("b")), [hashed_order(seed + 1, F.col("b")), F.col("b")], "y")
    need = min(n * m, k + used.count())
    walk = left.sparkSession.range(need).select(F.col("id").alias("t"))
    # Step t goes to row t mod n and column (t + t div lcm) mod m: each of the n * m pairs comes once.
    lcm = n * m // int(np.gcd(n, m))
    walk = walk.select("t", (F.col("t") % n).alias("x"), ((F.col("t") + F.floor(F.col("t") / lcm)) % m).alias("y"))
    drawn = walk.join(a, "x").join(b, "y").select("t", "a", "b").join(used.select(F.col("a").alias("ua"), F.col("b").alias("ub")), (F.col("a") == F.col("ua")) & (F.col("b") == F.col("ub")), "left_anti")
    return drawn.orderBy("t").limit(k).select("a", "b")


class GraphBuilder:
    def __init__(self, spark: SparkSession, seed: int):
        if seed < 0:
            raise ValueError("Error: seed must not be negative")
        self.spark, self.seed = spark, seed
        self._sizes: list[int] = []
        self._bases: list[int] = []
        self._parts: list[DataFrame] = []
        self._links: dict[tuple[int, int], list[DataFrame]] = {}
        self._counts: dict[tuple[int, int], int] = {}
        self._draws = 0
        self._finalized = False

    def _check(self, fine: bool, what: str) -> None:
        if self._finalized:
            raise ValueError("Builder has been finalized and can't be used again")
        if not fine:
            raise ValueError(f"Error: {what}")

    def _new(self, n: int) -> tuple[int, int]:
        self._bases.append(self._bases[-1] + self._sizes[-1] if self._sizes else 0)
        self._sizes.append(n)
        return len(self._sizes) - 1, self._bases[-1]

    def add_scale_free_cluster(self, num_nodes: int, new_edges: int) -> int:
        return self.add_scale_free_clusters([(num_nodes, new_edges)])[0]

    def add_scale_free_clusters(self, shapes: list[tuple[int, int]]) -> list[int]:
        """Many clusters at once, grown side by side, a task for several of them. shapes: (num_nodes, new_edges)."""
        for n, m in shapes:
            self._check(n > 0, "num_nodes must be positive")
            self._check(m > 0, "new_edges must be positive")
            self._check(m <= n, "new_edges must not exceed num_nodes")
        new = [(*self._new(n), n, m) for n, m in shapes]
        table = self.spark.createDataFrame(new, "cluster long, base long, n long, m long").repartition(min(64, len(new)), "cluster")
        seed = self.seed
        importable(self.spark)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in pdf.itertuples():
                edges = scale_free_edges(row.n, row.m, hash((seed, int(row.cluster))) & (2**63 - 1)) + row.base
                out.append(pd.DataFrame({"part": row.cluster, "k": np.arange(len(edges)), "src": edges[:, 0], "dst": edges[:, 1]}))
            return pd.concat(out)

        self._parts.append(table.groupBy("cluster").applyInPandas(grow, "part long, k long, src long, dst long"))
        return [c for c, *_ in new]

    def add_dense_cluster(self, num_nodes: int, edge_density: float) -> int:
        self._check(num_nodes > 0, "num_nodes must be positive")
        self._check(0 <= edge_density <= 1, "edge_density must lie between 0 and 1")
        c, base = self._new(num_nodes)
        pairs = dense_pairs(self.spark, base, num_nodes, edge_density, self.seed + c)
        self._parts.append(pairs.select(F.lit(c).cast("long").alias("part"), (F.col("src") * (base + num_nodes) + F.col("dst")).alias("k"), "src", "dst"))
        return c

    def _nodes(self, c: int) -> DataFrame:
        return self.spark.range(self._bases[c], self._bases[c] + self._sizes[c]).withColumnRenamed("id", "v")

    def _used(self, c1: int, c2: int) -> DataFrame:
        out = self.spark.createDataFrame([], "a long, b long")
        for x in self._links.get((c1, c2), []):
            out = out.unionByName(x.select("a", "b"))
        return out

    def _add(self, c1: int, c2: int, pairs: DataFrame, k: int) -> None:
        self._links.setdefault((c1, c2), []).append(pairs)
        self._counts[c1, c2] = self._counts.get((c1, c2), 0) + k
        self._draws += 1
        self._parts.append(pairs.select(F.lit((1 << 40) + self._draws).cast("long").alias("part"), F.col("a").alias("k"), F.col("a").alias("src"), F.col("b").alias("dst")))

    def add_random_link(self, c1: int, c2: int) -> None:
        self.add_random_links(c1, c2, 1)

    def add_random_links(self, c1: int, c2: int, k: int) -> None:
        """k edges from nodes of c1 to nodes of c2, no pair twice."""
        self._check(c1 != c2, "a link needs two different clusters")
        self._check(0 <= c1 < len(self._sizes) and 0 <= c2 < len(self._sizes), "no such cluster")
        self._check(k >= 0 and self._counts.get((c1, c2), 0) + k <= self._sizes[c1] * self._sizes[c2], "all links are taken")
        seed = self.seed * 1_000_003 + self._draws
        self._add(c1, c2, staged(unused_pairs(self._nodes(c1), self._nodes(c2), self._used(c1, c2), k, seed), "links"), k)

    def add_link(self, c1: int, c2: int, n1: int, n2: int) -> None:
        """The edge from node n1 of c1 to node n2 of c2, numbered within their clusters."""
        self._check(c1 != c2, "a link needs two different clusters")
        self._check(0 <= c1 < len(self._sizes) and 0 <= c2 < len(self._sizes), "no such cluster")
        self._check(0 <= n1 < self._sizes[c1] and 0 <= n2 < self._sizes[c2], "no such node")
        a, b = self._bases[c1] + n1, self._bases[c2] + n2
        self._check(self._used(c1, c2).where((F.col("a") == a) & (F.col("b") == b)).limit(1).count() == 0, "the link is there already")
        self._add(c1, c2, self.spark.createDataFrame([(a, b)], "a long, b long"), 1)

    def add_ring_links(self, counts: list[int]) -> None:
        """counts[i] links from cluster i to the next one, the last one's to the first; all drawn at once."""
        n = len(self._sizes)
        self._check(len(counts) == n and n > 1, "a count is needed for each of several clusters")
        for i, k in enumerate(counts):
            self._check(0 <= k <= self._sizes[i] * self._sizes[(i + 1) % n] and (i, (i + 1) % n) not in self._counts, "no room for the links")
        rows = []
        for i, k in enumerate(counts):
            j = (i + 1) % n
            rows.append((i, k, self._bases[i], self._bases[j], self._sizes[i], self._sizes[j]))
            self._counts[i, j] = k
        seed, draw = self.seed, self._draws

        def links(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for x in pdf.itertuples():
                picked = np.random.default_rng([seed, draw, 7, int(x.i)]).choice(x.n1 * x.n2, size=x.links, replace=False)
                out.append(pd.DataFrame({"a": x.base1 + picked // x.n2, "b": x.base2 + picked % x.n2}))
            return pd.concat(out)

        importable(self.spark)
        table = self.spark.createDataFrame(rows, "i long, links long, base1 long, base2 long, n1 long, n2 long")
        pairs = staged(table.repartition(min(64, n), "i").groupBy("i").applyInPandas(links, "a long, b long"), "ring")
        self._draws += 1
        for i in range(n):
            low, high = self._bases[i], self._bases[i] + self._sizes[i]
            self._links.setdefault((i, (i + 1) % n), []).append(pairs.where((F.col("a") >= low) & (F.col("a") < high)))
        self._parts.append(pairs.select(F.lit((1 << 40) + self._draws).cast("long").alias("part"), (F.col("a") * sum(self._sizes) + F.col("b")).alias("k"), F.col("a").alias("src"), F.col("b").alias("dst")))

    def get_cluster(self, c: int) -> list[int] | None:
        """The nodes of a cluster; None if there is none, or after finalize_graph."""
        if self._finalized or not 0 <= c < len(self._sizes):
            return None
        return list(range(self._bases[c], self._bases[c] + self._sizes[c]))

    def membership(self) -> DataFrame:
        """key, cluster: what was planted."""
        table = self.spark.createDataFrame(list(zip(range(len(self._sizes)), self._bases, self._sizes)), "cluster long, base long, n long")
        return table.select(F.explode(F.sequence("base", F.col("base") + F.col("n") - 1)).alias("key"), "cluster").withColumn("key", F.col("key").cast("string"))

    def finalize_graph(self) -> Graph:
        """The graph, its keys the nodes' numbers; the builder is used up."""
        self._check(True, "")
        self._finalized = True
        total = sum(self._sizes)
        vertices = self.spark.range(total).select(F.col("id").alias("vid"), F.col("id").cast("string").alias("key"), F.lit(None).cast("string").alias("label"), F.col("id").alias("pos"))
        if not self._parts:
            return Graph(vertices, self.spark.createDataFrame([], "eid long, src long, dst long"))
        edges = self._parts[0]
        for x in self._parts[1:]:
            edges = edges.unionByName(x)
        edges = ranked(edges, [F.col("part"), F.col("k"), F.col("src"), F.col("dst")], "eid").select("eid", "src", "dst")
        return Graph(vertices, staged(edges, "edges"))
