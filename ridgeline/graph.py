"""Graphs as DataFrames.

vertices: vid, key, label, pos. edges: eid, src, dst, where src and dst are vids and eid keeps the order of insertion.
Parallel edges and self-loops stay. A vid never changes; pos, the place in the current order, does. A Graph is
immutable: each operation gives a new one, and one that moves vertices gives one without clusters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ranking import hashed_order, ranked
from .functions.scores import binned
from .plans.staging import staged

VERTICES = "vid long, key string, label string, pos long"
EDGES = "eid long, src long, dst long"
CLUSTERS = "cluster_id long, pos long, vid long"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    clusters: DataFrame | None = None

    # Building

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES))

    @staticmethod
    def from_edges(df: DataFrame, src: str, dst: str, order: str | list[str], more_keys: DataFrame | None = None) -> Graph:
        """Vertices are numbered as they first appear along `order` (ties: by the ends' keys), a source before its destination.

        more_keys: (key, at) of further vertices, `at` on the scale of twice the edge's number; without `at` they come last.
        """
        order = [order] if isinstance(order, str) else order
        named = df.select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(src).cast("string").alias("s"), F.col(dst).cast("string").alias("d"))
        named = staged(ranked(named, [*[F.col(f"__o{i}") for i in range(len(order))], F.col("s"), F.col("d")], "eid").select("eid", "s", "d"), "edges")
        seen = named.select(F.explode(F.array(F.struct(F.col("s").alias("key"), (2 * F.col("eid")).alias("at")), F.struct(F.col("d").alias("key"), (2 * F.col("eid") + 1).alias("at")))).alias("x")).select("x.*")
        if more_keys is not None:
            seen = seen.unionByName(more_keys.select(F.col("key").cast("string").alias("key"), F.col("at").cast("long") if "at" in more_keys.columns else F.lit((1 << 62)).alias("at")))
        first = seen.groupBy("key").agg(F.min("at").alias("at"))
        vertices = ranked(first, [F.col("at"), F.col("key")], "pos").select(F.col("pos").alias("vid"), "key", F.lit(None).cast("string").alias("label"), "pos")
        vertices = staged(vertices, "vertices")
        s, d = (vertices.select(F.col("key").alias(f"{x}k"), F.col("vid").alias(f"{x}v")) for x in "sd")
        edges = named.join(s, F.col("s") == F.col("sk")).join(d, F.col("d") == F.col("dk")).select("eid", F.col("sv").alias("src"), F.col("dv").alias("dst"))
        return Graph(vertices, staged(edges, "edges"))

    def with_vertices(self, keys: DataFrame) -> Graph:
        """Adds the keys (column key) that are not there yet, in order of key; the others keep their numbers."""
        known = self.vertices.select(F.col("key").alias("known"))
        new = keys.select(F.col("key").cast("string").alias("key")).distinct().join(known, F.col("key") == F.col("known"), "left_anti")
        n = self.num_vertices()
        new = ranked(new, [F.col("key")], "r").select((F.col("r") + n).alias("vid"), "key", F.lit(None).cast("string").alias("label"), (F.col("r") + n).alias("pos"))
        return Graph(self.vertices.unionByName(new), self.edges)

    def with_edges(self, pairs: DataFrame) -> Graph:
        """Adds edges (columns src and dst, keys) after the present ones, in order of keys, and the vertices they need."""
        grown = self.with_vertices(pairs.select(F.explode(F.array("src", "dst")).alias("key")))
        grown = replace(grown, vertices=staged(grown.vertices, "vertices"))
        s, d = (grown.vertices.select(F.col("key").alias(f"{x}k"), F.col("vid").alias(f"{x}v")) for x in "sd")
        new = pairs.join(s, F.col("src") == F.col("sk")).join(d, F.col("dst") == F.col("dk")).select(F.col("sv").alias("src"), F.col("dv").alias("dst"))
        base = self.edges.agg(F.coalesce(F.max("eid") + 1, F.lit(0))).first()[0]
        new = ranked(new, [F.col("src"), F.col("dst")], "r").select((F.col("r") + base).alias("eid"), "src", "dst")
        return Graph(grown.vertices, self.edges.unionByName(new))

    def with_labels(self, labels: DataFrame) -> Graph:
        """Sets labels (key, label); keys stay as they are, so equal labels do no harm."""
        labels = labels.groupBy(F.col("key").alias("k")).agg(F.min("label").alias("l"))
        joined = self.vertices.join(labels, F.col("key") == F.col("k"), "left")
        return replace(self, vertices=joined.select("vid", "key", F.coalesce("l", "label").alias("label"), "pos"))

    # Reading

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def get_vertex_id(self, key: str) -> int | None:
        found = self.vertices.where(F.col("key") == key).select("pos").first()
        return None if found is None else found.pos

    def positioned(self) -> DataFrame:
        """eid, src, dst as positions."""
        s, d = (self.vertices.select(F.col("vid").alias(f"{x}v"), F.col("pos").alias(f"{x}p")) for x in "sd")
        return self.edges.join(s, F.col("src") == F.col("sv")).join(d, F.col("dst") == F.col("dv")).select("eid", F.col("sp").alias("src"), F.col("dp").alias("dst"))

    def edge_list(self) -> DataFrame:
        """eid, src, dst as keys; order by eid for the order of insertion."""
        s, d = (self.vertices.select(F.col("vid").alias(f"{x}v"), F.col("key").alias(f"{x}k")) for x in "sd")
        return self.edges.join(s, F.col("src") == F.col("sv")).join(d, F.col("dst") == F.col("dv")).select("eid", F.col("sk").alias("src"), F.col("dk").alias("dst"))

    def collect_edge_list(self) -> list[tuple[str, str]]:
        return [(r.src, r.dst) for r in self.edge_list().orderBy("eid").toLocalIterator()]

    def degrees(self) -> DataFrame:
        """key, degree: ends of edges at each vertex, a self-loop counting twice."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("degree"))
        return self.vertices.join(ends, F.col("vid") == F.col("v"), "left").select("key", F.coalesce("degree", F.lit(0)).alias("degree"))

    def isolated(self) -> DataFrame:
        """The vertices without any edge."""
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("v"))
        return self.vertices.join(ends, F.col("vid") == F.col("v"), "left_anti")

    def adjacency_bins(self, most: int = 1000) -> DataFrame:
        """row, col, count of the matrix of directed edges, positions put in at most `most` bins; empty cells left out."""
        n = F.lit(self.num_vertices()).cast("long")
        edges = self.positioned().select(binned(F.col("src"), n, most).alias("row"), binned(F.col("dst"), n, most).alias("col"))
        return edges.groupBy("row", "col").agg(F.count("*").alias("count"))

    def as_matrix(self, most: int = 1000) -> list[list[int]]:
        """The same in full; at most `most` squared numbers."""
        size = min(most, self.num_vertices())
        out = [[0] * size for _ in range(size)]
        for r in self.adjacency_bins(most).toLocalIterator():
            out[r.row][r.col] = r["count"]
        return out

    def same_as(self, other: Graph) -> bool:
        """Whether keys have the same positions and the sets of edges are equal; labels and clusters don't matter."""

        def differ(a: DataFrame, b: DataFrame) -> bool:
            return bool(a.subtract(b).limit(1).count() or b.subtract(a).limit(1).count())

        if differ(self.vertices.select("key", "pos"), other.vertices.select("key", "pos")):
            return False
        return not differ(self.positioned().select("src", "dst"), other.positioned().select("src", "dst"))

    # Moving vertices

    def with_positions(self, pos: DataFrame) -> Graph:
        """Takes positions from (vid, pos)."""
        joined = self.vertices.drop("pos").join(pos.select("vid", "pos"), "vid").select("vid", "key", "label", "pos")
        return Graph(joined, self.edges)

    def shuffle(self, seed: int) -> Graph:
        """Positions in an order that seed alone decides."""
        if seed < 0:
            raise ValueError("seed must not be negative")
        return self.with_positions(ranked(self.vertices.select("vid", F.col("pos").alias("was")), [hashed_order(seed, F.col("was")), F.col("was")], "pos"))

    def remap(self, mapping: DataFrame) -> Graph:
        """Moves all vertices at once by (old, new); positions that are not named stay. The result must be a permutation."""
        joined = self.vertices.join(mapping.select("old", "new"), F.col("pos") == F.col("old"), "left")
        moved = joined.select("vid", "key", "label", F.coalesce("new", "pos").cast("long").alias("pos"))
        n, distinct, low, high = moved.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
        if n and (distinct != n or low != 0 or high != n - 1):
            raise ValueError("the mapping does not give a permutation of the positions")
        return Graph(moved, self.edges)

    def induced(self, vids: DataFrame) -> DataFrame:
        """The edges with both ends among vids (column vid)."""
        s, d = (vids.select(F.col("vid").alias(x)).distinct() for x in ("sv", "dv"))
        return self.edges.join(s, F.col("src") == F.col("sv"), "left_semi").join(d, F.col("dst") == F.col("dv"), "left_semi")

    def renumbered_keys(self, numeric: bool = False) -> Graph:
        """Keys become their ranks in order of key, as text; positions stay. numeric: keys that are whole numbers come first, by value."""
        order = [F.col("key").try_cast("decimal(38,0)").asc_nulls_last()] if numeric else []
        by_key = ranked(self.vertices, [*order, F.col("key")], "r")
        return Graph(by_key.select("vid", F.col("r").cast("string").alias("key"), F.lit(None).cast("string").alias("label"), "pos"), self.edges)

    # Clustering

    def cluster_step(self, factor: float, lo: int, hi: int) -> tuple[Graph, DataFrame]:
        """One scoring and sorting of positions lo to hi; also (pos, weight) of that range, in its new order."""
        from .operators.scoring import step_range

        return step_range(self, factor, lo, hi)

    def cluster(self, factor: float, steps: int, threshold: float, min_size: int, **limits: int) -> Graph:
        """Finds communities; see operators.cluster."""
        from .operators.cluster import clustered

        return clustered(self, factor, steps, threshold, min_size, **limits)

    def get_clusters(self) -> DataFrame:
        """cluster_id, pos, vid, key; no rows before clustering."""
        if self.clusters is None:
            return self.vertices.limit(0).select(F.col("vid").alias("cluster_id"), "pos", "vid", "key")
        return self.clusters.join(self.vertices.select("vid", "key"), "vid").select("cluster_id", "pos", "vid", "key")

    def cluster_lists(self) -> DataFrame:
        """cluster_id, members: keys in order of position."""
        members = F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"])
        return self.get_clusters().groupBy("cluster_id").agg(members.alias("members"))

    def collect_clusters(self) -> list[list[str]]:
        return [r.members for r in self.cluster_lists().orderBy("cluster_id").toLocalIterator()]
