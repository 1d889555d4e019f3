"""Graphs over the tables at hand. Each gives src, dst and the columns that order them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from .staging import importable

NEIGHBOURS = 10
#: Rows of a block of vectors and of a wide one; a block and a wide one meet in a task.
BLOCK, WIDE = 4096, 16384
#: Rows of a block that are multiplied at a time, and pairs whose similarity is taken at a time.
PIECE, PAIRS = 128, 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to supplier, an edge for each line of an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(trade(spark, sf_dir), "src", "dst", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part to supplier, once for each pair that was ever ordered."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one order, the smaller key first, and the number of orders that hold both. An order has a handful of lines."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a")).distinct()
    other = parts.select(F.col("l_orderkey").alias("o"), F.col("a").alias("b"))
    return parts.join(other, (F.col("l_orderkey") == F.col("o")) & (F.col("a") < F.col("b"))).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("orders"))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers to nations, nations to regions."""

    def edges(name: str, a: str, b: str, ka: str, kb: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"))

    return edges("customer", "c", "n", "c_custkey", "c_nationkey").unionByName(edges("supplier", "s", "n", "s_suppkey", "s_nationkey")).unionByName(edges("nation", "n", "r", "n_nationkey", "n_regionkey"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event type to the next one of the same user, with the number of times."""
    along = Window.partitionBy("user_id").orderBy("ts", "event_id")
    following = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("src")).withColumn("dst", F.lead("src").over(along))
    return following.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("times"))


def hyperlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page to what it links to."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))


def _best(ids: np.ndarray, a: np.ndarray, names: np.ndarray, b: np.ndarray, k: int) -> pa.Table:
    """src, dst, similarity: the k nearest of unit vectors b (names) to each of a (ids), but for those of the same name; ties by name.

    All pairs are multiplied in single precision. Columns are put in groups, and the k-th highest of the groups' maxima is, but
    for rounding, no more than the k-th highest of all; what reaches it is multiplied in double precision, the same in any block.
    """
    slack = np.float32((a.shape[1] + 4) * 2.0**-22)  # over twice what rounding can make of a product of unit vectors
    x, y, m = a.astype(np.float32), b.astype(np.float32).T, len(b)
    deep = max(1, m // (16 * k))
    by_name = np.argsort(names, kind="stable")
    first, last = (np.searchsorted(names, ids, side, sorter=by_name) for side in ("left", "right"))
    out = []
    for at in range(0, len(a), PIECE):
        near = x[at : at + PIECE] @ y
        many = (last - first)[at : at + PIECE]
        near[np.repeat(np.arange(len(near)), many), by_name[np.repeat(last[at : at + PIECE] - np.cumsum(many), many) + np.arange(many.sum())]] = -np.inf
        wanted = near > -np.inf
        if m > k:
            tops = near[:, : m // deep * deep].reshape(len(near), deep, m // deep).max(axis=1)
            wanted &= near >= np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k, None] - slack
        row, column = np.divmod(np.flatnonzero(wanted), m)
        exact = np.concatenate([(a[at + row[i : i + PAIRS]] * b[column[i : i + PAIRS]]).sum(axis=1) for i in range(0, max(1, row.size), PAIRS)])
        order = np.lexsort((names[column], -exact, row))
        row, column, exact = row[order], column[order], exact[order]
        keep = np.arange(row.size) - np.searchsorted(row, row) < k
        out.append((ids[at + row[keep]], names[column[keep]], exact[keep]))
    src, dst, exact = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "similarity": exact})


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """src, dst, rank, similarity: the k nearest by cosine of each row (vec_id, embedding), all rows against all, in blocks.

    A block meets a wide one in a task, which keeps the k best for each of its rows; those of all wide blocks are then ranked.
    """
    importable(vectors.sparkSession)
    count = vectors.count()
    blocks, wides = (max(1, -(-count // rows)) for rows in (block, wide))
    kind = dict(vectors.dtypes)["embedding"]
    x = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    own = vectors.select("vec_id", x.alias("x"))

    def numbered(n: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))

    left = own.select(numbered(blocks).alias("i"), every(wides).alias("j"), F.lit(True).alias("query"), "vec_id", "x")
    right = own.select(numbered(wides).alias("j"), every(blocks).alias("i"), F.lit(False).alias("query"), "vec_id", "x").select(*left.columns)

    def best(rows: pa.Table) -> pa.Table:
        query = rows["query"].to_numpy()
        ids = rows["vec_id"].to_numpy()
        x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        sound = np.isfinite(x).all(axis=1)
        a, b = query & sound, ~query & sound
        if not a.any() or not b.any():
            return pa.table({"src": np.empty(0, np.int64), "dst": np.empty(0, np.int64), "similarity": np.empty(0)})
        return _best(ids[a], x[a], ids[b], x[b], k)

    some = left.unionByName(right).groupBy("i", "j").applyInArrow(best, "src long, dst long, similarity double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return some.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("src", "dst", "rank", "similarity")


def knn_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(nearest(table(spark, sf_dir, "embeddings")), "src", "dst", ["src", "rank"])
