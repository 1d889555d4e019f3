"""Edges from a growing folder of entity dumps: each file is read once, its edges are appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..sources.entities import parsed, raw_edges


def edge_stream(spark: SparkSession, folder: str, relationship: str) -> DataFrame:
    """A stream of src, dst, k (the place among an entity's targets)."""
    text = spark.readStream.text(folder, lineSep="\n").select(F.lit(None).cast("long").alias("serial"), "value")
    return raw_edges(parsed(text, relationship)).select("src", "dst", "k")


def append_edges(stream: DataFrame, table: str, state: str) -> StreamingQuery:
    """Appends what there is to the Parquet folder `table` and ends; `state` is the stream's checkpoint, and makes each file count once."""
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", state).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, table: str) -> Graph:
    """The graph of the edges so far, numbered in order of their keys, since files come in no order."""
    return Graph.from_edges(spark.read.parquet(table), "src", "dst", ["src", "k", "dst"])
