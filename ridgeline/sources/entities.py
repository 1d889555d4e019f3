"""Line-delimited JSON entity dumps: one relationship becomes the edges, English labels become labels."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def parsed(text: DataFrame, relationship: str) -> DataFrame:
    """serial, id, targets, label of the lines (serial, value) that are entities with the relationship.

    A line counts from its first { to its last }; lines that aren't JSON, whose id is not a string, or in which the
    relationship is not an array are left out, as are statements without a target id that is a string.
    """
    rows = text.withColumn("doc", F.try_parse_json(F.regexp_extract("value", r"(?s)\{.*\}", 0)))
    claim = relationship.replace("\\", "\\\\").replace('"', '\\"')

    def string(v: Column, path: str) -> Column:
        found = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(v, path, "string"))

    targets = F.try_variant_get("doc", f'$.claims["{claim}"]', "array<variant>")
    is_array = F.startswith(F.schema_of_variant(F.try_variant_get("doc", f'$.claims["{claim}"]', "variant")), F.lit("ARRAY"))
    rows = rows.select("serial", string(F.col("doc"), "$.id").alias("id"), F.when(is_array, targets).alias("targets"), string(F.col("doc"), "$.labels.en.value").alias("label"))
    rows = rows.where("id IS NOT NULL AND targets IS NOT NULL")
    ids = F.filter(F.transform("targets", lambda v: string(v, "$.mainsnak.datavalue.value.id")), lambda x: x.isNotNull())
    return rows.withColumn("targets", ids)


def raw_edges(rows: DataFrame) -> DataFrame:
    """serial, k, src, dst from parsed()."""
    return rows.select("serial", F.col("id").alias("src"), F.posexplode("targets").alias("k", "dst"))


def read_entities(spark: SparkSession, path: str, relationship: str) -> Graph:
    """Entities keep their ids as keys; a label is set where an entity that has the relationship has one."""
    if "://" not in path and not os.path.exists(path):
        raise OSError(f"Error: no such file: {path}")
    try:
        text = spark.read.text(path, lineSep="\n")
    except AnalysisException as e:
        raise OSError(f"Error: {e}") from e
    # Files by name, blocks of a file by where they begin, lines of a block as they are read, whatever task reads them.
    serial = F.struct("file", "block", F.monotonically_increasing_id().alias("line"))
    text = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).select("value", serial.alias("serial"))
    rows = parsed(text.select("serial", "value"), relationship)
    graph = Graph.from_edges(raw_edges(rows), "src", "dst", ["serial", "k"])
    return graph.with_labels(rows.where("label IS NOT NULL").select(F.col("id").alias("key"), "label"))
