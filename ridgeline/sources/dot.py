"""DOT text: reading and writing.

Two dialects. "reference" is the line-based one with bare names: the first line is skipped, reading stops at a line
that is only `}`, a line `name -- name` or `name -> name` is an edge, any other line's first name is a vertex, and
attributes are ignored. "quoted" also takes names in double quotes (with \\" and \\\\ inside), several statements on a
line, arrows without spaces, and attributes and semicolons after an edge.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import ranked
from ..graph import Graph

SPACE = r"(?U)\s"
NAME = r'(?:"(?:[^"\\]|\\.)*+"|[^\s\[\];"{}=,>-]++(?:-(?!>|-)[^\s\[\];"{}=,>-]++)*+)'
EDGE = {"reference": r"^(?U)\s*([^\s\[]+)\s+(?:--|->)\s+([^\s\[]+)\s*$", "quoted": rf"^\s*({NAME})\s*(?:--|->)\s*({NAME})\s*(?:\[.*\])?\s*$"}
NODE = {"reference": r"^(?U)\s*([^\s\[]+).*$", "quoted": rf"^\s*({NAME})\s*(?:\[.*\])?\s*$"}
LABEL = r'\[.*?\blabel\s*=\s*"((?:[^"\\]|\\.)*+)"'


def lines(spark: SparkSession, path: str) -> DataFrame:
    """at, line: the lines of a file in order. Spark splits large files, so order comes from where a split begins, and the order within."""
    if not os.path.exists(path.removeprefix("file://")) and "://" not in path:
        raise OSError(f"Error: no such file: {path}")
    try:
        text = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_block_start")
    except AnalysisException as e:
        raise OSError(f"Error: {e}") from e
    return ranked(text.withColumn("serial", F.monotonically_increasing_id()), [F.col("file_block_start"), F.col("serial")], "at").select("at", F.regexp_replace("value", r"\r$", "").alias("line"))


def statements(numbered: DataFrame, dialect: str = "reference") -> DataFrame:
    """at, src, dst (null for a vertex) and label of the statements among numbered lines (at, line).

    at is the number of the line; in the quoted dialect, of the statement among all.
    """
    if dialect not in EDGE:
        raise ValueError(f"unknown dialect: {dialect}")
    body = numbered.where("at > 0").withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    stop = body.where(F.col("line") == "}").agg(F.coalesce(F.min("at"), F.lit(1 << 62)).alias("stop"))
    body = body.join(F.broadcast(stop), F.col("at") < F.col("stop")).where("line <> ''").drop("stop")
    if dialect == "quoted":
        body = body.where(~F.col("line").rlike(r"^(?://|#|/\*)"))
        pieces = F.regexp_extract_all("line", F.lit(r'(?:"(?:[^"\\]|\\.)*+"|\[[^\]]*+\]|[^;"\[])++'), F.lit(0))
        body = body.select(F.col("at").alias("row"), F.posexplode(pieces).alias("k", "line")).where(F.trim("line") != "")
        body = ranked(body, [F.col("row"), F.col("k")], "at").select("at", "line")
    src, dst = F.regexp_extract("line", EDGE[dialect], 1), F.regexp_extract("line", EDGE[dialect], 2)
    node = F.regexp_extract("line", NODE[dialect], 1)
    found = body.select("at", "line", F.when(dst != "", src).when(node != "", node).alias("src"), F.when(dst != "", dst).alias("dst"), F.nullif(F.regexp_extract("line", LABEL, 1), F.lit("")).alias("label"))
    bad = F.raise_error(F.concat(F.lit("ValueError: unrecognized pattern in line "), F.col("at").cast("string")))
    if dialect == "reference":
        found = found.withColumn("src", F.when(F.col("src").isNull(), bad).otherwise(F.col("src")))
    else:
        found = found.where(F.col("src").isNotNull() & (~F.col("src").isin("node", "edge", "graph") | F.col("dst").isNotNull()))
        bare = lambda c: F.when(F.startswith(c, F.lit('"')), F.regexp_replace(F.substring(c, F.lit(2), F.length(c) - 2), r"\\(.)", "$1")).otherwise(c)
        found = found.withColumns({"src": bare(F.col("src")), "dst": bare(F.col("dst"))})
    return found.select("at", "src", "dst", "label")


def read_dot(spark: SparkSession, path: str, dialect: str = "reference") -> Graph:
    """Vertices are numbered by the line that they first appear on."""
    found = statements(lines(spark, path), dialect)
    refused = lines(spark, path).where(F.col("at") > 0).where(F.ltrim("line").startswith("[")).select("at", "line")
    if dialect == "reference":
        stop = lines(spark, path).where((F.col("at") > 0) & (F.trim("line") == "}")).agg(F.min("at")).first()[0]
        first = refused.agg(F.min("at")).first()[0]
        if first is not None and (stop is None or first < stop):
            raise ValueError(f"unrecognized pattern in line {first}")
    edges = found.where("dst IS NOT NULL")
    # Numbers of first appearance on the scale of lines, for edges and vertices alike.
    graph = _graph(found, edges)
    labels = found.where("dst IS NULL AND label IS NOT NULL").select(F.col("src").alias("key"), "label")
    return graph.with_labels(labels) if dialect == "quoted" else graph


def _graph(found: DataFrame, edges: DataFrame) -> Graph:
    from ..plans.staging import staged

    found = staged(found.select("at", "src", "dst"), "statements")
    seen = found.select(F.explode(F.array(F.struct(F.col("src").alias("key"), (2 * F.col("at")).alias("at")), F.struct(F.col("dst").alias("key"), (2 * F.col("at") + 1).alias("at")))).alias("x")).select("x.*").where("key IS NOT NULL")
    vertices = staged(ranked(seen.groupBy("key").agg(F.min("at").alias("first")), [F.col("first")], "pos").select(F.col("pos").alias("vid"), "key", F.lit(None).cast("string").alias("label"), "pos"), "vertices")
    s, d = (vertices.select(F.col("key").alias(f"{x}k"), F.col("vid").alias(f"{x}v")) for x in "sd")
    pairs = ranked(found.where("dst IS NOT NULL"), [F.col("at")], "eid")
    pairs = pairs.join(s, F.col("src") == F.col("sk")).join(d, F.col("dst") == F.col("dk")).select("eid", F.col("sv").alias("src"), F.col("dv").alias("dst"))
    return Graph(vertices, staged(pairs, "edges"))


def dot_lines(graph: Graph, dialect: str = "reference") -> DataFrame:
    """section, ord, line of the text: header, vertices in order of key, a blank line, edges in order of insertion, footer."""
    quoted = dialect == "quoted"

    def name(c: str):
        return F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\])', r"\\$1"), F.lit('"')) if quoted else F.col(c)

    text = F.coalesce("label", "key") if quoted else F.col("key")
    text = F.regexp_replace(text, r'(["\\])', r"\\$1") if quoted else text
    spark = graph.vertices.sparkSession
    frame = spark.createDataFrame([(0, "", 0, "digraph {"), (2, "", 0, ""), (4, "", 0, "}")], "section int, k string, e long, line string")
    vertices = graph.vertices.select(F.lit(1).alias("section"), F.col("key").alias("k"), F.lit(0).cast("long").alias("e"), F.concat(F.lit("\t"), name("key"), F.lit(' [label="'), text, F.lit(" ("), F.col("pos").cast("string"), F.lit(')"]')).alias("line"))
    edges = graph.edge_list().select(F.lit(3).alias("section"), F.lit("").alias("k"), F.col("eid").alias("e"), F.concat(F.lit("\t"), name("src"), F.lit(" -> "), name("dst")).alias("line"))
    return frame.unionByName(vertices).unionByName(edges)


def write_dot(graph: Graph, path: str, dialect: str = "reference") -> None:
    """One file, without a line end after the last line; missing folders are made."""
    kept, n = graph.edge_list().count(), graph.num_edges()
    if kept != n:
        raise OSError("Error: an edge has a vertex that is not in the index")
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        for i, row in enumerate(dot_lines(graph, dialect).orderBy("section", "k", "e").toLocalIterator()):
            out.write(("\n" if i else "") + row.line)
