"""python -m ridgeline.cli extract | cluster | evaluate"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .evaluation import evaluate
from .sources.clusters import write_cluster_json
from .sources.dot import read_dot, write_dot
from .sources.entities import read_entities


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ridgeline")
    commands = top.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="one relationship of an entity dump to DOT")
    extract.add_argument("dump")
    extract.add_argument("relationship")
    extract.add_argument("output")
    extract.add_argument("--dialect", default="quoted", choices=["reference", "quoted"])
    cluster = commands.add_parser("cluster", help="communities of a DOT graph to JSON")
    cluster.add_argument("graph")
    cluster.add_argument("output")
    cluster.add_argument("--factor", type=float, default=0.0001)
    cluster.add_argument("--steps", type=int, default=5)
    cluster.add_argument("--threshold", type=float, default=0.25)
    cluster.add_argument("--min-size", type=int, default=10)
    cluster.add_argument("--dialect", default="reference", choices=["reference", "quoted"])
    score = commands.add_parser("evaluate", help="find planted communities again")
    score.add_argument("--runs", type=int, default=25)
    score.add_argument("--clusters", type=int, default=1000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "extract":
        write_dot(read_entities(spark, args.dump, args.relationship), args.output, args.dialect)
    elif args.command == "cluster":
        graph = read_dot(spark, args.graph, args.dialect)
        began = time.time()
        graph = graph.cluster(args.factor, args.steps, args.threshold, args.min_size)
        print(f"clustered in {time.time() - began:.1f} s", file=sys.stderr)
        write_cluster_json(graph, args.output)
    else:
        print(json.dumps(evaluate(spark, args.runs, clusters=args.clusters)))


if __name__ == "__main__":
    main()
