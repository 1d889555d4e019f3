"""How well planted communities are found again."""

from __future__ import annotations

import random
import time

from pyspark.sql import SparkSession

from .builder import GraphBuilder
from .functions.metrics import adjusted_rand_index


def planted_run(spark: SparkSession, seed: int, clusters: int = 1000, low: int = 20, high: int = 200, salt: float = 0.1, pepper: float = 0.7, factor: float = 0.01, steps: int = 5, threshold: float = 0.1, min_size: int = 10) -> dict[str, float]:
    """Scale-free clusters of low to high nodes, salt * size edges from each new node, pepper * size links to the next cluster in a ring."""
    r = random.Random(seed)
    sizes = [r.randint(low, high) for _ in range(clusters)]
    builder = GraphBuilder(spark, seed)
    builder.add_scale_free_clusters([(n, int(salt * n)) for n in sizes])
    builder.add_ring_links([int(pepper * min(n, sizes[(i + 1) % clusters])) for i, n in enumerate(sizes)])
    planted = builder.membership()
    graph = builder.finalize_graph().shuffle(seed)
    began = time.time()
    found = graph.cluster(factor, steps, threshold, min_size)
    count = found.get_clusters().agg({"cluster_id": "max"}).first()[0] + 1
    seconds = time.time() - began
    ari = adjusted_rand_index(found.get_clusters().join(planted, "key"), "cluster_id", "cluster").first().ari
    return {"seed": seed, "vertices": graph.num_vertices(), "edges": graph.num_edges(), "found": count, "ari": ari, "seconds": seconds}


def evaluate(spark: SparkSession, runs: int = 25, **shape) -> dict[str, float]:
    """Means over seeds 0 to runs - 1; a run that fails is an error, not replaced."""
    all_runs = [planted_run(spark, seed, **shape) for seed in range(runs)]
    return {k: sum(r[k] for r in all_runs) / len(all_runs) for k in ("vertices", "edges", "found", "ari", "seconds")}
