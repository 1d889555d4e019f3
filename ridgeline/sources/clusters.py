"""Writing clusters."""

from __future__ import annotations

import json
import os

from ..graph import Graph


def write_cluster_json(graph: Graph, path: str) -> None:
    """One JSON array of arrays of keys, in order; one cluster at a time passes the driver."""
    if folder := os.path.dirname(path):
        os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(graph.cluster_lists().orderBy("cluster_id").toLocalIterator()):
            out.write((", " if i else "") + json.dumps(list(row.members)))
        out.write("]")


def write_clusters(graph: Graph, path: str) -> None:
    """The same as JSON lines (cluster_id, members), by all executors."""
    graph.cluster_lists().write.json(path)
