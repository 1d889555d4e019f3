"""Ridgeline: community detection on large graphs, expressed as Spark DataFrame plans."""
