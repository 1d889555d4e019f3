"""Graphs, scoring, cutting and clustering."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions.metrics import adjusted_rand_index
from ridgeline.functions.ranking import ranked
from ridgeline.graph import Graph
from ridgeline.operators.affinity import affinity_round
from ridgeline.operators.cluster import attach
from ridgeline.operators.local import attached, cut, segmented
from ridgeline.operators.segments import demoted, kinds, runs

TINY = [("v1", "v2"), ("v1", "v3"), ("v1", "v4"), ("v2", "v3"), ("v2", "v4"), ("v3", "v4"), ("v4", "v5"), ("v5", "v6"), ("v5", "v7"), ("v6", "v7")]


def graph_of(spark, pairs, more=None):
    df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "i long, src string, dst string")
    keys = spark.createDataFrame([(k,) for k in more], "key string") if more else None
    return Graph.from_edges(df, "src", "dst", "i", keys)


def positions(graph):
    return {r.key: r.pos for r in graph.vertices.collect()}


def test_empty_graph(spark):
    graph = Graph.empty(spark)
    assert graph.num_vertices() == 0 and graph.num_edges() == 0 and graph.as_matrix() == [] and graph.collect_clusters() == []
    with pytest.raises(ValueError):
        graph.cluster(0.1, 1, 0.1, 1)


def test_ids_by_first_appearance(spark):
    graph = graph_of(spark, [("v1", "v2"), ("v1", "v3"), ("v3", "v3"), ("v1", "v2")])
    assert positions(graph) == {"v1": 0, "v2": 1, "v3": 2} and graph.num_edges() == 4
    assert graph.collect_edge_list() == [("v1", "v2"), ("v1", "v3"), ("v3", "v3"), ("v1", "v2")]
    assert graph.get_vertex_id("v3") == 2 and graph.get_vertex_id("none") is None
    assert {r.key: r.degree for r in graph.degrees().collect()} == {"v1": 3, "v2": 2, "v3": 3}


def test_added_vertices_and_edges(spark):
    graph = Graph.empty(spark).with_vertices(spark.createDataFrame([("v1",), ("v2",), ("v1",)], "key string"))
    graph = graph.with_edges(spark.createDataFrame([("v1", "v9"), ("v9", "v9")], "src string, dst string"))
    assert positions(graph) == {"v1": 0, "v2": 1, "v9": 2} and sorted(graph.collect_edge_list()) == [("v1", "v9"), ("v9", "v9")]
    assert [r.key for r in graph.isolated().collect()] == ["v2"]


def test_remap_moves_all_at_once(spark):
    graph = graph_of(spark, [("v1", "v2"), ("v1", "v3")])
    moved = graph.remap(spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "old long, new long"))
    assert sorted((r.src, r.dst) for r in moved.positioned().collect()) == [(1, 0), (1, 2)]
    with pytest.raises(ValueError):
        graph.remap(spark.createDataFrame([(0, 1)], "old long, new long"))


def test_shuffle_is_a_permutation_by_seed(spark):
    graph = graph_of(spark, [(i, i + 1) for i in range(50)])
    a, b, c = (positions(graph.shuffle(s)) for s in (1, 1, 2))
    assert a == b != c and sorted(a.values()) == list(range(51))


def test_equality(spark):
    a, b = graph_of(spark, TINY), graph_of(spark, TINY + TINY[:1])
    assert a.same_as(b) and not a.same_as(graph_of(spark, TINY[::-1])) and not a.same_as(a.shuffle(3))


def test_matrices(spark):
    assert graph_of(spark, [("v1", "v2"), ("v1", "v3")]).as_matrix() == [[0, 1, 1], [0, 0, 0], [0, 0, 0]]
    graph = graph_of(spark, [(0, 1), (1, 0), (0, 2), (3, 1)], [f"{i:05d}" for i in range(4, 2000)])
    matrix = graph.as_matrix()
    assert len(matrix) == 1000 and matrix[0][0] == 2 and matrix[0][1] == 1 and matrix[1][0] == 1 and sum(map(sum, matrix)) == 4


def test_conversion_keeps_positions(spark):
    graph = graph_of(spark, [("b", "a"), ("b", "c")]).renumbered_keys()
    assert positions(graph) == {"1": 0, "0": 1, "2": 2}


def test_ranks_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    got = ranked(df, [F.col("x")], "r").collect()
    assert [r.r for r in sorted(got, key=lambda r: r.x)] == list(range(1000))
    for g in range(3):
        own = sorted((r for r in ranked(df, [F.col("x").desc()], "r", "g").collect() if r.g == g), key=lambda r: -r.x)
        assert [r.r for r in own] == list(range(len(own)))


def test_step_of_tiny(spark):
    graph, weights = graph_of(spark, TINY).cluster_step(0.1, 0, 7)
    got = {r.key: round(r.weight, 6) for r in graph.vertices.join(weights, "pos").collect()}
    assert got == {"v4": 3.393888, "v3": 2.645656, "v2": 2.559549, "v1": 2.464386, "v5": 1.896161, "v7": 1.276851, "v6": 1.219132}
    assert positions(graph) == {"v4": 0, "v3": 1, "v2": 2, "v1": 3, "v5": 4, "v7": 5, "v6": 6}


def test_step_of_a_range(spark):
    graph = graph_of(spark, TINY)
    moved, weights = graph.cluster_step(0.1, 4, 7)
    assert weights.count() == 3 and {k: p for k, p in positions(moved).items() if p < 4} == {"v1": 0, "v2": 1, "v3": 2, "v4": 3}
    for bad in ((5, 4), (0, 8), (-1, 3)):
        with pytest.raises(ValueError):
            graph.cluster_step(0.1, *bad)
    with pytest.raises(ValueError):
        graph.cluster_step(math.nan, 0, 7)


def machine(d, threshold, min_size):
    """Runs by a state machine over the marks of positions."""
    marks = [x > threshold for x in [d[0], *d]]
    found, start = [], 0
    for i in range(1, len(marks) + 1):
        if i == len(marks) or marks[i] != marks[start]:
            strong = marks[start] and i - start >= min_size
            if found and found[-1][2] == strong:
                found[-1][1] = i
            else:
                found.append([start, i, strong])
            start = i
    return [tuple(x) for x in found]


def test_cutting_equals_a_state_machine(spark):
    r = random.Random(0)
    rows, want = [], {}
    for seg in range(60):
        lw = sorted((round(r.choice([0.05, 0.5]) * r.randint(0, 9), 9) for _ in range(r.randint(2, 40))), reverse=True)
        want[seg] = machine(np.diff(lw).tolist(), -0.2, 3)
        assert cut(np.array(lw), -0.2, 3) == want[seg]
        rows += [(seg, p, x) for p, x in enumerate(lw)] + [(seg, len(lw), None)]
    df = spark.createDataFrame(rows, "seg long, p long, lw double")
    got = {}
    for x in demoted(runs(kinds(df, -0.2)), 3).collect():
        got.setdefault(x.seg, []).append((x.start, x.end, x.strong))
    assert {k: sorted(v) for k, v in got.items()} == want


def recursive(src, dst, n, factor, steps, threshold, min_size):
    """Depth-first, all edges looked at each time: order of vertices and segments."""
    place, found = {v: v for v in range(n)}, []

    def work(lo, hi):
        if hi - lo <= min_size:
            if hi > lo:
                found.append((lo, hi, 0))
            return
        for _ in range(steps):
            w = dict.fromkeys((v for v in place if lo <= place[v] < hi), 0.0)
            for a, b in zip(src, dst):
                if a in w and b in w:
                    w[a] += math.exp(-factor * (place[b] - lo))
                    w[b] += math.exp(-factor * (place[a] - lo))
            lw = {v: round(math.log2(x), 9) if x > 0 else -math.inf for v, x in w.items()}
            order = sorted(w, key=lambda v: (-lw[v], place[v]))
            for i, v in enumerate(order):
                place[v] = lo + i
            c = sum(x > -math.inf for x in lw.values())
            if c <= min_size:
                found.append((lo, hi, 0))
                return
        parts = machine(np.diff([lw[v] for v in order[:c]]).tolist(), threshold, min_size)
        k = sum(s for *_, s in parts)
        if c == hi - lo and k <= 1:
            found.extend((lo + a, lo + b, 2 if s else 1) for a, b, s in parts)
            return
        end = 0
        for a, b, s in parts:
            end = b
            if s and k > 1:
                work(lo + a, lo + b)
            else:
                found.append((lo + a, lo + b, 2 if s else 1))
            if s:
                break
        work(lo + end, hi)

    work(0, n)
    return place, sorted(found)


def blocks(r, sizes, inner, outer):
    label = [i for i, n in enumerate(sizes) for _ in range(n)]
    r.shuffle(label)
    n = len(label)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < (inner if label[a] == label[b] else outer)], label


CASES = [(1, (30, 25, 20), 0.6, 0.01, 0.05, 3, -0.1, 5), (2, (40, 40), 0.5, 0.02, 0.01, 5, -0.25, 10), (3, (12, 15, 9, 20, 14), 0.7, 0.02, 0.1, 2, -0.3, 4)]


@pytest.mark.parametrize("case", CASES)
def test_local_levels_equal_recursion(case):
    seed, sizes, inner, outer, *params = case
    pairs, label = blocks(random.Random(seed), sizes, inner, outer)
    src, dst = np.array(pairs).T
    final, found = segmented(src, dst, len(label), *params)
    place, want = recursive(src.tolist(), dst.tolist(), len(label), *params)
    assert found == want and [place[v] for v in final.tolist()] == list(range(len(label)))
    assert [a for a, *_ in found] == [0, *[b for _, b, _ in found[:-1]]]


def test_many_levels_of_a_long_graph():
    """Each level looks at the edges in reach only: thousands of levels, of a graph far longer than they reach, end soon."""
    n = 40_000
    i = np.arange(n)
    src, dst = np.concatenate([i[:-k] for k in (1, 2, 3)]), np.concatenate([i[k:] for k in (1, 2, 3)])
    began = time.monotonic()
    final, found = segmented(src, dst, n, 5.0, 4, -0.2, 3)
    assert time.monotonic() - began < 30
    assert sorted(final.tolist()) == list(range(n)) and [a for a, *_ in found] == [0, *[b for _, b, _ in found[:-1]]]


def test_short_reach_equals_recursion():
    """Scores that come to 0 within a few places."""
    r = random.Random(9)
    for _ in range(20):
        n = r.randint(5, 60)
        pairs = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(3, 150))]
        src, dst = np.array(pairs).T
        final, found = segmented(src, dst, n, 90.0, 3, -0.2, 2)
        place, want = recursive(src.tolist(), dst.tolist(), n, 90.0, 3, -0.2, 2)
        assert found == want and [place[v] for v in final.tolist()] == list(range(n))


@pytest.mark.parametrize("case", CASES[:2])
def test_dataframe_levels_equal_local_ones(spark, case):
    seed, sizes, inner, outer, *params = case
    pairs, _ = blocks(random.Random(seed), sizes, inner, outer)
    graph = graph_of(spark, pairs, ["zz1", "zz2"])
    whole = graph.cluster(*params)
    split = graph.cluster(*params, task_edges=60)
    assert whole.collect_clusters() == split.collect_clusters()
    assert positions(whole) == positions(split) and sorted(positions(whole).values()) == list(range(graph.num_vertices()))
    assert whole.collect_clusters()[:2] == [["zz1"], ["zz2"]]


def test_attaching_equals_rounds(spark):
    r = random.Random(7)
    n = 60
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(70)]
    cluster = [r.choice([-1, -1, -1, 0, 1, 2]) if i < 45 else -1 for i in range(n)]
    src, dst = np.array(pairs).T
    want = attached(np.array(cluster), src, dst, 3).tolist()
    members = spark.createDataFrame([(i, i, None if c < 0 else c) for i, c in enumerate(cluster)], "vid long, pos long, cluster long")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    for limit in (1_000_000, 20):
        got = {x.vid: x.cluster for x in attach(members, edges, limit).collect()}
        assert [got[i] for i in range(n)] == want
    once = {x.vid: x.cluster for x in affinity_round(members, edges).collect()}
    for v in range(n):
        if cluster[v] < 0:
            votes = [cluster[b] for a, b in pairs + [(b, a) for a, b in pairs] if a == v and cluster[b] >= 0]
            assert once[v] == (min(set(votes), key=lambda c: (-votes.count(c), c)) if votes else None)


def test_cluster_arguments_and_small_graphs(spark):
    graph = graph_of(spark, TINY)
    for bad in ((math.inf, 5, 0.1, 10), (0.1, 0, 0.1, 10), (0.1, 5, 0.1, 0)):
        with pytest.raises(ValueError):
            graph.cluster(*bad)
    assert graph.cluster(0.0001, 5, 0.25, 10).collect_clusters() == [[f"v{i}" for i in range(1, 8)]]
    alone = Graph.empty(spark).with_vertices(spark.createDataFrame([("a",), ("b",)], "key string"))
    assert alone.cluster(0.1, 1, 0.1, 1).collect_clusters() == [["a"], ["b"]]
    again = graph.cluster(0.1, 2, 0.1, 2)
    assert len(again.cluster(0.1, 2, 0.1, 10).collect_clusters()) == 1 and again.shuffle(1).clusters is None


def test_rand_index(spark):
    rows = [(0, "x", 5), (0, "x", 5), (1, "y", 5), (1, "z", 5)]
    df = spark.createDataFrame(rows, "a long, b string, c long")
    assert adjusted_rand_index(df, "a", "a").first().ari == 1.0
    assert adjusted_rand_index(df, "a", "b").first().ari == pytest.approx(0.5714285714)
    assert adjusted_rand_index(df, "c", "c").first().ari == 1.0 and adjusted_rand_index(df, "a", "c").first().ari == 0.0
