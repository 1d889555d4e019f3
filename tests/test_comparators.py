"""Label propagation, Louvain, Leiden, fast greedy and walktrap on graphs with an obvious answer, and against plain versions."""

import collections
import itertools
import random

import numpy as np
import pytest

from ridgeline.functions.metrics import adjusted_rand_index
from ridgeline.graph import Graph
from ridgeline.operators import comparators
from ridgeline.operators.comparators import COMPARATORS, _walk_distances, _walks, fast_greedy, label_propagation, leiden, louvain, modularity, symmetric, walktrap
from ridgeline.operators.local_moves import _Near, hashed
from ridgeline.plans.projections import nearest
from tests.test_graph import graph_of


@pytest.fixture(scope="module")
def cliques(spark):
    pairs = [p for k in range(5) for p in itertools.combinations(range(8 * k, 8 * k + 8), 2)] + [(8 * k, (8 * k + 9) % 40) for k in range(5)]
    random.Random(2).shuffle(pairs)
    return graph_of(spark, pairs, ["alone"])


def leiden_by_modularity(graph):
    return leiden(graph, objective="modularity")


@pytest.mark.parametrize("find", [label_propagation, louvain, leiden_by_modularity, fast_greedy, walktrap])
def test_cliques_are_found(spark, cliques, find):
    found = find(cliques)
    truth = spark.createDataFrame([(str(i), i // 8) for i in range(40)] + [("alone", 99)], "key string, truth int")
    rows = cliques.vertices.join(found, "vid").join(truth, "key")
    assert rows.count() == 41 and adjusted_rand_index(rows, "community", "truth").first().ari == 1.0


@pytest.mark.parametrize("find", [label_propagation, louvain, fast_greedy])
def test_one_task_equals_dataframe_rounds(spark, tangle, find):
    """The same communities either way, and few jobs in one task, however many rounds there are."""
    spark.sparkContext.setJobGroup(f"one-{find.__name__}", "")
    one = sorted(find(tangle).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"one-{find.__name__}"))
    spark.sparkContext.setJobGroup("rest", "")
    assert one == sorted(find(tangle, task_links=0).collect()) and jobs < 60


def test_all_levels_of_louvain_take_one_task(spark, monkeypatch):
    """Rings of rings of cliques need several levels; they are made in one task, with the result of the DataFrame rounds."""
    pairs = [p for k in range(24) for p in itertools.combinations(range(4 * k, 4 * k + 4), 2)]
    pairs += [(4 * k, 4 * (k // 4 * 4 + (k + 1) % 4) + 1) for k in range(24)] + [(16 * g, (16 * g + 18) % 96) for g in range(6)]
    graph = graph_of(spark, pairs, ["alone"])
    calls, once = collections.Counter(), {x: getattr(comparators, x) for x in ("_in_one_task", "_moves")}
    for x, f in once.items():
        monkeypatch.setattr(comparators, x, lambda *a, x=x, f=f: calls.update([x]) or f(*a))
    one = sorted(louvain(graph).collect())
    assert calls == {"_in_one_task": 1}
    assert one == sorted(louvain(graph, task_links=0).collect()) and calls["_moves"] > 2
    calls.clear()
    assert one == sorted(louvain(graph, task_links=300).collect()) and calls == {"_in_one_task": 1, "_moves": 1}


def test_weights_are_kept_up_as_vertices_move():
    r = np.random.default_rng(4)
    n = 300
    w = np.triu(r.integers(1, 4, (n, n)) * (r.random((n, n)) < 0.03), 1)
    w = w + w.T
    (a, b), c = np.nonzero(w), np.arange(n)
    near = _Near(a, b, w[a, b].astype(float), c)
    for many in (200, 3, 1, 40, 0, 5, 5, 5, 5, 150, 20, 20, 20, 2):
        u = np.sort(r.choice(n, many, replace=False))
        after = c.copy()
        after[u] = [c[r.choice(np.append(b[a == v], v))] for v in u]  # as in moves, to where a neighbour is
        near.moved(u, c, after)
        c = after
        want = np.zeros((n, n))
        np.add.at(want.T, c, w)
        got = np.zeros((n, n))
        got[near.v, near.to] = near.weight
        assert (got == want).all() and (np.diff(near.key) > 0).all()
        assert (near.to[near.first] == near.to[np.searchsorted(near.v, np.arange(n))]).all() and (near.to == c[near.v]).sum() == n


def test_nearest_in_any_blocks(spark):
    """The ten nearest against all pairs, many of them exact copies, whose ties go by name; to the last digit the same in any blocks."""
    r = np.random.default_rng(3)
    x = r.normal(size=(700, 12)).astype(np.float32)
    x[300:] = x[r.integers(0, 60, 400)]
    x[20:23] = 0
    unit = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1, keepdims=True), 1e-300)
    similarity = (unit[:, None] * unit[None]).sum(axis=2)
    np.fill_diagonal(similarity, -np.inf)
    best = np.argsort(-similarity, axis=1, kind="stable")[:, :10]
    want = [(i, int(j), k + 1, float(similarity[i, j])) for i in range(700) for k, j in enumerate(best[i])]
    vectors = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    for block, wide in ((700, 700), (90, 250), (2000, 11)):
        assert sorted(map(tuple, nearest(vectors, block=block, wide=wide).collect()), key=lambda y: (y[0], y[2])) == want


def test_hashes_are_spark_s(spark):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 62), 12345678901]
    want = spark.createDataFrame([(x, x ^ 5) for x in ids], "a long, b long").selectExpr("a", "b", "xxhash64(a, b, 3) AS h", "xxhash64(a, 0) AS g").collect()
    a, b = np.array([r.a for r in want]), np.array([r.b for r in want])
    assert hashed([a, b], 3).tolist() == [r.h for r in want] and hashed([a], 0).tolist() == [r.g for r in want]


def test_modularity(spark, cliques):
    rows = cliques.vertices.selectExpr("vid", "CASE WHEN key = 'alone' THEN -1 ELSE CAST(key AS INT) div 8 END AS community")
    inside, m = 5 * 28, 5 * 28 + 5
    assert modularity(cliques, rows).first().modularity == pytest.approx(inside / m - 5 * (2 * m / 5 / (2 * m)) ** 2)
    assert modularity(cliques, louvain(cliques)).first().modularity >= modularity(cliques, label_propagation(cliques)).first().modularity - 1e-9


def test_nothing_to_find(spark):
    lone = graph_of(spark, [("a", "a")], ["b"])
    for find in set(COMPARATORS.values()):
        assert find(Graph.empty(spark)).count() == 0
        assert sorted((r.vid, r.community) for r in find(lone).collect()) == [(0, 0), (1, 1)]
    with pytest.raises(ValueError):
        leiden(lone, objective="other")
    with pytest.raises(ValueError):
        walktrap(lone, 0)


@pytest.fixture(scope="module")
def tangle(spark):
    r = random.Random(5)
    pairs = [(a, b) for a, b in itertools.combinations(range(36), 2) if r.random() < (0.5 if a // 12 == b // 12 else 0.06)]
    return graph_of(spark, pairs + pairs[:5])


def test_leiden_on_a_tangle(spark, tangle):
    """Communities are connected, no single vertex gains by a move, and the preset objective leaves simple edges alone."""
    found = {r.vid: r.community for r in leiden(tangle, objective="modularity").collect()}
    edges = [(r.src, r.dst) for r in tangle.edges.collect()]
    for c in set(found.values()):
        inside = {v for v, x in found.items() if x == c}
        seen, ahead = set(), [c]
        while ahead:
            v = ahead.pop()
            if v not in seen:
                seen.add(v)
                ahead += [y for e in edges for x, y in (e, e[::-1]) if x == v and y in inside]
        assert seen == inside

    def quality(of):
        m, degree = len(edges), collections.Counter(v for e in edges for v in e)
        size = collections.Counter()
        for v, k in degree.items():
            size[of[v]] += k
        return sum(of[a] == of[b] for a, b in edges) / m - sum((s / (2 * m)) ** 2 for s in size.values())

    best = quality(found)
    assert best > 0.3
    assert all(quality(found | {v: c}) <= best + 1e-9 for v in found for c in set(found.values()))
    by_cpm = leiden(tangle).groupBy("community").count().where("count > 1").count()
    assert by_cpm <= 5  # only where an edge is double


def test_walk_distances(spark, tangle):
    """Distances of neighbours against matrices."""
    links = symmetric(tangle)
    n = tangle.num_vertices()
    w = np.zeros((n, n))
    for r in links.collect():
        w[r.a, r.b] = r.w
    w += np.diag(w.sum(1) / (w > 0).sum(1))
    degree = w.sum(1)
    walk = np.linalg.matrix_power(w / degree[:, None], 3) / np.sqrt(degree)
    sizes = tangle.vertices.selectExpr("vid AS v", "1.0D AS n")
    got = _walk_distances(links.where("a < b").select("a", "b"), _walks(links, 3), sizes).collect()
    assert len(got) == links.where("a < b").count()
    for r in got:
        assert -r.near == pytest.approx(((walk[r.a] - walk[r.b]) ** 2).sum() / 2, abs=1e-9)
