"""DOT text, entity dumps, streams, the generator and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import cli
from ridgeline.builder import GraphBuilder, scale_free_edges
from ridgeline.catalogue import _nation_edges
from ridgeline.sources.dot import read_dot, write_dot
from ridgeline.sources.entities import read_entities
from ridgeline.streaming.entity_edges import append_edges, edge_stream, snapshot
from tests.test_graph import TINY, graph_of, positions

GOLDEN = 'digraph {\n\tv1 [label="v1 (0)"]\n\tv2 [label="v2 (1)"]\n\tv3 [label="v3 (2)"]\n\n\tv1 -> v2\n\tv1 -> v3\n}'


def test_dot_golden(spark, tmp_path):
    graph = graph_of(spark, [("v1", "v2"), ("v1", "v3")])
    path = tmp_path / "deep" / "er" / "g.dot"
    write_dot(graph, str(path))
    assert path.read_text() == GOLDEN
    assert read_dot(spark, str(path)).same_as(graph)


def test_dot_reference_dialect(spark, tmp_path):
    path = tmp_path / "g.dot"
    path.write_text("x -> skipped\n\n \ta -- b \na -> c;\nd -> e [w=1]\nf->g\nh i -> j\nk [label=\"K (7)\"]\n }\t\nl -> m\n")
    graph = read_dot(spark, str(path))
    assert graph.collect_edge_list() == [("a", "b"), ("a", "c;")]
    assert positions(graph) == {"a": 0, "b": 1, "c;": 2, "d": 3, "f->g": 4, "h": 5, "k": 6}
    path.write_text("graph {\n[x]\n}\n")
    with pytest.raises(ValueError):
        read_dot(spark, str(path))
    with pytest.raises(OSError):
        read_dot(spark, str(tmp_path / "none.dot"))


def test_dot_quoted_dialect(spark, tmp_path):
    graph = graph_of(spark, [("human being", 'an "animal"'), ("a\\b", "human being")])
    path = tmp_path / "g.dot"
    write_dot(graph, str(path), "quoted")
    back = read_dot(spark, str(path), "quoted")
    assert sorted(back.collect_edge_list()) == sorted(graph.collect_edge_list())
    path.write_text('graph {\nnode [shape=box];\na->b; b -- "c d" [w=1];\n// no\ne\n}\n')
    graph = read_dot(spark, str(path), "quoted")
    assert graph.collect_edge_list() == [("a", "b"), ("b", "c d")] and set(positions(graph)) == {"a", "b", "c d", "e"}


ENTITIES = [
    "[",
    '{"id":"Q1","labels":{"en":{"value":"human being"}},"claims":{"P1":[{"mainsnak":{"datavalue":{"value":{"id":"Q2"}}}},{"mainsnak":{"snaktype":"novalue"}},{"mainsnak":{"datavalue":{"value":"str"}}},{"mainsnak":{"datavalue":{"value":{"id":"Q3"}}}}]}},',
    '{"id":"Q9","claims":[]},',
    '{"id":"Q4","claims":{"P1":[{"mainsnak":{"datavalue":{"value":{"id":"Q2"}}}}]}},',
    '{"id":"Q8","labels":{"en":{"value":"x"}},"claims":{"P1":[]}},',
    "{bad json},",
    '{"id":7,"claims":{"P1":[{"mainsnak":{"datavalue":{"value":{"id":"Q2"}}}}]}}',
    "]",
]


def test_entities(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text("\n".join(ENTITIES) + "\n")
    graph = read_entities(spark, str(path), "P1")
    assert graph.collect_edge_list() == [("Q1", "Q2"), ("Q1", "Q3"), ("Q4", "Q2")]
    assert {r.key: r.label for r in graph.vertices.collect()} == {"Q1": "human being", "Q2": None, "Q3": None, "Q4": None}
    with pytest.raises(OSError):
        read_entities(spark, str(tmp_path / "none"), "P1")


def test_entity_stream(spark, tmp_path):
    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(ENTITIES[:3]))
    append_edges(edge_stream(spark, folder, "P1"), table, state).awaitTermination()
    assert snapshot(spark, table).num_edges() == 2
    (tmp_path / "in" / "b.json").write_text("\n".join(ENTITIES[3:]))
    append_edges(edge_stream(spark, folder, "P1"), table, state).awaitTermination()
    assert snapshot(spark, table).collect_edge_list() == [("Q1", "Q2"), ("Q1", "Q3"), ("Q4", "Q2")]


@pytest.mark.parametrize("seed", [0, 9])
def test_dense_clusters(spark, seed):
    builder = GraphBuilder(spark, seed)
    builder.add_dense_cluster(3, 1.0)
    assert sorted(builder.finalize_graph().collect_edge_list()) == [(a, b) for a in "012" for b in "012" if a != b]
    builder = GraphBuilder(spark, seed)
    builder.add_dense_cluster(3, 0.0)
    graph = builder.finalize_graph()
    assert graph.num_vertices() == 3 and graph.num_edges() == 0


def test_links_until_all_are_taken(spark):
    builder = GraphBuilder(spark, 4)
    a, b = builder.add_dense_cluster(2, 1.0), builder.add_dense_cluster(2, 1.0)
    assert builder.get_cluster(a) == [0, 1] and builder.get_cluster(b) == [2, 3] and builder.get_cluster(2) is None
    for _ in range(3):
        builder.add_random_link(a, b)
    builder.add_random_links(a, b, 1)
    with pytest.raises(ValueError):
        builder.add_random_link(a, b)
    graph = builder.finalize_graph()
    assert sorted(graph.collect_edge_list()) == [("0", "1"), ("0", "2"), ("0", "3"), ("1", "0"), ("1", "2"), ("1", "3"), ("2", "3"), ("3", "2")]
    assert builder.get_cluster(a) is None
    with pytest.raises(ValueError, match="finalized"):
        builder.add_dense_cluster(2, 1.0)


def test_failures(spark):
    builder = GraphBuilder(spark, 0)
    a, b = builder.add_dense_cluster(2, 0.5), builder.add_dense_cluster(2, 0.5)
    builder.add_link(a, b, 0, 1)
    calls = [
        lambda: builder.add_scale_free_cluster(0, 1), lambda: builder.add_scale_free_cluster(1, 0), lambda: builder.add_scale_free_cluster(2, 3),
        lambda: builder.add_dense_cluster(0, 0.5), lambda: builder.add_dense_cluster(2, -0.1), lambda: builder.add_dense_cluster(2, 1.1),
        lambda: builder.add_random_link(a, a), lambda: builder.add_random_link(a, 7), lambda: builder.add_random_link(7, a), lambda: builder.add_random_links(a, b, 4),
        lambda: builder.add_link(a, a, 0, 0), lambda: builder.add_link(a, 7, 0, 0), lambda: builder.add_link(7, a, 0, 0),
        lambda: builder.add_link(a, b, 2, 0), lambda: builder.add_link(a, b, 0, 2), lambda: builder.add_link(a, b, -1, 0), lambda: builder.add_link(a, b, 0, 1),
        lambda: GraphBuilder(spark, -1),
    ]
    for call in calls:
        with pytest.raises(ValueError):
            call()


def test_scale_free_growth():
    for n, m, seed in ((1, 1, 0), (5, 1, 1), (30, 4, 2), (30, 30, 3), (50, 7, 4)):
        edges = scale_free_edges(n, m, seed)
        seeds = [(a, b) for a, b in edges.tolist() if max(a, b) < m]
        assert len(edges) - len(seeds) == (n - m) * m
        assert (m + 1) // 2 <= len(seeds) <= m - 1 if m > 1 else not seeds
        assert all(a != b for a, b in edges.tolist()) and len({frozenset(e) for e in edges.tolist()}) == len(edges)
        assert np.array_equal(edges, scale_free_edges(n, m, seed))


def test_ring_and_membership(spark):
    builder = GraphBuilder(spark, 5)
    builder.add_scale_free_clusters([(20, 3), (15, 2), (10, 2)])
    builder.add_ring_links([5, 4, 3])
    truth = {r.key: r.cluster for r in builder.membership().collect()}
    graph = builder.finalize_graph()
    edges = graph.collect_edge_list()
    assert len(set(edges)) == len(edges) and sum(truth[a] != truth[b] for a, b in edges) == 12
    assert graph.vertices.agg(F.count_distinct("pos")).first()[0] == 45


def test_command_line(spark, tmp_path, capsys):
    dump, dot, out = (str(tmp_path / x) for x in ("dump.json", "g.dot", "c.json"))
    (tmp_path / "dump.json").write_text("\n".join(ENTITIES))
    cli.main(["extract", dump, "P1", dot], spark)
    assert read_dot(spark, dot, "quoted").num_edges() == 3
    write_dot(graph_of(spark, TINY), dot)
    cli.main(["cluster", dot, out], spark)
    assert json.loads((tmp_path / "c.json").read_text()) == [[f"v{i}" for i in range(1, 8)]]
    cli.main(["evaluate", "--runs", "1", "--clusters", "12"], spark)
    assert 0 <= json.loads(capsys.readouterr().out)["ari"] <= 1


def test_many_statements_on_one_line(spark, tmp_path):
    many = "; ".join(f"a{i} -> b{i}" for i in range(3000))
    (tmp_path / "g.dot").write_text(f"digraph {{\n{many}\nlate -> a0; x\n}}")
    graph = read_dot(spark, str(tmp_path / "g.dot"), "quoted")
    assert graph.collect_edge_list() == [*((f"a{i}", f"b{i}") for i in range(3000)), ("late", "a0")]
    assert [graph.get_vertex_id(x) for x in ("a0", "b2999", "late", "x")] == [0, 5999, 6000, 6001]


def test_entities_are_numbered_by_file(spark, tmp_path):
    line = '{"id":"%s","claims":{"P1":[{"mainsnak":{"datavalue":{"value":{"id":"%s"}}}}]}}'
    for name, n in (("b", 400), ("a", 3), ("c", 1)):
        (tmp_path / f"{name}.json").write_text("\n".join(line % (f"{name}{i}", f"t{name}{i}") for i in range(n)))
    got = read_entities(spark, str(tmp_path), "P1").collect_edge_list()
    assert got == [(f"{name}{i}", f"t{name}{i}") for name, n in (("a", 3), ("b", 400), ("c", 1)) for i in range(n)]


def test_a_shared_folder_is_needed_beyond_one_machine(spark):
    from types import SimpleNamespace

    from ridgeline.plans import staging

    def session(master, folder=None):
        conf = SimpleNamespace(get=lambda _: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            staging.shared_dir(session(master))
        assert staging.shared_dir(session(master, "hdfs:///x")) == "hdfs:///x"
    assert staging.shared_dir(session("local[4]")).startswith("file:///")


def test_staged_tables_can_be_cleared(spark, tmp_path):
    import os

    from ridgeline.plans import staging

    assert staging.staged(spark.range(5), "some").count() == 5
    root = staging.staged_root(spark).removeprefix("file://")
    held = root + "-held"
    os.rename(root, held)
    staging.staged(spark.range(5), "some")
    assert os.listdir(root)
    staging.clear_staged(spark)
    assert not os.path.exists(root)
    os.rename(held, root)


def test_growth_draws_different_nodes_by_degree():
    for n, m in ((400, 5), (60, 30), (5, 5), (300, 1), (1, 1)):
        edges = scale_free_edges(n, m, 3)
        pairs = {frozenset(x) for x in edges.tolist()}
        assert len(pairs) == len(edges) >= (n - m) * m and all(len(x) == 2 for x in pairs)
        assert (scale_free_edges(n, m, 3) == edges).all()
    degree = np.bincount(scale_free_edges(3000, 4, 1).ravel())
    assert degree[:30].mean() > 5 * degree[1500:].mean()


def test_nations_are_linked_without_pairing_all(spark, tmp_path):
    """The links of the nations' graph against all pairs, from joins on equal keys alone."""
    g = {k: None if k % 50 == 7 else 3 if k < 200 else (k * k) % 25 for k in range(0, 1200, 2)}
    spark.createDataFrame(list(g.items()), "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    edges = _nation_edges(spark, str(tmp_path))
    own = {n: [k for k in g if g[k] == n] for n in range(25)}
    want = [(own[n][i], own[n][j]) for n in own for i in range(len(own[n])) for j in range(i + 1, len(own[n])) if j - i <= 3 or j % (i + 2) == 0]
    want += [(a, b) for n in own for i, (a, b) in enumerate(zip(own[n], own[(n + 1) % 25])) if i % 9 == 0]
    assert sorted((r.kx, r.ky) for r in edges.collect()) == sorted(want)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and (" OR " in line or "<" in line)]
