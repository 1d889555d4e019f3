"""Every query of the graph engine by name, with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .builder import GraphBuilder, dense_pairs, unused_pairs
from .functions.metrics import adjusted_rand_index, differences
from .functions.ranking import ranked
from .graph import Graph
from .operators.affinity import affinity_counts, affinity_round, best_cluster
from .operators.comparators import fast_greedy, label_propagation, leiden, louvain, modularity
from .operators.scoring import step, weights
from .operators.segments import demoted, first_strong, kinds, runs
from .plans import projections as P
from .plans.clustering_sql import clustering_sql
from .plans.staging import staged
from .sources.dot import dot_lines as lines_of
from .sources.dot import read_dot, statements, write_dot
from .sources.entities import parsed, raw_edges

FACTOR, THRESHOLD, MIN_SIZE = 0.01, -0.1, 10
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# SQL pieces: edges e (eid, s, d) of the trade graph, its vertices v (key, pos), its edges p (eid, src, dst) by position.
TRADE = """
    e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS eid, 'c' || o_custkey AS s, 's' || l_suppkey AS d
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    v AS (SELECT key, row_number() OVER (ORDER BY min(seen)) - 1 AS pos
        FROM (SELECT s AS key, 2 * eid AS seen FROM e UNION ALL SELECT d, 2 * eid + 1 FROM e) GROUP BY key),
    p AS (SELECT eid, a.pos AS src, b.pos AS dst FROM e JOIN v a ON a.key = e.s JOIN v b ON b.key = e.d)"""


def made_sql(edges: str) -> str:
    """Tables e, v and p as above, of edges given as SQL of eid, s, d."""
    return f"""
    e AS ({edges}),
    v AS (SELECT key, row_number() OVER (ORDER BY min(seen)) - 1 AS pos
        FROM (SELECT s AS key, 2 * eid AS seen FROM e UNION ALL SELECT d, 2 * eid + 1 FROM e) GROUP BY key),
    p AS (SELECT eid, a.pos AS src, b.pos AS dst FROM e JOIN v a ON a.key = e.s JOIN v b ON b.key = e.d)"""


KNN_SQL = """x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nn AS (SELECT src, dst, r AS rank FROM (
        SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS r
        FROM x a JOIN x b ON a.vec_id <> b.vec_id) WHERE r <= 10),"""
KNN = KNN_SQL + made_sql("SELECT row_number() OVER (ORDER BY src, rank) - 1 AS eid, CAST(src AS VARCHAR) AS s, CAST(dst AS VARCHAR) AS d FROM nn")
#: A community of customers for each nation: each linked to some later ones of its nation, and by few edges to the next nation.
NATIONS = made_sql("""
        SELECT row_number() OVER (ORDER BY a, b) - 1 AS eid, 'c' || a AS s, 'c' || b AS d FROM (
        WITH c AS (SELECT c_custkey AS k, c_nationkey AS g, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)
        SELECT x.k AS a, y.k AS b FROM c x JOIN c y ON y.g = x.g AND y.i > x.i AND (y.i - x.i <= 3 OR y.i % (x.i + 2) = 0)
        UNION ALL SELECT x.k, y.k FROM c x JOIN c y ON y.g = (x.g + 1) % 25 AND x.i = y.i AND x.i % 9 = 0)""")


def steps_sql(n: int) -> str:
    """Tables t0 to tn (vid, pos; from t1 on weight, lw): the trade graph's vertices after each step."""
    out = "t0 AS (SELECT pos AS vid, pos FROM v)"
    for i in range(1, n + 1):
        out += f""",
    w{i} AS (SELECT t.vid, t.pos, coalesce(x.w, 0) AS weight FROM t{i - 1} t LEFT JOIN (SELECT vid, sum(w) AS w FROM (
        SELECT p.src AS vid, exp(-CAST({FACTOR} AS DOUBLE) * b.pos) AS w FROM p JOIN t{i - 1} b ON b.vid = p.dst
        UNION ALL SELECT p.dst, exp(-CAST({FACTOR} AS DOUBLE) * a.pos) FROM p JOIN t{i - 1} a ON a.vid = p.src) GROUP BY vid) x ON x.vid = t.vid),
    q{i} AS (SELECT vid, pos, weight, CASE WHEN weight > 0 THEN round(log2(weight), 9) END AS lw FROM w{i}),
    t{i} AS (SELECT vid, row_number() OVER (ORDER BY lw DESC NULLS LAST, pos) - 1 AS pos, weight, lw FROM q{i})"""
    return out


RUNS = f"""
    c AS (SELECT pos, lw, lw - lag(lw) OVER (ORDER BY pos) AS d0, lead(lw) OVER (ORDER BY pos) - lw AS d1 FROM t3 WHERE lw IS NOT NULL),
    k AS (SELECT pos, lw, coalesce(d0, d1) AS d, coalesce(coalesce(d0, d1) > {THRESHOLD}, false) AS strong FROM c),
    f AS (SELECT *, CASE WHEN strong IS DISTINCT FROM lag(strong) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS change FROM k),
    i AS (SELECT *, sum(change) OVER (ORDER BY pos) AS island FROM f),
    r AS (SELECT min(pos) AS "start", max(pos) + 1 AS "end", strong FROM i GROUP BY island, strong),
    r2 AS (SELECT "start", "end", strong AND "end" - "start" >= {MIN_SIZE} AS strong FROM r),
    f2 AS (SELECT *, CASE WHEN strong IS DISTINCT FROM lag(strong) OVER (ORDER BY "start") THEN 1 ELSE 0 END AS change FROM r2),
    i2 AS (SELECT *, sum(change) OVER (ORDER BY "start") AS island FROM f2),
    m AS (SELECT min("start") AS "start", max("end") AS "end", strong FROM i2 GROUP BY island, strong)"""

MEMBERS = "g AS (SELECT pos AS vid, pos, CASE WHEN pos % 7 = 0 THEN pos // 7 % 20 END AS cluster FROM v)"
COUNTS = """
    b AS (SELECT p.src, p.dst, x.cluster AS sc, y.cluster AS dc FROM p JOIN g x ON x.vid = p.src JOIN g y ON y.vid = p.dst WHERE (x.cluster IS NULL) <> (y.cluster IS NULL)),
    n AS (SELECT CASE WHEN sc IS NULL THEN src ELSE dst END AS vid, coalesce(sc, dc) AS cluster, count(*) AS n FROM b GROUP BY ALL)"""
BEST = "h AS (SELECT vid, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, cluster) AS r FROM n) WHERE r = 1)"


def _state(graph: Graph) -> DataFrame:
    return graph.vertices.select("vid", F.lit(0).cast("long").alias("seg"), F.col("pos").alias("p"))


def _stepped(graph: Graph, n: int) -> DataFrame:
    now = _state(graph)
    for _ in range(n):
        now = staged(step(now.select("vid", "seg", "p"), graph.edges, FACTOR), "step")
    return now


def _members(graph: Graph) -> DataFrame:
    return graph.vertices.select("vid", "pos", F.when(F.col("pos") % 7 == 0, F.floor(F.col("pos") / 7) % 20).alias("cluster"))


# Sources and tables


@query(f"WITH {TRADE} SELECT eid, s AS src, d AS dst FROM e")
def edge_list_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).edge_list()


@query(f"WITH {TRADE} SELECT key, pos FROM v")
def vertex_ids_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).vertices.select("key", "pos")


@query(f"WITH {TRADE} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    one = graph.vertices.agg(F.count("*").alias("n_vertices")).withColumn("one", F.lit(1))
    return one.join(graph.edges.agg(F.count("*").alias("n_edges")).withColumn("one", F.lit(1)), "one").drop("one")


@query(f"WITH {TRADE} SELECT DISTINCT s AS src, d AS dst FROM e")
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).edge_list().select("src", "dst").distinct()


@query("SELECT 'itself' AS other, true AS same UNION ALL SELECT 'edges twice', true UNION ALL SELECT 'reversed', false")
def graph_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    twice = Graph(graph.vertices, graph.edges.unionByName(graph.edges))
    turned = Graph(graph.vertices, graph.edges.select("eid", F.col("dst").alias("src"), F.col("src").alias("dst")))
    rows = [("itself", graph.same_as(graph)), ("edges twice", graph.same_as(twice)), ("reversed", graph.same_as(turned))]
    return spark.createDataFrame(rows, "other string, same boolean")


@query("SELECT 'o' || o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def isolated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    edges = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key("l_orderkey").alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    orders = P.table(spark, sf_dir, "orders").select(key("o_orderkey").alias("key"))
    return Graph.from_edges(edges, "src", "dst", ["l_orderkey", "l_linenumber"], orders).isolated().select("key")


@query("SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem")
def part_supp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.part_supp(spark, sf_dir)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS k FROM lineitem)
    SELECT a.k AS src, b.k AS dst, count(*) AS orders FROM l a JOIN l b ON a.o = b.o AND a.k < b.k GROUP BY ALL""")
def copurchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.copurchase(spark, sf_dir)


@query("""SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation""")
def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.geo(spark, sf_dir)


@query("""SELECT src, dst, count(*) AS times FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events)
    WHERE dst IS NOT NULL GROUP BY ALL""")
def user_event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.user_events(spark, sf_dir)


@query("""SELECT url AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS dst FROM pages""")
def hyperlink_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.hyperlinks(spark, sf_dir)


@query("""WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT src, dst, r AS rank FROM (SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.vec_id) AS r
    FROM x a JOIN x b ON a.vec_id <> b.vec_id) WHERE r <= 10""")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.nearest(P.table(spark, sf_dir, "embeddings")).select("src", "dst", "rank")


def _entity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of JSON for each customer with orders; those of every tenth customer are cut short, those of every eleventh have a number for an id."""
    orders = P.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("serial")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    claims = F.array_join(F.transform("o", lambda x: F.concat(F.lit('{"mainsnak":{"datavalue":{"value":{"id":"O'), x.cast("string"), F.lit('"}}}}'))), ",")
    name = F.when(F.col("serial") % 11 == 0, F.col("serial").cast("string")).otherwise(F.concat(F.lit('"C'), F.col("serial").cast("string"), F.lit('"')))
    line = F.concat(F.lit('{"id":'), name, F.lit(',"labels":{"en":{"value":"customer '), F.col("serial").cast("string"), F.lit('"}},"claims":{"P1":['), claims, F.lit("]}},"))
    return orders.select("serial", F.when(F.col("serial") % 10 == 0, F.left(line, F.lit(30))).otherwise(line).alias("value"))


@query("SELECT 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders WHERE o_custkey % 10 <> 0 AND o_custkey % 11 <> 0")
def json_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(parsed(_entity_lines(spark, sf_dir), "P1")).select("src", "dst")


@query("SELECT DISTINCT 'C' || o_custkey AS key, 'customer ' || o_custkey AS label FROM orders WHERE o_custkey % 10 <> 0 AND o_custkey % 11 <> 0")
def json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(_entity_lines(spark, sf_dir), "P1").select(F.col("id").alias("key"), "label")


@query(rf"""WITH {TRADE} SELECT 0 AS section, 'digraph {{' AS line UNION ALL SELECT 1, chr(9) || key || ' [label="' || key || ' (' || pos || ')"]' FROM v
    UNION ALL SELECT 2, '' UNION ALL SELECT 3, chr(9) || s || ' -> ' || d FROM e UNION ALL SELECT 4, '}}'""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(P.trade_graph(spark, sf_dir)).select("section", "line")


@query(f"""WITH {TRADE} SELECT eid + 1 AS line_no, CASE WHEN eid % 5 = 0 THEN s || ';' ELSE s END AS src, CASE WHEN eid % 5 = 0 OR eid % 3 = 2 THEN NULL ELSE d END AS dst
    FROM e WHERE eid < (SELECT count(*) - 100 FROM e)""")
def dot_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = P.trade_graph(spark, sf_dir).edge_list()
    stop = edges.count() - 100
    text = F.concat(F.lit(" \t"), "src", F.when(F.col("eid") % 5 == 0, "; ").otherwise(""), F.when(F.col("eid") % 2 == 0, " -- ").otherwise(" -> "), "dst", F.when(F.col("eid") % 3 == 2, " [w=1]").otherwise(""), F.when(F.col("eid") % 5 == 0, " ;").otherwise(""))
    lines = edges.select((F.col("eid") + 1).alias("at"), F.when(F.col("eid") == stop, " }").otherwise(text).alias("line")).unionByName(spark.createDataFrame([(0, "a -> b")], "at long, line string"))
    return statements(lines).select(F.col("at").alias("line_no"), "src", "dst")


# Graphs as they are


@query(f"WITH {TRADE} SELECT key, count(*) AS degree FROM (SELECT s AS key FROM e UNION ALL SELECT d FROM e) GROUP BY key")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).degrees()


@query(f"""WITH {TRADE}, n AS (SELECT count(*) AS n, least(1000, count(*)) AS b FROM v)
    SELECT src * b // n AS "row", dst * b // n AS col, count(*) AS "count" FROM p, n GROUP BY ALL""")
def adjacency_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).adjacency_bins()


@query(f"WITH {TRADE} SELECT key, row_number() OVER (ORDER BY md5('7:' || pos), pos) - 1 AS pos FROM v")
def shuffle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).shuffle(7).vertices.select("key", "pos")


@query(f"WITH {TRADE} SELECT key, CASE WHEN pos < 99 THEN (pos + 1) % 99 ELSE pos END AS pos FROM v")
def remap_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.range(99).select(F.col("id").alias("old"), ((F.col("id") + 1) % 99).alias("new"))
    return P.trade_graph(spark, sf_dir).remap(mapping).vertices.select("key", "pos")


@query(f"WITH {TRADE} SELECT eid, src, dst FROM p WHERE src % 3 <> 0 AND dst % 3 <> 0")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    return graph.induced(graph.vertices.where("pos % 3 <> 0")).select("eid", "src", "dst")


@query(f"WITH {TRADE} SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS VARCHAR) AS key, pos FROM v")
def renumbered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).renumbered_keys().vertices.select("key", "pos")


# Scoring and cutting


@query(f"WITH {TRADE}, {steps_sql(1)} SELECT vid, round(weight, 6) AS weight FROM t1")
def step_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    return weights(_state(graph), graph.edges, FACTOR).select("vid", F.round("weight", 6).alias("weight"))


@query(f"WITH {TRADE}, {steps_sql(1)} SELECT v.key, t1.pos, round(weight, 6) AS weight FROM t1 JOIN v ON v.pos = t1.vid")
def cluster_step_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    moved, scores = graph.cluster_step(FACTOR, 0, graph.num_vertices())
    return moved.vertices.join(scores, "pos").select("key", "pos", F.round("weight", 6).alias("weight"))


@query(f"WITH {TRADE}, {steps_sql(3)} SELECT v.key, t3.pos, round(weight, 6) AS weight FROM t3 JOIN v ON v.pos = t3.vid")
def cluster_step_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    moved = _stepped(graph, 3).select("vid", F.col("p").alias("at"), "weight")
    return graph.vertices.join(moved, "vid").select("key", F.col("at").alias("pos"), F.round("weight", 6).alias("weight"))


@query(f"WITH {TRADE}, {steps_sql(3)}, {RUNS} SELECT pos AS p, lw, round(d, 6) AS d, strong FROM k")
def log_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(_stepped(P.trade_graph(spark, sf_dir), 3), THRESHOLD).select("p", "lw", F.round("d", 6).alias("d"), "strong")


@query(f"""WITH {TRADE}, {steps_sql(1)}, d AS (SELECT pos AS p, lw, lw - lag(lw) OVER (ORDER BY pos) AS d1 FROM t1)
    SELECT p, round(d1, 6) + 0.0 AS d1, round(d1 - lag(d1) OVER (ORDER BY p), 6) + 0.0 AS d2 FROM d""")
def weight_laplacians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differences(_stepped(P.trade_graph(spark, sf_dir), 1), "lw", "p", "seg").select("p", (F.round("d1", 6) + 0.0).alias("d1"), (F.round("d2", 6) + 0.0).alias("d2"))


@query(f'WITH {TRADE}, {steps_sql(3)}, {RUNS} SELECT "start", "end", strong FROM r')
def segments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(kinds(_stepped(P.trade_graph(spark, sf_dir), 3), THRESHOLD)).select("start", "end", "strong")


@query(f'WITH {TRADE}, {steps_sql(3)}, {RUNS} SELECT "start", "end", strong FROM m')
def segments_demoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demoted(runs(kinds(_stepped(P.trade_graph(spark, sf_dir), 3), THRESHOLD)), MIN_SIZE).select("start", "end", "strong")


@query(f"""WITH {TRADE}, {steps_sql(3)}, {RUNS}, o AS (SELECT count(*) AS k, min("start") AS "start" FROM m WHERE strong)
    SELECT k, o."start", m."end" FROM o LEFT JOIN m ON m."start" = o."start" AND m.strong""")
def first_strong_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_strong(demoted(runs(kinds(_stepped(P.trade_graph(spark, sf_dir), 3), THRESHOLD)), MIN_SIZE)).select("k", "start", "end")


# Affinity and clusters


@query(f"WITH {TRADE}, {MEMBERS}, {COUNTS} SELECT vid, cluster, n FROM n")
def affinity_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    return affinity_counts(_members(graph), graph.edges)


@query(f"WITH {TRADE}, {MEMBERS}, {COUNTS}, {BEST} SELECT vid, cluster FROM h")
def affinity_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    return best_cluster(affinity_counts(_members(graph), graph.edges))


@query(f"WITH {TRADE}, {MEMBERS}, {COUNTS}, {BEST} SELECT g.vid, g.pos, coalesce(g.cluster, h.cluster, -1) AS cluster FROM g LEFT JOIN h ON h.vid = g.vid")
def affinity_one_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    return affinity_round(_members(graph), graph.edges).select("vid", "pos", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


@query("""SELECT c_nationkey AS cluster_id, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY c_nationkey) - count(*) AS BIGINT) AS "start" FROM customer GROUP BY c_nationkey""")
def cluster_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = ranked(P.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey"), [F.col("c_nationkey"), F.col("c_custkey")], "pos")
    return customers.groupBy(F.col("c_nationkey").alias("cluster_id")).agg(F.count("*").alias("n"), F.min("pos").alias("start"))


@query("SELECT c_nationkey AS cluster_id, string_agg('c' || c_custkey, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY c_nationkey")
def clusters_as_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = P.table(spark, sf_dir, "customer")
    vertices = customers.select(F.col("c_custkey").alias("vid"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.lit(None).cast("string").alias("label"), F.col("c_custkey").alias("pos"))
    clusters = customers.select(F.col("c_nationkey").alias("cluster_id"), F.col("c_custkey").alias("pos"), F.col("c_custkey").alias("vid"))
    return Graph(vertices, Graph.empty(spark).edges, clusters).cluster_lists().select("cluster_id", F.array_join("members", ",").alias("members"))


@query("""WITH c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n FROM customer GROUP BY ALL),
    x AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS t FROM c), i AS (SELECT sum(n * (n - 1) / 2) AS i FROM (SELECT sum(n) AS n FROM c GROUP BY a)), j AS (SELECT sum(n * (n - 1) / 2) AS j FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT round((ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)), 9) AS ari FROM x, i, j""")
def ari_segment_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjusted_rand_index(P.table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey").select(F.round("ari", 9).alias("ari"))


@query(f"""WITH {TRADE}, x AS (SELECT src % 5 AS a, dst % 5 AS b FROM p), y AS (SELECT a, b FROM x UNION ALL SELECT b, a FROM x),
    z AS (SELECT a, count(*) AS n, count(*) FILTER (WHERE a = b) AS i FROM y GROUP BY a) SELECT round(sum(i) / sum(n) - sum(n * n) / (sum(n) * sum(n)), 9) AS modularity FROM z""")
def modularity_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    return modularity(graph, graph.vertices.select("vid", (F.col("pos") % 5).alias("community"))).select(F.round("modularity", 9).alias("modularity"))


# Synthetic graphs


@query("""SELECT i + 100 AS src, j + 100 AS dst FROM range(60) a(i), range(60) b(j)
    WHERE i <> j AND CAST('0x' || substr(md5('5:' || i || ':' || j), 1, 8) AS BIGINT) / 4294967296 < 0.3""")
def dense_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_pairs(spark, 100, 60, 0.3, 5)


@query("""WITH a AS (SELECT i AS a, row_number() OVER (ORDER BY md5('3:' || i), i) - 1 AS x FROM range(30) t(i)), b AS (SELECT i + 30 AS b, row_number() OVER (ORDER BY md5('4:' || (i + 30)), i) - 1 AS y FROM range(20) t(i)),
    u AS (SELECT i * 3 AS ua, 30 + j * 5 AS ub FROM range(10) s(i), range(4) t(j)), w AS (SELECT t, t % 30 AS x, (t + t // 60) % 20 AS y FROM range(140) r(t))
    SELECT a, b FROM (SELECT t, a, b FROM w JOIN a USING (x) JOIN b USING (y) WHERE NOT EXISTS (SELECT 1 FROM u WHERE ua = a AND ub = b) ORDER BY t LIMIT 100)""")
def random_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = spark.range(40).select((F.floor(F.col("id") / 4) * 3).alias("a"), (F.col("id") % 4 * 5 + 30).alias("b"))
    return unused_pairs(spark.range(30).withColumnRenamed("id", "v"), spark.range(30, 50).withColumnRenamed("id", "v"), used, 100, 3)


@query("""WITH l AS (SELECT DISTINCT c_nationkey AS c1, s_nationkey AS c2, o_custkey, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
    c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
    SELECT c1, c2, count(*) AS made, any_value(c.n * s.n) AS possible FROM l JOIN c ON c.k = c1 JOIN s ON s.k = c2 GROUP BY c1, c2""")
def link_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, suppliers = P.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("c1")), P.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c2"))
    lines = P.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = lines.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("c1", "c2", "o_custkey", "l_suppkey").distinct()
    made = links.groupBy("c1", "c2").agg(F.count("*").alias("made"))
    return made.join(customers.groupBy("c1").agg(F.count("*").alias("n1")), "c1").join(suppliers.groupBy("c2").agg(F.count("*").alias("n2")), "c2").select("c1", "c2", "made", (F.col("n1") * F.col("n2")).alias("possible"))


@query()
def scale_free_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder = GraphBuilder(spark, 11)
    builder.add_scale_free_clusters([(400, 20), (150, 10)])
    builder.add_random_links(0, 1, 50)
    return builder.finalize_graph().edge_list()


@query()
def cluster_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    builder = GraphBuilder(spark, 2)
    sizes = [40 + 17 * i % 130 for i in range(24)]
    builder.add_scale_free_clusters([(n, n // 10) for n in sizes])
    builder.add_ring_links([int(0.7 * min(n, sizes[(i + 1) % len(sizes)])) for i, n in enumerate(sizes)])
    planted = builder.membership()
    found = builder.finalize_graph().shuffle(1).cluster(0.01, 5, 0.1, 10).get_clusters()
    return adjusted_rand_index(found.join(planted, "key"), "cluster_id", "cluster")


@query(clustering_sql(TRADE, 0.01, 5, 0.1, 10))
def cluster_full_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.trade_graph(spark, sf_dir).cluster(0.01, 5, 0.1, 10).get_clusters().select("cluster_id", "pos", "key")


@query(clustering_sql(KNN, 0.1, 5, 0.25, 10))
def cluster_full_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.knn_graph(spark, sf_dir).cluster(0.1, 5, 0.25, 10).get_clusters().select("cluster_id", "pos", "key")


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kx, ky: who is linked to whom; src, dst: their names."""
    customers = P.table(spark, sf_dir, "customer").where("c_nationkey IS NOT NULL").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"))
    c = staged(ranked(customers, [F.col("k")], "i", "g"), "customers")
    x, y = (c.select(*[F.col(n).alias(f"{n}{side}") for n in "kgi"]) for side in "xy")
    # Who a customer is linked to follows from its number: the next three, and the multiples of two more than it, of which the first is among those.
    last = c.groupBy(F.col("g").alias("gl")).agg(F.max("i").alias("last"))
    twice = 2 * (F.col("ix") + 2)
    later = F.when(twice <= F.col("last"), F.sequence(twice, F.col("last"), F.col("ix") + 2)).otherwise(F.array().cast("array<bigint>"))
    following = F.concat(F.array(*[F.col("ix") + i for i in (1, 2, 3)]), later)
    inner = x.join(F.broadcast(last), F.col("gx") == F.col("gl")).select("kx", "gx", F.explode(following).alias("to")).join(y, (F.col("gx") == F.col("gy")) & (F.col("to") == F.col("iy")))
    outer = x.join(y, (F.col("gy") == (F.col("gx") + 1) % 25) & (F.col("ix") == F.col("iy"))).where("ix % 9 = 0")
    name = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    return inner.select("kx", "ky").unionByName(outer.select("kx", "ky")).select("kx", "ky", name("kx").alias("src"), name("ky").alias("dst"))


def _nations(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(_nation_edges(spark, sf_dir), "src", "dst", ["kx", "ky"])


@query(clustering_sql(NATIONS, 0.2, 4, 0.2, 3))
def cluster_full_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).cluster(0.2, 4, 0.2, 3).get_clusters().select("cluster_id", "pos", "key")


@query(f"""WITH f AS ({clustering_sql(NATIONS, 0.2, 4, 0.2, 3)})
    SELECT cluster_id, count(*) AS n, min(pos) AS "start", '[' || string_agg('"' || key || '"', ', ' ORDER BY pos) || ']' AS line FROM f GROUP BY cluster_id""")
def cluster_json_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and offsets of found clusters, and their lines of the JSON sink."""
    found = _nations(spark, sf_dir).cluster(0.2, 4, 0.2, 3)
    lists = found.cluster_lists().select("cluster_id", F.concat(F.lit('["'), F.array_join("members", '", "'), F.lit('"]')).alias("line"))
    return lists.join(found.get_clusters().groupBy("cluster_id").agg(F.count("*").alias("n"), F.min("pos").alias("start")), "cluster_id")


@query("SELECT 0 AS n_vertices, 0 AS n_edges")
def empty_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph.empty(spark)
    return spark.createDataFrame([(graph.num_vertices(), graph.num_edges())], "n_vertices long, n_edges long")


@query(f"""WITH {TRADE}, n AS (SELECT count(*) AS n FROM v), new AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM (SELECT 'p' || p_partkey AS key FROM part WHERE p_partkey % 50 = 0))
    SELECT key, pos FROM v UNION ALL SELECT key, n + r FROM new, n""")
def point_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices that are there already, c and s of the graph, keep their numbers; the others follow in order of key."""
    graph = P.trade_graph(spark, sf_dir)
    parts = P.table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"))
    return graph.with_vertices(parts.unionByName(graph.vertices.select("key"))).vertices.select("key", "pos")


@query(f"""WITH {TRADE}, n AS (SELECT count(*) AS n FROM e), x AS (SELECT 'n' || n_nationkey AS s, 'n' || (n_nationkey + 1) % 25 AS d FROM nation),
    k AS (SELECT key, (SELECT count(*) FROM v) + row_number() OVER (ORDER BY key) - 1 AS pos FROM (SELECT DISTINCT s AS key FROM x))
    SELECT n + row_number() OVER (ORDER BY a.pos, b.pos) - 1 AS eid, s AS src, d AS dst FROM x JOIN k a ON a.key = s JOIN k b ON b.key = d, n UNION ALL SELECT eid, s, d FROM e""")
def point_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda c: F.concat(F.lit("n"), c.cast("string"))
    nations = P.table(spark, sf_dir, "nation").select(key(F.col("n_nationkey")).alias("src"), key((F.col("n_nationkey") + 1) % 25).alias("dst"))
    return P.trade_graph(spark, sf_dir).with_edges(nations).edge_list()


@query(f"WITH {TRADE} SELECT key, pos, CASE WHEN key LIKE 'c%' THEN c_name END AS label FROM v LEFT JOIN customer ON key = 'c' || c_custkey")
def labelled_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that come after the edges, as elements of a parallel source do."""
    names = P.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("label"))
    return P.trade_graph(spark, sf_dir).with_labels(names).vertices.select("key", "pos", "label")


@query(f"WITH {TRADE}, w(key) AS (VALUES ('c1'), ('s3'), ('nobody')) SELECT w.key, coalesce(v.pos, -1) AS pos FROM w LEFT JOIN v ON v.key = w.key")
def vertex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = P.trade_graph(spark, sf_dir)
    found = {key: graph.get_vertex_id(key) for key in ("c1", "s3", "nobody")}
    return spark.createDataFrame([(key, -1 if pos is None else pos) for key, pos in found.items()], "key string, pos long")


@query("""WITH n AS (SELECT CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT DISTINCT 'x' || c_nationkey FROM customer),
    r AS (SELECT key, row_number() OVER (ORDER BY try_cast(key AS BIGINT) NULLS LAST, key) - 1 AS r FROM n)
    SELECT a.r AS src, b.r AS dst FROM customer JOIN r a ON a.key = CAST(c_custkey AS VARCHAR) JOIN r b ON b.key = 'x' || c_nationkey""")
def renumbered_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are numbers in text, in order of value, each once."""
    edges = P.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("src"), F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("dst"))
    found = Graph.from_edges(edges, "src", "dst", "c_custkey").renumbered_keys(numeric=True).edge_list()
    return found.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query("""SELECT unnest(['cluster of an empty graph', 'min_size 0', 'steps 0', 'factor not finite', 'range beyond the vertices', 'range turned', 'no such file', 'line of an attribute',
    'writing an edge of an unknown vertex', 'negative seed', 'no nodes', 'more new edges than nodes', 'density above 1', 'link within a cluster', 'no such cluster', 'too many links', 'no such node', 'used up']) AS "call",
    unnest(['ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'OSError', 'ValueError', 'OSError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError', 'ValueError']) AS error""")
def refused_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What arguments that make no sense are answered with."""
    one = spark.createDataFrame([("a", "b", 0)], "s string, d string, o long")
    graph, empty = Graph.from_edges(one, "s", "d", "o"), Graph.empty(spark)
    lost = Graph(graph.vertices.where("key = 'a'"), graph.edges)
    builder, used = GraphBuilder(spark, 1), GraphBuilder(spark, 1)
    for _ in range(2):
        builder.add_dense_cluster(2, 0.0)
    used.finalize_graph()
    bad = spark.createDataFrame([(0, "digraph {"), (1, "[a=b]")], "at long, line string")
    calls = {
        "cluster of an empty graph": lambda: empty.cluster(0.1, 1, 0.1, 1),
        "min_size 0": lambda: graph.cluster(0.1, 1, 0.1, 0),
        "steps 0": lambda: graph.cluster(0.1, 0, 0.1, 1),
        "factor not finite": lambda: graph.cluster_step(float("nan"), 0, 1),
        "range beyond the vertices": lambda: graph.cluster_step(0.1, 0, 3),
        "range turned": lambda: graph.cluster_step(0.1, 2, 1),
        "no such file": lambda: read_dot(spark, "/no/such/file.dot"),
        "line of an attribute": lambda: statements(bad).collect(),
        "writing an edge of an unknown vertex": lambda: write_dot(lost, "/no/such/folder.dot"),
        "negative seed": lambda: GraphBuilder(spark, -1),
        "no nodes": lambda: builder.add_scale_free_cluster(0, 1),
        "more new edges than nodes": lambda: builder.add_scale_free_cluster(2, 3),
        "density above 1": lambda: builder.add_dense_cluster(3, 1.5),
        "link within a cluster": lambda: builder.add_random_link(0, 0),
        "no such cluster": lambda: builder.add_random_link(0, 2),
        "too many links": lambda: builder.add_random_links(0, 1, 5),
        "no such node": lambda: builder.add_link(0, 1, 2, 0),
        "used up": lambda: used.add_dense_cluster(2, 0.5),
    }
    answers = []
    for name, call in calls.items():
        try:
            call()
            answers.append((name, "none"))
        except (ValueError, OSError) as e:
            answers.append((name, "OSError" if isinstance(e, OSError) else "ValueError"))
        except PySparkException as e:
            answers.append((name, "ValueError" if "ValueError" in str(e) else type(e).__name__))
    return spark.createDataFrame(answers, "call string, error string")


@query()
def louvain_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return louvain(P.knn_graph(spark, sf_dir))


@query()
def label_propagation_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_propagation(P.knn_graph(spark, sf_dir))


@query()
def leiden_cpm_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leiden(P.knn_graph(spark, sf_dir))


@query()
def fast_greedy_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_greedy(P.knn_graph(spark, sf_dir))
