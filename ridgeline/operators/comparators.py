"""Well-known community algorithms to compare with, as DataFrame rounds: label propagation, Louvain, Leiden, fast greedy, walktrap.

All take edges as undirected; parallel edges add up and self-loops count for degrees only. Vertices without edges stay
alone. Results are (vid, community), a community named by one of its vertices; an empty graph gives no rows. Rounds go on
until nothing changes any more; ties are broken by numbers or their hashes, so results are the same on any cluster.
Moves, all levels of Louvain and greedy merges of few enough links are made in one task (local_moves), with equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.staging import importable, staged
from .local_moves import levelled, merged_greedily, moved

#: A change of quality, in edges, below which it is taken for rounding.
TINY = 1e-6
#: Links, each in both directions, whose rounds one task may make in numpy.
TASK_LINKS = 4_000_000


def _quantised(gain: Column) -> Column:
    """Rounded by the same operations of doubles as in local_moves."""
    return F.rint(gain * 1e9) / 1e9


def _in_one_task(links: DataFrame, state: DataFrame, run) -> DataFrame:
    """(v, c) that run(a, b, w, k, c, names) gives of links (a, b, w) and state (v, k, c), all numbered in order of v; names: the vs."""

    def task(table: pa.Table) -> pa.Table:
        link, a, b, w = (table[x].to_numpy() for x in ("link", "a", "b", "w"))
        order = np.argsort(a[~link])
        names = a[~link][order]
        number = [np.searchsorted(names, x) for x in (a[link], b[link], b[~link][order])]
        found = run(number[0], number[1], w[link], w[~link][order], number[2], names)
        return pa.table({"v": names, "c": names[found]})

    importable(links.sparkSession)
    rows = links.select(F.lit(True).alias("link"), "a", "b", "w").unionByName(state.select(F.lit(False).alias("link"), F.col("v").alias("a"), F.col("c").alias("b"), F.col("k").alias("w")))
    return rows.withColumn("task", F.lit(0)).groupBy("task").applyInArrow(task, "v long, c long")


def symmetric(graph: Graph) -> DataFrame:
    """a, b, w: both directions of each pair of neighbours with the number of its edges; a self-loop once, with two ends."""
    both = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x"))
    return both.groupBy(F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").cast("double").alias("w"))


def label_propagation(graph: Graph, task_links: int = TASK_LINKS) -> DataFrame:
    """Each round some vertices take the label that most of their edges lead to (ties: their own, else the lowest).

    A vertex changes only to a label with more edges than its own, so the edges within labels grow with each change of one
    vertex. Half of those that gain change at a time; where they spoil each other's gain, those between different labels.
    """
    links = staged(symmetric(graph).where("a <> b"), "links")
    start = graph.vertices.select(F.col("vid").alias("v"), F.lit(0.0).alias("k"), F.col("vid").alias("c"))
    return _moves(links, start, 0.0, task_links).select(F.col("v").alias("vid"), F.col("c").alias("community"))


def modularity(graph: Graph, communities: DataFrame) -> DataFrame:
    """One row with modularity of (vid, community)."""
    links = symmetric(graph).join(communities.select(F.col("vid").alias("a"), F.col("community").alias("ca")), "a").join(communities.select(F.col("vid").alias("b"), F.col("community").alias("cb")), "b")
    sums = links.groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = F.sum("all")
    return sums.agg((F.sum("inside") / total - F.sum(F.col("all") * F.col("all")) / (total * total)).alias("modularity"))


def _quality(links: DataFrame, state: DataFrame, penalty: float) -> float:
    """Ends of edges within communities of state (v, k, c), less penalty times the square of each community's sum of k."""
    a, b = (state.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    inside = links.join(a, "a").join(b, "b").where("ca = cb").agg(F.sum("w").alias("x"))
    sizes = state.groupBy("c").agg(F.sum("k").alias("s")).agg(F.sum(F.col("s") * F.col("s") * -penalty).alias("x"))
    return inside.unionAll(sizes).agg(F.sum("x")).first()[0] or 0.0


def _gains(links: DataFrame, state: DataFrame, penalty: float) -> DataFrame:
    """v, k, c, n, gain: for each vertex of state (v, k, c) its own community and those of its neighbours, and what it adds to each."""
    sizes = state.groupBy(F.col("c").alias("s")).agg(F.sum("k").alias("size"))
    near = links.where("a <> b").join(state.select(F.col("v").alias("b"), F.col("c").alias("n")), "b").select("a", "n", "w")
    near = near.unionByName(state.select(F.col("v").alias("a"), F.col("c").alias("n"), F.lit(0.0).alias("w"))).groupBy("a", "n").agg(F.sum("w").alias("w"))
    near = near.join(sizes, F.col("n") == F.col("s")).join(state, F.col("a") == F.col("v"))
    rest = F.col("size") - F.when(F.col("n") == F.col("c"), F.col("k")).otherwise(0.0)
    return near.select("v", "k", "c", "n", _quantised(F.col("w") - F.lit(penalty) * F.col("k") * rest).alias("gain"))


def _apart(wishes: DataFrame) -> DataFrame:
    """v: of wishes (v, c, n, more) those that gain most for both communities they touch, so that none touches another's."""
    touched = wishes.select("v", F.explode(F.array("c", "n")).alias("g"), F.struct(F.col("more"), -F.col("v")).alias("rank"))
    return touched.groupBy("g").agg(F.max_by("v", "rank").alias("v")).groupBy("v").agg(F.count("*").alias("ends")).where("ends = 2").select("v")


def _moves(links: DataFrame, state: DataFrame, penalty: float, task_links: int = TASK_LINKS) -> DataFrame:
    """state (v, k, c) with vertices moved to the neighbouring community that gains most, until no move raises the quality.

    Half of those that gain move at once. Where they spoil each other's gain, only moves between different communities are
    made instead, whose gains add up; so the quality grows with each round, and the rounds come to an end.
    """
    state, value, bold, i = staged(state, "state"), None, True, 0
    if links.count() + state.count() <= task_links:
        done = _in_one_task(links, state, lambda a, b, w, k, c, names: moved(a, b, w, k, c, names, penalty, TINY))
        return staged(state.select("v", "k").join(done, "v").select("v", "k", "c"), "state")
    own, wants = F.col("n") == F.col("c"), F.col("more") > TINY
    while True:
        best = _gains(links, state, penalty).groupBy("v", "k", "c").agg(F.max_by(F.struct("n", "gain"), F.struct("gain", own, -F.col("n"))).alias("x"), F.max(F.when(own, F.col("gain"))).alias("was"))
        wish = staged(best.select("v", "k", "c", F.col("x.n").alias("n"), (F.col("x.gain") - F.col("was")).alias("more")), "wishes")
        wishes = wish.where(wants).count()
        if not wishes:
            return state
        if bold:
            turn = F.pmod(F.xxhash64("v", F.lit(i)), F.lit(2)) == 0
            after, i = wish.select("v", "k", F.when(wants & turn, F.col("n")).otherwise(F.col("c")).alias("c")), i + 1
            value, now = _quality(links, state, penalty) if value is None else value, _quality(links, after, penalty)
            if now > value + TINY:
                state, value = after, now
                continue
        chosen = staged(_apart(wish.where(wants)).withColumnRenamed("v", "u"), "chosen")
        state, value = staged(wish.join(chosen, F.col("v") == F.col("u"), "left").select("v", "k", F.when(F.col("u").isNotNull(), F.col("n")).otherwise(F.col("c")).alias("c")), "state"), None
        bold = wishes > 4 * chosen.count()


def _merged(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links between the groups r of names (v, r)."""
    a, b = (names.select(F.col("v").alias(x), F.col("r").alias(f"r{x}")) for x in "ab")
    return staged(links.join(a, "a").join(b, "b").groupBy(F.col("ra").alias("a"), F.col("rb").alias("b")).agg(F.sum("w").alias("w")), "links")


def _refined(links: DataFrame, state: DataFrame, penalty: float) -> DataFrame:
    """(v, r): each community of state (v, k, c) as connected groups, grown from single vertices within it.

    A vertex that is still alone joins the group it gains most by, if both are well connected with the rest of their
    community. In a round one half of the names may move and the other be joined, so a group's own vertex never leaves it.
    """
    a, b = (state.select(F.col("v").alias(x), F.col("c").alias(f"c{x}")) for x in "ab")
    inner = staged(links.where("a <> b").join(a, "a").join(b, "b").where("ca = cb").select("a", "b", "w"), "inner")
    whole = state.groupBy(F.col("c").alias("g")).agg(F.sum("k").alias("all"))
    groups, i = staged(state.select("v", "k", "c", F.col("v").alias("r")), "groups"), 0
    while True:
        ra, rb = (groups.select(F.col("v").alias(x), F.col("r").alias(f"r{x}")) for x in "ab")
        out = inner.join(ra, "a").join(rb, "b").where("ra <> rb").groupBy(F.col("ra").alias("r")).agg(F.sum("w").alias("out"))
        sizes = groups.groupBy("r", "c").agg(F.count("*").alias("m"), F.sum("k").alias("size")).join(whole, F.col("c") == F.col("g")).join(out, "r")
        sound = F.col("out") >= F.lit(penalty) * F.col("size") * (F.col("all") - F.col("size")) - TINY
        sizes = staged(sizes.where(sound).select("r", "m"), "sound")
        gains = _gains(inner, groups.select("v", "k", F.col("r").alias("c")), penalty).where((F.col("n") != F.col("c")) & (F.col("gain") > TINY))
        gains = gains.join(sizes.where("m = 1").select(F.col("r").alias("v")), "v", "left_semi").join(sizes.select(F.col("r").alias("n")), "n", "left_semi")
        gains = staged(gains.select("v", "n", "gain"), "gains")
        if gains.limit(1).count() == 0:
            return groups.select("v", "r")

        def side(name: str, i: int = i) -> Column:
            return F.pmod(F.xxhash64(name, F.lit(i)), F.lit(2))

        best = gains.where((side("v") == 1) & (side("n") == 0)).groupBy(F.col("v").alias("u")).agg(F.max_by("n", F.struct("gain", -F.col("n"))).alias("n"))
        groups, i = staged(groups.join(best, F.col("v") == F.col("u"), "left").select("v", "k", "c", F.coalesce("n", "r").alias("r")), "groups"), i + 1


def _levels(graph: Graph, resolution: float, by_degree: bool, refine: bool, task_links: int = TASK_LINKS) -> DataFrame:
    """Moves of vertices, then of the groups so far, until no two groups are joined any more."""
    links = staged(symmetric(graph), "links")
    total = links.agg(F.sum("w")).first()[0] or 0.0
    found = graph.vertices.select("vid", F.col("vid").alias("community"))
    if not total:
        return found
    penalty = resolution / total if by_degree else resolution
    degree = links.groupBy(F.col("a").alias("v")).agg((F.sum("w") if by_degree else F.lit(1.0)).alias("k"))
    state = degree.select("v", "k", F.col("v").alias("c"))
    while True:
        if not refine and links.count() + state.count() <= task_links:
            last = _in_one_task(links, state, lambda a, b, w, k, c, names: levelled(a, b, w, k, c, names, penalty, TINY)).withColumnRenamed("c", "r")
            return staged(found.join(last, F.col("community") == F.col("v"), "left").select("vid", F.coalesce("r", "community").alias("community")), "found")
        state = _moves(links, state, penalty, task_links)
        names = _refined(links, state, penalty) if refine else state.select("v", F.col("c").alias("r"))
        if names.where("v <> r").limit(1).count() == 0:
            last = state.select("v", F.col("c").alias("r"))
            return staged(found.join(last, F.col("community") == F.col("v"), "left").select("vid", F.coalesce("r", "community").alias("community")), "found")
        found = staged(found.join(names, F.col("community") == F.col("v"), "left").select("vid", F.coalesce("r", "community").alias("community")), "found")
        links = _merged(links, names)
        groups = state.join(names, "v").groupBy("r", "c").agg(F.sum("k").alias("k"))
        heads = groups.groupBy(F.col("c").alias("g")).agg(F.min("r").alias("head"))
        state = groups.join(heads, F.col("c") == F.col("g")).select(F.col("r").alias("v"), "k", F.col("head").alias("c"))


def louvain(graph: Graph, resolution: float = 1.0, task_links: int = TASK_LINKS) -> DataFrame:
    """Modularity raised by moves of vertices, then of the communities so far, until none moves any more."""
    return _levels(graph, resolution, by_degree=True, refine=False, task_links=task_links)


def leiden(graph: Graph, resolution: float = 1.0, objective: str = "cpm") -> DataFrame:
    """Like Louvain, but levels are built from connected groups within communities, which can part again.

    objective: "modularity", or "cpm", the edges within communities less resolution times their pairs of vertices. With
    "cpm" and 1, the setting commonly preset, hardly any vertex gains by a move, so nearly all stay alone.
    """
    if objective not in ("cpm", "modularity"):
        raise ValueError("objective must be cpm or modularity")
    return _levels(graph, resolution, by_degree=objective == "modularity", refine=True)


def _mutual(pairs: DataFrame, score: str, i: int) -> DataFrame:
    """v, r: the two ends of pairs (a < b) that both score highest with each other, under the lesser of them; ties go by hash."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("v"), "a", "b", F.struct(F.col(score), F.xxhash64("a", "b", F.lit(i)), -F.col("a"), -F.col("b")).alias("rank"))
    best = both.groupBy("v").agg(F.max_by(F.struct("a", "b"), "rank").alias("p"))
    chosen = best.groupBy("p").agg(F.count("*").alias("n")).where("n = 2")
    return staged(chosen.select(F.explode(F.array("p.a", "p.b")).alias("v"), F.col("p.a").alias("r")), "merges")


def _named(merges: DataFrame, all_names: DataFrame) -> DataFrame:
    """(v, r) of all names (v), those that don't merge under their own."""
    return staged(all_names.join(merges, "v", "left").select("v", F.coalesce("r", "v").alias("r")), "names")


def fast_greedy(graph: Graph, task_links: int = TASK_LINKS) -> DataFrame:
    """Communities merge with the neighbour that raises modularity most, while any merge raises it.

    All pairs that are each other's best merge in one round, where the serial algorithm takes one pair after the other.
    """
    links = staged(symmetric(graph), "links")
    total = links.agg(F.sum("w")).first()[0] or 0.0
    found, i = graph.vertices.select("vid", F.col("vid").alias("community")), 0
    while total:
        size = staged(links.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("k")), "sizes")
        ka, kb = (size.select(F.col("v").alias(x), F.col("k").alias(f"k{x}")) for x in "ab")
        if links.count() <= task_links:
            merged = _in_one_task(links.where("a < b"), size.select("v", "k", F.col("v").alias("c")), lambda a, b, w, k, c, names, i=i: merged_greedily(a, b, w, k, names, total, TINY, i))
            return staged(found.join(merged, F.col("community") == F.col("v"), "left").select("vid", F.coalesce("c", "community").alias("community")), "found")
        gain = _quantised(F.col("w") - F.col("ka") * F.col("kb") / total)
        merges = _mutual(links.where("a < b").join(ka, "a").join(kb, "b").select("a", "b", gain.alias("gain")).where(F.col("gain") > TINY), "gain", i)
        if merges.limit(1).count() == 0:
            break
        names, i = _named(merges, size.select("v")), i + 1
        links = _merged(links, names)
        found = staged(found.join(names, F.col("community") == F.col("v"), "left").select("vid", F.coalesce("r", "community").alias("community")), "found")
    return found


def _walks(links: DataFrame, steps: int) -> DataFrame:
    """c, j, x: the chance that a walk of `steps` from c ends at j, over the root of j's degree. Each vertex has a loop of its mean link."""
    links = links.where("a <> b")
    loops = links.groupBy("a").agg(F.avg("w").alias("w")).select("a", F.col("a").alias("b"), "w")
    links = links.unionByName(loops)
    degree = staged(links.groupBy(F.col("a").alias("v")).agg(F.sum("w").alias("d")), "degrees")
    step = staged(links.join(degree, F.col("a") == F.col("v")).select("a", "b", (F.col("w") / F.col("d")).alias("p")), "steps")
    at = step.select(F.col("a").alias("c"), F.col("b").alias("j"), F.col("p").alias("x"))
    for _ in range(steps - 1):
        at = staged(at.join(step, F.col("j") == F.col("a")).groupBy("c", "b").agg(F.sum(F.col("x") * F.col("p")).alias("x")).withColumnRenamed("b", "j"), "walks")
    return at.join(degree, F.col("j") == F.col("v")).select("c", "j", (F.col("x") / F.sqrt("d")).alias("x"))


def _walk_distances(pairs: DataFrame, walks: DataFrame, sizes: DataFrame) -> DataFrame:
    """a, b, near: pairs with the distance of their walks, negated, as the growth of variance that merging them would bring."""
    xa, xb = (walks.select(F.col("c").alias(x), "j", F.col("x").alias(f"x{x}")) for x in "ab")
    norms = walks.groupBy(F.col("c").alias("g")).agg(F.sum(F.col("x") * F.col("x")).alias("q")).join(sizes.select(F.col("v").alias("g"), "n"), "g")
    na, nb = (norms.select(F.col("g").alias(x), F.col("q").alias(f"q{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    dots = pairs.join(xa, "a").join(xb, ["b", "j"]).groupBy("a", "b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    far = (F.col("qa") + F.col("qb") - 2 * F.coalesce("dot", F.lit(0.0))) * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    return pairs.join(dots, ["a", "b"], "left").join(na, "a").join(nb, "b").select("a", "b", F.round(-far, 12).alias("near"))


def walktrap(graph: Graph, steps: int = 4) -> DataFrame:
    """Neighbouring communities merge whose short random walks end alike; of the tree of merges, the cut of highest modularity.

    All pairs that are each other's nearest merge in one round, until no neighbours are left. A community keeps the better of
    itself as a whole and the best cuts of its two parts, so no tree is gathered. The table of walks has a row for each vertex
    and each other one within `steps` links, which on graphs with hubs grows with the square of the vertices.
    """
    if steps < 1:
        raise ValueError("steps must be at least 1")
    links = staged(symmetric(graph), "links")
    total = links.agg(F.sum("w")).first()[0] or 0.0
    found = graph.vertices.select("vid", F.col("vid").alias("at"), F.col("vid").alias("community"))
    if not total or links.where("a <> b").limit(1).count() == 0:
        return found.select("vid", "community")
    walks, i = staged(_walks(links, steps), "walks"), 0
    share = F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)) / total - (F.sum("w") / total) ** 2
    state = staged(links.groupBy(F.col("a").alias("v")).agg(F.lit(1.0).alias("n"), share.alias("best")), "state")
    near = staged(_walk_distances(links.where("a < b").select("a", "b"), walks, state), "near")
    while True:
        merges = _mutual(near, "near", i)
        if merges.limit(1).count() == 0:
            return staged(found.select("vid", "community"), "found")
        names, i = _named(merges, state.select("v")), i + 1
        links = _merged(links, names)
        before = state.select("v", F.col("n").alias("was"))
        parts = state.join(names, "v").groupBy("r").agg(F.sum("n").alias("n"), F.sum("best").alias("parts"), F.count("*").alias("m"))
        own = links.groupBy(F.col("a").alias("v")).agg(share.alias("own"))
        state = staged(parts.join(own, F.col("r") == F.col("v")).select("v", "n", F.greatest("own", "parts").alias("best"), ((F.col("m") > 1) & (F.col("own") >= F.col("parts") - 1e-12)).alias("whole"), (F.col("m") > 1).alias("new")), "state")
        mark = names.join(state.select(F.col("v").alias("r"), "whole"), "r")
        found = staged(found.join(mark, F.col("at") == F.col("v"), "left").select("vid", F.coalesce("r", "at").alias("at"), F.when(F.col("whole"), F.col("r")).otherwise(F.col("community")).alias("community")), "found")
        share_of = names.join(before, "v").join(state.select(F.col("v").alias("r"), "n"), "r").select(F.col("v").alias("c"), "r", (F.col("was") / F.col("n")).alias("part"))
        walks = staged(walks.join(share_of, "c").groupBy("r", "j").agg(F.sum(F.col("x") * F.col("part")).alias("x")).withColumnRenamed("r", "c"), "walks")
        na, nb = (state.select(F.col("v").alias(x), F.col("new").alias(f"n{x}")) for x in "ab")
        pairs = links.where("a < b").select("a", "b").join(na, "a").join(nb, "b")
        kept = near.join(pairs.where("NOT na AND NOT nb").select("a", "b"), ["a", "b"], "left_semi")
        near = staged(kept.unionByName(_walk_distances(pairs.where("na OR nb").select("a", "b"), walks, state)), "near")


#: The names under which published comparisons list them; three of those names stand for one call.
COMPARATORS = {"louvain": louvain, "leiden": leiden, "fast_greedy": fast_greedy, "walktrap": walktrap, "random_walk": walktrap, "infomap": walktrap, "label_propagation": label_propagation}
