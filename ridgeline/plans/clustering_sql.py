"""The full clustering as one recursive SQL statement, to hold the engine against on small graphs."""

from __future__ import annotations


def _step(i: int, factor: float) -> str:
    """Table t{i} (vid, seg, p, lw) from t{i - 1} (vid, seg, p) and the edges u (a, b) within segments."""
    return f"""
        w{i} AS (SELECT t.vid, t.seg, t.p, CASE WHEN x.w > 0 THEN round(log2(x.w), 9) END AS lw FROM t{i - 1} t
            LEFT JOIN (SELECT u.a AS vid, sum(exp(-CAST({factor} AS DOUBLE) * b.p)) AS w FROM u JOIN t{i - 1} b ON b.vid = u.b GROUP BY u.a) x ON x.vid = t.vid),
        t{i} AS (SELECT vid, seg, row_number() OVER (PARTITION BY seg ORDER BY lw DESC NULLS LAST, p) - 1 AS p, lw FROM w{i}),"""


def clustering_sql(tables: str, factor: float, steps: int, threshold: float, min_size: int) -> str:
    """cluster_id, pos, key. tables: SQL of v (key, pos) and p (src, dst: positions); each vertex must have an edge, and more than min_size be there.

    lv holds the levels: vertices whose segment is still worked on have no kind. 0: a segment too small or with too few
    connected vertices; 1: a border run; 2: a strong run. at holds the rounds in which vertices join clusters.
    """
    threshold = -abs(threshold)
    return f"""
    WITH RECURSIVE {tables},
    lv AS (
        SELECT pos AS vid, CAST(0 AS BIGINT) AS seg, CAST(pos AS BIGINT) AS p, CAST(NULL AS INTEGER) AS kind FROM v
        UNION ALL
        (WITH act AS (SELECT vid, seg, p, count(*) OVER (PARTITION BY seg) AS n FROM lv WHERE kind IS NULL),
        ins AS (SELECT p.src, p.dst FROM p JOIN act s ON s.vid = p.src JOIN act d ON d.vid = p.dst WHERE s.seg = d.seg),
        u AS (SELECT src AS a, dst AS b FROM ins UNION ALL SELECT dst, src FROM ins),
        t0 AS (SELECT vid, seg, p FROM act WHERE n > {min_size}),{"".join(_step(i, factor) for i in range(1, steps + 1))}
        c AS (SELECT seg, count(lw) AS c, count(*) AS n FROM t1 GROUP BY seg),
        k AS (SELECT t.seg, t.p, coalesce(coalesce(t.lw - lag(t.lw) OVER o, lead(t.lw) OVER o - t.lw) > {threshold}, false) AS strong
            FROM t{steps} t JOIN c USING (seg) WHERE t.lw IS NOT NULL AND c.c > {min_size} WINDOW o AS (PARTITION BY t.seg ORDER BY t.p)),
        f AS (SELECT *, CASE WHEN strong IS DISTINCT FROM lag(strong) OVER (PARTITION BY seg ORDER BY p) THEN 1 ELSE 0 END AS change FROM k),
        i AS (SELECT *, sum(change) OVER (PARTITION BY seg ORDER BY p) AS run FROM f),
        r AS (SELECT seg, min(p) AS low, max(p) + 1 AS high, strong AND count(*) >= {min_size} AS strong FROM i GROUP BY seg, run, strong),
        g AS (SELECT seg, count(*) FILTER (WHERE strong) AS k, min(low) FILTER (WHERE strong) AS fs, min(high) FILTER (WHERE strong) AS fe FROM r GROUP BY seg),
        e AS (SELECT t.vid, t.seg, t.p, c.n, g.k, g.fs, g.fe, CASE WHEN c.c = c.n AND g.k <= 1 THEN c.n WHEN g.k = 0 THEN c.c ELSE g.fe END AS done,
            g.k > 0 AND t.p >= g.fs AND t.p < g.fe AS first FROM t{steps} t JOIN c USING (seg) JOIN g USING (seg)),
        h AS (SELECT vid, seg, p, CASE WHEN p >= done THEN done WHEN first THEN fs WHEN k > 0 AND p >= fe THEN fe ELSE 0 END AS low,
            CASE WHEN p >= done OR (first AND k > 1) THEN NULL WHEN first THEN 2 ELSE 1 END AS kind FROM e)
        SELECT vid, seg + low, p - low, kind FROM h
        UNION ALL SELECT vid, seg, p, 0 FROM act WHERE n <= {min_size}
        UNION ALL SELECT t1.vid, t1.seg, t1.p, 0 FROM t1 JOIN c USING (seg) WHERE c.c <= {min_size})
    ),
    numbered AS (SELECT seg, row_number() OVER (ORDER BY seg) - 1 AS cluster FROM (SELECT DISTINCT seg FROM lv WHERE kind = 2)),
    und AS (SELECT src AS a, dst AS b FROM p UNION ALL SELECT dst, src FROM p),
    "at" AS (
        SELECT 0 AS round, lv.vid, lv.seg + lv.p AS pos, CASE WHEN kind = 2 THEN cluster END AS cluster FROM lv LEFT JOIN numbered USING (seg) WHERE kind IS NOT NULL
        UNION ALL
        (WITH cur AS (SELECT * FROM "at"),
        near AS (SELECT a.vid, b.cluster, count(*) AS n FROM und JOIN cur a ON a.vid = und.a JOIN cur b ON b.vid = und.b WHERE a.cluster IS NULL AND b.cluster IS NOT NULL GROUP BY ALL),
        best AS (SELECT vid, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, cluster) AS r FROM near) WHERE r = 1),
        x AS (SELECT count(*) FILTER (WHERE cluster IS NULL) AS open, min(pos) FILTER (WHERE cluster IS NULL) AS founder, coalesce(max(cluster) + 1, 0) AS next FROM cur)
        SELECT round + 1, cur.vid, pos, coalesce(cur.cluster, best.cluster, CASE WHEN (SELECT count(*) FROM best) = 0 AND pos = x.founder THEN x.next END)
        FROM cur CROSS JOIN x LEFT JOIN best ON best.vid = cur.vid WHERE x.open > 0)
    ),
    fin AS (SELECT * FROM "at" WHERE round = (SELECT max(round) FROM "at"))
    SELECT cluster AS cluster_id, row_number() OVER (ORDER BY cluster, fin.pos) - 1 AS pos, v.key FROM fin JOIN v ON v.pos = fin.vid"""
