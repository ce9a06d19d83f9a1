"""Registered queries of graph algorithms, link prediction and similarity, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import algorithms as A
from kgloom.operators import links as L
from kgloom.operators import paths as P
from kgloom.operators import relational as R
from kgloom.plans.relational import both, by_folder, written
from kgloom.plans.sql import over
from kgloom.sources import graph as G
from kgloom.sources.stage import staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = over(sql, recursive)
        return f

    return add


def directed(s, d):
    n, e = both(s, d)
    return G.project(n, staged(e))


def undirected(s, d):
    """Unweighted, simple."""
    n, e = both(s, d)
    return L.as_projection(n, staged(G.adjacency(e)))


# --- algorithms --------------------------------------------------------------------------------------------------------


def _rank_sql(divisor: str, rounds: int = 20) -> str:
    parts = [f", od AS MATERIALIZED (SELECT src, count(*) AS o FROM edges GROUP BY 1), sh AS MATERIALIZED (SELECT e.src, dst, 1.0::DOUBLE / ({divisor}) AS w FROM edges e JOIN od ON e.src = od.src), r0 AS (SELECT id, 1 - 0.85::DOUBLE AS score FROM nodes)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, (1 - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(g, 0) AS score FROM nodes n LEFT JOIN (SELECT dst, sum(score * w) AS g FROM sh JOIN r{i} ON src = id GROUP BY 1) ON n.id = dst)")
    return ", ".join(parts) + f" SELECT id, round(score + 3e-8::DOUBLE, 6) AS score FROM r{rounds}"


@query("g1_pagerank", _rank_sql("o"))
def _(s, d):
    return A.pagerank(directed(s, d)).select("id", F.round(F.col("score") + 3e-8, 6).alias("score"))


@query("g2_articlerank", _rank_sql("o + (SELECT count(*) FROM edges)::DOUBLE / (SELECT count(*) FROM nodes)"))
def _(s, d):
    return A.articlerank(directed(s, d)).select("id", F.round(F.col("score") + 3e-8, 6).alias("score"))


def _hits_sql(rounds: int = 20) -> str:
    parts = [", ee AS MATERIALIZED (SELECT src, dst FROM edges), h0 AS (SELECT id, 1.0::DOUBLE AS v FROM nodes)"]
    step = "{to} AS MATERIALIZED (SELECT id, CASE WHEN n > 0 THEN v / n ELSE 0 END AS v FROM (SELECT id, v, sqrt(sum(v * v) OVER ()) AS n FROM (SELECT n.id, coalesce(s, 0) AS v FROM nodes n LEFT JOIN (SELECT {out} AS i, sum(v) AS s FROM ee JOIN {by} ON {inp} = id GROUP BY 1) ON n.id = i)))"
    for i in range(rounds):
        parts.append(step.format(to=f"a{i + 1}", out="dst", inp="src", by=f"h{i}"))
        parts.append(step.format(to=f"h{i + 1}", out="src", inp="dst", by=f"a{i + 1}"))
    return ", ".join(parts) + f" SELECT h.id, round(h.v, 5) AS hub, round(a.v, 5) AS auth FROM h{rounds} h JOIN a{rounds} a ON h.id = a.id"


@query("g5_hits", _hits_sql())
def _(s, d):
    return A.hits(directed(s, d)).select("id", F.round("hub", 5).alias("hub"), F.round("auth", 5).alias("auth"))


def _levels_sql(depth: int = 12) -> str:
    """f0, f1, ...: sources, nodes and numbers of shortest paths by distance."""
    parts = [", nn AS MATERIALIZED (SELECT id AS name, row_number() OVER (ORDER BY id)::INTEGER AS id FROM nodes), nt AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM adj JOIN nn x ON x.name = a JOIN nn y ON y.name = b), f0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS p FROM nn)"]
    for i in range(1, depth + 1):
        old = " ".join(f"ANTI JOIN f{j} USING (s, id)" for j in range(max(0, i - 2), i))
        parts.append(f"f{i} AS MATERIALIZED (SELECT * FROM (SELECT s, b AS id, sum(p) AS p FROM f{i - 1} JOIN nt ON id = a GROUP BY 1, 2) {old})")
    return ", ".join(parts)


def _dependency_sql(depth: int = 12) -> str:
    """d0, d1, ...: the same with dependencies; bt: half of each node's sum; eb: half of the flow over each edge."""
    parts = [f"{_levels_sql(depth)}, d{depth} AS MATERIALIZED (SELECT s, id, p, 0.0::DOUBLE AS d FROM f{depth})"]
    for i in range(depth - 1, -1, -1):
        parts.append(f"h{i} AS MATERIALIZED (SELECT v.s, v.id, w.id AS w, v.p * (1 + w.d) / w.p AS x FROM d{i + 1} w JOIN nt ON a = w.id JOIN f{i} v ON v.s = w.s AND v.id = b), d{i} AS MATERIALIZED (SELECT s, id, p, coalesce(x, 0) AS d FROM f{i} LEFT JOIN (SELECT s, id, sum(x) AS x FROM h{i} GROUP BY 1, 2) USING (s, id))")
    sums, flows = (" UNION ALL ".join(t.format(i) for i in r) for t, r in (("SELECT id, sum(d) AS d FROM d{} GROUP BY 1", range(1, depth + 1)), ("SELECT least(id, w) AS src, greatest(id, w) AS dst, sum(x) AS x FROM h{} GROUP BY 1, 2", range(depth))))
    parts.append(f"bt AS (SELECT name AS id, coalesce(sum(d), 0) / 2 AS score FROM nn LEFT JOIN ({sums}) z ON nn.id = z.id GROUP BY 1)")
    parts.append(f"eb AS (SELECT least(x.name, y.name) AS src, greatest(x.name, y.name) AS dst, sum(z.x) / 2 AS score FROM ({flows}) z JOIN nn x ON x.id = src JOIN nn y ON y.id = dst GROUP BY 1, 2)")
    return ", ".join(parts)


_SCORES: dict[tuple[str, str], tuple] = {}


def betweenness(s, d):
    """Exact scores of the nodes and edges of the folder's graph, written once a session: several queries rank by them."""
    key = (s.sparkContext.applicationId, d)
    if key not in _SCORES:
        g = undirected(s, d)
        nodes, edges = P.betweenness_exact(g)
        nodes = g.nodes.select("id").join(nodes, "id", "left").select("id", (F.coalesce("total", F.lit(0.0)) / 2).alias("score"))
        edges = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.sum("flow") / 2).alias("score"))
        _SCORES[key] = staged(nodes), staged(edges)
    return _SCORES[key]


def _even(c):
    """Rounded where no score lies half-way."""
    return F.round(F.col(c) + 3e-5, 3).alias(c)


@query("g3_betweenness", _dependency_sql() + " SELECT id, round(score + 3e-5, 3) AS score FROM bt")
def _(s, d):
    return betweenness(s, d)[0].select("id", _even("score"))


@query("g3_betweenness_sampled")
def _(s, d):
    return A.betweenness(undirected(s, d), error=0.05)


@query("g4_closeness", _levels_sql() + ", z AS (" + " UNION ALL ".join(f"SELECT s, {i} AS d FROM f{i}" for i in range(1, 13)) + ") SELECT name AS id, round(count(*) * count(*)::DOUBLE / (sum(d) * ((SELECT count(*) FROM nodes) - 1.0)), 6) AS score FROM z JOIN nn ON s = nn.id GROUP BY 1")
def _(s, d):
    return A.closeness(undirected(s, d)).select("id", F.round("score", 6).alias("score"))


@query("g4_closeness_sketched")
def _(s, d):
    return A.closeness(undirected(s, d), lg=12)


@query("g6_degree_centrality", "SELECT nodes.id, d AS degree FROM nodes JOIN deg ON nodes.id = deg.id ORDER BY d DESC, nodes.id LIMIT 10")
def _(s, d):
    n, e = both(s, d)
    return R.top_k(R.degrees(n, e, "distinct"), "degree", 10)


@query("g7_louvain")
def _(s, d):
    return A.louvain(undirected(s, d))


@query("g7_louvain_levels")
def _(s, d):
    return A.louvain_levels(undirected(s, d))


@query("g8_leiden")
def _(s, d):
    return A.leiden(undirected(s, d))


def _lpa_sql(rounds: int = 10) -> str:
    parts = [", l0 AS (SELECT id, id AS c FROM nodes)"]
    for i in range(rounds):
        parts.append(f"l{i + 1} AS MATERIALIZED (SELECT n.id, coalesce(v.c, n.c) AS c FROM l{i} n LEFT JOIN (SELECT a, c FROM (SELECT a, c, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, c) AS k FROM adj JOIN l{i} ON b = id GROUP BY a, c) WHERE k = 1) v ON n.id = v.a)")
    return ", ".join(parts) + f" SELECT id, c AS cluster FROM l{rounds}"


@query("g9_label_propagation", _lpa_sql())
def _(s, d):
    return A.label_propagation(undirected(s, d))


def _wcc_sql(view: str, rounds: int = 16) -> str:
    parts = [", w0 AS (SELECT id, id AS c FROM nodes)"]
    for i in range(rounds):
        parts.append(f"w{i + 1} AS MATERIALIZED (SELECT n.id, least(n.c, coalesce(m, n.c)) AS c FROM w{i} n LEFT JOIN (SELECT a, min(c) AS m FROM {view} JOIN w{i} ON b = id GROUP BY 1) ON n.id = a)")
    return ", ".join(parts) + f", wcc AS (SELECT id, c AS component FROM w{rounds})"


_ALL = ", tr AS MATERIALIZED (SELECT a, b FROM adj)"


@query("g10_wcc", _ALL + _wcc_sql("tr") + " SELECT * FROM wcc")
def _(s, d):
    return A.wcc(undirected(s, d))


@query("a14_island_summary", _ALL + _wcc_sql("tr") + ", z AS (SELECT component, count(*) AS c FROM wcc GROUP BY 1) SELECT count(*) AS components, max(c) AS giant, CAST(sum(c) - max(c) AS BIGINT) AS isolated, count(*) FILTER (WHERE c = 1) AS singles, coalesce((SELECT string_agg(name, ', ' ORDER BY c DESC, f) FROM (SELECT name, c, f FROM (SELECT min(id) AS f, count(*) AS c FROM wcc GROUP BY component ORDER BY 2 DESC, 1 LIMIT 3 OFFSET 1) JOIN nodes ON id = f)), '') || CASE WHEN count(*) > 4 THEN ', and others' ELSE '' END AS sample FROM z")
def _(s, d):
    n, e = both(s, d)
    return R.island_summary(A.wcc(L.as_projection(n, written(e))), n)


@query("a9_health_audit", _ALL + _wcc_sql("tr") + """, v AS (
SELECT 'connectivity' AS metric, max(c)::DOUBLE / (SELECT count(*) FROM nodes) AS value FROM (SELECT count(*) AS c FROM wcc GROUP BY component)
UNION ALL SELECT 'density', round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 4)
UNION ALL SELECT 'completeness', avg(CASE WHEN trim(coalesce(description, '')) <> '' THEN 1.0 ELSE 0 END) FROM nodes
UNION ALL SELECT 'balance', -sum(p * ln(p)) / ln(count(*)) FROM (SELECT count(*)::DOUBLE / (SELECT count(*) FROM nodes) AS p FROM nodes GROUP BY type))
SELECT metric, round(value, 4) AS value, CASE WHEN round(value, 4) >= 0.8 THEN 'healthy' WHEN round(value, 4) >= 0.5 THEN 'warning' ELSE 'critical' END AS status FROM v""")
def _(s, d):
    n, e = both(s, d)
    return R.health_audit(n, e, A.wcc(undirected(s, d)))


@query("g11_modularity", ", c AS (SELECT a, x.folder_id AS ca, y.folder_id AS cb FROM adj JOIN nodes x ON a = x.id JOIN nodes y ON b = y.id), t AS (SELECT count(*)::DOUBLE AS m2 FROM c) SELECT round(sum(i / m2 - (k / m2) * (k / m2)), 6) AS modularity FROM (SELECT ca, count(*) AS k, count(*) FILTER (WHERE ca = cb) AS i FROM c GROUP BY 1), t")
def _(s, d):
    g = undirected(s, d)
    return A.modularity(g, by_folder(g.nodes)).select(F.round("modularity", 6).alias("modularity"))


def _core_sql(rounds: int = 16) -> str:
    parts = [", k0 AS MATERIALIZED (SELECT nodes.id, coalesce(d, 0) AS core FROM nodes LEFT JOIN deg ON nodes.id = deg.id)"]
    for i in range(rounds):
        parts.append(f"h{i} AS (SELECT a, v, sum(count(*)) OVER (PARTITION BY a ORDER BY v DESC) AS n FROM (SELECT a, least(x.core, y.core) AS v FROM adj JOIN k{i} x ON x.id = a JOIN k{i} y ON y.id = b) GROUP BY a, v), k{i + 1} AS MATERIALIZED (SELECT k.id, least(k.core, coalesce(m, 0)) AS core FROM k{i} k LEFT JOIN (SELECT a, max(least(v, n)) AS m FROM h{i} GROUP BY 1) ON a = k.id)")
    return ", ".join(parts) + f" SELECT id, CAST(core AS BIGINT) AS core FROM k{rounds}"


@query("g12_k_core", _core_sql())
def _(s, d):
    return A.k_core(undirected(s, d))


@query("g13_triangles", ", u AS (SELECT a, b FROM adj WHERE a < b), t AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b) SELECT id, count(*) AS triangles FROM (SELECT p AS id FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY 1")
def _(s, d):
    return A.triangles(undirected(s, d))


@query("g14_topological_sort", ", t(id, l) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT dst, l + 1 FROM t JOIN edges ON t.id = src) SELECT id, max(l) AS level, false AS in_cycle FROM t GROUP BY 1", recursive=True)
def _(s, d):
    return A.topological_sort(directed(s, d))


@query("g15_bfs", ", t(id, d) AS (SELECT 'r1', 0 UNION SELECT b, d + 1 FROM t JOIN adj ON id = a WHERE d < 10) SELECT id, min(d) AS depth FROM t GROUP BY 1", recursive=True)
def _(s, d):
    return A.bfs(undirected(s, d), "r1")


@query("g16_dfs_reach", ", t(id) AS (SELECT 'c7' UNION SELECT dst FROM t JOIN edges ON t.id = src) SELECT id FROM t", recursive=True)
def _(s, d):
    return A.bfs(directed(s, d), "c7").select("id")


@query("g17_random_walks")
def _(s, d):
    g = undirected(s, d)
    return A.random_walks(g, g.nodes)


@query("g18_dijkstra", """, w AS (SELECT src, dst, min(coalesce(strength, 1.0)) AS c FROM edges GROUP BY 1, 2),
t(path, id, cost, hops) AS (SELECT 'c7', 'c7', 0.0::DOUBLE, 0 UNION ALL SELECT path || ' > ' || dst, dst, cost + c, hops + 1 FROM t JOIN w ON src = id)
SELECT min_by(path, cost) AS path, min(cost) AS cost, min_by(hops, cost) AS hops FROM t WHERE id IN ('r0', 'r1') GROUP BY id""", recursive=True)
def _(s, d):
    return A.dijkstra(directed(s, d), "c7", "r1").unionByName(A.dijkstra(directed(s, d), "c7", "r0"))


@query("g19_shortest_path", ", t(id, d) AS (SELECT 'c7', 0 UNION SELECT b, d + 1 FROM t JOIN adj ON id = a WHERE d < 10) SELECT min(d) AS hops FROM t WHERE id = 's5'", recursive=True)
def _(s, d):
    n, e = both(s, d)
    return A.shortest_path(G.adjacency(e), "c7", "s5").select("hops")


@query("g20_seed_paths", ", t(s, id, d) AS (SELECT id, id, 0 FROM nodes WHERE type = 'Region' UNION SELECT s, b, d + 1 FROM t JOIN adj ON id = a WHERE d < 9) SELECT s AS a, id AS b, min(d) AS hops FROM t WHERE s < id AND id IN (SELECT id FROM nodes WHERE type = 'Region') GROUP BY 1, 2", recursive=True)
def _(s, d):
    n, e = both(s, d)
    return A.seed_paths(G.adjacency(e), n.filter("type = 'Region'"))


@query("g21_expand", ", t(id, d) AS (SELECT 's5', 0 UNION SELECT b, d + 1 FROM t JOIN adj ON id = a WHERE d < 1) SELECT DISTINCT e.id, src, dst, type FROM edges e WHERE src IN (SELECT id FROM t) OR dst IN (SELECT id FROM t)", recursive=True)
def _(s, d):
    return A.expand(G.graph_edges(s, d), "s5", 2)


@query("g22_trace_outcomes", ", x AS (SELECT src AS source, dst AS o, 1 AS h FROM edges WHERE type IN ('BOUGHT', 'SUPPLIED_BY') AND src LIKE 'c%'), y AS (SELECT source, dst, 2 FROM x JOIN edges ON o = src AND type IN ('BOUGHT', 'SUPPLIED_BY')), u AS (FROM x UNION ALL FROM y) SELECT source, o AS outcome, min(h) AS hops FROM u GROUP BY 1, 2")
def _(s, d):
    n, e = both(s, d)
    return A.trace_outcomes(e, n.filter("type = 'Customer'"), ["BOUGHT", "SUPPLIED_BY"])


@query("g23_cluster_bridges", _dependency_sql() + " SELECT bt.id, round(score + 3e-5, 3) AS score, folder_id AS cluster FROM bt JOIN nodes ON bt.id = nodes.id ORDER BY round(score, 6) DESC, 1 LIMIT 20")
def _(s, d):
    return A.cluster_bridges(by_folder(G.graph_nodes(s, d)), betweenness(s, d)[0]).select("id", _even("score"), "cluster")


@query("g24_edge_betweenness", _dependency_sql() + " SELECT src, dst, round(score + 3e-5, 3) AS score FROM eb")
def _(s, d):
    return betweenness(s, d)[1].select("src", "dst", _even("score"))


def _split(s, d):
    n, e = both(s, d)
    n = staged(n.filter("type in ('Region', 'Nation', 'Supplier')"))
    return A.girvan_newman(L.as_projection(n, staged(G.adjacency(G.scope_edges(e, n)))), 7)


@query("g24_girvan_newman")
def _(s, d):
    return A.best_cut(*_split(s, d)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


@query("g24_dendrogram")
def _(s, d):
    levels, splits = _split(s, d)
    sizes = levels.groupBy("splits", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(splits.select("splits", F.round("modularity", 6).alias("modularity")), "splits")


_CONSTRAINT = """, w AS MATERIALIZED (SELECT a AS i, b AS j, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS p FROM tr),
ind AS (SELECT x.i, y.j, sum(x.p * y.p) AS r FROM w x JOIN w y ON x.j = y.i WHERE x.i <> y.j GROUP BY 1, 2)
SELECT w.i AS id, round(sum((p + coalesce(r, 0)) * (p + coalesce(r, 0))), 5) AS "constraint" FROM w LEFT JOIN ind ON w.i = ind.i AND w.j = ind.j GROUP BY 1"""


@query("g25_constraint", _ALL + _CONSTRAINT)
def _(s, d):
    return A.constraint(undirected(s, d)).select("id", F.round("constraint", 5).alias("constraint"))


_BROKERS = _CONSTRAINT.rsplit(")\nSELECT", 1)[0] + """), cs AS (SELECT w.i AS id, sum((p + coalesce(r, 0)) * (p + coalesce(r, 0))) AS x FROM w LEFT JOIN ind ON w.i = ind.i AND w.j = ind.j GROUP BY 1)
SELECT id, round(x, 5) AS "constraint", round(score + 3e-5, 3) AS score FROM cs JOIN bt USING (id) ORDER BY round(x, 6), round(score, 6) DESC, id LIMIT 10"""


@query("g25_brokers", _dependency_sql() + ", tr AS MATERIALIZED (SELECT a, b FROM adj)" + _BROKERS)
def _(s, d):
    return A.brokers(undirected(s, d), betweenness(s, d)[0]).select("id", F.round("constraint", 5).alias("constraint"), _even("score"))


@query("g25_holes", ", e2 AS (SELECT x.folder_id AS c_src, y.folder_id AS c_dst FROM adj JOIN nodes x ON a = x.id JOIN nodes y ON b = y.id), z AS (SELECT folder_id AS f, count(*)::DOUBLE AS n FROM nodes GROUP BY 1) SELECT c_src, c_dst, count(*) AS n, round(count(*) / (p.n * q.n), 8) AS density FROM e2 JOIN z p ON p.f = c_src JOIN z q ON q.f = c_dst WHERE c_src < c_dst GROUP BY 1, 2, p.n, q.n ORDER BY 4, 1, 2 LIMIT 10")
def _(s, d):
    g = undirected(s, d)
    return A.holes(g, by_folder(g.nodes)).withColumn("density", F.round("density", 8))


# --- links -------------------------------------------------------------------------------------------------------------

PAIRS = _ALL + """, dg AS (SELECT a AS id, count(*) AS d FROM tr GROUP BY 1),
pr AS MATERIALIZED (SELECT x.a, y.b, count(*) AS cn, sum(CASE WHEN v.d > 1 THEN 1 / ln(v.d) ELSE 0 END) AS aa, sum(1.0::DOUBLE / v.d) AS ra FROM tr x JOIN tr y ON x.b = y.a JOIN dg v ON v.id = x.b WHERE x.a < y.b GROUP BY 1, 2),
pu AS (SELECT pr.*, p.d AS da, q.d AS db FROM pr JOIN dg p ON p.id = pr.a JOIN dg q ON q.id = pr.b WHERE NOT EXISTS (SELECT 1 FROM tr z WHERE z.a = pr.a AND z.b = pr.b)),
ap AS (SELECT p.id AS a, q.id AS b, p.d AS da, q.d AS db FROM dg p JOIN dg q ON p.id < q.id WHERE NOT EXISTS (SELECT 1 FROM tr z WHERE z.a = p.id AND z.b = q.id))"""


def adj(s, d):
    return written(G.graph_edges(s, d))


@query("l1_common_neighbors", PAIRS + " SELECT a, b, cn AS score FROM pu ORDER BY cn DESC, a, b LIMIT 20")
def _(s, d):
    return L.lp_common_neighbors(adj(s, d))


@query("l2_adamic_adar", PAIRS + " SELECT a, b, x.name AS name_a, y.name AS name_b, x.type AS type_a, y.type AS type_b, round(aa, 3) AS score FROM pu JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b ORDER BY round(aa, 3) DESC, a, b LIMIT 20")
def _(s, d):
    n, e = both(s, d)
    top = L.lp_adamic_adar(written(e))
    name = lambda c: n.select(F.col("id").alias(c), F.col("name").alias(f"name_{c}"), F.col("type").alias(f"type_{c}"))
    return top.join(name("a"), "a").join(name("b"), "b")


@query("l3_resource_allocation", PAIRS + " SELECT a, b, round(ra, 3) AS score FROM pu ORDER BY 3 DESC, a, b LIMIT 20")
def _(s, d):
    return L.lp_resource_allocation(adj(s, d))


@query("l4_preferential_attachment", PAIRS + " SELECT a, b, da * db AS score FROM ap ORDER BY 3 DESC, a, b LIMIT 20")
def _(s, d):
    return L.lp_preferential_attachment(adj(s, d))


@query("l5_total_neighbors", PAIRS + " SELECT ap.a, ap.b, ap.da + ap.db - coalesce(cn, 0) AS score FROM ap LEFT JOIN pr ON ap.a = pr.a AND ap.b = pr.b ORDER BY 3 DESC, 1, 2 LIMIT 20")
def _(s, d):
    return L.lp_total_neighbors(adj(s, d))


@query("l6_same_type", "SELECT p.id AS a, q.id AS b, p.type, 1.0::DOUBLE AS score FROM nodes p JOIN nodes q ON p.type = q.type AND p.id < q.id WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = p.id AND adj.b = q.id) ORDER BY 1, 2 LIMIT 20")
def _(s, d):
    n, e = both(s, d)
    return L.lp_same_type(n, written(e))


@query("l7_score_pair", PAIRS + """, q AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'BOUGHT') SELECT q.a, q.b, coalesce(cn, 0) AS common_neighbors, round(coalesce(aa, 0), 3) AS adamic_adar, round(coalesce(ra, 0), 3) AS resource_allocation, p.d * w.d AS preferential_attachment, p.d + w.d - coalesce(cn, 0) AS total_neighbors, true AS already_connected FROM q LEFT JOIN pr ON pr.a = q.a AND pr.b = q.b JOIN dg p ON p.id = q.a JOIN dg w ON w.id = q.b""")
def _(s, d):
    e = G.graph_edges(s, d)
    return L.score_pair(written(e), e.filter("type = 'BOUGHT'").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("l8_ghost_lines", PAIRS + " SELECT a, b, least(round(aa, 3), 1.0) AS probability FROM pu WHERE round(aa, 3) >= 0.5")
def _(s, d):
    return L.ghost_lines(adj(s, d))


@query("l9_between_types", PAIRS + ", o AS (SELECT CASE WHEN x.type = 'Customer' THEN a ELSE b END AS a, CASE WHEN x.type = 'Customer' THEN b ELSE a END AS b, round(aa, 3) AS score FROM pu JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE (x.type = 'Customer' AND y.type = 'Supplier') OR (x.type = 'Supplier' AND y.type = 'Customer')) SELECT * FROM o ORDER BY score DESC, a, b LIMIT 20")
def _(s, d):
    n, e = both(s, d)
    return L.lp_between_types(n, written(e), "Customer", "Supplier")


@query("l10_bs_common_neighbors", PAIRS + " SELECT a, b, least(cn / 10.0::DOUBLE, 1.0) AS confidence FROM pu WHERE cn > 1")
def _(s, d):
    return L.bs_common_neighbors(adj(s, d))


@query("l11_bs_adamic_adar", PAIRS + " SELECT a, b, round(least(aa / 5, 1.0), 3) AS confidence FROM pu WHERE round(aa, 3) > 0.5")
def _(s, d):
    return L.bs_adamic_adar(adj(s, d))


@query("l12_bs_preferential", PAIRS + " SELECT a, b, least(da * db / 100.0::DOUBLE, 1.0) AS confidence FROM (SELECT * FROM ap WHERE da > 2 AND db > 2 AND da * db > 10 ORDER BY da * db DESC, a, b LIMIT 50)")
def _(s, d):
    return L.bs_preferential(adj(s, d))


@query("l13_bs_jaccard", PAIRS + " SELECT a, b, round(cn::DOUBLE / (da + db - cn), 3) AS confidence FROM pu WHERE cn > 1 AND round(cn::DOUBLE / (da + db - cn), 3) > 0.1")
def _(s, d):
    return L.bs_jaccard(adj(s, d))


_DISCOVER = PAIRS + """, m AS (
SELECT * FROM (SELECT a, b, least(cn / 10.0::DOUBLE, 1.0) AS confidence, 'common_neighbors' AS method, 0 AS k FROM pu WHERE cn > 1 AND cn >= 5 ORDER BY 3 DESC, a, b LIMIT 50)
UNION ALL SELECT * FROM (SELECT a, b, round(least(aa / 5, 1.0), 3) AS confidence, 'adamic_adar', 1 FROM pu WHERE round(aa, 3) > 0.5 AND round(least(aa / 5, 1.0), 3) >= 0.5 ORDER BY 3 DESC, a, b LIMIT 50)
UNION ALL SELECT * FROM (SELECT a, b, least(s / 100.0::DOUBLE, 1.0) AS confidence, 'preferential_attachment', 2 FROM (SELECT a, b, da * db AS s FROM ap WHERE da > 2 AND db > 2 AND da * db > 10 ORDER BY da * db DESC, a, b LIMIT 50) WHERE s >= 50 ORDER BY 3 DESC, a, b LIMIT 50)),
f AS (SELECT a, b, confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY k) AS n FROM m) WHERE n = 1 ORDER BY confidence DESC, a, b LIMIT 50),
dc AS (SELECT a, b, confidence, method, 'RELATED_TO' AS predicted_type FROM f)"""


@query("l14_discover", _DISCOVER + " SELECT * FROM dc")
def _(s, d):
    n, e = both(s, d)
    return L.discover(n, written(e))


@query("a18_by_category", _DISCOVER + " SELECT predicted_type, count(*) AS n, max(confidence) AS best FROM dc GROUP BY 1")
def _(s, d):
    n, e = both(s, d)
    return R.by_category(L.discover(n, written(e)))


@query("l15_pair_similarity", PAIRS + ", s AS (SELECT pr.a, pr.b, cn::DOUBLE / (p.d + q.d - cn) AS j, cn::DOUBLE / least(p.d, q.d) AS o FROM pr JOIN dg p ON p.id = pr.a JOIN dg q ON q.id = pr.b) SELECT a, b, round(j, 4) AS jaccard, round(o, 4) AS overlap, CAST(NULL AS DOUBLE) AS cosine, round((j + o) / 2, 4) AS combined FROM s")
def _(s, d):
    return L.two_hop_similarity(adj(s, d))


SIMILAR = ", sm AS (SELECT pr.a, pr.b, cn::DOUBLE / (p.d + q.d - cn) AS j FROM pr JOIN dg p ON p.id = pr.a JOIN dg q ON q.id = pr.b)"


@query("l16_node_similarity", PAIRS + SIMILAR + ", t AS (SELECT a, b, j FROM sm WHERE j >= 0.1 UNION ALL SELECT b, a, j FROM sm WHERE j >= 0.1), r AS (SELECT a, b, round(j, 4) AS similarity, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS rank FROM t) SELECT * FROM r WHERE rank <= 10")
def _(s, d):
    return L.node_similarity(adj(s, d))


@query("l17_find_similar", PAIRS + SIMILAR + ", t AS (SELECT CASE WHEN a = 's5' THEN b ELSE a END AS id, round(j, 4) AS similarity FROM sm WHERE a = 's5' OR b = 's5') SELECT * FROM t ORDER BY similarity DESC, id LIMIT 10")
def _(s, d):
    return L.find_similar(adj(s, d), "s5")


@query("l18_similar_pairs", PAIRS + SIMILAR + " SELECT a, b, round(j, 4) AS similarity FROM sm WHERE j >= 0.5 ORDER BY round(j, 4) DESC, a, b LIMIT 100")
def _(s, d):
    return L.similar_pairs(adj(s, d))


@query("l19_knn", ", v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT query, id, round(c, 5) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(c, 6) DESC, id) AS rank FROM p) SELECT * FROM r WHERE rank <= 10")
def _(s, d):
    v = G.read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return L.knn(v, v.filter("id % 50 = 0"))


@query("l20_degree_distribution", ", h AS (SELECT d, count(*) AS n FROM deg GROUP BY 1), f AS (SELECT sum(n) AS t, sum(n * ln(d / 0.5)) AS lg, max(d) AS most, sum(d * n)::DOUBLE / sum(n) AS mean FROM h), a AS (SELECT *, 1 + t / lg AS alpha FROM f), k AS (SELECT max(abs(c / t - (1 - pow((d + 0.5) / 0.5, 1 - alpha)))) AS ks FROM (SELECT d, sum(n) OVER (ORDER BY d) AS c FROM h), a) SELECT CAST(t AS BIGINT) AS nodes, round(mean, 4) AS mean, most, round(alpha, 4) AS alpha, round(ks, 4) AS ks FROM a, k")
def _(s, d):
    n, e = both(s, d)
    return L.degree_distribution(R.degrees(n, e, "distinct"))


@query("l21_completeness", "SELECT type, count(*) AS n, round(avg(CASE WHEN trim(coalesce(description, '')) <> '' THEN 1.0 ELSE 0 END), 4) AS described, round(avg(CASE WHEN d IS NULL THEN 0 ELSE 1.0 END), 4) AS connected, round(avg(coalesce(d, 0)), 4) AS mean_edges FROM nodes LEFT JOIN inc ON nodes.id = inc.id GROUP BY 1")
def _(s, d):
    return L.completeness(*both(s, d))


@query("l22_incomplete_entities", """, j AS (SELECT nodes.*, coalesce(d, 0) AS d FROM nodes LEFT JOIN inc ON nodes.id = inc.id), p AS (SELECT type, quantile_cont(CAST(d AS DOUBLE), 0.25) AS p25 FROM j GROUP BY 1),
r AS (SELECT id, array_to_string(list_filter([CASE WHEN trim(coalesce(name, '')) = '' THEN 'no name' END, CASE WHEN trim(coalesce(description, '')) = '' THEN 'no description' END, CASE WHEN d = 0 THEN 'isolated' END, CASE WHEN d < p25 THEN 'few connections' END, CASE WHEN coalesce(confidence, 0) < 0.1 THEN 'low confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j JOIN p USING (type))
SELECT id, reasons, round(1 - (CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, ',')) END) / 5.0::DOUBLE, 2) AS score FROM r WHERE round(1 - (CASE WHEN reasons = '' THEN 0 ELSE len(string_split(reasons, ',')) END) / 5.0::DOUBLE, 2) < 0.7""")
def _(s, d):
    return L.incomplete_entities(*both(s, d))


@query("l23_missing_transitive", ", e2 AS (SELECT DISTINCT src, dst FROM edges) SELECT x.src AS a, y.dst AS c, count(*) AS n FROM e2 x JOIN e2 y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM e2 z WHERE z.src = x.src AND z.dst = y.dst) GROUP BY 1, 2")
def _(s, d):
    return L.missing_transitive(G.graph_edges(s, d))


@query("l23_type_lift", ", t AS (SELECT x.type AS ta, y.type AS tb, count(*) AS n FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id GROUP BY 1, 2) SELECT ta, tb, n, round(n * sum(n) OVER ()::DOUBLE / (sum(n) OVER (PARTITION BY ta) * sum(n) OVER (PARTITION BY tb)), 4) AS lift FROM t")
def _(s, d):
    return L.type_lift(*both(s, d))


@query("l23_co_mentions", ", m AS (SELECT DISTINCT 'c' || o_custkey AS chunk, 'p' || l_partkey AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT x.id AS a, y.id AS b, count(*) AS n FROM m x JOIN m y ON x.chunk = y.chunk AND x.id < y.id WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = x.id AND adj.b = y.id) GROUP BY 1, 2 HAVING count(*) >= 4")
def _(s, d):
    lines = G.read_table(s, d, "lineitem").join(G.read_table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return L.co_mentions(lines.select(F.concat(F.lit("c"), "o_custkey").alias("chunk_id"), F.concat(F.lit("p"), "l_partkey").alias("id")), G.graph_edges(s, d), 4)


@query("l23_missing_semantic", ", v AS (SELECT 's' || vec_id AS id, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT q.id AS a, v.id AS b, list_cosine_similarity(q.e, v.e) AS c FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.id <> v.id), r AS (SELECT a, b, round(c, 5) AS similarity, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS rank FROM p) SELECT a, b, similarity FROM r WHERE rank <= 10 AND similarity >= 0.3 AND NOT EXISTS (SELECT 1 FROM adj WHERE adj.a = r.a AND adj.b = r.b)")
def _(s, d):
    v = G.read_table(s, d, "embeddings").select(F.concat(F.lit("s"), "vec_id").alias("id"), "vec_id", "embedding")
    return L.missing_semantic(v.select("id", "embedding"), G.graph_edges(s, d), v.filter("vec_id % 50 = 0").select("id", "embedding"), 0.3)


@query("l23_knn_graph")
def _(s, d):
    return L.knn_graph(G.read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))


@query("l24_power_law_test")
def _(s, d):
    n, e = both(s, d)
    return L.power_law_test(R.degrees(n, e, "distinct"))


@query("l24_chi_square", ", n AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT x, sum(n) AS r FROM n GROUP BY 1), c AS (SELECT y, sum(n) AS c FROM n GROUP BY 1), e AS (SELECT r.x, c.y, coalesce(n, 0) AS n, r * c / (SELECT sum(n)::DOUBLE FROM n) AS e FROM r CROSS JOIN c LEFT JOIN n ON n.x = r.x AND n.y = c.y) SELECT round(sum((n - e) * (n - e) / e), 4) AS statistic, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS degrees FROM e")
def _(s, d):
    return L.chi_square(G.read_table(s, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("l24_chi_square_test")
def _(s, d):
    n = G.read_table(s, d, "lineitem").select("l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return L.chi_square_test(n, ["l_linenumber"], "returned").select("feature", F.round("statistic", 4).alias("statistic"), F.round("pValue", 6).alias("p_value"), "significant")


@query("l24_pearson", "SELECT round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem")
def _(s, d):
    return L.correlation(G.read_table(s, d, "lineitem"), "l_quantity", "l_extendedprice")


@query("l24_spearman", ", r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT round(corr(x, y), 4) AS r FROM r")
def _(s, d):
    return L.correlation(G.read_table(s, d, "lineitem"), "l_quantity", "l_discount", "spearman")
