"""Registered queries of the relational operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import columns as C
from kgloom.operators import links as L
from kgloom.operators import relational as R
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


def both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.graph_nodes(spark, d), G.graph_edges(spark, d)


def _joined(df: DataFrame) -> DataFrame:
    """Arrays as text, so that results compare as plain values."""
    return df.select(*(F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))


_N = "id, name, type, folder_id, array_to_string(file_ids, ',') AS file_ids, description, confidence"
_E = "id, src, dst, type, strength, array_to_string(file_ids, ',') AS file_ids"


@query("s1_scope_folder", f"SELECT {_N} FROM nodes WHERE folder_id = 'f1'")
def _(s, d):
    return _joined(G.scope_nodes(G.graph_nodes(s, d), folder_id="f1"))


@query("s1_scope_file", f"SELECT {_N} FROM nodes WHERE list_contains(file_ids, 'shared')")
def _(s, d):
    return _joined(G.scope_nodes(G.graph_nodes(s, d), file_id="shared"))


@query("s2_scope_edges", f", s AS (SELECT id FROM nodes WHERE folder_id = 'f2') SELECT {_E} FROM edges WHERE src IN (FROM s) AND dst IN (FROM s)")
def _(s, d):
    n, e = both(s, d)
    return _joined(G.scope_edges(e, G.scope_nodes(n, folder_id="f2")))


@query("s3_file_graph", f", s AS (SELECT id FROM nodes WHERE list_contains(file_ids, 'geo')) SELECT {_E} FROM edges WHERE src IN (FROM s) AND dst IN (FROM s) AND list_contains(file_ids, 'geo')")
def _(s, d):
    n, e = both(s, d)
    return _joined(G.file_graph(n, e, "geo")[1])


@query("s4_graph_view", f", s AS (SELECT id FROM nodes ORDER BY id LIMIT 2500) SELECT {_E} FROM edges WHERE src IN (FROM s) AND dst IN (FROM s) ORDER BY id LIMIT 5000")
def _(s, d):
    n, e = both(s, d)
    return _joined(G.graph_view(n, e, 2500)[1])


@query("s5_projection", "SELECT src, dst, max(w) AS weight FROM (SELECT src, dst, coalesce(strength, 1.0) AS w FROM edges UNION ALL SELECT dst, src, coalesce(strength, 1.0) FROM edges) WHERE src <> dst GROUP BY 1, 2")
def _(s, d):
    return G.project(*both(s, d), undirected=True).edges


@query("s19_read_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(s, d):
    return G.read_table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("p1_search_by_name", "SELECT id, name FROM nodes WHERE contains(lower(name), 'ring') AND folder_id = 'f1' ORDER BY name, id LIMIT 50")
def _(s, d):
    return R.search_by_name(G.graph_nodes(s, d), "RING", "f1").select("id", "name")


@query("p2_browse_nodes", """, o AS (SELECT id, name FROM nodes WHERE type = 'Customer'), pg AS (SELECT * FROM o ORDER BY name, id LIMIT 20 OFFSET 20),
nb AS (SELECT pg.id, n.type, count(*) AS c FROM pg JOIN adj ON pg.id = a JOIN nodes n ON n.id = b GROUP BY 1, 2),
ag AS (SELECT id, string_agg(type || '=' || c, ',' ORDER BY type || '=' || c) AS nb FROM nb GROUP BY id)
SELECT pg.id, name, coalesce(nb, '') AS neighbours, (SELECT count(*) FROM o) AS total, CAST(ceil((SELECT count(*) FROM o) / 20.0) AS BIGINT) AS pages FROM pg LEFT JOIN ag ON pg.id = ag.id""")
def _(s, d):
    return R.browse_nodes(*both(s, d), "Customer", page=2)


@query("p3_type_counts", "SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(s, d):
    return R.type_counts(R.isolate(G.graph_nodes(s, d).withColumn("type", F.concat("type", F.lit("_F_"), "folder_id")), "f0"))


@query("p4_min_connections", "SELECT nodes.id, d AS degree FROM nodes JOIN deg ON nodes.id = deg.id WHERE d >= 5")
def _(s, d):
    return R.min_connections(*both(s, d), 5).select("id", "degree")


@query("p5_clean_label", "SELECT id, CASE WHEN coalesce(description, '') = '' THEN 'Unknown' ELSE split_part(description, ' ', 1) END AS label FROM nodes")
def _(s, d):
    return G.graph_nodes(s, d).select("id", C.clean_label(F.replace("description", F.lit(" "), F.lit("_F_"))).alias("label"))


@query("p6_effective_type", """, l AS (SELECT id, type, CASE type WHEN 'Part' THEN ['Entity', 'SomethingLong', 'Quality', 'Property'] WHEN 'Supplier' THEN ['Entity', 'Shop_F_f1', 'Store_F_f1', 'F_x'] WHEN 'Nation' THEN ['Entity', 'F_f2', 'Chunk'] WHEN 'Customer' THEN ['Entity', 'Unknown'] ELSE ['Herb'] END AS labels FROM nodes)
SELECT id, CASE type WHEN 'Part' THEN 'Property' WHEN 'Supplier' THEN 'Store' WHEN 'Nation' THEN split_part('F_f2', '_F_', 1) WHEN 'Customer' THEN 'Entity' ELSE 'Region' END AS kind FROM l""")
def _(s, d):
    some = {"Part": ["Entity", "SomethingLong", "Quality", "Property"], "Supplier": ["Entity", "Shop_F_f1", "Store_F_f1", "F_x"], "Nation": ["Entity", "F_f2", "Chunk"], "Customer": ["Entity", "Unknown"], "Region": ["Herb"]}
    labels = F.coalesce(*(F.when(F.col("type") == k, F.array(*map(F.lit, v))) for k, v in some.items()))
    return G.graph_nodes(s, d).select("id", C.effective_type(labels, F.when(F.col("type") == "Region", F.lit("Region_F_f9"))).alias("kind"))


@query("p7_display_name", """, v AS (SELECT id, type, CASE WHEN type = 'Customer' THEN 'Entity' ELSE type END AS kind, unnest([sha256(name), repeat(name, 100), '', description, concat_ws('-', 'aaaaaaaa', 'bbbb', 'cccc', 'dddd', 'eeeeeeeeeeee')]) AS v, unnest([1, 2, 3, 4, 5]) AS k FROM nodes),
o AS (SELECT id, min_by(v, k) AS v FROM v WHERE v <> '' AND length(v) < 100 AND NOT (length(v) > 30 AND (length(v) - length(replace(v, '-', '')) >= 4 OR regexp_full_match(v, '[A-Za-z0-9]+'))) AND NOT (k = 4 AND type = 'Customer') GROUP BY 1)
SELECT n.id, coalesce(o.v, CASE WHEN n.type <> 'Customer' THEN n.type END, n.id) AS shown FROM nodes n LEFT JOIN o USING (id)""")
def _(s, d):
    n = G.graph_nodes(s, d)
    customer = F.col("type") == "Customer"
    values = [F.sha2("name", 256), F.repeat("name", 100), F.lit(""), F.when(~customer, F.col("description")), F.lit("aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee")]
    return n.select("id", C.display_name(values, F.when(customer, "Entity").otherwise(F.col("type")), F.col("id")).alias("shown"))


@query("p8_extra_properties", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(s, d):
    e = G.read_table(s, d, "events").withColumn("properties", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("id"), F.lit("x"), F.lit("conflicts"), F.lit("broken"))))
    return R.extra_properties(e, ["id", "name"]).select("event_id", F.col("extra")["k"].alias("k"))


@query("p9_serialize", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, '[\"' || o_orderstatus || '\"]' AS status FROM orders")
def _(s, d):
    return R.serialize(G.read_table(s, d, "orders").select("o_orderkey", "o_orderdate", F.array("o_orderstatus").alias("status")))


@query("p10_node_details", "SELECT nodes.id, name, type, CAST(coalesce(d, 0) AS BIGINT) AS degree, array_to_string(file_ids, ',') AS files FROM nodes LEFT JOIN inc ON nodes.id = inc.id WHERE type IN ('Nation', 'Supplier')")
def _(s, d):
    n, e = both(s, d)
    return R.node_details(n, e, n.filter("type in ('Nation', 'Supplier')"))


@query("p11_resolve_names", "SELECT name AS asked, min(id) AS id FROM nodes WHERE folder_id = 'f3' AND name IN (SELECT p_name FROM part) GROUP BY name")
def _(s, d):
    return R.resolve_names(G.graph_nodes(s, d), G.read_table(s, d, "part").select(F.col("p_name").alias("asked")).distinct(), "f3")


@query("p12_filter_results", "SELECT id, type FROM nodes WHERE folder_id = 'f4' AND lower(type) = 'customer'")
def _(s, d):
    return R.filter_results(G.graph_nodes(s, d), "f4", None, "CUSTOMER").select("id", "type")


@query("p13_adopt", ", c AS (SELECT id FROM nodes) SELECT e.id, array_to_string(list_append(file_ids, 'new'), ',') AS file_ids FROM edges e")
def _(s, d):
    return R.adopt(*both(s, d), "new", "f0")[1].select("id", F.array_join("file_ids", ",").alias("file_ids"))


@query("p14_isolate", "SELECT id, 'fx' AS folder_id FROM nodes")
def _(s, d):
    return R.isolate(G.graph_nodes(s, d), "fx").select("id", "folder_id")


@query("p15_ensure_ids", "SELECT name, CASE WHEN type = 'Part' THEN sha256(concat_ws('|', name, type, folder_id)) ELSE id END AS id FROM nodes")
def _(s, d):
    return R.ensure_ids(G.graph_nodes(s, d).withColumn("id", F.when(F.col("type") != "Part", F.col("id")))).select("name", "id")


@query("p16_allowed_scope", "SELECT DISTINCT folder_id FROM folders JOIN files USING (folder_id) WHERE owner = 'n3' AND status = 'completed'")
def _(s, d):
    return R.allowed_scope(G.folders_table(s, d), "n3", G.files_table(s, d).filter("status = 'completed'"))


@query("p17_pending_files", "SELECT file_id, folder_id, folder_name, owner FROM files JOIN folders USING (folder_id) WHERE status = 'pending_review' AND owner = 'n2'")
def _(s, d):
    return R.pending_files(G.files_table(s, d), G.folders_table(s, d), "n2")


@query("p18_status_progress", "SELECT file_id, CASE status WHEN 'completed' THEN 100 WHEN 'pending_review' THEN 90 ELSE 50 END AS progress, CASE status WHEN 'completed' THEN 'Done' WHEN 'pending_review' THEN 'Ready for review' ELSE 'In progress' END AS message FROM files")
def _(s, d):
    return R.status_progress(G.files_table(s, d))


@query("j1_files_with_folder", "SELECT file_id, folder_name, status FROM files JOIN folders USING (folder_id)")
def _(s, d):
    return R.files_with_folder(G.files_table(s, d), G.folders_table(s, d)).select("file_id", "folder_name", "status")


@query("j2_folder_summary", "SELECT f.folder_id, folder_name, count(DISTINCT file_id) AS n_files, CAST(coalesce(sum(file_size), 0) AS DOUBLE) AS size FROM folders f LEFT JOIN files USING (folder_id) GROUP BY 1, 2")
def _(s, d):
    return R.folder_summary(G.folders_table(s, d), G.files_table(s, d))


@query("j3_folder_permissions", "SELECT 'c' || c_custkey AS folder_id, c_custkey % 40 AS user_id, c_mktsegment AS role, coalesce(n_name, 'Unknown') AS user_name FROM customer LEFT JOIN nation ON c_custkey % 40 = n_nationkey")
def _(s, d):
    p = G.read_table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("folder_id"), (F.col("c_custkey") % 40).alias("user_id"), F.col("c_mktsegment").alias("role"))
    return R.folder_permissions(p, G.read_table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_name").alias("user_name")))


@query("j4_hydrate_edges", "SELECT e.id, src, dst, e.type, coalesce(x.name, 'Unknown') AS src_name, coalesce(y.name, 'Unknown') AS dst_name FROM edges e LEFT JOIN (SELECT * FROM nodes WHERE type <> 'Supplier') x ON src = x.id LEFT JOIN (SELECT * FROM nodes WHERE type <> 'Supplier') y ON dst = y.id")
def _(s, d):
    n, e = both(s, d)
    return R.hydrate_edges(e, n.filter("type <> 'Supplier'"))


_SUB = ", sub AS MATERIALIZED (SELECT a, b FROM adj)"


def written(edges: DataFrame) -> DataFrame:
    """The adjacency, written once, since pair measures read it several times."""
    return staged(G.adjacency(edges))


@query("j5_two_hop_pairs", _SUB + " SELECT x.a, y.b, count(*) AS n FROM sub x JOIN sub y ON x.b = y.a WHERE x.a < y.b GROUP BY 1, 2")
def _(s, d):
    return L.pair_scores(written(G.graph_edges(s, d)), linked=True).select("a", "b", F.col("common").alias("n"))


@query("j6_exclude_linked", _SUB + " SELECT DISTINCT x.a, y.b FROM sub x JOIN sub y ON x.b = y.a WHERE x.a < y.b AND NOT EXISTS (SELECT 1 FROM sub z WHERE z.a = x.a AND z.b = y.b)")
def _(s, d):
    return L.pair_scores(written(G.graph_edges(s, d))).select("a", "b")


@query("j7_typed_pairs", "SELECT x.type, x.folder_id, x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.type = y.type AND x.folder_id = y.folder_id AND x.id < y.id")
def _(s, d):
    return R.typed_pairs(G.graph_nodes(s, d))


@query("j8_cross_folder_bridges", ", p AS (SELECT name, folder_id, min(id) AS id FROM nodes GROUP BY 1, 2) SELECT x.name, x.folder_id AS folder_a, y.folder_id AS folder_b, x.id AS id_a, y.id AS id_b FROM p x JOIN p y ON x.name = y.name AND x.folder_id < y.folder_id")
def _(s, d):
    return R.cross_folder_bridges(G.graph_nodes(s, d))


_MAP = ", m AS (SELECT id AS old, min(id) OVER (PARTITION BY name, type) AS canonical FROM nodes WHERE type = 'Part')"


def part_map(nodes: DataFrame) -> DataFrame:
    p = nodes.filter("type = 'Part'")
    return p.select("name", F.col("id").alias("old")).join(p.groupBy("name").agg(F.min("id").alias("canonical")), "name").select("old", "canonical")


@query("j9_rewrite_endpoints", _MAP + " SELECT e.id, coalesce(x.canonical, src) AS src, coalesce(y.canonical, dst) AS dst FROM edges e LEFT JOIN m x ON src = x.old LEFT JOIN m y ON dst = y.old")
def _(s, d):
    n, e = both(s, d)
    return R.rewrite_endpoints(e, part_map(n)).select("id", "src", "dst")


@query("j10_match_existing", ", k AS (SELECT folder_id, name, type, min(id) AS e FROM nodes WHERE type <> 'Customer' GROUP BY 1, 2, 3) SELECT id, e AS existing_id FROM nodes LEFT JOIN k USING (folder_id, name, type)")
def _(s, d):
    n = G.graph_nodes(s, d)
    return R.match_existing(n.withColumn("name", F.upper("name")), n.filter("type <> 'Customer'")).select("id", "existing_id")


@query("j11_valid_edges", ", v AS (SELECT id FROM nodes WHERE confidence > 0.3) SELECT id FROM edges WHERE src IN (FROM v) AND dst IN (FROM v)")
def _(s, d):
    n, e = both(s, d)
    return R.valid_edges(e, n.filter("confidence > 0.3")).select("id")


_STATES = ", st AS (SELECT r_name AS state FROM region UNION ALL SELECT 'small ' UNION ALL SELECT 'the nation_7 and more')"


def states(s: SparkSession, d: str) -> DataFrame:
    return G.read_table(s, d, "region").select(F.col("r_name").alias("state")).union(s.range(1).select(F.explode(F.array(F.lit("small "), F.lit("the nation_7 and more")))))


@query("j12_match_states", _STATES + " SELECT state, id FROM st JOIN nodes ON contains(lower(name), lower(state)) OR contains(lower(state), lower(name))")
def _(s, d):
    return R.match_states(states(s, d), G.graph_nodes(s, d))


@query("j13_find_interventions", _STATES + """, m AS (SELECT state, id FROM st JOIN nodes ON contains(lower(name), lower(state)) OR contains(lower(state), lower(name)))
SELECT y.src AS intervention, count(*) AS strength FROM m JOIN edges x ON x.src = m.id AND x.type = 'SUPPLIED_BY' JOIN edges y ON y.dst = x.dst AND y.type = 'SUPPLIED_BY' WHERE m.id <> y.src GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(s, d):
    n, e = both(s, d)
    return R.find_interventions(R.match_states(states(s, d), n), e, "SUPPLIED_BY", "SUPPLIED_BY")


@query("j14_chain_profile", "SELECT x.src AS subject, count(DISTINCT x.dst) AS n_values, string_agg(DISTINCT y.dst, ',' ORDER BY y.dst) AS qualities FROM edges x LEFT JOIN edges y ON x.dst = y.src AND y.type = 'SUPPLIED_BY' WHERE x.type = 'BOUGHT' GROUP BY 1")
def _(s, d):
    n, e = both(s, d)
    return R.chain_profile(n, e, "BOUGHT", "SUPPLIED_BY")


@query("j15_with_source", "SELECT item_id, d.doc_id AS chunk_id, substr(d.text, 1, 20) AS start FROM benchmark LEFT JOIN documents d ON item_id * 3 = d.doc_id")
def _(s, d):
    chunks = G.read_table(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    out = R.with_source(G.read_table(s, d, "benchmark").withColumn("chunk_id", F.col("item_id") * 3), chunks)
    return out.select("item_id", F.when(F.col("content").isNotNull(), F.col("chunk_id")).alias("chunk_id"), F.substring("content", 1, 20).alias("start"))


@query("j16_link_relationships", """, e AS (SELECT lower(name) AS k, max(id) AS i FROM nodes WHERE type IN ('Customer', 'Supplier', 'Nation') GROUP BY 1)
SELECT x.id, a.i AS source_id, b.i AS target_id FROM edges x JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst JOIN e a ON a.k = lower(s.name) JOIN e b ON b.k = lower(t.name)""")
def _(s, d):
    n, e = both(s, d)
    names = n.select("id", "name")
    rels = e.join(names.select(F.col("id").alias("src"), F.col("name").alias("source")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("target")), "dst").select("id", "source", "target")
    return R.link_relationships(rels, n.filter("type in ('Customer', 'Supplier', 'Nation')").withColumn("seq", F.lit(0))).select("id", "source_id", "target_id")


def by_folder(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("folder_id").alias("cluster"))


@query("j17_cluster_edges", "SELECT least(x.folder_id, y.folder_id) AS cluster_a, greatest(x.folder_id, y.folder_id) AS cluster_b, count(*) AS n FROM edges JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id WHERE x.folder_id <> y.folder_id GROUP BY 1, 2")
def _(s, d):
    n, e = both(s, d)
    return R.cluster_edges(e, by_folder(n))


_LR = ", l AS (SELECT id, type FROM nodes WHERE folder_id = 'f0' AND type = 'Customer'), r AS (SELECT id, type FROM nodes WHERE folder_id IN ('f0', 'f1') AND type IN ('Supplier', 'Nation', 'Customer'))"


def sides(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    return n.filter("folder_id = 'f0' and type = 'Customer'"), n.filter("folder_id in ('f0', 'f1') and type in ('Supplier', 'Nation', 'Customer')")


_BR = ", x AS (SELECT a, count(*) AS n FROM adj WHERE b IN (SELECT id FROM l) GROUP BY 1), y AS (SELECT a, count(*) AS n FROM adj WHERE b IN (SELECT id FROM r) GROUP BY 1), br AS (SELECT x.a AS id, x.n AS n_left, y.n AS n_right FROM x JOIN y ON x.a = y.a WHERE x.a NOT IN (SELECT id FROM l) AND x.a NOT IN (SELECT id FROM r) ORDER BY x.n + y.n DESC, x.a LIMIT 20)"


@query("j18_bridges", _LR + _BR + " SELECT * FROM br")
def _(s, d):
    n, e = both(s, d)
    return R.bridges(G.adjacency(e), *sides(n))


@query("j19_optional_neighbours", "SELECT id, b FROM nodes LEFT JOIN adj ON id = a")
def _(s, d):
    n, e = both(s, d)
    return n.join(G.adjacency(e), F.col("id") == F.col("a"), "left").select("id", "b")


@query("a1_dashboard", "SELECT 'nodes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM nodes UNION ALL SELECT 'relationships', count(*) FROM edges UNION ALL SELECT 'types', count(DISTINCT type) FROM nodes UNION ALL SELECT 'completed_files', count(*) FROM files WHERE status = 'completed'")
def _(s, d):
    return R.dashboard_stats(*both(s, d), G.files_table(s, d))


@query("a2_type_distribution", "SELECT type, count(*) AS n FROM nodes WHERE folder_id = 'f1' GROUP BY 1")
def _(s, d):
    return R.type_distribution(G.graph_nodes(s, d), "f1")


@query("a3_degrees", "SELECT nodes.id, CAST(coalesce(d, 0) AS BIGINT) AS degree FROM nodes LEFT JOIN inc ON nodes.id = inc.id")
def _(s, d):
    return R.degrees(*both(s, d))


@query("a4_degree_stats", ", g AS (SELECT CAST(coalesce(d, 0) AS BIGINT) AS d FROM nodes LEFT JOIN inc ON nodes.id = inc.id) SELECT min(d) AS min, max(d) AS max, round(avg(d), 4) AS mean, quantile_cont(d, 0.5) AS median, round(quantile_cont(d, 0.9), 4) AS p90, round(stddev_samp(d), 4) AS stdev FROM g")
def _(s, d):
    return R.degree_stats(*both(s, d))


@query("a5_degree_histogram", ", g AS (SELECT coalesce(d, 0) AS d FROM nodes LEFT JOIN inc ON nodes.id = inc.id), b AS (SELECT unnest(['0', '1-2', '3-5', '6-10', '11-20', '21+']) AS bin), c AS (SELECT CASE WHEN d = 0 THEN '0' WHEN d <= 2 THEN '1-2' WHEN d <= 5 THEN '3-5' WHEN d <= 10 THEN '6-10' WHEN d <= 20 THEN '11-20' ELSE '21+' END AS bin, count(*) AS n FROM g GROUP BY 1) SELECT bin, coalesce(n, 0) AS n FROM b LEFT JOIN c USING (bin)")
def _(s, d):
    return R.degree_histogram(*both(s, d))


_NL = ", t AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS l)"


@query("a6_overview", _NL + " SELECT n, l, round(2.0 * l / (n * (n - 1.0)), 4) AS density, round(CAST(2 * l AS DOUBLE) / n, 2) AS average_degree, round(l / (n * (n - 1.0)), 6) AS directed_density FROM t")
def _(s, d):
    return R.overview(*both(s, d))


@query("a8_health_score", _NL + " SELECT n, l, CASE WHEN 2.0 * l / (n * (n - 1.0)) < 0.01 THEN 85 ELSE 100 END AS score, CASE WHEN 2.0 * l / (n * (n - 1.0)) < 0.01 THEN 'B' ELSE 'A' END AS grade, CASE WHEN 2.0 * l / (n * (n - 1.0)) < 0.01 THEN 'very sparse' ELSE '' END AS issues FROM t")
def _(s, d):
    return R.health_score(*both(s, d))


@query("a10_backbone_types", "SELECT type, count(*) AS n FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return R.backbone_types(G.graph_edges(s, d))


@query("a12_extraction_summary", "SELECT 'entity' AS kind, type, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'relationship', type, count(*) FROM edges GROUP BY 2")
def _(s, d):
    return R.extraction_summary(*both(s, d))


@query("a13_communities", "SELECT folder_id AS cluster, count(*) AS size, min(id) AS first, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM nodes), 4) AS share FROM nodes GROUP BY 1")
def _(s, d):
    return R.communities(by_folder(G.graph_nodes(s, d)))


@query("a15_infer_schema", "(SELECT 'entity' AS kind, type, count(*) AS n FROM nodes GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20) UNION ALL (SELECT 'relationship', type, count(*) FROM edges GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)")
def _(s, d):
    return R.infer_schema(*both(s, d))


@query("a16_merge_schema", "SELECT 'entity' AS kind, type, count(*) AS n FROM nodes WHERE type <> 'Part' GROUP BY 2 UNION ALL SELECT 'entity', type, count(*) FROM nodes WHERE folder_id = 'f0' AND type = 'Part' GROUP BY 2")
def _(s, d):
    n = G.graph_nodes(s, d)
    kinds = lambda x: x.groupBy(F.lit("entity").alias("kind"), "type").agg(F.count("*").alias("n"))
    return R.merge_schema(kinds(n.filter("type <> 'Part'")), kinds(n.filter("folder_id = 'f0'")))


@query("a19_type_examples", ", t AS (SELECT DISTINCT type, name FROM nodes), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name) AS k FROM t) SELECT type, string_agg(name, '|' ORDER BY name) AS examples FROM r WHERE k <= 5 GROUP BY 1")
def _(s, d):
    return R.type_examples(G.graph_nodes(s, d))


@query("a20_best_folder", "SELECT folder_id, count(*) FILTER (WHERE contains(lower(name), 'ring') OR contains(lower(name), 'red')) AS hits FROM nodes GROUP BY 1")
def _(s, d):
    return R.best_folder(G.graph_nodes(s, d), ["ring", "red"])


@query("a21_reference_counts", "SELECT id, CAST(len(file_ids) AS INTEGER) AS refs, len(file_ids) = 1 AS deletable FROM nodes WHERE list_contains(file_ids, 'cust')")
def _(s, d):
    return R.reference_counts(G.graph_nodes(s, d), "cust")


@query("a22_reconcile", ", t AS (SELECT (SELECT count(*) FROM nodes) AS a, (SELECT count(DISTINCT src) FROM edges) AS b) SELECT a, b, abs(a - b) AS difference, abs(a - b) <= greatest(5, floor(greatest(a, b) * 0.01)) AS consistent FROM t")
def _(s, d):
    n, e = both(s, d)
    return R.reconcile(n, e.select("src").distinct())


@query("a23_vocabulary", "SELECT type FROM edges UNION SELECT 'RELATED_TO' UNION SELECT 'PART_OF'")
def _(s, d):
    return R.vocabulary(G.graph_edges(s, d), ["RELATED_TO", "PART_OF"])


@query("a24_scope_summary", "SELECT type, count(*) AS n, (SELECT count(*) FROM nodes WHERE folder_id = 'f2') AS total FROM nodes WHERE folder_id = 'f2' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(s, d):
    return R.scope_summary(G.graph_nodes(s, d).filter("folder_id = 'f2'"))


@query("a25_top_communities", "SELECT type || folder_id AS cluster, count(*) AS size FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return R.top_communities(G.graph_nodes(s, d).select("id", F.concat("type", "folder_id").alias("cluster")))


@query("a26_file_counts", ", x AS (SELECT f, count(*) AS n FROM (SELECT unnest(file_ids) AS f FROM nodes) GROUP BY 1), y AS (SELECT f, count(*) AS n FROM (SELECT unnest(file_ids) AS f FROM edges) GROUP BY 1) SELECT coalesce(x.f, y.f) AS file_id, coalesce(x.n, 0) AS entities, coalesce(y.n, 0) AS relations FROM x FULL JOIN y ON x.f = y.f")
def _(s, d):
    return R.file_counts(*both(s, d))


@query("w1_latest_message", "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def _(s, d):
    return R.latest_per_session(G.read_table(s, d, "conversations"))


@query("w2_chat_window", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def _(s, d):
    return R.chat_window(G.read_table(s, d, "conversations"), 3).select("conv_id", "turn", "role")


@query("w3_history_context", ", b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, count(*) FILTER (WHERE k > 3) AS old, count(*) FILTER (WHERE k <= 3) AS recent, coalesce(string_agg(role || ': ' || substr(text, 1, 150), chr(10) ORDER BY turn) FILTER (WHERE k <= 4), '') AS context FROM b GROUP BY 1")
def _(s, d):
    return R.history_context(G.read_table(s, d, "conversations"), recent=3)


@query("w4_top_k", "SELECT id, confidence FROM nodes WHERE confidence IS NOT NULL ORDER BY confidence DESC, id LIMIT 10")
def _(s, d):
    return R.top_k(G.graph_nodes(s, d).filter("confidence is not null"), "confidence", 10).select("id", "confidence")


@query("w5_top_k_per", "SELECT type, id, rank FROM (SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, id) AS rank FROM nodes WHERE confidence IS NOT NULL) WHERE rank <= 3")
def _(s, d):
    return R.top_k_per(G.graph_nodes(s, d).filter("confidence is not null"), "type", "confidence", 3, "id").select("type", "id", "rank")


@query("w6_first_seen", ", u AS (SELECT id, 0 AS l FROM nodes WHERE confidence > 0.5 UNION ALL SELECT id, 1 FROM nodes WHERE folder_id = 'f1') SELECT id, min(l) AS list FROM u GROUP BY 1")
def _(s, d):
    n = G.graph_nodes(s, d)
    return R.first_seen([n.filter("confidence > 0.5").select("id", F.lit(0).alias("list")), n.filter("folder_id = 'f1'").select("id", F.lit(1).alias("list"))], ["id"])


@query("w7_ranked_table", ", t AS (SELECT id, d FROM deg ORDER BY d DESC, id LIMIT 20) SELECT id, d AS degree, row_number() OVER (ORDER BY d DESC, id) AS rank, round(100.0 * d / (SELECT max(d) FROM t), 2) AS bar FROM t")
def _(s, d):
    n, e = both(s, d)
    return R.ranked_table(R.top_k(R.degrees(n, e, "distinct"), "degree", 20), "degree")


@query("w9_encounter_history", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def _(s, d):
    return R.encounter_history(G.read_table(s, d, "events")).select("user_id", "event_id", "rank")


@query("w10_recent_activity", """, t AS (SELECT *, date_diff('second', ts, TIMESTAMP '2030-01-01') AS sec FROM events ORDER BY ts DESC, event_id DESC LIMIT 30)
SELECT event_id, user_id, event_type AS action, 'item ' || json_extract_string(props, '$.k') AS target, CAST((epoch(TIMESTAMP '2030-01-01') - floor(epoch(ts))) // 86400 AS BIGINT) || ' days ago' AS "when" FROM t""")
def _(s, d):
    return R.recent_activity(G.read_table(s, d, "events"), 30, F.expr("timestamp '2030-01-01 00:00:00'"))


@query("u1_compare_sets", _LR + " SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'right' WHEN r.id IS NULL THEN 'left' ELSE 'common' END AS side FROM l FULL JOIN r ON l.id = r.id")
def _(s, d):
    return R.compare_sets(*sides(G.graph_nodes(s, d)))


_C3 = ", c AS (SELECT count(*) FILTER (WHERE l.id IS NOT NULL AND r.id IS NOT NULL) AS k, count(*) FILTER (WHERE r.id IS NULL) AS lo, count(*) FILTER (WHERE l.id IS NULL) AS ro FROM l FULL JOIN r ON l.id = r.id)"
_TC = ", tc AS (SELECT sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS v FROM (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM (SELECT type, count(*) AS x FROM l GROUP BY 1) a FULL JOIN (SELECT type, count(*) AS y FROM r GROUP BY 1) b ON a.type = b.type))"


@query("u2_compare_clusters", _LR + _BR + _C3 + _TC + " SELECT k AS common, lo AS left_only, ro AS right_only, (SELECT count(*) FROM br) AS bridges, round(CAST(k AS DOUBLE) / (k + lo + ro), 3) AS jaccard, (SELECT round(v, 4) FROM tc) AS semantic, round((CAST(least(k + lo, k + ro) AS DOUBLE) / greatest(k + lo, k + ro) + CAST(k AS DOUBLE) / least(k + lo, k + ro)) / 2, 4) AS structural FROM c")
def _(s, d):
    n, e = both(s, d)
    return R.compare_clusters(*sides(n), G.adjacency(e))


@query("u3_cluster_members", "SELECT id, name FROM nodes WHERE type || folder_id = 'Supplierf1'")
def _(s, d):
    n = G.graph_nodes(s, d)
    return R.cluster_members(n, assign=n.select("id", F.concat("type", "folder_id").alias("cluster")), cluster="Supplierf1").select("id", "name")


@query("u4_type_cosine", _LR + _TC + " SELECT round(v, 4) AS semantic FROM tc")
def _(s, d):
    return R.type_cosine(*sides(G.graph_nodes(s, d)))


@query("u5_structural_similarity", _LR + _C3 + " SELECT round((CAST(least(k + lo, k + ro) AS DOUBLE) / greatest(k + lo, k + ro) + CAST(k AS DOUBLE) / least(k + lo, k + ro)) / 2, 4) AS structural FROM c")
def _(s, d):
    return R.structural_similarity(*sides(G.graph_nodes(s, d)))


@query("u6_missing_in_b", "SELECT id, name, type FROM nodes WHERE folder_id = 'f0' AND type IN (SELECT type FROM nodes WHERE folder_id = 'f1') ORDER BY id LIMIT 20")
def _(s, d):
    n = G.graph_nodes(s, d)
    return R.missing_in_b(n.filter("folder_id = 'f0'"), n.filter("folder_id = 'f1'"))


@query("u7_jaccard", _LR + _C3 + " SELECT round(CAST(k AS DOUBLE) / (k + lo + ro), 3) AS jaccard FROM c")
def _(s, d):
    return R.jaccard(*sides(G.graph_nodes(s, d)))


@query("u8_union_files", "SELECT name, string_agg(DISTINCT f, ',' ORDER BY f) AS files FROM (SELECT name, unnest(file_ids) AS f FROM nodes WHERE type = 'Part') GROUP BY 1")
def _(s, d):
    p = G.graph_nodes(s, d).filter("type = 'Part'").select("name", F.explode("file_ids").alias("f")).distinct()
    return p.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("files"))


@query("u9_dedup_edges", "SELECT src, dst, type, min(id) AS id FROM edges GROUP BY 1, 2, 3")
def _(s, d):
    e = G.graph_edges(s, d)
    return R.dedup_edges(e.unionByName(e.withColumn("id", F.concat("id", F.lit("x")))))


@query("f1_sanitize_rel_type", "SELECT id, upper(regexp_replace(regexp_replace(coalesce(description, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS t0, CASE WHEN coalesce(description, '') = '' THEN 'RELATED_TO' ELSE upper(regexp_replace(regexp_replace(description, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) END AS t FROM nodes")
def _(s, d):
    n = G.graph_nodes(s, d)
    return n.select("id", F.upper(F.regexp_replace(F.regexp_replace(F.coalesce("description", F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")).alias("t0"), C.sanitize_rel_type(F.col("description")).alias("t"))


@query("f2_f4_names", r"SELECT p_partkey, upper(translate(p_name, ' -', '__')) AS upper_type, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS cleaned, regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, lower(translate(trim(p_name), ' -.', '___')) AS safe FROM part")
def _(s, d):
    p = G.read_table(s, d, "part")
    return p.select("p_partkey", C.upper_type(F.col("p_name")).alias("upper_type"), C.name_clean(F.col("p_brand")).alias("cleaned"), C.name_slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"), C.safe_key(F.col("p_name")).alias("safe"))


@query("f5_query_terms", r"SELECT conv_id, turn, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(text, E' \n'), '\s+'), lambda w: length(w) > 2)[1:10], lambda w: lower(regexp_replace(w, '^[?,.!]+|[?,.!]+$', '', 'g'))), ' ') AS terms FROM conversations")
def _(s, d):
    return G.read_table(s, d, "conversations").select("conv_id", "turn", F.array_join(C.query_terms(F.col("text")), " ").alias("terms"))


@query("f6_is_vague", r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: length(w) > 1)) < 3 AS vague FROM conversations")
def _(s, d):
    return G.read_table(s, d, "conversations").select("conv_id", "turn", C.is_vague(F.col("text")).alias("vague"))


@query("f7_cosine", "SELECT x.vec_id, round(coalesce(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 0), 5) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def _(s, d):
    e = G.read_table(s, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("other")), 5).alias("cosine"))


@query("f8_f9_array_similarity", """, p AS (SELECT e.id, len(list_intersect(x.file_ids, y.file_ids)) AS i, len(list_distinct(list_concat(x.file_ids, y.file_ids))) AS u, least(len(x.file_ids), len(y.file_ids)) AS m FROM edges e JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id)
SELECT id, round(CAST(i AS DOUBLE) / u, 6) AS j, round(CAST(i AS DOUBLE) / m, 6) AS o, round((CAST(i AS DOUBLE) / u + CAST(i AS DOUBLE) / m) / 2, 6) AS both_ FROM p""")
def _(s, d):
    n, e = both(s, d)
    end = lambda c, f: n.select(F.col("id").alias(c), F.col("file_ids").alias(f))
    x = e.select("id", "src", "dst").join(end("src", "fa"), "src").join(end("dst", "fb"), "dst")
    j, o = C.jaccard_arr(F.col("fa"), F.col("fb")), C.overlap_arr(F.col("fa"), F.col("fb"))
    return x.select("id", F.round(j, 6).alias("j"), F.round(o, 6).alias("o"), F.round(C.combined_similarity(j, o, F.lit(None).cast("double")), 6).alias("both_"))


@query("f10_f11_hashes", "SELECT id, round(CAST(('0x' || substr(md5(id), 1, 8)) AS BIGINT) / 4294967296.0, 6) AS u, substr(md5(array_to_string(list_sort(file_ids), ',')), 1, 8) AS scope FROM nodes")
def _(s, d):
    return G.graph_nodes(s, d).select("id", F.round(C.hash_unit(F.col("id")), 6).alias("u"), C.scope_key(F.col("file_ids")).alias("scope"))


@query("f12_grades", "SELECT o_orderkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN s >= 80 THEN 'healthy' WHEN s >= 50 THEN 'warning' ELSE 'critical' END AS status FROM (SELECT o_orderkey, o_orderkey % 101 AS s FROM orders)")
def _(s, d):
    v = (F.col("o_orderkey") % 101).cast("double")
    return G.read_table(s, d, "orders").select("o_orderkey", C.grade(v).alias("grade"), C.health_status(v / 100).alias("status"))


_KINDS = {"Customer": "Person", "Supplier": "Organization", "Nation": "Place", "Region": "Event", "Part": "Concept"}


@query("f13_predicted_type", """, t AS (SELECT id, CASE type WHEN 'Customer' THEN 'Person' WHEN 'Supplier' THEN 'Organization' WHEN 'Nation' THEN 'Place' WHEN 'Region' THEN 'Event' ELSE 'Concept' END AS k FROM nodes),
e2 AS (SELECT id, src, dst FROM edges UNION ALL SELECT o_orderkey::VARCHAR, 'c' || o_custkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'p' || l_orderkey || '-' || l_linenumber, 'p' || l_partkey, 'p' || l_partkey FROM lineitem)
SELECT e2.id, CASE WHEN x.k = 'Person' AND y.k = 'Person' THEN 'KNOWS' WHEN x.k = 'Person' AND y.k = 'Organization' OR x.k = 'Organization' AND y.k = 'Person' THEN 'WORKS_FOR' WHEN x.k = 'Person' AND y.k = 'Place' THEN 'LIVES_IN' WHEN x.k = 'Organization' AND y.k = 'Place' THEN 'LOCATED_IN' WHEN x.k = 'Place' AND y.k = 'Event' THEN 'OCCURRED_AT' ELSE 'RELATED_TO' END AS predicted FROM e2 JOIN t x ON src = x.id JOIN t y ON dst = y.id""")
def _(s, d):
    n, e = both(s, d)
    kinds = n.select("id", F.element_at(F.create_map(*(F.lit(x) for kv in _KINDS.items() for x in kv)), F.col("type")).alias("kind"))
    same = lambda t, id_, end: G.read_table(s, d, t).select(id_.alias("id"), end.alias("src"), end.alias("dst"))
    e = e.select("id", "src", "dst").union(same("orders", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), "o_custkey"))).union(same("lineitem", F.concat(F.lit("p"), "l_orderkey", F.lit("-"), "l_linenumber"), F.concat(F.lit("p"), "l_partkey")))
    j = e.join(kinds.select(F.col("id").alias("src"), F.col("kind").alias("x")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("kind").alias("y")), "dst")
    return j.select("id", C.predicted_type(F.col("x"), F.col("y")).alias("predicted"))


@query("f13_predicted_own_pairs", "SELECT e.id, CASE WHEN x.type = 'Customer' AND y.type = 'Part' THEN 'MAY_BUY' WHEN x.type = 'Part' AND y.type = 'Supplier' THEN 'MAY_BE_SUPPLIED_BY' ELSE 'RELATED_TO' END AS predicted FROM edges e JOIN nodes x ON src = x.id JOIN nodes y ON dst = y.id")
def _(s, d):
    n, e = both(s, d)
    t = n.select("id", "type")
    j = e.select("id", "src", "dst").join(t.select(F.col("id").alias("src"), F.col("type").alias("x")), "src").join(t.select(F.col("id").alias("dst"), F.col("type").alias("y")), "dst")
    return j.select("id", C.predicted_type(F.col("x"), F.col("y"), {("Customer", "Part"): "MAY_BUY", ("Supplier", "Part"): "MAY_BE_SUPPLIED_BY"}).alias("predicted"))


@query("f14_array_edits", "SELECT id, CAST(len(CASE WHEN list_contains(file_ids, 'shared') THEN file_ids ELSE list_append(file_ids, 'shared') END) AS INTEGER) AS added, array_to_string(list_filter(file_ids, lambda f: f <> 'shared'), ',') AS dropped FROM nodes")
def _(s, d):
    return G.graph_nodes(s, d).select("id", F.size(C.array_add(F.col("file_ids"), F.lit("shared"))).alias("added"), F.array_join(C.array_drop(F.col("file_ids"), "shared"), ",").alias("dropped"))


@query("f15_parse_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(s, d):
    fenced = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return G.read_table(s, d, "events").select("event_id", C.parse_json_lenient(fenced)["k"].alias("k"))


@query("f16_merge_maps", "SELECT o_orderkey, o_orderpriority AS a, 'kept' AS b, o_orderstatus AS c FROM orders")
def _(s, d):
    m = C.merge_maps(F.create_map(F.lit("a"), F.lit("lost"), F.lit("b"), F.lit("kept")), F.create_map(F.lit("a"), F.col("o_orderpriority"), F.lit("c"), F.col("o_orderstatus")))
    return G.read_table(s, d, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.col("m")["c"].alias("c"))


@query("f17_relative_time", "SELECT o_orderkey, CASE WHEN k < 60 THEN 'just now' WHEN k < 3600 THEN (k // 60) || ' minute' || CASE WHEN k // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN k < 86400 THEN (k // 3600) || ' hour' || CASE WHEN k // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE (k // 86400) || ' day' || CASE WHEN k // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS t FROM (SELECT o_orderkey, (o_orderkey * 37) % 400000 AS k FROM orders)")
def _(s, d):
    now = F.expr("timestamp '2030-01-01 00:00:00'")
    then = F.timestamp_seconds(F.unix_timestamp(now) - (F.col("o_orderkey") * 37) % 400000)
    return G.read_table(s, d, "orders").select("o_orderkey", C.relative_time(then, now).alias("t"))


@query("f19_embed_text", "SELECT id, coalesce(name, '') || '. Type: ' || type || '. ' || coalesce(description, '') AS t, substr(name, 1, 8) AS preview FROM nodes")
def _(s, d):
    return G.graph_nodes(s, d).select("id", C.embed_text(F.col("name"), F.col("type"), F.col("description")).alias("t"), F.substring("name", 1, 8).alias("preview"))
