"""Registered queries of ingestion, mutation, retrieval, learning, exports and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.operators import ingest as I
from kgloom.operators import learning as M
from kgloom.operators import mutate as D
from kgloom.operators import retrieve as Q
from kgloom.plans.graphs import PAIRS, SIMILAR, undirected
from kgloom.plans.relational import both, written
from kgloom.plans.sql import over
from kgloom.sources import files as S
from kgloom.sources import graph as G
from kgloom.sources.stage import scratch
from kgloom.sources.views import register_views
from kgloom.streaming import jobs as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _region_names(content: bytes) -> str:
    """A caller's parser: what a file of the regions says, as text."""
    import io

    import pyarrow.parquet as pq

    return "\n".join(sorted(pq.read_table(io.BytesIO(content)).column("r_name").to_pylist()))


def query(name: str, sql: str | None = None, recursive: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = over(sql, recursive)
        return f

    return add


def docs(s, d):
    return G.read_table(s, d, "documents").select("doc_id", "text")


def joined(c: str):
    return F.array_join(F.array_sort(c), ",").alias(c)


@query("s8_read_binary_docs", "SELECT string_agg(r_name, chr(10) ORDER BY r_name) AS text FROM region")
def _(s, d):
    return S.read_binary_docs(s, f"{d}/region.parquet", _region_names).select("text")


# --- files and exports -------------------------------------------------------------------------------------------------


@query("s9_admit_files", "SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND length(trim(text)) > 0")
def _(s, d):
    p = docs(s, d).withColumn("path", F.concat(F.lit("a/b."), F.when(F.col("doc_id") % 3 == 0, "exe").when(F.col("doc_id") % 3 == 1, "TXT").otherwise("md")))
    return S.admit_files(p).select("doc_id")


@query("s16_export_json", """SELECT 'node' AS kind, '{"id":"' || id || '","name":"' || name || '","type":"' || type || '","folder_id":"' || folder_id || '"}' AS line FROM nodes UNION ALL SELECT 'rel', '{"id":"' || id || '","src":"' || src || '","dst":"' || dst || '","type":"' || type || '"}' FROM edges""")
def _(s, d):
    return S.export_graph_json(*both(s, d))


@query("s17_export_statements", """SELECT 'node' AS kind, 'CREATE (:`' || type || '` {id: ''' || id || ''', name: ''' || name || '''});' AS line FROM nodes UNION ALL SELECT 'rel', 'MATCH (a {id: ''' || src || '''}), (b {id: ''' || dst || '''}) CREATE (a)-[:`' || type || '`]->(b);' FROM edges""")
def _(s, d):
    return S.export_graph_statements(*both(s, d))


@query("s18_export_report", """, dgr AS (SELECT nodes.id, CAST(coalesce(d, 0) AS BIGINT) AS d FROM nodes LEFT JOIN inc ON nodes.id = inc.id), h AS (SELECT CASE WHEN d = 0 THEN '0' WHEN d <= 2 THEN '1-2' WHEN d <= 5 THEN '3-5' WHEN d <= 10 THEN '6-10' WHEN d <= 20 THEN '11-20' ELSE '21+' END AS bin, count(*) AS n FROM dgr GROUP BY 1)
SELECT 'overview' AS section, 'nodes' AS metric, CAST((SELECT count(*) FROM nodes) AS DOUBLE) AS value UNION ALL SELECT 'overview', 'relationships', (SELECT count(*) FROM edges) UNION ALL SELECT 'overview', 'density', round(2.0 * (SELECT count(*) FROM edges) / ((SELECT count(*) FROM nodes) * ((SELECT count(*) FROM nodes) - 1.0)), 4)
UNION ALL SELECT 'types', type, count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'degrees', bin, coalesce(n, 0) FROM (SELECT unnest(['0', '1-2', '3-5', '6-10', '11-20', '21+']) AS bin) LEFT JOIN h USING (bin) UNION ALL (SELECT 'hubs', id, d FROM dgr ORDER BY d DESC, id LIMIT 10)""")
def _(s, d):
    return S.export_report(*both(s, d))


@query("s20_register_files", "SELECT 'd' || doc_id AS file_id, 'f0' AS folder_id, 'pending' AS status, CAST(strlen(coalesce(text, '')) AS INTEGER) AS file_size FROM documents")
def _(s, d):
    return S.register_files(docs(s, d), "f0")


# --- upserts and deletions ---------------------------------------------------------------------------------------------


@query("s10_upsert_entities", """, b AS (SELECT name, type, folder_id, min('x' || id) AS i FROM (SELECT * FROM nodes WHERE type IN ('Nation', 'Supplier') UNION ALL SELECT id, name || '!', type, folder_id, file_ids, description, confidence FROM nodes WHERE type = 'Nation') GROUP BY 1, 2, 3)
SELECT coalesce(n.id, b.i) AS id, coalesce(n.name, b.name) AS name, array_to_string(list_sort(CASE WHEN b.i IS NULL THEN n.file_ids WHEN n.id IS NULL THEN ['new'] ELSE list_append(n.file_ids, 'new') END), ',') AS file_ids, CAST(len(CASE WHEN b.i IS NULL THEN n.file_ids WHEN n.id IS NULL THEN ['new'] ELSE list_append(n.file_ids, 'new') END) AS INTEGER) AS source_count
FROM nodes n FULL JOIN b ON n.name = b.name AND n.type = b.type AND n.folder_id = b.folder_id""")
def _(s, d):
    n = G.graph_nodes(s, d)
    b = n.filter("type in ('Nation', 'Supplier')").unionByName(n.filter("type = 'Nation'").withColumn("name", F.concat("name", F.lit("!")))).withColumn("id", F.concat(F.lit("x"), "id"))
    return D.upsert_entities(n, b, "new").select("id", "name", joined("file_ids"), "source_count")


@query("s11_upsert_edges", """, b AS (SELECT src, dst, type, 'x' || id AS i FROM edges WHERE type = 'PART_OF' UNION ALL SELECT dst, src, 'HOSTS', 'h' || id FROM edges WHERE type = 'LOCATED_IN')
SELECT coalesce(e.id, b.i) AS id, coalesce(e.src, b.src) AS src, coalesce(e.type, b.type) AS type, array_to_string(list_sort(CASE WHEN b.i IS NULL THEN e.file_ids WHEN e.id IS NULL THEN ['new'] ELSE list_append(e.file_ids, 'new') END), ',') AS file_ids FROM edges e FULL JOIN b ON e.src = b.src AND e.dst = b.dst AND e.type = b.type""")
def _(s, d):
    n, e = both(s, d)
    a = e.filter("type = 'PART_OF'").select(F.concat(F.lit("x"), "id").alias("id"), "src", "dst", "type", "strength")
    h = e.filter("type = 'LOCATED_IN'").select(F.concat(F.lit("h"), "id").alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("HOSTS").alias("type"), "strength")
    gone = a.limit(5).withColumn("src", F.lit("nobody"))
    return D.upsert_edges(e, a.unionByName(h).unionByName(gone), n, "new").select("id", "src", "type", joined("file_ids"))


@query("s13_staging", "SELECT file_id, CASE WHEN status = 'completed' THEN 'approved' ELSE 'pending' END AS status FROM files")
def _(s, d):
    f = G.files_table(s, d)
    base = f.select("file_id", F.to_json(F.struct("folder_id")).alias("payload"), F.lit("pending").alias("status"))
    return D.stage_file(base, f.filter("status = 'completed'").select("file_id", F.lit("{}").alias("payload"), F.lit("approved").alias("status"))).select("file_id", "status")


@query("s6_text_docs", "SELECT CAST(count(*) AS BIGINT) AS rows_, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL")
def _(s, d):
    """Texts written as files with a mark between documents, read back as whole files."""
    path = scratch(s)
    G.read_table(s, d, "documents").filter("text is not null").select(F.concat("text", F.lit("\x01")).alias("value")).write.text(path)
    docs = S.read_text_docs(s, f"{path}/part-*").select(F.explode(F.split("text", "\x01\n")).alias("text")).filter("text <> ''")
    return docs.agg(F.count(F.lit(1)).alias("rows_"), F.sum(F.char_length("text")).alias("chars"))


@query("s7_tabular_docs", "SELECT 'o_orderkey: ' || o_orderkey || ' | o_orderstatus: ' || o_orderstatus AS text FROM orders UNION ALL SELECT 'c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment FROM customer")
def _(s, d):
    """Two tables written as CSV files of different headers into one folder."""
    path = scratch(s)
    G.read_table(s, d, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(path)
    G.read_table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.mode("append").option("header", True).csv(path)
    return S.read_tabular_docs(s, f"{path}/part-*").select("text")


@query("s12_append_table", "SELECT folder_id, CAST(2 * count(*) AS BIGINT) AS n FROM nodes GROUP BY 1")
def _(s, d):
    path = scratch(s)
    for _ in range(2):
        S.append_table(G.graph_nodes(s, d).select("id", "folder_id"), path, "folder_id")
    return s.read.parquet(path).groupBy("folder_id").agg(F.count(F.lit(1)).alias("n"))


@query("s14_set_file_status", "SELECT file_id, CASE status WHEN 'processing' THEN 'failed' WHEN 'pending_review' THEN 'processing' ELSE status END AS status, CASE WHEN status <> 'completed' THEN CAST(length(file_id) AS BIGINT) END AS node_count, CASE WHEN status <> 'completed' THEN 0 END AS relationship_count, CASE WHEN status = 'processing' THEN 'no text' END AS error_message, CASE WHEN status = 'processing' THEN created_at END AS processed_at FROM files")
def _(s, d):
    f = G.files_table(s, d)
    failed = F.col("status") == "processing"
    u = f.filter("status <> 'completed'").select("file_id", F.when(failed, "failed").otherwise("processing").alias("new_status"), F.length("file_id").cast("long").alias("node_count"), F.when(failed, "no text").alias("error_message"), F.col("created_at").alias("at"))
    return D.set_file_status(f, u).select("file_id", "status", "node_count", "relationship_count", "error_message", "processed_at")


_LEFT = ", k AS (SELECT id, list_filter(file_ids, lambda f: f <> 'shared' AND f <> 'cust') AS f FROM nodes WHERE len(list_filter(file_ids, lambda f: f <> 'cust')) > 0), n1 AS (SELECT id, list_filter(file_ids, lambda f: f <> 'cust') AS f FROM nodes WHERE len(list_filter(file_ids, lambda f: f <> 'cust')) > 0)"


@query("d1_delete_file_nodes", _LEFT + " SELECT id, array_to_string(f, ',') AS file_ids FROM n1")
def _(s, d):
    n, e = both(s, d)
    c = docs(s, d).select(F.col("doc_id").alias("chunk_id"), F.lit("cust").alias("file_id"))
    return D.delete_file(n, e, c, "cust")[0].select("id", F.array_join("file_ids", ",").alias("file_ids"))


@query("d1_delete_file_edges", _LEFT + " SELECT e.id FROM edges e WHERE NOT list_contains(file_ids, 'cust') AND src IN (SELECT id FROM n1) AND dst IN (SELECT id FROM n1)")
def _(s, d):
    n, e = both(s, d)
    c = docs(s, d).select(F.col("doc_id").alias("chunk_id"), F.lit("cust").alias("file_id"))
    return D.delete_file(n, e, c, "cust")[1].select("id")


@query("d2_delete_folder", "SELECT id FROM nodes WHERE folder_id <> 'f1' AND len(list_filter(file_ids, lambda f: f NOT IN ('part1', 'supp'))) > 0")
def _(s, d):
    return D.delete_folder(*both(s, d), "f1", ["part1", "supp"])[0].select("id")


@query("d3_delete_entities", "SELECT id FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE confidence > 0.4) AND dst NOT IN (SELECT id FROM nodes WHERE confidence > 0.4)")
def _(s, d):
    n, e = both(s, d)
    return D.delete_entities(n, e, n.filter("confidence > 0.4"))[1].select("id")


@query("d4_add_edges", "SELECT id, type, array_to_string(file_ids, ',') AS files FROM edges UNION ALL SELECT 'z' || e.id, 'DELIVERS_TO', array_to_string(n.file_ids, ',') FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type = 'SUPPLIED_BY'")
def _(s, d):
    n, e = both(s, d)
    new = e.filter("type = 'SUPPLIED_BY'").select(F.concat(F.lit("z"), "id").alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("delivers-to").alias("type"), "strength")
    return D.add_edges(e, new, n).select("id", "type", F.array_join("file_ids", ",").alias("files"))


@query("d5_update_nodes", "SELECT id, CASE WHEN type = 'Part' THEN 'renamed' ELSE name END AS name, description FROM nodes")
def _(s, d):
    n = G.graph_nodes(s, d)
    u = n.filter("type = 'Part'").select("id", F.lit("renamed").alias("name"), F.lit(None).cast("string").alias("description"))
    return D.update_nodes(n, u, ["name", "description"]).select("id", "name", "description")


@query("d6_rename_type", "SELECT id, CASE WHEN type = 'LOCATED_IN' AND list_contains(file_ids, 'supp') THEN 'BASED_IN' ELSE type END AS type FROM edges")
def _(s, d):
    return D.normalize_types(D.rename_type(G.graph_edges(s, d), "LOCATED_IN", "based in", "supp")).select("id", "type")


_DUP = ", m AS (SELECT id AS old, min(id) OVER (PARTITION BY name, type, folder_id) AS c FROM nodes)"


@query("d8_merge_duplicates", _DUP + " SELECT c AS id, count(*) - 1 AS merge_count, string_agg(DISTINCT f, ',' ORDER BY f) AS file_ids FROM (SELECT m.c, m.old, unnest(file_ids) AS f FROM m JOIN nodes ON nodes.id = m.old) JOIN (SELECT c AS cc, count(*) AS k FROM m GROUP BY 1) ON cc = c GROUP BY c, k HAVING true")
def _(s, d):
    n, e = D.merge_duplicates(*both(s, d))
    return n.select("id", "merge_count", joined("file_ids"))


SQL["d8_merge_duplicates"] = over(_DUP + ", k AS (SELECT c, count(*) - 1 AS merge_count FROM m GROUP BY 1), f AS (SELECT c, string_agg(DISTINCT f, ',' ORDER BY f) AS file_ids FROM (SELECT m.c, unnest(file_ids) AS f FROM m JOIN nodes ON nodes.id = m.old) GROUP BY 1) SELECT k.c AS id, merge_count, file_ids FROM k JOIN f ON k.c = f.c")


@query("d7_merge_edges", _DUP + " SELECT e.id, x.c AS src, y.c AS dst FROM edges e JOIN m x ON src = x.old JOIN m y ON dst = y.old WHERE x.c <> y.c")
def _(s, d):
    n, e = both(s, d)
    return D.merge_nodes(n, e, D.duplicate_map(n))[1].select("id", "src", "dst")


@query("d9_set_property", "SELECT id, CASE WHEN folder_id = 'f2' THEN 'checked' ELSE description END AS description FROM nodes")
def _(s, d):
    return D.set_property(G.graph_nodes(s, d), "f2", "description", "checked").select("id", "description")


# --- ingestion ---------------------------------------------------------------------------------------------------------

_SEC = r"""WITH l AS (SELECT doc_id, i AS line, r AS raw, trim(r) AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS r, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
h AS (SELECT *, line > 0 AND t <> '' AND length(t) < 100 AND ((upper(t) = t AND regexp_matches(t, '[A-Za-z]')) OR t LIKE '%:' OR t LIKE '#%' OR regexp_matches(t, '^\d+\. ')) AS hd FROM l),
s AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) FILTER (WHERE NOT hd) AS n_lines, sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (WHERE NOT hd), '')) AS digest FROM s GROUP BY 1, 2"""


@query("i1_detect_sections")
def _(s, d):
    x = I.detect_sections(docs(s, d))
    return x.select("doc_id", "section", F.when(F.col("content") == "", F.sha2(F.lit(""), 256)).otherwise(F.sha2("content", 256)).alias("digest"))


SQL["i1_detect_sections"] = _SEC.replace("count(*) FILTER (WHERE NOT hd) AS n_lines, ", "")


_CHUNKS = _SEC[: _SEC.index("SELECT doc_id, CAST(section")].rstrip() + r""",
sec AS (SELECT doc_id, CAST(section AS BIGINT) AS section, string_agg(raw, chr(10) ORDER BY line) AS content FROM s WHERE NOT hd GROUP BY 1, 2),
pieces AS (SELECT doc_id, section, list_filter(list_transform(string_split(regexp_replace(content, '([.!?])(?:\n[ \t\n\x0B\f\r]*\n|[ \t\n\x0B\f\r]+)|\n[ \t\n\x0B\f\r]*\n', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS v FROM sec),
se AS (SELECT doc_id, section, unnest(v) AS sentence, unnest(range(len(v))) AS seq FROM pieces),
fold AS (SELECT doc_id, section, list_reduce(list_transform(v, lambda x: {'used': length(x), 'at': 0::BIGINT, 'numbers': [0::BIGINT]}), lambda a, b:
  CASE WHEN a.used + 1 + b.used > 1000 THEN {'used': b.used, 'at': a.at + 1, 'numbers': list_append(a.numbers, a.at + 1)} ELSE {'used': a.used + 1 + b.used, 'at': a.at, 'numbers': list_append(a.numbers, a.at)} END).numbers AS numbers FROM pieces WHERE len(v) > 0),
dealt AS (SELECT doc_id, section, unnest(numbers) AS chunk, unnest(range(len(numbers))) AS seq FROM fold),
ch AS (SELECT *, max(chunk) OVER (PARTITION BY doc_id, section) AS last FROM (SELECT doc_id, section, chunk, string_agg(sentence, ' ' ORDER BY seq) AS content FROM se JOIN dealt USING (doc_id, section, seq) GROUP BY 1, 2, 3)),
ck AS (SELECT doc_id, section, chunk, content FROM ch WHERE length(content) >= 100 OR last = 0 OR chunk < last),
tails AS (SELECT *, right(lag(content) OVER (PARTITION BY doc_id, section ORDER BY chunk), 100) AS tail FROM ck),
ov AS (SELECT doc_id || '-' || section || '-' || chunk AS chunk_id, tail IS NOT NULL AS has_overlap, CASE WHEN tail IS NULL THEN content ELSE '[...] ' || CASE WHEN contains(tail, '. ') THEN substr(tail, strpos(tail, '. ') + 2) ELSE tail END || ' ' || content END AS content FROM tails)"""

@query("i2_tabular_layout", "SELECT doc_id, CAST(len(string_split(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1], '|')) AS INTEGER) AS columns, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) - 1 AS INTEGER) AS rows FROM documents WHERE text LIKE '%|%'")
def _(s, d):
    return I.tabular_layout(docs(s, d).filter("text like '%|%'"), r"\|").select("doc_id", "columns", "rows")


@query("i4_sentences")
def _(s, d):
    return I.split_sentences(I.detect_sections(docs(s, d))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


SQL["i4_sentences"] = _CHUNKS + " SELECT doc_id, count(*) AS n, CAST(sum(length(sentence)) AS BIGINT) AS chars FROM se GROUP BY 1"


@query("i5_chunks")
def _(s, d):
    return I.chunk(I.detect_sections(docs(s, d))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


SQL["i5_chunks"] = _CHUNKS + " SELECT doc_id, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM ck GROUP BY 1"


@query("i6_overlap")
def _(s, d):
    return I.chunked(docs(s, d)).select("chunk_id", "has_overlap", F.length("content").alias("chars"))


SQL["i6_overlap"] = _CHUNKS + " SELECT chunk_id, has_overlap, length(content) AS chars FROM ov"


@query("i7_define_schema", "SELECT DISTINCT 'entity' AS kind, type FROM nodes UNION SELECT 'entity', unnest(['Person', 'Organization', 'Location', 'Concept', 'Event', 'Product']) UNION SELECT 'relationship', unnest(['RELATED_TO', 'PART_OF', 'LOCATED_IN', 'WORKS_FOR'])")
def _(s, d):
    return I.define_schema(G.graph_nodes(s, d).select(F.lit("entity").alias("kind"), "type"))


def frequent_words(s, d):
    words = docs(s, d).select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("name")).filter("length(name) >= 9")
    return words.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 8").select("name")


_MENTIONS = _CHUNKS + r""",
fw AS (SELECT name FROM (SELECT unnest(list_distinct(string_split_regex(lower(text), '[^\p{L}\p{N}]+'))) AS name FROM documents) WHERE length(name) >= 9 GROUP BY 1 HAVING count(*) >= 8),
mt AS (SELECT chunk_id, name, count(*) AS n FROM (SELECT chunk_id, unnest(string_split_regex(lower(substr(content, 1, 3000)), '[^\p{L}\p{N}]+')) AS name FROM ov) JOIN fw USING (name) GROUP BY 1, 2)"""


@query("i8_extract_mentions")
def _(s, d):
    return I.extract_mentions(I.chunked(docs(s, d)), frequent_words(s, d))


SQL["i8_extract_mentions"] = _MENTIONS + " SELECT chunk_id, name, n FROM mt"


@query("i10_dedup_batch", "SELECT id, min(id) OVER (PARTITION BY lower(trim(name)), lower(type)) AS canonical FROM nodes")
def _(s, d):
    return I.dedup_batch(G.graph_nodes(s, d).withColumn("seq", F.lit(0)).withColumn("name", F.concat(F.lit(" "), F.upper("name")))).select("id", "canonical")


@query("i11_reconcile", ", k AS (SELECT folder_id, name, type, min(id) AS k FROM nodes WHERE type <> 'Supplier' GROUP BY 1, 2, 3), b AS (SELECT *, min('x' || id) OVER (PARTITION BY name, type) AS c FROM nodes) SELECT 'x' || id AS id, coalesce(k, c) AS canonical, k IS NOT NULL AS matched FROM b LEFT JOIN k USING (folder_id, name, type)")
def _(s, d):
    n = G.graph_nodes(s, d)
    return I.reconcile_entities(n.withColumn("id", F.concat(F.lit("x"), "id")).withColumn("seq", F.lit(0)), n.filter("type <> 'Supplier'"))


@query("i12_fuzzy_matches", ", x AS (SELECT lower(name) AS n, type, min(id) AS id FROM nodes GROUP BY 1, 2) SELECT a.id AS a, b.id AS b, round(1 - levenshtein(a.n, b.n)::DOUBLE / greatest(length(a.n), length(b.n)), 4) AS likeness FROM x a JOIN x b ON a.type = b.type AND a.n < b.n WHERE round(1 - levenshtein(a.n, b.n)::DOUBLE / greatest(length(a.n), length(b.n)), 4) >= 0.85")
def _(s, d):
    return I.fuzzy_matches(G.graph_nodes(s, d))


_VAL = "WITH c AS (SELECT item_id, text, doc_id FROM benchmark LEFT JOIN (SELECT doc_id, text AS content FROM documents) d ON d.doc_id = item_id), v AS (SELECT item_id AS id, CASE WHEN item_id % 7 = 0 THEN 'missing_name' WHEN NOT coalesce(contains(lower(d.text), lower(substr(b.text, 1, 12))) OR contains(d.text, substr(b.text, 1, 50)), false) THEN 'no_evidence' END AS issue FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id) SELECT id, issue, CASE issue WHEN 'missing_name' THEN 'critical' WHEN 'no_evidence' THEN 'warning' END AS severity, CASE issue WHEN 'missing_name' THEN 0.0::DOUBLE WHEN 'no_evidence' THEN 0.6::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM v"


def checked(s, d):
    e = G.read_table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("chunk_id"), F.when(F.col("item_id") % 7 == 0, " ").otherwise(F.substring("text", 1, 12)).alias("name"), F.col("text").alias("source_text"))
    return I.validate_entities(e, docs(s, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))


@query("i13_validate_entities")
def _(s, d):
    return checked(s, d)


SQL["i13_validate_entities"] = _VAL


@query("i14_validate_edges", "SELECT id FROM edges WHERE src NOT LIKE 's%' AND dst NOT LIKE 's%'")
def _(s, d):
    n, e = both(s, d)
    return I.validate_edges(e, n.filter("type <> 'Supplier'")).select("id")


@query("a17_validation_summary")
def _(s, d):
    return I.needs_review(I.validation_summary(checked(s, d)), False)


SQL["a17_validation_summary"] = "SELECT count(*) FILTER (WHERE severity = 'critical') AS removed, count(*) FILTER (WHERE severity = 'warning') AS flagged, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (WHERE severity = 'critical') = 0 AS valid, count(*) FILTER (WHERE severity IS NOT NULL) > 0 AS needs_review FROM (" + _VAL + ")"


@query("i16_approve", ", b AS (SELECT id FROM nodes WHERE type = 'Part') SELECT id, array_to_string(list_sort(CASE WHEN type = 'Nation' THEN list_append(file_ids, 'o1') ELSE file_ids END), ',') AS file_ids FROM nodes")
def _(s, d):
    n, e = both(s, d)
    staging = G.files_table(s, d).select("file_id", "status")
    new = n.filter("type = 'Nation'").withColumn("id", F.concat(F.lit("x"), "id"))
    return D.approve(n, e, staging, new, e.limit(0), "o1")[0].select("id", joined("file_ids"))


@query("i17_embed")
def _(s, d):
    return I.embed(G.graph_nodes(s, d).withColumn("t", F.concat_ws(" ", "name", "description")), "t", 64).select("id", "embedding")


@query("i18_ingest")
def _(s, d):
    n = G.graph_nodes(s, d).withColumn("seq", F.lit(0))
    return I.ingest(docs(s, d), frequent_words(s, d), n, "f0")[2]


SQL["i18_ingest"] = _MENTIONS + ", co AS (SELECT a.name AS source, b.name AS target, count(*) AS n FROM mt a JOIN mt b USING (chunk_id) WHERE a.name < b.name GROUP BY 1, 2 HAVING count(*) >= 2) SELECT source, target, n, substr(sha256(source || '|Concept|f0'), 1, 16) AS source_id, substr(sha256(target || '|Concept|f0'), 1, 16) AS target_id FROM co"


# --- retrieval ---------------------------------------------------------------------------------------------------------


def vectors(s, d):
    return G.read_table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("label"))


_VEC = ", v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS id, v.label, round((1 + list_cosine_similarity(q.e, v.e)) / 2, 5) AS score FROM v q JOIN v ON q.vec_id % 50 = 0), r AS (SELECT query, id, label, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p {}) SELECT query, id, score, rank FROM r WHERE rank <= 10 {}"


@query("r1_vector_search", _VEC.format("WHERE label = 1", ""))
def _(s, d):
    v = vectors(s, d)
    return Q.vector_search(v, v.filter("id % 50 = 0"), scope="1")


@query("r1_vector_search_post", _VEC.format("", "AND label = 1"))
def _(s, d):
    v = vectors(s, d)
    return Q.vector_search(v, v.filter("id % 50 = 0"), scope="1", post_filter=True)


def questions(s, d):
    return G.read_table(s, d, "region").select(F.col("r_regionkey").alias("query"), F.concat(F.lit("Which red ring is in "), "r_name", F.lit("? Nation_"), "r_regionkey").alias("q"))


@query("r2_fulltext_search", r""", dd AS (SELECT id, concat_ws(' ', name, description) AS t FROM nodes), tk AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM dd), tf AS (SELECT id, term, count(*) AS tf FROM tk GROUP BY 1, 2), sz AS (SELECT id, count(*) AS size FROM tk GROUP BY 1), st AS (SELECT avg(size) AS mean, (SELECT count(*) FROM dd) AS n FROM sz),
qs AS (SELECT DISTINCT r_regionkey AS query, unnest(list_filter(regexp_split_to_array(lower('Which red ring is in ' || r_name || '? Nation_' || r_regionkey), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM region), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query, tf.id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))), 4) AS score FROM tf JOIN qs USING (term) JOIN df USING (term) JOIN sz ON sz.id = tf.id, st GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc) SELECT * FROM r WHERE rank <= 20""")
def _(s, d):
    n = G.graph_nodes(s, d).select("id", F.concat_ws(" ", "name", "description").alias("text"))
    return Q.fulltext_search(n, questions(s, d))


_TERMS = ", q AS (SELECT r_regionkey AS query, unnest(['which', 'red', 'ring', lower(r_name), 'nation_' || r_regionkey]) AS term FROM region)"
_LEX = _TERMS + ", lx AS (SELECT DISTINCT query, id FROM nodes JOIN q ON contains(lower(concat_ws(' ', name, description)), term)), l3 AS (SELECT query, id, 0.85::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS k FROM lx) WHERE k <= 20), nx AS (SELECT DISTINCT query, b AS id FROM nodes JOIN q ON contains(lower(name), term) JOIN adj ON adj.a = nodes.id), l4 AS (SELECT query, id, 0.80::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY id) AS k FROM nx) WHERE k <= 15)"
_FUSED = ", fs AS (SELECT query, id, max(score) AS score FROM (FROM l3 UNION ALL FROM l4) GROUP BY 1, 2), fd AS (SELECT fs.*, coalesce(d, 0) AS d FROM fs LEFT JOIN deg ON deg.id = fs.id), fc AS (SELECT query, id, score, round(0.7::DOUBLE * score + 0.3::DOUBLE * d / max(d) OVER (PARTITION BY query), 4) AS combined FROM fd), fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY combined DESC, id) AS rank FROM fc)"


@query("r3_lexical_search", _LEX + " SELECT * FROM l3")
def _(s, d):
    return Q.lexical_search(G.graph_nodes(s, d), questions(s, d))


@query("r4_neighbor_search", _LEX + " SELECT * FROM l4")
def _(s, d):
    return Q.neighbor_search(*both(s, d), questions(s, d))


@query("r5_hybrid_search", _LEX + _FUSED + " SELECT * FROM fr WHERE rank <= 25")
def _(s, d):
    return Q.hybrid_search(*both(s, d), questions(s, d))


@query("r6_entity_profiles", """, m AS (SELECT src AS a, dst AS b, type FROM edges UNION SELECT dst, src, type FROM edges), o AS (SELECT a AS id, b, type FROM m),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY type, b) <= 25),
w AS (SELECT id, c FROM (SELECT DISTINCT k.id, m.b AS c FROM k JOIN m ON m.a = k.b WHERE m.b <> k.id) x WHERE NOT EXISTS (FROM o WHERE o.id = x.id AND o.b = x.c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c) <= 20),
lines AS (SELECT k.id, k.type || ': ' || string_agg(n.name, ', ' ORDER BY n.name) AS line FROM k JOIN nodes n ON n.id = k.b GROUP BY k.id, k.type),
near AS (SELECT id, string_agg(line, chr(10) ORDER BY line) AS t FROM lines GROUP BY 1),
far AS (SELECT w.id, 'beyond: ' || string_agg(n.name, ', ' ORDER BY n.name) AS t FROM w JOIN nodes n ON n.id = w.c GROUP BY 1)
SELECT id, concat_ws(chr(10), near.t, far.t) AS text FROM near LEFT JOIN far USING (id)""")
def _(s, d):
    n, e = both(s, d)
    return Q.entity_profiles(n, e, n)


@query("r7_neighbor_triples", ", m AS (SELECT src AS id, src, type, dst FROM edges UNION ALL SELECT dst, src, type, dst FROM edges), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, type, dst) AS rank FROM m WHERE id LIKE 's%') SELECT k.id, rank, x.name || ' -[' || k.type || ']-> ' || y.name AS triple FROM k JOIN nodes x ON x.id = src JOIN nodes y ON y.id = dst WHERE rank <= 30")
def _(s, d):
    n, e = both(s, d)
    return Q.neighbor_triples(n, e, n.filter("type = 'Supplier'"))


@query("r8_similar_to_seeds", PAIRS + SIMILAR + """, t AS (SELECT a, b, j FROM sm WHERE j >= 0.3 UNION ALL SELECT b, a, j FROM sm WHERE j >= 0.3), r AS (SELECT a, b, round(j, 4) AS similarity, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) AS rank FROM t),
seeds AS (SELECT id FROM nodes WHERE description = 'AUTOMOBILE')
SELECT b AS id, max(similarity) AS similarity FROM r WHERE rank <= 3 AND a IN (FROM seeds) AND b NOT IN (FROM seeds) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(s, d):
    n, e = both(s, d)
    return Q.similar_to_seeds(written(e), n.filter("description = 'AUTOMOBILE'"))


@query("r9_predictions_for", "SELECT id, strength FROM edges WHERE type = 'SUPPLIED_BY' AND src IN (SELECT id FROM nodes WHERE name = 'red ring') ORDER BY strength DESC, id LIMIT 5")
def _(s, d):
    n, e = both(s, d)
    p = e.withColumn("type", F.when(F.col("type") == "SUPPLIED_BY", "PREDICTED_LINK").otherwise(F.col("type")))
    return Q.predictions_for(p, n, n.filter("name = 'red ring'").select("name").distinct()).select("id", "strength")


@query("r10_grounding", ", a AS (SELECT r_regionkey AS query, lower('the ' || r_name || ' and nation_1 and red ring') AS answer FROM region), c AS (SELECT r_regionkey AS query, n_name AS name FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, r_name FROM region) SELECT query, round(avg(CASE WHEN contains(answer, lower(name)) THEN 1.0 ELSE 0 END), 2) AS grounding, round(avg(CASE WHEN contains(answer, lower(name)) THEN 1.0 ELSE 0 END), 2) >= 0.1 AS grounded FROM a JOIN c USING (query) GROUP BY 1")
def _(s, d):
    r = G.read_table(s, d, "region")
    a = r.select(F.col("r_regionkey").alias("query"), F.concat(F.lit("The "), "r_name", F.lit(" and NATION_1 and red ring")).alias("answer"))
    c = r.join(G.read_table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("query"), F.col("n_name").alias("name")).union(r.select("r_regionkey", "r_name"))
    return Q.grounding_score(a, c)


@query("r11_citations", _LEX + _FUSED + " SELECT query, fr.id, name, substr(coalesce(description, ''), 1, 200) AS text, combined AS confidence FROM fr JOIN nodes ON nodes.id = fr.id WHERE rank <= 25")
def _(s, d):
    n, e = both(s, d)
    return Q.citations(Q.hybrid_search(n, e, questions(s, d)), n)


@query("r12_layout", """, k AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS t, count(*) OVER () AS k FROM (SELECT DISTINCT type FROM nodes)),
h AS (SELECT id, t, k, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS j, count(*) OVER (PARTITION BY type) AS n, ('0x' || substr(md5(name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5(folder_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS f FROM nodes JOIN k USING (type)),
g AS (SELECT *, j::DOUBLE / n * 6 * pi() AS w, j::DOUBLE / n * least(100 * 0.3::DOUBLE, n * 10) + 20 * u AS r FROM h)
SELECT id, round(50 * cos(2 * pi() * t / k) + r * cos(w), 3) + 0.0::DOUBLE AS x, round(50 * sin(2 * pi() * t / k) + r * sin(w), 3) + 0.0::DOUBLE AS y, round(400 * (f - 0.5::DOUBLE), 3) + 0.0::DOUBLE AS z FROM g""")
def _(s, d):
    return Q.layout_positions(G.graph_nodes(s, d))


# --- learning ----------------------------------------------------------------------------------------------------------


@query("m1_fastrp")
def _(s, d):
    return M.fastrp(undirected(s, d), 64)


@query("m2_node2vec")
def _(s, d):
    return M.node2vec(undirected(s, d), dim=16, walk_length=8, walks=2, window=4)


@query("m3_m4_link_prediction")
def _(s, d):
    g = undirected(s, d)
    model, v, _ = M.train_link_prediction(g, lambda left: M.fastrp(left, 32))
    return M.predict_links(model, v, g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query("m5_m6_node_types")
def _(s, d):
    v = vectors(s, d)
    model, _ = M.train_node_classifier(v)
    return M.predict_types(model, v)


@query("m7_list_models", "SELECT 'label1' AS name, count(*) AS n FROM embeddings WHERE label = 1")
def _(s, d):
    v, folder = vectors(s, d), scratch(s)
    M.save_model(M.one_label(v, "1"), folder, "label1")
    n = v.filter("label = '1'").agg(F.count(F.lit(1)).alias("n"))
    return M.list_models(s, folder).crossJoin(n).select("name", "n")


# --- the graph in Spark SQL ------------------------------------------------------------------------------------------------


def viewed(s, d):
    n, e = both(s, d)
    register_views(s, n, e, "kg_")
    return s


@query("v1_sql_neighbours", "SELECT n.id, n.name, n.type FROM adj JOIN nodes n ON n.id = b WHERE a = 's5'")
def _(s, d):
    return viewed(s, d).sql("SELECT * FROM kg_neighbours('s5')")


@query("v2_sql_expand", ", t(id, d) AS (SELECT 'c7', 0 UNION SELECT b, d + 1 FROM t JOIN adj ON id = a WHERE d < 2) SELECT id, min(d) AS hops FROM t GROUP BY 1", recursive=True)
def _(s, d):
    return viewed(s, d).sql("SELECT * FROM kg_expand('c7', 2)")


@query("v3_sql_path", ", t(p, id, d) AS (SELECT 'c7', 'c7', 0 UNION ALL SELECT p || ' > ' || b, b, d + 1 FROM t JOIN adj ON id = a WHERE d < 4 AND id <> 's5') SELECT p AS path, d AS hops FROM t WHERE id = 's5' ORDER BY d, p LIMIT 1", recursive=True)
def _(s, d):
    return viewed(s, d).sql("SELECT * FROM kg_path('c7', 's5')")


# --- streaming jobs in their batch form ----------------------------------------------------------------------------------


@query("t1_ingest_stream", "SELECT doc_id, lang, length(text) AS n_chars FROM documents")
def _(s, d):
    target, docs_ = scratch(s), G.read_table(s, d, "documents")
    # A stream reads a folder of files; the table may be a single one.
    docs_.write.parquet(f"{target}/in")
    stream = T.read_stream(s, f"{target}/in", docs_)
    merge = T.merged_once(f"{target}/merged", lambda df: df.select("doc_id", "lang", F.char_length("text").cast("long").alias("n_chars")))
    T.ingest_stream(stream, merge, f"{target}/checkpoint").awaitTermination()
    return T.ingested(s, f"{target}/merged").select("doc_id", "lang", "n_chars")


@query("t2_latest_progress", "SELECT user_id, event_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1")
def _(s, d):
    return T.latest_progress(G.read_table(s, d, "events"))


@query("t3_rate_counts", "SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS n, count(*) > 100 AS over FROM events GROUP BY 1, 2")
def _(s, d):
    return T.rate_counts(G.read_table(s, d, "events"))


@query("t4_latency_rollup", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most, quantile_disc(value, 0.95) AS p95 FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def _(s, d):
    return T.latency_rollup(G.read_table(s, d, "events"))


@query("t5_presence", ", e AS (SELECT *, json_extract_string(props, '$.k') AS room FROM events WHERE event_type IN ('signup', 'view', 'click', 'error')), l AS (SELECT room, user_id, max_by(event_type, (ts, event_id)) AS last FROM e GROUP BY 1, 2) SELECT room, count(*) FILTER (WHERE last <> 'error') AS present, count(*) AS seen FROM l GROUP BY 1")
def _(s, d):
    return T.presence(G.read_table(s, d, "events"))
