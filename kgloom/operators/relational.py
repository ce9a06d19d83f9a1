"""Filters, joins, aggregations, windows and set operations over entities, relationships, files and chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.columns import clean_label, grade, health_status
from kgloom.operators.textjoin import contained
from kgloom.sources.graph import adjacency, first_per
from kgloom.sources.stage import staged

# --- filters and projections -------------------------------------------------------------------------------------------


def search_by_name(nodes: DataFrame, q: str, folder: str | None = None, limit: int | None = 50, regex: bool = False) -> DataFrame:
    """Names that hold ``q``, whatever the case; literal unless ``regex``."""
    hit = F.col("name").rlike(f"(?i){q}") if regex else F.contains(F.lower("name"), F.lit(q.lower()))
    out = nodes.filter(hit)
    if folder is not None:
        out = out.filter(F.col("folder_id") == folder)
    return out.orderBy("name", "id").limit(limit) if limit else out


def browse_nodes(nodes: DataFrame, edges: DataFrame, kind: str, q: str = "", page: int = 1, size: int = 20, folder: str | None = None) -> DataFrame:
    """A page of one type's entities, then (for the page only) their neighbours' types with counts."""
    of = nodes.filter(clean_label(F.col("type")) == kind)
    if q:
        of = of.filter(F.contains(F.lower("name"), F.lit(q.lower())))
    if folder is not None:
        of = of.filter(F.col("folder_id") == folder)
    total = of.agg(F.count(F.lit(1)).alias("total"))
    shown = of.orderBy("name", "id").offset((page - 1) * size).limit(size).select("id", "name")
    near = shown.join(adjacency(edges), F.col("id") == F.col("a")).join(nodes.select(F.col("id").alias("b"), F.col("type").alias("near_type")), "b")
    counts = near.groupBy("id", "near_type").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "near_type", "n"))), ",").alias("neighbours"))
    out = shown.join(counts, "id", "left").crossJoin(F.broadcast(total))
    return out.select("id", "name", F.coalesce("neighbours", F.lit("")).alias("neighbours"), "total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def type_counts(nodes: DataFrame, folder: str | None = None) -> DataFrame:
    """P3"""
    if folder is not None:
        nodes = nodes.filter(F.col("folder_id") == folder)
    return nodes.groupBy(clean_label(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def degrees(nodes: DataFrame, edges: DataFrame, mode: str = "incident") -> DataFrame:
    """A3: (id, degree) of every node. incident: all edge ends; distinct: neighbours; in and out: one side."""
    ends = {"in": [edges.select(F.col("dst").alias("id"))], "out": [edges.select(F.col("src").alias("id"))], "distinct": [adjacency(edges).select(F.col("a").alias("id"))]}
    some = ends.get(mode, [edges.select(F.col("src").alias("id")), edges.select(F.col("dst").alias("id"))])
    all_ends = some[0] if len(some) == 1 else some[0].union(some[1])
    counts = all_ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def min_connections(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """P4"""
    return nodes.join(degrees(nodes, edges, "distinct").filter(F.col("degree") >= k), "id")


def extra_properties(df: DataFrame, core: list[str], column: str = "properties") -> DataFrame:
    """The map without core keys, and its ``conflicts`` parsed, empty where that fails."""
    rest = F.map_filter(F.col(column), lambda k, _: ~k.isin(*core, "conflicts"))
    conflicts = F.coalesce(F.from_json(F.col(column)["conflicts"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    return df.withColumn("extra", rest).withColumn("conflicts", conflicts)


def serialize(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text, nested values as JSON."""

    def one(name: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss").alias(name)
        return F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct")) else F.col(name)

    return df.select(*(one(n, k) for n, k in df.dtypes))


def node_details(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """P10: for a table of ids."""
    some = nodes.join(ids.select("id"), "id", "left_semi")
    return some.join(degrees(some, edges), "id").select("id", "name", "type", "degree", F.array_join(F.coalesce("file_ids", F.array()), ",").alias("files"))


def resolve_names(nodes: DataFrame, names: DataFrame, folder: str | None = None) -> DataFrame:
    """(asked) -> the first entity by id whose lower-cased name is the asked one."""
    of = nodes if folder is None else nodes.filter(F.col("folder_id") == folder)
    joined = names.select("asked", F.lower("asked").alias("key")).join(of.select(F.lower("name").alias("key"), "id"), "key")
    return joined.groupBy("asked").agg(F.min("id").alias("id"))


def filter_results(results: DataFrame, folder: str | None = None, ids: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """P12"""
    for given, test in ((folder, F.col("folder_id") == folder), (ids, F.col("id").isin(*(ids or [""]))), (kind, F.lower("type") == (kind or "").lower())):
        if given is not None:
            results = results.filter(test)
    return results


def adopt(nodes: DataFrame, edges: DataFrame, file_id: str, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """Fills empty folders, adds the file, and tags edges whose ends both carry the file."""
    n = nodes.withColumn("folder_id", F.coalesce("folder_id", F.lit(folder_id))).withColumn("file_ids", F.array_union("file_ids", F.array(F.lit(file_id))))
    carried = n.filter(F.array_contains("file_ids", file_id)).select("id")
    both = edges.join(carried.select(F.col("id").alias("src")), "src", "left_semi").join(carried.select(F.col("id").alias("dst")), "dst", "left_semi")
    rest = edges.join(both.select("id"), "id", "left_anti")
    return n, both.withColumn("file_ids", F.array_union("file_ids", F.array(F.lit(file_id)))).unionByName(rest)


def isolate(df: DataFrame, folder_id: str) -> DataFrame:
    """A folder is a partition column."""
    return df.withColumn("folder_id", F.lit(folder_id))


def ensure_ids(df: DataFrame) -> DataFrame:
    """Missing ids from the key's digest, the same whenever the plan runs again."""
    return df.withColumn("id", F.coalesce("id", F.sha2(F.concat_ws("|", "name", "type", "folder_id"), 256)))


def allowed_scope(folders: DataFrame, user: str, requested: DataFrame | None = None) -> DataFrame:
    """P16"""
    own = folders.filter(F.col("owner") == user).select("folder_id")
    return own if requested is None else own.join(requested, "folder_id", "left_semi")


def pending_files(files: DataFrame, folders: DataFrame, user: str | None = None) -> DataFrame:
    """P17, J1"""
    own = folders if user is None else folders.filter(F.col("owner") == user)
    return files.filter(F.col("status") == "pending_review").join(own, "folder_id").select("file_id", "folder_id", "folder_name", "owner")


def status_progress(files: DataFrame) -> DataFrame:
    """P18"""
    s = F.col("status")
    progress = F.when(s == "pending", 0).when(s == "processing", 50).when(s == "pending_review", 90).when(s == "completed", 100).otherwise(0)
    message = F.when(s == "pending", "Waiting").when(s == "processing", "In progress").when(s == "pending_review", "Ready for review").when(s == "completed", "Done").otherwise("Failed")
    return files.select("file_id", progress.alias("progress"), message.alias("message"))


# --- joins -------------------------------------------------------------------------------------------------------------


def files_with_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """J1"""
    return files.join(folders, "folder_id")


def folder_summary(folders: DataFrame, files: DataFrame) -> DataFrame:
    """J2"""
    sums = files.groupBy("folder_id").agg(F.count_distinct("file_id").alias("n_files"), F.sum("file_size").alias("size"))
    return folders.join(sums, "folder_id", "left").select("folder_id", "folder_name", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("size", F.lit(0)).cast("double").alias("size"))


def folder_permissions(permissions: DataFrame, users: DataFrame) -> DataFrame:
    """Permissions (folder_id, user_id, role) with user names where known."""
    return permissions.join(users, "user_id", "left").select("folder_id", "user_id", "role", F.coalesce("user_name", F.lit("Unknown")).alias("user_name"))


def hydrate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J4"""
    a, b = (nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst"))
    out = edges.join(a, "src", "left").join(b, "dst", "left")
    return out.select("id", "src", "dst", F.coalesce(F.nullif("type", F.lit("")), F.lit("RELATED_TO")).alias("type"), F.coalesce("src_name", F.lit("Unknown")).alias("src_name"), F.coalesce("dst_name", F.lit("Unknown")).alias("dst_name"))


def two_hop_pairs(adj: DataFrame) -> DataFrame:
    """(a, b, via) with a < b."""
    left, right = adj.select(F.col("b").alias("via"), "a"), adj.select(F.col("a").alias("via"), "b")
    return left.join(right, "via").filter("a < b").select("a", "b", "via")


def exclude_linked(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """J6"""
    return pairs.join(adj, ["a", "b"], "left_anti")


def typed_pairs(nodes: DataFrame, keys: tuple[str, ...] = ("type", "folder_id"), block: int = 1024) -> DataFrame:
    """Pairs a < b of nodes that agree in ``keys``. A group's nodes are dealt to blocks of about ``block`` by hash and each two
    blocks meet once, so a large group's pairs are spread over tasks; as what meets is small beside its pairs, the number of tasks is given."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = nodes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_of"))
    placed = nodes.select("id", *keys).join(blocks, list(keys)).withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_of")).cast("int"))
    a = placed.select(F.col("id").alias("x"), *keys, F.col("_p").alias("_i"), F.explode(F.sequence(F.col("_p"), F.col("_of") - 1)).alias("_j"))
    b = placed.select(F.col("id").alias("y"), *keys, F.col("_p").alias("_j"), F.explode(F.sequence(F.lit(0), F.col("_p"))).alias("_i"))
    a, b = (x.repartition(parts, *keys, "_i", "_j") for x in (a, b))
    pairs = a.join(b.hint("merge"), [*keys, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("x") < F.col("y")))
    return pairs.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def cross_folder_bridges(nodes: DataFrame) -> DataFrame:
    """(name, folder_a, folder_b, id_a, id_b) for every two folders a < b that hold a name; the least id stands for the
    name's entities in a folder, so a name gives at most as many rows as there are pairs of folders."""
    per = staged(nodes.filter("name is not null and folder_id is not null").groupBy("name", "folder_id").agg(F.min("id").alias("id")))
    a, b = (per.select("name", F.col("folder_id").alias(f"folder_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    return a.join(b, "name").filter("folder_a < folder_b").select("name", "folder_a", "folder_b", "id_a", "id_b")


def rewrite_endpoints(edges: DataFrame, merge_map: DataFrame) -> DataFrame:
    """(old, canonical) applied to both ends."""
    for end in ("src", "dst"):
        m = merge_map.select(F.col("old").alias(end), F.col("canonical").alias("_to"))
        edges = edges.join(m, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges


def match_existing(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each new entity with the existing one of the same folder, lower-cased name and type, if any."""
    known = nodes.groupBy("folder_id", F.lower("name").alias("_name"), F.lower("type").alias("_type")).agg(F.min("id").alias("existing_id"))
    b = batch.withColumn("_name", F.lower("name")).withColumn("_type", F.lower("type"))
    return b.join(known, ["folder_id", "_name", "_type"], "left").drop("_name", "_type")


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J11"""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def match_states(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """(state, id) where either text holds the other."""
    n = nodes.select("id", F.lower("name").alias("_n"))
    s = states.select("state", F.lower("state").alias("_s"))
    both = contained(n, "_n", s, "_s").select("state", "id").union(contained(s, "_s", n, "_n").select("state", "id"))
    return both.distinct()


def find_interventions(matched: DataFrame, edges: DataFrame, to_property: str, to_intervention: str, k: int = 10) -> DataFrame:
    """State -> property <- intervention; strength is the number of chains."""
    first = edges.filter(F.col("type") == to_property).select(F.col("src").alias("id"), F.col("dst").alias("property"))
    second = edges.filter(F.col("type") == to_intervention).select(F.col("dst").alias("property"), F.col("src").alias("intervention"))
    chains = matched.join(first, "id").join(second, "property").filter("id <> intervention")
    return chains.groupBy("intervention").agg(F.count(F.lit(1)).alias("strength")).orderBy(F.desc("strength"), "intervention").limit(k)


def chain_profile(nodes: DataFrame, edges: DataFrame, first: str, second: str) -> DataFrame:
    """Subject -first-> value -second-> quality; values without a quality stay."""
    a = edges.filter(F.col("type") == first).select(F.col("src").alias("subject"), F.col("dst").alias("value"))
    b = edges.filter(F.col("type") == second).select(F.col("src").alias("value"), F.col("dst").alias("quality"))
    out = a.join(b, "value", "left")
    return out.groupBy("subject").agg(F.count_distinct("value").alias("n_values"), F.array_join(F.array_sort(F.collect_set("quality")), ",").alias("qualities"))


def with_source(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """Left join to evidence chunks on chunk_id."""
    return df.join(chunks.select("chunk_id", "content"), "chunk_id", "left")


def link_relationships(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """Relations by name to entity ids: the last entity of a name wins; unlinked relations go."""
    last = ents.groupBy(F.lower("name").alias("_key")).agg(F.max_by("id", F.struct("seq", "id")).alias("_id"))
    out = rels
    for end in ("source", "target"):
        m = last.select(F.col("_key").alias(f"_{end}"), F.col("_id").alias(f"{end}_id"))
        out = out.withColumn(f"_{end}", F.lower(end)).join(m, f"_{end}").drop(f"_{end}")
    return out


def cluster_edges(edges: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, n): edges between different clusters (id, cluster)."""
    a, b = (assign.select(F.col("id").alias(e), F.col("cluster").alias(f"cluster_{e}")) for e in ("src", "dst"))
    out = edges.join(a, "src").join(b, "dst").filter("cluster_src <> cluster_dst")
    return out.groupBy(F.least("cluster_src", "cluster_dst").alias("cluster_a"), F.greatest("cluster_src", "cluster_dst").alias("cluster_b")).agg(F.count(F.lit(1)).alias("n"))


def bridges(adj: DataFrame, left: DataFrame, right: DataFrame, k: int = 20) -> DataFrame:
    """Nodes of neither set with neighbours in both."""
    both = left.select("id").union(right.select("id")).distinct()
    a = adj.join(left.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a").agg(F.count_distinct("b").alias("n_left"))
    b = adj.join(right.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a").agg(F.count_distinct("b").alias("n_right"))
    out = a.join(b, "a").withColumnRenamed("a", "id").join(both, "id", "left_anti")
    return out.orderBy(F.desc(F.col("n_left") + F.col("n_right")), "id").limit(k)


# --- aggregations ------------------------------------------------------------------------------------------------------


def _one(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")


def dashboard_stats(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """A1"""
    out = _one(nodes, "nodes", F.count(F.lit(1))).union(_one(edges, "relationships", F.count(F.lit(1))))
    return out.union(_one(nodes, "types", F.count_distinct("type"))).union(_one(files, "completed_files", F.count_if(F.col("status") == "completed")))


def type_distribution(nodes: DataFrame, folder: str | None = None) -> DataFrame:
    """A2"""
    of = nodes if folder is None else nodes.filter(F.col("folder_id") == folder)
    return of.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4"""
    d = F.col("degree")
    return degrees(nodes, edges).agg(F.min(d).alias("min"), F.max(d).alias("max"), F.round(F.avg(d), 4).alias("mean"), F.percentile(d, 0.5).alias("median"), F.round(F.percentile(d, 0.9), 4).alias("p90"), F.round(F.stddev_samp(d), 4).alias("stdev"))


_BINS = ("0", "1-2", "3-5", "6-10", "11-20", "21+")


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A5"""
    d = F.col("degree")
    of = F.when(d == 0, _BINS[0]).when(d <= 2, _BINS[1]).when(d <= 5, _BINS[2]).when(d <= 10, _BINS[3]).when(d <= 20, _BINS[4]).otherwise(_BINS[5])
    counts = degrees(nodes, edges).groupBy(of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = nodes.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, _BINS))).alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A6, A7"""
    both = nodes.agg(F.count(F.lit(1)).alias("n")).crossJoin(edges.agg(F.count(F.lit(1)).alias("l")))
    n, m = F.col("n"), F.col("l")
    return both.select("n", "l", F.when(n > 1, F.round(2 * m / (n * (n - 1)), 4)).otherwise(0.0).alias("density"), F.when(n > 0, F.round(2 * m / n, 2)).otherwise(0.0).alias("average_degree"), F.when(n > 1, F.round(m / (n * (n - 1)), 6)).otherwise(0.0).alias("directed_density"))


def health_score(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A8"""
    kinds = nodes.agg(F.count_distinct("type").alias("kinds"))
    o = overview(nodes, edges).crossJoin(kinds)
    n, m = F.col("n"), F.col("l")
    no_edges, sparse, small, single = m == 0, (m > 0) & (F.col("density") < 0.01) & (n > 10), n < 5, (F.col("kinds") == 1) & (m > 10)
    points = lambda c, p: F.when(c, p).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), 100 - points(no_edges, 30) - points(sparse, 15) - points(small, 20) - points(single, 10)))
    issues = F.concat_ws(";", F.when(no_edges, "no relationships"), F.when(sparse, "very sparse"), F.when(small, "few entities"), F.when(single, "one type only"))
    return o.select("n", "l", score.alias("score"), grade(score).alias("grade"), issues.alias("issues"))


def health_audit(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """Connectivity, density, completeness and balance with their status; ``components`` is (id, component)."""
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("c"))
    connectivity = sizes.crossJoin(total).select(F.lit("connectivity").alias("metric"), (F.col("c") / F.col("total")).alias("value"))
    density = overview(nodes, edges).select(F.lit("density"), F.col("density"))
    full = nodes.agg(F.avg((F.coalesce(F.trim("description"), F.lit("")) != "").cast("double")).alias("v")).select(F.lit("completeness"), "v")
    p = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("c")).crossJoin(total).withColumn("p", F.col("c") / F.col("total"))
    balance = p.agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"), F.count(F.lit(1)).alias("k")).select(F.lit("balance"), F.when(F.col("k") > 1, F.col("h") / F.ln("k")).otherwise(0.0))
    out = connectivity.union(density).union(full).union(balance).withColumn("value", F.round("value", 4))
    return out.withColumn("status", health_status(F.col("value")))


def backbone_types(edges: DataFrame, k: int = 5) -> DataFrame:
    """A10"""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k)


def extraction_summary(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """A12"""
    a = ents.groupBy(F.lit("entity").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n"))
    b = rels.groupBy(F.lit("relationship").alias("kind"), "type").agg(F.count(F.lit(1)).alias("n"))
    return a.union(b)


def communities(assign: DataFrame) -> DataFrame:
    """(cluster, size, share, rank), greatest first; members stay in ``assign``."""
    sizes = assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first"))
    total = assign.agg(F.count(F.lit(1)).alias("total"))
    return sizes.crossJoin(total).select("cluster", "size", "first", F.round(F.col("size") / F.col("total"), 4).alias("share"))


def top_communities(assign: DataFrame, k: int = 5) -> DataFrame:
    """A25"""
    return assign.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster").limit(k)


def island_summary(components: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of (id, component): number of components, size of the giant, nodes outside it, single nodes, and the names of the
    first nodes of the three islands that follow the giant (by size, then by that node's id)."""
    sizes = staged(components.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("f")))
    after = sizes.orderBy(F.desc("c"), "f").limit(4).orderBy("c", F.desc("f")).limit(3) if sizes.limit(4).count() == 4 else sizes.orderBy("c", F.desc("f")).limit(max(0, sizes.limit(4).count() - 1))
    names = after.join(nodes.select(F.col("id").alias("f"), "name"), "f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "f", "name"))), lambda x: x["name"]), ", ").alias("sample"))
    out = sizes.agg(F.count(F.lit(1)).alias("components"), F.max("c").alias("giant"), (F.sum("c") - F.max("c")).alias("isolated"), F.count_if(F.col("c") == 1).alias("singles"))
    return out.crossJoin(names).withColumn("sample", F.concat("sample", F.when(F.col("components") > 4, ", and others").otherwise("")))


def infer_schema(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """A15"""
    a = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k).select(F.lit("entity").alias("kind"), "type", "n")
    b = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k).select(F.lit("relationship").alias("kind"), "type", "n")
    return a.union(b)


def merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds types that are not yet there."""
    return old.unionByName(new.join(old.select("kind", "type"), ["kind", "type"], "left_anti"))


def by_category(pred: DataFrame) -> DataFrame:
    """A18"""
    return pred.groupBy("predicted_type").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("best"))


def type_examples(nodes: DataFrame, names: int = 5, types: int = 5) -> DataFrame:
    """The first distinct names of the most frequent types; names are ranked by window, not gathered."""
    top = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(types).select("type")
    per = nodes.join(top, "type", "left_semi").select("type", "name").distinct()
    ranked = per.withColumn("n", F.row_number().over(Window.partitionBy("type").orderBy("name"))).filter(F.col("n") <= names)
    return ranked.groupBy("type").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("examples"))


def best_folder(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """Hits of any term by folder, most first."""
    hit = F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("name"), t))
    return nodes.groupBy("folder_id").agg(F.count_if(hit).alias("hits")).orderBy(F.desc("hits"), "folder_id")


def reference_counts(nodes: DataFrame, file_id: str) -> DataFrame:
    """Of a file's entities: how many files refer to each, and whether deleting the file would delete it."""
    n = F.size("file_ids")
    return nodes.filter(F.array_contains("file_ids", file_id)).select("id", n.alias("refs"), (n == 1).alias("deletable"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts that differ by at most max(5, 1 %) agree."""
    both = a.agg(F.count(F.lit(1)).alias("a")).crossJoin(b.agg(F.count(F.lit(1)).alias("b")))
    return both.select("a", "b", F.abs(F.col("a") - F.col("b")).alias("difference"), (F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(5), F.floor(F.greatest("a", "b") * 0.01))).alias("consistent"))


def vocabulary(df: DataFrame, defaults: list[str]) -> DataFrame:
    """A23"""
    extra = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, defaults))).alias("type"))
    return df.select("type").filter("type is not null").union(extra).distinct()


def scope_summary(nodes: DataFrame, k: int = 10) -> DataFrame:
    """A24"""
    total = nodes.agg(F.count(F.lit(1)).alias("total"))
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(k).crossJoin(total)


def file_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A26"""
    a = nodes.select(F.explode("file_ids").alias("file_id")).groupBy("file_id").agg(F.count(F.lit(1)).alias("entities"))
    b = edges.select(F.explode("file_ids").alias("file_id")).groupBy("file_id").agg(F.count(F.lit(1)).alias("relations"))
    return a.join(b, "file_id", "full").select("file_id", F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce("relations", F.lit(0)).alias("relations"))


# --- windows, order, sets ----------------------------------------------------------------------------------------------


def latest_per_session(chat: DataFrame) -> DataFrame:
    """The last message of each session, by aggregation rather than a sort."""
    return chat.groupBy("conv_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("m")).select("conv_id", "m.*")


def chat_window(chat: DataFrame, n: int = 10) -> DataFrame:
    """W2"""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return chat.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def history_context(chat: DataFrame, recent: int = 10, shown: int = 4, clip: int = 150) -> DataFrame:
    """How many messages are old and recent, and the last ones clipped into one string."""
    back = chat.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    text = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= shown, F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, clip)).alias("s"))))), lambda x: x["s"])
    return back.groupBy("conv_id").agg(F.count_if(F.col("_n") > recent).alias("old"), F.count_if(F.col("_n") <= recent).alias("recent"), F.array_join(text, "\n").alias("context"))


def top_k(df: DataFrame, score: str, k: int, tie: str = "id") -> DataFrame:
    """W4"""
    return df.orderBy(F.desc(score), tie).limit(k)


def top_k_per(df: DataFrame, key: str, score: str, k: int, tie: str) -> DataFrame:
    """W5"""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))).filter(F.col("rank") <= k)


def first_seen(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows of the first list in which their key occurs."""
    out = frames[0].withColumn("_list", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        out = out.unionByName(f.withColumn("_list", F.lit(i)))
    return first_per(out, key, [F.col("_list")]).drop("_list")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """Adds the row's number, from 1, among those with the same ``keys`` (not null) in ``order``. Rows are dealt by ranges and
    numbered there; what the ranges before hold of the key is added, so a key's rows never meet in one task."""
    placed = staged(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_p", *keys, F.coalesce(before, F.lit(0)).alias("_before"))
    local = placed.withColumn(name, F.row_number().over(Window.partitionBy("_p", *keys).orderBy(*order)))
    return local.join(counts, ["_p", *keys]).withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def counted_pairs(at: DataFrame, least: int, block: int = 4096) -> DataFrame:
    """(x, y, n): numbers x < y that are in the same groups of ``at`` (chunk_id, x) at least ``least`` times.

    Each number gets the packed ones after it in its groups, in lists of about ``block``, and its pairs are counted where these lists
    lie: a number travels for each pair, not a row."""
    size = at.groupBy("chunk_id").agg(F.ceil(F.count(F.lit(1)) / block).alias("of"))
    lists = at.join(size, "chunk_id").groupBy("chunk_id", F.pmod(F.xxhash64("x"), F.col("of")).alias("part")).agg(F.array_sort(F.collect_list("x")).alias("ys"))
    after = at.join(lists, "chunk_id").select("x", F.filter("ys", lambda y: y > F.col("x")).alias("ys")).filter(F.size("ys") > 0)
    return after.repartition("x").select("x", F.explode("ys").alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def running_before(df: DataFrame, order: str, weight: str, name: str) -> DataFrame:
    """Adds the sum of ``weight`` over all rows before in ``order`` (distinct values), range by range."""
    placed = staged(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_p").agg(F.sum(weight).alias("_s"))
    sums = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(weight).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, local).join(sums, "_p").withColumn(name, F.col(name) + F.col("_before")).drop("_p", "_before")


def ranked_table(df: DataFrame, score: str, tie: str = "id") -> DataFrame:
    """Rank and share of the top score."""
    best = df.agg(F.max(score).alias("_best"))
    ranked = numbered(df, [], [F.desc(score), F.col(tie)], "rank")
    return ranked.crossJoin(best).withColumn("bar", F.when(F.col("_best") > 0, F.round(100 * F.col(score) / F.col("_best"), 2)).otherwise(0.0)).drop("_best")


def encounter_history(events: DataFrame, n: int = 5) -> DataFrame:
    """W9"""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def recent_activity(events: DataFrame, n: int, now: Column) -> DataFrame:
    """W10, F17"""
    from kgloom.functions.columns import relative_time

    target = F.coalesce(F.get_json_object("props", "$.name"), F.concat(F.lit("item "), F.get_json_object("props", "$.k")), F.lit("unknown"))
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "user_id", F.col("event_type").alias("action"), target.alias("target"), relative_time(F.col("ts"), now).alias("when"))


def compare_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, side) with side common, left or right; one full join."""
    a, b = left.select("id").distinct().withColumn("_l", F.lit(True)), right.select("id").distinct().withColumn("_r", F.lit(True))
    return a.join(b, "id", "full").select("id", F.when(F.col("_l") & F.col("_r"), "common").when(F.col("_l"), "left").otherwise("right").alias("side"))


def jaccard(left: DataFrame, right: DataFrame) -> DataFrame:
    """U7"""
    c = compare_sets(left, right).agg(F.count_if(F.col("side") == "common").alias("c"), F.count(F.lit(1)).alias("n"))
    return c.select(F.when(F.col("n") > 0, F.round(F.col("c") / F.col("n"), 3)).otherwise(0.0).alias("jaccard"))


def type_cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """U4"""
    a, b = (d.groupBy("type").agg(F.count(F.lit(1)).alias(c)) for d, c in ((left, "x"), (right, "y")))
    j = a.join(b, "type", "full").select(F.coalesce("x", F.lit(0)).cast("double").alias("x"), F.coalesce("y", F.lit(0)).cast("double").alias("y"))
    s = j.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("xx"), F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("yy"))
    return s.select(F.when(F.col("xx") * F.col("yy") > 0, F.round(F.col("xy") / (F.col("xx") * F.col("yy")), 4)).otherwise(0.0).alias("semantic"))


def structural_similarity(left: DataFrame, right: DataFrame) -> DataFrame:
    """U5"""
    c = compare_sets(left, right).agg(F.count_if(F.col("side") == "common").alias("c"), F.count_if(F.col("side") != "right").alias("l"), F.count_if(F.col("side") != "left").alias("r"))
    size, overlap = F.least("l", "r") / F.greatest("l", "r"), F.col("c") / F.least("l", "r")
    return c.select(F.when(F.least("l", "r") > 0, F.round((size + overlap) / 2, 4)).otherwise(0.0).alias("structural"))


def compare_clusters(left: DataFrame, right: DataFrame, adj: DataFrame) -> DataFrame:
    """One row of counts and similarities."""
    sides = compare_sets(left, right).agg(F.count_if(F.col("side") == "common").alias("common"), F.count_if(F.col("side") == "left").alias("left_only"), F.count_if(F.col("side") == "right").alias("right_only"))
    n = bridges(adj, left, right).agg(F.count(F.lit(1)).alias("bridges"))
    return sides.crossJoin(n).crossJoin(jaccard(left, right)).crossJoin(type_cosine(left, right)).crossJoin(structural_similarity(left, right))


def cluster_members(nodes: DataFrame, folder: str | None = None, file: str | None = None, ids: DataFrame | None = None, assign: DataFrame | None = None, cluster: str | None = None) -> DataFrame:
    """U3"""
    if ids is not None:
        return nodes.join(ids.select("id"), "id", "left_semi")
    if assign is not None:
        return nodes.join(assign.filter(F.col("cluster") == cluster).select("id"), "id", "left_semi")
    return nodes.filter(F.col("folder_id") == folder) if folder is not None else nodes.filter(F.array_contains("file_ids", file))


def missing_in_b(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """U6"""
    out = a.join(b.select("id"), "id", "left_anti").join(b.select("type").distinct(), "type", "left_semi")
    return out.orderBy("id").limit(k).select("id", "name", "type")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The smallest id of each (src, dst, type)."""
    return edges.groupBy("src", "dst", "type").agg(F.min("id").alias("id"))
