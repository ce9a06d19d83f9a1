"""Changes to the graph: each takes tables and returns new ones; plain Parquet has no update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.columns import upper_type
from kgloom.operators.relational import rewrite_endpoints, valid_edges
from kgloom.sources.graph import scope_edges


def upsert_entities(nodes: DataFrame, batch: DataFrame, file_id: str) -> DataFrame:
    """Merged on (name, type, folder_id): new ones come in, known ones gain the file; source_count is the number of files."""
    key = ["name", "type", "folder_id"]
    new = batch.groupBy(*key).agg(F.min("id").alias("_id"))
    j = nodes.join(new, key, "full")
    files = F.coalesce("file_ids", F.array().cast("array<string>"))
    files = F.when(F.col("_id").isNotNull(), F.array_union(files, F.array(F.lit(file_id)))).otherwise(files)
    out = j.select(F.coalesce("id", "_id").alias("id"), *key, files.alias("file_ids"), "description", "confidence")
    return out.withColumn("source_count", F.size("file_ids"))


def upsert_edges(edges: DataFrame, batch: DataFrame, nodes: DataFrame, file_id: str) -> DataFrame:
    """Keyed (src, dst, type); both ends must exist."""
    key = ["src", "dst", "type"]
    new = valid_edges(batch, nodes).groupBy(*key).agg(F.min("id").alias("_id"), F.max("strength").alias("_s"))
    j = edges.join(new, key, "full")
    files = F.coalesce("file_ids", F.array().cast("array<string>"))
    files = F.when(F.col("_id").isNotNull(), F.array_union(files, F.array(F.lit(file_id)))).otherwise(files)
    return j.select(F.coalesce("id", "_id").alias("id"), *key, F.coalesce("strength", "_s").alias("strength"), files.alias("file_ids"))


def stage_file(staging: DataFrame, new: DataFrame) -> DataFrame:
    """(file_id, payload JSON, status), the new row of a file replaces the old."""
    return staging.join(new.select("file_id"), "file_id", "left_anti").unionByName(new)


def set_file_status(files: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates (file_id, new_status, at) and, where given, node_count, relationship_count (0 without) and error_message;
    processed_at only for completed and failed. Files without an update have none of the four."""
    null = F.lit(None)
    given = lambda c, kind, without: F.coalesce(F.col(c), F.lit(without)) if c in updates.columns else F.lit(without).cast(kind)
    u = updates.select("file_id", "new_status", "at", given("node_count", "long", 0).alias("node_count"), given("relationship_count", "long", 0).alias("relationship_count"), (F.col("error_message") if "error_message" in updates.columns else null.cast("string")).alias("error_message"))
    j = files.select("file_id", "folder_id", "status").join(u, "file_id", "left")
    done = F.col("new_status").isin("completed", "failed")
    return j.select("file_id", "folder_id", F.coalesce("new_status", "status").alias("status"), "node_count", "relationship_count", "error_message", F.when(done, F.col("at")).alias("processed_at"))


def approve(nodes: DataFrame, edges: DataFrame, staging: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I16: what was staged goes into the graph; the staging row goes."""
    n = upsert_entities(nodes, new_nodes, file_id)
    return n, upsert_edges(edges, new_edges, n, file_id), staging.filter(F.col("file_id") != file_id)


def reject(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, staging: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """I16"""
    return (*delete_file(nodes, edges, chunks, file_id), staging.withColumn("status", F.when(F.col("file_id") == file_id, "rejected").otherwise(F.col("status"))))


def _without(df: DataFrame, files: list[str]) -> DataFrame:
    left = F.array_except("file_ids", F.array(*map(F.lit, files)))
    touched = F.arrays_overlap("file_ids", F.array(*map(F.lit, files)))
    return df.withColumn("_left", left).filter(~touched | (F.size("_left") > 0)).withColumn("file_ids", F.col("_left")).drop("_left")


def delete_file(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relationships without any other file go, and edges whose ends went; chunks of the file go."""
    n = _without(nodes, [file_id])
    return n, scope_edges(_without(edges, [file_id]), n), chunks.filter(F.col("file_id") != file_id)


def delete_folder(nodes: DataFrame, edges: DataFrame, folder_id: str, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """All files of the folder at once, then whatever is left in it."""
    n = _without(nodes, files).filter(F.coalesce("folder_id", F.lit("")) != folder_id)
    return n, scope_edges(_without(edges, files), n)


def delete_entities(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D3"""
    n = nodes.join(ids.select("id"), "id", "left_anti")
    for end in ("src", "dst"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    return n, edges


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose id is not there yet."""
    return nodes.unionByName(new.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


def add_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Normalised types; files come from the source node; both ends must exist."""
    ok = valid_edges(new.drop("file_ids"), nodes).withColumn("type", upper_type(F.col("type")))
    ok = ok.join(nodes.select(F.col("id").alias("src"), "file_ids"), "src")
    return edges.unionByName(ok, allowMissingColumns=True)


def update_nodes(nodes: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """Given values win, nulls change nothing."""
    u = updates.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    j = nodes.join(u, "id", "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in nodes.columns))


update_edges = update_nodes  # D5


def rename_type(edges: DataFrame, old: str, new: str, file_id: str | None = None) -> DataFrame:
    """D6"""
    hit = F.col("type") == old
    if file_id is not None:
        hit = hit & F.array_contains("file_ids", file_id)
    return edges.withColumn("type", F.when(hit, F.lit(new)).otherwise(F.col("type")))


def normalize_types(edges: DataFrame) -> DataFrame:
    """D6"""
    return edges.withColumn("type", upper_type(F.col("type")))


def merge_nodes(nodes: DataFrame, edges: DataFrame, merge_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, canonical): files are united, edges re-routed (own type kept), loops from merging dropped, secondaries gone."""
    m = merge_map.filter("old <> canonical")
    moved = nodes.join(m, F.col("id") == F.col("old")).select(F.col("canonical").alias("id"), F.explode_outer("file_ids").alias("f"), F.col("old"))
    gained = moved.groupBy("id").agg(F.collect_set("f").alias("_files"), F.count_distinct("old").alias("_n"))
    kept = nodes.join(m.select(F.col("old").alias("id")), "id", "left_anti").join(gained, "id", "left")
    n = kept.withColumn("file_ids", F.array_union("file_ids", F.coalesce("_files", F.array().cast("array<string>")))).withColumn("merge_count", F.coalesce("_n", F.lit(0))).drop("_files", "_n")
    before = edges.withColumn("_loop", F.col("src") == F.col("dst"))
    e = rewrite_endpoints(before, m).filter("_loop or src <> dst").drop("_loop")
    return n, e


def duplicate_map(nodes: DataFrame, folder: str | None = None) -> DataFrame:
    """(old, canonical) of entities of one name, type and folder: the smallest id stays."""
    of = nodes if folder is None else nodes.filter(F.col("folder_id") == folder)
    key = ["name", "type", "folder_id"]
    first = of.groupBy(*key).agg(F.min("id").alias("canonical"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return of.join(first, key).select(F.col("id").alias("old"), "canonical")


def merge_duplicates(nodes: DataFrame, edges: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """D8"""
    return merge_nodes(nodes, edges, duplicate_map(nodes, folder))


def set_property(nodes: DataFrame, folder: str, column: str, value) -> DataFrame:
    """D9"""
    return nodes.withColumn(column, F.when(F.col("folder_id") == folder, F.lit(value)).otherwise(F.col(column)))
