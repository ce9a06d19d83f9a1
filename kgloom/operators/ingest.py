"""From documents to chunks, mentions, entities and relationships, with deduplication, validation and review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.columns import merge_maps
from kgloom.operators.relational import counted_pairs, link_relationships, numbered, valid_edges
from kgloom.operators.textjoin import alike
from kgloom.sources.stage import staged

#: Entity and relationship types that every folder starts with.
DEFAULT_ENTITY_TYPES = ("Person", "Organization", "Location", "Concept", "Event", "Product")
DEFAULT_RELATION_TYPES = ("RELATED_TO", "PART_OF", "LOCATED_IN", "WORKS_FOR")


def detect_sections(docs: DataFrame, detect_leading: bool = False) -> DataFrame:
    """(doc_id, section, title, start, content): a header is a short line in capitals, with a final colon, a
    markdown mark or a number; a first line is none unless asked for. Texts without content give one empty paragraph."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"))
    t = F.trim("raw")
    letters = t.rlike("[A-Za-z]")
    header = (t != "") & (F.length(t) < 100) & (((F.upper(t) == t) & letters) | t.endswith(":") | t.startswith("#") | t.rlike(r"^\d+\. "))
    if not detect_leading:
        header = header & (F.col("line") > 0)
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("header", header).withColumn("section", F.sum(F.col("header").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("line", "raw")))), lambda x: x["raw"]), "\n")
    title = F.max(F.when(F.col("header"), F.trim(F.regexp_replace(F.trim("raw"), r"^#+\s*|:$", ""))))
    return lines.groupBy("doc_id", "section").agg(F.coalesce(title, F.lit("")).alias("title"), F.min("line").alias("start"), body.alias("content"))


def tabular_layout(docs: DataFrame, sep: str = ",") -> DataFrame:
    """Columns and row count of delimited texts."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.size(F.split(F.get(lines, F.lit(0)), sep)).alias("columns"), (F.size(lines) - 1).alias("rows"), F.lit(sep).alias("delimiter"))


def split_sentences(sections: DataFrame) -> DataFrame:
    """I4: (doc_id, section, title, seq, sentence)."""
    parts = F.filter(F.split("content", r"\n\s*\n|(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    return sections.select("doc_id", "section", "title", F.posexplode(F.transform(parts, lambda x: F.trim(x))).alias("seq", "sentence"))


def chunk(sections: DataFrame, most: int = 1000, least: int = 100) -> DataFrame:
    """(doc_id, section, title, chunk, content): sentences packed greedily up to ``most`` characters; a section
    that fits is one chunk, a last piece shorter than ``least`` of a longer one is dropped. One fold over each section's sentences gives
    the chunk number of each; texts are joined after."""
    s = split_sentences(sections).withColumn("n", F.length("sentence"))
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("seq", "n"))), lambda x: x["n"])
    fold = F.aggregate(
        F.col("lengths"), F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, n: F.when((a["used"] > 0) & (a["used"] + 1 + n > most), F.struct(n.alias("used"), (a["at"] + 1).alias("at"), F.concat(a["out"], F.array(a["at"] + 1)).alias("out")))
        .otherwise(F.struct((a["used"] + F.when(a["used"] > 0, 1).otherwise(0) + n).alias("used"), a["at"].alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))),
        lambda a: a["out"],
    )
    numbers = s.groupBy("doc_id", "section").agg(lengths.alias("lengths")).select("doc_id", "section", F.posexplode(fold).alias("seq", "chunk"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sentence"))), lambda x: x["sentence"]), " ")
    out = s.join(numbers, ["doc_id", "section", "seq"]).groupBy("doc_id", "section", "title", "chunk").agg(text.alias("content"))
    last = F.max("chunk").over(Window.partitionBy("doc_id", "section"))
    out = out.withColumn("last", last).filter((F.length("content") >= least) | (F.col("last") == 0) | (F.col("chunk") < F.col("last")))
    return out.drop("last")


def add_overlap(chunks: DataFrame, n: int = 100) -> DataFrame:
    """Puts the end of the chunk before, in the same section, after its first '. ', in front."""
    before = F.lag("content").over(Window.partitionBy("doc_id", "section").orderBy("chunk"))
    tail = F.right(before, F.lit(n))
    at = F.instr(tail, ". ")
    cut = F.when(at > 0, F.substring(tail, at + 2, F.lit(n))).otherwise(tail)
    return chunks.withColumn("_before", cut).withColumn("has_overlap", F.col("_before").isNotNull()).withColumn("content", F.when(F.col("_before").isNotNull(), F.concat(F.lit("[...] "), "_before", F.lit(" "), "content")).otherwise(F.col("content"))).drop("_before")


def define_schema(known: DataFrame) -> DataFrame:
    """(kind, type): what the folder knows and the defaults."""
    spark = known.sparkSession
    pairs = [("entity", t) for t in DEFAULT_ENTITY_TYPES] + [("relationship", t) for t in DEFAULT_RELATION_TYPES]
    default = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(t).alias("type")) for k, t in pairs))).alias("x")).select("x.*")
    return known.select("kind", "type").union(default).distinct()


def extract_mentions(chunks: DataFrame, dictionary: DataFrame, clip: int = 3000) -> DataFrame:
    """I8's default extractor: (chunk_id, name, n): dictionary words in the chunk's first ``clip`` characters."""
    words = chunks.select("chunk_id", F.explode(F.split(F.lower(F.substring("content", 1, clip)), r"[^\p{L}\p{N}]+")).alias("name")).filter("name <> ''")
    return words.groupBy("chunk_id", "name").agg(F.count(F.lit(1)).alias("n")).join(dictionary.select("name"), "name")


def extract(chunks: DataFrame, extractor: Callable, schema: str) -> DataFrame:
    """I8: a pluggable extractor, an iterator of pandas frames to frames of ``schema``."""
    return chunks.mapInPandas(extractor, schema)


def co_occurrences(mentions: DataFrame, least: int = 2) -> DataFrame:
    """I8: relations between names that share chunks: (source, target, n). Names are numbered in their order, and pairs counted where packed numbers lie."""
    m = mentions.select("chunk_id", "name").filter("chunk_id is not null and name is not null")
    names = staged(numbered(m.select("name").distinct(), [], [F.col("name")], "x").withColumn("x", F.col("x").cast("int")))
    counts = counted_pairs(staged(m.join(names, "name").select("chunk_id", "x")), least)
    return counts.join(names.withColumnRenamed("name", "source"), "x").join(names.select(F.col("name").alias("target"), F.col("x").alias("y")), "y").select("source", "target", "n")


link_extracted = link_relationships  # I9


def dedup_batch(ents: DataFrame) -> DataFrame:
    """Entities (id, seq, name, type) with the canonical id: the first of the same trimmed, lower-cased name and type."""
    key = [F.lower(F.trim("name")), F.lower("type")]
    first = ents.groupBy(*(k.alias(f"_k{i}") for i, k in enumerate(key))).agg(F.min_by("id", F.struct("seq", "id")).alias("canonical"))
    return ents.withColumn("_k0", key[0]).withColumn("_k1", key[1]).join(first, ["_k0", "_k1"]).drop("_k0", "_k1")


def merge_properties(ents: DataFrame) -> DataFrame:
    """By canonical id, maps merged in order, later ones win."""
    maps = F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", "properties"))), lambda x: x["properties"])
    folded = F.aggregate(maps, F.create_map().cast("map<string,string>"), merge_maps)
    return ents.groupBy("canonical").agg(folded.alias("properties"))


def reconcile_entities(ents: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, canonical, matched): batch duplicates, then existing entities of the same folder, name and type."""
    d = dedup_batch(ents)
    known = existing.groupBy("folder_id", F.lower("name").alias("_n"), F.lower("type").alias("_t")).agg(F.min("id").alias("known"))
    out = d.withColumn("_n", F.lower(F.trim("name"))).withColumn("_t", F.lower("type")).join(known, ["folder_id", "_n", "_t"], "left")
    return out.select("id", F.coalesce("known", "canonical").alias("canonical"), F.col("known").isNotNull().alias("matched"))


def fuzzy_matches(ents: DataFrame, threshold: float = 0.85, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs of one type whose names are alike at the threshold: (a, b, likeness). Equal names are one entity already.

    ``judge`` is the caller's: it gets (a, b, type, na, nb, likeness) and keeps what it takes for the same entity.
    """
    x = ents.groupBy(F.lower("name").alias("name"), "type").agg(F.min("id").alias("id"))
    pairs = alike(x, threshold)
    return (judge(pairs) if judge else pairs).select("a", "b", "likeness")


def validate_entities(ents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, issue, severity, confidence): no name: removed; evidence missing in the chunk: flagged; else 0.95."""
    j = ents.join(chunks.select("chunk_id", "content"), "chunk_id", "left")
    nameless = F.coalesce(F.trim("name"), F.lit("")) == ""
    there = F.contains(F.lower("content"), F.lower("name")) | F.contains("content", F.substring("source_text", 1, 50))
    issue = F.when(nameless, "missing_name").when(~F.coalesce(there, F.lit(False)), "no_evidence")
    return j.select("id", issue.alias("issue"), F.when(nameless, "critical").when(issue.isNotNull(), "warning").alias("severity"), F.when(nameless, 0.0).when(issue.isNotNull(), 0.6).otherwise(0.95).alias("confidence"))


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends must exist, the type must not be empty."""
    return valid_edges(edges.filter(F.coalesce(F.trim("type"), F.lit("")) != ""), nodes)


def validation_summary(checked: DataFrame) -> DataFrame:
    """A17"""
    return checked.agg(F.count_if(F.col("severity") == "critical").alias("removed"), F.count_if(F.col("severity") == "warning").alias("flagged"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), (F.count_if(F.col("severity") == "critical") == 0).alias("valid"))


def needs_review(summary: DataFrame, auto_approve: bool, policy: str = "issues") -> DataFrame:
    """Always unless approved automatically; or only where there are issues."""
    need = F.lit(not auto_approve) if policy == "always" else (F.col("removed") + F.col("flagged") > 0) & F.lit(not auto_approve)
    return summary.withColumn("needs_review", need)


def embed(df: DataFrame, text: str, dim: int = 256, out: str = "embedding", embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Hashed, weighted words of unit length; or what ``embedder``, the caller's, makes of the text column (a pandas_udf, say)."""
    if embedder:
        return df.withColumn(out, embedder(F.coalesce(text, F.lit(""))))
    words = df.withColumn("_w", F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    p = Pipeline(stages=[HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dim), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_n")])
    return p.fit(words).transform(words).withColumn(out, vector_to_array("_n")).drop("_w", "_tf", "_idf", "_n")


def chunked(docs: DataFrame) -> DataFrame:
    """I18, first part: sections, chunks and overlap with stable ids."""
    c = add_overlap(chunk(detect_sections(docs)))
    return c.withColumn("chunk_id", F.concat_ws("-", "doc_id", "section", "chunk"))


def ingest(docs: DataFrame, dictionary: DataFrame, existing: DataFrame, folder_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, entities with canonical ids and relationships of new documents."""
    chunks = chunked(docs)
    # Written once: entities and relations both read them, and the texts are cut once.
    mentions = staged(extract_mentions(chunks, dictionary))
    per = mentions.groupBy("name").agg(F.min("chunk_id").alias("chunk_id"), F.sum("n").alias("n"))
    ents = per.select(F.substring(F.sha2(F.concat_ws("|", "name", F.lit("Concept"), F.lit(folder_id)), 256), 1, 16).alias("id"), F.lit(0).alias("seq"), "name", F.lit("Concept").alias("type"), F.lit(folder_id).alias("folder_id"), "chunk_id", "n")
    mapped = ents.join(reconcile_entities(ents, existing), "id")
    rels = link_relationships(co_occurrences(mentions), mapped.select("name", F.col("canonical").alias("id"), "seq"))
    return chunks, mapped, rels
