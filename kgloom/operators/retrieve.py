"""Retrieval over tables of questions: vectors, full text, terms, neighbours, fusion, profiles, grounding, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions.columns import hash_unit, query_terms
from kgloom.operators.links import most_similar, nearest
from kgloom.operators.relational import numbered
from kgloom.operators.textjoin import contained
from kgloom.sources.graph import adjacency
from kgloom.sources.stage import staged


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10, scope: str | None = None, post_filter: bool = False, raw: bool = False) -> DataFrame:
    """(query, id, score, rank); the scope is a value of ``label``, applied before the top k unless ``post_filter``."""
    v = vectors if scope is None or post_filter else vectors.filter(F.col("label") == scope)
    out = nearest(v, queries, k, 5, halved=not raw, itself=True).select("query", "id", F.col("likeness").alias("score"), "rank")
    return out if scope is None or not post_filter else out.join(v.filter(F.col("label") == scope).select("id"), "id", "left_semi").select("query", "id", "score", "rank")


def _tokens(df: DataFrame, id_: str, text) -> DataFrame:
    return df.select(id_, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("term")).filter("term <> ''")


def fulltext_search(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """R2: BM25 over (id, text) for (query, q): (query, id, score, rank)."""
    t = _tokens(docs, "id", F.coalesce("text", F.lit("")))
    tf = t.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = t.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    stats = size.agg(F.avg("size").alias("mean")).crossJoin(docs.agg(F.count(F.lit(1)).alias("n")))
    asked = _tokens(queries, "query", F.col("q")).distinct()
    hits = tf.join(asked.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = hits.join(df, "term").join(size, "id").crossJoin(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    score = s.select("id", "term", w.alias("w")).join(asked, "term").groupBy("query", "id").agg(F.round(F.sum("w"), 4).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)


def lexical_search(nodes: DataFrame, questions: DataFrame, score: float = 0.85, k: int = 20) -> DataFrame:
    """Entities whose name or description holds a term of the question; (query, id, score), k by id."""
    terms = questions.select("query", F.explode(query_terms(F.col("q"))).alias("term")).filter("term <> ''")
    n = nodes.select("id", F.lower(F.concat_ws(" ", "name", "description")).alias("t"))
    hit = contained(n, "t", terms, "term").select("query", "id").distinct()
    r = F.row_number().over(Window.partitionBy("query").orderBy("id"))
    return hit.withColumn("r", r).filter(F.col("r") <= k).select("query", "id", F.lit(score).alias("score"))


def neighbor_search(nodes: DataFrame, edges: DataFrame, questions: DataFrame, score: float = 0.80, k: int = 15) -> DataFrame:
    """Neighbours of entities that match a term."""
    terms = questions.select("query", F.explode(query_terms(F.col("q"))).alias("term")).filter("term <> ''")
    n = nodes.select("id", F.lower("name").alias("t"))
    hit = contained(n, "t", terms, "term").select("query", "id").distinct()
    near = hit.join(adjacency(edges), F.col("id") == F.col("a")).select("query", F.col("b").alias("id")).distinct()
    r = F.row_number().over(Window.partitionBy("query").orderBy("id"))
    return near.withColumn("r", r).filter(F.col("r") <= k).select("query", "id", F.lit(score).alias("score"))


def fuse(lists: list[DataFrame], edges: DataFrame, k: int = 25) -> DataFrame:
    """First-seen hits of the lists in order; 0.7 score + 0.3 degree over the greatest degree of the question's hits."""
    out = lists[0].select("query", "id", "score").withColumn("l", F.lit(0))
    for i, x in enumerate(lists[1:], 1):
        out = out.unionByName(x.select("query", "id", "score").withColumn("l", F.lit(i)))
    first = out.groupBy("query", "id").agg(F.min_by("score", "l").alias("score"))
    d = adjacency(edges).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    j = first.join(d, "id", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    most = F.max("d").over(Window.partitionBy("query"))
    combined = F.round(0.7 * F.col("score") + F.when(most > 0, 0.3 * F.col("d") / most).otherwise(0.0), 4)
    j = j.withColumn("combined", combined)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("combined"), "id"))).filter(F.col("rank") <= k).select("query", "id", "score", "combined", "rank")


def hybrid_search(nodes: DataFrame, edges: DataFrame, questions: DataFrame, vector_hits: DataFrame | None = None, k: int = 25) -> DataFrame:
    """R5"""
    some = [lexical_search(nodes, questions), neighbor_search(nodes, edges, questions)]
    return fuse(([vector_hits] if vector_hits is not None else []) + some, edges, k)


def neighbor_triples(nodes: DataFrame, edges: DataFrame, ids: DataFrame, k: int = 30) -> DataFrame:
    """(id, rank, triple): the first edges of each entity as text."""
    e = edges.select("src", "dst", "type")
    mine = e.join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("id"), "src", "type", "dst").union(e.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("id"), "src", "type", "dst"))
    cut = mine.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("src", "type", "dst"))).filter(F.col("rank") <= k)
    a, b = (nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")) for c in ("src", "dst"))
    return cut.join(a, "src").join(b, "dst").select("id", "rank", F.format_string("%s -[%s]-> %s", "src_name", "type", "dst_name").alias("triple"))


def entity_profiles(nodes: DataFrame, edges: DataFrame, ids: DataFrame, first: int = 25, second: int = 20) -> DataFrame:
    """(id, text): neighbours by relation, then neighbours at two hops; cut before they are gathered.

    Of each way on only the first neighbours are read: at most the entity itself and its own neighbours are left out of what
    it shows beyond, so none after place ``second`` + 1 + its degree can be among the first ``second``. The work grows with the edges, not
    with pairs of a hub's neighbours."""
    e = staged(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").union(edges.select("dst", "src", "type")).distinct())
    one = ids.select("id").join(e, F.col("id") == F.col("a")).select("id", "b", "type")
    kept = staged(numbered(one, ["id"], [F.col("type"), F.col("b")], "r").filter(F.col("r") <= first))
    ranked = numbered(e.select("a", F.col("b").alias("c")).distinct(), ["a"], [F.col("c")], "at")
    reach = one.groupBy("id").agg((F.countDistinct("b") + second + 1).alias("reach"))
    ways = kept.select("id", F.col("b").alias("a")).distinct().join(reach, "id")
    # A way meets the places up to its reach only, octave by octave, and not all of a hub's neighbours.
    octave = lambda c: F.floor(F.log2(F.col(c).cast("double"))).cast("int")
    ways = ways.withColumn("octave", F.explode(F.sequence(F.lit(0), octave("reach"))))
    two = ways.join(ranked.withColumn("octave", octave("at")), ["a", "octave"]).filter("at <= reach and c <> id").select("id", "c").distinct().join(one.select("id", F.col("b").alias("c")), ["id", "c"], "left_anti")
    two = two.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("c"))).filter(F.col("r") <= second)
    name = nodes.select(F.col("id").alias("b"), "name")
    lines = kept.join(name, "b").groupBy("id", "type").agg(F.concat(F.col("type"), F.lit(": "), F.array_join(F.array_sort(F.collect_list("name")), ", ")).alias("line"))
    near = lines.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("near"))
    far = two.join(name.withColumnRenamed("b", "c"), "c").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("far"))
    return near.join(far, "id", "left").select("id", F.concat_ws("\n", "near", F.concat(F.lit("beyond: "), "far")).alias("text"))


def similar_to_seeds(adj: DataFrame, seeds: DataFrame, top: int = 3, cutoff: float = 0.3, k: int = 5) -> DataFrame:
    """The nodes most similar to any seed, from the seeds' own neighbours; each seed names its ``top`` at ``cutoff`` or more."""
    best = most_similar(adj, top, cutoff, seeds).withColumn("similarity", F.round("similarity", 4))
    return best.groupBy(F.col("b").alias("id")).agg(F.max("similarity").alias("similarity")).join(seeds.select("id"), "id", "left_anti").orderBy(F.desc("similarity"), "id").limit(k)


def predictions_for(edges: DataFrame, nodes: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """Stored predicted links that touch the names."""
    ids = nodes.join(names.select("name"), "name", "left_semi").select("id")
    p = edges.filter(F.col("type") == "PREDICTED_LINK")
    hit = p.join(ids.select(F.col("id").alias("src")), "src", "left_semi").unionByName(p.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")).distinct()
    return hit.orderBy(F.desc("strength"), "id").limit(k)


def grounding_score(answers: DataFrame, context: DataFrame, gate: float = 0.10) -> DataFrame:
    """(query, grounding, grounded): the share of context names that the answer holds."""
    j = answers.join(context, "query")
    s = j.groupBy("query").agg(F.round(F.avg(F.contains(F.lower("answer"), F.lower("name")).cast("double")), 2).alias("grounding"))
    return s.withColumn("grounded", F.col("grounding") >= gate)


def citations(hits: DataFrame, nodes: DataFrame, clip: int = 200) -> DataFrame:
    """R11"""
    return hits.join(nodes, "id").select("query", "id", "name", F.substring(F.coalesce("description", F.lit("")), 1, clip).alias("text"), F.coalesce("combined", "score").alias("confidence"))


def layout_positions(nodes: DataFrame, scale: float = 100.0) -> DataFrame:
    """(id, x, y, z): types on a ring, entities on a spiral of three turns around their type by their place in it, with
    a little jitter by name, folders apart along z. Places are numbered range by range (``numbered``)."""
    of = nodes.filter("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    k = of.count()
    ring = numbered(of, [], [F.col("type")], "t").withColumn("t", F.col("t") - 1)
    placed = numbered(nodes.select("id", "name", "type", "folder_id"), ["type"], [F.col("id")], "j").join(ring, "type")
    part = (F.col("j") - 1) / F.col("n")
    centre, angle = 2 * F.pi() * F.col("t") / F.lit(max(1, k)), part * 6 * F.pi()
    r = part * F.least(F.lit(scale * 0.3), F.col("n") * 10.0) + 20 * hash_unit(F.coalesce("name", F.lit("")))
    x, y = scale / 2 * F.cos(centre) + r * F.cos(angle), scale / 2 * F.sin(centre) + r * F.sin(angle)
    return placed.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(scale * 4 * (hash_unit(F.coalesce("folder_id", F.lit(""))) - 0.5), 3).alias("z"))
