"""Entities and relationships as DataFrames: schemas, a graph over the star-schema tables, scopes and projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_STRINGS = T.ArrayType(T.StringType())
NODE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("folder_id", T.StringType()),
    T.StructField("file_ids", _STRINGS), T.StructField("description", T.StringType()), T.StructField("confidence", T.DoubleType()),
])
EDGE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("type", T.StringType()),
    T.StructField("strength", T.DoubleType()), T.StructField("file_ids", _STRINGS),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relational table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _node(df: DataFrame, id_, name, kind: str, folder, file_, shared_key: str, description, confidence) -> DataFrame:
    files = F.when(F.col(shared_key) % 5 == 0, F.array(file_, F.lit("shared"))).otherwise(F.array(file_))
    return df.select(id_.alias("id"), name.alias("name"), F.lit(kind).alias("type"), folder.alias("folder_id"), files.alias("file_ids"), description.cast("string").alias("description"), confidence.cast("double").alias("confidence"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as entities."""
    t = lambda n: read_table(spark, sf_dir, n)
    folder = t("nation").select("n_nationkey", _key("f", "n_regionkey").alias("folder"))
    cust = t("customer").join(folder, F.col("c_nationkey") == F.col("n_nationkey"))
    supp = t("supplier").join(folder, F.col("s_nationkey") == F.col("n_nationkey"))
    null = F.lit(None)
    parts = [
        _node(t("region"), _key("r", "r_regionkey"), F.col("r_name"), "Region", _key("f", "r_regionkey"), F.lit("geo"), "r_regionkey", F.lit(""), null),
        _node(t("nation"), _key("n", "n_nationkey"), F.col("n_name"), "Nation", _key("f", "n_regionkey"), F.lit("geo"), "n_nationkey", F.lit(""), null),
        _node(cust, _key("c", "c_custkey"), F.col("c_name"), "Customer", F.col("folder"), F.lit("cust"), "c_custkey", F.col("c_mktsegment"), F.abs("c_acctbal") / 16384),
        _node(supp, _key("s", "s_suppkey"), F.col("s_name"), "Supplier", F.col("folder"), F.lit("supp"), "s_suppkey", null, F.abs("s_acctbal") / 16384),
        _node(t("part"), _key("p", "p_partkey"), F.col("p_name"), "Part", F.concat(F.lit("f"), (F.col("p_size") % 5).cast("string")), F.concat(F.lit("part"), (F.col("p_size") % 4).cast("string")), "p_partkey", F.concat("p_brand", F.lit(" "), "p_type"), F.col("p_retailprice") / 16384),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def graph_edges(spark: SparkSession, sf_dir: str, every: bool = False) -> DataFrame:
    """PART_OF and LOCATED_IN from keys; SUPPLIED_BY names a part's main supplier and BOUGHT a customer's favourite part, by the
    largest quantity and spending in all line items; SERVED_BY a customer's supplier of that part.

    With ``every``, each pair of a part and a supplier, a customer and a part, a customer and a supplier in the line items is a relationship,
    with the summed quantity or spending for its strength."""
    t = lambda n: read_table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("decimal(18,2)").alias("qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    bought = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    if every:
        by_supplier = lines.groupBy("l_partkey", F.col("l_suppkey").alias("to")).agg(F.sum("qty").alias("w"))
        # Both relations of a customer from one join and one exchange.
        ends = F.array(*(F.struct(F.lit(p).alias("prefix"), F.col(c).alias("to")) for p, c in (("p", "l_partkey"), ("s", "l_suppkey"))))
        spent = bought.select("o_custkey", "price", F.explode(ends).alias("end")).groupBy("o_custkey", "end.prefix", "end.to").agg(F.sum("price").alias("w"))
    else:
        # Dealt by the key of the second grouping, so that the first needs no exchange of its own.
        by_supplier = lines.select("l_partkey", "l_suppkey", "qty").repartition("l_partkey").groupBy("l_partkey", F.col("l_suppkey").alias("to")).agg(F.sum("qty").alias("w"))
        by_supplier = by_supplier.groupBy("l_partkey").agg(F.max_by("to", F.struct("w", -F.col("to"))).alias("to"), F.max("w").alias("w"))
        spent = bought.select("o_custkey", "l_partkey", "price").repartition("o_custkey").groupBy("o_custkey", F.col("l_partkey").alias("to")).agg(F.sum("price").alias("w"))
        spent = spent.groupBy("o_custkey").agg(F.max_by("to", F.struct("w", -F.col("to"))).alias("to"), F.max("w").alias("w"))
        served = spent.select("o_custkey", F.col("to").alias("l_partkey")).join(by_supplier.select("l_partkey", F.col("to").alias("by")), "l_partkey").withColumn("w", F.lit(1.0))

    def edge(df: DataFrame, src, dst, kind: str | F.Column, strength, file_: str) -> DataFrame:
        return df.select(F.concat_ws("-", src, dst).alias("id"), src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), strength.cast("double").alias("strength"), F.array(F.lit(file_)).alias("file_ids"))

    parts = [
        edge(t("nation"), _key("n", "n_nationkey"), _key("r", "n_regionkey"), "PART_OF", F.lit(1.0), "geo"),
        edge(t("customer"), _key("c", "c_custkey"), _key("n", "c_nationkey"), "LOCATED_IN", F.lit(None), "cust"),
        edge(t("supplier"), _key("s", "s_suppkey"), _key("n", "s_nationkey"), "LOCATED_IN", F.lit(None), "supp"),
        edge(by_supplier, _key("p", "l_partkey"), _key("s", "to"), "SUPPLIED_BY", F.col("w"), "part"),
    ]
    if every:
        parts.append(edge(spent, _key("c", "o_custkey"), F.concat("prefix", F.col("to").cast("string")), F.when(F.col("prefix") == "p", "BOUGHT").otherwise("SERVED_BY"), F.col("w"), "cust"))
    else:
        parts += [edge(spent, _key("c", "o_custkey"), _key("p", "to"), "BOUGHT", F.col("w"), "cust"), edge(served, _key("c", "o_custkey"), _key("s", "by"), "SERVED_BY", F.col("w"), "cust")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, without self-loops: (a, b). Edges travel once and are turned after."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    return e.select(F.explode(_ways("x", "y")).alias("e")).select("e.a", "e.b")


def _ways(x: str, y: str) -> F.Column:
    return F.array(F.struct(F.col(x).alias("a"), F.col(y).alias("b")), F.struct(F.col(y).alias("a"), F.col(x).alias("b")))


def scope_nodes(nodes: DataFrame, folder_id: str | None = None, file_id: str | None = None, node_ids: list[str] | None = None) -> DataFrame:
    """By explicit ids, else by folder and file, else all."""
    if node_ids:
        return nodes.filter(F.col("id").isin(*node_ids))
    if folder_id is not None:
        nodes = nodes.filter(F.col("folder_id") == folder_id)
    if file_id is not None:
        nodes = nodes.filter(F.array_contains("file_ids", file_id))
    return nodes


def scope_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return edges


def file_graph(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame]:
    """S3: what carries the file, ends and edges alike."""
    n = scope_nodes(nodes, file_id=file_id)
    return n, scope_edges(edges.filter(F.array_contains("file_ids", file_id)), n)


def graph_view(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` nodes by id, and at most twice as many edges between them."""
    n = nodes.orderBy("id").limit(limit)
    return n, scope_edges(edges, n).orderBy("id").limit(2 * limit)


@dataclass(frozen=True)
class Projection:
    """Nodes and weighted edges (src, dst, weight); undirected projections hold both directions."""

    nodes: DataFrame
    edges: DataFrame
    undirected: bool


def project(nodes: DataFrame, edges: DataFrame, undirected: bool = False, scope_mode: str | None = None, folder_id: str | None = None, file_id: str | None = None) -> Projection:
    """The graph an algorithm runs on. Directed projections are induced by the scope; undirected ones cover the whole
    graph and results are filtered afterwards, unless ``scope_mode`` says otherwise."""
    mode = scope_mode or ("global_then_filter" if undirected else "induced")
    if mode == "induced":
        nodes = scope_nodes(nodes, folder_id, file_id)
        if folder_id is not None or file_id is not None:
            edges = scope_edges(edges, nodes)
    e = edges.select("src", "dst", F.coalesce("strength", F.lit(1.0)).alias("weight"))
    if undirected:
        # Edges travel once; both directions arise after.
        e = e.filter("src <> dst").groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.max("weight").alias("weight"))
        e = e.select(F.explode(_ways("x", "y")).alias("e"), "weight").select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "weight")
    return Projection(nodes, e, undirected)


def files_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files of the customers' folders: file_id, folder_id, status, size, created_at."""
    status = F.element_at(F.create_map(F.lit("F"), F.lit("completed"), F.lit("O"), F.lit("pending_review"), F.lit("P"), F.lit("processing")), F.col("o_orderstatus"))
    return read_table(spark, sf_dir, "orders").select(_key("o", "o_orderkey").alias("file_id"), _key("c", "o_custkey").alias("folder_id"), status.alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("file_size"), F.col("o_orderdate").alias("created_at"))


def folders_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders owned by nations: folder_id, folder_name, owner."""
    return read_table(spark, sf_dir, "customer").select(_key("c", "c_custkey").alias("folder_id"), F.col("c_name").alias("folder_name"), _key("n", "c_nationkey").alias("owner"))


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
