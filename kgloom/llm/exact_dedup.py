"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Equal rows are combined
three times, each time comparing the full normalised text beside its digest:

1. locally: the partial aggregation of the first grouping, inside each input partition;
2. by salt: groups (digest, salt) merge what the partitions of one salt found, so a text that fills a third of the
   corpus reaches ``salts`` tasks, one row from each partition;
3. globally: at most ``salts`` winners of each text meet.

No list of members is ever built: members find their class by a join on the digest, whose hot keys adaptive execution
splits. Should two different texts share a digest, those digests are joined by digest and text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import BLANKS, plain, staged, table

_TOP = 9223372036854775807
_STEP = "100000000000000000000"


def squeezed(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rank(doc_id: Column, text: Column) -> Column:
    """One fixed-width number that is greatest for the longest text, then the smallest id (null ids last)."""
    n = F.char_length(F.coalesce(text, F.lit(""))).cast("decimal(38,0)")
    place = F.lit(_TOP).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")
    return n * F.lit(_STEP).cast("decimal(21,0)") + F.coalesce(place, F.lit(0).cast("decimal(22,0)"))


def _id(best: Column) -> Column:
    rest = best % F.lit(_STEP).cast("decimal(21,0)")
    return F.when(rest > 0, F.lit(_TOP).cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)") - rest).cast("long")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in the original text stays, then the smallest id.
    Null texts count as empty and equal each other and texts of blanks only. Repeated rows each count; a row whose id
    repeats the kept id is kept too. Null ids lose against any id; where all ids of a class are null, keep_id is null
    and kept is true. Texts are read whole, however long. An empty table gives an empty result. Other columns are ignored.
    """
    rows = plain(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", squeezed(F.col("text")).alias("norm"))
    rows = rows.withColumn("digest", digest(F.col("norm")))

    def classes(some: DataFrame) -> DataFrame:
        each = some.select("digest", "norm", (F.spark_partition_id() % salts).alias("salt"), _rank(F.col("doc_id"), F.col("text")).alias("best"))
        salted = each.groupBy("digest", "salt", "norm").agg(F.max("best").alias("best"), F.count(F.lit(1)).alias("group_size"))
        return salted.groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("group_size").alias("group_size"))

    found = staged(classes(rows).select("digest", _id(F.col("best")).alias("keep_id"), "group_size"))
    shared = found.groupBy("digest").count().filter("count > 1").select("digest")
    members = rows.select("doc_id", "digest", *([] if digest is sha256 else [F.sha2("norm", 256).alias("sha")]))
    if shared.isEmpty():
        out = members.join(found, "digest")
    else:
        twice = rows.join(shared, "digest", "left_semi")
        own = classes(twice).select("digest", "norm", _id(F.col("best")).alias("keep_id"), "group_size")
        other = twice.join(own, ["digest", "norm"]).select(*members.columns[:1], "digest", *([] if digest is sha256 else [F.sha2("norm", 256).alias("sha")]), "keep_id", "group_size")
        out = members.join(shared, "digest", "left_anti").join(found, "digest").select(*other.columns).unionByName(other)
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.col("sha")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op1_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
k AS (SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM k
"""
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
