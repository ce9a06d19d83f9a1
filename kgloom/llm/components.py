"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import staged


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour greater than u is tied to the least of u and its neighbours."""
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """u and its lesser neighbours are tied to the least of them (u > v in each row)."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) for every end of ``links`` (a, b): root is the least id that can be reached. Links to itself are ignored.

    Each step groups by node with partial aggregation and joins the minimum back, so hubs are split like any skewed
    join; each round is written to the shared folder. It stops when a round changes nothing.
    """
    e = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
        before = now
        e = staged(_small_star(_large_star(e)))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
