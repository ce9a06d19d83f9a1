import hashlib
import random

from pyspark.sql import functions as F

from kgloom.llm.common import BLANKS
from kgloom.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = {}
    for i, t in rows:
        t = t or ""
        n = "".join(c for c in t if c not in BLANKS)
        groups.setdefault(n, []).append((-len(t), i is None, i or 0, i))
    out = []
    for i, t in rows:
        n = "".join(c for c in t or "" if c not in BLANKS)
        keep = min(groups[n], key=lambda g: g[:3])[3]
        out.append(str((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest())))
    return sorted(out)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (None, "é x"), (7, "éx"), (None, "only"), (8, "ab"), (8, "ab"), (8, "other"), (-5, "neg"), (9, "n eg"), (10, "x" * 300000), (11, "x" * 300000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, digest string, keep_id int")


def test_rows(spark):
    df = frame(spark, ROWS)
    assert sorted(str(tuple(r)) for r in exact_dedup(df).collect()) == brute(ROWS)
    assert exact_dedup(df.limit(0)).count() == 0


def test_hot_text_and_many_partitions(spark):
    random.seed(1)
    rows = [(i, random.choice(["same text", "same  text", f"text {i % 50}", f"t{i}"])) for i in range(2000)]
    df = frame(spark, rows).repartition(23)
    assert sorted(str(tuple(r)) for r in exact_dedup(df, salts=3).collect()) == brute(rows)


def test_colliding_digests_are_told_apart_by_content(spark):
    """With a digest of one byte, different texts meet in one digest all the time."""
    rows = ROWS + [(100 + i, f"text {i % 90}") for i in range(300)]
    out = exact_dedup(frame(spark, rows), digest=lambda n: F.substring(F.unhex(F.sha2(n, 256)), 1, 1))
    assert sorted(str(tuple(r)) for r in out.collect()) == brute(rows)
