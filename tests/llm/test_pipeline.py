"""Each stage against brute force, on its own input."""

import corpus_pipeline as cp
from pyspark.sql import functions as F
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as near_brute
from test_packing import check

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = cp.language(spark, docs, D)
    assert kept.columns == docs.columns
    before, after = docs.count(), kept.count()
    assert after >= 0.98 * before
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lines = cp.lines(spark, kept, D)
    assert lines.columns == docs.columns and lines.filter("n_chars <> char_length(text)").count() == 0
    got = {r.doc_id: r.text for r in lines.collect()}
    want = [eval(x) for x in lines_brute(rows)]  # noqa: S307  tuples that the brute force printed
    assert got == {i: t for i, t, *_ in want}
    near = cp.near_duplicates(spark, lines, D)
    want = [eval(x) for x in near_brute(list(got.items()), 80)]  # noqa: S307
    assert near.columns == docs.columns
    left = {r.doc_id: r.text for r in near.collect()}
    assert sorted(left) == sorted(i for i, _, _, keep in want if keep)
    padding, n = check(cp.packing(spark, near, D).collect(), left, 2048)
    assert padding <= 0.02 * 2048 * n


def test_run_and_empty_input(spark):
    out = cp.run(spark, D)
    assert out.agg(F.sum("length")).first()[0] > 0
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, D)
    assert docs.count() == 0


def test_clashing_columns_null_and_repeated_ids(spark):
    """Columns named like what stages make come through as they were; null and repeated ids and null texts are each a row."""
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(60)
    odd = docs.limit(3).select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:]).union(docs.limit(2)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    more = docs.union(odd)
    names = ["language", "n_lines", "kept", "n_shingles", "language_accepted", "__kg_lost", "part", "rank", "h"]
    for i, c in enumerate(names):
        more = more.withColumn(c, F.lit(i))
    kept = cp.staged(cp.language(spark, more, D))
    assert kept.columns == more.columns and kept.filter("text is null").count() == 0
    lines = cp.staged(cp.lines(spark, kept, D))
    assert lines.columns == more.columns and lines.count() == kept.count()
    near = cp.staged(cp.near_duplicates(spark, lines, D))
    assert near.columns == more.columns and near.filter("doc_id is null").count() == lines.filter("doc_id is null").count()
    for df in (kept, lines, near):
        assert [r[0] for r in df.select(F.array(*names)).distinct().collect()] == [list(range(len(names)))]
    assert cp.packing(spark, near, D).filter("start = 0").count() == near.count()
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert cp.language(spark, unlabelled, D).count() == docs.count()
