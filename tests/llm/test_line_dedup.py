import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kgloom.llm import line_dedup as ld
from kgloom.llm import perfect_hash
from kgloom.llm.common import BLANKS
from kgloom.llm.line_dedup import line_dedup


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_docs=5, min_chars=40):
    least = -(2**63)
    holders = {}
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append((least if i is None else i, n))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = {k for k in map(key, lines) if len(holders.get(k, ())) >= min_docs and max(holders[k])[0] != (least if i is None else i)}
        kept = [x for x in lines if key(x) not in gone]
        out.append(str((i, "\n".join(kept), len(lines), len(lines) - len(kept))))
    return sorted(out)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50000).astype(np.uint64))
    packed, index = perfect_hash.build(keys)
    assert sorted(index.tolist()) == list(range(len(keys)))
    assert (perfect_hash.lookup(packed, keys) == index).all()
    assert len(packed) < 1.2 * len(keys)
    assert (perfect_hash.lookup(perfect_hash.build(keys[:0])[0], keys[:5]) == -1).all()


def test_rows(spark):
    random.seed(3)
    common = ["This line is long enough to be dropped when it repeats.", "  THIS line is long enough to be dropped when it repeats.\t", "é" * 40, "é" * 39, "short line", "Another line which many of the documents hold, again.", ""]
    rows = []
    for i in range(300):
        lines = random.choices([*common, f"A line of its own in the document with number {i} only."], k=random.randint(0, 9))
        rows.append((i, random.choice(["\n", "\r\n"]).join(lines)))
    rows += [(None, common[0]), (None, common[5]), (7, common[0]), (299, common[0] + "\n" + common[0]), (400, None), (401, ""), (402, "\n"), (403, (common[2] + "\n") * 5000)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, shard string, n_lines int").repartition(6)
    out = line_dedup(df, shards=7)
    assert set(out.columns) == {"doc_id", "text", "shard", "n_lines", "n_dropped"}
    assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_dropped)) for r in out.collect()) == brute(rows)
    assert line_dedup(df.limit(0)).count() == 0


def test_keys_of_one_placing_half():
    """Keys that differ in the other half only are all found, each with its own greatest id."""
    keys = np.array([(7, 1), (7, 2), (7, 3), (9, 1)], ld._KEY)
    n, top = np.array([5, 6, 4, 5], np.uint32), np.array([11, 12, 13, 14], np.int64)
    packets = pa.table({"batch": pa.array([1], pa.int64()), "shard": pa.array([0], pa.int32()), "keys": [keys.tobytes()], "n_docs": [n.tobytes()], "max_doc": [top.tobytes()]})
    index = ld._indexing(5)(packets)
    hits = ld._probe(packets.select(["shard", "batch", "keys"]), index)
    found = np.frombuffer(b"".join(hits.column("keys").to_pylist()), ld._KEY)
    tops = np.frombuffer(b"".join(hits.column("max_doc").to_pylist()), np.int64)
    assert sorted(zip(found.tolist(), tops.tolist(), strict=True)) == [((7, 1), 11), ((7, 2), 12), ((9, 1), 14)]


def test_hot_line_over_many_batches(spark):
    """A line in a third of 30,000 rows, dealt over many batches and shards, stays in the last row alone."""
    hot = "this very line stands in a third of all the documents there are"
    df = spark.range(0, 30000, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(f"own line {hot[:5]} "), F.col("id"), F.lit(f"\n  {hot.upper()} \nend"))).otherwise(F.lit("short")).alias("text"))
    out = ld.line_dedup(df, shards=64)
    assert out.agg(F.sum("n_dropped"), F.count("*")).first() == (9999, 30000)
    assert [r.doc_id for r in out.filter(F.lower("text").contains(hot)).collect()] == [29997]


def test_keys_of_one_placing_half_and_batches_that_miss(spark, monkeypatch):
    """All kept keys share a placing half, so all but one are in the overflow list; most batches hold none of them."""
    digest = ld.xxhash.xxh3_128_digest
    monkeypatch.setattr(ld, "_key", lambda line, least: bytes(8) + digest(line.strip(ld.BLANKS).encode().lower())[8:] if len(line.strip(ld.BLANKS)) >= least else None)
    lines = [f"a repeated line of more than forty characters number {i}" for i in range(3)]
    texts = [lines[i % 3] if i < 30 else f"a line of its own with more than forty characters, number {i}" for i in range(60)]
    rows = pa.table({"doc_id": pa.array(range(60), pa.int64()), "text": texts})
    digests = [pa.Table.from_batches(ld._digesting(1, 40)(iter([b]))) for b in rows.to_batches(max_chunksize=6)]
    packets = pa.concat_tables([t.set_column(0, "batch", pa.array([n] * t.num_rows, pa.int64())) for n, t in enumerate(digests)])
    asked = packets.filter(pa.compute.greater_equal(packets.column("shard"), 0))
    index = ld._indexing(5)(asked)
    hits = ld._probe(asked, index)
    lost = []
    for n in range(len(digests)):
        own = packets.filter(pa.compute.and_(pa.compute.equal(packets.column("batch"), n), pa.compute.less(packets.column("shard"), 0)))
        lost += ld._decide(own, hits.filter(pa.compute.equal(hits.column("batch"), n))).column("doc_id").to_pylist()
    assert sorted(lost) == list(range(27))
    nothing = pa.table({"batch": pa.array([0], pa.int64()), "keys": pa.array([b""]), "max_doc": pa.array([b""])})
    assert ld._decide(packets.filter(pa.compute.less(packets.column("shard"), 0)), nothing).num_rows == 0
