"""Line deduplication by a sharded minimal perfect hash.

A line's key is the line stripped of blanks at both ends, with A-Z lower-cased, as a 128-bit hash: one half places it
(shard and perfect hash), the other is its fingerprint. The work in Spark:

1. every batch of documents is reduced to its distinct keys, each with its number of documents and its greatest id, cut
   up by shard; a line that fills a third of the corpus leaves one entry in each batch;
2. each shard adds up its entries, and builds a minimal perfect hash over the keys found in enough documents, with
   arrays of fingerprints, counts and greatest ids (keys below the threshold need no slot: they miss the fingerprint);
3. the batches probe the shards' arrays with their distinct keys; what comes back is keyed by batch;
4. each batch turns the answers into the keys that each document loses, and the documents, read again, drop them.

No line is joined with a line and no list of a line's documents is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import perfect_hash
from kgloom.llm.common import BLANKS, plain, staged, table

_LEAST = -9223372036854775808
_KEY = np.dtype([("place", "<u8"), ("mark", "<u8")])
_PACKETS = "batch long, shard int, keys binary, n_docs binary, max_doc binary"
_INDEX = "shard int, hash binary, marks binary, counts binary, max_doc binary, rest binary, rest_max_doc binary"
#: A shard is dealt so many keys at most, going by the characters of all texts.
_SHARD_KEYS = 1 << 20


def _key(line: str, least: int) -> bytes | None:
    s = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(s.encode().lower()) if len(s) >= least else None


def _digesting(shards: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("n_docs", pa.binary()), ("max_doc", pa.binary())])
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 24
        for n, b in enumerate(batches):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = [sorted({k for line in (t.as_py() or "").split("\n") if (k := _key(line, least))}) for t in b.column("text")]
            sizes = np.array([len(x) for x in lists], np.int64)
            keys = np.frombuffer(b"".join(k for x in lists for k in x), _KEY)
            if not len(keys):
                continue
            uniq, inverse = np.unique(keys, return_inverse=True)
            count = np.bincount(inverse, minlength=len(uniq)).astype(np.uint32)
            top = np.full(len(uniq), _LEAST, np.int64)
            np.maximum.at(top, inverse, np.repeat(ids, sizes))
            shard = (perfect_hash.mixed(uniq["place"], 99) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = [(base + n, -1, keys.tobytes(), sizes.tobytes(), ids.tobytes())]
            rows += [(base + n, int(shard[part[0]]), uniq[part].tobytes(), count[part].tobytes(), top[part].tobytes()) for part in np.split(order, cuts)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return run


def _indexing(min_docs: int) -> Callable[[pa.Table], pa.Table]:
    def run(packets: pa.Table) -> pa.Table:
        columns = {c: b"".join(packets.column(c).to_pylist()) for c in ("keys", "n_docs", "max_doc")}
        keys, inverse = np.unique(np.frombuffer(columns["keys"], _KEY), return_inverse=True)
        count = np.bincount(inverse, np.frombuffer(columns["n_docs"], np.uint32), len(keys)).astype(np.int64)
        top = np.full(len(keys), _LEAST, np.int64)
        np.maximum.at(top, inverse, np.frombuffer(columns["max_doc"], np.int64))
        enough = count >= min_docs
        # Two keys of one placing half (2^-64 each pair) can't both rest in the hash; all but the first are kept in a sorted list.
        places, first = np.unique(keys["place"][enough], return_index=True)
        rest = np.setdiff1d(np.arange(int(enough.sum())), first)
        packed, index = perfect_hash.build(places)
        arrays = [np.zeros(len(places), t) for t in (np.uint64, np.int64, np.int64)]
        for array, values in zip(arrays, (keys["mark"], count, top), strict=True):
            array[index] = values[enough][first]
        return pa.table({"shard": packets.column("shard")[:1].cast(pa.int32()), "hash": [packed], "marks": [arrays[0].tobytes()], "counts": [arrays[1].tobytes()], "max_doc": [arrays[2].tobytes()], "rest": [keys[enough][rest].tobytes()], "rest_max_doc": [top[enough][rest].tobytes()]})

    return run


def _probe(packets: pa.Table, index: pa.Table) -> pa.Table:
    batches, found, tops = [], [], []
    if packets.num_rows and index.num_rows:
        packed, marks, top = (index.column(c)[0].as_py() for c in ("hash", "marks", "max_doc"))
        marks, top = np.frombuffer(marks, np.uint64), np.frombuffer(top, np.int64)
        rest, rest_top = np.frombuffer(index.column("rest")[0].as_py(), _KEY), np.frombuffer(index.column("rest_max_doc")[0].as_py(), np.int64)
        for batch, raw in zip(packets.column("batch").to_pylist(), packets.column("keys").to_pylist(), strict=True):
            keys = np.frombuffer(raw, _KEY)
            at = perfect_hash.lookup(packed, keys["place"])
            hit = np.flatnonzero(at >= 0)
            hit = hit[marks[at[hit]] == keys["mark"][hit]]
            if len(hit):
                batches.append(batch), found.append(keys[hit].tobytes()), tops.append(top[at[hit]].tobytes())
            if len(rest):
                at = np.minimum(np.searchsorted(rest, keys), len(rest) - 1)
                hit = np.flatnonzero(rest[at] == keys)
                if len(hit):
                    batches.append(batch), found.append(keys[hit].tobytes()), tops.append(rest_top[at[hit]].tobytes())
    return pa.table({"batch": pa.array(batches, pa.int64()), "keys": pa.array(found, pa.binary()), "max_doc": pa.array(tops, pa.binary())})


def _decide(lists: pa.Table, hits: pa.Table) -> pa.Table:
    out_ids, out_keys = [], []
    known = np.frombuffer(b"".join(hits.column("keys").to_pylist()), _KEY)
    if lists.num_rows and len(known):
        top = np.frombuffer(b"".join(hits.column("max_doc").to_pylist()), np.int64)
        order = np.argsort(known)
        known, top = known[order], top[order]
        for raw, n, docs in zip(*(lists.column(c).to_pylist() for c in ("keys", "n_docs", "max_doc")), strict=True):
            keys, sizes, ids = np.frombuffer(raw, _KEY), np.frombuffer(n, np.int64), np.frombuffer(docs, np.int64)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            lose = (known[at] == keys) & (top[at] != np.repeat(ids, sizes))
            ends = np.cumsum(sizes)
            for i in np.unique(np.repeat(np.arange(len(ids)), sizes)[lose]):
                part = slice(ends[i] - sizes[i], ends[i])
                out_ids.append(int(ids[i])), out_keys.append(keys[part][lose[part]].tobytes())
    return pa.table({"doc_id": pa.array(out_ids, pa.int64()), "lost": pa.array(out_keys, pa.binary())})


def _dropping(least: int, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(b.column(text_col), b.column("__kg_lost"), strict=True):
                lines = (text.as_py() or "").split("\n")
                n_lines.append(len(lines))
                if lost.is_valid:
                    blobs = b"".join(lost.as_py())
                    gone = {blobs[i : i + 16] for i in range(0, len(blobs), 16)}
                    lines = [x for x in lines if _key(x, least) not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                texts.append("\n".join(lines))
            names = [c for c in b.schema.names if c not in ("__kg_lost", "__kg_id")]
            arrays = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return run


def line_index(df: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, shards: int | None) -> tuple[DataFrame, DataFrame]:
    """The staged packets and the staged index: one row of arrays for each shard."""
    rows = plain(df, doc_id=id_col, text=text_col)
    if not shards:
        # A key has min_chars characters at least.
        keys = (rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // max(1, min_chars)
        shards = max(32, keys // _SHARD_KEYS)
    rows = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)))
    packets = staged(rows.mapInArrow(_digesting(shards, min_chars), _PACKETS))
    index = staged(packets.filter("shard >= 0").groupBy("shard").applyInArrow(_indexing(min_docs), _INDEX))
    return packets, index


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40, shards: int | None = None) -> DataFrame:
    """The input rows with repeated lines dropped from the text, and n_lines (before) and n_dropped.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` rows lose all their lines except in the
    row with the largest id that holds them (in all rows with that id, should ids repeat; null ids lose against any).
    A null or empty text is one empty line and comes out as an empty text. Texts are read whole, however long; memory follows
    the longest. Shorter and blank lines always stay. An empty table gives an empty result. Other columns pass through; input columns named n_lines or n_dropped are replaced.
    """
    df = df.drop("n_lines", "n_dropped")
    packets, index = line_index(df, id_col, text_col, min_docs, min_chars, shards)
    hits = packets.filter("shard >= 0").select("shard", "batch", "keys").groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "batch long, keys binary, max_doc binary")
    lost = packets.filter("shard = -1").groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(_decide, "doc_id long, lost binary")
    lost = lost.groupBy("doc_id").agg(F.collect_list("lost").alias("__kg_lost")).withColumnRenamed("doc_id", "__kg_id")
    rows = df.withColumn("__kg_id", F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LEAST)))
    joined = rows.join(lost.hint("shuffle_hash"), "__kg_id", "left").select(*(F.col(f"`{c}`") for c in df.columns), "__kg_lost")
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return joined.mapInArrow(_dropping(min_chars, text_col), f"{kinds}, n_lines long, n_dropped long")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(plain(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, k.key IS NOT NULL AND l.doc_id <> k.top AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
}
QUERIES = {"op4_line_dedup": op4_line_dedup}
