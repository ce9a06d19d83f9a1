"""Document fingerprints by a quartile bucket digest.

A window of five bytes slides over the text; six triplets of each window are hashed into buckets, the bucket counts are
compared with their own quartiles, and two bits for each bucket, a logarithmic length code and a checksum of the counts
make the digest. Two digests differ by a bounded score: the sum of the buckets' quartile distances (opposite ends count
double) and the distance of the length codes; likeness is 1 for equal digests and 0 from ``_WORST`` on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm.common import plain, staged, table

BUCKETS = 512
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)
#: The score from which two texts have nothing in common.
_WORST = 1.5 * BUCKETS
_BYTES = 1 << 18


def digests(texts: list[str]) -> list[str]:
    """The digest of each text in hex: 2 digits of length, 2 of checksum, then two bits for each bucket."""
    data = [t.encode() for t in texts]
    out: list[str] = []
    at = 0
    while at < len(data):
        to, room = at + 1, len(data[at])
        while to < len(data) and room + len(data[to]) <= _BYTES:
            room += len(data[to])
            to += 1
        out += _digests(data[at:to])
        at = to
    return out


def _counts(data: list[bytes]) -> np.ndarray:
    n, sizes = len(data), np.array([len(d) for d in data])
    a = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    base = np.repeat(np.arange(n) * BUCKETS, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(a))  # bytes from here to the text's end
    out = np.zeros(n * BUCKETS, np.int64)
    for (i, j, k), factor in zip(_TRIPLETS, _FACTORS, strict=True):
        m = len(a) - k
        if m > 0:
            x = a[i : i + m] | a[j : j + m] << np.uint32(8) | a[k : k + m] << np.uint32(16)
            x = ((x ^ (x >> np.uint32(9))) * factor) >> _SHIFT
            out += np.bincount((base[:m] + x)[left[:m] > k], minlength=len(out))
    return out.reshape(n, BUCKETS)


def _digests(data: list[bytes]) -> list[str]:
    counts = _counts(data)
    ordered = np.sort(counts, axis=1)
    q = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    bits = (counts > q[:, :1]).astype(np.uint8) + (counts > q[:, 1:2]) + (counts > q[:, 2:])
    packed = bits[:, 0::4] | bits[:, 1::4] << 2 | bits[:, 2::4] << 4 | bits[:, 3::4] << 6
    check = (counts * (2 * np.arange(BUCKETS) + 1)).sum(axis=1) & 255
    sizes = np.minimum(255, np.round(8 * np.log2(1 + np.array([len(d) for d in data])))).astype(np.uint8)
    return [f"{s:02x}{c:02x}{p.tobytes().hex()}" for s, c, p in zip(sizes.tolist(), check.tolist(), packed, strict=True)]


_BITS = np.array([[b >> 2 * i & 3 for i in range(4)] for b in range(256)], np.int8)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Of digests pair by pair, from 0 to 1. The checksum only tells equal digests of unequal counts apart."""
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), np.uint8).reshape(len(s), -1) for s in (a, b))
    d = np.abs(_BITS[x[:, 2:]] - _BITS[y[:, 2:]]).reshape(len(a), -1)
    score = (d + 3 * (d == 3)).sum(axis=1) + 2 * np.maximum(0, np.abs(x[:, 0].astype(int) - y[:, 0]) - 1)
    return np.maximum(0.0, 1 - score / _WORST)


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compared(texts: list[str], after: list[str], prints: list[str], prints_after: list[str]) -> list[pa.Array]:
    edited = [t[: len(t) - (k := len(t) // 4)] + n[:k] for t, n in zip(texts, after, strict=True)]
    of_edited = digests(edited)
    columns = [[len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], prints, of_edited, likeness(prints, of_edited), likeness(prints, prints_after)]
    return [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]


def _sliding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition, each with the next; kind 0. The first (kind 1) and the last (kind 2) leave their texts."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    last: tuple[pa.Array, str, str] | None = None

    def rows(kind: int, ids: pa.Array, columns: list[pa.Array] | None, texts: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        columns = columns or [pa.nulls(n, k) for k in _KINDS]
        return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([kind] * n, pa.int32()), ids, *columns, texts], ["part", "kind", *_COLUMNS, "text"])

    for b in batches:
        at, n = 0, b.num_rows
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_pylist()
        while at < n:
            to, room = at + 1, sizes[at]
            while to < n and room + sizes[to] <= 4 * _BYTES:
                room += sizes[to]
                to += 1
            ids = b.column("doc_id").slice(at, to - at)
            texts = [t or "" for t in b.column("text").slice(at, to - at).to_pylist()]
            prints = digests(texts)
            if last is None:
                yield rows(1, ids[:1], None, pa.array(texts[:1], pa.string()))
            else:
                ids, texts, prints = pa.concat_arrays([last[0], ids]), [last[1], *texts], [last[2], *prints]
            if len(texts) > 1:
                yield rows(0, ids[:-1], _compared(texts[:-1], texts[1:], prints[:-1], prints[1:]), pa.nulls(len(texts) - 1, pa.string()))
            last = (ids[-1:], texts[-1], prints[-1])
            at = to
    if last is not None:
        yield rows(2, last[0], None, pa.array([last[1]], pa.string()))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, after = b.column("text").to_pylist(), b.column("after").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_compared(texts, after, digests(texts), digests(after))], _COLUMNS)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint.

    Null texts count as empty; equal texts have equal fingerprints; texts are read whole, however long. Null and repeated ids pass through; an empty table gives an
    empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests([t.as_py() or "" for t in b.column("text")]), pa.string())], ["doc_id", "fingerprint"])

    rows = plain(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def compared_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars/4) code points replaced by the first as many (or all) of the next
    row by ascending id; after the last comes the first. Null ids come first; rows of one id are ordered by text. Null texts count
    as empty; an only row is its own next; an empty table gives an empty result; other columns are ignored.

    Rows are dealt by ranges of the id and sorted; each task looks one row ahead, and only the first and last row of
    each range meet the neighbouring range's.
    """
    rows = plain(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = staged(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_sliding, f"part long, kind int, {result}, text string"))
    # One row for each range.
    heads = out.filter("kind = 1").select("part", F.col("text").alias("after"))
    order = Window.orderBy("part")
    follow = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    tails = out.filter("kind = 2").select("part", "doc_id", "text").join(follow, "part")
    ends = tails.select("doc_id", "text", F.col("next").alias("part")).join(heads, "part").select("doc_id", "text", "after")
    return out.filter("kind = 0").select(*_COLUMNS).unionByName(ends.mapInArrow(_pairs, result))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_fingerprints": op9_fingerprints}
