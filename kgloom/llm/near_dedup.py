"""Near-duplicate groups by a MinHash LSH forest.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text's set holds the 64-bit hashes of its distinct five-word shingles.

1. One pass gives each text its set size, a 128-bit key of its set, and TREES x DEPTH minimum hashes. Texts with equal
   sets are one class, represented by its smallest id.
2. Each tree is one sorted order of the representatives: rows are dealt by ranges of (tree, signature, id) and sorted,
   so a crowded prefix spreads over tasks. Neighbours that share at least ``_LEAST_DEPTH`` leading hashes form a
   region. In a sparse region all pairs are candidates; a crowded one is cut into chunks in sorted order (neighbours
   there share the longest prefixes, so depth adapts to the crowd), where each row takes its best neighbours and
   the chunk's medoids, and the medoids meet again, in sorted order, at a second level.
   Candidates must agree in about as many minimum hashes as the similarity asks for (4.5 standard deviations of slack).
3. Candidates are confirmed on full sets: first each row's best, then all whose ends are still in different components;
   then, rows whose candidates failed meet the medoids of all their crowded regions.
   Sets are computed again for rows with candidates only, chosen through a bitmap of fixed size.
4. Links are contracted to components by star steps.
5. No pair of a crowded region is left out: where a crowded (or cut) region still holds several components, every row
   outside the region's greatest component meets all rows of the region, in blocks of rows by rows. A block's minimum
   hashes name the rows with a partner in another component, and those rows' full sets are intersected as matrices.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import BLANKS, plain, staged, table
from kgloom.llm.components import components
from kgloom.llm.perfect_hash import mixed

TREES, DEPTH = 10, 6
_HASHES = TREES * DEPTH
_LEAST_DEPTH = 2
_SPARSE = 9
_CHUNK = 768
_BEST = 8
_MEDOIDS = 4
_BLOCK = 512
_COLUMNS = 4096
_BITMAP = 1 << 24

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_BASE = int(_RANDOM.integers(0, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(int(_RANDOM.integers(0, 1 << 62)) * 2 + 1)
_FACTORS = _RANDOM.integers(0, 1 << 62, _HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 64, _HASHES, np.uint64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(18, n.bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, np.uint64(b), np.uint64))]) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [(t or "").encode() for t in texts]
    a = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    forward, back = _powers(len(a) + 1)
    ink = ~_BLANK[a]
    edge = np.flatnonzero(np.diff(ink.astype(np.int8), prepend=np.int8(0)))
    start, stop = edge[0::2], edge[1::2]
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * forward[: len(a)])])
    words = mixed((run[stop] - run[start]) * back[start] + (stop - start).astype(np.uint64), 1)
    first = np.searchsorted(start, np.append(0, ends))
    out = []
    long = np.zeros(0, np.uint64)
    if len(words) >= width:
        long = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            long = long * _STEP + words[k : len(words) - width + 1 + k]
        long = mixed(long, 2)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= width:
            out.append(np.unique(long[i : j - width + 1]))
        elif j > i:
            h = np.zeros(1, np.uint64)
            for w in words[i:j]:
                h = h * _STEP + w
            out.append(mixed(h, 100 + j - i))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _groups(column: pa.Array, octets: int = 1 << 18) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of about a quarter of a megabyte of text, with where each starts."""
    at, texts, room = 0, [], 0
    for n, t in enumerate(column):
        texts.append(t.as_py())
        room += len(texts[-1] or "")
        if room > octets or n == len(column) - 1:
            yield at, texts
            at, texts, room = n + 1, [], 0


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each minimum hash; all sets hold something."""
    values = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), _HASHES), ">u2")
    for k in range(_HASHES):
        low = np.minimum.reduceat((values ^ _SHIFTS[k]) * _FACTORS[k], at)
        out[:, k] = (mixed(low, 3) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _signing(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _groups(b.column("text")):
                sets = shingle_sets(texts, width)
                some = [i for i, s in enumerate(sets) if len(s)]
                keys: list[bytes | None] = [None] * len(sets)
                signs: list[bytes | None] = [None] * len(sets)
                if some:
                    for i, sign in zip(some, signatures([sets[i] for i in some]), strict=True):
                        keys[i], signs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), sign.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sign"])

    return run


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), width)


class _Region:
    """Finds candidates among rows sorted by (tree, key)."""

    def __init__(self, percent: int) -> None:
        t = percent / 100
        self.size = t
        self.agree = math.floor(_HASHES * (t - 4.5 * math.sqrt(t * (1 - t) / _HASHES)))

    def pairs(self, region: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> tuple[list[tuple], dict[int, int | None]]:
        """(i, j, agreement) arrays; and the rows that shall meet at the next level, medoids with their mean agreement."""
        found: list[tuple] = []
        pivots: dict[int, int | None] = {}
        starts = np.flatnonzero(np.diff(region, prepend=region[0] - 1))
        lengths = np.diff(np.append(starts, len(region)))
        crowded = np.repeat(lengths > _SPARSE, lengths)
        for s in range(1, _SPARSE):
            i = np.flatnonzero((region[:-s] == region[s:]) & ~crowded[:-s])
            if len(i):
                found.append(self.agreeing(i, i + s, sizes, signs))
        for at, n in zip(starts[lengths > _SPARSE].tolist(), lengths[lengths > _SPARSE].tolist(), strict=True):
            for a in range(at, at + n, _CHUNK):
                rows = np.arange(a, min(a + _CHUNK, at + n))
                part = signs[rows]
                same = np.zeros((len(rows), len(rows)), np.int16)
                for k in range(_HASHES):
                    same += part[:, k, None] == part[None, :, k]
                total = same.sum(axis=1, dtype=np.int64)
                medoids = np.argsort(-total, kind="stable")[:_MEDOIDS]
                pivots |= zip(rows[medoids].tolist(), (1000 * total[medoids] // len(rows)).tolist(), strict=True)
                np.fill_diagonal(same, -1)
                best = np.argpartition(same, -min(_BEST, len(rows)), axis=1)[:, -_BEST:]
                i = np.concatenate([np.repeat(np.arange(len(rows)), best.shape[1]), np.tile(np.arange(len(rows)), len(medoids))])
                j = np.concatenate([best.reshape(-1), np.repeat(medoids, len(rows))])
                keep = i != j
                found.append(self.agreeing(rows[i[keep]], rows[j[keep]], sizes, signs))
        # What the next block or task may continue.
        for edge in (starts[0], starts[-1]):
            n = int(lengths[np.searchsorted(starts, edge)])
            for row in (*range(edge, edge + min(n, _SPARSE)), *range(max(edge, edge + n - _SPARSE), edge + n)):
                pivots.setdefault(row, None)
        return found, pivots

    def agreeing(self, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fit = np.minimum(sizes[i], sizes[j]) >= self.size * np.maximum(sizes[i], sizes[j])
        i, j = i[fit], j[fit]
        same = (signs[i] == signs[j]).sum(axis=1)
        fit = same >= self.agree
        return i[fit], j[fit], same[fit]


_FOUND = "a long, b long, same int, tree int, key binary, id long, n_shingles long, sign binary"


def _searching(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["a", "b", "same", "tree", "key", "id", "n_shingles", "sign"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Region(percent)
        for b in batches:
            if not b.num_rows:
                continue
            tree, ids, sizes = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "id", "n_shingles"))
            key, signs = _matrix(b.column("key"), ">u2", DEPTH), _matrix(b.column("sign"), ">u2", _HASHES)
            near = (key[1:, :_LEAST_DEPTH] == key[:-1, :_LEAST_DEPTH]).all(axis=1) & (tree[1:] == tree[:-1])
            region = np.concatenate([[0], np.cumsum(~near)])
            found, pivots = finder.pairs(region, sizes, signs)
            if found:
                i, j, same = (np.concatenate(x) for x in zip(*found, strict=True))
                x, y = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                _, first = np.unique(np.stack([x, y]), axis=1, return_index=True)
                n = len(first)
                yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(y[first]), pa.array(same[first].astype(np.int32)), *(pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names)
            n = len(pivots)
            rows = b.take(pa.array(list(pivots), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(pivots.values()), pa.int32()), *(rows.column(c) for c in names[3:])], names)

    return run


def _tree_rows(classes: DataFrame) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(t).alias("tree"), F.expr(f"substring(sign, {1 + 2 * DEPTH * t}, {2 * DEPTH})").alias("key")) for t in range(TREES)))
    return classes.select(F.explode(keys).alias("k"), "id", "n_shingles", "sign").select("k.tree", "k.key", "id", "n_shingles", "sign")


def _candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, same), a < b: distinct candidate pairs of representatives; each crowded region's medoid; and (tree, prefix)
    of all regions that are crowded or cut by the end of a block, the only ones of which pairs may be missing."""
    rows = _tree_rows(classes)
    order = ["tree", "key", "id"]
    first = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_searching(percent), _FOUND))
    again = first.filter("id is not null").select("tree", "key", "id", "n_shingles", "sign").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_searching(percent), _FOUND)
    pairs = first.filter("a is not null").select("a", "b", "same").union(again.filter("a is not null").select("a", "b", "same"))
    prefix = F.expr(f"substring(key, 1, {2 * _LEAST_DEPTH})").alias("prefix")
    regions = first.filter("id is not null").select("tree", prefix).distinct()
    medoids = first.filter("id is not null and same is not null").groupBy("tree", prefix)
    medoids = medoids.agg(F.max_by(F.struct(F.col("id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sign").alias("sign_b")), F.struct("same", -F.col("id"))).alias("m")).select("tree", "prefix", "m.*")
    return staged(pairs.groupBy("a", "b").agg(F.max("same").alias("same"))), staged(medoids), staged(regions)


def _to_medoids(classes: DataFrame, ids: DataFrame, medoids: DataFrame, percent: int) -> DataFrame:
    """(a, b): the rows ``ids`` with the medoids of all regions they are in, where the minimum hashes agree enough."""

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Region(percent)
        for b in batches:
            n = b.num_rows
            if n:
                signs = np.concatenate([_matrix(b.column(c), ">u2", _HASHES) for c in ("sign", "sign_b")])
                sizes = np.concatenate([b.column(c).to_numpy() for c in ("n_shingles", "n_b")])
                i, _, _ = finder.agreeing(np.arange(n), np.arange(n, 2 * n), sizes, signs)
                yield b.select(["a", "b"]).take(pa.array(i))

    rows = _tree_rows(classes.join(ids, "id", "left_semi")).withColumn("prefix", F.expr(f"substring(key, 1, {2 * _LEAST_DEPTH})"))
    met = rows.join(medoids, ["tree", "prefix"]).filter("id <> b").select(F.col("id").alias("a"), "b", "n_shingles", "sign", "n_b", "sign_b")
    pairs = met.mapInArrow(agreeing, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, whatever the number of ids: which hashes occur."""
    words = ids.select((F.pmod(F.xxhash64("id"), F.lit(bits))).alias("h")).groupBy(F.expr("h div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("m"))
    out = np.zeros(bits // 32, np.uint32)
    for b in words.toArrow().to_batches():
        out[b.column("w").to_numpy()] = b.column("m").to_numpy().astype(np.uint32)
    return out


def _sets(rows: DataFrame, ids: DataFrame, width: int, bits: int) -> DataFrame:
    """(id, set) of at least the rows ``ids``: the whole hashes, eight bytes for each shingle."""
    kept = rows.sparkSession.sparkContext.broadcast(_bitmap(ids, bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy()
            asked = b.filter(pa.array((kept.value[h >> 5] >> (h & 31).astype(np.uint32) & 1).astype(bool)))
            for at, texts in _groups(asked.column("text")):
                got = [s.tobytes() for s in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([asked.column("doc_id").slice(at, len(texts)), pa.array(got, pa.binary())], ["id", "set"])

    return rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(bits))).mapInArrow(sets, "id long, set binary")


def _confirmed(rows: DataFrame, pairs: DataFrame, percent: int, width: int, bits: int) -> DataFrame:
    """Those of ``pairs`` (a, b) with 100 * intersection >= percent * union, on the full sets."""
    full = _sets(rows, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), width, bits)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                p, q = (_wide(v.as_py()) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.select("a", "b").join(full.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    return (left.join(full.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b").mapInArrow(compare, "a long, b long"))


_PLACE = ["tree", "prefix", "part_a", "part_b"]


def _blocks(classes: DataFrame, roots: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of those ``regions`` that hold several components, dealt to blocks (tree, prefix, part_a, part_b).

    Side a has the rows outside the region's greatest component, side b all rows; each a meets each b in one block.
    """
    known = classes.join(roots, "id", "left").select("id", "n_shingles", "sign", F.coalesce("root", "id").alias("root"))
    places = F.array(*(F.struct(F.lit(t).alias("tree"), F.expr(f"substring(sign, {1 + 2 * DEPTH * t}, {2 * _LEAST_DEPTH})").alias("prefix")) for t in range(TREES)))
    members = known.select(F.explode(places).alias("k"), "id", "root").select("k.tree", "k.prefix", "id", "root")
    members = staged(members.join(regions, ["tree", "prefix"], "left_semi"))
    counts = members.groupBy("tree", "prefix", "root").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("top")).filter("roots > 1")
    parts = lambda n: F.ceil(n / F.lit(_BLOCK)).cast("int")
    several = several.select("tree", "prefix", "top", parts(F.col("n") - F.col("most")).alias("parts_a"), parts(F.col("n")).alias("parts_b"))
    met = members.join(several, ["tree", "prefix"]).select("tree", "prefix", "id", (F.col("root") == F.col("top")).alias("in_top"), "parts_a", "parts_b")
    met = met.join(known, "id")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    carried = ["id", "root", "n_shingles", "sign", "in_top"]
    a = met.filter("not in_top").select("tree", "prefix", own("parts_a").alias("part_a"), every("parts_b").alias("part_b"), F.lit(True).alias("is_a"), *carried)
    b = met.select("tree", "prefix", every("parts_a").alias("part_a"), own("parts_b").alias("part_b"), F.lit(False).alias("is_a"), *carried)
    return a.union(b)


def _partnered(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one block, the rows with a partner in another component whose minimum hashes agree enough."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        finder, tree, is_a = _Region(percent), block.column("tree")[0].as_py(), block.column("is_a").to_numpy()
        sides = [np.flatnonzero(is_a), np.flatnonzero(~is_a)]
        signs = _matrix(block.column("sign"), ">u2", _HASHES).astype(np.uint16)
        (sign_a, sign_b), (id_a, id_b), (root_a, root_b), (size_a, size_b) = ([x[s] for s in sides] for x in (signs, *(block.column(c).to_numpy() for c in ("id", "root", "n_shingles"))))
        top_b = block.column("in_top").to_numpy()[sides[1]]
        same = np.zeros((len(id_a), len(id_b)), np.int8)
        # Pairs that meet in the region of a tree before this are compared there; of two rows outside the greatest component, the lesser is on side a.
        fit = (root_a[:, None] != root_b) & (top_b | (id_a[:, None] < id_b))
        fit &= np.minimum(size_a[:, None], size_b) >= finder.size * np.maximum(size_a[:, None], size_b)
        for t in range(TREES):
            before = np.ones_like(fit)
            for k in range(DEPTH):
                equal = sign_a[:, DEPTH * t + k, None] == sign_b[:, DEPTH * t + k]
                same += equal
                if k < _LEAST_DEPTH:
                    before &= equal
            if t < tree:
                fit &= ~before
        fit &= same >= finder.agree
        rows = np.concatenate([sides[0][fit.any(axis=1)], sides[1][fit.any(axis=0)]])
        return block.take(pa.array(rows)).select([*_PLACE, "is_a", "id", "root"])

    return run


def _linking(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one block with full sets, links (a, b) enough to tie all components that its pairs tie."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        is_a, ids, roots = (block.column(c).to_numpy() for c in ("is_a", "id", "root"))
        sets = [_wide(v.as_py()) for v in block.column("set")]
        sizes = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), sizes)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        on_a = is_a[row]
        # Only shingles that both sides hold count.
        both = (np.bincount(column, on_a) > 0) & (np.bincount(column, ~on_a) > 0)
        column, row = (np.cumsum(both) - 1)[column[both[column]]], row[both[column]]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        a, b = np.flatnonzero(is_a), np.flatnonzero(~is_a)
        shared = np.zeros((len(a), len(b)), np.float32)
        for at in range(0, int(both.sum()), _COLUMNS):
            here = slice(*np.searchsorted(column, (at, at + _COLUMNS)))
            m = np.zeros((len(sets), _COLUMNS), np.float32)
            m[row[here], column[here] - at] = 1
            shared += m[a] @ m[b].T
        shared = shared.astype(np.int64)
        linked = (100 * shared >= percent * (sizes[a][:, None] + sizes[b] - shared)) & (roots[a][:, None] != roots[b])
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        out: list[tuple[int, int]] = []
        i, j = np.nonzero(linked)
        for x, y in zip(a[i].tolist(), b[j].tolist(), strict=True):
            p, q = top(int(roots[x])), top(int(roots[y]))
            if p != q:
                up[max(p, q)] = min(p, q)
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _all_pairs(rows: DataFrame, classes: DataFrame, roots: DataFrame, regions: DataFrame, percent: int, width: int, bits: int) -> DataFrame:
    """Links (a, b) between components from all pairs of ``regions``, enough to tie what any of the pairs ties."""
    kept = "tree int, prefix binary, part_a int, part_b int, is_a boolean, id long, root long"
    asked = staged(_blocks(classes, roots, regions).groupBy(*_PLACE).applyInArrow(_partnered(percent), kept))
    if asked.isEmpty():
        return asked.select(F.col("id").alias("a"), F.col("id").alias("b"))
    full = staged(_sets(rows, asked.select("id"), width, bits))
    return asked.join(full, "id").groupBy(*_PLACE).applyInArrow(_linking(percent), "a long, b long")


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def near_dedup(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = _BITMAP) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows are linked when 100 * intersection >= percent * union of their shingle sets; component_id is the smallest id
    that links reach, kept is doc_id = component_id. A text of fewer words than ``width`` is one shingle; texts without
    words (null, empty, blanks only) have empty sets and are linked with nothing. Rows with a null id are linked with nothing
    and kept. Rows that repeat an id are one node, linked with whatever any of them is linked with. Texts are read whole, however long. An empty table gives an empty result; other columns are ignored.
    """
    rows = plain(df, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = staged(rows.mapInArrow(_signing(width), "doc_id long, n_shingles long, set_key binary, sign binary"))
    some = signed.filter("doc_id is not null and n_shingles > 0")
    classes = staged(some.groupBy("set_key", "n_shingles", "sign").agg(F.min("doc_id").alias("id")))
    # Rows that repeat an id with different sets tie the classes they belong to.
    several = some.groupBy("doc_id").agg(F.min(F.xxhash64("set_key")).alias("x"), F.max(F.xxhash64("set_key")).alias("y")).filter("x <> y").select("doc_id")
    ties = some.join(several, "doc_id", "left_semi").join(classes.select("set_key", "id"), "set_key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    candidates, medoids, regions = _candidates(classes, percent)
    best = candidates.select("a", "b", "same", F.col("a").alias("id")).union(candidates.select("a", "b", "same", F.col("b").alias("id")))
    best = best.groupBy("id").agg(F.max_by(F.struct("a", "b"), F.struct("same", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
    texts = rows.filter("doc_id is not null")
    first = staged(_confirmed(texts, best, percent, width, bits).union(ties))
    roots = components(first)
    left = _apart(candidates, roots)
    second = staged(_confirmed(texts, left, percent, width, bits))
    roots = components(first.union(second)) if not second.isEmpty() else roots
    still = _apart(candidates, roots)
    ids = still.select(F.col("a").alias("id")).union(still.select("b")).distinct()
    third = staged(_confirmed(texts, _apart(_to_medoids(classes, ids, medoids, percent), roots), percent, width, bits))
    roots = components(first.union(second).union(third)) if not third.isEmpty() else roots
    last = staged(_all_pairs(texts, classes, roots, regions, percent, width, bits))
    roots = components(first.union(second).union(third).union(last)) if not last.isEmpty() else roots
    groups = classes.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("root", "id").alias("root"))
    out = signed.join(groups, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    a, b = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    joined = pairs.join(a, "a", "left").join(b, "b", "left")
    return staged(joined.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


SQL: dict[str, str] = {}
QUERIES = {"op2_near_dedup": op2_near_dedup}
