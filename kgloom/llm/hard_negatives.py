"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers (components scaled and floored), so scores are exact inner products. The anchors come in waves of
a bounded number, which the tasks get by broadcast; the candidates are read where they lie and never shuffled. Each task
takes its candidates in blocks of one label. For a block every dimension has a list of its rows sorted by that component,
and an anchor reads the lists from their top where its own component is positive and from their bottom where it is
negative, many rows of all lists at a time (sorted access); rows that come up for the first time are scored in full (random
access). No row that hasn't come up scores more than the threshold, the anchor's product with the last components read. The
anchor leaves the block once the threshold is strictly below the k-th score of each of its windows so far (below the
window's lower end while it holds fewer than k rows); strictly, so that no row of an equal score and a smaller id is missed.

A wave reads the candidates twice: for the first rows of the anchor's own label, the positives, and then, with the window of
scores that each positive opens, for the first rows of other labels inside it. A task gives k rows for each anchor and
window at most; Spark ranks what the tasks found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import staged, table

#: Scaled components are cut to this size, so that inner products of up to 1,024 of them are exact in float64 as in long.
LARGEST = 1 << 21
#: Rows of a block, anchors of a wave, and rows that are read of each list at first.
_BLOCK, _WAVE, _FIRST = 1 << 14, 1 << 14, 16
_LEAST = np.iinfo(np.int64).min


class Block:
    """Candidates of one label with a sorted list of rows for each dimension."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.keys, self.ids, self.vectors = keys, ids, vectors
        self.lists = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(vectors, self.lists, axis=0)

    def depths(self) -> list[int]:
        n, out = len(self.ids), [_FIRST]
        while out[-1] < n:
            out.append(out[-1] * 2)
        out[-1] = n
        return out

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """For each anchor the greatest score that is possible at the very start, and below each depth of reading."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        n = len(self.ids)
        last = [0, *(d - 1 for d in self.depths())]
        return up @ self.sorted[[n - 1 - x for x in last]].T + down @ self.sorted[last].T

    def rounds(self, anchor: np.ndarray) -> Iterator[np.ndarray]:
        """The rows that come up for the first time at each depth."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        done = np.zeros(n, bool)
        for depth in self.depths():
            seen = done.copy()
            seen[self.lists[n - depth :, up]] = True
            seen[self.lists[:depth, down]] = True
            # An anchor of zeros reads no list: all rows score zero.
            yield np.flatnonzero(seen & ~done) if len(up) + len(down) else np.arange(n)
            done = seen


class Best:
    """The first ``k`` (score, id, key) so far among those with low <= score <= high; higher scores, then smaller ids come first."""

    def __init__(self, k: int, low: int = _LEAST, high: int = -_LEAST - 1) -> None:
        self.k, self.low, self.high = k, low, high
        self.rows = np.zeros((3, 0), np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        fit = np.flatnonzero((scores >= self.bound()) & (scores <= self.high))
        if len(fit):
            rows = np.concatenate([self.rows, np.stack([scores[fit], ids[fit], keys[fit]])], axis=1)
            self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]

    def bound(self) -> int:
        """No row below this can still come in."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else self.low


def search(block: Block, anchors: np.ndarray, own_keys: np.ndarray, wanted: list[list[Best]]) -> None:
    """Adds the block's rows to each anchor's windows, as far as the thresholds ask for."""
    reach = block.thresholds(anchors)
    for a in np.flatnonzero([bool(w) for w in wanted]):
        windows = wanted[a]
        if reach[a, 0] < min(w.bound() for w in windows):
            continue
        for rows, threshold in zip(block.rounds(anchors[a]), reach[a, 1:], strict=True):
            rows = rows[block.keys[rows] != own_keys[a]]
            scores = np.rint(block.vectors[rows] @ anchors[a]).astype(np.int64)
            for w in windows:
                w.add(scores, block.ids[rows], block.keys[rows])
            if threshold < min(w.bound() for w in windows):
                break


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[int, Block]]:
    def cut(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, Block]]:
        t = pa.Table.from_batches(parts).combine_chunks()
        labels = t.column("label").to_numpy()
        vectors = np.zeros((len(labels), dims))
        values = t.column("vector").combine_chunks()
        sizes = values.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(sizes)), sizes)
        vectors[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.flatten().to_numpy()
        keys, ids = t.column("key").to_numpy(), t.column("id").to_numpy()
        for label in np.unique(labels):
            at = np.flatnonzero(labels == label)
            yield int(label), Block(keys[at], ids[at], vectors[at])

    parts, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, _BLOCK):
            parts.append(b.slice(at, _BLOCK))
            n += parts[-1].num_rows
            if n >= _BLOCK:
                yield from cut(parts)
                parts, n = [], 0
    if parts:
        yield from cut(parts)


_FOUND = "anchor int, window int, score long, id long, key long"


def _mining(wave: object, dims: int, k: int, same_label: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, anchors, windows = wave.value
        best = [[Best(k, low, high) for low, high in w] for w in windows]
        for label, block in _blocks(batches, dims):
            # Of an anchor's windows only the label's own ones, or only the others', are asked for.
            search(block, anchors, keys, [b if (x == label) == same_label else [] for b, x in zip(best, labels, strict=True)])
        at = [(a, w, b.rows) for a, bs in enumerate(best) for w, b in enumerate(bs) if b.rows.shape[1]]
        for first in range(0, len(at), 4096):
            part = at[first : first + 4096]
            sizes = [r.shape[1] for _, _, r in part]
            score, ids, key = np.concatenate([r for _, _, r in part], axis=1)
            columns = [pa.array(np.repeat([x[i] for x in part], sizes), pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(ids), pa.array(key)], ["anchor", "window", "score", "id", "key"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def integers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component x as a double; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    cut = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), cut)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, wave: int = _WAVE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives the hard negatives.

    ``is_anchor`` is a condition over the columns ``id``, ``label``. An anchor's positives are its first ``positives`` other rows of
    the same label; the hard negatives of a positive of score p are the first ``negatives`` rows of other labels whose score s has
    low * p <= 100 * s <= high * p. Higher scores come first, ties by smaller id. A positive without such rows gives none; a
    negative p gives none, since no s fits.

    Rows with a null label, a null vector, or a component that is null or not finite take no part. Null ids come last in
    ties and are returned as null. Rows may repeat and ids may repeat: every row is a candidate of its own, and only the anchor's
    very row is not its own positive. Vectors shorter than others count as zero in what they lack; scaled components beyond
    +-2^21 are cut to that. Vectors of more than 1,024 components raise an error. An empty table, or one without anchors, gives an
    empty result; other columns, however named, are ignored. There are no texts, so none can be long.
    """
    spark = rows.sparkSession
    last = F.lit(-_LEAST - 1)
    plain = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), integers(F.col(f"`{vector_col}`")).alias("vector"))
    plain = plain.filter("label is not null and vector is not null").select(F.monotonically_increasing_id().alias("key"), F.coalesce("id", last).alias("id"), "label", "vector", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    plain = staged(plain)
    dims = plain.agg(F.max(F.size("vector"))).first()[0] or 0
    if dims > 1024:
        raise ValueError(f"vectors of {dims} components; 1,024 at most have exact scores")
    candidates = plain.select("key", "id", "label", "vector")
    done: list[DataFrame] = []

    def mine(anchors: list) -> DataFrame:
        vectors = np.zeros((len(anchors), dims))
        for i, r in enumerate(anchors):
            vectors[i, : len(r["vector"])] = r["vector"]
        keys, labels = np.array([r["key"] for r in anchors], np.int64), np.array([r["label"] for r in anchors], np.int64)
        everything = [(_LEAST, -_LEAST - 1)]
        sent = spark.sparkContext.broadcast((keys, labels, vectors, [everything] * len(anchors)))
        own = _first(candidates.mapInArrow(_mining(sent, dims, positives, True), _FOUND), positives).select("anchor", "rank", "id", "score").collect()
        windows: list[list[tuple[int, int]]] = [[] for _ in anchors]
        ids: list[tuple[int, int, int, int, int]] = []
        for r in sorted(own):
            # The least and greatest whole numbers between the two ends.
            ends = -(-low * r["score"] // 100), high * r["score"] // 100
            if ends[0] <= ends[1]:
                ids.append((r["anchor"], len(windows[r["anchor"]]), anchors[r["anchor"]]["id"], r["id"], r["score"]))
                windows[r["anchor"]].append(ends)
        sent = spark.sparkContext.broadcast((keys, labels, vectors, windows))
        others = _first(candidates.mapInArrow(_mining(sent, dims, negatives, False), _FOUND), negatives)
        of = spark.createDataFrame(ids, "anchor int, window int, anchor_id long, positive_id long, positive_score long")
        null = lambda c: F.when(F.col(c) != last, F.col(c))
        return others.join(F.broadcast(of), ["anchor", "window"]).select(null("anchor_id").alias("anchor_id"), null("positive_id").alias("positive_id"), "rank", null("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

    waiting: list = []
    for r in plain.filter("anchor").select("key", "id", "label", "vector").toLocalIterator():
        waiting.append(r)
        if len(waiting) == wave:
            done.append(staged(mine(waiting)))
            waiting = []
    if waiting or not done:
        done.append(mine(waiting))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 100 == 0)


SQL = {
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
}
QUERIES = {"op13_hard_negatives": op13_hard_negatives}
