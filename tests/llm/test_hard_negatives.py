import math

import numpy as np
from pyspark.sql import functions as F

from kgloom.llm import hard_negatives as H

_SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor string"


def _brute(rows, anchor, positives=5, negatives=10):
    """All pairs, in plain Python."""
    kept = [(n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, label) in enumerate(rows) if v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for n, i, label, v in kept:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), last(j), m, j, other) for m, j, other, w in kept if m != n), key=lambda x: x[:3])
        for score, _, _, j, _ in [x for x in scored if x[4] == label][:positives]:
            p = -score
            fit = [(k, -s) for s, _, _, k, other in scored if other != label and 30 * p <= -100 * s <= 90 * p][:negatives]
            out += [(i, j, rank, k, p, s) for rank, (k, s) in enumerate(fit, 1)]
    return sorted(out, key=str)


def _run(spark, rows, anchor, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], _SCHEMA)
    return sorted((tuple(r) for r in H.hard_negatives(df, anchor, **more).collect()), key=str)


def test_against_all_pairs(spark, monkeypatch):
    """Small blocks, short lists and several waves; ties by the hundred, since the components are coarse."""
    monkeypatch.setattr(H, "_BLOCK", 64)
    rng = np.random.default_rng(3)
    for scale in (1.0, 0.02):
        centres = rng.normal(size=(4, 8))
        rows = [(i, [float(x) for x in scale * (centres[i % 4] + rng.normal(size=8))], int(i % 4 if i % 9 else 0)) for i in range(400)]
        got = _run(spark, rows, F.col("id") % 20 == 0, wave=7)
        assert got == _brute(rows, lambda i: i % 20 == 0) and len(got) > 100


def test_odd_rows(spark):
    """Nulls, rows that aren't finite, empty and ragged vectors, zeros, repeated ids and rows, huge components."""
    v = [1.0, 0.5, -0.25]
    rows = [(0, v, 1), (0, v, 1), (1, v, 1), (1, v, 1), (2, v, 2), (2, v, 2), (3, [0.5, 0.25], 2), (None, [0.5, 0.25, 0.0], 3), (4, [0.0, 0.0, 0.0], 1), (5, [], 2), (6, None, 1), (7, v, None), (8, [1.0, None, 1.0], 2), (9, [1.0, math.nan, 1.0], 2), (10, [math.inf, 0.0, 0.0], 2), (11, [-1.0, -0.5, 0.25], 1), (100, [0.0, 0.0, 0.0], 2)]
    got = _run(spark, rows, F.col("id") % 100 == 0)
    assert got == _brute(rows, lambda i: i is not None and i % 100 == 0) and got
    big = _run(spark, [(0, [1e30, 1.0], 1), (1, [1e30, 0.0], 1), (2, [3e3, 0.0], 2), (3, [1e30, 1.0], 2)], F.col("id") == 0)
    assert [r[3] for r in big] == [2]


def test_nothing(spark):
    assert _run(spark, [], F.col("id") % 100 == 0) == []
    assert _run(spark, [(1, [1.0], 1), (2, [1.0], 2)], F.col("id") % 100 == 0) == []
    assert _run(spark, [(0, [1.0], 1), (2, [1.0], 2)], F.col("id") % 100 == 0) == []


def test_readers_stop_early():
    """The threshold ends the reading long before all rows came up, with the rows that a full ranking gives."""
    rng = np.random.default_rng(5)
    vectors = np.floor(np.exp(rng.normal(size=(4000, 3)) * 2) * 16)
    block = H.Block(np.arange(4000), np.arange(4000), vectors)
    anchor, best = np.array([3.0, 1.0, -2.0]), H.Best(5)
    read = []
    rounds = H.Block.rounds
    H.Block.rounds = lambda self, a: (read.append(len(r)) or r for r in rounds(self, a))
    try:
        H.search(block, anchor[None], np.array([-1]), [[best]])
    finally:
        H.Block.rounds = rounds
    scores = (vectors @ anchor).astype(int)
    order = sorted(range(4000), key=lambda i: (-scores[i], i))[:5]
    assert best.rows[1].tolist() == order and sum(read) < 1500
