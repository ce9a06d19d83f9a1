import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import decontaminate as D
from kgloom.llm.fm_index import FMIndex, suffix_order

_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def _words(text):
    return _WORDS.findall((text or "").translate(_UPPER))


def _brute(docs, items, width):
    windows = {}
    for name, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(name or "")
    out = []
    for text in docs:
        w = _words(text)
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit |= {*range(i, i + n)}
                    found |= windows[g]
        out.append((len(w), hit, sorted(found)))
    return out


def _held(spark, docs, items, width=10, **more):
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(docs)], "doc_id long, text string, spans string, token string")
    found = D.decontaminate(df, spark.createDataFrame(items, "item_id string, text string"), width=width, **more)
    assert found.columns == ["doc_id", "text", "token", "n_words", "spans", "items"]
    rows = found.orderBy("doc_id").collect()
    for r, text, (n, hit, names) in zip(rows, docs, _brute(docs, items, width), strict=True):
        assert r["n_words"] == n and r["items"] == names
        spans = [(s["word"], s["words"]) for s in r["spans"]]
        assert [p for a, m in spans for p in range(a, a + m)] == sorted(hit) and all(a + m < b for (a, m), (b, _) in zip(spans, spans[1:], strict=False))
        for s in r["spans"]:
            part = text.encode()[s["byte"] : s["byte"] + s["bytes"]].decode()
            assert _words(part) == _words(text)[s["word"] : s["word"] + s["words"]]
    return found


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    for n, v in ((1, 1), (50, 2), (400, 3), (3000, 40)):
        pieces = [rng.integers(1, v + 1, rng.integers(1, 30)) for _ in range(n // 10 + 1)]
        text = np.concatenate([np.append(p, 0) for p in pieces]).astype(np.int32)
        starts = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
        zero = {int(p): k for k, p in enumerate(np.flatnonzero(text == 0))}
        key = lambda i: [(1, int(x)) if x else (0, zero[i + j]) for j, x in enumerate(text[i : i + 40])]  # noqa: E731, B023
        order = suffix_order(text)
        assert order.tolist() == sorted(range(len(text)), key=key)
        index = FMIndex(text, starts, every=4)
        last = text[order - 1]
        assert index.access(np.arange(len(text))).tolist() == last.tolist()
        for c in set(last.tolist()):
            at = np.arange(len(text) + 1)
            assert index.rank(np.full(len(at), c), at).tolist() == np.concatenate([[0], np.cumsum(last == c)]).tolist()
        words = np.flatnonzero(text[order] > 0)
        assert index.locate(words).tolist() == order[words].tolist()


@pytest.mark.parametrize("width", [1, 2, 4, 10])
def test_against_brute_force(spark, monkeypatch, width):
    """Few words, so that windows abound, overlap and repeat; small shards and pieces; items of several blocks."""
    monkeypatch.setattr(D, "_PIECE", 5)
    monkeypatch.setattr(D, "_SHARD", 64)
    rng = random.Random(width)
    vocabulary = ["a", "B", "c3", "été", "日本", "x"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "@"]) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([0, 1, 3, 6, 14, 30]))) for k in range(12)]
    docs = [text(rng.choice([0, 1, 5, 40, 200])) + rng.choice(["", items[k % 12][1], " zzz " + items[k % 12][1]]) + text(5) for k in range(30)]
    _held(spark, docs, items, width)
    _held(spark, docs, items, width, block_words=20)


def test_odd_rows(spark):
    long = "one two three four five six seven eight nine ten eleven"
    items = [("k", long), ("k", long), ("l", long.upper()), (None, "only three words"), ("e", ""), ("n", None), ("p", "!?")]
    docs = [None, "", "!!", long, f"x{long}", f"{long}x", f"before. {long.replace(' ', '--')}! After only Three WORDS only three words. " * 3, "word " * 40000 + long, long, "one two three four five", "İ ſ K é"]
    found = _held(spark, docs, items)
    assert [r["items"] for r in found.orderBy("doc_id").collect()][3] == ["k", "l"]
    cut = [r["text"] for r in D.without_spans(found).orderBy("doc_id").collect()]
    assert cut[0] == "" and cut[3] == "" and cut[5] == " elevenx" and cut[9] == docs[9] and cut[7] == "word " * 40000 and cut[10] == docs[10]


def test_words_of_one_hash_are_told_apart(spark, monkeypatch):
    """With all words of one length on one hash, only the confirmed bytes count."""
    cut = D.cut_words
    monkeypatch.setattr(D, "cut_words", lambda o, at: (lambda s, e, h: (s, e, (h % np.uint64(3)).astype(np.uint64) if len(o) < 100 else h))(*cut(o, at)))
    windows = D.Windows([("i", ["aa", "bb"])], 2)
    if len(set(windows.hashes.tolist())) == 2:
        import pyarrow as pa

        texts = ["aa bb", "cc bb", "aa dd aa bb", "ee ff"]
        for t in texts:
            _, spans, items = D._shard(pa.array([t]), windows)
            assert bool(spans[0]) == ("aa bb" in t) == bool(items[0])


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    assert D.decontaminate(df, bench).count() == 0
    one = D.decontaminate(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first()
    assert (one["n_words"], one["spans"], one["items"]) == (2, [], [])
