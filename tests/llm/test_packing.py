import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from kgloom.llm import packing

PATH = P.path("word_bpe_49k.json")


def test_word_ids_equal_the_library():
    words = packing.WordIds(PATH, 50)
    library = Tokenizer.from_file(PATH)
    random.seed(3)
    letters = "aB'sST RE12 é É İ Σς ñ́ é 漢  _-<|endoftext|>ǅ ﬁ ² Ⅷ 👩‍ ͅ ΑΣ\x1c\n\x85"
    texts = ["".join(random.choice(letters) for _ in range(30)) for _ in range(1500)] + ["<|endoftext|> a", "hi <|endoftext|> there", "a<|startoftext|>b <|endoftext|", "", " ", "x" * 3000, "é" * 700, "12'34's-'s 'LL don't"]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(words.encode(t)) == e.ids, t


def test_best_fill_is_best():
    random.seed(1)
    for _ in range(200):
        counts = collections.Counter(random.randint(1, 40) for _ in range(random.randint(0, 9)))
        room = random.randint(1, 90)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums if s + x <= room}
        used = packing.best_fill(dict(counts), room)
        assert sum(k * v for k, v in used.items()) == max(sums)
        assert all(v <= counts[k] for k, v in used.items())


def check(rows, texts, window):
    library = Tokenizer.from_file(PATH)
    by_sequence = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return sum(window - sum(n for _, n in p) for p in by_sequence.values()), len(by_sequence)


def test_pack(spark):
    random.seed(2)
    texts = {i: " ".join(random.choice(["tree", "le", "Haus", "x1", "été"]) for _ in range(random.choice([0, 1, 5, 40, 300]))) for i in range(300)}
    texts[400], texts[401] = None, "word " * 5000
    df = spark.createDataFrame([(k, v, 1, "s") for k, v in texts.items()], "doc_id long, text string, length int, rank string").repartition(5)
    rows = packing.pack(df, PATH, window=256).collect()
    padding, n = check(rows, texts, 256)
    assert padding < 0.04 * 256 * n
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b"), (7, "b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.length) for r in packing.pack(twice, PATH).collect()) == [("7", 2), ("7", 2), ("None", 2), ("None", 2)]


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    padding, n = check(packing.op5_packing(spark, "/root/testdata/sf0.001").collect(), texts, 2048)
    assert padding <= 0.02 * 2048 * n, (padding, n)


def test_all_code_points_equal_the_library():
    """Also those that this Python's tables don't know as assigned."""
    words = packing.WordIds(PATH, 1000)
    library = Tokenizer.from_file(PATH)
    points = [c for c in range(0x34000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 20000):
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)}" for c in points[at : at + 20000]]
        for t, got, e in zip(texts, words.encode_column(packing.pa.array(texts)), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert got.tolist() == e.ids, ascii(t)
