import hashlib
import math
import random

from kgloom.llm import fingerprints as fp


def brute(text):
    data, counts = text.encode(), [0] * fp.BUCKETS
    for (i, j, k), factor in zip(fp._TRIPLETS, fp._FACTORS.tolist(), strict=True):
        for p in range(len(data) - k):
            x = data[p + i] | data[p + j] << 8 | data[p + k] << 16
            counts[(((x ^ x >> 9) * factor) & 0xFFFFFFFF) >> int(fp._SHIFT)] += 1
    return counts


def test_counts():
    texts = ["", "a", "abcde", "été ñ " * 50, "x" * 700]
    assert fp._counts([t.encode() for t in texts]).tolist() == [brute(t) for t in texts]
    assert fp.digests(texts) == [fp.digests([t])[0] for t in texts]


def plain_digest(text):
    """The digest with its length, checksum and quartile codes, worked out bucket by bucket."""
    counts = brute(text)
    ordered = sorted(counts)
    quartiles = [ordered[len(counts) * k // 4 - 1] for k in (1, 2, 3)]
    codes = [sum(c > q for q in quartiles) for c in counts]
    octets = [codes[i] | codes[i + 1] << 2 | codes[i + 2] << 4 | codes[i + 3] << 6 for i in range(0, len(codes), 4)]
    size = min(255, round(8 * math.log2(1 + len(text.encode()))))
    return f"{size:02x}{sum(c * (2 * i + 1) for i, c in enumerate(counts)) % 256:02x}" + bytes(octets).hex(), codes, size


def plain_likeness(a, b):
    (_, x, m), (_, y, n) = plain_digest(a), plain_digest(b)
    score = sum(6 if abs(p - q) == 3 else abs(p - q) for p, q in zip(x, y, strict=True)) + 2 * max(0, abs(m - n) - 1)
    return max(0.0, 1 - score / (1.5 * fp.BUCKETS))


def test_digest_and_likeness_recomputed():
    random.seed(6)
    texts = ["", "a", "abcd", "x" * 700, "été ñ " * 50] + ["".join(random.choices("abc def.\n", k=random.choice([9, 80, 900]))) for _ in range(25)]
    prints = fp.digests(texts)
    assert prints == [plain_digest(t)[0] for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    got = fp.likeness([prints[i] for i, _ in pairs], [prints[j] for _, j in pairs])
    assert all(abs(g - plain_likeness(texts[i], texts[j])) < 1e-12 for g, (i, j) in zip(got, pairs, strict=True))


def test_likeness():
    a, b = fp.digests(["the quick brown fox " * 40, "ein ganz anderer Satz ohne Bezug " * 30])
    assert fp.likeness([a, a], [a, b])[0] == 1.0
    assert 0 <= fp.likeness([a], [b])[0] < 0.3


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        a, b, c = fp.digests([t, e, n])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, float(fp.likeness([a], [b])[0]), float(fp.likeness([a], [c])[0])))
    return sorted(map(str, out))


def test_frames(spark):
    rows = [(i, f"word{i % 7} " * (i % 11)) for i in range(100)] + [(None, "null id"), (5, "again"), (5, None), (200, "é" * 50000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, kind string").repartition(7)
    assert sorted(str(tuple(r)) for r in fp.compared_with_next(df).collect()) == expected(rows)
    assert fp.compared_with_next(df.limit(0)).count() == 0
    one = df.filter("doc_id = 200")
    assert [tuple(r)[-1] for r in fp.compared_with_next(one).collect()] == [1.0]


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = fp.op9_fingerprints(spark, d).collect()
    assert sorted(str(tuple(r)) for r in got) == expected(rows)
    assert sum(r.near_edited > r.near_next for r in got) > 0.95 * len(got)
