import collections
import random
import re

import numpy as np

from kgloom.llm import near_dedup as nd
from kgloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)}


def brute(rows, percent):
    """Union-find over ids by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted(str((i, len(s), i if i is None else root(i), i is None or root(i) == i)) for i, s in sets)


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_sets():
    texts = ["", None, " \t", "One", "one two THREE four", "A b c d e", "a B c d e f a b c d e", "é\xa0x y z   w v É", "x " * 300, "\x1c a b c d e"]
    sets = nd.shingle_sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert set(sets[5].tolist()) <= set(sets[6].tolist())
    assert nd.shingle_sets(["one TWO"])[0].tolist() == nd.shingle_sets(["One  two\n"])[0].tolist()
    assert np.array_equal(nd._wide(sets[6].tobytes()), sets[6])


def test_groups(spark):
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for g in range(30):
        base = random.choices(words, k=random.choice([20, 60, 200, 500]))
        for _ in range(random.choice([1, 2, 3, 12])):
            text = [random.choice(words) if random.random() < random.choice([0, 0.005, 0.01, 0.02, 0.05]) else w for w in base]
            rows.append((len(rows), " ".join(text).title() if random.random() < 0.3 else "  ".join(text)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two words"), (None, rows[0][1]), (3, rows[40][1]), (905, rows[7][1]), (905, rows[7][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, sign int")
    for percent in (80, 85):
        assert got(nd.near_dedup(df, percent)) == brute(rows, percent)
    assert nd.near_dedup(df.limit(0)).count() == 0


def test_hot_group(spark):
    """A star: copies of one text with few edits each, that are like the original and less like one another."""
    random.seed(6)
    words = [f"w{i}" for i in range(5000)]
    base = random.choices(words, k=400)
    rows = [(7000, " ".join(base))]
    for i in range(600):
        text = list(base)
        for _ in range(random.randint(1, 6)):
            text[random.randrange(400)] = random.choice(words)
        rows.append((i, " ".join(text)))
    assert got(nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 80)) == brute(rows, 80)


def linked_by_all_pairs(rows, percent):
    """id -> least id of its component, by the shingles that several rows share as one matrix."""
    column, sets = {}, [shingles(t) for _, t in rows]
    held = collections.Counter(s for x in sets for s in x)
    m = np.zeros((len(rows), sum(n > 1 for n in held.values())), np.float32)
    for i, x in enumerate(sets):
        m[i, [column.setdefault(s, len(column)) for s in x if held[s] > 1]] = 1
    shared, sizes = m @ m.T, np.array([len(x) for x in sets])
    linked = 100 * shared >= percent * (sizes[:, None] + sizes - shared)
    ids = np.array([i for i, _ in rows])
    low = ids.copy()
    while True:
        new = np.where(linked, low, low.max()).min(axis=1)
        if (new == low).all():
            return dict(zip(ids.tolist(), low.tolist(), strict=True))
        low = new


def test_star_over_several_chunks(spark):
    """Over 3,000 copies of one text that are linked through the original only, and a tight group beside it."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=400)

    def edited(text, n):
        out = list(text)
        for at in rng.sample(range(len(text)), n):
            out[at] = rng.choice(words)
        return out

    rows = [(i, " ".join(edited(base, rng.randint(3, 6)))) for i in range(3000)] + [(9000, " ".join(base))]
    tight = edited(base, 6)
    rows += [(4000 + i, " ".join(edited(tight, 1))) for i in range(60)]
    want = linked_by_all_pairs(rows, 85)
    out = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {r.doc_id: r.component_id for r in out.collect()} == want


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 160)] + [(200, 201), (201, 202), (201, 200), (5, 5)]
    out = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{j: 100 for j in range(100, 160)}, **{j: 200 for j in (200, 201, 202)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(nd.op2_near_dedup(spark, d)) == brute(rows, 85)
