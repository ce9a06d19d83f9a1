"""Rules of types, names and folders against plain Python, numbering by ranges, and searches past a hundred hops."""

import itertools
import random

from pyspark.sql import functions as F
from test_graph import make

from kgloom.functions import columns as C
from kgloom.operators import algorithms as A
from kgloom.operators import links as L
from kgloom.operators import relational as R


def kind(labels, explicit):
    if explicit:
        raw = explicit
    else:
        own = [x for x in labels if x not in ("Entity", "Chunk", "File", "Folder", "Unknown")]
        domain = [x for x in own if not x.startswith("F_")]
        ranked = [p for p in ("Herb", "Property", "Quality", "Entity") if p in domain]
        raw = ranked[0] if ranked else max(domain, key=len) if domain else own[0] if own else labels[0] if labels else "Unknown"
    return raw.split("_F_")[0] or "Unknown"


def test_effective_type(spark):
    random.seed(1)
    names = ["Entity", "Chunk", "F_a", "F_b", "Herb", "Property", "Quality", "Town_F_x", "Cities", "Unknown", "Ort"]
    rows = [(random.sample(names, random.randint(0, 4)), random.choice([None, "", "Given", "Given_F_z"])) for _ in range(300)]
    df = spark.createDataFrame(rows, "labels array<string>, explicit string")
    got = df.select(C.effective_type(F.col("labels"), F.col("explicit"))).collect()
    assert [r[0] for r in got] == [kind(*r) for r in rows]


def test_display_name(spark):
    uid = "123e4567-e89b-12d3-a456-426614174000"
    rows = [("Ann", "t", "i"), (uid, "Town", "i"), ("x" * 31, "Town", "i"), ("x" * 30, "Town", "i"), ("a b" * 40, "Entity", "short"), ("", "Unknown", "y" * 21), (None, None, "y" * 20), (None, "", None), (None, None, "")]
    df = spark.createDataFrame(rows, "v string, kind string, id string")
    got = [r[0] for r in df.select(C.display_name([F.col("v")], F.col("kind"), F.col("id"))).collect()]
    assert got == ["Ann", "Town", "Town", "x" * 30, "short", "y" * 8, "y" * 20, "Unknown", "Unknown"]


def test_predicted_type(spark):
    kinds = ["Person", "Organization", "Place", "Event", "Concept", "Other", None]
    rows = list(itertools.product(kinds, kinds))
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(C.predicted_type(F.col("a"), F.col("b"))).collect()]
    assert got == [C.PREDICTED_TYPES.get((a, b)) or C.PREDICTED_TYPES.get((b, a)) or "RELATED_TO" for a, b in rows]


def test_bridges_pair_all_folders(spark):
    rows = [("a1", "n", "f1"), ("a0", "n", "f1"), ("b", "n", "f2"), ("c", "n", "f3"), ("d", "m", "f1"), ("e", None, "f1"), ("f", None, "f2")]
    got = sorted(tuple(r) for r in R.cross_folder_bridges(spark.createDataFrame(rows, "id string, name string, folder_id string")).collect())
    assert got == [("n", "f1", "f2", "a0", "b"), ("n", "f1", "f3", "a0", "c"), ("n", "f2", "f3", "b", "c")]


def test_same_type_pairs(spark):
    random.seed(2)
    ids = [f"v{i:02}" for i in range(24)]
    types = {i: random.choice(["x", "x", "y", None]) for i in ids}
    linked = {tuple(sorted(random.sample(ids, 2))) for _ in range(70)}
    adj = spark.createDataFrame([p for a, b in linked for p in ((a, b), (b, a))], "a string, b string")
    nodes = spark.createDataFrame(list(types.items()), "id string, type string")
    want = [(a, b) for a, b in itertools.combinations(ids, 2) if types[a] and types[a] == types[b] and (a, b) not in linked]
    for k in (1, 5, 500):
        assert [(r.a, r.b) for r in L.lp_same_type(nodes, adj, k).orderBy("a", "b").collect()] == want[:k]


def test_islands_and_numbers(spark):
    rows = [(f"v{i:02}", "c" + "aaaaaabbbcccdde"[i]) for i in range(15)]
    nodes = spark.createDataFrame([(i, i.upper()) for i, _ in rows], "id string, name string")
    got = R.island_summary(spark.createDataFrame(rows, "id string, component string"), nodes).first()
    assert tuple(got) == (5, 6, 9, 1, "V06, V09, V12, and others")
    two = R.island_summary(spark.createDataFrame(rows[:9], "id string, component string"), nodes).first()
    assert two.sample == "V06"
    assert R.island_summary(spark.createDataFrame(rows[:3], "id string, component string"), nodes).first().sample == ""
    values = [(i, random.choice("pq"), random.random()) for i in range(400)]
    df = spark.createDataFrame(values, "id long, k string, v double")
    for keys in ([], ["k"]):
        got = {r.id: r.n for r in R.numbered(df, keys, [F.desc("v"), F.col("id")], "n").collect()}
        for part in ("p", "q") if keys else (None,):
            of = sorted((x for x in values if part in (None, x[1])), key=lambda x: (-x[2], x[0]))
            assert [got[x[0]] for x in of] == list(range(1, len(of) + 1))


def test_search_goes_to_the_end(spark):
    g = make(spark, [(i, i + 1) for i in range(104)], 105)
    assert A.bfs(g, "v00").agg(F.max("depth")).first()[0] == 104
