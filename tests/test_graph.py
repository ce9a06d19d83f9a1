"""Small graphs with answers by brute force or by hand."""

import itertools
import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import algorithms as A
from kgloom.operators import learning as M
from kgloom.operators import links as L
from kgloom.operators import paths as P
from kgloom.operators import retrieve as Q
from kgloom.operators.blocks import Blocks
from kgloom.sources.graph import Projection, adjacency, graph_edges, project


def make(spark, pairs, n, undirected=True, weight=1.0):
    nodes = spark.createDataFrame([(f"v{i:02}", f"name {i}", "T") for i in range(n)], "id string, name string, type string")
    rows = [(f"v{a:02}", f"v{b:02}", float(weight if isinstance(weight, float) else weight(a, b))) for a, b in pairs]
    rows += [(b, a, w) for a, b, w in rows] if undirected else []
    return Projection(nodes, spark.createDataFrame(rows, "src string, dst string, weight double"), undirected)


@pytest.fixture(scope="module")
def pairs():
    random.seed(3)
    return sorted(p for p in itertools.combinations(range(14), 2) if random.random() < 0.22)


def near(pairs):
    n = defaultdict(set)
    for a, b in pairs:
        n[a].add(b), n[b].add(a)
    return n


def search(n, s):
    dist, sigma, q = {s: 0}, defaultdict(float, {s: 1.0}), deque([s])
    while q:
        v = q.popleft()
        for w in n[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                q.append(w)
            if dist[w] == dist[v] + 1:
                sigma[w] += sigma[v]
    return dist, sigma


def test_betweenness_and_closeness(spark, pairs):
    n, g = near(pairs), make(spark, pairs, 15)
    score = defaultdict(float)
    found = {s: search(n, s) for s in range(15)}
    for s, t in itertools.combinations(range(15), 2):
        (ds, ss), (dt, st) = found[s], found[t]
        for v in range(15):
            if v not in (s, t) and t in ds and v in ds and v in dt and ds[v] + dt[v] == ds[t]:
                score[v] += ss[v] * st[v] / ss[t]
    got = {int(r.id[1:]): r.score for r in A.betweenness(g).collect()}
    assert len(got) == 15 and all(math.isclose(got[v], score[v], abs_tol=1e-9) for v in range(15))
    got = {int(r.id[1:]): r.score for r in A.closeness(g).collect()}
    for v in range(15):
        d = found[v][0]
        if len(d) > 1:
            assert math.isclose(got[v], (len(d) - 1) ** 2 / (sum(d.values()) * 14))


def test_blocks_samples_and_sketches(spark, pairs):
    """Small blocks give what one block gives; samples of all sources are exact; sketches of few nodes count them exactly."""
    n, g = near(pairs), make(spark, pairs, 15)
    whole, flows = P.betweenness_exact(g)
    for block in (4, 7):
        some, parts = P.betweenness_exact(g, block)
        assert {r.id: round(r.total, 9) for r in some.collect()} == {r.id: round(r.total, 9) for r in whole.collect()}
        assert {(r.src, r.dst): round(r.flow, 9) for r in parts.collect()} == {(r.src, r.dst): round(r.flow, 9) for r in flows.collect()}
    assert {(r.src, r.dst) for r in flows.collect()} == {(f"v{a:02}", f"v{b:02}") for a in n for b in n[a]}
    sampled, taken, bound = P.betweenness_within(g, 0.01, first=4)
    assert (taken, bound) == (15, 0.0)
    assert {r.id: round(r.total, 9) for r in sampled.collect()} == {r.id: round(r.total, 9) for r in whole.collect()}
    want = {f"v{v:02}": (sum(d := search(n, v)[0].values()), len(d) - 1) for v in range(15)}
    assert {r.id: (r.far, r.reached) for r in P.hyperball(g).collect()} == want
    assert {r.id: (r.far, r.reached) for r in P.closeness_exact(g, block=4).collect()} == {k: v for k, v in want.items() if v[1]}


def test_directed_levels(spark):
    """Edges one way, a cycle, and a second shortest path."""
    g = make(spark, [(0, 1), (1, 2), (0, 3), (3, 2), (2, 4), (4, 0), (4, 5)], 6, False)
    n = {0: [1, 3], 1: [2], 3: [2], 2: [4], 4: [0, 5], 5: []}
    score = defaultdict(float)
    found = {s: search(n, s) for s in range(6)}
    for s, t in itertools.permutations(range(6), 2):
        for v in {*range(6)} - {s, t}:
            ds, ss = found[s]
            if t in ds and v in ds and t in found[v][0] and ds[v] + found[v][0][t] == ds[t]:
                score[v] += ss[v] * found[v][1][t] / ss[t]
    got = {int(r.id[1:]): r.score for r in A.betweenness(g).collect()}
    assert all(math.isclose(got[v], score[v], abs_tol=1e-9) for v in range(6))


def test_sampled_betweenness_is_within_its_bound(spark):
    """1,500 nodes round two hubs: fewer sources than all, an error within the bound, and the same result twice."""
    random.seed(5)
    edges = {tuple(sorted((random.choice([0, 1, random.randrange(1500)]), v))) for v in range(2, 1500) for _ in range(2)}
    nodes = spark.createDataFrame([(f"v{i:04}", "n", "T") for i in range(1500)], "id string, name string, type string")
    rows = [(f"v{a:04}", f"v{b:04}", 1.0) for a, b in edges if a != b]
    g = Projection(nodes, spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src string, dst string, weight double"), True)
    exact = {r.id: r.total for r in P.betweenness_exact(g)[0].collect()}
    sampled, taken, bound = P.betweenness_within(g, 0.15, first=128)
    got = {r.id: r.total for r in sampled.collect()}
    assert taken < 1500 and 0 < bound <= 0.15
    worst = max(abs(got.get(k, 0) - exact.get(k, 0)) / (1500 * 1499) for k in {*got, *exact})
    assert worst <= bound
    balls, whole = ({r.id: (r.far, r.reached) for r in df.collect()} for df in (P.hyperball(g), P.closeness_exact(g)))
    assert balls.keys() >= whole.keys()
    assert max(abs(balls[k][0] / whole[k][0] - 1) for k in whole) < 0.05


def test_core_triangles_components(spark, pairs):
    n, g = near(pairs), make(spark, pairs, 15)
    core, left, k = {}, {v: set(n[v]) for v in range(15)}, 0
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for w in left.pop(v):
            left[w].discard(v)
    assert {int(r.id[1:]): r.core for r in A.k_core(g).collect()} == core
    tri = defaultdict(int)
    for t in itertools.combinations(range(15), 3):
        if all(b in n[a] for a, b in itertools.combinations(t, 2)):
            for v in t:
                tri[v] += 1
    assert {int(r.id[1:]): r.triangles for r in A.triangles(g).collect()} == dict(tri)
    assert {int(r.id[1:]): int(r.component[1:]) for r in A.wcc(g).collect()} == {v: min(search(n, v)[0]) for v in range(15)}


def test_communities(spark):
    groups = [range(0, 6), range(6, 12), range(12, 18)]
    g = make(spark, [p for r in groups for p in itertools.combinations(r, 2)] + [(0, 6), (7, 12)], 18)
    for f in (A.louvain, A.leiden):
        out = f(g)
        assert sorted(sorted(int(r.id[1:]) for r in rows) for rows in _grouped(out)) == [list(r) for r in groups]
        assert A.modularity(g, out).first()[0] > 0.5
    at = defaultdict(dict)
    for r in A.louvain_levels(g).collect():
        at[r.level][r.id] = r.cluster
    assert sorted(at) == list(range(1, len(at) + 1)) and all(len(x) == 18 for x in at.values())
    # Each level has fewer clusters, and what is together stays so.
    for low, high in itertools.pairwise(sorted(at)):
        assert len(set(at[high].values())) < len(set(at[low].values()))
        assert len({(at[low][v], at[high][v]) for v in at[low]}) == len(set(at[low].values()))
    assert {r.cluster for r in A.louvain_levels(make(spark, [], 3)).collect()} == {"v00", "v01", "v02"}
    tail = make(spark, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)], 6)
    levels, splits = A.girvan_newman(tail, 3)
    assert {(r.splits, r.component) for r in levels.collect()} >= {(1, "v00"), (2, "v00"), (2, "v03")}
    assert {r.component for r in A.best_cut(levels, splits).collect()} == {"v00", "v03"}
    first = splits.filter("splits = 2").first()
    assert (first.src, first.dst, first.score) == ("v02", "v03", 9.0) and abs(first.modularity - (2 * (6 / 14 - 0.25))) < 1e-12
    assert levels.filter("splits = 3").select("component").distinct().count() == 3
    top = A.edge_betweenness(tail).orderBy(F.desc("score")).first()
    assert (top.src, top.dst, top.score) == ("v02", "v03", 9.0)


def _grouped(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.cluster].append(r)
    return out.values()


def test_paths(spark):
    edges = {(0, 1): 1.0, (1, 2): 1.0, (0, 2): 5.0, (2, 3): 1.0, (4, 5): 1.0, (5, 4): 1.0}
    g = make(spark, list(edges), 6, False, lambda a, b: edges[a, b])
    assert tuple(A.dijkstra(g, "v00", "v03").first()) == ("v00 > v01 > v02 > v03", 3.0, 3)
    assert A.dijkstra(g, "v03", "v00").count() == 0
    adj = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    assert tuple(A.shortest_path(adj, "v00", "v03").first()) == ("v00 > v02 > v03", 2)
    topo = {r.id: (r.level, r.in_cycle) for r in A.topological_sort(g).collect()}
    assert topo["v03"] == (3, False) and topo["v04"] == (None, True)
    walks = A.random_walks(g, g.nodes, 5).collect()
    assert walks and sorted(map(str, walks)) == sorted(map(str, A.random_walks(g, g.nodes, 5).collect()))
    steps = defaultdict(dict)
    for r in walks:
        steps[r.walk][r.step] = int(r.id[1:])
    assert all((w[i], w[i + 1]) in edges for w in steps.values() for i in w if i + 1 in w)


def test_scores_do_not_depend_on_isolated_nodes(spark, pairs):
    a, b = (A.pagerank(make(spark, pairs, n)).select("id", F.round("score", 9).alias("s")) for n in (14, 20))
    assert a.exceptAll(b).count() == 0


def test_hub_pairs_equal_all_pairs(spark, pairs):
    n = near(pairs)
    adj = spark.createDataFrame([(f"v{a:02}", f"v{b:02}") for a in n for b in n[a]], "a string, b string")
    free = [(a, b) for a, b in itertools.combinations(sorted(n), 2) if b not in n[a]]
    want = sorted(((-len(n[a]) * len(n[b]), a, b) for a, b in free))[:5]
    assert [(-r.score, int(r.a[1:]), int(r.b[1:])) for r in L.lp_preferential_attachment(adj, 5).collect()] == want
    want = sorted(((-len(n[a] | n[b]), a, b) for a, b in free))[:5]
    assert [(-r.score, int(r.a[1:]), int(r.b[1:])) for r in L.lp_total_neighbors(adj, 5).collect()] == want


def test_profiles_of_a_hub(spark):
    """What lies beyond is read from the first neighbours of each way on, and still is the first of all."""
    random.seed(5)
    links = sorted({tuple(sorted(random.sample(range(40), 2))) for _ in range(45)} | {(0, v) for v in range(1, 36)})
    g = make(spark, links, 40, undirected=False)
    edges = g.edges.withColumn("type", F.lit("T"))
    n = near(links)
    want = {}
    for v in n:
        kept = sorted(n[v])[:3]
        beyond = sorted({c for a in kept for c in n[a]} - n[v] - {v})[:4]
        names = lambda x: ", ".join(sorted(f"name {i}" for i in x))
        want[f"v{v:02}"] = f"T: {names(kept)}" + (f"\nbeyond: {names(beyond)}" if beyond else "")
    assert {r.id: r.text for r in Q.entity_profiles(g.nodes, edges, g.nodes, 3, 4).collect()} == want


def test_random_projections(spark):
    """Against the same sums by hand; a vector stays whole on its way, so no row is a single number."""
    random.seed(8)
    pairs = sorted({tuple(sorted((random.choice([0, random.randrange(60)]), random.randrange(61, 90)))) for _ in range(150)})
    g, dim = make(spark, pairs, 99), 16
    h = spark.range(dim).select(F.col("id").cast("int").alias("d")).crossJoin(g.nodes.select("id")).select("id", "d", F.pmod(F.xxhash64(F.lit(42), "id", "d"), F.lit(6)).alias("h"))
    now, want = np.zeros((99, dim)), np.zeros((99, dim))
    for r in h.collect():
        now[int(r.id[1:]), r.d] = {0: 1, 1: -1}.get(r.h, 0)
    n = near(pairs)
    for w in (0, 1, 1):
        now = np.array([sum((now[v] for v in n[u]), np.zeros(dim)) for u in range(99)])
        now /= np.maximum(np.sqrt((now * now).sum(axis=1)), 1e-300)[:, None]
        want += w * now
    got = {int(r.id[1:]): r.embedding for r in M.fastrp(g, dim).collect()}
    assert len(got) == 99 and all(np.allclose(got[v], want[v], atol=1e-5) for v in got)
    sent = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [2.0, 2.0]), ("b", [0.0, 0.0])], "id string, x array<float>")
    assert [(r.id, [round(x, 6) for x in r.x]) for r in M._summed(sent, 2).collect()] == [("a", [0.6, 0.8])]


def test_sums_over_packed_edges(spark):
    """Several blocks give what one gives, doubled edges count twice, ends that are no nodes not at all; a round moves no edge."""
    random.seed(6)
    nodes = spark.createDataFrame([(f"v{i:03}",) for i in range(100)], "id string")
    rows = [(f"v{random.randrange(100):03}", f"v{random.randrange(110):03}") for _ in range(700)] * 2
    edges, value = spark.createDataFrame(rows, "src string, dst string"), {f"v{i:03}": 1.0 + i for i in range(100)}
    given = spark.createDataFrame(list(value.items()), "id string, v double")
    for per in (1 << 25, 200):
        b = Blocks(edges, nodes, True, per)
        assert b.of == (1 if per > 200 else 7) and b.named(b.values(given, "v"), "v").orderBy("id").collect() == given.orderBy("id").collect()
        for back, ends in ((False, (0, 1)), (True, (1, 0))):
            want = defaultdict(float)
            for r in rows:
                if r[1] in value:
                    want[r[ends[1]]] += value[r[ends[0]]]
            done = b.step(b.values(given, "v"), b.values(given, "v"), lambda total, own: (total, own), back)
            assert {r.id: r.s for r in b.named(done, "s").collect()} == {k: want[k] for k in value}
            plan = b.sums(b.values(given, "v"), back)._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount" in plan and plan.count("Exchange hashpartitioning") == 1


def test_edges_travel_once(spark):
    """Both directions of an edge arise after its one exchange, the greatest weight of either for both; a node's degrees as well."""
    g = make(spark, [], 4)
    e = spark.createDataFrame([("v00", "v01", 2.0), ("v01", "v00", 5.0), ("v02", "v01", None), ("v03", "v03", 1.0)], "src string, dst string, strength double")
    both, near = project(g.nodes, e, undirected=True).edges, adjacency(e)
    assert sorted(tuple(r) for r in both.collect()) == [("v00", "v01", 5.0), ("v01", "v00", 5.0), ("v01", "v02", 1.0), ("v02", "v01", 1.0)]
    assert sorted(tuple(r) for r in near.collect()) == [("v00", "v01"), ("v01", "v00"), ("v01", "v02"), ("v02", "v01")]
    for df in (both, near):
        assert "Union" not in df._jdf.queryExecution().executedPlan().toString()


def test_every_edge_from_one_join(spark):
    """A customer's relations to parts and to suppliers share the join of line items and orders."""
    plan = graph_edges(spark, "/root/testdata/sf0.001", every=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 2 and plan.count("Join Inner") == 1


def test_moves_read_edges_in_buckets(spark, monkeypatch):
    """A level's edges are dealt once, by the end whose label travels; two cliques come apart and keep their least ids."""
    dealt = []
    monkeypatch.setattr(A, "kept", lambda df, of, column: dealt.append((of, column)) or df)
    out = A.louvain(make(spark, [*itertools.combinations(range(5), 2), *itertools.combinations(range(5, 10), 2), (0, 9)], 10))
    assert {r.id: r.cluster for r in out.collect()} == {f"v{i:02}": "v00" if i < 5 else "v05" for i in range(10)}
    assert dealt and set(dealt) == {(1, "dst")}
