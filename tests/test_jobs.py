"""Entry points, files, streams and models."""

import json
import os
import random

import __spark_entry__ as entry
from pyspark.sql import functions as F

from kgloom.operators import ingest as I
from kgloom.operators import learning as M
from kgloom.sources import files as S
from kgloom.sources import graph as G
from kgloom.streaming import jobs as T

D = "/root/testdata/sf0.001"


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_typed_pairs_of_all_types(spark):
    """Customers and parts are paired as well, not nations and suppliers only."""
    want = {}
    for r in G.graph_nodes(spark, D).collect():
        want.setdefault((r.type, r.folder_id), []).append(r.id)
    want = {(*k, a, b) for k, ids in want.items() for a in ids for b in ids if a < b}
    got = [(r.type, r.folder_id, r.a, r.b) for r in entry.queries()["j7_typed_pairs"](spark, D).collect()]
    assert {k[0] for k in got} >= {"Customer", "Part"} and len(got) == len(want) and set(got) == want


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("été".encode())
    (tmp_path / "b.txt").write_bytes("été".encode("latin-1"))
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3,\n")
    assert [r.text for r in S.read_text_docs(spark, str(tmp_path / "*.txt")).collect()] == ["été", "été"]
    assert sorted(r.text for r in S.read_tabular_docs(spark, str(tmp_path / "c.csv")).collect()) == ["x: 1 | y: 2", "x: 3 | y: "]
    parsed = S.read_binary_docs(spark, str(tmp_path / "a.txt"), lambda b: b.decode().upper()).collect()
    assert parsed[0].text == "ÉTÉ"
    n, e = G.graph_nodes(spark, D), G.graph_edges(spark, D)
    S.write_lines(S.export_graph_json(n, e), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["id"]
    S.write_report(S.export_report(n, e), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() > 10
    S.append_table(n.select("id", "folder_id"), str(tmp_path / "t"), "folder_id")
    S.append_table(n.select("id", "folder_id"), str(tmp_path / "t"), "folder_id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 * n.count()


def test_chunks(spark):
    text = "Intro line.\nMETHODS\n" + " ".join(f"Sentence number {i} has some words." for i in range(80)) + "\nResults:\nshort"
    c = I.chunk(I.detect_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")))
    rows = c.orderBy("section", "chunk").collect()
    assert [r.title for r in rows][0] == "" and {r.title for r in rows} == {"", "METHODS", "Results"}
    assert all(len(r.content) <= 1000 for r in rows)
    o = I.add_overlap(c).filter("has_overlap").collect()
    assert o and all(r.content.startswith("[...] ") for r in o)


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet(f"{D}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), events)
    q = T.latest_progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("progress").collect())) == sorted(map(str, T.latest_progress(events).collect()))
    q = T.rate_counts(stream).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("rates").collect())) == sorted(map(str, T.rate_counts(events).collect()))
    seen = []
    T.ingest_stream(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination(120)
    assert sum(seen) == events.count()


def test_replayed_batches_merge_once(spark, tmp_path):
    """A batch that is played again, whole or after a death half-way, is there once."""
    rows = spark.range(20)
    merge = T.merged_once(str(tmp_path / "t"))
    merge(rows, 0), merge(rows, 0), merge(spark.range(20, 25), 1)
    (tmp_path / "t/batch=2").mkdir()
    (tmp_path / "t/batch=2/part-0.parquet").write_bytes(b"torn")
    merge(spark.range(25, 30), 2)
    assert sorted(r.id for r in T.ingested(spark, str(tmp_path / "t")).collect()) == list(range(30))
    spark.range(50).write.parquet(str(tmp_path / "in"))
    stream = T.read_stream(spark, str(tmp_path / "in"), rows)
    for _ in range(2):
        T.ingest_stream(stream, T.merged_once(str(tmp_path / "s")), str(tmp_path / "ck")).awaitTermination(120)
    # The checkpoint is lost: the source is read from the beginning, and its first batch is known.
    T.ingest_stream(stream, T.merged_once(str(tmp_path / "s")), str(tmp_path / "ck2")).awaitTermination(120)
    assert T.ingested(spark, str(tmp_path / "s")).count() == 50


def test_silent_members_drop_out(spark, tmp_path):
    """Signs in shuffled order over several files; a last sign far ahead moves the watermark past the silent ones' timers."""
    random.seed(3)
    kinds = ["signup", "view", "click", "error"]
    rows = [(i, 1_700_000_000 + i * 7 + random.randint(0, 200), random.choice(kinds), random.randrange(12), f'{{"k": {random.randrange(3)}}}') for i in range(240)]
    end = max(r[1] for r in rows) + 900
    schema = "event_id long, s long, event_type string, user_id long, props string"
    frame = lambda x: spark.createDataFrame(x, schema).select("event_id", F.timestamp_seconds("s").alias("ts"), "event_type", "user_id", "props")
    order = sorted(rows, key=lambda r: r[0] // 60 * 60 + random.random() * 59)
    for n, part in enumerate([order[:80], order[80:160], order[160:], [(999, end, "view", 99, '{"k": 9}')], [(1000, end + 1, "view", 99, '{"k": 9}')]]):
        frame(part).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{n}").glob("part-*")).rename(tmp_path / f"in/{n}.parquet")
        os.utime(tmp_path / f"in/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen: dict = {}
    try:
        like = frame(rows)
        source = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ttl = 600
        q = T.presence_stream(source, ttl * 1000, "10 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
        q.foreachBatch(lambda df, n: seen.update({n: [tuple(r) for r in df.collect()]})).start().awaitTermination(240)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    now: dict = {}
    for n in sorted(seen):
        rooms: dict = {}
        for room, present, members in seen[n]:
            rooms.setdefault(room, []).append((members, present))
        # Timers of one batch go off in order, so a room's fewest members are its latest.
        now |= {room: min(x) for room, x in rooms.items()}
    watermark = end - 600
    want = {r.room: (r.seen, r.present) for r in T.presence_at(frame(rows), f"{__import__('datetime').datetime.fromtimestamp(watermark, __import__('datetime').timezone.utc):%Y-%m-%d %H:%M:%S}", f"{ttl} seconds").collect()}
    assert {k: v for k, v in now.items() if k in "012"} == {k: want.get(k, (0, 0)) for k in "012"}


def test_models(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("label"))
    model, score = M.train_node_classifier(v)
    assert 0 <= score <= 1
    M.save_model(model, str(tmp_path), "types")
    assert [r.name for r in M.list_models(spark, str(tmp_path)).collect()] == ["types"]
    assert M.drop_model(spark, str(tmp_path), "types") and not (tmp_path / "types").exists()


def test_co_occurrences_travel_packed(spark):
    """Names that share chunks, against brute force; packed numbers are expanded where pairs are counted."""
    random.seed(6)
    rows = [(f"c{i}", n, 1) for i in range(12) for n in random.sample("abcdefgh", 4)]
    out = I.co_occurrences(spark.createDataFrame(rows, "chunk_id string, name string, n long"))
    held = {}
    for c, n, _ in rows:
        held.setdefault(c, set()).add(n)
    want = {(a, b): k for a in "abcdefgh" for b in "abcdefgh" if a < b and (k := sum(a in h and b in h for h in held.values())) >= 2}
    assert {(r.source, r.target): r.n for r in out.collect()} == want and len(want) > 5
    assert "explode(ys" in out._jdf.queryExecution().optimizedPlan().toString()
