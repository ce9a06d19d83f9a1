import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kgloom.llm import conversation_repair as C

_BLANKS = " \t\n\x0b\x0c\r"


def _least(rows):
    """(cost, audit, messages) by plain recursion from the end; rows of (initial, fault, role, text)."""
    nexts = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "", ()), 3: (0, "", ())}

    def inserted(best):
        while True:
            new = dict(best)
            for q, to in nexts.items():
                if to in new:
                    c, a, m = new[to]
                    option = (c + 5, "I" + a, (("user" if to == 2 else "assistant", ""), *m))
                    if q not in new or option[:2] < new[q][:2]:
                        new[q] = option
            if new == best:
                return new
            best = new

    best = inserted(best)
    for initial, fault, role, text in reversed(rows):
        new = {}
        for q in range(4):
            options = [(best[q][0] + 2, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                to = nexts[q]
                said = "user" if to == 2 else "assistant"
                options.append((best[to][0] + 1 + more, "R" + best[to][1], ((said, text), *best[to][2])))
                keep = 1 if initial == "s" and q == 0 else to if initial == said[0] else None
                if keep is not None:
                    options.append((best[keep][0] + more, "K" + best[keep][1], ((role, text), *best[keep][2])))
            new[q] = min(options, key=lambda o: o[:2])
        best = inserted(new)
    return best[0]


def _brute(rows):
    """From (conv, turn, role, text, gone) to conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, messages)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text, gone in rows if c == conv and not gone]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, found = set(), []
        for _, role, text in own:
            s = text.strip(_BLANKS)
            found.append((role[:1], "blank" if not s else "duplicate" if (role, text) in seen else "" if s[-1] in ".!?" else "truncated", role, text))
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        faults = [f for _, f, _, _ in found]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") or not a[0] for a, b in zip(found, found[1:], strict=False))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, *_least(found))
    return out


def _run(spark, rows, block_rows, partitions=6):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, gone boolean, part int, rows int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        report, parts = C.repair_conversations(df, absent=F.col("gone"), block_rows=block_rows)
        counts = {r["conv_id"]: tuple(r[c] for c in C._COUNTS) for r in report.collect()}
        assert len(counts) == report.count()
        audit, messages = {}, {}
        for r in parts.orderBy("part", "block").collect():
            audit[r["conv_id"]] = audit.get(r["conv_id"], "") + r["audit"]
            messages.setdefault(r["conv_id"], []).extend((m["role"], m["text"]) for m in r["messages"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return {k: (*v, audit[k], tuple(messages[k])) for k, v in counts.items()}


def _random(rng, convs, longest):
    texts = ["a.", "b", "c! ", "", " \t", "d?\n", "e", None, "f.", "g.", "h."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "u", None]
    return [(c, rng.choice([t, t, t + 1, None]), rng.choice(roles), f"{rng.choice('xyz')} {t}." if rng.random() < 0.5 else rng.choice(texts), rng.random() < 0.1) for c in range(convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize(("convs", "longest", "block_rows"), [(60, 9, 1000), (40, 12, 3), (3, 150, 4), (1, 90, 1)])
def test_against_recursion(spark, convs, longest, block_rows):
    """Short conversations whole, long ones over many partitions and blocks of few rows."""
    rng = random.Random(convs)
    rows = _random(rng, convs, longest)
    assert _run(spark, rows, block_rows) == _brute(rows)


def test_hot_conversation_lies_over_partitions(spark):
    """A third of all rows in one conversation, most of them equal and of one turn."""
    rng = random.Random(4)
    rows = [*_random(rng, 30, 8), *((99, 1, "user", "same.", False) for _ in range(60)), *((99, t, rng.choice(["user", "assistant"]), f"t{t % 40}.", False) for t in range(2, 60))]
    assert _run(spark, rows, 5) == _brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "a.", False), (None, None, None, None, False), (1, 1, "user", "x.", True), (2, 5, "", "a.", False), (2, 5, "assistant", "long " * 50000, False), (2, 5, "assistant", "long " * 50000, False), (3, None, "user", "a.", False), (3, None, "assistant", "b.", False)]
    got = _run(spark, rows, 1000)
    assert got == _brute(rows)
    assert got[1] == (0, 0, 0, 0, 0, 0, "", ())
    assert _run(spark, [], 10) == {}


def test_ties_take_the_least_initials():
    """Rank by rank against all edits of the least cost."""
    rng = random.Random(8)
    for _ in range(300):
        rows = [(rng.choice("suat"), rng.choice(["", "", "truncated", "duplicate"]), "r", "t") for _ in range(rng.randint(0, 7))]
        import numpy as np

        code, fault = {"s": 0, "u": 1, "a": 2, "t": 3}, {"": 0, "duplicate": 2, "truncated": 3}
        w = C.Ways(np.array([code[r[0]] for r in rows], np.int64), np.array([fault[r[1]] for r in rows], np.int64), np.array([0, len(rows)]), C._END[None], np.array([True]))
        w.follow()
        path, _ = w.write(np.array([0]))
        cost, audit, _ = _least(rows)
        assert "".join(C._LETTERS[w.letters[path]]) == audit and w.costs[0, 0] == cost


def test_query(spark, tmp_path):
    """Damage and digests of the query, recomputed."""
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), f"Said {c} {t}! And more.") for c in [*range(40), None] for t in [*range(rng.randint(1, 6)), None]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    broken = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: text.translate({ord(x): None for x in ".!?"})}.get(kind, text)
        broken += [(c, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    want = {k: (*v[:7], hashlib.sha256("\n".join(f"{a}:{b}" for a, b in v[7]).encode()).hexdigest()) for k, v in _brute(broken).items()}
    got = C.op11_conversation_repair(spark, str(tmp_path))
    assert {r["conv_id"]: tuple(r[c] for c in (*C._COUNTS, "audit", "repaired_sha256")) for r in got.collect()} == want
