"""Benchmark decontamination: an FM-index for each shard of the training texts, searched backwards for all test windows.

The driver reads the benchmark item by item and makes blocks of windows of a bounded number of words, which go to the tasks
by broadcast; a benchmark of several blocks gives as many passes, one behind the other in the same tasks. Texts are never
shuffled. A task takes its texts in shards: words become the numbers of the block's words, all others end a stretch, for
no window can reach over them, and stretches shorter than any window are left out. Stretches are cut into pieces that overlap by one word
less than the longest window, so every occurrence lies whole in a piece and suffixes are compared over a piece at most. The
index of the shard (``fm_index``) answers all windows at once by backward search through wavelet ranks; rows are located by sampled
suffix positions, the words found are confirmed byte by byte, and occurrences are merged into the spans to be removed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import plain, table, text_slices
from kgloom.llm.fm_index import FMIndex

#: Words are runs of 0-9, a-z and everything from code point 128 up, with A-Z lower-cased.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE, _UNBASE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes that are cut into words at a time, words of a shard, words of a piece besides the overlap, words of a block of windows.
_BYTES, _SHARD, _PIECE, _BLOCK = 1 << 20, 1 << 19, 64, 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1), _powers(_UNBASE, 1)


def cut_words(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts that lie at ``offsets`` in the bytes; a word ends with its text."""
    global _UP, _DOWN
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(octets):
        past = min(len(octets), at + _BYTES)
        # Cut where no word goes on: at a byte of no word, or at a text's end.
        while past < len(octets) and _IN_WORD[octets[past - 1]] and _IN_WORD[octets[past]]:
            step = octets[past : past + 4096]
            out = np.flatnonzero(~_IN_WORD[step])
            past += int(out[0]) if len(out) else len(step)
        part = octets[at:past]
        word = _IN_WORD[part]
        begins, closes = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        cuts = offsets[(offsets > at) & (offsets < past)] - at
        begins[cuts] = word[cuts]
        closes[cuts - 1] = word[cuts - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        if len(part) >= len(_UP):
            _UP, _DOWN = _powers(_BASE, len(part) + 1), _powers(_UNBASE, len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=sums[1:])
        hashes.append((sums[e] - sums[s]) * _DOWN[s])
        starts.append(s + at), ends.append(e + at)
        at = past
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64)


def _gather(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``sizes[0]`` places, and so on."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Windows:
    """A block of test windows: the distinct ones as rows of word numbers that end at the last column, and the items of each."""

    def __init__(self, items: list[tuple[str, list[str]]], width: int) -> None:
        """Items as (id, words)."""
        found: dict[tuple[str, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        for name, words in items:
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(place[name])
        coded = {w.encode(): w for w in {w for g in found for w in g}}
        octets = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum([len(b) for b in coded], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(coded) else ends
        _, _, hashes = cut_words(octets, starts)
        order = np.argsort(hashes)
        number = {list(coded.values())[j]: i + 1 for i, j in enumerate(order.tolist())}
        self.hashes, self.octets, self.starts, self.ends = hashes[order], octets, starts[order], ends[order]
        self.lengths = np.array([len(g) for g in found], np.int64)
        self.phrases = np.zeros((len(found), int(self.lengths.max(initial=1))), np.int32)
        for i, g in enumerate(found):
            self.phrases[i, self.phrases.shape[1] - len(g) :] = [number[w] for w in g]
        self.item_sizes = np.array([len(v) for v in found.values()], np.int64)
        self.item_starts = np.cumsum(self.item_sizes) - self.item_sizes
        self.items = np.array([x for v in found.values() for x in sorted(v)], np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers from 1 up, 0 for words that no window has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)

    def confirmed(self, numbers: np.ndarray, octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of the words are byte by byte those of their numbers."""
        n = numbers - 1
        sizes = ends - starts
        same = sizes == self.ends[n] - self.starts[n]
        some = np.flatnonzero(same)
        differ = _LOWER[octets[_gather(starts[some], sizes[some])]] != self.octets[_gather(self.starts[n[some]], sizes[some])]
        same[np.repeat(some, sizes[some])[differ]] = False
        return same


def _pieces(numbers: np.ndarray, text: np.ndarray, shortest: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of the pieces of all stretches of known words of one text that could hold a window."""
    known = np.concatenate([[0], numbers > 0, [0]])
    edge = np.flatnonzero(np.diff(known) != 0) if len(numbers) else np.zeros(0, np.int64)
    first, past = edge[::2], edge[1::2]
    # A stretch ends with its text as well.
    cuts = np.flatnonzero(np.diff(text)) + 1
    inner = cuts[(numbers[cuts - 1] > 0) & (numbers[cuts] > 0)] if len(cuts) else cuts
    first, past = np.sort(np.concatenate([first, inner])), np.sort(np.concatenate([past, inner]))
    long = past - first >= shortest
    first, past = first[long], past[long]
    n = np.maximum(1, -(-(past - first - overlap) // _PIECE))
    start = _gather(np.zeros(len(n), np.int64), n) * _PIECE + np.repeat(first, n)
    return start, np.minimum(np.repeat(past, n) - start, _PIECE + overlap)


def occurrences(numbers: np.ndarray, text: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """First words and windows of all occurrences; ``text`` is the number of the text that each word is of."""
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(windows.lengths):
        start, size = _pieces(numbers, text, int(windows.lengths.min()), windows.phrases.shape[1] - 1)
        shard = np.cumsum(size) // _SHARD
        for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(shard)) + 1):
            if not len(part):
                continue
            s, n = start[part], size[part]
            symbols = np.zeros(int(n.sum()) + len(part), np.int32)
            begins = np.cumsum(n + 1) - n - 1
            symbols[_gather(begins, n)] = numbers[_gather(s, n)]
            index = FMIndex(symbols, begins)
            low, high = index.search(windows.phrases, windows.lengths)
            hit = np.flatnonzero(high > low)
            count = high[hit] - low[hit]
            at = index.locate(_gather(low[hit], count))
            piece = np.searchsorted(begins, at, "right") - 1
            found_at.append(s[piece] + at - begins[piece]), found.append(np.repeat(hit, count))
    # The overlap of two pieces is found in both.
    return tuple(np.unique(np.stack([np.concatenate(found_at), np.concatenate(found)]), axis=1)) if len(found_at) > 1 else (found_at[0], found[0])


def _shard(texts: pa.Array, windows: Windows) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[list[str]]]:
    """For each text its number of words, the spans to be removed (first word, words, first byte, bytes), and the items found."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    octets = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends, hashes = cut_words(octets, offsets)
    text = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(text, minlength=len(texts)).astype(np.int64)
    numbers = windows.numbers(hashes)
    while True:
        at, which = occurrences(numbers, text, windows)
        steps = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + windows.lengths[which], -1)
        words = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        same = windows.confirmed(numbers[words], octets, starts[words], ends[words]) if len(words) else np.ones(0, bool)
        if same.all():
            break
        # Other words of the same hashes: they aren't of any window.
        numbers[words[~same]] = 0
    spans: list[list] = [[] for _ in range(len(texts))]
    items: list[list] = [[] for _ in range(len(texts))]
    if len(words):
        begins = np.concatenate([[True], (np.diff(words) > 1) | (np.diff(text[words]) > 0)])
        first, last = words[begins], words[np.concatenate([begins[1:], [True]])]
        base = np.cumsum(counts) - counts
        for i, a, z in zip(text[first].tolist(), first.tolist(), last.tolist(), strict=True):
            spans[i].append((a - int(base[i]), z - a + 1, int(starts[a] - offsets[i]), int(ends[z] - starts[a])))
        pairs = np.unique(np.stack([text[at], which]), axis=1)
        size = windows.item_sizes[pairs[1]]
        pairs = np.unique(np.stack([np.repeat(pairs[0], size), windows.items[_gather(windows.item_starts[pairs[1]], size)]]), axis=1)
        for i, item in pairs.T.tolist():
            items[i].append(windows.names[item])
    return counts, spans, items


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for a, n, b, m in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            p, q, r, s = out[-1]
            out[-1] = (p, max(q, a + n - p), r, max(s, b + m - r))
        else:
            out.append((a, n, b, m))
    return out


_OUT = ("n_words", "spans", "items")
_SPANS = pa.list_(pa.struct([(c, pa.int64()) for c in ("word", "words", "byte", "bytes")]))


def _searching(block: object, text_col: str, again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = block.value
        for b in batches:
            at = 0
            for texts in text_slices(b.column(text_col), _BYTES * 3):
                counts, spans, items = _shard(texts, windows)
                part = b.slice(at, len(texts))
                at += len(texts)
                if again:
                    spans = [_merged([*s, *(tuple(x.values()) for x in old)]) for s, old in zip(spans, part.column("__kg_spans").to_pylist(), strict=True)]
                    items = [sorted({*i, *old}) for i, old in zip(items, part.column("__kg_items").to_pylist(), strict=True)]
                names = [c for c in part.schema.names if c not in ("__kg_n_words", "__kg_spans", "__kg_items")]
                spans = [[dict(zip(("word", "words", "byte", "bytes"), s, strict=True)) for s in x] for x in spans]
                arrays = [pa.array(counts), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *arrays], [*names, *(f"__kg_{c}" for c in _OUT)])

    return run


def _blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Windows]:
    """Windows of some ``block_words`` words at a time, so the driver never holds more than a block and an item."""
    items, n = [], 0
    for r in benchmark.toLocalIterator():
        text = (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})
        items.append((r["item_id"] or "", _WORD.findall(text)))
        n += len(items[-1][1])
        if n >= block_words:
            yield Windows(items, width)
            items, n = [], 0
    if items:
        yield Windows(items, width)


def decontaminate(df: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, block_words: int = _BLOCK) -> DataFrame:
    """The rows with n_words, spans and items: which passages are of the benchmark (item_id, text), and of which items.

    Words are runs of digits, letters a to z and all characters from code point 128 up, after A-Z are lower-cased. A window is
    ``width`` consecutive words of an item, or the whole item if it has fewer; an item without words has none. ``spans`` are the
    merged occurrences of all windows as array<struct<word, words, byte, bytes>>: number of the first word, number of words, and the same in
    bytes of UTF-8. ``items`` are the distinct ids (as strings, null as empty) of the items with an occurring window, sorted.

    Null and empty texts have no words, no spans and no items. Texts are searched whole, however long; memory follows the
    longest. Windows that several items share count for each; repeated rows are searched each by itself. An empty table gives an
    empty result, an empty benchmark empty arrays. All columns pass through; those named like the output are replaced.
    """
    df = df.drop(*_OUT)
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", __kg_n_words long, __kg_spans array<struct<word: long, words: long, byte: long, bytes: long>>, __kg_items array<string>"
    rows, again = df, False
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    for block in _blocks(items, width, block_words):
        rows = rows.mapInArrow(_searching(df.sparkSession.sparkContext.broadcast(block), text_col, again), kinds)
        again = True
    if not again:
        rows = df.mapInArrow(_searching(df.sparkSession.sparkContext.broadcast(Windows([], width)), text_col, False), kinds)
    return rows.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__kg_{c}").alias(c) for c in _OUT))


def without_spans(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``decontaminate`` with their spans cut out of the texts; a null text becomes empty."""
    octets = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["byte"] + s["bytes"]))
    ends = F.concat(F.transform("spans", lambda s: s["byte"]), F.array(F.octet_length(octets).cast("long")))
    kept = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("z")), lambda p: F.decode(F.substring(octets, (p["a"] + 1).cast("int"), (p["z"] - p["a"]).cast("int")), "UTF-8"))
    return rows.withColumn(text_col, F.array_join(kept, ""))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = plain(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = {
    "op12_decontaminate": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
h AS (SELECT r, item_id, n, i FROM
        (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
         FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)) o
      JOIN g USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
}
QUERIES = {"op12_decontaminate": op12_decontaminate}
