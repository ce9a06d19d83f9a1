"""Packing documents into token sequences by minimum bin slack.

Each document's ids (with the closing id) are cut into full windows and one remainder. Remainders are packed by their
lengths alone: a histogram of at most ``window - 1`` lengths, whatever the corpus's size, is all that the driver sees.
For each window a bitset subset-sum over the multiset of remaining lengths (counts split in powers of two) finds the
fill closest to capacity; the chosen counts are read back by backtracking through the bitsets, and the pattern is
repeated as often as the histogram allows. Every pattern uses up a length, so there are at most as many patterns as
lengths. Spark then deals the pieces out: a piece's rank within its length (local rank plus the counts of the parts
before) falls into an interval of the small table of patterns, which gives its sequence and offset.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.llm.byte_bpe import token_starts
from kgloom.llm.common import plain, staged, table, text_slices
from kgloom.llm.pair_merging import LONG, Known, PairMerger, joined, spread

#: Characters that count as white space for Arrow and not for the tokenizer's \s.
_NOT_SPACE = "[\x1c\x1d\x1e\x1f]"


_UNASSIGNED: list[np.ndarray] = []


def _unassigned() -> np.ndarray:
    """By code point, whether it has no category in Python's tables."""
    if not _UNASSIGNED:
        _UNASSIGNED.append(np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)]))
    return _UNASSIGNED[0]


class WordIds:
    """Ids of texts by their words between white space; the normaliser and the split pattern work on each word by itself.

    A batch's distinct words that aren't known yet are normalised, split by one boundary scan, and merged together on arrays. Words with very long parts, and texts with the strings of special tokens, go to the library.
    """

    def __init__(self, path: str, size: int) -> None:
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path) as f:
            model = json.load(f)
        self.whole = "|".join([_NOT_SPACE, *(re.escape(t["content"]) for t in model["added_tokens"])])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        vocab, suffix = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        self.single, self.last = (np.array([vocab[byte[b] + end] for b in range(256)], np.int64) for end in ("", suffix))
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["model"]["merges"]]
        first: dict[tuple[int, int], int] = {}
        for i, (a, b) in enumerate(merges):
            first.setdefault((vocab[a], vocab[b]), i)
        left, right = (np.array(x, np.int64) for x in zip(*first, strict=True))
        self.pairs = PairMerger(left, right, np.fromiter(first.values(), np.int64), np.array([vocab[a + b] for a, b in merges], np.int64), np.append(self.single, self.last))
        self.known = Known(size, pa.string())

    def library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def merged(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has.

        A word falls into letters, single digits, other characters and the suffixes after an apostrophe, as the boundary
        scan of the byte-level codec finds them (a word holds no white space, so its rules for blanks never apply).
        """
        if not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = "".join(f"{w}\n" for w in words.to_pylist())
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case character by character: no rule for a sigma at a word's end.
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(token_starts(cps, each_digit=True))
        octets = np.frombuffer(text.encode(), np.uint8)
        cuts = np.append(np.flatnonzero((octets & 0xC0) != 0x80)[starts], len(octets))
        sizes = np.diff(cuts)
        closing = octets[cuts[:-1]] == 10  # the end of a word is a part of its own
        word = (np.cumsum(closing) - closing)[~closing]
        ids = self.single[octets]
        ids[cuts[1:] - 1] = self.last[octets[cuts[1:] - 1]]
        begin, sizes = cuts[:-1][~closing], sizes[~closing]
        # What this Python's tables don't know as assigned the library's may: such words are the library's as well.
        newer = np.cumsum(cps == 10)[_unassigned()[cps]]
        long = np.union1d(word[sizes > 4 * LONG], newer)
        here = ~np.isin(word, long)
        flat, n = self.pairs.merge(spread(ids, begin[here], sizes[here]), sizes[here])
        n = np.bincount(word[here], n, len(words)).astype(np.int64)
        if not len(long):
            return flat, n
        rest = np.setdiff1d(np.arange(len(words)), long)
        parts = [(rest, n[rest], flat)]
        for i in long.tolist():
            own = self.library_ids(words[i].as_py())
            parts.append((np.array([i]), np.array([len(own)]), own))
        return joined(parts)

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        special = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        lists = pc.utf8_split_whitespace(pc.if_else(pa.array(special), "", texts))
        words = pc.list_flatten(lists).dictionary_encode()
        flat, start, sizes = self.known.ids_of(words.dictionary, self.merged)
        which = words.indices.to_numpy()
        each = sizes[which]
        ids, past = spread(flat, start[which], each), np.append(0, np.cumsum(each))
        cuts = past[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))].tolist()
        for i, alone in enumerate(special.tolist()):
            yield self.library_ids(texts[i].as_py()) if alone else ids[cuts[i] : cuts[i + 1]]

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_column(pa.array([text])))


_LOADED: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, size: int) -> WordIds:
    """One table for each Python worker."""
    if (path, size) not in _LOADED:
        _LOADED[path, size] = WordIds(path, size)
    return _LOADED[path, size]


def _cutting(path: str, window: int, end_id: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path, size)
        context = TaskContext.get()
        part, seen = (context.partitionId() if context else 0), {}
        for b in batches:
            done = 0
            for texts in text_slices(b.column("text")):
                at, rows = [], []
                for i, ids in enumerate(words.encode_column(texts)):
                    raw, n = memoryview(np.append(ids, np.int32(end_id)).astype("<u4").tobytes()), len(ids) + 1
                    for s in range(0, n, window):
                        size_here = min(window, n - s)
                        r = seen.get(size_here, 0)
                        seen[size_here] = r + 1
                        at.append(done + i)
                        rows.append((s, size_here, zlib.crc32(raw[4 * s : 4 * (s + size_here)]), n, part, r))
                done += len(texts)
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(c, pa.int64()) for c in columns)], names)

    return run


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the greatest sum within ``room``, longest lengths preferred, by bitset subset sums."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    full = 1 << room
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0 and not reach & full:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left -= k
            k *= 2
    total, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            total -= length * k
            used[length] = used.get(length, 0) + k
    return used


def patterns(counts: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, lengths with their counts in one sequence), until the histogram is used up."""
    left, out = dict(counts), []
    while left:
        longest = max(left)
        used = best_fill({k: v - (k == longest) for k, v in left.items() if v > (k == longest)}, window - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // c for k, c in used.items())
        for k, c in used.items():
            left[k] -= times * c
            if not left[k]:
                del left[k]
        out.append((times, used))
    return out


def _intervals(fills: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, past rank, in each sequence, first sequence, offset of the first)."""
    rows, taken, sequence = [], {}, 0
    for times, used in fills:
        offset = 0
        for length, c in sorted(used.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, first + times * c, c, sequence, offset))
            taken[length] = first + times * c
            offset += length * c
        sequence += times
    return rows


def pack(df: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", table_size: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizers file at ``path`` without special tokens, then ``end_id``; a null text
    counts as empty and gives the closing id alone. Sequences have at most ``window`` ids; offsets are gapless from 0.
    Sequence ids are gapless from 0. Each row is a document of its own, also where ids repeat or are null. Texts are
    encoded whole, however long. Pieces of one length are placed in the order of parts and rows. An empty table gives an empty result; other columns are ignored. ``table_size`` bounds the words whose ids a worker keeps.
    """
    rows = plain(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    pieces = staged(rows.mapInArrow(_cutting(path, window, end_id, table_size), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long"))
    parts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = staged(parts.select("length", "part", "n", F.coalesce(before, F.lit(0)).alias("ahead")))
    # At most ``window`` rows.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = counts.pop(window, 0)
    fills = patterns(counts, window)
    small = [*_intervals(fills), *([(window, 0, whole, 1, sum(t for t, _ in fills), 0)] if whole else [])]
    ranked = pieces.join(parts.select("length", "part", "ahead").hint("merge"), ["length", "part"])
    place = F.arrow_udf(_placing(small), "struct<sequence: bigint, offset: bigint>")("length", (F.col("rank") + F.col("ahead")))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", place.alias("p")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("p.sequence").alias("sequence_id"), F.col("p.offset").alias("offset"))


def _placing(intervals: list[tuple[int, int, int, int, int, int]]) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """Finds the interval of each (length, rank) by binary search; there are a few for each length of the window at most."""
    rows = np.array(sorted(intervals), np.int64).reshape(-1, 6)
    keys = rows[:, 0] << 48 | rows[:, 1]

    def run(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(), rank.to_numpy()
        at = rows[np.searchsorted(keys, n << 48 | r, "right") - 1]
        r = r - at[:, 1]
        return pa.StructArray.from_arrays([pa.array(at[:, 4] + r // at[:, 3]), pa.array(at[:, 5] + r % at[:, 3] * n)], ["sequence", "offset"])

    return run


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


SQL: dict[str, str] = {}
QUERIES = {"op5_packing": op5_packing}
