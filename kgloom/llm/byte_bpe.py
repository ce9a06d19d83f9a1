"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

The split pattern is run without a regex engine. Each code point gets a class from an array, refined by its neighbours
(spaces before a word, suffixes after an apostrophe); each class is a transition function on four states, packed in a
byte; composing such functions is associative, so a blocked scan over whole batches gives the state before each code
point, and from class and state whether a token starts there. A batch's slices between starts are dictionary-encoded; each
distinct one takes its ids from a bounded table or, with all others that are new, from pair merging on arrays. The ids' byte
offsets are kept beside them, and decoding uses them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from kgloom.llm.common import plain, table, text_slices
from kgloom.llm.pair_merging import LONG, Known, PairMerger, joined, octets_of, spread

# States: what the last code point belongs to. DIGITS also stands for an open apostrophe suffix, which only letters follow.
FRESH, LETTERS, DIGITS, OTHERS = range(4)
# Classes of code points; from SP_L on refined by the neighbours.
LETTER, DIGIT, OTHER, SPACE, END, SP_FIRST, SP_L, SP_N, SP_O, SP_LAST, APOS, SUF_ONE, SUF_A, SUF_B = range(14)
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _rules() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each class its packed function, for each (class, state) whether a token starts, and the composition table."""
    same = [0, 1, 2, 3]
    after = {LETTER: [1] * 4, DIGIT: [2] * 4, OTHER: [3] * 4, SPACE: [0] * 4, END: [0] * 4, SP_FIRST: [0] * 4, SP_L: [1] * 4, SP_N: [2] * 4, SP_O: [3] * 4, SP_LAST: [0] * 4}
    after |= {APOS: [2, 2, 2, 3], SUF_ONE: [1, 1, 0, 1], SUF_A: [1, 1, 2, 1], SUF_B: [1, 1, 0, 1]}
    starts = {c: [True] * 4 for c in (SP_FIRST, SP_L, SP_N, SP_O, SP_LAST)} | {c: [False] * 4 for c in (SPACE, END)}
    starts |= {LETTER: [True, False, True, True], DIGIT: [True, True, False, True], OTHER: [True, True, True, False], APOS: [True, True, True, False]}
    starts |= {c: [True, False, False, True] for c in (SUF_ONE, SUF_A, SUF_B)}
    packed = np.array([sum(s << 2 * i for i, s in enumerate(after[c])) for c in range(14)] + [sum(s << 2 * i for i, s in enumerate(same))], np.uint8)
    f, g = np.divmod(np.arange(65536), 256)
    compose = sum(((g >> 2 * (f >> 2 * i & 3)) & 3) << 2 * i for i in range(4)).astype(np.uint8)
    return packed, np.array([starts[c] for c in range(14)]), compose


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": DIGIT}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[_WHITE] = SPACE
    return out


_FUNCTION, _STARTS, _COMPOSE = _rules()
_SAME = _FUNCTION[14]
_CLASS: list[np.ndarray] = []


def _states(functions: np.ndarray) -> np.ndarray:
    """The state before each position: a blocked scan, each step of which composes functions of all blocks at once."""
    n, width = len(functions), 64
    if n <= width:
        out, s = np.zeros(n, np.uint8), 0
        for i, f in enumerate(functions.tolist()):
            out[i], s = s, f >> 2 * s & 3
        return out
    blocks = -(-n // width)
    f = np.full(blocks * width, _SAME, np.uint8)
    f[:n] = functions
    f = np.ascontiguousarray(f.reshape(blocks, width).T)
    before = np.empty_like(f)
    run = np.full(blocks, _SAME, np.uint8)
    for k in range(width):
        before[k] = run
        run = _COMPOSE[(run.astype(np.uint16) << 8) | f[k]]
    enter = _states(run)
    return ((before >> (2 * enter)) & 3).T.reshape(-1)[:n]


def token_starts(cps: np.ndarray, each_digit: bool = False) -> np.ndarray:
    """Where tokens start in an array of code points in which texts are closed by 0x110000 (see ``END``).

    With ``each_digit`` every digit is a token.
    """
    if not _CLASS:
        _CLASS.append(np.append(_classes(), np.uint8(END)))
    base = _CLASS[0][cps]
    c = base.copy()
    after, ago = np.append(base[1:], END), np.append(np.uint8(END), base[:-1])
    white = base == SPACE
    first = white & (ago != SPACE)
    last = white & (after != SPACE) & (after != END)
    c[first] = SP_FIRST
    c[last] = SP_LAST
    for kind, to in ((LETTER, SP_L), (DIGIT, SP_N), (OTHER, SP_O)):
        c[last & (cps == 0x20) & (after == kind)] = to
    at = np.flatnonzero(cps == 0x27)
    at = at[at + 2 < len(cps)]
    one, two = cps[at + 1], cps[at + 2]
    is_one = np.isin(one, [ord(x) for x in "stmd"])
    is_two = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    c[at[is_one | is_two]] = APOS
    c[at[is_one] + 1] = SUF_ONE
    c[at[is_two] + 1] = SUF_A
    c[at[is_two] + 2] = SUF_B
    starts = _STARTS[c, _states(_FUNCTION[c])]
    return starts | (base == DIGIT) if each_digit else starts


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one slice: the adjacent pair of lowest rank, leftmost first, is joined until none is known."""
    if piece in ranks:
        return (ranks[piece],)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, ago = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
        if after[i] < len(parts):
            ago[after[i]] = i
        for a, b in ((ago[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (r := ranks.get(pair := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, len(pair)))
    return tuple(ranks[p] for p in parts if p is not None)


class Codec:
    """Encodes and decodes arrays of texts; the ids of the short slices met last are kept."""

    def __init__(self, path: str, size: int) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.strings = [b""] * (max(self.ranks.values()) + 1)
        for s, i in self.ranks.items():
            self.strings[i] = s
        self.lengths = np.array([len(s) for s in self.strings], np.int64)
        self.vocabulary, self.ids = pa.array(list(self.ranks), pa.binary()), np.fromiter(self.ranks.values(), np.int64)
        self.known = Known(size, pa.binary())
        self.octets, self.decimals = pa.array(self.strings, pa.binary()), pa.array([b"%d," % i for i in range(len(self.strings))], pa.binary())
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.pairs = _pairs(self.ranks, self.single)

    def merged(self, slices: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of slices one after another, and how many each has: vocabulary strings as such, all else merged."""
        octets, sizes = octets_of(slices)
        whole = pc.fill_null(pc.index_in(slices, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        one, rest, long = np.flatnonzero(whole >= 0), np.flatnonzero((whole < 0) & (sizes <= LONG)), np.flatnonzero((whole < 0) & (sizes > LONG))
        flat, n = self.pairs.merge(self.single[spread(octets, (np.cumsum(sizes) - sizes)[rest], sizes[rest])], sizes[rest])
        parts = [(one, np.ones(len(one), np.int64), self.ids[whole[one]]), (rest, n, flat)]
        for i in long.tolist():
            ids = np.array(merged(slices[i].as_py(), self.ranks), np.int64)
            parts.append((np.array([i]), np.array([len(ids)]), ids))
        return joined(parts)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin and end."""
        octets, sizes = octets_of(texts)
        n, raw = len(texts), pa.py_buffer(octets)
        offsets = np.cumsum(sizes)
        lead = np.flatnonzero((octets & 0xC0) != 0x80)  # where each code point begins
        ends = np.searchsorted(lead, offsets) + np.arange(n)
        cps = np.empty(len(lead) + n, np.uint32)
        keep = np.ones(len(cps), bool)
        keep[ends] = False
        cps[keep] = np.frombuffer(raw.to_pybytes().decode().encode("utf-32-le"), np.uint32)
        cps[ends] = 0x110000
        starts = np.flatnonzero(token_starts(cps))
        first = np.append(0, np.searchsorted(starts, ends))
        cuts = np.append(lead[starts - np.searchsorted(ends, starts)], len(octets)).astype(np.int32)
        slices = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(cuts), raw]).dictionary_encode()
        which = slices.indices.to_numpy()
        flat, start, sizes = self.known.ids_of(slices.dictionary, self.merged)
        each = sizes[which]
        return spread(flat, start[which], each), np.append(0, np.cumsum(each))[first]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        for part in text_slices(pa.array(texts, pa.string())):
            ids, cuts = self.encode_column(part)
            ids = ids.tolist()
            yield from (ids[a:b] for a, b in pairwise(cuts.tolist()))

    def offsets(self, ids: list[int] | np.ndarray) -> np.ndarray:
        """Where each id's bytes end in the text's bytes."""
        return np.cumsum(self.lengths[ids]) if len(ids) else np.zeros(0, np.int64)

    def decode(self, ids: list[int] | np.ndarray, offsets: np.ndarray | None = None) -> memoryview:
        """The bytes of the ids; with the retained offsets, it is checked that each id's bytes end where they did."""
        out, ends = _taken(self.octets, np.asarray(ids, np.int32))
        if offsets is not None and not np.array_equal(ends[1:], offsets):
            raise ValueError("ids and offsets don't fit")
        return out


def _taken(strings: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The strings of the ids in one piece, and where each ends (from 0)."""
    got = strings.take(pa.array(ids))
    ends = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    return memoryview(got.buffers()[2] or b"").cast("B")[: int(ends[-1])], ends


def _pairs(ranks: dict[bytes, int], single: np.ndarray) -> PairMerger:
    """All pairs of vocabulary strings that are a vocabulary string together; a string's rank is its id."""
    get = ranks.get
    pairs = [(a, b, r) for s, r in ranks.items() for i in range(1, len(s)) if (a := get(s[:i])) is not None and (b := get(s[i:])) is not None]
    return PairMerger(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)), np.arange(max(ranks.values()) + 1), single)


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(path: str, size: int) -> Codec:
    """One for each Python worker."""
    if (path, size) not in _CODECS:
        _CODECS[path, size] = Codec(path, size)
    return _CODECS[path, size]


def _encoding(path: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, size)
        for b in batches:
            at = 0
            for texts in text_slices(b.column("text")):
                ids, cuts = c.encode_column(texts)
                past = np.append(0, c.offsets(ids))
                ends = past[1:] - np.repeat(past[cuts[:-1]], np.diff(cuts))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x)) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), *lists], ["doc_id", "ids", "ends"])
                at += len(texts)

    return run


def _decoding(path: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, size)
        for b in batches:
            data = [bytes(c.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [])) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return run


def _round_trip(path: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, size)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            at = 0
            for texts in text_slices(b.column("text")):
                ids, cuts = c.encode_column(texts)
                said, ends = _taken(c.decimals, ids)
                back = c.decode(ids, offsets := c.offsets(ids))
                past = np.append(0, offsets)[cuts].tolist()
                one = [digest(said[x : max(x, y - 1)]) for x, y in pairwise(ends[cuts].tolist())]
                two = [digest(back[x:y]) for x, y in pairwise(past)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), pa.array(np.diff(cuts)), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(texts)

    return run


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, ids, ends (the byte offset at which each id's bytes end).

    Null texts count as empty and give no ids. Null and repeated ids pass through; an empty table gives an empty
    result; other columns are ignored. ``table_size`` bounds the slices whose ids a worker keeps.
    """
    rows = plain(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_encoding(path, table_size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, ends array<long>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", table_size: int = 100_000) -> DataFrame:
    """One row per input row: doc_id, data (the bytes of the ids; null ids count as none).

    Null and repeated doc_ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    rows = plain(df, doc_id=id_col, ids=ids_col)
    return rows.mapInArrow(_decoding(path, table_size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_size: int = 100_000) -> DataFrame:
    """Digests of ``encode`` and of the decoded bytes, computed in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty, of any length texts are read whole; null and repeated ids pass through; an empty table gives
    an empty result; other columns are ignored, also where they are named like the result's.
    """
    rows = plain(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_round_trip(path, table_size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


SQL: dict[str, str] = {}
QUERIES = {"op6_byte_bpe": op6_byte_bpe}
