"""Repair of conversations' structure: cheapest edits by dynamic programming, the least of them by prefix-doubling ranks.

A repaired conversation's role initials are (s?(ua)+)?, which a machine of four states reads: nothing yet (0), after a system
message (1), after a user's (2), after an assistant's (3); 0 and 3 may end. The nodes are (rows passed, state), the arcs the edits:
Delete and Keep and Rerole pass a row, Insert passes none. Work:

1. Rows are dealt by ranges of (conversation, turn, role, text), so a conversation of a third of all rows lies over many
   partitions, and are sorted there. A task turns whole conversations of a batch at once into arrays; conversations that reach
   beyond a partition, or are longer than a block, are left as blocks of rows.
2. The cost of the cheapest way from each node to the end is computed backwards, layer by layer for all conversations of a
   batch together. Arcs that lie on a cheapest way are optimal; of a node's optimal arcs no two have the same initial.
3. Nodes are ranked by the initials of their least optimal ways: by one initial, and then by pairs of ranks for 2, 4, 8 ... of
   them, each node pointing as far ahead. The arc of the least (initial, rank of where it leads) is taken at each node, and the
   doubled pointers write out all ways, one half of the steps each time.
4. Blocks of open conversations: first the texts that earlier blocks hold; then each block's 4 x 4 costs from state to state, which
   are multiplied up by partition and conversation and give each block the costs at its end; then its ways from each state, which are
   followed up in the same manner and give each block the state it begins with. No task ever holds a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.llm.common import BLANKS, staged, table

_FAR = 1 << 40
_LETTERS = np.array(list("DIKR"))
_DELETE, _REROLE, _INSERT, _CUT_OFF = 2, 1, 5, 5
#: Where a user's or an assistant's message leads from each state; where keeping s, u, a or another initial does (-1: nowhere).
_ADDED = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Costs at the end of a conversation: from each state with the inserts that are missing.
_END = np.array([0, 2 * _INSERT, _INSERT, 0])
#: Rows of a block.
_ROWS = 1 << 10
_BLANK, _DUPLICATE, _TRUNCATED = 1, 2, 3


def facts(role: pa.Array, text: pa.Array, owner: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Initials (0 to 3 for s, u, a and others; 4 for none) and first faults of rows in order; ``owner`` numbers their conversations.

    ``seen`` marks rows that stand in an earlier block.
    """
    initial = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(role, 0, 1), pa.array(["s", "u", "a"])), 3).to_numpy(zero_copy_only=False).astype(np.int64)
    initial[pc.binary_length(role).to_numpy(zero_copy_only=False) == 0] = 4
    ended = pc.utf8_rtrim(text, BLANKS)
    blank = pc.equal(pc.binary_length(ended), 0).to_numpy(zero_copy_only=False)
    whole = pc.is_in(pc.utf8_slice_codeunits(ended, -1), pa.array([".", "!", "?"])).to_numpy(zero_copy_only=False)
    codes = [pc.dictionary_encode(c).indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (role, text)]
    _, first, group = np.unique(np.stack([owner, *codes]), axis=1, return_index=True, return_inverse=True)
    repeated = first[group.reshape(-1)] != np.arange(len(owner))
    if seen is not None:
        repeated |= seen
    return initial, np.where(blank, _BLANK, np.where(repeated, _DUPLICATE, np.where(whole, 0, _TRUNCATED)))


class Ways:
    """The cheapest ways through blocks of rows, all at once. ``offsets`` are the blocks' first rows and the end of the last."""

    def __init__(self, initial: np.ndarray, fault: np.ndarray, offsets: np.ndarray, ends: np.ndarray, last: np.ndarray) -> None:
        """``ends``: costs from each state at each block's end. ``last``: whether a conversation ends there, so that inserts may follow."""
        self.initial, self.fault, self.offsets, self.last = np.minimum(initial, 3), fault, offsets, last
        sizes = np.diff(offsets)
        self.base = offsets[:-1] + np.arange(len(sizes))
        self.costs = np.full((len(initial) + len(sizes), 4), _FAR)
        self.costs[self.base + sizes] = ends
        by_size = np.argsort(-sizes, kind="stable")
        n = np.searchsorted(-sizes[by_size], -np.arange(1, int(sizes.max(initial=0)) + 1), "right")
        for back, active in enumerate(n, 1):
            blocks = by_size[:active]
            layer, row = self.base[blocks] + sizes[blocks] - back, offsets[blocks + 1] - back
            after = self.costs[layer + 1]
            here = after + _DELETE
            for to, cost in self._passing(row):
                here = np.minimum(here, np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), _FAR) + cost)
            for _ in range(2):
                here = np.minimum(here, here[:, _ADDED] + _INSERT)
            self.costs[layer] = np.minimum(here, _FAR)

    def _passing(self, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Where Keep and Rerole lead from each state, and their costs."""
        extra = np.where(self.fault[row] == _TRUNCATED, _CUT_OFF, 0)[:, None]
        stays = ((self.fault[row] != _BLANK) & (self.fault[row] != _DUPLICATE))[:, None]
        yield np.where(stays, _KEPT[self.initial[row]], -1), extra
        yield np.where(stays, _ADDED[None, :], -1), extra + _REROLE

    def follow(self) -> None:
        """Optimal arcs, ranks and pointers of all nodes."""
        sizes = np.diff(self.offsets)
        n = len(self.costs)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        place = np.arange(n) - self.base[owner]
        inner = place < sizes[owner]
        row = np.where(inner, np.arange(n) - owner, 0)
        after = np.where(inner, np.arange(n) + 1, 0)
        to = np.full((4, n, 4), -1)
        if len(self.initial):
            (keep, keep_cost), (rerole, rerole_cost) = self._passing(row)
        else:
            keep = rerole = np.full((n, 4), -1)
            keep_cost = rerole_cost = np.zeros((n, 1), np.int64)
        states = np.broadcast_to(np.arange(4), (n, 4))
        added = np.broadcast_to(_ADDED, (n, 4))
        for letter, (node, state, cost, may) in enumerate(((after, states, _DELETE, inner), (np.arange(n), added, _INSERT, inner | self.last[owner]), (after, keep, keep_cost, inner), (after, rerole, rerole_cost, inner))):
            fits = may[:, None] & (state >= 0)
            there = self.costs[node[:, None], np.maximum(state, 0)] + cost
            to[letter] = np.where(fits & (there == self.costs) & (self.costs < _FAR), node[:, None] * 4 + np.maximum(state, 0), -1)
        to = to.reshape(4, -1)
        optimal = to >= 0
        ended = ~optimal.any(axis=0)
        letter = optimal.argmax(axis=0)
        node = np.arange(4 * n)
        rank, pointer = np.where(ended, 0, letter + 1), np.where(ended, node, to[letter, node])
        self.pointers, steps = [pointer], (~ended).astype(np.int64)
        while True:
            if len(rank):
                rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1].reshape(-1)
            steps, further = steps + steps[pointer], pointer[pointer]
            if (further == pointer).all():
                break
            pointer = further
            self.pointers.append(pointer)
        self.ends = pointer
        self.steps = steps if len(self.pointers) > 1 else (~ended).astype(np.int64)
        # The least initial, and of several arcs with it the one that leads to the least rank.
        order = np.where(optimal, np.arange(4)[:, None] * (int(rank.max(initial=0)) + 1) + rank[np.maximum(to, 0)], np.iinfo(np.int64).max)
        self.letters = order.argmin(axis=0)

    def write(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the least ways from the blocks' states at their beginning, one after the other, and their lengths."""
        start = self.base * 4 + entry
        lengths = self.steps[start]
        offset = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.int64)
        some = np.flatnonzero(lengths)
        at, left = offset[some], lengths[some]
        out[at] = start[some]
        for k in range(len(self.pointers) - 1, -1, -1):
            on = left > 1 << k
            out[at[on] + (1 << k)] = self.pointers[k][out[at[on]]]
            at = np.concatenate([at, at[on] + (1 << k)])
            left = np.concatenate([np.where(on, 1 << k, left), left[on] - (1 << k)])
        return out, lengths


_MESSAGE = pa.struct([("role", pa.string()), ("text", pa.string())])
_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_MESSAGES, _SOURCE = "array<struct<role: string, text: string>>", "array<struct<turn: long, role: string, text: string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _written(ways: Ways, entry: np.ndarray, role: pa.Array, text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each block's audit and messages."""
    path, lengths = ways.write(entry)
    letters = ways.letters[path]
    letter_text = "".join(_LETTERS[letters])
    ends = np.cumsum(lengths)
    audits = pa.array([letter_text[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.string())
    block = np.repeat(np.arange(len(lengths)), lengths)
    row, said = path // 4 - block, letters > 0
    # Added and changed roles lead to state 2 (a user's) or 3.
    added = len(role) + (_ADDED[path % 4] == 3)
    roles = pc.take(pa.concat_arrays([role, pa.array(["user", "assistant"])]), pa.array(np.where(letters == 2, row, added)[said]))
    texts = pc.take(pa.concat_arrays([text, pa.array([""])]), pa.array(np.where(letters == 1, len(text), row)[said]))
    kept = np.concatenate([[0], np.cumsum(np.bincount(block[said], minlength=len(lengths)))])
    return audits, pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.StructArray.from_arrays([roles, texts], fields=list(_MESSAGE)))


def _turns(turn: pa.Array, offsets: np.ndarray) -> np.ndarray:
    """maxTurn - minTurn + 1 - distinct turns of each block's sorted rows."""
    valid = turn.is_valid().to_numpy(zero_copy_only=False)
    values = pc.fill_null(turn, 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[valid]
    values = values[valid]
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(values):
        begins = np.concatenate([[True], np.diff(owner) > 0])
        ends = np.concatenate([begins[1:], [True]])
        distinct = np.bincount(owner, begins | np.concatenate([[True], np.diff(values) != 0]), len(out)).astype(np.int64)
        some = owner[begins]
        out[some] = values[ends] - values[begins] + 1 - distinct[some]
    return out


def _illegal(initial: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    a, b = initial[:-1], initial[1:]
    wrong = (owner[:-1] == owner[1:]) & ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))
    return np.bincount(owner[1:][wrong], minlength=n).astype(np.int64)


def _first_pass(kind: pa.DataType, rows_of_block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["conv", "part", "block", "whole", *_COUNTS, "audit", "messages", "rows"]

    def blocks(t: pa.Table, cuts: np.ndarray, part: int, at: int, whole: bool) -> pa.RecordBatch:
        """A row for each of the blocks between the cuts; rows that only name their conversation are left out of them."""
        there = ~t.column("gone").to_numpy(zero_copy_only=False)
        n = len(cuts) - 1
        offsets = np.concatenate([[0], np.cumsum(there)])[cuts]
        conv = t.column("conv").combine_chunks().take(pa.array(cuts[:-1]))
        head = [conv, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n)), pa.array(np.full(n, whole))]
        turn, role, text = (t.column(c).combine_chunks().filter(pa.array(there)) for c in ("turn", "role", "text"))
        if not whole:
            rows = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([turn, role, text], fields=list(_ROW)))
            return pa.RecordBatch.from_arrays([*head, *[pa.nulls(n, pa.int64())] * 6, pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(_MESSAGE)), rows], names)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        initial, fault = facts(role, text, owner)
        ways = Ways(initial, fault, offsets, np.tile(_END, (n, 1)), np.ones(n, bool))
        ways.follow()
        audits, messages = _written(ways, np.zeros(n, np.int64), role, text)
        counts = [_turns(turn, offsets), *(np.bincount(owner[fault == f], minlength=n).astype(np.int64) for f in (_BLANK, _DUPLICATE, _TRUNCATED)), _illegal(initial, owner, n), ways.costs[ways.base, 0]]
        return pa.RecordBatch.from_arrays([*head, *map(pa.array, counts), audits, messages, pa.nulls(n, pa.list_(_ROW))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        waiting: pa.Table | None = None
        # The conversation that a partition begins or ends with may reach beyond it.
        opened = True
        for b in _closed(batches):
            t = waiting if b is None else pa.Table.from_batches([b]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            codes = pc.fill_null(pc.dictionary_encode(t.column("conv").combine_chunks()).indices, -1).to_numpy(zero_copy_only=False)
            runs = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
            done = len(runs) - 1 if b is None else len(runs) - 2
            ready: list[tuple[int, int, bool]] = []
            for i, (first, past) in enumerate(zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True)):
                is_open = (opened and i == 0) or past - first > rows_of_block or (b is None and i == done - 1)
                if i < done or is_open and past - first > rows_of_block:
                    # Of the run that goes on, only full blocks are given out.
                    stop = past if i < done else first + (past - first) // rows_of_block * rows_of_block
                    step = rows_of_block if is_open else past - first
                    ready += [(x, min(x + step, stop), is_open) for x in range(first, stop, step)]
            opened = (opened and len(runs) == 2) or (len(ready) > 0 and done < len(runs) - 1 and ready[-1][1] > runs[-2])
            used = ready[-1][1] if ready else 0
            i = 0
            while i < len(ready):
                j = i
                while j < len(ready) and ready[j][2] == ready[i][2]:
                    j += 1
                cuts = np.array([ready[i][0], *(z for _, z, _ in ready[i:j])])
                yield blocks(t.slice(cuts[0], cuts[-1] - cuts[0]), cuts - cuts[0], part, at, not ready[i][2])
                at += j - i
                i = j
            waiting = t.slice(used)

    return run


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _listed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), column.flatten()


def _opened(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Offsets, owners, initials, faults, turns, roles and texts of blocks of open conversations."""
    offsets, rows = _listed(b.column("rows"))
    turn, role, text = (rows.field(i) for i in range(3))
    owner = np.repeat(np.arange(b.num_rows), np.diff(offsets))
    seen = [set(x or ()) for x in b.column("seen").to_pylist()]
    marks = np.fromiter((bool(seen[o]) and _mark(r, t) in seen[o] for o, r, t in zip(owner.tolist(), role.to_pylist(), text.to_pylist(), strict=True)), bool, len(owner))
    initial, fault = facts(role, text, owner, marks)
    return offsets, owner, initial, fault, turn, role, text


def _mark(role: str, text: str) -> str:
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def _second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's counts, what stands at its ends, and its costs from state to state."""
    for b in batches:
        offsets, owner, initial, fault, turn, _, _ = _opened(b)
        n = b.num_rows
        costs = np.zeros((n, 4, 4), np.int64)
        for state in range(4):
            end = np.where(np.arange(4) == state, 0, _FAR)
            ways = Ways(initial, fault, offsets, np.tile(end, (n, 1)), np.zeros(n, bool))
            costs[:, :, state] = ways.costs[ways.base]
        some = np.diff(offsets) > 0
        ends = [np.where(some, initial[np.minimum(i, len(initial) - 1)] if len(initial) else 0, -1) for i in (offsets[:-1], offsets[1:] - 1)]
        low, high = [], []
        for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            extremes = pc.min_max(turn.slice(a, z - a)).as_py()
            low.append(extremes["min"]), high.append(extremes["max"])
        gaps = _turns(turn, offsets)
        distinct = [None if x is None else y - x + 1 - int(g) for x, y, g in zip(low, high, gaps, strict=True)]
        counts = [np.bincount(owner[fault == f], minlength=n).astype(np.int64) for f in (_BLANK, _DUPLICATE, _TRUNCATED)]
        arrays = [b.column("ck"), b.column("part"), b.column("block"), pa.array(list(costs.reshape(n, 16)), pa.list_(pa.int64())), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(distinct, pa.int64()), *map(pa.array, counts), pa.array(_illegal(initial, owner, n)), *(pa.array(e) for e in ends)]
        yield pa.RecordBatch.from_arrays(arrays, ["ck", "part", "block", "value", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal", "first", "last"])


def _third_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's state at its end for each at its beginning."""
    for b in batches:
        offsets, _, initial, fault, *_ = _opened(b)
        given = np.array(b.column("given").to_pylist(), np.int64).reshape(-1, 5)
        ways = Ways(initial, fault, offsets, given[:, :4], given[:, 4] > 0)
        ways.follow()
        to = ways.ends[ways.base[:, None] * 4 + np.arange(4)] % 4
        yield pa.RecordBatch.from_arrays([b.column("ck"), b.column("part"), b.column("block"), pa.array(list(to), pa.list_(pa.int64()))], ["ck", "part", "block", "value"])


def _last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        offsets, _, initial, fault, _, role, text = _opened(b)
        given = np.array(b.column("given").to_pylist(), np.int64).reshape(-1, 5)
        entry = np.array(b.column("entry").to_pylist(), np.int64).reshape(-1)
        ways = Ways(initial, fault, offsets, given[:, :4], given[:, 4] > 0)
        ways.follow()
        audits, messages = _written(ways, entry, role, text)
        cost = ways.costs[ways.base, entry]
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("ck"), b.column("part"), b.column("block"), pa.array(cost), audits, messages], ["conv", "ck", "part", "block", "cost", "audit", "messages"])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _costs_up(values: list) -> list:
    out = np.array(values[-1]).reshape(4, 4)
    for v in values[-2::-1]:
        out = _product(np.array(v).reshape(4, 4), out)
    return out.reshape(-1).tolist()


def _costs_down(values: list, end: list) -> list[list]:
    """For each of the values what holds at its end, where ``end`` holds at the last one's; the fifth number: a conversation ends there."""
    out = [end]
    for v in values[:0:-1]:
        out.append([*np.minimum((np.array(v).reshape(4, 4) + np.array(out[-1][:4])).min(axis=1), _FAR).tolist(), 0])
    return out[::-1]


def _states_up(values: list) -> list:
    out = [0, 1, 2, 3]
    for v in values:
        out = [v[s] for s in out]
    return out


def _states_down(values: list, begin: list) -> list[list]:
    out = [begin]
    for v in values[:-1]:
        out.append([v[out[-1][0]]])
    return out


def _swept(blocks: DataFrame, up: Callable[[list], list], down: Callable[[list, list], list[list]], given: list) -> DataFrame:
    """(ck, part, block, given): what the blocks' values make of ``given`` at the conversation's end or beginning.

    The values of a partition's blocks are combined first, so a conversation is one value for each partition.
    """

    def ordered(t: pa.Table, by: str) -> pa.Table:
        return t.take(pc.sort_indices(t, sort_keys=[(by, "ascending")]))

    def by_part(t: pa.Table) -> pa.Table:
        values = ordered(t, "block").column("value").to_pylist()
        return pa.table({"ck": t.column("ck")[:1], "part": t.column("part")[:1], "value": pa.array([up(values)], pa.list_(pa.int64()))})

    def by_conversation(t: pa.Table) -> pa.Table:
        t = ordered(t, "part")
        return pa.table({"ck": t.column("ck"), "part": t.column("part"), "given": pa.array(down(t.column("value").to_pylist(), given), pa.list_(pa.int64()))})

    def by_block(t: pa.Table, above: pa.Table) -> pa.Table:
        t = ordered(t, "block")
        found = down(t.column("value").to_pylist(), above.column("given")[0].as_py()) if t.num_rows else []
        return pa.table({"ck": t.column("ck"), "part": t.column("part"), "block": t.column("block"), "given": pa.array(found, pa.list_(pa.int64()))})

    blocks = blocks.select("ck", "part", "block", "value")
    parts = blocks.groupBy("ck", "part").applyInArrow(by_part, "ck string, part long, value array<long>")
    above = parts.groupBy("ck").applyInArrow(by_conversation, "ck string, part long, given array<long>")
    return blocks.groupBy("ck", "part").cogroup(above.groupBy("ck", "part")).applyInArrow(by_block, "ck string, part long, block long, given array<long>")


def _open_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of blocks (conv, part, block, rows): (ck, conv, gaps, ..., cost), and (conv, ck, part, block, cost, audit, messages)."""
    key = ["ck", "part", "block"]
    rows = rows.select(F.to_json(F.struct("conv")).alias("ck"), "conv", "part", "block", "rows")
    each = rows.select(*key, F.explode("rows").alias("r"))
    mark = F.sha2(F.concat(F.octet_length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")), 256)
    marks = each.select(*key, mark.alias("mark")).distinct()
    first = marks.groupBy("ck", "mark").agg(F.min(F.struct("part", "block")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = marks.join(first, ["ck", "mark"]).filter(F.struct("part", "block") > F.col("first")).groupBy(*key).agg(F.collect_list("mark").alias("seen"))
    rows = staged(rows.join(seen, key, "left"))
    kind = rows.schema["conv"].dataType.simpleString()
    facts_ = staged(rows.select(*key, "rows", "seen").mapInArrow(_second_pass, "ck string, part long, block long, value array<long>, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first long, last long"))
    given = staged(_swept(facts_, _costs_up, _costs_down, [*_END.tolist(), 1]))
    known = rows.join(given, key)
    ends = known.select(*key, "rows", "seen", "given").mapInArrow(_third_pass, "ck string, part long, block long, value array<long>")
    entries = _swept(staged(ends), _states_up, _states_down, [0]).select(*key, F.col("given")[0].alias("entry"))
    written = staged(known.join(entries, key).mapInArrow(_last_pass, f"conv {kind}, ck string, part long, block long, cost long, audit string, messages {_MESSAGES}"))
    # What meets at the borders of blocks: pairs of initials, and turns that two blocks share.
    order = Window.partitionBy("ck").orderBy("part", "block")
    pair = F.concat_ws(",", F.lag("last").over(order), "first")
    borders = facts_.filter("first >= 0").select("ck", "part", "block", pair.alias("pair"), F.lag("last").over(order).alias("before"))
    borders = borders.filter("before is not null").groupBy("ck").agg(F.sum((~F.col("pair").isin("0,1", "1,2", "2,1")).cast("long")).alias("more_illegal"))
    shared = facts_.filter("low is not null").select("ck", F.lag("high").over(order).alias("before"), "low").groupBy("ck").agg(F.sum((F.col("before") == F.col("low")).cast("long")).alias("shared"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    total = facts_.groupBy("ck").agg(*sums, F.max("high").alias("high"), F.min("low").alias("low"), F.sum("distinct").alias("distinct"))
    costs = written.groupBy("ck").agg(F.min_by("cost", F.struct("part", "block")).alias("cost"), F.first("conv").alias("conv"))
    total = total.join(borders, "ck", "left").join(shared, "ck", "left").join(costs, "ck")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct") + F.coalesce("shared", F.lit(0)), F.lit(0))
    counts = total.select("ck", "conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce("more_illegal", F.lit(0))).alias("illegal"), "cost")
    return counts, written


def _repaired(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, absent: Column | None, block_rows: int) -> tuple[DataFrame, DataFrame]:
    kind = rows.schema[conv_col].dataType
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    plain = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("gone"))
    plain = plain.withColumn("role", F.when(~F.col("gone"), F.col("role")).otherwise("")).withColumn("text", F.when(~F.col("gone"), F.col("text")).otherwise(""))
    # Equal rows are told apart by where they were read, so that no number of them has to lie in one partition.
    plain = plain.withColumns({"head": F.substring("text", 1, 64), "rest": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    order = ["conv", "turn", "role", "head", "rest", "uid"]
    sorted_ = plain.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "gone")
    schema = f"conv {kind.simpleString()}, part long, block long, whole boolean, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, messages {_MESSAGES}, rows {_SOURCE}"
    done = staged(sorted_.mapInArrow(_first_pass(kind, block_rows), schema))
    return done.filter("whole"), done.filter("not whole")


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None, block_rows: int = _ROWS) -> tuple[DataFrame, DataFrame]:
    """A report (conv_id, gaps, blank, duplicate, truncated, illegal, cost) and parts of the repaired conversations (conv_id, part, block, audit, messages).

    Parts in order of (part, block) make up a conversation: ``audit`` names the edits, ``messages`` are (role, text). Rows are taken by turn,
    nulls first, those of one turn by role, the text's first 64 characters and its hash. First faults: blank, duplicate (role and text
    seen earlier), truncated (doesn't end with . ! ?). Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must be
    deleted), Insert an empty message 5; truncated rows that stay cost 5 more. Of the cheapest edits that give (s?(ua)+)? the ones
    whose initials come first in ASCII are taken. ``gaps``: turns that are missing between the least and the greatest; ``illegal``:
    neighbours whose initials aren't su, ua or au.

    A null role or text is one blank; a null conversation is one of its own; a role without characters can't be kept. Rows under
    the condition ``absent`` only name their conversation; one without other rows has zeros, an empty audit and no messages. Conversations
    of any length lie over many tasks in blocks of ``block_rows``; texts may be of any length; repeated rows are duplicates. An empty table
    gives empty results; other columns, however named, are ignored.
    """
    whole, blocks = _repaired(rows, conv_col, turn_col, role_col, text_col, absent, block_rows)
    counts, written = _open_conversations(blocks)
    report = whole.select("conv", *_COUNTS).unionByName(counts.select("conv", *_COUNTS)).withColumnRenamed("conv", conv_col)
    columns = ("conv", "part", "block", "audit", "messages")
    return report, whole.select(*columns).unionByName(written.select(*columns)).withColumnRenamed("conv", conv_col)


def _digesting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks in order: each conversation's audit, and the digest of its messages, text by text."""
    names, now, audit, digest, some = ["ck", "audit", "repaired_sha256"], None, [], hashlib.sha256(), False
    row = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (now, "".join(audit), digest.hexdigest())], names)
    for b in batches:
        for ck, letters, messages in zip(*(b.column(c) for c in ("ck", "audit", "messages")), strict=True):
            if ck.as_py() != now:
                if now is not None:
                    yield row()
                now, audit, digest, some = ck.as_py(), [], hashlib.sha256(), False
            audit.append(letters.as_py())
            for m in messages.as_py():
                digest.update(f"{chr(10) if some else ''}{m['role']}:{m['text']}".encode())
                some = True
    if now is not None:
        yield row()


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``: dropped (gone), emptied, unpunctuated, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind", F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int"))))
    return rows.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole, blocks = _repaired(damaged(table(spark, sf_dir, "conversations")), "conv_id", "turn", "role", "text", F.col("gone"), _ROWS)
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    short = whole.select("conv", *_COUNTS, "audit", F.sha2(F.array_join(said, "\n"), 256).alias("repaired_sha256"))
    counts, written = _open_conversations(blocks)
    in_order = written.select("ck", "part", "block", "audit", "messages").repartition("ck").sortWithinPartitions("ck", "part", "block").select("ck", "audit", "messages")
    long = counts.join(in_order.mapInArrow(_digesting, "ck string, audit string, repaired_sha256 string"), "ck").select("conv", *_COUNTS, "audit", "repaired_sha256")
    return short.unionByName(long).withColumnRenamed("conv", "conv_id")


SQL = {
    "op11_conversation_repair": r"""
WITH RECURSIVE o AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::UBIGINT)),
        lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)::UBIGINT[]), lambda y, i: xor(y >> 1, (y & 1) * 3988292384::UBIGINT)))) % 20 AS kind
    FROM conversations),
d AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM o)),
i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
f AS (SELECT k, i, turn, role, text, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS p,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM i),
t AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
             count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY k),
-- From the last row to the first: the cheapest edits of the rest from each state, as (cost, audit, messages).
w AS (SELECT k, n + 1 AS i, {'c': 0, 'a': '', 'm': []::VARCHAR[]} AS s0, {'c': 10, 'a': 'II', 'm': ['user:', 'assistant:']} AS s1,
             {'c': 5, 'a': 'I', 'm': ['assistant:']} AS s2, {'c': 0, 'a': '', 'm': []::VARCHAR[]} AS s3 FROM t
      UNION ALL
      SELECT k, i, list_min([b0, {'c': b2.c + 5, 'a': 'I' || b2.a, 'm': list_prepend('user:', b2.m)}, {'c': b3.c + 10, 'a': 'II' || b3.a, 'm': list_concat(['user:', 'assistant:'], b3.m)}]),
             list_min([b1, {'c': b2.c + 5, 'a': 'I' || b2.a, 'm': list_prepend('user:', b2.m)}, {'c': b3.c + 10, 'a': 'II' || b3.a, 'm': list_concat(['user:', 'assistant:'], b3.m)}]),
             list_min([b2, {'c': b3.c + 5, 'a': 'I' || b3.a, 'm': list_prepend('assistant:', b3.m)}]), list_min([b3, {'c': b2.c + 5, 'a': 'I' || b2.a, 'm': list_prepend('user:', b2.m)}])
      FROM (SELECT k, i,
              list_min([{'c': s0.c + 2, 'a': 'D' || s0.a, 'm': s0.m}, {'c': CASE WHEN stays AND r = 's' THEN s1.c + e ELSE 1000000 END, 'a': 'K' || s1.a, 'm': list_prepend(own, s1.m)},
                        {'c': CASE WHEN stays AND r = 'u' THEN s2.c + e ELSE 1000000 END, 'a': 'K' || s2.a, 'm': list_prepend(own, s2.m)}, {'c': CASE WHEN stays THEN s2.c + e + 1 ELSE 1000000 END, 'a': 'R' || s2.a, 'm': list_prepend('user:' || text, s2.m)}]) AS b0,
              list_min([{'c': s1.c + 2, 'a': 'D' || s1.a, 'm': s1.m}, {'c': CASE WHEN stays AND r = 'u' THEN s2.c + e ELSE 1000000 END, 'a': 'K' || s2.a, 'm': list_prepend(own, s2.m)},
                        {'c': CASE WHEN stays THEN s2.c + e + 1 ELSE 1000000 END, 'a': 'R' || s2.a, 'm': list_prepend('user:' || text, s2.m)}]) AS b1,
              list_min([{'c': s2.c + 2, 'a': 'D' || s2.a, 'm': s2.m}, {'c': CASE WHEN stays AND r = 'a' THEN s3.c + e ELSE 1000000 END, 'a': 'K' || s3.a, 'm': list_prepend(own, s3.m)},
                        {'c': CASE WHEN stays THEN s3.c + e + 1 ELSE 1000000 END, 'a': 'R' || s3.a, 'm': list_prepend('assistant:' || text, s3.m)}]) AS b2,
              list_min([{'c': s3.c + 2, 'a': 'D' || s3.a, 'm': s3.m}, {'c': CASE WHEN stays AND r = 'u' THEN s2.c + e ELSE 1000000 END, 'a': 'K' || s2.a, 'm': list_prepend(own, s2.m)},
                        {'c': CASE WHEN stays THEN s2.c + e + 1 ELSE 1000000 END, 'a': 'R' || s2.a, 'm': list_prepend('user:' || text, s2.m)}]) AS b3
            FROM (SELECT w.k, f.i, s0, s1, s2, s3, r, text, role || ':' || text AS own, fault NOT IN (1, 2) AS stays, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS e
                  FROM w JOIN f ON f.k = w.k AND f.i = w.i - 1)))
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.m, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM o) LEFT JOIN t USING (k) LEFT JOIN (SELECT k, s0 FROM w WHERE i = 1) USING (k)
"""
}
QUERIES = {"op11_conversation_repair": op11_conversation_repair}
