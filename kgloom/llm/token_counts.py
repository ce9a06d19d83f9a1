"""Token counts by the whole-token shortcut.

When the vocabulary is loaded, every vocabulary string is encoded once alone; those that give one token are the whole
tokens. It is also proved there that no vocabulary string holds a space after another character, so a text falls into
units of spaces and the following other characters, which no merge can cross. A unit that is a whole token counts one
without merging; only the rest is merged, and the counts of units met before are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from kgloom.llm.common import plain, table

SPACE = "▁"
_UNITS = re.compile(" +[^ ]+| +")
_LONG = 64


class UnitCounts(dict):
    """Unit without its first space -> number of tokens."""

    def __init__(self, path: str, size: int) -> None:
        import sentencepiece

        self.model, self.size = sentencepiece.SentencePieceProcessor(model_file=path), size
        m = self.model
        kinds = range(m.get_piece_size())
        plain_ids = [i for i in kinds if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        pieces = {i: m.id_to_piece(i) for i in plain_ids}
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces.values())
        self.apart &= m.encode("a") == m.encode_as_ids("a") and m.encode_as_pieces("  a ")[0].startswith(SPACE) and "".join(m.encode_as_pieces(" a  b ")) == f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}"
        names = {i: p[1:].replace(SPACE, " ") for i, p in pieces.items() if p[0] == SPACE and len(p) > 1}
        self.whole = {s: 1 for (i, s), got in zip(names.items(), m.encode(list(names.values())), strict=True) if got == [i]}
        # A single space at the end of a text is the unit that can't be asked for alone.
        self.whole[""] = len(m.encode("a ")) - len(m.encode("a"))
        self.update(self.whole)

    def __missing__(self, unit: str) -> int:
        n = len(self.model.encode(unit))
        if len(unit) <= _LONG:
            if len(self) >= self.size:
                self.clear()
                self.update(self.whole)
            self[unit] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.apart:
            return len(self.model.encode(text))
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return sum(self[u[1:]] for u in _UNITS.findall(" " + text))
        return sum(map(self.__getitem__, text.split(" ")))


_LOADED: dict[tuple[str, int], UnitCounts] = {}


def unit_counts(path: str, size: int) -> UnitCounts:
    """One table for each Python worker."""
    if (path, size) not in _LOADED:
        _LOADED[path, size] = UnitCounts(path, size)
    return _LOADED[path, size]


def _counting(path: str, limit: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = unit_counts(path, size)
        for b in batches:
            texts = b.column("text")
            n = [counts.count(t.as_py()) for t in texts]
            octets = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), octets, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", table_size: int = 200_000) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The counts are those of the sentencepiece model at ``path`` without begin or end tokens; strings of special tokens
    inside a text are ordinary text. Null texts count as empty: no bytes, no tokens. Texts are counted whole,
    however long. Null and repeated ids are passed through; an empty table gives an empty result; other columns are ignored. ``table_size`` bounds the kept units.
    """
    rows = plain(df, doc_id=id_col, text=text_col)
    return rows.mapInArrow(_counting(path, limit, table_size), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


SQL: dict[str, str] = {}
QUERIES = {"op10_token_counts": op10_token_counts}
