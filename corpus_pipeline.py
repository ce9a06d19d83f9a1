"""A corpus pipeline: language identification, line deduplication, near-duplicate removal, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import staged, table
from kgloom.llm.language_id import documents_language, fit
from kgloom.llm.line_dedup import line_dedup
from kgloom.llm.near_dedup import near_dedup
from kgloom.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _beside(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` with the columns that aren't those of documents out of the way; they come back under their own names."""
    own = [c if c in COLUMNS else f"__kg_{i}" for i, c in enumerate(docs.columns)]
    done = stage(docs.toDF(*own))
    return done.select(*(F.col(f"`{a}`").alias(c) for a, c in zip(own, docs.columns, strict=True)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is of no language that the corpus's labels know.

    Null, empty and blank texts are of none. Without a labelled row there is no language to know, and all rows stay. Ids may
    be null or repeat: each row is judged by itself. All columns stay; an empty table gives an empty result.
    """
    model = fit(docs)
    return _beside(docs, lambda d: documents_language(d, model).filter("language_accepted")) if model.languages else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat across documents; n_chars follows the text.

    No row goes; a null text becomes empty. Of rows that repeat the largest id that holds a line all keep it; null ids lose
    against any. All columns stay; an empty table gives an empty result.
    """
    return _beside(docs, lambda d: line_dedup(d).withColumn("n_chars", F.char_length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, keeps the document with the smallest id.

    Texts without words are near nothing and stay, as do rows with a null id. Rows that repeat an id stay or go together.
    All columns stay; an empty table gives an empty result.
    """
    gone = near_dedup(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into token sequences.

    Every row is a document of its own, also where ids are null or repeat; a null or empty text is its closing id alone.
    An empty table gives an empty result.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained, hashed and packed stages have no SQL; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None
