"""Language identification by Bayesian evidence fusion.

Evidence on each row: the text's likelihood under each language (character trigrams, hashed into buckets; since neighbouring
trigrams repeat each other, it is scaled by a temperature fitted on labelled rows held out of the fit); the declared
language, through the grouped confusion of declared language and language by text; and a prior of the host, smoothed
towards its address suffix's, which is smoothed towards the corpus's. A row's own vote is taken out of all three levels and
of the confusion before they are applied to it. All counts are grouped aggregations over the whole table; what the driver
sees is the trigram table (languages x buckets) and the confusion (languages x languages). Counts of hosts and suffixes
stay tables that are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import plain, staged, table

BUCKETS = 1 << 14
#: Pseudo-counts by which a level leans on the level above.
LEAN = 20.0
#: What the temperature is chosen from: the share of a text's trigrams that count as independent.
TEMPERATURES = tuple(2.0**-k for k in range(11))
UNKNOWN = "und"
#: Labels that are no two- or three-letter code aren't languages; so there are 18,252 languages at most.
_CODE = "^[a-z]{2,3}$"
#: Codes of no language (undetermined, several, uncoded, no linguistic content). They are neither fitted nor evidence.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
_BLOCK = 1 << 18


def buckets(text: str) -> Iterator[np.ndarray]:
    """The hashed trigrams of a text, lower-cased and closed by blanks, some 260,000 at a time."""
    text = f" {text.lower()} "
    for at in range(0, len(text) - 2, _BLOCK):
        c = np.frombuffer(text[at : at + _BLOCK + 2].encode("utf-32-le", "replace"), np.uint32)
        x = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        yield x >> np.uint32(18)


class TextModel:
    """Log-likelihoods of trigram buckets for each language, how low a mean is still of the language, and the temperature."""

    def __init__(self, languages: list[str], counts: np.ndarray, temperature: float = 1.0) -> None:
        self.languages, self.temperature = languages, temperature
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        self.table = np.log(p).T.astype(np.float32).copy()
        own = (p * np.log(p)).sum(axis=1)
        # Half-way between what the language's own texts score on average and what evenly spread trigrams score.
        self.floor = (own + np.log(p).mean(axis=1)) / 2

    def means(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's trigrams (0: nothing but blanks), and their mean log-likelihoods."""
        n, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        for i, value in enumerate(texts):
            text = value.as_py()
            if text and not text.isspace():
                for b in buckets(text):
                    out[i] += self.table[b].sum(axis=0, dtype=np.float64)
                    n[i] += len(b)
                out[i] /= n[i]
        return n, out

    def votes(self, n: np.ndarray, means: np.ndarray) -> np.ndarray:
        """The place of the language that the text alone speaks for; -1 where it is below the language's floor."""
        top = means.argmax(axis=1)
        return np.where((n > 0) & (means[np.arange(len(top)), top] >= self.floor[top]), top, -1)


def fit(labelled: DataFrame, languages: tuple[str, ...] | None = None, sample_rows: int = 2000) -> TextModel:
    """From rows (doc_id, text, lang): about ``sample_rows`` labelled rows of each language (all, where it has fewer), the same whatever the order of rows.

    Languages are counted over all labelled rows; labels count by their first subtag, lower-cased, and only two- or
    three-letter ones that name a language (not ``NO_LANGUAGE``). Only the fit of each language uses a sample; of those rows a quarter is held out and chooses the
    temperature. Null or empty texts and labels are left out; an empty table gives a model without languages.
    """
    rows = labelled.select("doc_id", "text", F.lower(F.substring_index(F.trim("lang"), "-", 1)).alias("lang")).filter((F.col("text") != "") & F.col("lang").rlike(_CODE) & ~F.col("lang").isin(*NO_LANGUAGE))
    if languages:
        rows = rows.filter(F.col("lang").isin(*languages))
    # A row is taken by its own hash, so nothing is ranked; the least hash is always taken, so no language comes out empty.
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text", "lang"), F.lit(1 << 40)))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least"))
    taken = rows.join(F.broadcast(counts), "lang").filter((F.col("h") == F.col("least")) | (F.col("h") / F.lit(1 << 40) < F.lit(sample_rows) / F.col("n")))
    sample = staged(taken.select("text", "lang", ((F.xxhash64("h") % 4 == 0) & (F.col("h") != F.col("least"))).alias("held")))

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in buckets(text.as_py()):
                    total[lang] += np.bincount(part, minlength=BUCKETS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "bucket", "n"])

    grouped = sample.filter("not held").mapInArrow(counting, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per: dict[str, np.ndarray] = {}
    for r in grouped.toLocalIterator():
        per.setdefault(r["lang"], np.zeros(BUCKETS))[r["bucket"]] = r["n"]
    names = sorted(per)
    if not names:
        return TextModel([], np.zeros((0, BUCKETS)))
    model = TextModel(names, np.stack([per[k] for k in names]))

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(names)}
        for b in batches:
            n, m = model.means(b.column("text"))
            true = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            some = np.flatnonzero(n)
            for k, t in enumerate(TEMPERATURES):
                e = m[some] * (n[some] * t)[:, None]
                e -= e.max(axis=1, keepdims=True)
                loss = np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(some)), true[some]]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([float(loss.sum())])], ["k", "loss"])

    # Sums are compared to nine digits, so the order in which parts are added doesn't matter.
    total = sample.filter("held").mapInArrow(losses, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
    best = min(((float(f"{r['loss']:.9g}"), r["k"]) for r in total), default=(0.0, TEMPERATURES.index(0.125)))
    model.temperature = TEMPERATURES[best[1]]
    return model


def fuse(model: TextModel, n: np.ndarray, means: np.ndarray, declared: np.ndarray, host: np.ndarray, suffix: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the most probable language's place and the probabilities of all.

    ``table_`` counts votes (rows: language by text; columns: declared language, then unknown declared ones, then none);
    ``host`` and ``suffix`` hold the votes of each row's host and suffix (zeros without one). The row's own vote is in all
    of them and is taken out first.
    """
    k = len(model.languages)
    votes = model.votes(n, means)
    one = np.zeros((len(n), k))
    voted = np.flatnonzero(votes >= 0)
    one[voted, votes[voted]] = 1
    total = table_.sum(axis=1) - one
    prior = (total + 1) / (total.sum(axis=1, keepdims=True) + k)
    for level in (suffix, host):
        c = np.maximum(level - one, 0)
        prior = (c + LEAN * prior) / (c.sum(axis=1, keepdims=True) + LEAN)
    # P(declared | language), smoothed towards how often the label is declared at all.
    said = declared <= k
    column = np.minimum(declared, k)
    own = one * said[:, None]
    of = table_[:, : k + 1]
    shares = (of.sum(axis=0)[column] - own.sum(axis=1) + 1) / (of.sum() - own.sum(axis=1) + k + 1)
    confusion = np.log((of[:, column].T - own + LEAN * shares[:, None]) / (of.sum(axis=1) - own + LEAN))
    e = means * (n * model.temperature)[:, None] + np.log(prior) + np.where(said[:, None], confusion, 0.0)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    return e.argmax(axis=1), e


_EVIDENCE = "struct<n: bigint, vote: int, means: array<double>>"
_DECISION = "struct<by_text: string, language: string, probability: double, accepted: boolean>"


def _evidence(model: TextModel, entities: bool) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        if entities:
            texts = pa.array([unescape(t) if t and "&" in t else t for t in texts.to_pylist()], pa.string())
        n, m = model.means(texts)
        means = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1)))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(model.votes(n, m), pa.int32()), means], ["n", "vote", "means"])

    return run


def _decision(model: TextModel, table_: np.ndarray, least: float) -> Callable[..., pa.Array]:
    place = {k: i for i, k in enumerate(model.languages)}
    k = len(place)

    def counts(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), k))
        some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        out[some] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return out

    def run(text: pa.Array, declared: pa.Array, host: pa.Array, suffix: pa.Array) -> pa.Array:
        if pa.types.is_struct(text.type):
            n, means = text.field("n").to_numpy(), text.field("means").flatten().to_numpy().reshape(-1, k)
        else:
            n, means = model.means(text)
        said = np.array([k + 1 if d is None else place.get(d, k) for d in declared.to_pylist()], np.int64)
        best, e = fuse(model, n, means, said, counts(host), counts(suffix), table_)
        row = np.arange(len(n))
        fits = (n > 0) & (means[row, best] >= model.floor[best]) if len(n) else np.zeros(0, bool)
        probability = np.where(fits, e[row, best], 0.0)
        accepted = fits & (probability >= least)
        names = np.array([*model.languages, UNKNOWN], object)
        by_text, language = names[np.where(n > 0, means.argmax(axis=1), k)], names[np.where(accepted, best, k)]
        return pa.StructArray.from_arrays([pa.array(by_text, pa.string()), pa.array(language, pa.string()), pa.array(probability), pa.array(accepted)], ["by_text", "language", "probability", "accepted"])

    return run


def _declared(code: Column) -> Column:
    return F.when(~code.isin(*NO_LANGUAGE) & (code != ""), code)


def language_id(df: DataFrame, model: TextModel, text: Column, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, keep: list[str] | None = None, least: float = 0.5, entities: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all) and language_by_text, language, language_probability, language_accepted.

    A row is accepted if its text scores above the language's floor and the fused probability is at least ``least``;
    otherwise its language is ``und`` (texts that are null, empty or blank always). Missing evidence (null declared language,
    host or suffix) leaves the other evidence, and so do declared codes of no language; unknown declared languages count together. Texts are read
    whole, however long. With ``entities`` character references (&eacute;) are read as their characters. Ties go to the language first in
    the alphabet. Repeated rows count each time. An empty table gives an empty result; with no fitted language all rows
    are rejected. Input columns named like the output are replaced.

    Where the columns ``keep`` are named, they are written once with each text's evidence, and the texts are read once;
    else the texts stay where they are and are scored twice.
    """
    out = ["language_by_text", "language", "language_probability", "language_accepted"]
    kept = [c for c in keep or df.columns if c not in out]
    null = F.lit(None).cast("string")
    shape = lambda c: F.lower(F.trim(c)) if c is not None else null
    rows = df.select(*(F.col(f"`{c}`") for c in kept), text.alias("__kg_text"), _declared(F.substring_index(shape(declared), "-", 1)).alias("__kg_declared"), shape(suffix).alias("__kg_suffix"), shape(host).alias("__kg_host"))
    k = len(model.languages)
    if not k:
        return rows.select(*(F.col(f"`{c}`") for c in kept), F.lit(UNKNOWN).alias(out[0]), F.lit(UNKNOWN).alias(out[1]), F.lit(0.0).alias(out[2]), F.lit(False).alias(out[3]))
    # Called nondeterministic, so that filters on what they give don't make Catalyst evaluate them twice.
    scored = F.arrow_udf(_evidence(model, entities), _EVIDENCE).asNondeterministic()
    evidence = scored(F.col("__kg_text"))
    if keep:
        rows = staged(rows.withColumn("__kg_text", evidence))
    votes = rows.select(*(f"__kg_{c}" for c in ("declared", "suffix", "host")), (F.col("__kg_text") if keep else evidence)["vote"].alias("vote")).filter("vote >= 0")
    known = F.when(F.col("__kg_declared").isin(*model.languages), F.col("__kg_declared")).when(F.col("__kg_declared").isNotNull(), F.lit(UNKNOWN))
    votes = votes.withColumn("__kg_declared", known)
    sums = lambda n: [F.sum(F.when(F.col("vote") == i, F.col("n"))).alias(f"c{i}") for i in range(k)]  # noqa: E731, ARG005
    array = lambda name: F.array(*(F.coalesce(f"c{i}", F.lit(0)).cast("double") for i in range(k))).alias(name)
    counts = staged(votes.groupBy("__kg_declared", "__kg_suffix", "__kg_host", "vote").agg(F.count(F.lit(1)).alias("n")))
    # Languages x languages.
    table_ = np.zeros((k, k + 2))
    place = {x: i for i, x in enumerate(model.languages)} | {UNKNOWN: k, None: k + 1}
    for r in counts.groupBy("__kg_declared", "vote").agg(F.sum("n").alias("n")).collect():
        table_[r["vote"], place[r["__kg_declared"]]] = r["n"]
    by_suffix = counts.filter("__kg_suffix is not null").groupBy("__kg_suffix").agg(*sums("n")).select("__kg_suffix", array("__kg_suffix_votes"))
    by_host = counts.filter("__kg_host is not null").groupBy("__kg_host").agg(*sums("n")).select("__kg_host", array("__kg_host_votes"))
    joined = rows.join(by_host, "__kg_host", "left").join(by_suffix, "__kg_suffix", "left")
    decide = F.arrow_udf(_decision(model, table_, least), _DECISION).asNondeterministic()
    decided = decide("__kg_text", "__kg_declared", "__kg_host_votes", "__kg_suffix_votes")
    done = joined.select(*(F.col(f"`{c}`") for c in kept), decided.alias("__kg"))
    return done.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"__kg.{f}").alias(n) for f, n in zip(("by_text", "language", "probability", "accepted"), out, strict=True)))


_MARKUP = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"


def pages_language(pages: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """page_id and the languages of pages (page_id, url, html): declared in the html tag, suffix and host from the address.

    Null pages have no text and are ``und``; a null or odd address gives no host and no suffix; page ids may be null or
    repeat. An empty table gives an empty result; other columns are ignored. Ties go as in ``language_id``.
    """
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    suffix = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?[^/:?#]*\.([A-Za-z]+)(?:[:/?#]|$)", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("html"), _MARKUP, " "), r"\s+", " "))
    return language_id(pages, model, text, F.when(declared != "", declared), host, F.when(suffix != "", suffix), keep=["page_id"], least=least, entities=True)


def documents_language(docs: DataFrame, model: TextModel, least: float = 0.5) -> DataFrame:
    """All columns of documents (text, lang, source among them) and the languages; the source stands for the host.

    Null, empty and blank texts are ``und``; null labels, labels of no language and null sources leave the other evidence. Ids play no part, so they may
    be null or repeat. An empty table gives an empty result. Ties go as in ``language_id``.
    """
    return language_id(docs, model, F.col("text"), F.col("lang"), F.col("source"), least=least)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit(plain(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang"))
    return pages_language(table(spark, sf_dir, "pages"), model)


SQL: dict[str, str] = {}
QUERIES = {"op7_language_id": op7_language_id}
