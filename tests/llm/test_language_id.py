import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.llm import common
from kgloom.llm import language_id as li

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    return li.fit(docs.filter("doc_id % 2 = 0"))


def test_held_out(spark, model):
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("doc_id % 2 = 1")
    out = li.documents_language(docs, model)
    assert set(docs.columns) < set(out.columns)
    n, right, text, kept = out.agg(F.count("*"), F.count_if(F.expr("language = lang")), F.count_if(F.expr("language_by_text = lang")), F.count_if("language_accepted")).first()
    assert n == docs.count() and right > 0.97 * n and text > 0.95 * n and kept > 0.97 * n


def test_edges(spark, model):
    rows = [(1, None, None, None), (2, "", "en", "h"), (3, " \n", "xx", None), (4, "漢字かな交じり文" * 40, "en", "h"), (5, "the and of that is " * 30, None, None), (5, "the and of that is " * 30, "zz", "h"), (6, "der die und das ist nicht " * 4000, "de-AT", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("language", F.lit(7))
    got = sorted((r.doc_id, r.language, r.language_accepted) for r in li.documents_language(df, model).collect())
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "und", False), (5, "en", True), (5, "en", True), (6, "de", True)]
    assert li.documents_language(df.limit(0), model).count() == 0
    none = li.fit(df.limit(0))
    assert [r.language for r in li.documents_language(df, none).collect()] == ["und"] * 7


def brute(rows, model, least):
    """(language, probability) for rows (text, declared, host, suffix): each recounted over all other rows."""
    k, names = len(model.languages), model.languages

    def mean(text):
        if not text or text.isspace():
            return 0, None
        t = " " + text.lower() + " "
        b = [int(v) for part in li.buckets(text) for v in part]
        assert len(b) == len(t) - 2
        return len(b), [sum(float(model.table[x, j]) for x in b) / len(b) for j in range(k)]

    means = [mean(r[0]) for r in rows]

    def vote(n, m):
        top = max(range(k), key=lambda j: (m[j], -j)) if n else None
        return top if n and m[top] >= model.floor[top] else None

    votes = [vote(n, m) for n, m in means]
    known = [None if d is None else d.split("-")[0].strip().lower() if d.split("-")[0].strip().lower() in names else "und" for _, d, _, _ in rows]
    out = []
    for i, ((n, m), (_, _, host, suffix)) in enumerate(zip(means, rows, strict=True)):
        if not n:
            out.append(("und", 0.0))
            continue
        others = [(votes[j], known[j], rows[j][2], rows[j][3]) for j in range(len(rows)) if j != i and votes[j] is not None]
        count = lambda **w: [sum(v == j and all({"d": d, "h": h, "s": x}[a] == b for a, b in w.items()) for v, d, h, x in others) for j in range(k)]  # noqa: B023, E731
        c = count()
        prior = [(x + 1) / (sum(c) + k) for x in c]
        for level in ([count(s=suffix)] if suffix else []) + ([count(h=host)] if host else []):
            prior = [(x + li.LEAN * p) / (sum(level) + li.LEAN) for x, p in zip(level, prior, strict=True)]
        score = [m[j] * n * model.temperature + math.log(prior[j]) for j in range(k)]
        if known[i] is not None:
            declared = [(v, d) for v, d, _, _ in others if d is not None]
            share = (sum(d == known[i] for _, d in declared) + 1) / (len(declared) + k + 1)
            for j in range(k):
                score[j] += math.log((sum(v == j and d == known[i] for v, d in declared) + li.LEAN * share) / (sum(v == j for v, _ in declared) + li.LEAN))
        e = [math.exp(x - max(score)) for x in score]
        best = max(range(k), key=lambda j: (e[j], -j))
        p = e[best] / sum(e)
        ok = m[best] >= model.floor[best] and p >= least
        out.append((names[best] if ok else "und", p if m[best] >= model.floor[best] else 0.0))
    return out


def test_fusion_equals_brute_force(spark, model):
    random.seed(3)
    words = {"de": "der die und das ist nicht von mit".split(), "en": "the and of that is with by on".split(), "es": "que de la los una por con para".split(), "fr": "le les des une dans pour est que".split()}
    rows = []
    for i in range(160):
        lang = random.choice(list(words))
        text = " ".join(random.choices(words[lang], k=random.choice([1, 2, 5, 60]))) if i % 12 else random.choice([None, "", " ", "漢字かな" * 9])
        rows.append((text, random.choice([lang, lang, lang + "-XX", "zz", None]), random.choice(["h" + lang, "h", None]), random.choice([lang, "com", None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, host string, suffix string")
    for keep in (None, ["doc_id"]):
        got = sorted(li.language_id(df, model, F.col("text"), F.col("lang"), F.col("host"), F.col("suffix"), keep=keep).select("doc_id", "language", "language_probability").collect())
        for g, w in zip(got, brute(rows, model, 0.5), strict=True):
            assert g[1] == w[0] and abs(g[2] - w[1]) < 1e-6, (g, w)


def test_prior_decides_where_text_is_silent(spark):
    """A text that two languages are alike likely for: the host's other rows tip the balance, and the row's own vote doesn't."""
    counts = np.ones((2, li.BUCKETS))
    for k, t in enumerate(["der die und", "the and of"]):
        counts[k] += 50 * np.bincount(next(li.buckets(t)), minlength=li.BUCKETS)
    both = np.bincount(next(li.buckets("in")), minlength=li.BUCKETS) * 40
    counts[1, int(np.flatnonzero((counts + both).max(axis=0) == 1)[0])] += counts[0].sum() - counts[1].sum()
    model = li.TextModel(["de", "en"], counts + both)
    rows = [(i, "der die und", "hde") for i in range(60)] + [(i, "the and of", "hen") for i in range(60)] + [(900, "in", "hde"), (901, "in", "hen"), (902, "in", "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: (r.language, r.language_probability) for r in li.language_id(df, model, F.col("text"), host=F.col("source"), least=0.0).filter("doc_id >= 900").collect()}
    assert out[900][0] == "de" and out[901][0] == "en" and min(out[900][1], out[901][1]) > 0.85
    assert abs(out[902][1] - 0.5) < 0.02


def test_very_long_text(spark, model):
    text = "der hund und die katze sind nicht im haus " * 40000
    n, m = model.means(pa.array([text]))
    assert n[0] == len(text) and np.allclose(m[0], model.means(pa.array([text[: 42 * 3000]]))[1][0], atol=1e-3)


def test_few_labels_among_many_rows(spark):
    """Ten and 1,000 labelled rows among 400,000: all ten are fitted on, the language is known and nothing is lost."""
    df = spark.range(400_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the house is large and the garden small "), F.col("id") % 97).alias("text"), F.when(F.col("id") < 10, "en").alias("lang"), F.lit(None).cast("string").alias("source"))
    fitted = li.fit(df)
    assert fitted.languages == ["en"]
    assert li.documents_language(df, fitted).filter("language_accepted").count() == 400_000
    few = df.filter("lang is not null").select("doc_id", F.col("text"))
    assert common.bounded_sample(few, 1000, "doc_id").count() == 10
    many = df.filter("doc_id < 1000").select("doc_id", "text")
    assert common.bounded_sample(many, 2000, "doc_id").count() == 1000
    assert common.bounded_sample(df.filter("doc_id % 400 = 0").select("doc_id", "text"), 200, "doc_id").count() == 200
    assert common.bounded_sample(df.select("doc_id"), 1, "doc_id").count() == 1


def test_pages(spark):
    out = li.op7_language_id(spark, D)
    pages = spark.read.parquet(f"{D}/pages.parquet")
    assert out.count() == pages.count()
    said = pages.select("page_id", F.regexp_extract("html", 'lang="(..)"', 1).alias("said"))
    n, same = out.join(said, "page_id").agg(F.count("*"), F.count_if(F.expr("language = said"))).first()
    assert same > 0.9 * n


def test_rare_languages(spark):
    """Languages of 4 rows in 40,000 each are fitted, and their texts accepted."""
    rare = {"el": "το σπίτι είναι μεγάλο και ο κήπος μικρός ", "ru": "дом большой а сад маленький и тихий ", "he": "הבית גדול והגן קטן ושקט מאוד ", "ka": "სახლი დიდია და ბაღი პატარა ", "hy": "տունը մեծ է իսկ այգին փոքր "}
    common = spark.range(40000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the house is large and the garden small "), F.col("id")).alias("text"), F.lit("en-GB").alias("lang"))
    rows = [(100000 + i, t * 20, k) for i, (k, t) in enumerate((k, t) for k, t in rare.items() for _ in range(4))]
    few = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = li.fit(common.union(few))
    assert fitted.languages == sorted([*rare, "en"])
    out = li.documents_language(few.withColumn("source", F.lit(None).cast("string")), fitted).collect()
    assert len(out) == 20 and all(r.language_accepted and r.language == r.lang for r in out)


def test_labels_of_no_language(spark, model):
    """Texts labelled und, mul, mis or zxx are judged by the rest of the evidence: none is lost and nothing is NaN."""
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("doc_id % 5 = 1")
    codes = F.array(*map(F.lit, ["und", "mul", "mis", "zxx", "und-Latn", "UND"]))
    half = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.get(codes, (F.col("doc_id") % 6).cast("int"))).otherwise(F.col("lang")))
    assert set(li.fit(half).languages) == set(model.languages)
    want = {r.doc_id: (r.language, r.language_accepted) for r in li.documents_language(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, F.col("lang"))), model).collect()}
    got = li.documents_language(half, model).collect()
    assert {r.doc_id: (r.language, r.language_accepted) for r in got} == want
    assert not any(math.isnan(r.language_probability) for r in got)
    assert sum(r.language_accepted for r in got) > 0.97 * len(got)


def test_pages_against_recount(spark, model):
    """Host, suffix, declared language and markup of pages, recomputed in Python."""
    import html as h
    import re

    pages = spark.read.parquet(f"{D}/pages.parquet").limit(60).collect()
    rows = [(r.page_id, r.url, r.html) for r in pages] + [(900, "https://u@Ex.DE:80/x", "<html lang='und'><p>der die das und ist nicht &uuml;ber " * 9), (901, None, "<HTML class=a LANG=en-GB><script>x</script>the and of that is with " * 9), (902, "nohost", None)]
    ready = []
    for _, url, page in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", url or "")
        host = m[1].strip().lower() if m else None
        s = re.match(r".*\.([A-Za-z]+)$", host or "")
        d = re.search(r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]{2,3})", page or "")
        text = None if page is None else h.unescape(re.sub(r"\s+", " ", re.sub(r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ", page)).strip(" "))
        declared = d[1].lower() if d and d[1].lower() not in li.NO_LANGUAGE else None
        ready.append((text, declared, host, s[1] if s else None))
    want = brute(ready, model, 0.5)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.language, r.language_probability) for r in li.pages_language(df, model).collect()}
    for (page_id, *_), (language, probability) in zip(rows, want, strict=True):
        assert got[page_id][0] == language and got[page_id][1] == pytest.approx(probability, abs=1e-9), page_id
