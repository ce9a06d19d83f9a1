import random

import public_tokenizers as P
import sentencepiece

from kgloom.llm import token_counts as tc

PATH = P.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    counts = tc.UnitCounts(PATH, 50000)
    assert counts.apart
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    random.seed(5)
    letters = "abcTHE ▁ \n\té漢<s></s><unk>  .,'　\x00" + "👩‍🚀"
    texts = ["", " ", "  ", "a ", " a", "▁", "<s> x </s>", "x" * 20000, "a  b   c", "\n\n", " ▁ "] + ["".join(random.choice(letters) for _ in range(random.randint(1, 60))) for _ in range(3000)]
    assert [counts.count(t) for t in texts] == [len(x) for x in model.encode(texts)]
    small = tc.UnitCounts(PATH, 31500)
    assert [small.count(t) for t in texts] == [len(x) for x in model.encode(texts)]


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "é"), (4, "word " * 5000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted(str((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096)) for i, t in rows)
    assert sorted(str(tuple(r)) for r in tc.token_counts(df, PATH).collect()) == want
    assert tc.token_counts(df.limit(0), PATH).count() == 0


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = {r.doc_id: len(model.encode(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in tc.op10_token_counts(spark, d).collect()} == want
