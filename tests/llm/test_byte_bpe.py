import hashlib
import itertools

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = byte_bpe.Codec(PATH, 1000)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


TEXTS = ["", " ", "  ", "a", "don't  stop 'sabc 's's ''s x's!'s", "a\n\n b\n 's", "'ll've're'd'm't 'LL'", "12ab３²½ x_y", "tab\t\tx \xa0 y  ", "été ñandú 漢字かな 👩‍👩‍👧 é", "<|endoftext|>", "a" * 5000, "ab'" * 300, "é " * 3000, "' 're ''re", "x' s 's", " \n's"]


def test_examples(library):
    assert [list(x) for x in CODEC.encode(TEXTS)] == [library.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" '\n\tsrevlmdt1aé_-\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
def test_random(texts):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})
    got = list(CODEC.encode(texts))
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(x, CODEC.offsets(x)) for x in got] == [t.encode() for t in texts]


def test_frames(spark):
    rows = [(1, None, 5), (1, "a b", 6), (None, "x", None), (3, "le été " * 9000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = byte_bpe.encode(df, PATH)
    assert sorted((len(r.ids), (r.ends or [0])[-1]) for r in out.collect())[0] == (0, 0)
    back = byte_bpe.decode(out, PATH)
    assert sorted(bytes(r.data) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in rows)
    assert byte_bpe.round_trip(df.limit(0), PATH).count() == 0


def test_merging_of_many(library):
    words = ["".join(c) for n in range(1, 5) for c in itertools.product("abé ", repeat=n)] + ["a" * 64, "x" * 65, "antidisestablishmentarianism", "ß" * 20]
    slices = [w.encode() for w in words]
    flat, sizes = CODEC.merged(pa.array(slices, pa.binary()))
    ends = np.cumsum(sizes).tolist()
    for s, a, b in zip(slices, [0, *ends], ends, strict=False):
        assert flat[a:b].tolist() == library.encode_ordinary(s.decode()) or b" " in s
        assert tuple(flat[a:b].tolist()) == byte_bpe.merged(s, CODEC.ranks)


def test_query_equals_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))


def test_query_columns_of_odd_tables(spark, library):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "", "y", 2), (2, "don't é " * 60000, "z", 3), (3, " ", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = sorted((str(r.doc_id), r.n_tokens) for r in byte_bpe.round_trip(df, PATH).collect())
    assert got == sorted((str(i), len(library.encode_ordinary(t or ""))) for i, t, *_ in rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(df, PATH).filter("n_tokens = 0").collect()} == {(empty, empty)}
    assert byte_bpe.decode(spark.createDataFrame([(1, None), (1, None), (None, [])], "doc_id long, ids array<int>"), PATH).filter("length(data) = 0").count() == 3
