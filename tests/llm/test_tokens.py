"""Byte-level BPE and token counts against the libraries."""

import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import bpe, tokencount

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


texts = st.text(alphabet=st.one_of(st.sampled_from("abcthe '\n\t\x1c\x85\xa0é一😀12½%<|endoftext|>ـ"), st.characters(exclude_categories=["Cs"])), max_size=120)
ENC, CNT = bpe.Encoder(bpe.ranks_from_tiktoken(RANKS), P.PATTERN), tokencount.Counts(JSON, P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_like_the_libraries(text):
    import tiktoken
    from tokenizers import Tokenizer

    if not hasattr(test_like_the_libraries, "libs"):
        test_like_the_libraries.libs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_from_tiktoken(RANKS), special_tokens={}), Tokenizer.from_file(JSON)
    tik, tok = test_like_the_libraries.libs
    ids = ENC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert ENC.decode(ids) == text.encode()
    assert CNT.count(text) == len(tok.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("word", ["a" * 5000, "ab" * 999, "é" * 700, " " * 300, "thethe" * 200])
def test_long_words_fold_alike(word, tik):
    assert np.frombuffer(ENC.encode(word), "<u4").tolist() == tik.encode_ordinary(word)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_queries_match(which, request, tik, tok):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len(i := tik.encode_ordinary(r.text or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    got = bpe.encode_decode(df, "doc_id", "text", RANKS, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in rows)
    got = tokencount.token_counts(df, "doc_id", "text", JSON, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_empty(empty):
    assert bpe.encode_decode(empty, "doc_id", "text", RANKS, P.PATTERN).collect() == []
    assert tokencount.token_counts(empty, "doc_id", "text", JSON, P.PATTERN).collect() == []


def test_higher_order_fold_and_round_trip(spark, tik):
    words = ["the", " the", "thing", "é", "", "aaaa", "x", None, " unbelievably"]
    ranks = {p: r for p, r in bpe.ranks_from_tiktoken(RANKS).items() if len(p) == 1 or any(p in w.encode() for w in words if w)}
    got = bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), "word", ranks).collect()
    for r in got:
        assert r.ids == (None if r.word is None else tik._encode_single_piece(r.word.encode()) if r.word else [])
    back = bpe.decode_ids(spark.createDataFrame([(w, tik.encode_ordinary(w) if w is not None else None) for w in words], "word string, ids array<int>"), "ids", "bytes", RANKS, P.PATTERN).collect()
    for r in back:
        assert (r.bytes is None) == (r.word is None) and (r.word is None or bytes(r.bytes).decode() == r.word)
