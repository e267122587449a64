"""Counts, encoding and decoding against the tokenizers library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laurel.llm import bpe, registry, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    counter, encoder = token_counts.counter(PATH), bpe.encoder(PATH)
    assert counter.count(texts) == [len(ids(t)) for t in texts]
    for t in texts:
        got = encoder.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids(t)
        assert encoder.decode(got) == LIBRARY.decode(ids(t), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "x<|endoftext|><|endoftext|> y", " \x1c\x85\u2028a", "\u3000\u3042" * 300, "don't we'll 'S"])
def test_hard_texts(text):
    assert token_counts.counter(PATH).count([text]) == [len(ids(text))]
    assert np.frombuffer(bpe.encoder(PATH).encode(text), "<u4").tolist() == ids(text)


def test_broken_ids_decode_like_the_library():
    some = [220, 128, 254, 50256, 97]
    assert bpe.encoder(PATH).decode(np.array(some, "<u4").tobytes()) == LIBRARY.decode(some, skip_special_tokens=False)


def test_odd_documents(spark, odd, nothing):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), len(ids(r.text or ""))) for r in rows)
    assert sorted(map(tuple, token_counts.count_tokens(odd, PATH).collect())) == want
    encoded = bpe.encode(odd, PATH, decoded=True).collect()
    assert sorted((r.doc_id, r.decoded) for r in encoded) == sorted((r.doc_id, r.text or "") for r in rows)
    assert token_counts.count_tokens(nothing, PATH).count() == 0 and bpe.encode(nothing, PATH).count() == 0
    again = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in again.collect()) == sorted((r.doc_id, r.text or "") for r in rows)


def test_queries_over_whole_tables(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in registry.op2_token_counts(spark, sf).collect():
        n = len(ids(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    rows = registry.op3_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = np.array(ids(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(found) // 4, hashlib.sha256(found).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
