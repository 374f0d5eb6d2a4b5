"""Encoding: equal to the library's encoder, streaming equal to whole, exact round trip."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(library, text):
    enc = tokens.encoder()
    ids = enc.encode(text)
    assert ids == library(text)
    assert enc.decode(ids) == text


@pytest.mark.parametrize("alphabet", ["ab", "thein", "=-#", "äöüß", "一二三", " ", "\n ", "x", "0123456789", "\U0001f525\u0301"])
def test_long_pieces(library, alphabet):
    rng, enc = random.Random(alphabet), tokens.encoder()
    for n in (60, 255, 900, 5000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert enc.encode(text) == library(text)


def test_merger_forgets_what_is_final():
    rng, m = random.Random(2), tokens.Merger(tokens.encoder())
    ids, most = [], 0
    for _ in range(200):
        ids += m.push("".join(rng.choice("thein") for _ in range(100)).encode())
        most = max(most, len(m.window))
    assert most <= 8 * tokens.encoder().lookahead and len(ids) > 5000


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n'lstrevm.a1é=", max_size=60), st.integers(1, 7), st.integers(1, 6))
def test_chunks_are_encoded_as_the_whole(library, text, n, long):
    keep, tokens.LONG = tokens.LONG, long
    try:
        chunks = [text[i : i + n] for i in range(0, len(text), n)]
        assert [i for ids in tokens.encoder().stream(chunks) for i in ids] == library(text)
    finally:
        tokens.LONG = keep


def test_texts_longer_than_a_chunk(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    text = "they'll see   it\n\n" * 40 + "z" * 700 + " " * 300 + "end" + "\t" * 200
    assert tokens.encoder().encode(text) == library(text)


def test_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    enc = tokens.Encoder(tokens.encoder().ranks)
    text = "one two three four five six " * 5
    assert enc.encode(text) == library(text) and len(enc) <= 3


def test_table(spark, library):
    df = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, ""), (3, None), (3, None), (None, "x"), (4, "\r\n\t ")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids)) for r in tokens.encode(df).collect()), key=str)
    want = sorted(((i, library(t) if t else []) for i, t in [(1, "a <|endoftext|> b"), (2, ""), (3, None), (3, None), (None, "x"), (4, "\r\n\t ")]), key=str)
    assert got == want
    assert {r.doc_id: r.tokens for r in tokens.token_counts(df).collect()}[2] == 0
    assert all(r.digest == hashlib.md5((dict([(1, "a <|endoftext|> b"), (None, "x"), (4, "\r\n\t ")]).get(r.doc_id, "")).encode()).hexdigest() for r in tokens.round_trip(df).collect())
    assert tokens.encode(df.limit(0)).count() == 0
