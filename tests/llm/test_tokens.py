"""p8: encoding and decoding."""

import os

import pytest

from skarv.llm.tokens import TOKENIZERS, decode_corpus, encode, encode_corpus, encoding, parts

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")

TEXTS = [None, "", " ", "Hei på deg!", "a\n\n  b\t c", "<|endoftext|>", "x\x01y\x07", "é́ 👩‍👩‍👧 ​﻿", "it's we'll 12345 ...", "a" * 5000]


def test_same_as_the_library_and_back(spark):
    enc = encoding(PATH)
    df = spark.createDataFrame([(i, t, [7], "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>, k string")
    got = encode_corpus(df)
    assert got.columns == ["doc_id", "ids"]
    ids = {r.doc_id: list(r.ids) for r in got.collect()}
    assert ids == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in decode_corpus(got).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    enc = encoding(PATH)
    for t in TEXTS:
        if t and len(t) < 1000:
            assert encode(t, enc).tolist() == other.encode(t, add_special_tokens=False).ids


def test_long_texts_are_cut_at_safe_places():
    enc = encoding(PATH)
    text = ("Tekst med  doble mellomrom\n\nog linjer, 12 tall's. " * 400) + "æ" * 700 + " \n  slutt "
    for size in (1, 7, 50, 1000):
        cut = list(parts(text, size))
        assert "".join(cut) == text
        assert [i for p in cut for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    long = text * 12
    assert encode(long, enc).tolist() == enc.encode_ordinary(long)


def test_empty_table(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
