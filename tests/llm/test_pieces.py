import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import public_tokenizers
import sentencepiece

from panelcast.llm import pieces, queries

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
CODEC = pieces.PieceCodec.load()


def ours(text):
    return np.frombuffer(CODEC.encode(text), dtype="<i4").tolist()


@pytest.mark.parametrize("text", ["", " ", "  a b  ", "a\tb\n\r\n", "\0x", "▁x ▁▁", "<s> </s> <0x41>", "\U0001f600﻿\xa0", "aaaaaaaaaaaaaaaaaaaa" * 50,
                                  " " * 100, "1234567890 12", "éé", "你好世界" * 30, "the" * 400])
def test_cases_equal_the_library(text):
    assert ours(text) == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_equals_the_library(text):
    assert ours(text) == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcdehinorst -.é▁\n0", max_size=80))
def test_dense_alphabet_equals_the_library(text):
    assert ours(text) == LIBRARY.encode(text)


def test_joined_pieces_equal_the_library_whole_and_in_parts():
    rng = random.Random(3)
    names = sorted(CODEC.id)
    for _ in range(3000):
        text = "".join(rng.choice(names) for _ in range(rng.randint(1, 12))).replace("▁", rng.choice(["", " ", "▁"]))
        want = LIBRARY.encode(text)
        assert ours(text) == want
        whole = [CODEC.id[p] for p in CODEC.cover(CODEC.model.normalize(text))]  # the cut into parts changes nothing
        assert whole == want


def test_query_covers_whole_documents(spark):
    at = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.REGISTRY["op12_sentencepiece_codec"](spark, at).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{at}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids)))
    assert got == want


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "y"), (3, "a b", "y"), (3, "a b", "y"), (4, "word " * 200_000, None)]
    out = pieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    got = sorted(((r.doc_id, tuple(r.ids), r.decoded) for r in out.collect()), key=str)
    want = sorted(((d, tuple(LIBRARY.encode(t or "", add_eos=True)), LIBRARY.decode(LIBRARY.encode(t or ""))) for d, t, _ in rows), key=str)
    assert got == want
    empty = pieces.digests(pieces.encode_documents(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
