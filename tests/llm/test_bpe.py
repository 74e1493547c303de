"""Operator 7 against the tokenizers library."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
from .conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobscope.llm import bpe
from jobscope.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.BpeCodec(bpe.load_vocabulary(PATH))


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert CODEC.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abcdeZ 'st\n\t.,!?09½²éÉÑß日Σσς\x1c\x85́İ<|>_-", "<|endoftext|>", "<|startoftext|>", " don't", "the "]),
                max_size=60).map("".join))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "ab" * 3000, "é" * 700, "x<|endoftext|>  y", "ΣΑΣ", "a" * 256, "a" * 257])
def test_special_texts(text):
    same(text)


def test_small_caches_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    for t in docs.text.head(20):
        same(t)


def test_query_equals_the_library(spark, docs):
    got = QUERIES["op7_bpe"](spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert tuple(got.loc[i]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                     hashlib.sha256(decoded.encode()).hexdigest())


def test_edge_cases(edge, empty):
    got = bpe.bpe_encode_decode(edge, PATH).toPandas()
    assert len(got) == edge.count() and all(x == b"" for x in got[got.doc_id.isin([1, 2, 3])].ids)
    assert bpe.digests(bpe.bpe_encode_decode(empty, PATH)).count() == 0
