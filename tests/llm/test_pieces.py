"""Encoding and decoding by pieces, against the library."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import pieces
from tests.llm import cases as data

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = pieces.PieceCodec(PATH)
PARTS = [" ", "  ", "   ", "\n", "\t", "the", "re", "th", "xyzzy", "é", "日本", "▁", "　", "\x00", "\x1c",
         "<s>", "</s>", "<unk>", "<0x0A>", "😀", "é", "ﬁ", "0", "'", "aaaaaaa", "－"]


def ids_of(text):
    return LIBRARY.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS)).map("".join), st.text()))
def test_ids_and_text_equal_the_library(text):
    packed = CODEC.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids_of(text)
    assert CODEC.decode(packed) == LIBRARY.decode(ids_of(text))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 300), st.integers(0, 31_999), st.sampled_from([1, 2, 259, 28705]))))
def test_any_ids_decode_like_the_library(ids):
    assert CODEC.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["x" * 30_000, "the" * 20_000, " " * 5_000, "日" * 9_999 + " the " * 50_000])
def test_long_texts_stay_whole(text):
    assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ids_of(text)
    assert CODEC.decode(CODEC.encode(text)) == text


def test_results_do_not_depend_on_what_is_cached(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_UNITS", 3)
    monkeypatch.setattr(pieces, "CACHED_CHARS", 4)
    fresh = pieces.PieceCodec(PATH)
    for text in ["a long-winded text of words", "words of a longer kind", "a long-winded text of words"]:
        assert np.frombuffer(fresh.encode(text), "<u4").tolist() == ids_of(text)
        assert len(fresh._units) <= 3 and all(len(unit) <= 4 for unit in fresh._units.older)


def test_every_row_is_encoded_checked_and_decoded(spark):
    frame = data.frame(spark)
    encoded = pieces.encode(frame, PATH)
    got = Counter((r[0], r[1], hashlib.sha256(r[2]).hexdigest(), r[3], r[4]) for r in encoded.collect())
    want = Counter()
    for doc, text, *_ in data.rows():
        ids = ids_of(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[doc, len(ids), digest, LIBRARY.decode(ids), True] += 1
    assert got == want
    back = Counter((r[0], r[1]) for r in pieces.decode(encoded, PATH).collect())
    assert back == Counter((doc, text or "") for doc, text, *_ in data.rows())


def test_unchecked_empty_and_null(spark):
    assert pieces.encode(data.empty(spark), PATH).collect() == []
    (row,) = pieces.encode(spark.createDataFrame([(None, None)], "doc_id long, text string"), PATH, check=False).collect()
    assert tuple(row) == (None, 2, bytes([1, 0, 0, 0, 2, 0, 0, 0]), "", None)
    null = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [tuple(r) for r in pieces.decode(null, PATH).collect()] == [(1, None)]


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, text: text)
    with pytest.raises(ValueError):
        pieces.PieceCodec(PATH)
