import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from archgraph.llm import text, tokens

CASES = (("byte_bpe_50k.json", tokens.byte_level_cuts), ("word_bpe_49k.json", tokens.word_level_cuts))
ALPHABET = st.text(alphabet="ab Zé ß'.,-\n\t12 　…́Σ日😀\x1f\u0085|ÀÑ", max_size=40)
WORDS = st.lists(st.sampled_from(["the", "it's", "Straße", "x", "12", "...", "—", "é", " ", "\n"]), max_size=12).map(" ".join)


@pytest.mark.parametrize("name, cuts", CASES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(ALPHABET, WORDS, st.text(max_size=20)), max_size=6))
def test_ids_are_those_of_the_library(name, cuts, texts):
    encoder = tokens.Encoder.of(path(name), cuts)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    found = [(first, ids, counts) for first, ids, counts in encoder.encode(pa.array([*texts, None], pa.string()))]
    ids = np.concatenate([x[1] for x in found])
    counts = np.concatenate([x[2] for x in found])
    ends = np.cumsum(counts)
    for value, begin, end in zip([*texts, ""], ends - counts, ends):
        assert ids[begin:end].tolist() == encoder.tokenizer.encode(value, add_special_tokens=False).ids


def test_pieces_are_forgotten_at_the_bound_without_effect(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_PIECES", 3)
    monkeypatch.setattr(tokens, "TOKEN_SLICE_BYTES", 20)
    encoder = tokens.Encoder(path("byte_bpe_50k.json"), tokens.byte_level_cuts)
    texts = [f"one two three {i} four five six" for i in range(20)]
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = np.concatenate([ids for _, ids, _ in encoder.encode(pa.array(texts))]).tolist()
    assert got == [i for t in texts for i in plain.encode(t, add_special_tokens=False).ids]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \nZ", max_size=12), min_size=1, max_size=6))
def test_spans_and_hashes_follow_words(texts):
    for _, data, offsets in text.text_slices(pa.array(texts)):
        start, end, row = text.spans(data, offsets, text.NOT_BLANK)
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(start, end)]
        assert words == [w for t in texts for w in t.split()]
        assert row.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
        hashes = text.hash_spans(data, start, end).tolist()
        assert len(set(hashes)) == len(set(words)) == len(set(zip(words, hashes)))


def test_shingles_of_short_rows_are_the_whole_sequence():
    hashes = np.arange(1, 8, dtype=np.uint64)
    out, number = text.shingles(hashes, np.array([0, 1, 2, 4]), 3)
    assert number.tolist() == [0, 1, 1, 2]
    again, _ = text.shingles(hashes[3:7], np.array([4]), 3)
    assert out[2:].tolist() == again.tolist()
    assert zlib.crc32(out.tobytes()) == zlib.crc32(text.shingles(hashes, np.array([0, 1, 2, 4]), 3)[0].tobytes())


def test_long_texts_are_a_slice_of_their_own():
    slices = list(text.text_slices(pa.array(["a" * 10, "b" * 100, None, "c"]), most=16))
    assert [first for first, _, _ in slices] == [0, 1, 2]
    assert [len(d) for _, d, _ in slices] == [10, 100, 1]
