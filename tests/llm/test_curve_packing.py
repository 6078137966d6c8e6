import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from archgraph.llm import curve_packing
from archgraph.llm.curve_packing import hilbert_keys, pack_along_curve, sequence_starts

VOCABULARY = path("word_bpe_49k.json")


@pytest.mark.parametrize("axes, bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 70))
def test_sequences_are_full_or_powers_of_two(total, capacity):
    full, tail = sequence_starts(total, capacity)
    sizes = [capacity] * full + np.diff(tail).tolist()
    assert sum(sizes) == total and tail[0] == full * capacity
    assert all(size == capacity or size & (size - 1) == 0 and size < capacity for size in sizes)


def checked(pieces, docs, capacity):
    """Every id lies in exactly one piece, sequences have no gaps and no padding but at powers of two."""
    plain = Tokenizer.from_file(VOCABULARY)
    rows = pieces.collect()
    sequences = defaultdict(list)
    for row in rows:
        assert len(row.ids) == 4 * row.length > 0
        sequences[row.sequence_id].append((row.offset, row.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end == capacity or end < capacity and end & (end - 1) == 0
    expected = Counter((r.doc_id, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in expected.items())
    by_row = defaultdict(list)
    for row in rows:
        by_row[row.doc_id, row.doc_tokens, row.start].append(row)
    assert sorted(sequences) == list(range(len(sequences)))
    for (doc, ids), n in expected.items():
        have = [(r.start, r.length, r.ids) for r in rows if r.doc_id == doc and r.doc_tokens == len(ids)]
        covered = Counter()
        for start, length, blob in have:
            assert np.frombuffer(blob, "<u4").tolist() == list(ids[start : start + length])
            covered.update(range(start, start + length))
        assert covered == Counter(dict.fromkeys(range(len(ids)), n))
    return sequences


@pytest.mark.parametrize("capacity", [16, 100, 4096])
def test_odd_documents(odd, capacity):
    checked(pack_along_curve(odd, VOCABULARY, capacity), odd, capacity)


def test_a_text_longer_than_a_slice(make):
    long = " ".join(f"word{i % 9973} of {i % 31}" for i in range(150_000))
    docs = make([(1, long, "a"), (2, "short", "a"), (2, "short", "a"), (3, None, "b")])
    checked(pack_along_curve(docs, VOCABULARY), docs, 4096)


def test_empty_table(nothing):
    assert pack_along_curve(nothing, VOCABULARY).collect() == []


def test_neighbours_are_alike(make):
    dice = np.random.default_rng(3)
    themes = [[f"{a}{b}" for b in "bcdfgklmnprst"] for a in ("ba", "no", "ti", "ru")]
    rows = [(i, " ".join(dice.choice(themes[i % 4], 60)), "a") for i in range(200)]
    pieces = pack_along_curve(make(rows), VOCABULARY, 512).collect()
    same = Counter()
    for number, own in itertools.groupby(sorted(pieces, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        theme = [r.doc_id % 4 for r in own]
        same.update(a == b for a, b in itertools.pairwise(theme))
    assert same[True] / sum(same.values()) > 0.8


def test_copies_lie_together_whatever_the_partitions(make):
    rows = [(i, "the very same words again and again" if i % 3 == 0 else f"other text number {i} x{i * 7919}", "a") for i in range(90)]
    pieces = pack_along_curve(make(rows).repartition(7), VOCABULARY, 64).collect()
    copies = [r.sequence_id for r in pieces if r.doc_id % 3 == 0]
    assert max(copies) - min(copies) <= 10


def test_the_session_keeps_its_batch_setting(spark, make):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    curve_packing.token_rows(make([(1, "a b", "a")]), VOCABULARY)
    assert spark.conf.get(setting) == before
