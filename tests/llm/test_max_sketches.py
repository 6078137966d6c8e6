import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from archgraph.llm import max_sketches
from archgraph.llm.max_sketches import MOST_TF, best_documents, fold, term_counts
from archgraph.llm.text import text_slices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    """Rows (item id, rank, document's id, score), straight from the rule."""
    counted = [(doc, Counter(terms(text))) for doc, text in docs]
    lengths = [sum(c.values()) for _, c in counted]
    many, words = sum(n > 0 for n in lengths), sum(lengths)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for (doc, c), n in zip(counted, lengths):
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * many + 2) / (2 * held[t] + 1)))
                    m = 100 - 90 + 90 * n * many // words
                    score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scored)[:k], 1)]
    return out


def found(spark, docs, items, **more):
    rows = spark.createDataFrame(items, "item_id long, text string, found_id string" if items and len(items[0]) == 3 else "item_id long, text string")
    return [tuple(r) for r in best_documents(docs, rows, **more).collect()]


def same(left, right):
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(left, key=order) == sorted(right, key=order)


def test_odd_documents_and_queries(spark, odd):
    items = [(1, "Alpha BETA words nowhere"), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "word1 word2 wörter"), (5, "!?"), (6, "ZWEI Wörter end")]
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    same(found(spark, odd, items), brute(docs, items))


@pytest.mark.parametrize("rounds, block", [((64, 1024), 1000), ((2, 3), 4), ((1, 1), 1)])
def test_random_documents_in_rounds_and_blocks(spark, make, rounds, block):
    dice = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(dice.choice(vocabulary, dice.integers(0, 40)) if i % 3 else ["w1", "w2", "w3"] * 4), "a") for i in range(120)]
    rows += [(7, "w5 w5 w5", "a"), (7, "w5 w5 w5", "a"), (None, "w5 w6", "b")]
    items = [(i, " ".join(dice.choice(vocabulary, 5))) for i in range(6)]
    same(found(spark, make(rows).repartition(5), items, k=4, rounds=rounds, query_block=block), brute([r[:2] for r in rows], items, 4))


def test_colliding_coordinates_lose_nothing(spark, make, monkeypatch):
    monkeypatch.setattr(max_sketches, "COORDINATE_BITS", 16)
    dice = np.random.default_rng(1)
    wide = [(i, " ".join(f"t{x}" for x in dice.integers(0, 200_000, 4_000)), "a") for i in range(25)]
    items = [(i, " ".join(f"t{x}" for x in dice.integers(0, 200_000, 400))) for i in range(3)]
    same(found(spark, make(wide), items, rounds=(3, 5)), brute([r[:2] for r in wide], items))


def test_many_occurrences_and_a_text_longer_than_a_slice(spark, make):
    rows = [(1, "deep " * 700 + "sea", "a"), (2, "deep " * 300, "a"), (3, "sea", "a"), (4, " ".join(f"x{i % 50_021}" for i in range(400_000)) + " deep sea", "a"), (5, "shore", "a")]
    items = [(1, "deep sea"), (2, "x17 shore"), (3, "x50020")]
    assert max(c for _, text, _ in rows for c in Counter(terms(text)).values()) > MOST_TF
    same(found(spark, make(rows), items), brute([r[:2] for r in rows], items))


def test_clashing_columns(spark, make):
    docs = make([(1, "a b", "s"), (2, "b", "s")], ("slot", "held", "terms", "text_key", "item", "bound"))
    same(found(spark, docs, [(1, "b", "x")]), brute([(1, "a b"), (2, "b")], [(1, "b")]))


def test_empty_tables(spark, make, nothing):
    assert found(spark, nothing, [(1, "a")]) == []
    assert best_documents(make([(1, "a", "s")]), spark.createDataFrame([], "item_id long, text string")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbé1 -\n", max_size=30), min_size=1, max_size=5))
def test_counts_and_maxima_of_terms(texts):
    for first, data, offsets in text_slices(pa.array(texts)):
        counts, row, hashes, times = term_counts(data, offsets)
        assert counts.tolist() == [len(terms(t)) for t in texts]
        at, most, number = fold(row, hashes, times, len(texts))
        for i, text in enumerate(texts):
            own = Counter(dict(zip(hashes[row == i].tolist(), times[row == i].tolist())))
            assert sorted(own.values()) == sorted(Counter(terms(text)).values())
            cells = {}
            for h, n in own.items():
                cells[h >> 48] = max(cells.get(h >> 48, 0), min(n, MOST_TF))
            part = slice(number[:i].sum(), number[: i + 1].sum())
            assert dict(zip(at[part].tolist(), most[part].tolist())) == cells
