import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archgraph.llm.packing import pack, packing_plan, token_pieces


def sequences(counts, capacity):
    """Contents of the sequences that a plan makes, by offset."""
    runs, total = packing_plan(counts, capacity)
    filled = defaultdict(dict)
    seen = Counter()
    for size, rank, items, per, first, offset in runs:
        assert rank == seen[size]
        seen[size] += items
        for i in range(items):
            place = filled[first + i // per]
            assert offset + i % per * size not in place
            place[offset + i % per * size] = size
    assert seen == Counter({s: n for s, n in counts.items() if n})
    assert sorted(filled) == list(range(total))
    for place in filled.values():
        end = 0
        for offset in sorted(place):
            assert offset == end
            end += place[offset]
        assert end <= capacity
    return filled, total


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=12))))
def test_plans_are_gapless_and_at_most_two_large_items_meet(case):
    capacity, counts = case
    filled, total = sequences(counts, capacity)
    for place in filled.values():
        assert sum(3 * size > capacity for size in place.values()) <= 2
    words = sum(s * n for s, n in counts.items())
    assert -(-words // capacity) <= total <= sum(counts.values())


def best_fit_decreasing(counts, capacity):
    gaps = []
    for size in sorted(Counter(counts).elements(), reverse=True):
        fits = [i for i, gap in enumerate(gaps) if gap >= size]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= size
        else:
            gaps.append(capacity - size)
    return len(gaps)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 15), max_size=10))
def test_plans_need_about_as_few_as_item_by_item_best_fit(counts):
    _, total = sequences(counts, 40)
    assert total <= best_fit_decreasing(counts, 40) * 1.1 + 1


def test_large_items_are_matched_as_often_as_possible():
    assert packing_plan({60: 3, 40: 2, 35: 1, 38: 1}, 100)[1] == 4
    assert packing_plan({50: 5}, 100)[1] == 3
    assert packing_plan({}, 100) == ([], 0)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_of_odd_documents(odd, capacity):
    plain = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = token_pieces(odd, path("byte_bpe_50k.json"), capacity).withColumn("crc", F.crc32("ids"))
    got = Counter(tuple(r) for r in pack(pieces.drop("ids"), capacity).drop("sequence_id", "offset").collect())
    expected = Counter()
    for row in odd.collect():
        ids = [*plain.encode(row.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for number, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            expected[row.doc_id, number, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert got == expected


def test_packed_rows_lie_end_to_end(odd):
    rows = pack(token_pieces(odd, path("byte_bpe_50k.json"), 64), 64).collect()
    by_sequence = defaultdict(list)
    for row in rows:
        assert len(row.ids) == 4 * row.length
        by_sequence[row.sequence_id].append((row.offset, row.length))
    for places in by_sequence.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 64
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 64) + 3


def test_empty_table_packs_to_nothing(nothing):
    assert pack(token_pieces(nothing, path("byte_bpe_50k.json"))).collect() == []
