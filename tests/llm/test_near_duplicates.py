import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from archgraph.llm import grouped
from archgraph.llm import near_duplicates as nd
from archgraph.llm import sized
from archgraph.llm.components import connected_components
from archgraph.llm.grouped import spanning_links

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_sets(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    """Sets and smallest reachable id per row number, by comparing all pairs."""
    sets = [word_sets(text, size) for _, text, _ in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                group[find(i)] = find(j)
    members = defaultdict(list)
    for i, row in enumerate(rows):
        members[find(i)].append(row[0])
    least = {g: min((k for k in ids if k is not None), default=None) for g, ids in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def edited(words, number, draw):
    words = list(words)
    for _ in range(number):
        words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=5):
    draw = random.Random(seed)
    rows = []
    for _ in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([8, 60, 150]))]
        rows += [edited(base, draw.choice([0, 0, 1, 2, 4, 9]), draw) for _ in range(draw.choice([1, 2, 9]))]
    base = [f"h{draw.randrange(300)}" for _ in range(120)]
    rows += [edited(base, 2, draw) for _ in range(40)] + [" ".join(base).upper()] * 25
    draw.shuffle(rows)
    return [(i * 3 + 1, text, "s") for i, text in enumerate(rows)]


@pytest.mark.parametrize("size, percent, block", [(3, 85, None), (5, 80, 4)])
def test_groups_are_those_of_all_pairs(make, monkeypatch, size, percent, block):
    if block:
        monkeypatch.setattr(nd, "POSTING_BLOCK", block)
        monkeypatch.setattr(nd, "GROUP_BLOCK", block)
    rows = corpus()
    found = nd.near_duplicates(make(rows), shingle_words=size, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, size, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("most", [400_000, 0])
def test_odd_documents(odd, monkeypatch, most):
    monkeypatch.setattr(sized, "BROADCAST_ROWS", most)
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    found = nd.near_duplicates(odd, shingle_words=3, percent=85).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=key) == sorted(brute(rows, 3, 85), key=key)
    kept = nd.without_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8, None, 10])


def test_empty_table(nothing):
    assert nd.near_duplicates(nothing).collect() == []
    assert nd.without_near_duplicates(nothing).collect() == []


def test_one_row_stays_of_equal_ids_with_other_texts(make):
    words = " ".join(f"w{i}" for i in range(100))
    kept = nd.without_near_duplicates(make([(4, words, "a"), (4, words + " x", "a"), (4, words, "a"), (9, words, "b")])).collect()
    assert [r.doc_id for r in kept] == [4]


def test_matches_leave_few_misses():
    matches = nd.needed_matches(32, 85)
    draw = np.random.default_rng(1)
    assert (draw.binomial(32, 0.85, 200_000) < matches).mean() < 1e-4 and 12 < matches < 24


def test_components_of_paths_stars_and_rings(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    draw.shuffle(links)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)} | {2000 + i: 2000 for i in range(9)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_spanning_links_join_what_all_links_join():
    draw = np.random.default_rng(3)
    for _ in range(50):
        linked = np.triu(draw.random((12, 12)) < 0.12, 1)
        linked |= linked.T
        one, other = spanning_links(12, lambda i, rest, linked=linked: linked[i, rest])
        assert linked[one, other].all() and len(one) <= 11
        reach = np.linalg.matrix_power(linked.astype(int) + np.eye(12, dtype=int), 12) > 0
        tree = np.eye(12, dtype=int)
        tree[one, other] = tree[other, one] = 1
        assert ((np.linalg.matrix_power(tree, 12) > 0) == reach).all()


@pytest.mark.parametrize("rows, size", [(1, 1 << 30), (7, 1 << 30), (1 << 30, 40), (1 << 30, 1 << 30)])
def test_groups_are_whole_whatever_the_batches(monkeypatch, rows, size):
    monkeypatch.setattr(grouped, "GROUP_ROWS", rows)
    monkeypatch.setattr(grouped, "GROUP_BYTES", size)
    keys = np.repeat(np.arange(12), [1, 5, 2, 9, 1, 1, 3, 4, 1, 2, 6, 1])
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    seen = []
    for part, begins in grouped.whole_groups(table.to_batches(max_chunksize=3), ["k"]):
        for begin, end in zip(begins[:-1], begins[1:]):
            seen.append((part["k"][int(begin)].as_py(), part["v"].to_numpy()[begin:end].tolist()))
    assert seen == [(k, np.flatnonzero(keys == k).tolist()) for k in range(12)]
