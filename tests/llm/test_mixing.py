import re
from collections import Counter, defaultdict

import pytest

from archgraph.llm.mixing import mix_sources, take_copies
from archgraph.llm.order import whole_row

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shared(sizes, weights, most):
    """Targets by repeated sharing, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, closed = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in closed)
        parts = sum(weight[s] for s in order if s not in closed)
        above = {s for s in order if s not in closed and left * weight[s] / parts > most * sizes[s]} if parts else set()
        if not above:
            return {s: most * sizes[s] if s in closed else left * weight[s] / parts for s in order}
        closed |= above


def sizes_of(docs):
    sizes = defaultdict(int)
    for row in docs.collect():
        sizes[row.source] += len(WORD.findall(row.text or ""))
    return dict(sizes)


def check(docs, **options):
    rows = mix_sources(docs, keep=["doc_id", "source"], **options).collect()
    sizes = sizes_of(docs)
    targets = shared(sizes, options.get("weights", (5, 2, 1)), 3)
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    return rows, targets


def test_odd_documents(odd):
    check(odd)


def test_targets_are_capped_and_met(make):
    rows = [(i, "w " * (1 + i % 37), "big") for i in range(900)] + [(1000 + i, "v " * (1 + i % 11), f"s{i % 4}") for i in range(400)]
    rows += [(5000, "tiny words", None), (5001, "few", "t")]
    found, targets = check(make(rows), weights=(1, 9, 5))
    taken = defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
    for source in ("big", "s0", "s1", "s2", "s3"):
        assert taken[source] == pytest.approx(targets[source], rel=0.05)
    assert taken[None] == 6


def test_runs_agree_and_rows_follow_copies(make):
    docs = make([(i, "a b c " * (i % 9), "xyz"[i % 3]) for i in range(200)])
    one, two = (sorted(map(tuple, mix_sources(docs, keep=["doc_id"]).collect())) for _ in range(2))
    assert one == two
    rows = docs.select(whole_row(docs).alias("row"), "doc_id", "source", "text")
    taken = take_copies(mix_sources(rows, keep=["row"]), ["row.*"])
    assert taken.columns == docs.columns
    assert Counter(r.doc_id for r in taken.collect()) == Counter({r[0]: r[4] for r in one if r[4]})


def test_no_words_and_no_rows(make, nothing):
    assert {tuple(r) for r in mix_sources(make([(1, None, "a"), (2, " ", None)]), keep=["doc_id"]).select("taken", "target").collect()} == {(0, 0.0)}
    assert mix_sources(nothing).collect() == []


def test_plan_has_no_python(make):
    plan = mix_sources(make([(1, "a", "b")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
