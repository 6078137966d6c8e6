"""Reverse reachability against breadth-first search in Python, within tasks and by rounds."""

import random
import time

import pytest

from archgraph.operators import reach
from archgraph.operators.reach import dependents
from tests.conftest import call

BOTH = pytest.mark.parametrize("local_bytes", [reach.LOCAL_BYTES, 0], ids=["tasks", "rounds"])


def brute(arcs, target, limit):
    depth, frontier, d = {}, {target}, 0
    while frontier and (limit is None or d < limit):
        d += 1
        frontier = {a for a, b in arcs if b in frontier} - set(depth)
        depth |= {n: d for n in frontier}
    return depth


def reached(tables, arcs, targets, limit=8, **more):
    edges = tables.rows("src string, dst string, relationship_type string", *[(a, b, "CALLS") for a, b in arcs])
    found = dependents(edges, tables.rows("uid string", *[(t,) for t in targets]), limit, **more).collect()
    assert len({(r.target_uid, r.uid) for r in found}) == len(found)
    out = {t: {} for t in targets}
    for r in found:
        out[r.target_uid][r.uid] = r.depth
    return out


@BOTH
@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(tables, seed, local_bytes):
    dice = random.Random(seed)
    arcs = [(f"v{dice.randrange(30)}", f"v{dice.randrange(30)}") for _ in range(50)]
    targets = ["v0", "v1", "v2"]
    assert reached(tables, arcs, targets, 4, local_bytes=local_bytes) == {t: brute(arcs, t, 4) for t in targets}


@BOTH
def test_more_targets_than_a_word(tables, local_bytes):
    dice = random.Random(9)
    arcs = [(f"v{dice.randrange(150)}", f"v{dice.randrange(150)}") for _ in range(190)]
    targets = [f"v{i}" for i in range(150)]
    assert reached(tables, arcs, targets, None, local_bytes=local_bytes) == {t: brute(arcs, t, None) for t in targets}


def test_more_targets_than_a_block(tables, monkeypatch):
    monkeypatch.setattr(reach, "MOST_WORDS", 1)
    monkeypatch.setattr(reach, "OUTPUT_ROWS", 7)
    arcs = [(f"v{i + 1}", f"v{i}") for i in range(200)]
    groups = reach._searched  # the bounds are read where the search runs
    import pyarrow as pa

    rows = [{"repo_id": "r", "src": a, "dst": b} for a, b in arcs] + [{"repo_id": "r", "src": None, "dst": f"v{i}"} for i in range(200)]
    table = pa.Table.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("repo_id", "src", "dst")]))
    batches = list(groups(table, None))
    assert len(batches) > 3
    pairs = {(r["target_uid"], r["uid"]): r["depth"] for batch in batches for r in batch.to_pylist()}
    assert pairs == {(f"v{i}", f"v{j}"): j - i for i in range(200) for j in range(i + 1, 201)}


@BOTH
def test_repositories_of_both_kinds(tables, local_bytes):
    """Many repositories with their own targets, a hot one among them, duplicate edges and targets without any."""
    dice = random.Random(2)
    edges, targets = [], []
    for repo, size in [(f"r{i}", 6) for i in range(12)] + [("hot", 60)]:
        edges += [(repo, f"{repo}:v{dice.randrange(size)}", f"{repo}:v{dice.randrange(size)}", "CALLS") for _ in range(2 * size)] * 2
        targets += [(repo, f"{repo}:v{i}") for i in range(3)] + [(repo, f"{repo}:none")]
    frame = tables.rows("repo_id string, src string, dst string, relationship_type string", *edges)
    limit = local_bytes and 500  # between the sizes: the hot one by rounds, the others within tasks
    found = dependents(frame, tables.rows("repo_id string, uid string", *targets), local_bytes=limit).collect()
    arcs = {(a, b) for _, a, b, _ in edges}
    expected = {(t, u, d) for _, t in targets for u, d in brute(arcs, t, None).items()}
    assert sorted((r.target_uid, r.uid, r.depth) for r in found) == sorted(expected)


@BOTH
def test_target_on_a_cycle_depends_on_itself(tables, local_bytes):
    ring = [("a", "b"), ("b", "c"), ("c", "a")]
    assert reached(tables, ring, ["a"], local_bytes=local_bytes) == {"a": {"c": 1, "b": 2, "a": 3}}
    assert reached(tables, [("a", "a")], ["a"], local_bytes=local_bytes) == {"a": {"a": 1}}


def test_all_depths_unless_the_caller_sets_a_limit(tables):
    chain = [(f"v{i + 1}", f"v{i}") for i in range(12)]
    assert max(reached(tables, chain, ["v0"])["v0"].values()) == 8
    assert reached(tables, chain, ["v0"], None)["v0"] == {f"v{i}": i for i in range(1, 13)}


def test_a_chain_of_a_thousand_takes_seconds(tables):
    chain = [(f"v{i + 1}", f"v{i}") for i in range(1000)]
    begin = time.time()
    assert reached(tables, chain, ["v0", "v500"], None)["v0"] == {f"v{i}": i for i in range(1, 1001)}
    assert time.time() - begin < 30


def test_only_the_repositories_asked_for_are_read(tables):
    edges = tables.rows("repo_id string, src string, dst string, relationship_type string",
                        ("r", "r:a", "r:b", "CALLS"), ("s", "s:a", "s:b", "CALLS"))
    found = dependents(edges, tables.rows("repo_id string, uid string", ("r", "r:b")))
    assert [(r.target_uid, r.uid, r.depth) for r in found.collect()] == [("r:b", "r:a", 1)]


def test_only_calls_and_inheritance_count(tables):
    graph = tables.graph(
        [("file", "m"), ("class", "m.A"), ("class", "m.B"), ("function", "m.f")],
        [call("m", "m.A", kind="contains"), call("m.B", "m.A", kind="inherits"), call("m.f", "m.B")])
    found = dependents(graph.edges, tables.rows("uid string", ("r:m.A",))).collect()
    assert {(r.uid, r.depth) for r in found} == {("r:m.B", 1), ("r:m.f", 2)}


@BOTH
def test_nothing_reached(tables, local_bytes):
    assert reached(tables, [("a", "b")], ["a", "unknown"], local_bytes=local_bytes) == {"a": {}, "unknown": {}}
    assert reached(tables, [], ["a"], local_bytes=local_bytes) == {"a": {}}
