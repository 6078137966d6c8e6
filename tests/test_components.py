"""Strongly connected components, in grouped tasks and by rounds over tables."""

import random

import pytest

from archgraph.operators.components import strongly_connected_components


def brute(arcs):
    """Component by least member, from the transitive closure."""
    nodes = {x for arc in arcs for x in arc}
    reach = {n: {n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for a, b in arcs:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                grown = True
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def components(tables, repositories, local_bytes, *more):
    """Components of several repositories (name -> arcs) in one run; names are prefixed."""
    rows = [(repo, f"{repo}:{a}", f"{repo}:{b}") for repo, arcs in repositories.items() for a, b in arcs]
    edges = tables.rows("repo_id string, src string, dst string", *rows)
    found = strongly_connected_components(edges, local_bytes, *more).collect()
    assert len({r.uid for r in found}) == len(found)
    return {r.uid: r.component for r in found}


def expected(repositories):
    return {f"{repo}:{n}": f"{repo}:{c}" for repo, arcs in repositories.items() for n, c in brute(arcs).items()}


SMALL = {name: [tuple(arc) for arc in arcs] for name, arcs in {
    "two": ["AB", "BA"],
    "chain": ["AB", "BC"],
    "three": ["AB", "BC", "CA"],
    "cycle and chain": ["AB", "BA", "XY", "YZ"],
    "self-loop": ["AA", "AB"],
    "repeated": ["AB", "AB", "BA", "BA"],
    "joined cycles": ["AB", "BA", "CD", "DC", "BC"],
    "figure eight": ["AB", "BA", "BC", "CB"],
}.items()}


def random_repositories(seeds):
    repositories = {}
    for seed in seeds:
        dice = random.Random(seed)
        n = dice.choice([10, 40, 80])
        repositories[f"random {seed}"] = [(f"v{dice.randrange(n)}", f"v{dice.randrange(n)}")
                                          for _ in range(int(n * dice.choice([0.8, 1.2, 2])))]
    return repositories


def test_grouped_tasks(tables):
    repositories = SMALL | random_repositories(range(40))
    assert components(tables, repositories, 1000) == expected(repositories)


def test_rounds_over_tables(tables):
    repositories = SMALL | random_repositories(range(100, 110))
    assert components(tables, repositories, 0) == expected(repositories)


def test_long_chain_into_a_cycle_by_rounds(tables):
    chain = {"r": [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(120)] + [("v120", "v060")]}
    assert components(tables, chain, 0) == expected(chain)


def test_small_and_large_repositories_together(tables):
    repositories = {"small": [("a", "b"), ("b", "a")],
                    "large": [(f"m{i}", f"m{(i + 1) % 30}") for i in range(30)] + [("m0", "x")]}
    assert components(tables, repositories, local_bytes=160) == expected(repositories)


@pytest.mark.parametrize("local_bytes", [0, 160])
def test_no_edges(tables, local_bytes):
    assert components(tables, {}, local_bytes) == {}


@pytest.mark.parametrize("numbered_bytes", [16 * 30, 1 << 20])
def test_numbered_arcs_within_tasks(tables, numbered_bytes):
    repositories = SMALL | random_repositories(range(200, 210))
    assert components(tables, repositories, 0, numbered_bytes) == expected(repositories)


def test_numbered_arcs_that_fit_take_no_rounds(tables, monkeypatch):
    from archgraph.operators import components as module

    def unused(arcs):
        raise AssertionError("signatures by rounds")

    monkeypatch.setattr(module, "_signatures", unused)
    assert components(tables, {"r": SMALL["figure eight"]}, 0, 1000) == expected({"r": SMALL["figure eight"]})
