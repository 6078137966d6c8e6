"""Substring search against a scan of all names."""

import random

import pytest

from archgraph.operators import symbol_search
from archgraph.operators.symbol_search import candidates, search_symbols, symbol_index


@pytest.fixture(scope="module")
def nodes(tables):
    dice = random.Random(6)
    words = ["pay", "Refund", "cart", "ÄRGER", "x", "ab", "Ledger"]
    symbols = []
    for i in range(300):
        name = ".".join(dice.choices(words, k=dice.randrange(1, 4))) + str(i % 7)
        symbols.append({"symbol_type": dice.choice(["file", "class", "function", "method", "import"]), "id": f"s{i}", "qualified_name": name, "repo_id": dice.choice("rs")})
    return tables.symbols(*symbols)


QUERIES = ["pay", "PAY.r", " ärger ", "x", "AB", "b3", "3", "r", "refund.cart", "zzz", "payzzz", "", " ", ".", "ledger.ledger.ledger", "6"]


def brute(rows, repo, query, limit):
    query = query.strip().lower()
    found = [r for r in rows if r.repo_id == repo and r.symbol_type != "import" and query and query in r.qualified_name.lower()]
    return [r.uid for r in sorted(found, key=lambda r: (len(r.qualified_name), r.uid))[:limit]]


def test_all_queries_find_what_a_scan_finds(tables, nodes):
    asked = tables.rows("query_id string, repo_id string, query string", *[(f"{r}/{i}", r, q) for r in "rst" for i, q in enumerate(QUERIES)])
    found = {}
    for row in search_symbols(nodes, asked, 5).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append(row.uid)
    rows = nodes.collect()
    expected = {f"{r}/{i}": brute(rows, r, q, 5) for r in "rst" for i, q in enumerate(QUERIES)}
    assert found == {q: uids for q, uids in expected.items() if uids}


def test_candidates_are_bounded_by_the_rarest_trigram(tables, nodes):
    index = symbol_index(nodes)
    asked = tables.rows("query_id string, repo_id string, part string", ("a", "r", "refund.cart"), ("b", "r", "ledger3"), ("c", "r", "payqqq"))
    counts = {(r.repo_id, r.gram): r.n for r in index.grams.collect()}
    per_query = {r.query_id: r["count"] for r in candidates(asked, index).groupBy("query_id").count().collect()}
    for query, part in (("a", "refund.cart"), ("b", "ledger3")):
        grams = {part[i : i + 3] for i in range(len(part) - 2)}
        assert per_query[query] <= min(counts["r", g] for g in grams) < nodes.filter("repo_id = 'r'").count() / 4
    assert "c" not in per_query


def test_no_join_pairs_queries_with_symbols_of_a_repository(tables, nodes):
    index = symbol_index(nodes)
    asked = tables.rows("query_id string, repo_id string, query string", ("a", "r", "refund"))
    plan = search_symbols(nodes, asked, index=index)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("uid" in line or "gram" in line or "query_id" in line for line in joins)


def test_empty_tables(tables, spark):
    empty = tables.symbols()
    asked = tables.rows("query_id string, repo_id string, query string", ("a", "r", "refund"), ("b", "r", "x"))
    assert search_symbols(empty, asked).collect() == []
    assert symbol_search.search_symbols(empty, asked.limit(0)).collect() == []
