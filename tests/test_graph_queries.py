"""Degrees, search, neighbourhoods and views on a random graph, against plain Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from archgraph.operators.degrees import degrees, neighbourhood, suggest_symbols
from archgraph.operators.symbol_search import search_symbols
from archgraph.operators.topk import top_k
from archgraph.operators.views import class_view, file_view
from archgraph.plans.graph import only_repositories
from tests.conftest import call


def random_repository(seed=7):
    """Files with two classes of three methods and one function each; calls at random."""
    dice = random.Random(seed)
    symbols, rows, methods = [], [], []
    for f in range(6):
        path = f"{'tests' if f == 5 else 'src'}/f{f}.py"
        module = path[:-3].replace("/", ".")

        def add(kind, name, owner, path=path):
            line = len(symbols) + 1
            symbols.append({"symbol_type": kind, "id": name, "file_path": path, "start_line": line})
            if owner:
                rows.append(call(owner, name, line, "contains", source_file=path, confidence=1.0))

        add("file", module, None)
        add("function", f"{module}.run", module)
        methods.append(f"{module}.run")
        for c in "AB":
            add("class", f"{module}.{c}", module)
            for m in range(3):
                add("method", f"{module}.{c}.m{m}", f"{module}.{c}")
                methods.append(f"{module}.{c}.m{m}")
            if f:
                rows.append(call(f"{module}.{c}", f"src.f0.{c}", len(symbols), "inherits"))
    for i in range(150):
        rows.append(call(dice.choice(methods), dice.choice(methods), 1000 + i % 40))
    # A class that holds one method by two edges.
    rows.append(call("src.f1.A", "src.f1.A.m0", 999, "contains"))
    return symbols, rows


@pytest.fixture(scope="module")
def repository(tables):
    symbols, rows = random_repository()
    graph = tables.graph(symbols, rows)
    info = {f"r:{s['id']}": s for s in symbols}
    edges = {(f"r:{r['source_id']}", r["relationship_type"].upper(), f"r:{r['target_id']}", r["source_line"])
             for r in rows}
    edges |= {("r", "CONTAINS", u, None) for u, s in info.items() if s["symbol_type"] == "file"}
    return graph, info, edges


def degree_of(edges, types=None):
    count = Counter()
    for a, kind, b, _ in edges:
        if types is None or kind in types:
            count.update({a, b} - {"r"})
    return count


def test_degrees(repository, tables):
    graph, _, edges = repository
    assert {r.uid: r.degree for r in degrees(graph.edges).collect()} == degree_of(edges)
    some = tables.rows("uid string", ("r:src.f0.A",), ("r:src.f0.A",), ("r:nowhere",))
    assert {r.uid: r.degree for r in degrees(graph.edges, only=some).collect()} == {
        "r:src.f0.A": degree_of(edges)["r:src.f0.A"]}


def test_suggestions(repository):
    graph, info, edges = repository
    count = degree_of(edges, ("CALLS", "INHERITS"))
    wanted = [u for u, s in info.items() if s["symbol_type"] != "file" and "test" not in s["file_path"] and count[u]]
    expected = sorted(wanted, key=lambda u: (-count[u], u))[:6]
    assert [r.uid for r in suggest_symbols(*graph).orderBy("rank").collect()] == expected


def test_search(repository, tables):
    graph, info, _ = repository
    queries = tables.rows("query_id string, repo_id string, query string",
                          ("q", "r", " F1.a "), ("none", "r", "zzz"), ("blank", "r", " \t "), ("foreign", "x", "f1"))
    found = search_symbols(graph.nodes, queries, 3).orderBy("query_id", "rank").collect()
    matches = sorted((u for u in info if "f1.a" in u.lower()), key=lambda u: (len(u), u))[:3]
    assert [(r.query_id, r.uid) for r in found] == [("q", u) for u in matches]


def test_neighbourhood(repository):
    graph, info, edges = repository
    confidence = {"CONTAINS": 1.0}
    for row in neighbourhood(graph.edges, graph.nodes).groupBy("uid", "direction").agg(
            F.count("*").alias("n"), F.max("position").alias("last")).collect():
        out = [e for e in edges if e[0] == row.uid]
        into = [e for e in edges if e[2] == row.uid and e[1] == "CALLS"]
        assert row.n == row.last == (min(8, len(out)) if row.direction == "outgoing" else min(5, len(into)))
    related = neighbourhood(graph.edges, graph.nodes).filter("relationship_type = 'CONTAINS'")
    assert {r.confidence for r in related.collect()} <= {confidence["CONTAINS"], 0.75}


def test_zero_or_missing_confidence_reads_as_one(tables):
    graph = tables.graph([("function", "m.a"), ("function", "m.b")], [
        call("m.a", "m.b", 1, confidence=0.0), call("m.a", "m.b", 2, confidence=None)])
    assert {r.confidence for r in neighbourhood(graph.edges, graph.nodes).collect()} == {1.0}


def pairs_of(info, edges):
    count = Counter()
    for a, kind, b, _ in edges:
        if kind == "CALLS":
            p, q = info[a]["file_path"], info[b]["file_path"]
            if p != q and "test" not in p and "test" not in q:
                count[p, q] += 1
    return count


@pytest.mark.parametrize("limit", [60, 3])
def test_file_view(repository, limit):
    graph, info, edges = repository
    pairs = pairs_of(info, edges)
    count = Counter(p for pair in pairs for p in pair)
    best = sorted(count, key=lambda p: (-count[p], p))[:limit]
    view = file_view(*graph, limit=limit)
    assert {(r.file_path, r.degree) for r in view.nodes.collect()} == {(p, count[p]) for p in best}

    def uid(path):
        return "r:" + path[:-3].replace("/", ".")

    assert {(r.source_uid, r.target_uid, r.weight) for r in view.edges.collect()} == {
        (uid(a), uid(b), float(n)) for (a, b), n in pairs.items() if a in best and b in best}
    assert view.truncated.first().truncated == (len(count) > limit)


@pytest.mark.parametrize("limit", [100, 6])
def test_class_view(repository, limit):
    graph, info, edges = repository
    count = degree_of(edges)
    wanted = [u for u, s in info.items() if s["symbol_type"] in ("file", "class") and "test" not in s["file_path"]]
    best = sorted(wanted, key=lambda u: (-count[u], u))[:limit]
    view = class_view(*graph, limit=limit)
    assert {(r.uid, r.degree) for r in view.nodes.collect()} == {(u, count[u]) for u in best}
    kind = {u: s["symbol_type"] for u, s in info.items()}
    expected = Counter()
    for a, t, b, _ in edges:
        if a in best and b in best:
            if (t, kind[a], kind[b]) in (("CONTAINS", "file", "class"), ("INHERITS", "class", "class")):
                expected[a, b, t, 1.0] += 1
    uses = Counter()
    members = [(a, b) for a, t, b, _ in edges if t == "CONTAINS" and kind.get(a) == "class" and kind[b] == "method"]
    for a, t, b, _ in edges:
        if t == "CALLS":
            for c1, m1 in members:
                for c2, m2 in members:
                    if (m1, m2) == (a, b) and c1 != c2 and c1 in best and c2 in best:
                        uses[c1, c2] += 1
    for (c1, c2), n in uses.items():
        expected[c1, c2, "USES", float(n)] += 1
    assert Counter((r.source_uid, r.target_uid, r.relationship_type, r.weight)
                   for r in view.edges.collect()) == expected
    assert view.truncated.first().truncated == (len(best) >= limit)


def test_views_of_an_empty_graph(tables):
    graph = tables.graph([], [])
    for view in (file_view(*graph), class_view(*graph)):
        assert view.nodes.isEmpty() and view.edges.isEmpty() and view.truncated.isEmpty()


@pytest.mark.parametrize("k, salted", [(5, False), (5, True), (1500, False)])
def test_top_k_with_a_hot_key(spark, k, salted):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("key"),
                                    (F.col("id") * 7919 % 6007).alias("x"))
    best = top_k(rows, ["key"], [F.col("x").desc()], k, salted=salted)
    hot = [i * 7919 % 6007 for i in range(6000) if i % 3 > 0]
    assert [r.x for r in best.filter("key = 'hot'").orderBy("rank").collect()] == sorted(hot, reverse=True)[:k]
    assert best.filter("key <> 'hot'").count() == 2000


def test_questions_about_one_repository_read_no_other(tables):
    graph = tables.graph(
        [{"symbol_type": "function", "id": n, "repo_id": r} for r in ("r", "s") for n in ("m.a", "m.b")],
        [call("m.a", "m.b", repo_id=r) for r in ("r", "s")])
    one = only_repositories(graph, ["s"])
    found = degrees(one.edges)
    assert {r.uid for r in found.collect()} == {"s:m.a", "s:m.b"}
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan and "repo_id" in scan[scan.index("PushedFilters"):]
    assert {r.repo_id for r in class_view(*one).truncated.collect()} == {"s"}


def test_neighbourhood_is_dealt_to_more_tasks_when_there_are_more_edges(repository, monkeypatch):
    from archgraph.operators import degrees as module

    graph = repository[0]
    few = neighbourhood(graph.edges, graph.nodes)
    monkeypatch.setattr(module, "EDGES_PER_TASK", max(1, graph.edges.count() // 20))
    more = neighbourhood(graph.edges, graph.nodes)
    assert few.exceptAll(more).isEmpty() and more.exceptAll(few).isEmpty()
    plan = more._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 4 and "hashpartitioning(uid" in plan
    parts = {int(n) for n in re.findall(r"hashpartitioning\(uid#\d+, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert len(parts) == 1 and min(parts) >= 20
