"""Smell detection, ordering and display selections."""

from collections import Counter

from archgraph.plans.smells import (
    affected_preview, dead_code_candidates, detect_smells, god_classes, hidden_findings, large_functions,
    ordered_findings, top_findings,
)
from tests.conftest import call


def class_of(name, methods):
    symbols = [("class", name)] + [("method", f"{name}.m{i}") for i in range(methods)]
    return symbols, [call(name, f"{name}.m{i}", i, "contains") for i in range(methods)]


def test_god_class_severities(tables):
    symbols, rows = [], []
    for name, n in (("m.C14", 14), ("m.C15", 15), ("m.C25", 25), ("m.C40", 40)):
        s, r = class_of(name, n)
        symbols, rows = symbols + s, rows + r
    rows.append(call("m.C14", "m.C14.m0", 99, "contains"))  # a second edge counts
    found = god_classes(tables.graph(symbols, rows)).findings.collect()
    assert {(f.qualified_name, f.severity, f.metric) for f in found} == {
        ("m.C14", "LOW", 15), ("m.C15", "LOW", 15), ("m.C25", "MEDIUM", 25), ("m.C40", "HIGH", 40)}


def test_large_functions(tables):
    graph = tables.graph([
        {"symbol_type": kind, "id": f"m.f{lines}{kind}", "start_line": 10, "end_line": 10 + lines}
        for lines in (59, 60, 100, 150) for kind in ("function", "class")], [])
    assert {(f.metric, f.severity) for f in large_functions(graph).findings.collect()} == {
        (60, "LOW"), (100, "MEDIUM"), (150, "HIGH")}


def test_dead_code(tables):
    graph = tables.graph(
        [("function", "m.used"), ("function", "m.unused"), ("method", "m.A.__init__"), ("function", "m.test_x"),
         {"symbol_type": "function", "id": "m.route", "decorators": ["@app.get('/')"]}, ("function", "m.recursive"),
         ("class", "m.A")],
        [call("m.unused", "m.used"), call("m.recursive", "m.recursive")])
    assert [f.qualified_name for f in dead_code_candidates(graph).findings.collect()] == ["m.unused"]
    many = tables.graph([("function", f"m.f{i:02d}") for i in range(30)], [])
    names = sorted(f.qualified_name for f in dead_code_candidates(many).findings.collect())
    assert names == [f"m.f{i:02d}" for i in range(30)]
    first = dead_code_candidates(many, 20).findings.collect()
    assert sorted(f.qualified_name for f in first) == names[:20] and "One of 30" in first[0].evidence


def cycle(prefix, n):
    symbols = [("function", f"{prefix}.f{i}") for i in range(n)]
    return symbols, [call(f"{prefix}.f{i}", f"{prefix}.f{(i + 1) % n}", i) for i in range(n)]


def test_report(tables):
    symbols, rows = [], []
    for prefix, n in (("a", 2), ("b", 3), ("c", 8), ("d", 1)):
        s, r = cycle(prefix, n)
        symbols, rows = symbols + s, rows + r
    symbols += [{"symbol_type": "method", "id": f"e.m{i}", "start_line": 1, "end_line": 101 + i} for i in range(7)]
    report = detect_smells(tables.graph(symbols, rows))
    found = ordered_findings(report.findings).collect()
    kinds = Counter((f.smell_type, f.severity) for f in found)
    assert kinds == {("circular_dependency", "LOW"): 1, ("circular_dependency", "MEDIUM"): 1,
                     ("circular_dependency", "HIGH"): 1, ("large_function", "MEDIUM"): 7,
                     ("dead_code_candidate", "LOW"): 7}
    order = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
    assert [order[f.severity] for f in found] == sorted(order[f.severity] for f in found)
    medium = [f.metric for f in found if f.severity == "MEDIUM" and f.smell_type == "large_function"]
    assert medium == sorted(medium, reverse=True)

    shown = top_findings(report.findings).collect()
    assert Counter(f.severity for f in shown) == {"HIGH": 1, "MEDIUM": 5}
    hidden = hidden_findings(report.findings).first()
    assert (hidden.total, hidden.hidden) == (17, 11)

    members = report.affected.filter("smell_type = 'circular_dependency'").collect()
    assert Counter(m.subject for m in members) == {"r:a.f0": 2, "r:b.f0": 3, "r:c.f0": 8}
    preview = {p.subject: p for p in affected_preview(report.affected).collect()}
    assert len(preview["r:c.f0"].symbols) == 6 and preview["r:c.f0"].more == 2
    assert preview["r:a.f0"].more == 0


def test_clean_repository(tables):
    report = detect_smells(tables.graph([("file", "m")], []))
    assert report.findings.isEmpty() and report.affected.isEmpty()
