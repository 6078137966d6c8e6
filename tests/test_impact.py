"""Impact reports, risk rubric and classification."""

import pytest
from pyspark.sql import functions as F

from archgraph.functions.classify import classify_import, is_api_endpoint, is_service_component, is_test
from archgraph.plans.impact import dependents_preview, explanation, impact_report, risk_level, risk_score, risk_signals
from tests.conftest import call

COUNTS = "direct long, indirect long, apis long, services long, tests long, external long, degree long"


def risk(tables, *vectors):
    rows = tables.rows("i int, " + COUNTS, *[(i, *v) for i, v in enumerate(vectors)])
    c = F.col
    scored = rows.withColumn("signals", risk_signals(
        c("direct") + c("indirect"), c("apis"), c("services"), c("tests"), c("external"), c("degree")))
    return scored.withColumn("score", risk_score(c("signals"))).withColumn("level", risk_level(c("score"))) \
        .orderBy("i").collect()


def test_rubric(tables):
    rows = risk(
        tables,
        (0, 0, 0, 0, 0, 0, 0), (20, 10, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0), (2, 0, 1, 0, 0, 0, 0),
        (5, 0, 0, 0, 0, 0, 0), (5, 0, 0, 0, 3, 0, 0), (15, 20, 3, 2, 0, 2, 20), (5, 1, 1, 0, 0, 0, 0))
    assert [(r.level, r.score) for r in rows] == [
        ("LOW", 0), ("HIGH", 6), ("MEDIUM", 3), ("HIGH", 5), ("MEDIUM", 4), ("LOW", 2), ("CRITICAL", 11), ("HIGH", 6)]
    for r in rows:
        assert sum(s.points for s in r.signals) == r.score
        assert r.signals[0].name == "Total dependents"


@pytest.mark.parametrize("total, bucket, points", [
    (0, "0", 0), (1, "1-3", 1), (3, "1-3", 1), (4, "4-10", 2), (10, "4-10", 2), (11, "11-25", 3), (25, "11-25", 3),
    (26, ">25", 4)])
def test_buckets(tables, total, bucket, points):
    signal = risk(tables, (total, 0, 0, 0, 1, 0, 0))[0].signals[0]
    assert (signal.value, signal.points) == (f"{total} ({bucket})", points)


def test_signal_values(tables):
    signals = risk(tables, (3, 0, 1, 2, 1, 4, 15))[0].signals
    assert [(s.value, s.points) for s in signals] == [
        ("3 (1-3)", 1), ("1", 2), ("2", 1), ("1 test(s) found", 0), ("4", 1), ("degree 15 (>=15)", 1)]
    assert [s.value for s in risk(tables, (1, 0, 0, 0, 0, 0, 14))[0].signals] == ["1 (1-3)", "none found"]


def test_explanation_branches(tables):
    vectors = [(0, 0, 0, 0, 0, 0, 0), (30, 0, 2, 1, 0, 0, 0), (11, 0, 0, 1, 11, 0, 0), (2, 1, 0, 0, 1, 0, 20)]
    rows = tables.rows("i int, " + COUNTS, *[(i, *v) for i, v in enumerate(vectors)])
    c = F.col
    names = F.when(c("i") == 3, F.array(*[F.lit(x) for x in "abcdef"])).otherwise(F.array().cast("array<string>"))
    texts = [r.t for r in rows.withColumn("t", explanation(
        F.lit("m.f"), c("direct"), c("indirect"), c("apis"), c("services"), c("tests"), names, c("degree"),
        F.lit("LOW"))).orderBy("i").collect()]
    assert texts[0] == "No symbol of the repository depends on m.f. Overall risk: LOW."
    assert "30 dependents" in texts[1] and "endpoints among them: 2" in texts[1] and "No test" in texts[1]
    assert "Service components among them: 1" in texts[2] and "covers all" in texts[2]
    assert "covers a part" in texts[3] and "(a, b, c, d, e)" in texts[3] and "20 edges" in texts[3]


@pytest.mark.parametrize("decorator, expected", [
    ('@app.get("/x")', True), ("@router.POST ('/x')", True), ("@api_view(['GET'])", True), ("@action", True),
    ("@actions", False), ("@app.getter()", False), ("@staticmethod", False), ("@bp.websocket(", True)])
def test_api_decorators(tables, decorator, expected):
    row = tables.rows("d array<string>", (["@x", decorator],)).select(is_api_endpoint(F.col("d")).alias("v")).first()
    assert row.v is expected


@pytest.mark.parametrize("name, kind, expected", [
    ("a.PaymentService", "class", True), ("a.PaymentService.pay", "method", True), ("a.Payment.pay", "method", False),
    ("PayClient", "class", True), ("pay", "method", False), ("a.service", "class", False),
    ("a.PaymentService", "function", False), ("a.PaymentServices", "class", False)])
def test_service_names(tables, name, kind, expected):
    row = tables.rows("n string, k string", (name, kind)).select(
        is_service_component(F.col("n"), F.col("k")).alias("v")).first()
    assert row.v is expected


def test_import_and_test_classes(tables):
    names = {"sqlalchemy.orm": "database", "sqlite3": "database", "os.path": None, "requests": "external_service",
             "_thread2": None, "..x": None, "": None, "numpy.linalg": "external_service"}
    rows = tables.rows("n string", *[(n,) for n in names])
    assert {r.n: r.c for r in rows.select("n", classify_import(F.col("n")).alias("c")).collect()} == names
    tests = tables.rows("p string, n string", ("src/Testing/a.py", "f"), ("src/a.py", "test_f"), ("src/a.py", "f"))
    assert [r.t for r in tests.select(is_test(F.col("p"), F.col("n")).alias("t")).collect()] == [True, True, False]


@pytest.fixture(scope="module")
def report(tables):
    symbols = [("file", "m"), {"symbol_type": "class", "id": "m.PayService", "decorators": []},
               {"symbol_type": "method", "id": "m.PayService.pay", "decorators": ['@app.get("/pay")']},
               ("function", "m.core"), {"symbol_type": "function", "id": "t.test_core", "file_path": "tests/t.py"},
               ("function", "m.lonely")]
    symbols += [{"symbol_type": "import", "id": f"i{i}", "qualified_name": n} for i, n in enumerate(
        ["requests.a", "requests.b", "redis", "os", "boto3", "attr", "yaml", "click"])]
    symbols.append({"symbol_type": "import", "id": "far", "qualified_name": "pandas", "file_path": "src/other.py"})
    graph = tables.graph(symbols, [
        call("m.PayService.pay", "m.core", 1), call("m.PayService.pay", "m.core", 2), call("t.test_core", "m.PayService.pay"),
        call("m.core", "m.core", 9)])
    targets = tables.rows("repo_id string, uid string", ("r", "r:m.core"), ("r", "r:m.lonely"), ("r", "r:none"),
                          ("other", "r:m.core"), ("r", "r:m.core"))
    return impact_report(graph, targets)


def test_report_rows(report):
    rows = {(r.repo_id, r.target_uid): r for r in report.summary.collect()}
    assert len(rows) == 4
    core = rows["r", "r:m.core"]
    assert (core.found, core.direct_count, core.indirect_count, core.degree) == (True, 2, 1, 3)
    assert (core.affected_apis, core.affected_services, core.affected_tests) == (1, 1, 1)
    assert core.external_count == 6 and core.external_names == ["attr", "boto3", "click", "redis", "requests"]
    assert core.risk_score == 1 + 2 + 1 + 0 + 1 and core.risk_level == "HIGH"
    lonely = rows["r", "r:m.lonely"]
    assert (lonely.direct_count, lonely.degree, lonely.risk_level) == (0, 0, "LOW")
    for missing in (rows["r", "r:none"], rows["other", "r:m.core"]):
        assert (missing.found, missing.risk_level, missing.explanation) == (False, None, None)
    assert len(core.detection_notes) == 2


def test_report_lists(report):
    assert {(r.uid, r.depth) for r in report.dependents.filter("target_uid = 'r:m.core'").collect()} == {
        ("r:m.core", 1), ("r:m.PayService.pay", 1), ("r:t.test_core", 2)}
    external = {(r.package, r.category) for r in report.external_dependencies.filter("target_uid = 'r:m.core'").collect()}
    assert ("redis", "database") in external and ("requests", "external_service") in external and len(external) == 6


def test_preview(report):
    row = dependents_preview(report.dependents, shown=2).filter("target_uid = 'r:m.core'").first()
    assert [d.qualified_name for d in row.dependents] == ["m.PayService.pay", "m.core"]
    assert (row.total, row.more) == (3, 1)
