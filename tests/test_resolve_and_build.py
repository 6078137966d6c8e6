"""Name resolution, nodes, edges."""

from pyspark.sql import functions as F

from archgraph.operators.build import build_edges, build_nodes, graph_counts, unique_violations
from archgraph.operators.resolve import resolve_relationships
from archgraph.session import materialize
from tests.conftest import call


def links(tables, symbols, *names, **more):
    rows = [{"source_id": "m.f", "target_name": n} | more for n in names]
    resolved = resolve_relationships(tables.symbols(*symbols), tables.relationships(*rows))
    return {r.target_name: (r.target_id, r.confidence) for r in resolved.collect()}


SYMBOLS = [("file", "m"), ("class", "m.A"), ("method", "m.A.go"), ("function", "m.f"), ("function", "n.twin"),
           ("function", "o.twin"), {"symbol_type": "import", "id": "x::import::os.path::0", "qualified_name": "os.path"}]


def test_rules(tables):
    found = links(tables, SYMBOLS, "m.A", "self.go", "go", "x.y.go", "twin", "a.twin", "os.path", "print", "m")
    assert found == {
        "m.A": ("m.A", 0.95), "self.go": ("m.A.go", 0.75), "go": ("m.A.go", 0.75), "x.y.go": ("m.A.go", 0.75),
        "twin": (None, 0.3), "a.twin": (None, 0.3), "os.path": ("x::import::os.path::0", 0.95),
        "print": (None, 0.35), "m": ("m", 0.95),
    }


def test_confidence_is_only_lowered_for_outside_names(tables):
    assert links(tables, SYMBOLS, "print", confidence=0.2) == {"print": (None, 0.2)}


def test_resolved_rows_pass_through(tables):
    row = {"source_id": "m", "target_id": "elsewhere", "target_name": "twin", "confidence": 1.0}
    resolved = resolve_relationships(tables.symbols(*SYMBOLS), tables.relationships(row)).first()
    assert (resolved.target_id, resolved.confidence) == ("elsewhere", 1.0)


def test_last_symbol_of_a_qualified_name_wins(tables):
    twice = [{"symbol_type": "class", "id": "m.A", "file_path": "b.py", "seq": 0},
             {"symbol_type": "import", "id": "a::import::m.A::0", "qualified_name": "m.A", "file_path": "a.py", "seq": 9},
             {"symbol_type": "import", "id": "b::import::m.A::7", "qualified_name": "m.A", "file_path": "b.py", "seq": 7}]
    assert links(tables, twice, "m.A") == {"m.A": ("b::import::m.A::7", 0.95)}


def test_repeated_id_makes_a_name_ambiguous(tables):
    assert links(tables, [("method", "m.A.size"), ("method", "m.A.size")], "a.size") == {"a.size": (None, 0.3)}


def test_repositories_do_not_mix(tables):
    symbols = tables.symbols({"symbol_type": "function", "id": "m.go", "repo_id": "other"})
    resolved = resolve_relationships(symbols, tables.relationships({"source_id": "m", "target_name": "go"}))
    assert resolved.first().target_id is None


def test_every_row_survives_a_hot_name(spark, tables):
    rows = spark.range(3000).select(
        F.lit("r").alias("repo_id"), F.col("id").cast("int").alias("seq"), F.lit("m.f").alias("source_id"),
        F.lit(None).cast("string").alias("target_id"),
        F.when(F.col("id") % 3 == 0, "self.go").otherwise(F.concat(F.lit("n"), "id")).alias("target_name"),
        F.lit("calls").alias("relationship_type"), F.lit("a.py").alias("source_file"),
        F.col("id").cast("int").alias("source_line"), F.lit(0.5).alias("confidence"))
    resolved = resolve_relationships(tables.symbols(*SYMBOLS), rows)
    assert resolved.count() == 3000
    assert resolved.filter("target_id = 'm.A.go'").count() == 1000


def test_nodes_keep_the_last_of_a_uid(tables):
    nodes = build_nodes(tables.symbols(
        {"symbol_type": "method", "id": "m.A.x", "seq": 1, "start_line": 3},
        {"symbol_type": "method", "id": "m.A.x", "seq": 2, "start_line": 8}))
    assert [n.start_line for n in nodes.collect()] == [8]


def test_edges(tables):
    symbols = tables.symbols(("file", "m"), ("class", "m.A"), ("method", "m.A.go"))
    nodes = build_nodes(symbols)
    edges = build_edges(nodes, tables.relationships(
        call("m.A.go", "m.A.go", 5), call("m.A.go", "m.A.go", 6), call("m.A.go", "m.A.go", 6, confidence=0.95, seq=9),
        call("m.A.go", "gone", 7), call("gone", "m.A", 7), {"source_id": "m", "target_name": "open"}))
    got = {(e.src, e.dst, e.relationship_type, e.source_line, e.confidence) for e in edges.collect()}
    assert got == {("r:m.A.go", "r:m.A.go", "CALLS", 5, 0.75), ("r:m.A.go", "r:m.A.go", "CALLS", 6, 0.95),
                   ("r", "r:m", "CONTAINS", None, None)}
    by_type = {e.src_type for e in edges.collect()}
    assert by_type == {"method", "repository"}


def test_counts_and_violations(tables):
    symbols = tables.symbols(("file", "m"), ("method", "m.x"), ("method", "m.x"))
    resolved = tables.relationships(call("m", "m.x"), call("m", "gone"), {"source_id": "m", "target_name": "q"})
    counts = graph_counts(symbols, resolved).first()
    assert (counts.symbol_count, counts.relationship_count) == (3, 2)
    assert [(r.uid, r.occurrences) for r in unique_violations(symbols, ["uid"]).collect()] == [("r:m.x", 2)]


def test_the_query_of_edges_makes_them_once(tables, monkeypatch):
    from checks import queries

    rows = (tables.symbols(("file", "src.a"), ("function", "src.a.f")),
            tables.relationships(call("src.a", "src.a.f", kind="contains")))

    def unused(*_):
        raise AssertionError("the graph is built beside")

    monkeypatch.setattr(queries, "extracted", lambda *_: rows)
    monkeypatch.setattr(queries, "code_graph", unused)
    assert queries.build_edges(tables.spark, "the rows of this test").count() == 2


def test_edges_are_linked_in_tasks_of_bounded_size(spark, tables, monkeypatch):
    """Partitions follow the relationships and small tasks stay small; the session has its settings again."""
    from archgraph.plans import graph

    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before, seen = [spark.conf.get(n) for n in names], {}

    def recorded(df, label, *more):
        seen[label] = [spark.conf.get(n) for n in names]
        return materialize(df, label, *more)

    monkeypatch.setattr(graph, "EDGES_PER_TASK", 1)
    monkeypatch.setattr(graph, "materialize", recorded)
    rows = [call("m.f", "m.g", i) for i in range(30)]
    linked = graph.build_graph(tables.symbols(("function", "m.f"), ("function", "m.g")), tables.relationships(*rows))
    assert linked.edges.count() == 30
    assert seen["edges"] == ["30", str(4 << 20)]
    assert [spark.conf.get(n) for n in names] == before == seen["nodes"]
