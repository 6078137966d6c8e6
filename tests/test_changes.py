"""Batches of few files write few rows, and give the graph of a full analysis of all files."""

import random

from pyspark.sql import functions as F

from archgraph.operators.build import graph_counts
from archgraph.operators.degrees import counted_degrees, degrees, edge_counts, merged_counts, suggest_symbols
from archgraph.operators.tfidf import fit_tfidf, search_documents
from archgraph.plans.ask import read_index
from archgraph.plans.graph import analyze_files
from archgraph.plans.impact import find_targets
from archgraph.schemas import SOURCE_FILES
from archgraph.sources import graph_store, repositories
from archgraph.streaming import ingest
from archgraph.streaming.ingest import ingest_batch

NAMES = [f"name{i}" for i in range(12)]


def source(dice, number):
    """A module with an import, a class that may inherit, and functions that call names defined anywhere."""
    lines = ["import os" if dice.random() < 0.5 else "from lib import thing"] + [""] * dice.randrange(3)
    base = f"(Class{dice.randrange(30)})" if dice.random() < 0.6 else ""
    lines += [f"class Class{number}{base}:", f"    def {dice.choice(NAMES)}(self):", f"        return self.{dice.choice(NAMES)}(1)"]
    for _ in range(dice.randrange(3)):
        lines += [f"def {dice.choice(NAMES)}_{dice.randrange(6)}(x):", f'    """About {dice.choice(NAMES)}."""',
                  f"    {dice.choice(NAMES)}_{dice.randrange(6)}(x)", f"    return other.Class{dice.randrange(30)}()"]
    return "\n".join(lines) + "\n"


def batch(spark, rows):
    frame = spark.createDataFrame([(r, p, len(c or ""), c) for r, p, c in rows], SOURCE_FILES)
    return frame.withColumn("landed", F.struct(F.current_timestamp().alias("at"), F.lit("f").alias("file"), F.lit(0).alias("row")))


def same_as_analysis(spark, store, files):
    """Graph, index and counts of the store against those of all its files, analysed at once."""
    frame = spark.createDataFrame([(r, p, len(c), c) for (r, p), c in files.items()], SOURCE_FILES)
    analyzed = analyze_files(frame)
    graph = graph_store.read_graph(spark, store)
    columns = [c for c in graph.nodes.columns if c != "seq"]
    assert sorted(map(str, graph.nodes.select(columns).collect())) == sorted(map(str, analyzed.graph.nodes.select(columns).collect()))
    edges = graph.edges.columns
    assert sorted(map(str, graph.edges.collect())) == sorted(map(str, analyzed.graph.edges.select(edges).collect()))
    kept = sorted(map(str, graph_store.read_degrees(spark, store).collect()))
    assert kept == sorted(map(str, merged_counts(edge_counts(analyzed.graph.edges)).collect()))
    counts = {r.repo_id: (r.symbol_count, r.relationship_count) for r in graph_counts(analyzed.extracted.symbols, analyzed.resolved).collect()}
    latest = {r.repo_id: r for r in repositories.latest_status(graph_store.read_status(spark, store)).collect()}
    assert {r: (latest[r].symbol_count, latest[r].relationship_count) for r in counts} == counts
    assert {r: latest[r].file_count for r in counts} == {r: sum(1 for repo, _ in files if repo == r) for r in counts}
    return analyzed


def rows_written(spark, store, name, number):
    return graph_store.read_batches(spark, store, name, [number]).count()


def test_random_changes_give_the_graph_of_all_files(spark, tmp_path):
    dice, store = random.Random(3), str(tmp_path / "store")
    files = {(r, f"pkg/m{i}.py"): source(dice, i) for r in ("big", "other") for i in range(25 if r == "big" else 8)}
    ingest_batch(batch(spark, [(r, p, c) for (r, p), c in files.items()]), 0, store, buckets=2)
    for number in range(1, 3):
        rows = {}
        for kind in ("new", "gone", "same", "other", "new"):
            repo, i = ("other" if kind == "other" else "big", dice.randrange(8 if kind == "other" else 27))
            key = (repo, f"pkg/m{i}.py")
            rows[key] = None if kind == "gone" else files.get(key) if kind == "same" else source(dice, i)
        for key, content in rows.items():
            files.pop(key, None)
            if content is not None:
                files[key] = content
        ingest_batch(batch(spark, [(*key, content) for key, content in rows.items()]), number, store, buckets=2)
    assert graph_store.live_entries(spark, store).filter("NOT is_base").count() == 4
    analyzed = same_as_analysis(spark, store, files)
    graph, counts = analyzed.graph, graph_store.read_degrees(spark, store)
    assert sorted(map(str, degrees(graph.edges, ("CALLS",)).collect())) == sorted(map(str, counted_degrees(counts, ("CALLS",)).collect()))
    assert sorted(map(str, suggest_symbols(*graph).collect())) == sorted(map(str, suggest_symbols(*graph, counts=counts).collect()))
    targets = suggest_symbols(*graph).select("repo_id", "uid")
    assert sorted(map(str, find_targets(graph, targets).collect())) == sorted(map(str, find_targets(graph, targets, counts).collect()))
    index = read_index(spark, store).terms
    full = fit_tfidf(search_documents(analyzed.extracted.symbols).select("repo_id", "doc_id", "text"))
    for own, other in ((index.vocabulary, full.vocabulary), (index.weights.drop("block"), full.weights.drop("block"))):
        key = [c for c in own.columns if c not in ("idf", "weight")]
        value = [c for c in own.columns if c not in key][0]
        rounded = [f.select(*key, F.round(value, 9).alias(value)) for f in (own, other)]
        assert sorted(map(str, rounded[0].collect())) == sorted(map(str, rounded[1].collect()))


def test_one_file_of_many_writes_its_own_and_the_concerned_rows(spark, tmp_path):
    store = str(tmp_path / "store")
    files = {("r", f"m{i}.py"): f"def f{i}():\n    return f{(i + 1) % 120}()\n" for i in range(120)}
    ingest_batch(batch(spark, [(r, p, c) for (r, p), c in files.items()]), 0, store, buckets=2)

    def change(number, path, content):
        ingest_batch(batch(spark, [("r", path, content)]), number, store, buckets=2)
        files.pop(("r", path), None)
        if content is not None:
            files["r", path] = content
        return {name: rows_written(spark, store, name, number) for name in ("ir", "nodes", "node_keys", "edges", "edge_keys", "term_counts")}

    # Its body only: its own rows. Its two nodes are the same, so no edge into them is made again.
    written = change(1, "m7.py", "def f7():\n    return f9()\n")
    assert written["nodes"] == 2 and written["edges"] == 2 and written["edge_keys"] == 2
    # The definition moves down a line: the edge of its one caller shows another line.
    assert change(2, "m7.py", "\ndef f7():\n    return f9()\n")["edge_keys"] == 3
    # A second definition of a name: its caller's edge goes.
    written = change(3, "again.py", "def f50():\n    pass\n")
    assert written["edge_keys"] <= 3 and written["edges"] <= 3
    # A file goes: so do its rows, and the edge of its caller.
    written = change(4, "m90.py", None)
    assert written["ir"] == written["nodes"] == written["term_counts"] == 0 and written["node_keys"] == 2
    same_as_analysis(spark, store, files)


def test_what_a_batch_lists_does_not_follow_the_history(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    monkeypatch.setattr(graph_store, "ENTRIES", 2)
    monkeypatch.setattr(ingest, "CHANGES", 2)
    files = {("r", f"m{i}.py"): f"def f{i}():\n    return f{i + 1}()\n" for i in range(12)}
    ingest_batch(batch(spark, [(r, p, c) for (r, p), c in files.items()]), 0, store, buckets=1)
    listed, entries = [], []
    original = graph_store.read_batches
    for number in range(1, 6):
        opened = []
        monkeypatch.setattr(graph_store, "read_batches", lambda s, st, name, batches: opened.extend(batches) or original(s, st, name, batches))
        files["r", "m3.py"] = f"def f3():\n    return f{number}()\n"
        ingest_batch(batch(spark, [("r", "m3.py", files["r", "m3.py"])]), number, store, buckets=1)
        listed.append(len(set(opened)))
        entries.append(sum(map(len, graph_store._manifest_folders(spark, store))))
    monkeypatch.setattr(graph_store, "read_batches", original)
    assert max(listed) <= 1 + 2 + 1 and max(entries) <= 2 + 2
    same_as_analysis(spark, store, files)
    bases = graph_store.live_entries(spark, store).filter("is_base").collect()
    assert len(bases) == 1 and bases[0].batch_id >= 3  # many changes were gathered into a new base


def test_a_repeated_change_replaces_itself(spark, tmp_path):
    store = str(tmp_path / "store")
    files = {("r", f"m{i}.py"): f"def f{i}():\n    return f{i + 1}()\n" for i in range(8)}
    ingest_batch(batch(spark, [(r, p, c) for (r, p), c in files.items()]), 0, store, buckets=1)
    files["r", "m3.py"] = "def f3():\n    return f1()\n"
    for _ in range(2):
        ingest_batch(batch(spark, [("r", "m3.py", files["r", "m3.py"])]), 1, store, buckets=1)
    # Rows of a change that was not finished are not seen.
    graph_store.write_snapshot(spark.createDataFrame([("r", "r:m1")], "repo_id string, uid string"), store, "node_keys", 2, 1)
    same_as_analysis(spark, store, files)
