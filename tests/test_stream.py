"""Files that arrive in several batches give the graph of all of them."""

import os
import time

from pyspark.sql import functions as F

from archgraph.plans.ask import read_index
from archgraph.plans.graph import analyze_files
from archgraph.schemas import SOURCE_FILES
from archgraph.sources import graph_store, repositories
from archgraph.streaming.ingest import ingest_batch, stream_ingest

HELPER = "def helper(x):\n    return x\n"
USER = "from lib import helper\n\ndef use():\n    return helper(1)\n"


def land(spark, folder, *rows):
    frame = spark.createDataFrame([(r, p, len(c), c) for r, p, c in rows], SOURCE_FILES)
    frame.coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.01)


def test_stream(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")

    def run():
        stream_ingest(spark, landing, store, str(tmp_path / "progress"), buckets=2).awaitTermination()
        return graph_store.read_graph(spark, store)

    def calls(graph):
        return {(e.src, e.dst) for e in graph.edges.filter("relationship_type = 'CALLS'").collect()}

    land(spark, landing, ("a", "use.py", USER), ("b", "lib.py", HELPER))
    assert calls(run()) == set()

    # The name now resolves, in a file that did not arrive again.
    land(spark, landing, ("a", "lib.py", HELPER))
    graph = run()
    assert calls(graph) == {("a:use.use", "a:lib.helper")}
    assert graph.nodes.filter("repo_id = 'b'").count() == 2

    # A second helper makes it ambiguous.
    land(spark, landing, ("a", "more.py", HELPER))
    assert calls(run()) == set()

    # A new version of a file replaces the old one, also within one landed file; a broken file is recorded.
    land(spark, landing, ("a", "more.py", HELPER), ("a", "more.py", "x = 1\n"), ("c", "bad.py", "def f(:\n"))
    graph = run()
    assert calls(graph) == {("a:use.use", "a:lib.helper")}

    everything = spark.createDataFrame(
        [(r, p, len(c), c) for r, p, c in [("a", "use.py", USER), ("a", "lib.py", HELPER), ("b", "lib.py", HELPER),
                                           ("a", "more.py", "x = 1\n"), ("c", "bad.py", "def f(:\n")]], SOURCE_FILES)
    expected = analyze_files(everything).graph
    assert sorted(graph.nodes.drop("seq").collect()) == sorted(expected.nodes.drop("seq").collect())
    assert {tuple(e) for e in graph.edges.collect()} == {tuple(e) for e in expected.edges.collect()}

    latest = {r.repo_id: r for r in repositories.latest_status(graph_store.read_status(spark, store)).collect()}
    assert {r: (s.status, s.file_count) for r, s in latest.items()} == {
        "a": ("ready", 3), "b": ("ready", 1), "c": ("ready", 1)}
    assert run().nodes.count() == expected.nodes.count()  # nothing new, nothing changed


def folders(spark):
    from archgraph.session import shared_folder

    path = shared_folder(spark).removeprefix("file:")
    return set(os.listdir(path))


def test_removed_files_index_and_folders(spark, tmp_path):
    landing, store = str(tmp_path / "landing"), str(tmp_path / "store")

    def run():
        stream_ingest(spark, landing, store, str(tmp_path / "progress"), buckets=2).awaitTermination()

    land(spark, landing, ("a", "use.py", USER), ("a", "lib.py", HELPER), ("b", "lib.py", HELPER))
    before = folders(spark)
    run()
    assert folders(spark) == before  # intermediate tables go with their batch
    frame = spark.createDataFrame([("a", "lib.py", 0, None)], SOURCE_FILES)
    frame.coalesce(1).write.mode("append").parquet(landing)
    run()
    graph = graph_store.read_graph(spark, store)
    assert {r.uid for r in graph.nodes.collect()} == {"a:use", "a:use.use", "a:use.py::import::lib.helper::0", "b:lib", "b:lib.helper"}
    assert graph.edges.filter("relationship_type = 'CALLS'").isEmpty()
    index = read_index(spark, store, ["a"])
    assert {r.symbol_uid for r in index.documents.collect()} == {"a:use", "a:use.use"}
    assert index.terms.weights.filter("repo_id <> 'a'").isEmpty()
    statuses = {r.status for r in graph_store.read_status(spark, store).collect()}
    assert statuses == {"parsing", "building_graph", "embedding", "ready"}
    land(spark, landing, ("b", "lib.py", USER))
    run()
    assert graph_store.remove_superseded(spark, store) == 1
    assert {r.repo_id for r in graph_store.read_graph(spark, store).nodes.collect()} == {"a", "b"}
    assert graph_store.store_buckets(spark, store, 64) == 2


def test_failed_batch_is_recorded_and_can_be_repeated(spark, tmp_path, monkeypatch):
    from archgraph.streaming import ingest

    store = str(tmp_path / "store")
    batch = spark.createDataFrame([("a", "lib.py", 1, HELPER)], SOURCE_FILES).withColumn(
        "landed", F.struct(F.current_timestamp().alias("at"), F.lit("f").alias("file"), F.lit(0).alias("row")))

    def broken(*_):
        raise RuntimeError("no room")

    with monkeypatch.context() as patch:
        patch.setattr(ingest, "link_graph", broken)
        try:
            ingest_batch(batch, 0, store, buckets=2)
            raise AssertionError("the failure was swallowed")
        except RuntimeError:
            pass
    row = repositories.latest_status(graph_store.read_status(spark, store)).first()
    assert row.status == "failed" and "no room" in row.error
    ingest_batch(batch, 0, store, buckets=2)
    row = repositories.latest_status(graph_store.read_status(spark, store)).first()
    assert row.status == "ready"
    assert graph_store.read_graph(spark, store).nodes.count() == 2
