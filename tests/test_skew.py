"""Hot keys: plans that split or prune them, and whole results."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from archgraph.operators.build import build_edges, build_nodes
from archgraph.operators.components import _trim
from archgraph.operators.degrees import degrees, neighbourhood, ranked_by_degree
from archgraph.operators.resolve import resolve_relationships
from archgraph.plans import smells
from archgraph.plans.smells import uncalled
from archgraph.schemas import RELATIONSHIPS, SYMBOLS, Graph
from archgraph.session import materialize
from archgraph.sources.files import accepted_files
from archgraph.sources.repositories import only_ready

SYMBOL_COUNT, CALLS = 3_000, 120_000


@contextmanager
def small_skew_limits(spark):
    """Adaptive execution as on a cluster, at the sizes of a test."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    """One repository where a third of all calls name the same function."""
    i = F.col("id")
    name = F.concat(F.lit("f"), i)
    qualified = F.concat(F.lit("m"), i % 40, F.lit("."), name)
    columns = {
        "repo_id": F.lit("r"), "uid": F.concat(F.lit("r:"), qualified), "id": qualified, "seq": i.cast("int"), "name": name,
        "qualified_name": qualified, "symbol_type": F.lit("function"), "file_path": F.concat(F.lit("m"), i % 40, F.lit(".py")),
        "start_line": F.lit(1), "end_line": F.lit(2), "language": F.lit("python"),
        "decorators": F.array().cast("array<string>"), "docstring": F.lit(None).cast("string")}
    symbols = materialize(spark.range(SYMBOL_COUNT).select(
        *[columns[c].alias(c) for c in SYMBOLS.fieldNames()]), "hot-symbols")
    source, target = (i * 7) % SYMBOL_COUNT, F.when(i % 3 == 0, 0).otherwise((i * 31 + 1) % SYMBOL_COUNT)
    columns = {
        "repo_id": F.lit("r"), "seq": i.cast("int"), "source_id": F.concat(F.lit("m"), source % 40, F.lit(".f"), source),
        "target_id": F.lit(None).cast("string"), "target_name": F.concat(F.lit("self.f"), target),
        "relationship_type": F.lit("calls"), "source_file": F.concat(F.lit("m"), source % 40, F.lit(".py")),
        "source_line": i.cast("int"), "confidence": F.lit(0.5)}
    relationships = materialize(spark.range(CALLS).select(
        *[columns[c].alias(c) for c in RELATIONSHIPS.fieldNames()]), "hot-relationships")
    return symbols, relationships


@pytest.fixture(scope="module")
def hot_graph(hot):
    symbols, relationships = hot
    nodes = materialize(build_nodes(symbols), "hot-nodes")
    return Graph(nodes, materialize(build_edges(nodes, resolve_relationships(symbols, relationships)), "hot-edges"))


def final_plan(df):
    rows = df.collect()
    return len(rows), df._jdf.queryExecution().executedPlan().toString()


def test_resolution_splits_a_hot_name(spark, hot):
    with small_skew_limits(spark):
        n, plan = final_plan(resolve_relationships(*hot).select("target_id", "confidence", "source_file"))
    assert n == CALLS
    assert "skew=true" in plan


def test_edges_split_a_hot_target(spark, hot):
    symbols, relationships = hot
    nodes = materialize(build_nodes(symbols), "hot-nodes")
    resolved = materialize(resolve_relationships(symbols, relationships), "hot-resolved")
    with small_skew_limits(spark):
        n, plan = final_plan(build_edges(nodes, resolved))
    assert n == CALLS
    assert "skew=true" in plan


def test_neighbourhood_of_a_hub_is_pruned_before_its_shuffle(spark, hot_graph):
    with small_skew_limits(spark):
        related = neighbourhood(hot_graph.edges, hot_graph.nodes)
        n, plan = final_plan(related.filter("uid = 'r:m0.f0'"))
    assert n == 8 + 5
    assert "WindowGroupLimit" in plan and "_part" in plan


def test_rank_within_a_hot_repository_is_pruned_in_map_tasks(spark, hot_graph):
    with small_skew_limits(spark):
        n, plan = final_plan(ranked_by_degree(hot_graph.edges, ("function",), 10))
    assert n == 10
    assert "Partial" in plan and plan.count("WindowGroupLimit") >= 2


def test_a_hot_callee_is_reduced_before_the_anti_join(hot_graph):
    called = {r.dst for r in hot_graph.edges.filter("relationship_type = 'CALLS'").select("dst").distinct().collect()}
    assert uncalled(hot_graph).count() == SYMBOL_COUNT - len(called)


def test_edges_of_a_hub_are_counted_before_the_join_with_what_is_asked(spark, hot_graph):
    asked = hot_graph.nodes.select("uid").union(hot_graph.nodes.select("uid"))
    with small_skew_limits(spark):
        found = degrees(hot_graph.edges, only=asked)
        n, plan = final_plan(found)
    assert n == degrees(hot_graph.edges).count()
    assert plan.index("Join") < plan.index("HashAggregate(keys=[repo_id")


@pytest.fixture(scope="module")
def large_repository(spark):
    """Files of which two in three belong to one repository."""
    repo = F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("r"), F.col("id") % 40))
    return materialize(spark.range(60_000).select(
        repo.alias("repo_id"), F.concat(F.lit("f"), "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("content")), "hot-files")


def test_files_of_a_large_repository_are_split(spark, large_repository):
    verdicts = large_repository.groupBy("repo_id").agg(F.lit(None).cast("string").alias("reject_reason"))
    with small_skew_limits(spark):
        n, plan = final_plan(accepted_files(large_repository, verdicts))
        assert n == 60_000 and "skew=true" in plan
        n, plan = final_plan(only_ready(large_repository, large_repository.groupBy("repo_id").agg(F.lit("ready").alias("status"))))
        assert n == 60_000 and "skew=true" in plan


def test_members_of_a_giant_component_are_split(spark, monkeypatch):
    members = materialize(spark.range(60_000).select(
        F.when(F.col("id") % 3 < 2, "c").otherwise(F.concat(F.lit("c"), F.col("id") % 40)).alias("component"),
        F.sha2(F.col("id").cast("string"), 256).alias("uid")), "hot-members")
    monkeypatch.setattr(smells, "strongly_connected_components", lambda _: members)
    edges = spark.createDataFrame([], "relationship_type string")
    with small_skew_limits(spark):
        n, plan = final_plan(smells.call_cycles(Graph(None, edges)))
    assert n == 60_000 and "skew=true" in plan


def test_arcs_of_a_popular_vertex_are_trimmed_alike(spark):
    hub = F.when(F.col("id") % 3 < 2, F.lit(-1)).otherwise(F.col("id") % 5_000)
    arcs = materialize(spark.range(200_000).select((F.col("id") % 5_000).alias("a"), hub.alias("b")), "hot-arcs")
    with small_skew_limits(spark):
        kept, left = _trim(arcs, arcs.count())
    assert left == kept.count() == arcs.filter("b <> -1").count()
