"""Change-impact reports for a table of targets."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archgraph.functions.classify import (
    SERVICE_SUFFIXES, classify_import, is_api_endpoint, is_service_component, is_test,
)
from archgraph.functions.text import first_segment
from archgraph.operators.degrees import counted_degrees, degrees
from archgraph.operators.reach import dependents
from archgraph.operators.topk import top_k
from archgraph.schemas import Graph
from archgraph.session import materialize

# Degree from which a target counts as central.
CENTRAL_DEGREE = 15
# Names quoted in the explanation, dependents shown in a panel.
NAMES_QUOTED = 5
DEPENDENTS_SHOWN = 8


class ImpactReport(NamedTuple):
    summary: DataFrame  # one row per target
    dependents: DataFrame  # one row per (target, dependent), with depth and flags
    external_dependencies: DataFrame  # target_uid, name, category


def find_targets(graph: Graph, targets: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Targets (repo_id, uid) with their own columns and degree; ``found`` is false for unknown ones.

    With ``counts`` (a store's ``read_degrees``) degrees are not counted from the edges.
    """
    asked = targets.select("repo_id", F.col("uid").alias("target_uid")).distinct()
    own = graph.nodes.select(
        "repo_id", F.col("uid").alias("target_uid"), F.col("qualified_name").alias("target_qualified_name"),
        F.col("symbol_type").alias("target_symbol_type"), F.col("file_path").alias("target_file_path"))
    every = degrees(graph.edges, only=targets) if counts is None else counted_degrees(counts, only=targets)
    counted = every.select(F.col("uid").alias("target_uid"), "degree")
    return (
        asked.join(own, ["repo_id", "target_uid"], "left")
        .join(counted, "target_uid", "left")
        .withColumn("found", F.col("target_qualified_name").isNotNull())
        .withColumn("degree", F.when(F.col("found"), F.coalesce("degree", F.lit(0))))
    )


def described_dependents(graph: Graph, found: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Dependents of the found targets with their columns and classification."""
    reached = dependents(graph.edges, found.select("repo_id", F.col("target_uid").alias("uid")), max_depth)
    shown = graph.nodes.select("repo_id", "uid", "symbol_type", "name", "qualified_name", "file_path",
                               "start_line", "end_line", "decorators")
    return (
        reached.join(shown, "uid")
        .withColumn("is_api", is_api_endpoint(F.col("decorators")))
        .withColumn("is_service", is_service_component(F.col("qualified_name"), F.col("symbol_type")))
        .withColumn("is_test", is_test(F.col("file_path"), F.col("name")))
        .drop("decorators")
    )


def external_dependencies(nodes: DataFrame, found: DataFrame, stdlib=None) -> DataFrame:
    """Distinct third-party packages imported in each target's own file."""
    own_files = found.select("repo_id", "target_uid", F.col("target_file_path").alias("file_path"))
    per_file = (
        nodes.filter(F.col("symbol_type") == "import")
        .join(own_files.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
        .select("repo_id", "file_path", first_segment(F.col("name")).alias("package"),
                classify_import(F.col("name"), stdlib).alias("category"))
        .filter(F.col("category").isNotNull())
        .distinct()
    )
    return per_file.join(own_files, ["repo_id", "file_path"]).select("repo_id", "target_uid", "package", "category")


def risk_signals(total: Column, apis: Column, services: Column, tests: Column, external: Column,
                 degree: Column) -> Column:
    """Array of (name, value, points); the names and value formats are fixed values."""

    def signal(name, value, points):
        return F.struct(F.lit(name).alias("name"), value.alias("value"),
                        (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points"))

    bucket = (
        F.when(total == 0, "0").when(total <= 3, "1-3").when(total <= 10, "4-10")
        .when(total <= 25, "11-25").otherwise(">25")
    )
    bucket_points = F.when(total == 0, 0).when(total <= 3, 1).when(total <= 10, 2).when(total <= 25, 3).otherwise(4)
    return F.array_compact(F.array(
        signal("Total dependents", F.format_string("%d (%s)", total, bucket), bucket_points),
        F.when(apis > 0, signal("Affects API endpoints", apis.cast("string"), 2)),
        F.when(services > 0, signal("Affects service-layer components", services.cast("string"), 1)),
        F.when((total > 0) & (tests == 0), signal("Test coverage of dependents", F.lit("none found"), 2))
        .when(total > 0, signal("Test coverage of dependents", F.format_string("%d test(s) found", tests), 0)),
        F.when(external > 0, signal("Touches external dependencies", external.cast("string"), 1)),
        F.when(degree >= CENTRAL_DEGREE,
               signal("Graph centrality of target", F.format_string("degree %d (>=15)", degree), 1)),
    ))


def risk_score(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0), lambda total, s: total + s["points"])


def risk_level(score: Column) -> Column:
    return F.when(score >= 8, "CRITICAL").when(score >= 5, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")


def explanation(name: Column, direct: Column, indirect: Column, apis: Column, services: Column, tests: Column,
                external_names: Column, degree: Column, level: Column) -> Column:
    """A sentence per aspect that applies; aspects that do not apply give null and vanish."""
    total = direct + indirect
    text = F.format_string
    footprint = (
        F.when(total == 0, text("No symbol of the repository depends on %s.", name))
        .when(total > 25, text("%s carries much of the repository: %d dependents, %d direct and %d indirect.",
                               name, total, direct, indirect))
        .when(total > 10, text("%s has %d dependents, %d direct and %d indirect, in more than one place.",
                               name, total, direct, indirect))
        .otherwise(text("%s has few dependents: %d, of which %d direct and %d indirect.",
                        name, total, direct, indirect))
    )
    exposure = (
        F.when(apis > 0, text("API endpoints among them: %d; callers outside would notice a fault.", apis))
        .when(services > 0, text("Service components among them: %d; no endpoint is reached directly.", services))
        .when(total > 0, F.lit("Neither endpoints nor service components are among them."))
    )
    cover = (
        F.when((total > 0) & (tests == 0), F.lit("No test is among them, so a fault may pass unseen."))
        .when((total > 0) & (tests >= total), text("Tests among them: %d, which covers all.", tests))
        .when(tests > 0, text("Tests among them: %d of %d, which covers a part.", tests, total))
    )
    packages = F.when(F.size(external_names) > 0, text(
        "The file itself uses outside packages (%s).",
        F.array_join(F.slice(external_names, 1, NAMES_QUOTED), ", ")))
    central = F.when((degree >= CENTRAL_DEGREE) & (total <= 10), text(
        "Its %d edges make it central beyond that count.", degree))
    verdict = text("Overall risk: %s.", level)
    return F.concat_ws(" ", footprint, exposure, cover, packages, central, verdict)


def detection_notes(max_depth: int | None = None) -> list[str]:
    notes = [
        "Endpoints are recognised by their decorators; request routing is not followed.",
        f"Service components are recognised by name endings: {', '.join(SERVICE_SUFFIXES)}.",
    ]
    if max_depth is not None:
        notes.append(f"Dependents more than {max_depth} edges away are not counted.")
    return notes


def impact_report(graph: Graph, targets: DataFrame, max_depth: int | None = None, stdlib=None) -> ImpactReport:
    """Reports of all targets (repo_id, uid). An unknown target gives a row with found = false.

    The full lists are flat tables; the summary row holds counts, the risk
    and the first names only, so its size does not grow with the lists.
    """
    located = materialize(find_targets(graph, targets), "impact-targets")
    found = located.filter("found")
    affected = described_dependents(graph, found, max_depth)
    external = external_dependencies(graph.nodes, found, stdlib)
    counts = affected.groupBy("target_uid").agg(
        F.count_if(F.col("depth") == 1).alias("direct_count"),
        F.count_if(F.col("depth") > 1).alias("indirect_count"),
        F.count_if("is_api").alias("affected_apis"),
        F.count_if("is_service").alias("affected_services"),
        F.count_if("is_test").alias("affected_tests"),
    )
    n_external = external.groupBy("target_uid").agg(F.count("*").alias("external_count"))
    quoted = (
        top_k(external, ["target_uid"], [F.col("package")], NAMES_QUOTED)
        .groupBy("target_uid").agg(F.array_sort(F.collect_list("package")).alias("external_names"))
    )
    zero = {c: 0 for c in counts.columns[1:]} | {"external_count": 0}
    rows = (
        located.join(counts, "target_uid", "left").join(n_external, "target_uid", "left")
        .join(quoted, "target_uid", "left").fillna(zero)
        .withColumn("external_names", F.coalesce("external_names", F.array().cast("array<string>")))
    )
    c = F.col
    total = c("direct_count") + c("indirect_count")
    summary = (
        rows.withColumn("risk_signals", F.when(c("found"), risk_signals(
            total, c("affected_apis"), c("affected_services"), c("affected_tests"), c("external_count"), c("degree"))))
        .withColumn("risk_score", risk_score(c("risk_signals")))
        .withColumn("risk_level", F.when(c("found"), risk_level(c("risk_score"))))
        .withColumn("explanation", F.when(c("found"), explanation(
            c("target_qualified_name"), c("direct_count"), c("indirect_count"), c("affected_apis"),
            c("affected_services"), c("affected_tests"), c("external_names"), c("degree"), c("risk_level"))))
        .withColumn("detection_notes", F.array(*[F.lit(n) for n in detection_notes(max_depth)]))
    )
    return ImpactReport(summary, affected, external)


def dependents_preview(affected: DataFrame, shown: int = DEPENDENTS_SHOWN) -> DataFrame:
    """The first dependents of every target, nearest first, and how many more there are."""
    order = [F.col("depth"), F.col("qualified_name"), F.col("uid")]
    first = (
        top_k(affected, ["target_uid"], order, shown)
        .groupBy("target_uid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "qualified_name", "file_path", "start_line", "depth")))
             .alias("dependents"))
    )
    counted = affected.groupBy("target_uid").agg(F.count("*").alias("total"))
    return first.join(counted, "target_uid").withColumn("more", F.greatest(F.col("total") - shown, F.lit(0)))
