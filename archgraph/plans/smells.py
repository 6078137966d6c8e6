"""Architectural smells.

Findings are one table with one row per finding; the symbols a finding
affects are a second, flat table, because one call cycle may have any number
of members.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.grading import severity, severity_order
from archgraph.operators.components import strongly_connected_components
from archgraph.operators.topk import top_k
from archgraph.schemas import CALLABLE_TYPES, Graph
from archgraph.session import materialize

# Thresholds for LOW, MEDIUM, HIGH, and how many rows a display shows.
CYCLE_MEMBERS = (2, 3, 5)
CLASS_METHODS = (15, 25, 40)
FUNCTION_LINES = (60, 100, 150)
MEDIUM_SHOWN = 5
AFFECTED_SHOWN = 6
SMELL_TYPES = ("circular_dependency", "god_class", "large_function", "dead_code_candidate")

FINDING = ("repo_id", "smell_type", "severity", "subject", "qualified_name", "metric",
           "title", "explanation", "evidence")
AFFECTED = ("repo_id", "smell_type", "subject", "qualified_name", "file_path", "start_line", "end_line")


class SmellReport(NamedTuple):
    findings: DataFrame
    affected: DataFrame


def _thresholds(steps):
    return "LOW>={}, MEDIUM>={}, HIGH>={}".format(*steps)


def _one_symbol(rows: DataFrame, smell_type, grade, metric, title, why, evidence) -> SmellReport:
    """Findings that affect a single symbol."""
    graded = (
        rows.withColumn("smell_type", F.lit(smell_type)).withColumn("severity", grade)
        .withColumn("subject", F.col("uid")).withColumn("metric", metric.cast("long"))
        .withColumn("title", title).withColumn("explanation", F.lit(why)).withColumn("evidence", evidence)
    )
    return SmellReport(graded.select(*FINDING), graded.select(*AFFECTED))


def call_cycles(graph: Graph) -> DataFrame:
    """Members of call components of two or more symbols: component, uid, size."""
    calls = graph.edges.filter(F.col("relationship_type") == "CALLS")
    members = materialize(strongly_connected_components(calls), "call-components")
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= CYCLE_MEMBERS[0])
    # Written, so that adaptive execution can split the members of a giant component.
    return members.join(materialize(sizes, "component-sizes"), "component")


def circular_dependencies(graph: Graph) -> SmellReport:
    members = call_cycles(graph).withColumn("smell_type", F.lit("circular_dependency"))
    shown = graph.nodes.select("repo_id", "uid", "qualified_name", "file_path", "start_line", "end_line")
    affected = members.withColumnRenamed("component", "subject").join(shown, "uid")
    # The component is named by its least member.
    findings = (
        members.filter(F.col("uid") == F.col("component"))
        .join(shown.select("repo_id", "uid", "qualified_name"), "uid")
        .select(
            "repo_id", "smell_type", severity(F.col("size"), *CYCLE_MEMBERS).alias("severity"),
            F.col("component").alias("subject"), "qualified_name", F.col("size").alias("metric"),
            F.format_string("Call cycle of %d symbols", "size").alias("title"),
            F.lit("Each of these symbols calls the others, directly or through more calls, so none can be "
                  "changed or tested alone.").alias("explanation"),
            F.format_string("One strongly connected component of %d symbols over CALLS edges.", "size")
            .alias("evidence"),
        )
    )
    return SmellReport(findings.select(*FINDING), affected.select(*AFFECTED))


def god_classes(graph: Graph) -> SmellReport:
    counted = (
        graph.edges.filter((F.col("relationship_type") == "CONTAINS") & (F.col("src_type") == "class")
                           & (F.col("dst_type") == "method"))
        .groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("methods"))
        .filter(F.col("methods") >= CLASS_METHODS[0])
    )
    n = F.col("methods")
    return _one_symbol(
        counted.join(graph.nodes, "uid"), "god_class", severity(n, *CLASS_METHODS), n,
        F.format_string("%s has %d methods", "qualified_name", n),
        "A class of so many methods tends to hold several responsibilities.",
        F.format_string("%d methods (" + _thresholds(CLASS_METHODS) + ").", n))


def large_functions(graph: Graph) -> SmellReport:
    n = F.col("end_line") - F.col("start_line")
    rows = graph.nodes.filter(F.col("symbol_type").isin(*CALLABLE_TYPES) & (n >= FUNCTION_LINES[0]))
    return _one_symbol(
        rows, "large_function", severity(n, *FUNCTION_LINES), n,
        F.format_string("%s spans %d lines", "qualified_name", n),
        "A function of this length tends to do several things and is hard to test.",
        F.format_string("%d lines (" + _thresholds(FUNCTION_LINES) + ").", n))


def uncalled(graph: Graph) -> DataFrame:
    """Undecorated functions and methods without a caller, framework hooks aside."""
    # Distinct first: the anti-join could not split a callee that most calls name.
    called = graph.edges.filter(F.col("relationship_type") == "CALLS").select(F.col("dst").alias("uid")).distinct()
    return graph.nodes.filter(
        F.col("symbol_type").isin(*CALLABLE_TYPES)
        & ~F.col("name").startswith("__") & ~F.col("name").startswith("test_")
        & (F.size("decorators") == 0)
    ).join(called, "uid", "left_anti")


def dead_code_candidates(graph: Graph, limit: int | None = None) -> SmellReport:
    """All candidates; with a limit the first of every repository, each with the number of all in ``evidence``."""
    rows, note = uncalled(graph), F.lit("No incoming CALLS edge, no decorator, no framework name.")
    if limit is not None:
        every = materialize(rows.groupBy("repo_id").agg(F.count("*").alias("candidates")), "candidate-counts")
        rows = top_k(rows, ["repo_id"], [F.col("qualified_name"), F.col("uid")], limit).join(every, "repo_id")
        note = F.concat(note, F.format_string(" One of %d in the repository.", "candidates"))
    return _one_symbol(
        rows, "dead_code_candidate", F.lit("LOW"), F.lit(0),
        F.format_string("%s has no known caller", "qualified_name"),
        "No call in the repository reaches this symbol. Dynamic calls and callers elsewhere are not seen, "
        "so this is a hint and no proof.",
        note)


def detect_smells(graph: Graph) -> SmellReport:
    parts = [circular_dependencies(graph), god_classes(graph), large_functions(graph), dead_code_candidates(graph)]
    findings, affected = parts[0]
    for part in parts[1:]:
        findings, affected = findings.unionByName(part.findings), affected.unionByName(part.affected)
    return SmellReport(findings, affected)


def report_order():
    """Severity first, then kind of smell, then size."""
    kinds = F.array(*[F.lit(s) for s in SMELL_TYPES])
    return [severity_order(F.col("severity")), F.array_position(kinds, F.col("smell_type")),
            F.col("metric").desc(), F.col("qualified_name"), F.col("subject")]


def ordered_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("repo_id", *report_order())


def top_findings(findings: DataFrame, medium_shown: int = MEDIUM_SHOWN) -> DataFrame:
    """All HIGH findings and the first MEDIUM ones of every repository."""
    high = findings.filter(F.col("severity") == "HIGH")
    medium = top_k(findings.filter(F.col("severity") == "MEDIUM"), ["repo_id"], report_order(), medium_shown)
    return high.unionByName(medium.drop("rank"))


def hidden_findings(findings: DataFrame, medium_shown: int = MEDIUM_SHOWN, repositories: DataFrame | None = None) -> DataFrame:
    """Per repository: findings in all, and how many top_findings leaves out; 0 for those of ``repositories`` without any."""
    counted = findings.groupBy("repo_id").agg(
        F.count("*").alias("total"),
        (F.count_if(F.col("severity") == "LOW")
         + F.greatest(F.count_if(F.col("severity") == "MEDIUM") - medium_shown, F.lit(0))).alias("hidden"),
    )
    if repositories is None:
        return counted
    return repositories.select("repo_id").distinct().join(counted, "repo_id", "left").fillna(0, ["total", "hidden"])


def affected_preview(affected: DataFrame, shown: int = AFFECTED_SHOWN) -> DataFrame:
    """The first affected symbols of every finding and how many more there are."""
    keys = ["repo_id", "smell_type", "subject"]
    order = [F.col("qualified_name"), F.col("file_path"), F.col("start_line"), F.col("end_line")]
    first = (
        top_k(affected, keys, order, shown).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "qualified_name", "file_path", "start_line")))
             .alias("symbols"))
    )
    counted = affected.groupBy(*keys).agg(F.count("*").alias("total"))
    return first.join(counted, keys).withColumn("more", F.greatest(F.col("total") - shown, F.lit(0)))
