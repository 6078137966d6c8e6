"""File-level and class-level graph views."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import is_test_path
from archgraph.operators.degrees import ranked_by_degree
from archgraph.operators.topk import top_k
from archgraph.schemas import CALLABLE_TYPES
from archgraph.session import materialize

# Default node limits.
FILE_LIMIT = 60
CLASS_LIMIT = 100


class GraphView(NamedTuple):
    nodes: DataFrame  # repo_id, uid, symbol_type, name, qualified_name, file_path, lines, degree
    edges: DataFrame  # repo_id, source_uid, target_uid, relationship_type, weight
    truncated: DataFrame  # repo_id, truncated


_SHOWN = ("uid", "symbol_type", "name", "qualified_name", "file_path", "start_line", "end_line")


def file_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls between different non-test files, counted per (source file, target file)."""
    files = nodes.filter((F.col("symbol_type") == "file") & ~is_test_path(F.col("file_path")))
    counted = (
        edges.filter(
            (F.col("relationship_type") == "CALLS")
            & F.col("src_type").isin(*CALLABLE_TYPES) & F.col("dst_type").isin(*CALLABLE_TYPES)
            & (F.col("src_path") != F.col("dst_path"))
            & ~is_test_path(F.col("src_path")) & ~is_test_path(F.col("dst_path"))
        )
        .groupBy("repo_id", "src_path", "dst_path")
        .agg(F.count("*").alias("weight"))
    )
    # One file symbol per path.
    by_path = files.groupBy("repo_id", "file_path").agg(F.max("uid").alias("uid"))
    sources = by_path.select("repo_id", F.col("file_path").alias("src_path"), F.col("uid").alias("source_uid"))
    targets = by_path.select("repo_id", F.col("file_path").alias("dst_path"), F.col("uid").alias("target_uid"))
    return counted.join(sources, ["repo_id", "src_path"]).join(targets, ["repo_id", "dst_path"])


def file_view(nodes: DataFrame, edges: DataFrame, limit: int = FILE_LIMIT) -> GraphView:
    # Degrees, ranks and edges all read the pairs, which are few beside the calls.
    pairs = materialize(file_pairs(nodes, edges), "file-pairs")
    touched = (
        pairs.select("repo_id", F.explode(F.array(
            F.struct(F.col("source_uid").alias("uid"), F.col("src_path").alias("file_path")),
            F.struct(F.col("target_uid").alias("uid"), F.col("dst_path").alias("file_path")),
        )).alias("end"))
        .groupBy("repo_id", F.col("end.uid").alias("uid"), F.col("end.file_path").alias("file_path"))
        .agg(F.count("*").alias("degree"))
    )
    best = top_k(touched, ["repo_id"], [F.col("degree").desc(), F.col("file_path")], limit)
    shown = best.select("repo_id", "uid", "degree").join(nodes.select(*_SHOWN), "uid")
    used = _induced(pairs, best, "source_uid", "target_uid").select(
        "repo_id", "source_uid", "target_uid", F.lit("USES").alias("relationship_type"),
        F.col("weight").cast("double").alias("weight"))
    truncated = _per_repository(nodes, touched.groupBy("repo_id").agg((F.count("*") > limit).alias("truncated")))
    return GraphView(shown, used, truncated)


def class_view(nodes: DataFrame, edges: DataFrame, limit: int = CLASS_LIMIT) -> GraphView:
    best = materialize(ranked_by_degree(edges, ("file", "class"), limit), "class-view")
    shown = best.select("repo_id", "uid", "degree").join(nodes.select(*_SHOWN), "uid")
    plain = edges.filter(
        ((F.col("relationship_type") == "CONTAINS") & (F.col("src_type") == "file") & (F.col("dst_type") == "class"))
        | ((F.col("relationship_type") == "INHERITS") & (F.col("src_type") == "class") & (F.col("dst_type") == "class"))
    )
    structure = _induced(plain, best, "src", "dst").select(
        "repo_id", F.col("src").alias("source_uid"), F.col("dst").alias("target_uid"),
        "relationship_type", F.lit(1.0).alias("weight"))
    view_edges = structure.unionByName(class_uses(edges, best))
    truncated = _per_repository(nodes, best.groupBy("repo_id").agg((F.count("*") >= limit).alias("truncated")))
    return GraphView(shown, view_edges, truncated)


def class_uses(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """Paths class - method - called method - other class, counted per pair of classes.

    Only members of the selected classes are kept, one row per (class,
    method) with the number of its edges; a call adds the product of both.
    """
    calls = edges.filter((F.col("relationship_type") == "CALLS")
                         & (F.col("src_type") == "method") & (F.col("dst_type") == "method")).select("src", "dst")
    members = (
        edges.filter((F.col("relationship_type") == "CONTAINS")
                     & (F.col("src_type") == "class") & (F.col("dst_type") == "method"))
        .join(classes.select(F.col("uid").alias("src")), "src", "left_semi")
        .groupBy("repo_id", F.col("src").alias("class_uid"), F.col("dst").alias("method_uid"))
        .agg(F.count("*").alias("links"))
    )
    callers = members.select("repo_id", F.col("class_uid").alias("source_uid"),
                             F.col("method_uid").alias("src"), F.col("links").alias("src_links"))
    callees = members.select(F.col("class_uid").alias("target_uid"),
                             F.col("method_uid").alias("dst"), F.col("links").alias("dst_links"))
    return (
        calls.join(callers, "src").join(callees, "dst")
        .filter(F.col("source_uid") != F.col("target_uid"))
        .groupBy("repo_id", "source_uid", "target_uid")
        .agg(F.sum(F.col("src_links") * F.col("dst_links")).cast("double").alias("weight"))
        .select("repo_id", "source_uid", "target_uid", F.lit("USES").alias("relationship_type"), "weight")
    )


def _per_repository(nodes: DataFrame, truncated: DataFrame) -> DataFrame:
    """A row for every repository; one without content is not truncated."""
    return nodes.select("repo_id").distinct().join(truncated, "repo_id", "left").fillna(False, ["truncated"])


def _induced(edges: DataFrame, selected: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges whose two ends are both selected."""
    return (
        edges.join(selected.select(F.col("uid").alias(src)), src, "left_semi")
        .join(selected.select(F.col("uid").alias(dst)), dst, "left_semi")
    )
