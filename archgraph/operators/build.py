"""Nodes and edges of the repository graph."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import symbol_uid
from archgraph.schemas import EDGES, REPOSITORY_NODE


def build_nodes(symbols: DataFrame) -> DataFrame:
    """One row per uid; of several symbols with one uid the last one counts."""
    rest = [c for c in symbols.columns if c != "uid"]
    return (
        symbols.groupBy("uid")
        .agg(F.max_by(F.struct(*rest), F.struct("file_path", "seq")).alias("last"))
        .select("uid", "last.*")
        .select(*symbols.columns)
    )


def build_edges(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved relationships between known nodes, and repository-to-file edges."""
    return relationship_edges(nodes, resolved).unionByName(repository_edges(nodes))


def relationship_edges(nodes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Resolved relationships between known nodes.

    An edge is (source, type, target, line); of several the last one's file
    and confidence count. Both joins have one row per key on the node side.
    """
    src, dst = symbol_uid(F.col("repo_id"), F.col("source_id")), symbol_uid(F.col("repo_id"), F.col("target_id"))
    keyed = (
        resolved.filter(F.col("target_id").isNotNull())
        .select("repo_id", src.alias("src"), dst.alias("dst"),
                F.upper("relationship_type").alias("relationship_type"),
                "source_line", "source_file", "confidence", "seq")
        .groupBy("repo_id", "src", "dst", "relationship_type", "source_line")
        .agg(F.max_by(F.struct("source_file", "confidence"), F.struct("source_file", "seq")).alias("last"))
        .select("repo_id", "src", "dst", "relationship_type", "last.source_file", "source_line",
                "last.confidence")
    )

    def ends(side):
        return nodes.select(
            F.col("uid").alias(side), F.col("symbol_type").alias(f"{side}_type"),
            F.col("qualified_name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_path"),
            F.col("start_line").alias(f"{side}_start"),
        )

    return keyed.join(ends("src"), "src").join(ends("dst"), "dst").select(*EDGES.fieldNames())


def repository_edges(nodes: DataFrame) -> DataFrame:
    """The edge from a repository to each of its files: columns of the file's node, no join."""
    return nodes.filter(F.col("symbol_type") == "file").select(
        "repo_id", F.col("repo_id").alias("src"), F.col("uid").alias("dst"),
        F.lit("CONTAINS").alias("relationship_type"), F.lit(None).cast("string").alias("source_file"),
        F.lit(None).cast("int").alias("source_line"), F.lit(None).cast("double").alias("confidence"),
        F.lit(REPOSITORY_NODE).alias("src_type"), F.col("repo_id").alias("src_name"),
        F.lit(None).cast("string").alias("src_path"), F.lit(None).cast("int").alias("src_start"),
        F.col("symbol_type").alias("dst_type"), F.col("qualified_name").alias("dst_name"),
        F.col("file_path").alias("dst_path"), F.col("start_line").alias("dst_start"),
    ).select(*EDGES.fieldNames())


def graph_counts(symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """Symbols before de-duplication and resolved relationships, per repository."""
    n_symbols = symbols.groupBy("repo_id").agg(F.count("*").alias("symbol_count"))
    n_edges = resolved.groupBy("repo_id").agg(F.count("target_id").alias("relationship_count"))
    return n_symbols.join(n_edges, "repo_id", "left").fillna(0, ["relationship_count"])


def unique_violations(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)
