"""Linking raw target names to symbols of the same repository."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import last_segment
from archgraph.schemas import DEFINITION_TYPES
from archgraph.session import materialize

# Confidence of a link by the rule that made it.
EXACT = 0.95
BY_SHORT_NAME = 0.75
AMBIGUOUS = 0.3
EXTERNAL_AT_MOST = 0.35


def name_links(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """For distinct (repo_id, target_name): the exact match and the short-name candidates."""
    exact = symbols.groupBy("repo_id", F.col("qualified_name").alias("target_name")).agg(
        F.max_by("id", F.struct("file_path", "seq")).alias("exact_id")
    )
    by_name = materialize(
        symbols.filter(F.col("symbol_type").isin(*DEFINITION_TYPES))
        .groupBy("repo_id", F.col("name").alias("short_name"))
        .agg(F.count("*").alias("candidates"), F.min("id").alias("candidate_id")),
        "short-names",
    )
    return (
        names.join(exact, ["repo_id", "target_name"], "left")
        .withColumn("short_name", last_segment(F.col("target_name")))
        .join(by_name, ["repo_id", "short_name"], "left")
        .select("repo_id", "target_name", "exact_id", "candidate_id",
                F.coalesce("candidates", F.lit(0)).alias("candidates"))
    )


def resolve_relationships(symbols: DataFrame, relationships: DataFrame) -> DataFrame:
    """Fill target_id and confidence of the relationships that have no target yet.

    The names are linked once per distinct (repository, name), after a
    map-side distinct, so a name used by a third of all rows is looked up
    once. Only the last join carries whole rows; its other side is a written
    table with one row per key, so the adaptive skew join can split a hot name
    there. The same holds for a short name that many distinct names end in.
    Rows that are resolved already are not shuffled.
    """
    columns = relationships.columns
    is_open = F.col("target_id").isNull()
    open_rows = relationships.filter(is_open)
    links = materialize(name_links(symbols, open_rows.select("repo_id", "target_name").distinct()), "name-links")
    target = (
        F.when(F.col("exact_id").isNotNull(), F.col("exact_id"))
        .when(F.col("candidates") == 1, F.col("candidate_id"))
    )
    confidence = (
        F.when(F.col("exact_id").isNotNull(), F.lit(EXACT))
        .when(F.col("candidates") == 1, F.lit(BY_SHORT_NAME))
        .when(F.col("candidates") > 1, F.lit(AMBIGUOUS))
        .otherwise(F.least(F.col("confidence"), F.lit(EXTERNAL_AT_MOST)))
    )
    linked = (
        open_rows.join(links, ["repo_id", "target_name"], "left")
        .withColumn("target_id", target)
        .withColumn("confidence", confidence)
    )
    return relationships.filter(~is_open).unionByName(linked.select(*columns))
