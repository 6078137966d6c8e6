"""Degrees, starting points and neighbourhoods.

Degrees are counted from edges, or read from a table of counts by symbol and
kind of edge that is kept up to date by signed differences (``edge_counts``).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import is_test_path
from archgraph.operators.topk import top_k
from archgraph.schemas import DEFINITION_TYPES, REPOSITORY_NODE
from archgraph.session import materialize

# Default numbers of rows.
SUGGESTION_LIMIT = 6
OUTGOING_LIMIT = 8
INCOMING_LIMIT = 5

# Edges that a task sorts by symbol, about.
EDGES_PER_TASK = 100_000

COUNTED = ["repo_id", "uid", "symbol_type", "file_path", "relationship_type"]


def incidences(edges: DataFrame, types=None) -> DataFrame:
    """One row per edge and end (repo_id, relationship_type, uid, symbol_type, file_path); a self-loop gives one."""
    wanted = edges if types is None else edges.filter(F.col("relationship_type").isin(*types))

    def end(side):
        return F.struct(F.col(side).alias("uid"), F.col(f"{side}_type").alias("symbol_type"),
                        F.col(f"{side}_path").alias("file_path"))

    ends = F.when(F.col("src") == F.col("dst"), F.array(end("src"))).otherwise(F.array(end("src"), end("dst")))
    return wanted.select("repo_id", "relationship_type", F.explode(ends).alias("end")).select("repo_id", "relationship_type", "end.*")


def edge_counts(edges: DataFrame, sign: int = 1) -> DataFrame:
    """Edges of every symbol and kind: repo_id, uid, symbol_type, file_path, relationship_type, change.

    ``sign`` -1 takes them away: counts of the edges before and after are added
    up by ``merged_counts``. What a symbol shows at the ends of its edges
    (type and path) is part of the key, so a symbol that moves leaves nothing behind.
    """
    ends = incidences(edges).filter(F.col("symbol_type") != REPOSITORY_NODE)
    return ends.groupBy(*COUNTED).agg((F.count("*") * sign).alias("change"))


def merged_counts(changes: DataFrame) -> DataFrame:
    """The sum of signed differences, without what is gone; ``degree`` by symbol and kind of edge."""
    return changes.groupBy(*COUNTED).agg(F.sum("change").alias("degree")).filter(F.col("degree") != 0)


def degrees(edges: DataFrame, types=None, only: DataFrame | None = None) -> DataFrame:
    """Incident edges per uid (degree > 0); ``only`` restricts to the uids of a table."""
    ends = incidences(edges, types).filter(F.col("symbol_type") != REPOSITORY_NODE)
    return _only(ends.groupBy("repo_id", "uid").agg(F.count("*").alias("degree")), only)


def counted_degrees(counts: DataFrame, types=None, only: DataFrame | None = None) -> DataFrame:
    """The rows of ``degrees`` from a table of counts."""
    return _only(_of_types(counts, types).groupBy("repo_id", "uid").agg(F.sum("degree").alias("degree")), only)


def _of_types(counts: DataFrame, types) -> DataFrame:
    return counts if types is None else counts.filter(F.col("relationship_type").isin(*types))


def _only(counted: DataFrame, only: DataFrame | None) -> DataFrame:
    if only is None:
        return counted
    # Counted before the join: the edges of a hub are one row per task by then.
    return counted.join(only.select("uid").distinct(), "uid").select(*counted.columns)


def ranked_by_degree(edges: DataFrame, symbol_types, limit: int, types=None, counts: DataFrame | None = None) -> DataFrame:
    """The non-test symbols of most edges in every repository: repo_id, uid, degree, rank.

    With ``counts`` no edge is read.
    """
    ends, degree = (incidences(edges, types), F.count("*")) if counts is None else (_of_types(counts, types), F.sum("degree"))
    counted = (
        ends.filter(F.col("symbol_type").isin(*symbol_types) & ~is_test_path(F.col("file_path")))
        .groupBy("repo_id", "uid")
        .agg(degree.alias("degree"))
    )
    return top_k(counted, ["repo_id"], [F.col("degree").desc(), F.col("uid")], limit)


def suggest_symbols(nodes: DataFrame, edges: DataFrame, limit: int = SUGGESTION_LIMIT, counts: DataFrame | None = None) -> DataFrame:
    """Well-connected starting points; node columns are joined to the few that are left."""
    best = ranked_by_degree(edges, DEFINITION_TYPES, limit, ("CALLS", "INHERITS"), counts)
    shown = nodes.select("uid", "symbol_type", "name", "qualified_name", "file_path", "start_line")
    return best.join(shown, "uid")


def neighbourhood(edges: DataFrame, uids: DataFrame, outgoing=OUTGOING_LIMIT, incoming=INCOMING_LIMIT) -> DataFrame:
    """Up to 8 outgoing edges and 5 incoming calls of every uid.

    Columns: uid, direction, position, relationship_type, qualified_name,
    file_path, start_line, confidence. Missing or zero confidence reads as 1.
    """
    # Written, so that adaptive execution can split the edges of a hub.
    asked = materialize(uids.select("uid").distinct(), "asked")
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES_PER_TASK))
    certainty = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))

    def towards(rows, near, far, direction, limit):
        seen = rows.select(
            F.col(near).alias("uid"), F.lit(direction).alias("direction"), "relationship_type",
            F.col(f"{far}_name").alias("qualified_name"), F.col(f"{far}_path").alias("file_path"),
            F.col(f"{far}_start").alias("start_line"), certainty.alias("confidence"),
            F.col(far).alias("other_uid"), "source_line",
        ).join(asked, "uid", "left_semi")
        order = [F.col("confidence").desc(), F.col("qualified_name"), F.col("source_line"),
                 F.col("other_uid"), F.col("relationship_type")]
        best = top_k(seen, ["uid"], order, limit, rank="position", salted=True, tasks=tasks)
        return best.drop("other_uid", "source_line")

    between = edges.filter(F.col("src_type") != REPOSITORY_NODE)
    return towards(between, "src", "dst", "outgoing", outgoing).unionByName(
        towards(between.filter(F.col("relationship_type") == "CALLS"), "dst", "src", "incoming", incoming)
    )
