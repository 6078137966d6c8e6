"""From extracted tables, or from files, to a graph."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.operators.build import build_edges, build_nodes
from archgraph.operators.extract import ExtractedTables, extract_ir
from archgraph.operators.resolve import resolve_relationships
from archgraph.schemas import Graph
from archgraph.session import bounded_tasks, materialize

# Relationships that a task joins to their ends and sorts, about.
EDGES_PER_TASK = 100_000


class AnalyzedFiles(NamedTuple):
    extracted: ExtractedTables
    resolved: DataFrame
    graph: Graph


def build_graph(symbols: DataFrame, relationships: DataFrame) -> Graph:
    """The linked graph as written tables.

    Nodes are written first: edges read a few of their columns three times.
    """
    return link_graph(symbols, resolve_relationships(symbols, relationships), relationships.count())


def link_graph(symbols: DataFrame, resolved: DataFrame, rows: int | None = None) -> Graph:
    """The written graph; files are sorted by repository, so questions about a few skip row groups."""
    return link_nodes(written_nodes(symbols), resolved, rows)


def written_nodes(symbols: DataFrame) -> DataFrame:
    return materialize(build_nodes(symbols).sortWithinPartitions("repo_id"), "nodes")


def link_nodes(nodes: DataFrame, resolved: DataFrame, rows: int | None = None) -> Graph:
    """The written graph of nodes that are written already.

    ``rows`` is the number of relationships, which are counted if it is not given.
    """
    with bounded_tasks(nodes.sparkSession, resolved.count() if rows is None else rows, EDGES_PER_TASK):
        edges = materialize(build_edges(nodes, resolved).sortWithinPartitions("repo_id"), "edges")
    return Graph(nodes, edges)


def only_repositories(graph: Graph, repo_ids) -> Graph:
    """The graph of some repositories, for questions that concern no others; the filter reaches the scans."""
    wanted = F.col("repo_id").isin(*repo_ids)
    return Graph(graph.nodes.filter(wanted), graph.edges.filter(wanted))


def analyze_files(files: DataFrame) -> AnalyzedFiles:
    """Parse, resolve and link the files of all repositories at once."""
    extracted = extract_ir(files)
    resolved = materialize(resolve_relationships(extracted.symbols, extracted.relationships), "resolved")
    return AnalyzedFiles(extracted, resolved, link_graph(extracted.symbols, resolved))
