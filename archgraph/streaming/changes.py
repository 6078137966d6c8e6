"""What a few arriving files change in the graph of a large repository.

A new, moved or removed definition changes how names resolve in files that did
not arrive. The names that can be concerned are those that the definitions of
the arrived files, as they were and as they are, are candidates of. They are
linked before and after; where the links differ, or where a symbol at an end of
an edge differs, the edges of the sources concerned are made again. All other
rows stay where they are. The result is that of linking the whole repository.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import last_segment, symbol_uid
from archgraph.operators.build import build_nodes, relationship_edges, repository_edges
from archgraph.operators.degrees import edge_counts, merged_counts
from archgraph.operators.extract import split_rows
from archgraph.operators.resolve import name_links, resolve_relationships
from archgraph.schemas import DEFINITION_TYPES, EDGES
from archgraph.session import materialize


class GraphChange(NamedTuple):
    nodes: DataFrame  # new or different nodes
    node_keys: DataFrame  # repo_id, uid: what they replace, and what is gone
    edges: DataFrame
    edge_keys: DataFrame  # repo_id, src: sources whose edges are replaced
    degrees: DataFrame  # signed differences of the edges of symbols
    counts: DataFrame  # repo_id and the differences of file_count, symbol_count, relationship_count


_FILE = ["repo_id", "file_path"]
# What edges show of the nodes at their ends.
_SHOWN = ["repo_id", "uid", "symbol_type", "qualified_name", "file_path", "start_line"]


def graph_change(before: DataFrame, nodes: DataFrame, edges: DataFrame, arrived: DataFrame, files: DataFrame) -> GraphChange:
    """The change that ``files`` (repo_id, file_path) make, whose rows are now ``arrived``.

    ``before`` are the extracted rows of the repositories, ``nodes`` and
    ``edges`` their graph; all are read, and only what differs is written.
    """
    was = split_rows(materialize(before.join(files, _FILE, "left_semi"), "rows-replaced"))
    kept = before.join(files, _FILE, "left_anti")
    now = split_rows(arrived)
    all_before, kept, all_after = split_rows(before), split_rows(kept), split_rows(kept.unionByName(arrived.select(*kept.columns)))

    defined = was.symbols.unionByName(now.symbols)
    node_keys = materialize(defined.select("repo_id", "uid").distinct(), "touched-symbols")
    new_nodes = materialize(build_nodes(all_after.symbols.join(node_keys, ["repo_id", "uid"], "left_semi")), "changed-nodes")
    old_nodes = nodes.join(node_keys, ["repo_id", "uid"], "left_semi")
    different = _differing(old_nodes.select(*_SHOWN), new_nodes.select(*_SHOWN), ["repo_id", "uid"])

    names, links_before, links_after = _links(was, now, defined, all_before, all_after)
    moved = materialize(_differing(links_before, links_after, ["repo_id", "target_name"]), "moved-names")

    concerned = kept.relationships.filter(F.col("target_id").isNull()).join(moved, ["repo_id", "target_name"], "left_semi")
    source = symbol_uid(F.col("repo_id"), F.col("source_id")).alias("src")
    different = materialize(different, "different-nodes")
    at_ends = edges.join(different.select("repo_id", F.col("uid").alias("dst")), ["repo_id", "dst"], "left_semi").select("repo_id", "src")
    from_ends = different.select("repo_id", F.col("uid").alias("src"))
    edge_keys = materialize(
        was.relationships.unionByName(now.relationships).unionByName(concerned).select("repo_id", source)
        .unionByName(at_ends).unionByName(from_ends).distinct(),
        "touched-sources")

    rows = all_after.relationships.withColumn("src", source).join(edge_keys, ["repo_id", "src"], "left_semi").drop("src")
    nodes_after = nodes.join(node_keys, ["repo_id", "uid"], "left_anti").unionByName(new_nodes.select(*nodes.columns))
    new_edges = relationship_edges(nodes_after, resolve_relationships(all_after.symbols, materialize(rows, "touched-relationships")))
    new_edges = materialize(new_edges, "changed-edges")
    counts = _count_changes(was, now, concerned, links_before, links_after)
    return GraphChange(new_nodes, node_keys, new_edges, edge_keys, _degree_changes(old_nodes, new_nodes, edges, new_edges, edge_keys), counts)


def _degree_changes(old_nodes, new_nodes, edges, new_edges, edge_keys) -> DataFrame:
    """Edges of the sources concerned and of the repository to its files, taken away as they were and added as they are."""
    old_edges = edges.join(edge_keys, ["repo_id", "src"], "left_semi")
    both = [edge_counts(rows.select(*EDGES.fieldNames()).unionByName(repository_edges(nodes)), sign)
            for rows, nodes, sign in ((old_edges, old_nodes, -1), (new_edges, new_nodes, 1))]
    return merged_counts(both[0].unionByName(both[1])).withColumnRenamed("degree", "change")


def _differing(before: DataFrame, after: DataFrame, key) -> DataFrame:
    return before.subtract(after).unionByName(after.subtract(before)).select(*key).distinct()


def _links(was, now, defined, all_before, all_after):
    """Names in the arrived files or with a candidate there, and their links before and after."""
    open_names = [t.relationships.filter(F.col("target_id").isNull()).select("repo_id", "target_name").distinct()
                  for t in (was, now, all_after)]
    qualified = defined.select("repo_id", F.col("qualified_name").alias("target_name")).distinct()
    short = defined.filter(F.col("symbol_type").isin(*DEFINITION_TYPES)).select("repo_id", F.col("name").alias("short_name")).distinct()
    used = open_names[2].withColumn("short_name", last_segment(F.col("target_name")))
    names = materialize(
        open_names[0].unionByName(open_names[1])
        .unionByName(used.join(qualified, ["repo_id", "target_name"], "left_semi").drop("short_name"))
        .unionByName(used.join(short, ["repo_id", "short_name"], "left_semi").drop("short_name")).distinct(),
        "concerned-names")
    return names, *(materialize(name_links(t.symbols, names), "links") for t in (all_before, all_after))


def _count_changes(was, now, concerned, links_before, links_after):
    def linked(relationships, links):
        found = links.filter(F.col("exact_id").isNotNull() | (F.col("candidates") == 1)).select("repo_id", "target_name", F.lit(1).alias("found"))
        joined = relationships.select("repo_id", "target_id", "target_name").join(found, ["repo_id", "target_name"], "left")
        return joined.filter(F.col("target_id").isNotNull() | F.col("found").isNotNull())

    def one(rows, sign, file=0, symbol=0, relationship=0):
        return rows.select("repo_id", *[(sign * F.lit(x)).cast("long").alias(n) for x, n in (
            (file, "file_count"), (symbol, "symbol_count"), (relationship, "relationship_count"))])

    parts = []
    for sign, tables, links in ((-1, was, links_before), (1, now, links_after)):
        parts.append(one(tables.symbols, sign, symbol=1))
        parts.append(one(tables.symbols.filter(F.col("symbol_type") == "file"), sign, file=1))
        parts.append(one(linked(tables.relationships.unionByName(concerned), links), sign, relationship=1))
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return all_parts.groupBy("repo_id").agg(*[F.sum(n).alias(n) for n in ("file_count", "symbol_count", "relationship_count")])
