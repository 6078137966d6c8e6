"""Reverse reachability by bit-parallel breadth-first search.

A vertex carries one bit per target: the targets it is known to reach. A step
passes the bits that are new at a vertex to the vertices with an arc to it, so
up to 64 targets advance in one word. A pair of target and symbol comes up only
as it is reached, with its depth, and is never read again.

Repositories whose arcs fit a bounded number of bytes are searched in grouped
tasks: one shuffle for all of them, whatever the depth of their graphs. Larger
ones advance by rounds over tables of (vertex, word), in which the bits that
arrive at a vertex are combined by OR on the map side. Both ways are exact and
give the same rows.
"""

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.operators.groups import ragged, whole_groups
from archgraph.session import materialize, new_folder

# The edge types a change travels along.
DEPENDENCY_TYPES = ("CALLS", "INHERITS")

# Most bytes of names at the ends of a repository's arcs that one task may hold.
LOCAL_BYTES = 64 << 20
# Most bytes of bits that a task holds for the vertices of a repository, and of words per vertex.
BIT_BYTES, MOST_WORDS = 64 << 20, 16
# Rows a task gathers before it hands a batch back.
OUTPUT_ROWS = 100_000

_WORD = 64
_PAIRS = "target_uid string, uid string, depth int"
_LEVEL = "repo_id string, uid string, word int, bits long, depth int"


def dependents(edges: DataFrame, targets: DataFrame, max_depth: int | None = None,
               local_bytes: int = LOCAL_BYTES) -> DataFrame:
    """Symbols with a path of edges to a target, with the least depth; ``max_depth`` is the caller's, default none.

    ``targets`` has a column uid and may have repo_id; then only the edges of
    those repositories are read and written. Without it, all edges count as
    those of one repository. Result: target_uid, uid, depth. A target starts
    the search without counting as visited, so a target on a cycle depends on
    itself.
    """
    by_repository = "repo_id" in targets.columns and "repo_id" in edges.columns
    repo = F.col("repo_id") if by_repository else F.lit("")
    asked = materialize(targets.select(repo.alias("repo_id"), "uid").filter(F.col("uid").isNotNull()).distinct(), "asked-targets")
    between = F.col("relationship_type").isin(*DEPENDENCY_TYPES) & F.col("src").isNotNull() & F.col("dst").isNotNull()
    arcs = edges.filter(between).select(repo.alias("repo_id"), "src", "dst")
    if by_repository:
        arcs = arcs.join(asked.select("repo_id").distinct(), "repo_id", "left_semi")
    arcs = materialize(arcs.distinct(), "dependency-arcs")
    size = F.sum(F.octet_length("src") + F.octet_length("dst"))
    large = materialize(arcs.groupBy("repo_id").agg(size.alias("bytes")).filter(F.col("bytes") > local_bytes).select("repo_id"), "large-repositories")
    if large.isEmpty():
        return _within_tasks(arcs, asked, max_depth)
    small = _within_tasks(arcs.join(large, "repo_id", "left_anti"), asked.join(large, "repo_id", "left_anti"), max_depth)
    return small.unionByName(
        _by_rounds(arcs.join(large, "repo_id", "left_semi"), asked.join(large, "repo_id", "left_semi"), max_depth))


def _within_tasks(arcs: DataFrame, asked: DataFrame, max_depth: int | None) -> DataFrame:
    """Each repository's arcs and targets in one task."""
    rows = arcs.unionByName(asked.select("repo_id", F.lit(None).cast("string").alias("src"), F.col("uid").alias("dst")))

    def search(batches):
        for group in whole_groups(batches, "repo_id"):
            yield from _searched(group, max_depth)

    return rows.repartition("repo_id").sortWithinPartitions("repo_id").mapInArrow(search, _PAIRS)


def _searched(group: pa.Table, max_depth: int | None):
    """Batches of pairs of one repository; rows without ``src`` are its targets."""
    src, dst = group.column("src"), group.column("dst")
    is_target = src.is_null().to_numpy()
    named = pa.chunked_array([*dst.chunks, *src.drop_null().chunks], pa.string()).combine_chunks().dictionary_encode()
    numbers = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = numbers[: len(is_target)]
    targets, b, a = ends[is_target], ends[~is_target], numbers[len(is_target) :]
    names, n = named.dictionary, len(named.dictionary)
    order = np.argsort(b, kind="stable")
    into, first = a[order], np.searchsorted(b[order], np.arange(n + 1))
    words = max(1, min(MOST_WORDS, -(-len(targets) // _WORD), BIT_BYTES // (8 * n)))
    held, rows = [], 0
    for begin in range(0, len(targets), words * _WORD):
        own = targets[begin : begin + words * _WORD]
        for depth, vertices, bits in _levels(into, first, n, own, words, max_depth):
            where, target = np.nonzero(np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little"))
            held.append((own[target], vertices[where], np.full(len(where), depth, dtype=np.int32)))
            rows += len(where)
            if rows >= OUTPUT_ROWS:
                yield _pairs(names, held)
                held, rows = [], 0
    if held:
        yield _pairs(names, held)


def _levels(into, first, n, targets, words, max_depth):
    """(depth, vertices, new bits) of every level; only arcs into vertices with new bits are followed."""
    seen = np.zeros((n, words), dtype=np.uint64)
    vertices = targets
    bits = np.zeros((len(targets), words), dtype=np.uint64)
    place = np.arange(len(targets))
    bits[place, place // _WORD] = np.uint64(1) << (place % _WORD).astype(np.uint64)
    for depth in count(1):
        degree = first[vertices + 1] - first[vertices]
        if not degree.any() or (max_depth is not None and depth > max_depth):
            return
        heads = into[ragged(first[vertices], degree)]
        order = np.argsort(heads, kind="stable")
        reached, at = np.unique(heads[order], return_index=True)
        arrived = np.bitwise_or.reduceat(np.repeat(bits, degree, axis=0)[order], at, axis=0)
        new = arrived & ~seen[reached]
        some = new.any(axis=1)
        vertices, bits = reached[some], new[some]
        if not len(vertices):
            return
        seen[vertices] |= bits
        yield depth, vertices, bits


def _pairs(names: pa.Array, held) -> pa.RecordBatch:
    target, vertex, depth = (np.concatenate([part[i] for part in held]) for i in range(3))
    return pa.RecordBatch.from_arrays([names.take(pa.array(target)), names.take(pa.array(vertex)), pa.array(depth)],
                                      names=["target_uid", "uid", "depth"])


def _by_rounds(arcs: DataFrame, asked: DataFrame, max_depth: int | None) -> DataFrame:
    """The same over tables, one round per level, for repositories of any size."""
    spark = arcs.sparkSession
    number = F.row_number().over(Window.partitionBy("repo_id").orderBy("uid")) - 1
    numbered = materialize(
        asked.withColumn("number", number).select(
            "repo_id", F.col("uid").alias("target_uid"), F.floor(F.col("number") / _WORD).cast("int").alias("word"),
            F.pmod("number", F.lit(_WORD)).cast("int").alias("place")),
        "numbered-targets")
    arcs = materialize(arcs.repartition("repo_id", "dst").sortWithinPartitions("dst"), "large-arcs")
    frontier = numbered.select("repo_id", F.col("target_uid").alias("dst"), "word", F.expr("shiftleft(1L, place)").alias("bits"))
    folders = []

    def levels():
        return spark.read.schema(_LEVEL).parquet(*folders)

    for depth in count(1):
        if max_depth is not None and depth > max_depth:
            break
        arrived = frontier.join(arcs, ["repo_id", "dst"]).groupBy("repo_id", F.col("src").alias("uid"), "word").agg(F.bit_or("bits").alias("bits"))
        if folders:
            seen = levels().groupBy("repo_id", "uid", "word").agg(F.bit_or("bits").alias("seen"))
            arrived = arrived.join(seen, ["repo_id", "uid", "word"], "left").withColumn(
                "bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))).drop("seen")
        folders.append(new_folder(spark, f"dependents-{depth}"))
        arrived.filter("bits <> 0").withColumn("depth", F.lit(depth)).write.parquet(folders[-1])
        level = spark.read.schema(_LEVEL).parquet(folders[-1])
        if level.isEmpty():
            break
        frontier = level.select("repo_id", F.col("uid").alias("dst"), "word", "bits")
    if not folders:
        return spark.createDataFrame([], _PAIRS)
    places = F.filter(F.sequence(F.lit(0), F.lit(_WORD - 1)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    pairs = levels().select("repo_id", "uid", "word", "depth", F.explode(places).alias("place"))
    return pairs.join(numbered, ["repo_id", "word", "place"]).select("target_uid", "uid", "depth")
