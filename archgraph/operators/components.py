"""Strongly connected components of a directed graph held in a table.

Every vertex carries two signatures, the greatest vertex number that reaches
it and the greatest one it reaches. Both are propagated to a fixpoint. Where
the two agree, the vertices with that signature are one whole component. All
vertices of a component share both signatures, so arcs between different
signatures lie in no component and are dropped before the next phase. (The
idea of in- and out-signatures with pointer jumping is published: Alabandi,
Sands, Biros, Burtscher, "A High-Performance MPI/OpenMP and CUDA
Strongly-Connected Components code", SC 2023.)

Components never cross repositories. Repositories whose arcs fit a bounded
number of bytes are solved in grouped tasks, which cost one shuffle for all of
them together. The others, of any size, have their vertices numbered, so that
every later step handles pairs of longs. If their arcs, trimmed, fit the same
bound as such pairs, they are solved in grouped tasks after all; if not, by
rounds over tables: per round one join of arcs with the signatures that changed
and one maximum per vertex, which combines on the map side. All ways are exact
and give the same result.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.operators.groups import whole_groups
from archgraph.session import materialize

# Most bytes of names at the ends of a repository's arcs that one task may hold.
LOCAL_BYTES = 64 << 20
# Bytes of an arc whose ends are numbered.
ARC_BYTES = 16

FORWARD, BACKWARD = 0, 1

# Trimming goes on while a pass removes at least one arc in this many.
TRIM_WORTHWHILE = 10


def strongly_connected_components(edges: DataFrame, local_bytes: int = LOCAL_BYTES, numbered_bytes: int | None = None) -> DataFrame:
    """(repo_id, src, dst) -> (uid, component); component is the least uid of its members.

    Singletons are included, also vertices known only as targets. Repositories
    with more than ``local_bytes`` of names have their vertices numbered; those
    of them with at most ``numbered_bytes`` of trimmed arcs are solved in a task
    each, the others by rounds. Who asks for another ``local_bytes`` asks for
    rounds, unless both are given.
    """
    if numbered_bytes is None:
        numbered_bytes = LOCAL_BYTES if local_bytes == LOCAL_BYTES else 0
    pairs = materialize(edges.select("repo_id", "src", "dst").distinct(), "scc-pairs")
    size = F.sum(F.octet_length("src") + F.octet_length("dst"))
    large = materialize(pairs.groupBy("repo_id").agg(size.alias("bytes")).filter(F.col("bytes") > local_bytes).select("repo_id"), "scc-large")
    if large.isEmpty():
        return _within_tasks(pairs)
    return _within_tasks(pairs.join(large, "repo_id", "left_anti")).unionByName(_numbered(pairs.join(large, "repo_id", "left_semi"), numbered_bytes))


def _numbered(pairs: DataFrame, numbered_bytes: int) -> DataFrame:
    """Components of large repositories."""
    vertices = materialize(
        pairs.select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
        .withColumn("vertex", F.monotonically_increasing_id()),
        "scc-vertices",
    )
    arcs = materialize(
        pairs.filter(F.col("src") != F.col("dst"))
        .join(vertices.select(F.col("uid").alias("src"), F.col("vertex").alias("a")), "src")
        .join(vertices.select(F.col("uid").alias("dst"), F.col("vertex").alias("b")), "dst")
        .select("repo_id", "a", "b"),
        "scc-arcs",
    )
    found = [vertices.select("vertex", F.lit(None).cast("long").alias("root")).limit(0)]
    if numbered_bytes:
        arcs, _ = _trim(arcs, arcs.count())
        fits = F.count("*") * ARC_BYTES <= numbered_bytes
        small = materialize(arcs.groupBy("repo_id").agg(fits.alias("fits")).filter("fits").select("repo_id"), "scc-small")
        found.append(_roots_within_tasks(arcs.join(small, "repo_id", "left_semi")))
        arcs = materialize(arcs.join(small, "repo_id", "left_anti"), "scc-arcs")
    found.extend(_roots_by_rounds(arcs.select("a", "b")))
    rooted = materialize(
        vertices.join(reduce(DataFrame.unionByName, found), "vertex", "left")
        .select("uid", F.coalesce("root", "vertex").alias("root")),
        "scc-roots",
    )
    # Written, so that adaptive execution can split the members of a giant component.
    names = materialize(rooted.groupBy("root").agg(F.min("uid").alias("component")), "scc-names")
    return rooted.join(names, "root").select("uid", "component")


def _within_tasks(pairs: DataFrame) -> DataFrame:
    """Components of repositories that fit a task, each in one."""

    def solve(batches):
        for group in whole_groups(batches, "repo_id"):
            ends = pa.chunked_array([*group.column("src").chunks, *group.column("dst").chunks], pa.string()).combine_chunks().dictionary_encode()
            names = ends.dictionary
            a, b = ends.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(2, -1)
            roots = _roots(a[a != b], b[a != b], len(names))
            place = np.empty(len(names), dtype=np.int64)
            order = pc.sort_indices(names).to_numpy()
            place[order] = np.arange(len(names))
            least = np.full(len(names), len(names))
            np.minimum.at(least, roots, place)
            yield pa.RecordBatch.from_arrays([names, names.take(pa.array(order[least[roots]]))], names=["uid", "component"])

    return pairs.repartition("repo_id").sortWithinPartitions("repo_id").mapInArrow(solve, "uid string, component string")


def _roots_within_tasks(arcs: DataFrame) -> DataFrame:
    """(vertex, root) of the vertices on numbered arcs (repo_id, a, b) of repositories that fit a task."""

    def solve(batches):
        for group in whole_groups(batches, "repo_id"):
            ends = np.concatenate([group.column("a").to_numpy(), group.column("b").to_numpy()])
            numbers, places = np.unique(ends, return_inverse=True)
            a, b = places.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(numbers[_roots(a, b, len(numbers))])], names=["vertex", "root"])

    return arcs.repartition("repo_id").sortWithinPartitions("repo_id").mapInArrow(solve, "vertex long, root long")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The same propagation on the arcs of one repository, as arrays: a member of its component for every vertex."""
    # Numbers in random order keep the phases few whatever the vertices are.
    order = np.random.default_rng(n).permutation(n)
    a, b = order[a], order[b]
    root = np.arange(n)
    while len(a):
        reached_by, reaches = _propagate(a, b, n), _propagate(b, a, n)
        done = reached_by == reaches
        finished = np.unique(np.concatenate([a, b]))
        finished = finished[done[finished]]
        root[finished] = reaches[finished]
        within = (reached_by[a] == reached_by[b]) & (reaches[a] == reaches[b]) & ~done[a]
        a, b = a[within], b[within]
    vertex_of = np.empty(n, dtype=np.int64)
    vertex_of[order] = np.arange(n)
    return vertex_of[root[order]]


def _propagate(origin: np.ndarray, vertex: np.ndarray, n: int) -> np.ndarray:
    mark = np.arange(n)
    while True:
        heard = mark.copy()
        np.maximum.at(heard, vertex, mark[origin])
        heard = np.maximum(heard, heard[heard])
        if np.array_equal(heard, mark):
            return mark
        mark = heard


def _roots_by_rounds(arcs: DataFrame) -> list[DataFrame]:
    """(vertex, root) tables of the components, by rounds over tables."""
    found = []
    arcs, left = _trim(arcs, arcs.count())
    while left:
        signatures = _signatures(arcs)
        done = F.col("reached_by") == F.col("reaches")
        found.append(signatures.filter(done).select("vertex", F.col("reaches").alias("root")))
        arcs = materialize(_arcs_within(arcs, signatures.filter(~done)), "scc-arcs")
        arcs, left = _trim(arcs, arcs.count())
    return found


def _trim(arcs: DataFrame, left: int):
    """Drop arcs from vertices without a way in and to vertices without a way out."""
    while left:
        # Written, so that adaptive execution can split the arcs of a popular vertex.
        entered = materialize(arcs.select(F.col("b").alias("a")).distinct(), "scc-entered")
        departed = materialize(arcs.select(F.col("a").alias("b")).distinct(), "scc-departed")
        kept = materialize(
            arcs.join(entered, "a", "left_semi").join(departed, "b", "left_semi").select(*arcs.columns),
            "scc-trimmed",
        )
        n = kept.count()
        removed, arcs, left = left - n, kept, n
        if removed * TRIM_WORTHWHILE < removed + left:
            break
    return arcs, left


def _signatures(arcs: DataFrame) -> DataFrame:
    """(vertex, reached_by, reaches) at the fixpoint; both directions share every round."""
    hops = materialize(
        arcs.select(F.explode(F.array(
            F.struct(F.lit(FORWARD).alias("way"), F.col("a").alias("origin"), F.col("b").alias("vertex")),
            F.struct(F.lit(BACKWARD).alias("way"), F.col("b").alias("origin"), F.col("a").alias("vertex")),
        )).alias("hop")).select("hop.*"),
        "scc-hops",
    )
    # The first round needs no join: a vertex starts with itself and its neighbours.
    first = hops.select("way", F.explode(F.array(
        F.struct("vertex", F.col("origin").alias("mark")),
        F.struct("vertex", F.col("vertex").alias("mark")),
        F.struct(F.col("origin").alias("vertex"), F.col("origin").alias("mark")),
    )).alias("start")).select("way", "start.*")
    marks = materialize(
        first.groupBy("way", "vertex").agg(F.max("mark").alias("mark"))
        .withColumn("changed", F.col("mark") != F.col("vertex")),
        "scc-marks",
    )
    while True:
        news = marks.filter("changed").select("way", F.col("vertex").alias("origin"), F.col("mark").alias("heard"))
        # Whoever marks a vertex reaches it, so the mark's own mark does as well:
        # told to all whose mark has news, and looked up by all with a new mark.
        jumps = marks.filter(F.col("mark") != F.col("vertex")).select("way", F.col("mark").alias("origin"), "vertex")
        told = hops.unionByName(jumps).join(news, ["way", "origin"]).select("way", "vertex", "heard")
        known = marks.select("way", F.col("vertex").alias("heard"), F.col("mark").alias("mark_of_mark"))
        looked_up = news.join(known, ["way", "heard"]).select(
            "way", F.col("origin").alias("vertex"), F.col("mark_of_mark").alias("heard"))
        heard = told.unionByName(looked_up).groupBy("way", "vertex").agg(F.max("heard").alias("heard"))
        better = F.col("heard") > F.col("mark")
        marks = materialize(
            marks.drop("changed").join(heard, ["way", "vertex"], "left").select(
                "way", "vertex", F.greatest("mark", "heard").alias("mark"),
                F.coalesce(better, F.lit(False)).alias("changed")),
            "scc-marks",
        )
        if marks.filter("changed").isEmpty():
            break
    return materialize(
        marks.groupBy("vertex").agg(
            F.max(F.when(F.col("way") == FORWARD, F.col("mark"))).alias("reached_by"),
            F.max(F.when(F.col("way") == BACKWARD, F.col("mark"))).alias("reaches"),
        ),
        "scc-signatures",
    )


def _arcs_within(arcs: DataFrame, signatures: DataFrame) -> DataFrame:
    def end(name):
        return signatures.select(F.col("vertex").alias(name), F.col("reached_by").alias(f"{name}_in"),
                                 F.col("reaches").alias(f"{name}_out"))

    return (
        arcs.join(end("a"), "a").join(end("b"), "b")
        .filter((F.col("a_in") == F.col("b_in")) & (F.col("a_out") == F.col("b_out")))
        .select("a", "b")
    )
