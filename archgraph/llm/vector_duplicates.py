"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

Equal vectors are one class and compared once. A class belongs to the cell of
its nearest centroid and is a guest in every other cell that a vector at the
threshold from it could belong to: with unit centroids ``c`` and ``d``, a vector
``x`` is at an angle of sine ``x (d - c) / |d - c|`` from where ``c`` gets nearer
than ``d``, and only if no such angle is above that of the threshold can a
linked vector belong to ``c``. So no link is lost, whatever the centroids are.
Of two cells, one sends guests to the other, so every pair meets once. Guests
are compared with a cell's own members only. Centroids that are as near to each
other as linked vectors are merged, so a dense group stays one cell.

Members and guests of cells of any size are cut into blocks, and every pair of
blocks is one product in a task of its own. A task passes on the number of links
of each vector and a spanning forest of them, not the pairs. Vectors without any
clusters are guests in most cells: their products grow with the square of their
number, as comparing all of them exactly asks for.

Centroids are fitted to a bounded sample (``vectors.SAMPLE``); every vector is
assigned. Vectors that are null, zero or hold null or non-finite components
link with nothing. Shorter vectors are filled up with zeros. Equal ids are
separate vectors; a null id is never the smallest unless all are null.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.components import connected_components
from archgraph.llm.grouped import dealt, spanning_links, whole_groups
from archgraph.llm.vectors import centroids, comparable, matrix, sample, unit, vector_classes, widest
from archgraph.session import materialize

THRESHOLD = 0.95
MOST_CELLS = 64
BLOCK = 1024
GUESTS_BLOCK = 4 * BLOCK
_MARGIN = 1e-9


def merged(found, threshold=THRESHOLD):
    """The centroids without those that an earlier one is linked with."""
    kept = []
    for at in range(len(found)):
        if not kept or (found[kept] @ found[at]).max() < threshold:
            kept.append(at)
    return found[kept]


def visited_cells(directions, found, threshold=THRESHOLD):
    """Own cell of every unit vector, and whether it is a guest in each cell."""
    products = directions @ found.T
    own = products.argmax(axis=1)
    number = len(found)
    ahead = (np.arange(number)[None, :] - own[:, None]) % number
    guest = (ahead > 0) & ((2 * ahead < number) | ((2 * ahead == number) & (own[:, None] < np.arange(number))))
    if threshold > 0:
        reach = np.sqrt(max(0.0, 1 - threshold**2)) + _MARGIN
        for cell in range(number):
            apart = np.linalg.norm(found - found[cell], axis=1)
            guest[:, cell] &= (products - products[:, cell, None] <= reach * apart + _MARGIN).all(axis=1)
    return own, guest


def with_cells(classes, found, width, threshold=THRESHOLD):
    """Every class once: ``node``, ``copies``, ``vector``, ``own`` (its cell), ``guest_of`` (cells)."""
    schema = T.StructType([
        T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), classes.schema["vector"],
        T.StructField("own", T.LongType()), T.StructField("guest_of", T.ArrayType(T.LongType())),
    ])

    def assign(batches):
        for batch in batches:
            own, guest = visited_cells(unit(matrix(batch.column("vector"), width)), found, threshold)
            ends = np.concatenate(([0], np.cumsum(guest.sum(axis=1)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(guest)[1].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("node", "copies", "vector")), pa.array(own.astype(np.int64)), listed], names=schema.fieldNames())

    return classes.select("node", "copies", "vector").mapInArrow(assign, schema)


def _blocks(assigned, cell, number, block):
    """Blocks that each cell is cut into, as a column with an array of the length ``number``."""
    held = {row[0]: row[1] for row in assigned.groupBy(cell.alias("cell")).count().collect()}  # at most MOST_CELLS rows
    return F.array(*[F.lit(-(-held.get(at, 0) // block)).cast("long") for at in range(number)])


def block_links(assigned, width, number, threshold=THRESHOLD):
    """``a``, ``b`` of a spanning forest, or ``a`` and its number of ``links`` (``b`` null), per pair of blocks."""
    visits = assigned.select("node", "copies", "vector", F.explode("guest_of").alias("cell"))
    owners, guests = _blocks(assigned, F.col("own"), number, BLOCK), _blocks(visits.select("cell"), F.col("cell"), number, GUESTS_BLOCK)
    keys = ["cell", "block_a", "block_b"]

    def placed(rows, first, blocks, others):
        """Rows once per pair of their own block with another; blocks of guests come after those of owners."""
        of = rows.withColumn("owners", owners[F.col("cell").cast("int")]).withColumn("guests", guests[F.col("cell").cast("int")])
        of = of.withColumn("block", first + F.pmod(F.xxhash64("node"), blocks))
        of = of.select("*", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
        return of.select("cell", F.least("block", "other").alias("block_a"), F.greatest("block", "other").alias("block_b"), "block", "node", "copies", "vector")

    own = placed(assigned.select("node", "copies", "vector", F.col("own").alias("cell")), F.lit(0).cast("long"), F.col("owners"), F.col("owners") + F.col("guests"))
    guest = placed(visits.where(owners[F.col("cell").cast("int")] > 0), F.col("owners"), F.col("guests"), F.col("owners"))

    def compare(batches):
        for table, begins in whole_groups(batches, keys):
            directions = unit(matrix(table.column("vector"), width))
            node, copies, block, first, second = (table.column(c).to_numpy() for c in ("node", "copies", "block", "block_a", "block_b"))
            for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                at = np.arange(begin, end)
                if first[begin] == second[begin]:
                    one, other = _linked_pairs(directions[at], directions[at], threshold)
                    apart = one != other
                    one, other = at[one[apart]], at[other[apart]]
                else:
                    left, right = at[block[at] == first[begin]], at[block[at] != first[begin]]
                    one, other = _linked_pairs(directions[left], directions[right], threshold)
                    one, other = np.concatenate((left[one], right[other])), np.concatenate((right[other], left[one]))
                if not len(one):
                    continue
                links = np.bincount(one - begin, weights=copies[other], minlength=end - begin).astype(np.int64)
                a, b = _forest(one - begin, other - begin, end - begin)
                some = np.flatnonzero(links)
                counted = np.arange(len(a) + len(some)) >= len(a)
                yield pa.RecordBatch.from_arrays([
                    pa.array(node[begin + np.concatenate((a, some))]), pa.array(node[begin + np.concatenate((b, np.zeros(len(some), np.int64)))], mask=counted),
                    pa.array(np.concatenate((np.zeros(len(a), np.int64), links[some]))),
                ], names=["a", "b", "links"])

    return dealt(own.unionByName(guest), keys).mapInArrow(compare, "a long, b long, links long")


def _linked_pairs(some, others, threshold):
    """Positions of the linked pairs, by rows."""
    return np.nonzero(some @ others.T >= threshold)


def _forest(one, other, number):
    """A spanning forest of symmetric pairs."""
    order = np.argsort(one, kind="stable")
    other = other[order]
    begins = np.searchsorted(one[order], np.arange(number + 1))

    def linked(i, rest):
        hit = np.zeros(number, dtype=bool)
        hit[other[begins[i] : begins[i + 1]]] = True
        return hit[rest]

    return spanning_links(number, linked)


def near_duplicate_vectors(vectors, id_column="vec_id", vector="embedding", threshold=THRESHOLD):
    """Per vector: its id, ``n_links``, ``component_id`` (the smallest id reachable), ``kept``."""
    classes = vector_classes(vectors, id_column, vector)
    width = widest(classes)
    number = classes.count()
    found = centroids(unit(sample(classes, width)), min(MOST_CELLS, int(np.ceil(np.sqrt(number)))), spherical=True) if number else np.zeros((1, width))
    found = merged(found, threshold)
    assigned = materialize(with_cells(classes, found, width, threshold), "vectors-with-cells")
    links = materialize(block_links(assigned, width, len(found), threshold), "vector-links")
    joined = connected_components(links.where("b is not null").select("a", "b"))
    numbers = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    named = classes.join(joined, "node", "left").join(numbers, "node", "left").select(
        "vector", "least_id", F.coalesce("component", "node").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    named = materialize(named, "named-vectors")
    least = materialize(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least-vectors")
    answer = materialize(named.join(least, "component").select(F.col("vector").alias("of"), "n_links", "component_id"), "vector-answers")
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.withColumn("usable", F.when(comparable(F.col("vector")), F.col("vector")))
    out = rows.join(answer, F.col("usable") == F.col("of"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
