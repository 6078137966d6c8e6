"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately; a cell is a pair of
centroids. A query walks over the pairs in the order of their summed inner
products with its halves, popped from a heap, until the visited cells hold the
wanted share of all entries. The entries of visited cells are scored exactly on
the original vectors. With ``share=1`` the search is exhaustive and exact.

Cells are dealt to bounded groups by their counts, cells that are larger than a
group are split, and queries go in blocks of bounded size. One task holds one
group of entries and one block of queries and passes on the best of each query.
Scores of entries near the last place are computed again in one fixed order of
summation, so equal vectors have equal scores wherever they are.

Centroids are fitted to a bounded sample (``vectors.SAMPLE``); every vector is
an entry. Vectors that are null, zero or hold null or non-finite components take
no part, nor do rows without an id. Shorter vectors are filled up with zeros, so
the widest sets the memory of a task. Ties go to the smaller id. Equal query rows
are one query; an id with several rows is one neighbour, with its best score.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.grouped import dealt, whole_groups
from archgraph.llm.order import shuffle_width
from archgraph.llm.text import mix64
from archgraph.llm.vectors import SAMPLE, centroids, comparable, matrix, widest
from archgraph.session import materialize

NEIGHBOURS = 20
HALF_CENTROIDS = 64
SHARE = 0.7
GROUP_ENTRIES = 8192
BLOCK_QUERIES = 1024
_MARGIN = 1e-9


def quantiser(entries, width, most=HALF_CENTROIDS):
    """Centroids of the first and of the second half."""
    drawn = entries.orderBy(F.xxhash64("vector"), "id").limit(SAMPLE).select("vector").toArrow()
    points = matrix(drawn.column("vector"), width)
    number = min(most, max(1, int(np.ceil(np.sqrt(len(points)) / 2))))
    half = (width + 1) // 2
    return centroids(points[:, :half], number, spherical=False), centroids(points[:, half:], number, spherical=False, seed=12)


def _codes(points, found):
    return (points @ found.T - 0.5 * (found**2).sum(axis=1)).argmax(axis=1)


def with_cells(entries, halves, width):
    first, second = halves
    half = first.shape[1]

    def assign(batches):
        for batch in batches:
            points = matrix(batch.column("vector"), width)
            cell = _codes(points[:, :half], first) * len(second) + _codes(points[:, half:], second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int64))], names=[*batch.schema.names, "cell"])

    return entries.mapInArrow(assign, T.StructType([*entries.schema.fields, T.StructField("cell", T.LongType())]))


def walk(first, second, counts, wanted):
    """Cells in the order of summed products until they hold ``wanted`` entries; ``first`` and ``second`` are one query's products.

    The heap holds the next pair of every row of the table of sums that has
    been reached: a row begins when the first pair of the row before it is taken.
    """
    left, right = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    rows, columns = (-first)[left].tolist(), (-second)[right].tolist()
    numbers, wide, high = counts.tolist(), len(columns), len(rows)
    heap, visited, held = [(rows[0] + columns[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heap[0]
        cell = left[i] * wide + right[j]
        if numbers[cell]:
            visited.append(cell)
            held += numbers[cell]
        if j + 1 < wide:
            heapq.heapreplace(heap, (rows[i] + columns[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if not j and i + 1 < high:
            heapq.heappush(heap, (rows[i + 1] + columns[0], i + 1, 0))
    return visited


def _groups(counts):
    """First group and number of groups of every cell; consecutive small cells share a group."""
    first, number, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, count in enumerate(counts.tolist()):
        if held and held + count > GROUP_ENTRIES:
            at, held = at + 1, 0
        first[cell] = at
        if count > GROUP_ENTRIES:
            number[cell] = -(-count // GROUP_ENTRIES)
            at += int(number[cell])
        else:
            held += count
    return first, number, at + 1


def nearest(vectors, queries, neighbours=NEIGHBOURS, share=SHARE, id_column="vec_id", vector="embedding"):
    """The best ``neighbours`` of each query found: ``query_id``, ``rank``, the id column, ``score``.

    ``queries`` has the columns of ``vectors``; a row with the query's own id is no candidate.
    """
    def usable(df):
        rows = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
        return rows.where(comparable(F.col("vector")) & F.col("id").isNotNull())

    entries = usable(vectors)
    width = widest(entries)
    halves = quantiser(entries, width)
    entries = materialize(with_cells(entries, halves, width), "entries")
    counts = np.zeros(len(halves[0]) * len(halves[1]), dtype=np.int64)
    for row in entries.groupBy("cell").count().collect():  # at most HALF_CENTROIDS squared rows
        counts[row[0]] = row[1]
    first_group, group_number, groups = _groups(counts)
    wanted = max(neighbours + 1, int(np.ceil(share * counts.sum())))

    def place(batches):
        for batch in batches:
            cell, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            mixed = (mix64(ids.astype(np.uint64)) % group_number[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(first_group[cell] + mixed), *batch.columns], names=["group", *batch.schema.names])

    placed = entries.mapInArrow(place, T.StructType([T.StructField("group", T.LongType()), *entries.schema.fields]))
    half = halves[0].shape[1]

    def visit(batches):
        for batch in batches:
            points = matrix(batch.column("vector"), width)
            left, right = points[:, :half] @ halves[0].T, points[:, half:] @ halves[1].T
            cells = [walk(left[i], right[i], counts, wanted) for i in range(len(points))]
            packed = [np.packbits(np.isin(np.arange(len(counts)), c)).tobytes() for c in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=[*batch.schema.names, "visited"])

    asked = usable(queries).distinct().withColumn("asked", F.monotonically_increasing_id())
    asked = materialize(asked, "asked-vectors")  # a distinct query's number must not change
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    asked = asked.repartition(shuffle_width(asked.sparkSession), "asked")  # few rows, much work each
    asked = asked.mapInArrow(visit, T.StructType([*asked.schema.fields, T.StructField("visited", T.BinaryType())]))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    asked = materialize(asked, "walked-queries")

    sent_queries = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), "block", "asked", "id", "vector", F.lit(0).cast("long").alias("cell"), "visited")
    sent_entries = placed.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast("long").alias("asked"), "id", "vector", "cell", F.lit(None).cast("binary").alias("visited"))
    keys = ["group", "block"]

    def search(batches):
        for table, begins in whole_groups(batches, keys):
            points = matrix(table.column("vector"), width)
            ids, cell = (table.column(c).to_numpy() for c in ("id", "cell"))
            asks = table.column("asked").is_valid().to_numpy()
            numbers = table.column("asked").fill_null(-1).to_numpy()
            visited = table.column("visited")
            for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                query = begin + np.flatnonzero(asks[begin:end])
                entry = begin + np.flatnonzero(~asks[begin:end])
                if len(query) and len(entry):
                    masks = np.unpackbits(np.frombuffer(b"".join(visited[int(i)].as_py() for i in query), np.uint8).reshape(len(query), -1), axis=1)
                    yield _best(points[query], numbers[query], ids[query], masks, points[entry], ids[entry], cell[entry], neighbours)

    found = dealt(sent_queries.unionByName(sent_entries), keys).mapInArrow(search, "asked long, query_id long, found_id long, score double")
    best = found.groupBy("asked", "query_id", "found_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), F.col("found_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", F.col("found_id").alias(id_column), "score")


def _best(asked, numbers, asked_ids, masks, points, ids, cell, neighbours):
    """The best ids in visited cells of each query, as a record batch; an id with several rows counts once, with its best score."""
    order = np.argsort(cell, kind="stable")
    points, ids, cell = points[order], ids[order], cell[order]
    begins = np.concatenate(([0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]))
    scores = np.full((len(asked), len(points)), -np.inf)
    for begin, end in zip(begins[:-1], begins[1:]):
        rows = np.flatnonzero(masks[:, cell[begin]])
        scores[rows, begin:end] = asked[rows] @ points[begin:end].T
    scores[asked_ids[:, None] == ids[None, :]] = -np.inf
    by_id = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[by_id][1:] != ids[by_id][:-1]))
    of_ids = scores if len(first) == len(ids) else np.maximum.reduceat(scores[:, by_id], first, axis=1)
    last = min(neighbours, of_ids.shape[1]) - 1
    floor = -np.partition(-of_ids, last, axis=1)[:, last]
    query, entry = np.nonzero((scores >= floor[:, None] - _MARGIN) & (scores > -np.inf))
    exact = (asked[query] * points[entry]).sum(axis=1)
    order = np.lexsort((-exact, ids[entry], query))
    query, entry, exact = query[order], entry[order], exact[order]
    once = np.ones(len(query), dtype=bool)
    once[1:] = (query[1:] != query[:-1]) | (ids[entry[1:]] != ids[entry[:-1]])
    query, entry, exact = query[once], entry[once], exact[once]
    order = np.lexsort((ids[entry], -exact, query))
    query, entry, exact = query[order], entry[order], exact[order]
    turn = np.arange(len(query)) - np.searchsorted(query, query)
    kept = turn < neighbours
    return pa.RecordBatch.from_arrays(
        [pa.array(numbers[query[kept]]), pa.array(asked_ids[query[kept]]), pa.array(ids[entry[kept]]), pa.array(exact[kept])],
        names=["asked", "query_id", "found_id", "score"])
