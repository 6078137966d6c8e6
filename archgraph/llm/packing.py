"""Best-fit packing of documents into sequences, with large items matched in pairs.

Sizes are whole numbers up to the capacity, so the plan needs only the count of
every size: at most ``capacity`` numbers, whatever the corpus. Items above a
third of the capacity are matched, largest first, with the largest partner that
still fits, at most two to a sequence; smaller items, largest first, go to the
sequence with the smallest gap that holds them. The plan says which ranks of a
size go to which run of sequences. Ranks come from one range-partitioned sort,
so the packing is that of the whole corpus and no task sees all of it.

Null and empty texts are one item, the end id alone. Repeated rows are separate
documents. Items of equal size are ordered by their other columns.
"""

import bisect
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.order import with_position, written_in_order
from archgraph.llm.sized import bounded_batches
from archgraph.llm.text import ragged, row_offsets
from archgraph.llm.tokens import Encoder, byte_level_cuts

CAPACITY = 2048
END_ID = 0


def token_pieces(docs, tokenizer, capacity=CAPACITY, end_id=END_ID, id_column="doc_id", text="text"):
    """Pieces of at most ``capacity`` ids: id column, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit).

    A document is its ids and the end id. Only longer ones are cut, into full
    pieces after a first piece that may be shorter.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([
        rows.schema[id_column], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def cut(batches):
        encoder = Encoder.of(tokenizer, byte_level_cuts)
        for batch in batches:
            for first, ids, counts in encoder.encode(batch.column(1)):
                yield _pieces(batch.column(0).slice(first, len(counts)), ids, counts, capacity, end_id, id_column)

    return rows.mapInArrow(cut, schema)


def _pieces(keys, ids, counts, capacity, end_id, id_column):
    ends = np.cumsum(counts)
    closed = np.insert(ids.astype("<u4"), ends, end_id)
    length = counts + 1
    number = (length + capacity - 1) // capacity
    row = np.repeat(np.arange(len(counts)), number)
    piece = ragged(np.zeros(len(counts), dtype=np.int64), number)
    first = length - (number - 1) * capacity
    start = np.where(piece > 0, first[row] + (piece - 1) * capacity, 0)
    size = np.where(piece > 0, capacity, first[row])
    begin = (row_offsets(length)[:-1])[row] + start
    stops = np.append(begin, begin[-1] + size[-1] if len(begin) else 0).astype(np.int32) * 4
    blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(closed.tobytes())])
    return pa.RecordBatch.from_arrays(
        [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), blob],
        names=[id_column, "piece", "start", "length", "ids"],
    )


def packing_plan(counts, capacity=CAPACITY):
    """Runs ``(size, from_rank, items, per_sequence, first_sequence, offset)`` for ``counts`` of items by size, and the number of sequences.

    Items ``from_rank`` on of a size fill the run's sequences one after
    another, ``per_sequence`` to each, laid end to end from ``offset``.
    """
    left = dict(counts)
    used = dict.fromkeys(left, 0)
    runs, gaps, total = [], {}, 0

    def place(size, items, per_sequence, first, offset):
        runs.append((size, used[size], items, per_sequence, first, offset))
        used[size] += items
        left[size] -= items

    def leave(gap, first, number):
        if gap and number:
            gaps.setdefault(gap, []).append((first, number))

    large = sorted((s for s in left if 3 * s > capacity and left[s]), reverse=True)
    for at, size in enumerate(large):
        for partner in large[at:]:
            pairs = left[size] // 2 if partner == size else min(left[size], left[partner])
            if size + partner > capacity or not pairs:
                continue
            if partner == size:
                place(size, 2 * pairs, 2, total, 0)
            else:
                place(size, pairs, 1, total, 0)
                place(partner, pairs, 1, total, size)
            leave(capacity - size - partner, total, pairs)
            total += pairs
        if left[size]:
            leave(capacity - size, total, left[size])
            total, alone = total + left[size], left[size]
            place(size, alone, 1, total - alone, 0)

    open_gaps = sorted(gaps)
    for size in sorted((s for s in left if 3 * s <= capacity and left[s]), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                gap, fit = capacity, capacity // size
                number = -(-left[size] // fit)
                first, total = total, total + number
            else:
                gap = open_gaps[at]
                first, number = gaps[gap].pop()
                fit = gap // size
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            full = min(number, left[size] // fit)
            rest = left[size] - full * fit if full < number else 0
            rest = min(rest, fit)
            parts = [(gap - fit * size, first, full), (gap - rest * size, first + full, 1 if rest else 0)]
            parts.append((gap, first + full + (1 if rest else 0), number - full - (1 if rest else 0)))
            if full:
                place(size, full * fit, fit, first, capacity - gap)
            if rest:
                place(size, rest, rest, first + full, capacity - gap)
            for new_gap, begin, many in parts:
                if new_gap and many:
                    if new_gap not in gaps:
                        bisect.insort(open_gaps, new_gap)
                    gaps.setdefault(new_gap, []).append((begin, many))
    return runs, total


def pack(items, capacity=CAPACITY, length="length"):
    """``items`` with ``sequence_id`` and ``offset``; every item's length is from 1 to ``capacity``.

    ``items`` is sorted and written once with all its columns.
    """
    ties = [F.col(f"`{name}`") for name in items.columns if name != length]
    ordered = written_in_order(items, [F.col(f"`{length}`").desc(), *ties], "pack-order")
    counts = {row[0]: row[1] for row in ordered.groupBy(F.col(f"`{length}`")).count().collect()}  # at most `capacity` rows
    runs, _ = packing_plan(counts, capacity)
    above = dict(zip(sorted(counts, reverse=True), itertools.accumulate((counts[s] for s in sorted(counts, reverse=True)), initial=0)))
    runs.sort(key=lambda run: above[run[0]] + run[1])
    table = np.array([(above[size] + rank, per, first, offset, size) for size, rank, _, per, first, offset in runs], dtype=np.int64).reshape(-1, 5)

    @F.pandas_udf("sequence_id long, offset long")
    def place_of(position: pd.Series) -> pd.DataFrame:
        at = position.to_numpy()
        run = table[np.searchsorted(table[:, 0], at, side="right") - 1]
        within = at - run[:, 0]
        return pd.DataFrame({"sequence_id": run[:, 2] + within // run[:, 1], "offset": run[:, 3] + within % run[:, 1] * run[:, 4]})

    placed = with_position(ordered, "pack_position").withColumn("pack_place", place_of("pack_position"))
    return placed.select(*[f"`{name}`" for name in items.columns], "pack_place.sequence_id", "pack_place.offset")
