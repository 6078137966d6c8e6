"""Packing of neighbouring documents along a space-filling curve.

Every document is a vector of counts of its hashed token ids, damped and scaled
to length one. A fixed random matrix projects it to four axes. Mean and spread
of each axis over all documents stretch it to a grid, and the place of a grid
cell on the Hilbert curve is the document's key: documents that lie next to
each other on the curve are alike in all axes. Keys are range-sorted, token
counts are summed along the order, and the stream of all tokens is cut at every
``capacity`` tokens, so a sequence holds neighbours and no padding. What is
left at the end is cut into powers of two, at which no padding is needed.

Tokens are made once and written with two bytes each where the vocabulary
allows. Only keys and counts are sorted; the tokens are shuffled once, to meet
their places. A hot group of copies shares a key and is split by the count and
the row's number.

Null and empty texts are the end id alone and lie in the middle of the grid.
Repeated rows are separate documents. Null ids are kept. Further columns of the
documents are not read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.order import shuffle_width
from archgraph.llm.sized import scoped_batches
from archgraph.llm.text import mix64, ragged, row_offsets
from archgraph.llm.tokens import Encoder, word_level_cuts
from archgraph.session import materialize

CAPACITY = 4096
END_ID = 2
HASHED = 4096  # coordinates of the hashed vectors
AXES, BITS = 4, 15  # of the curve; a key has AXES * BITS bits
STEPS = 1 << 12  # of a projected coordinate; whole numbers make the sums over all documents exact
SEED = 20240229
CUT_BYTES = 4 << 20

AXIS = [f"axis_{i}" for i in range(AXES)]


def hashed_projections(ids, counts):
    """Projections of rows of ids, in whole ``STEPS``; a row without ids gives zeros."""
    rows = len(counts)
    mixed = mix64(ids.astype(np.uint64) + np.uint64(SEED))
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    out = np.zeros((rows, AXES), dtype=np.int32)
    ends = np.cumsum(counts)
    most = 512  # rows whose hashed vectors are held at once
    for first in range(0, rows, most):
        last = min(rows, first + most)
        own = slice(ends[first] - counts[first], ends[last - 1])
        row = np.repeat(np.arange(last - first), counts[first:last])
        cell = row * HASHED + (mixed[own] % np.uint64(HASHED)).astype(np.int64)
        vectors = np.bincount(cell, weights=sign[own], minlength=(last - first) * HASHED).reshape(-1, HASHED)
        vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
        out[first:last] = np.rint(vectors @ _directions() * STEPS)
    return out


_made = {}


def _directions():
    if "directions" not in _made:
        _made["directions"] = np.random.default_rng(SEED).normal(size=(HASHED, AXES))
    return _made["directions"]


def hilbert_keys(cells, bits=BITS):
    """Places on the Hilbert curve of grid cells (rows x axes, below 2**bits), after Skilling (2004)."""
    axis = [column.astype(np.int64) for column in cells.T]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(axis)):
            set_here = (axis[i] >> bit) & 1 == 1
            exchanged = np.where(set_here, 0, (axis[0] ^ axis[i]) & low)
            axis[0] = np.where(set_here, axis[0] ^ low, axis[0] ^ exchanged)
            if i:
                axis[i] = axis[i] ^ exchanged
    for i in range(1, len(axis)):
        axis[i] = axis[i] ^ axis[i - 1]
    turn = np.zeros_like(axis[-1])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((axis[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    key = np.zeros_like(turn)
    for bit in range(bits - 1, -1, -1):
        for column in axis:
            key = (key << 1) | (((column ^ turn) >> bit) & 1)
    return key


def token_rows(docs, tokenizer, cuts=word_level_cuts, end_id=END_ID, id_column="doc_id", text="text"):
    """Written rows of all documents: id column, ``ids``, ``n_tokens`` (with the end id), the axes, ``row_key``."""
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = np.dtype("<u2") if max(size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
    rows = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([
        rows.schema[id_column], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        *[T.StructField(name, T.IntegerType()) for name in AXIS],
    ])

    def encode(batches):
        encoder = Encoder.of(tokenizer, cuts)
        for batch in batches:
            for first, ids, counts in encoder.encode(batch.column(1)):
                closed = np.insert(ids.astype(width), np.cumsum(counts), end_id)
                axes = hashed_projections(ids, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(counts)), _blobs(closed, row_offsets(counts + 1)), pa.array(counts + 1, pa.int64()),
                     *[pa.array(axes[:, i]) for i in range(AXES)]],
                    names=schema.names,
                )

    with scoped_batches(docs.sparkSession):
        written = materialize(rows.mapInArrow(encode, schema).withColumn("row_key", F.monotonically_increasing_id()), "curve-tokens")
    return written, width.str


def _blobs(values, offsets):
    """Rows of values, from their offsets, as a binary column."""
    stops = (offsets * values.itemsize).astype(np.int64)
    kind = pa.large_binary() if stops[-1] >= 1 << 31 else pa.binary()
    stops = stops.astype(np.int64 if kind == pa.large_binary() else np.int32)
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(values.tobytes())])


def with_keys(tokens):
    """Tokens' rows with ``curve_key``; the grid follows mean and spread of all documents."""
    sums = tokens.select(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a).cast("long")).alias(f"{a}_sum") for a in AXIS],
        *[F.sum((F.col(a).cast("long") * F.col(a)).cast("decimal(20,0)")).alias(f"{a}_squares") for a in AXIS],
    ).first()
    n = max(sums["n"], 1)
    mean = np.array([float(sums[f"{a}_sum"] or 0) / n for a in AXIS])
    spread = np.array([float(sums[f"{a}_squares"] or 0) / n for a in AXIS]) - mean**2
    spread = np.sqrt(np.maximum(spread, 1.0))

    @F.pandas_udf("long")
    def key_of(*axes: pd.Series) -> pd.Series:
        scaled = (np.column_stack([a.to_numpy() for a in axes]) - mean) / spread
        share = 1 / (1 + np.exp(-1.702 * np.clip(scaled, -20, 20)))  # about the normal distribution's
        return pd.Series(hilbert_keys(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return tokens.withColumn("curve_key", key_of(*AXIS))


def along_the_curve(keyed):
    """``row_key`` and ``begin``, the tokens of all documents before it on the curve; and the number of all tokens."""
    keys = ["curve_key", "n_tokens", "row_key"]
    spark = keyed.sparkSession
    ordered = keyed.select(*keys).repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    rows = ordered.select("row_key", "n_tokens", F.spark_partition_id().alias("part"))

    def running(batches):
        total = 0
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            ends = total + np.cumsum(sizes)
            if len(ends):
                total = int(ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - sizes), batch.column(1), batch.column(2)], names=["row_key", "before", "n_tokens", "part"])

    summed = materialize(rows.mapInArrow(running, "row_key long, before long, n_tokens long, part int"), "curve-order")
    parts = summed.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(parts.select("part", "part_tokens", before.alias("part_start")), "curve-starts")  # a row per part
    total = starts.agg(F.sum("part_tokens")).first()[0] or 0
    return summed.join(starts, "part").select("row_key", (F.col("part_start") + F.col("before")).alias("begin")), total


def sequence_starts(total, capacity=CAPACITY):
    """Number of full sequences, and where the sequences after them start, with the end of the last one."""
    full, rest = divmod(total, capacity)
    starts = [full * capacity]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            starts.append(starts[-1] + (1 << bit))
    return full, np.array(starts, dtype=np.int64)


def pack_along_curve(docs, tokenizer, capacity=CAPACITY, cuts=word_level_cuts, end_id=END_ID, id_column="doc_id", text="text"):
    """Pieces of all documents: id column, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    Sequences are numbered along the curve and have no gaps. All but the last
    few hold ``capacity`` tokens; the rest are powers of two.
    """
    tokens, width = token_rows(docs, tokenizer, cuts, end_id, id_column, text)
    places, total = along_the_curve(with_keys(tokens))
    full, tail = sequence_starts(total, capacity)
    rows = tokens.select("row_key", F.col(f"`{id_column}`"), "ids").join(places, "row_key").drop("row_key")
    schema = T.StructType([
        rows.schema[id_column], *[T.StructField(name, T.LongType()) for name in ("start", "length")], T.StructField("ids", T.BinaryType()),
        *[T.StructField(name, T.LongType()) for name in ("doc_tokens", "sequence_id", "offset")],
    ])

    def sequence_at(position):
        return np.where(position < full * capacity, position // capacity, full - 1 + np.searchsorted(tail, position, side="right"))

    def start_of(sequence):
        return np.where(sequence < full, sequence * capacity, tail[np.clip(sequence - full, 0, len(tail) - 1)])

    def cut(batches):
        for batch in batches:
            blobs = batch.column(1)
            ends = np.frombuffer(blobs.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(blobs.type) else np.int32)
            ends = ends[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
            values = np.frombuffer(blobs.buffers()[2], dtype=np.uint8)
            first = 0
            while first < len(blobs):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CUT_BYTES, side="right")) - 1)
                ids = values[ends[first] : ends[last]].view(width).astype("<u4")
                tokens_of = np.diff(ends[first : last + 1]) // np.dtype(width).itemsize
                begin = batch.column(2).to_numpy()[first:last]
                own = sequence_at(begin)
                number = sequence_at(begin + tokens_of - 1) - own + 1
                row = np.repeat(np.arange(last - first), number)
                sequence = ragged(own, number)
                piece_begin = np.maximum(begin[row], start_of(sequence))
                piece_end = np.minimum((begin + tokens_of)[row], start_of(sequence + 1))
                length = piece_end - piece_begin
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(piece_begin - begin[row]), pa.array(length),
                     _blobs(ids, row_offsets(length)).cast(pa.binary()), pa.array(tokens_of[row]), pa.array(sequence), pa.array(piece_begin - start_of(sequence))],
                    names=schema.names,
                )
                first = last

    return rows.mapInArrow(cut, schema)
