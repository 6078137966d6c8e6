"""Token ids in files of frames: frequency-ranked, byte-aligned, with separate control bytes.

Ids are replaced by their rank in the frequencies of the whole corpus, so
common ids are small numbers. A number takes one to four bytes, low byte first;
a control byte holds the lengths of four numbers, two bits each. A document's
numbers start on a fresh control byte. Numbers and control bytes are kept in
two separate streams, and decoded in numpy: a table of 256 rows gives the
lengths behind a control byte.

A file folder holds ``ranks`` (the ids in rank order) and ``frames``. A frame
is a run of documents in ascending id order: their ids, their numbers of ids,
the control stream and the data stream. Frames are rows of Parquet files, so
Spark's commit protocol covers them: a lost or repeated task leaves no half
files. The order of frames is in the column ``first_place``.

Texts are tokenised where they are read. Only their ids, two bytes each where
they allow it, are sorted by document.

Null and empty texts are the end id alone. Documents with equal ids are
ordered by a checksum of their tokens; a null id comes first.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.order import part_of
from archgraph.llm.sized import broadcast_if_small, scoped_batches
from archgraph.llm.text import ragged, row_offsets
from archgraph.llm.tokens import Encoder, word_level_cuts
from archgraph.session import materialize, new_folder

END_ID = 2
FRAME_IDS = 1 << 18
_LENGTHS = np.array([[(byte >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for byte in range(256)], dtype=np.uint8)


def encode_numbers(values, counts):
    """Control bytes and data bytes of rows of numbers laid end to end, and both streams' lengths per row."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    data = values.view(np.uint8)[ragged(np.arange(len(values)) * 4, size)]
    controls = (counts + 3) // 4
    slot = ragged(row_offsets(controls)[:-1] * 4, counts)
    codes = np.zeros(int(controls.sum()) * 4, dtype=np.uint8)
    codes[slot] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    sums = np.concatenate(([0], np.cumsum(size)))
    ends = np.cumsum(counts)
    return control, data, controls, sums[ends] - sums[ends - counts]


def decode_numbers(control, data, counts):
    """The numbers of the rows, laid end to end."""
    controls = (counts + 3) // 4
    size = _LENGTHS[control].reshape(-1)[ragged(row_offsets(controls)[:-1] * 4, counts)].astype(np.int64)
    begin = np.cumsum(size) - size
    values = np.zeros(len(size), dtype=np.uint32)
    for step in range(int(size.max()) if len(size) else 0):
        longer = np.flatnonzero(size > step)
        values[longer] |= data[begin[longer] + step].astype(np.uint32) << np.uint32(8 * step)
    return values


def _binary(lengths, data):
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _bytes_of(column):
    """All bytes of a binary column without nulls, laid end to end."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def write_token_files(docs, folder, tokenizer, end_id=END_ID, id_column="doc_id", text="text"):
    """Tokenise all documents once, count ids over all of them, and write the files."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_column}`").alias("key"), F.col(f"`{text}`").alias("text"))
    key = rows.schema["key"]
    coded = T.StructType([key, T.StructField("tie", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def tokenise(batches):
        encoder = Encoder.of(tokenizer, word_level_cuts)
        for batch in batches:
            for first, ids, counts in encoder.encode(batch.column("text")):
                many = len(counts)
                closed = np.insert(ids, np.cumsum(counts), end_id)
                narrow = closed.astype("<u4" if len(closed) and closed.max() > 0xFFFF else "<u2")
                cuts = (row_offsets(counts + 1) * narrow.itemsize).tolist()
                raw_bytes = memoryview(narrow.tobytes())
                ties = [zlib.crc32(raw_bytes[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(first, many), pa.array(ties, pa.int64()),
                    pa.array(counts + 1, pa.int64()), _binary((counts + 1) * narrow.itemsize, narrow),
                ], names=["key", "tie", "n", "ids"])

    raw = new_folder(spark, "token-ids")
    with scoped_batches(spark):
        rows.mapInArrow(tokenise, coded).write.option("compression", "zstd").parquet(raw)
    tokens = spark.read.schema(coded).parquet(raw)

    def ids_in(batch):
        """Ids of a batch; a row's width in bytes follows from its number of ids."""
        many = batch.column("n").to_numpy()
        column = batch.column("ids")
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        wide = np.diff(ends) == many * 4
        data = _bytes_of(column)
        if not wide.any():
            return data.view("<u2").astype(np.uint32), many
        begin = ends[:-1] - ends[0]
        step = np.repeat(np.where(wide, 4, 2), many)
        at = np.repeat(begin, many) + ragged(np.zeros(len(many), dtype=np.int64), many) * step
        padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
        low = padded[at] | padded[at + 1] << np.uint32(8)
        return np.where(step == 4, low | padded[at + 2] << np.uint32(16) | padded[at + 3] << np.uint32(24), low), many

    def count(batches):
        totals = np.zeros(0, dtype=np.int64)
        for batch in batches:
            found = np.bincount(ids_in(batch)[0])
            if len(found) > len(totals):
                found, totals = totals, found
            totals[: len(found)] += found
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(totals[at], pa.int64())], names=["id", "n"])

    counts = tokens.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counts.collect()  # one row per id in use: bounded by the vocabulary
    found.sort(key=lambda row: (-row.n, row.id))
    spark.createDataFrame([(rank, row.id, row.n) for rank, row in enumerate(found)], "rank long, id long, n long").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(max((row.id for row in found), default=0) + 1, dtype=np.uint32)
    rank_of[[row.id for row in found]] = np.arange(len(found))

    frame = T.StructType([
        T.StructField("first_place", T.LongType()), T.StructField("ids_total", T.LongType()), T.StructField("keys", T.ArrayType(key.dataType)),
        T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType()),
    ])

    def frames(batches):
        for batch in batches:
            values, many = ids_in(batch)
            control, data, controls, widths = encode_numbers(rank_of[values], many)
            places, keys = batch.column("place").to_numpy(), batch.column("key")
            before = np.cumsum(many) - many
            begins = np.flatnonzero(np.concatenate(([True], (before[1:] // FRAME_IDS != before[:-1] // FRAME_IDS) | (np.diff(places) != 1)))) if len(many) else []
            c, d = row_offsets(controls), row_offsets(widths)
            for first, last in zip(begins, [*begins[1:], len(many)]):
                yield pa.RecordBatch.from_arrays([
                    pa.array([places[first]], pa.int64()), pa.array([many[first:last].sum()], pa.int64()),
                    pa.array([keys.slice(first, last - first).to_pylist()], pa.list_(keys.type)), pa.array([many[first:last]], pa.list_(pa.int64())),
                    pa.array([control[c[first] : c[last]].tobytes()], pa.binary()), pa.array([data[d[first] : d[last]].tobytes()], pa.binary()),
                ], names=[f.name for f in frame])

    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    sorted_tokens = tokens.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    placed = sorted_tokens.select(F.monotonically_increasing_id().alias("place"), "key", "n", "ids")
    with scoped_batches(spark):
        placed.mapInArrow(frames, frame).write.option("compression", "zstd").parquet(f"{folder}/frames")


def read_token_files(spark, folder):
    """Documents of the files: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian unsigned 32-bit)."""
    id_of = np.array([row.id for row in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()], dtype="<u4")  # bounded by the vocabulary
    frames = spark.read.parquet(f"{folder}/frames")
    index = frames.select("first_place", "ids_total").withColumn("part", part_of("first_place"))
    parts = index.groupBy("part").agg(F.sum("ids_total").alias("part_ids"))
    parts = parts.select("part", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    within = F.coalesce(F.sum("ids_total").over(Window.partitionBy("part").orderBy("first_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = index.withColumn("within", within).join(parts, "part").select("first_place", (F.col("part_start") + F.col("within")).alias("frame_start"))
    # Two numbers a frame: the frames stay where they are while these are few.
    placed = frames.join(broadcast_if_small(materialize(starts, "frame-starts")), "first_place").select("frame_start", "keys", "counts", "control", "data")
    schema = T.StructType([T.StructField("key", frames.schema["keys"].dataType.elementType), *T.StructType.fromDDL("start long, n_tokens long, ids binary").fields])

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, many, control, data = (batch.column(i).slice(row, 1) for i in range(5))
                counts = many.flatten().to_numpy()
                ids = id_of[decode_numbers(_bytes_of(control), _bytes_of(data), counts)]
                before = int(start[0].as_py()) + np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [keys.flatten(), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), _binary(counts * 4, ids)], names=[f.name for f in schema]
                )

    return placed.mapInArrow(decode, schema)
