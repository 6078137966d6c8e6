"""Text quality by a small convolutional network over bytes, in numpy.

Every byte position of a text is the start of one window of ``WIDTH`` bytes, to
which learned filters are applied. Filter outputs are max-pooled in cells of 64
positions, and cells in overlapping chunks of four cells, one chunk every three
cells, over the whole text. A hidden layer turns a chunk into a few features;
their means over all chunks give one probability. Only the bytes are input.

The network is fitted on the driver to a bounded sample: at most
``SAMPLE_DOCS`` labelled documents of each class and ``SAMPLE_CHUNKS`` random
chunks of each; of a repeated id one text is taken. Class shares come from all
usable labels. Scoring reads every byte of every text, in one map without a
shuffle.

Null and empty texts are one chunk of padding. Documents whose labels
contradict each other count by the majority; ties are good. Without labels of
both classes the score is the share of good labels, or 1/2 without any. Scores
do not depend on batches; repeated rows get equal scores.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.sized import bounded_batches
from archgraph.llm.text import text_slices
from archgraph.session import materialize

WIDTH = 5
FILTERS = 16
BYTE_SIZE = 8
HIDDEN = 16
CELL = 64
CHUNK_CELLS = 4
CHUNK_STEP = 3
THRESHOLD = 0.7
SAMPLE_DOCS = 2500
SAMPLE_CHUNKS = 12
STEPS = 900
BATCH = 96
SEED = 7
HELD_OUT = 2
_CHUNK = CELL * CHUNK_CELLS
_SLICE = 1 << 19


def remainder(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def usable_labels(labels, id_column="doc_id", label="quality", held_out=HELD_OUT):
    """``doc_id``, ``good``: labels outside the held-out part, one row per document."""
    rows = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & (remainder(F.col(id_column)) != held_out))
    return rows.groupBy(F.col(id_column).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("good"))


def sample_chunks(docs, labels, id_column="doc_id", text="text"):
    """Chunks of the bounded training sample: ``(bytes of n x chunk length, document number, good of each document)`` and class counts."""
    bounded_batches(docs.sparkSession)
    usable = usable_labels(labels)
    counts = {row.good: row["count"] for row in usable.groupBy("good").count().collect()}
    drawn = [
        usable.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS) for good in (0, 1)
    ]
    drawn = drawn[0].union(drawn[1])  # at most 2 * SAMPLE_DOCS rows of two numbers
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(drawn), "doc_id")
    text_hash = F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")
    one_text = rows.select("doc_id", text_hash).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))

    def cut(batches):
        seen = set()  # at most as many as drawn ids
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                for row in range(len(offsets) - 1):
                    own = data[offsets[row] : offsets[row + 1]]
                    doc_id = batch.column("doc_id")[first + row].as_py()
                    if doc_id in seen:
                        continue
                    seen.add(doc_id)
                    draw = np.random.default_rng([SEED, zlib.crc32(str(doc_id).encode())])
                    last = max(0, len(own) - _CHUNK // 2)
                    begins = np.unique(draw.integers(0, last + 1, SAMPLE_CHUNKS)) if last else np.zeros(1, dtype=int)
                    padded = np.zeros(len(own) + _CHUNK + WIDTH, dtype=np.uint8)
                    padded[: len(own)] = own
                    pieces = b"".join(padded[b : b + _CHUNK + WIDTH - 1].tobytes() for b in begins)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first + row, 1), batch.column("good").slice(first + row, 1), pa.array([pieces], pa.binary())], names=["doc_id", "good", "pieces"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("good", T.IntegerType()), T.StructField("pieces", T.BinaryType())])
    # A repeated id gives one row: its smallest text hash, and one of the rows with equal texts.
    wanted = materialize(one_text, "sampled-ids")  # at most as many rows as drawn ids
    own = rows.select("doc_id", "good", "text", text_hash).join(F.broadcast(wanted), ["doc_id", "text_hash"])
    cuts = own.select("doc_id", "good", "text").mapInArrow(cut, schema)
    found = sorted(cuts.groupBy("doc_id", "good").agg(F.min("pieces").alias("pieces")).collect(), key=lambda r: (str(r.doc_id), bytes(r.pieces)))
    width = _CHUNK + WIDTH - 1
    pieces = [np.frombuffer(bytes(r.pieces), dtype=np.uint8).reshape(-1, width) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(p) for p in pieces])
    chunks = np.concatenate(pieces) if pieces else np.zeros((0, width), np.uint8)
    return chunks, owner, np.array([r.good for r in found], dtype=np.int64), counts


def _start(draw):
    scale = lambda *shape: draw.normal(0, 1, shape).astype(np.float32)
    return {
        "bytes": scale(256, BYTE_SIZE) * 0.5, "filters": scale(WIDTH, BYTE_SIZE, FILTERS) / np.sqrt(WIDTH * BYTE_SIZE),
        "filter_bias": np.zeros(FILTERS, np.float32), "hidden": scale(FILTERS, HIDDEN) / np.sqrt(FILTERS),
        "hidden_bias": np.zeros(HIDDEN, np.float32), "out": scale(HIDDEN) / np.sqrt(HIDDEN), "out_bias": np.zeros(1, np.float32),
    }


def _tables(model):
    """What every byte adds to every filter at every place of a window."""
    return np.stack([model["bytes"] @ model["filters"][place] for place in range(WIDTH)])


def _filtered(tables, bytes_, bias):
    """Filter outputs at all window starts; the last WIDTH - 1 bytes start none."""
    length = bytes_.shape[-1] - WIDTH + 1
    total = tables[0][bytes_[..., :length]]
    for place in range(1, WIDTH):
        total += tables[place][bytes_[..., place : place + length]]
    total += bias
    return total


def fit(chunks, owner, good, counts, steps=STEPS, seed=SEED):
    """The fitted network, or None where a class is missing."""
    if len(good) == 0 or good.min() == good.max():
        return None
    draw = np.random.default_rng(seed)
    model = _start(draw)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    begin = np.searchsorted(owner, np.arange(len(good) + 1))
    classes = [np.flatnonzero(good == g) for g in (0, 1)]
    for step in range(1, steps + 1):
        docs = np.concatenate([draw.choice(c, BATCH // 2) for c in classes])
        number = np.minimum(begin[docs + 1] - begin[docs], 3)
        rows = np.concatenate([draw.integers(begin[d], begin[d + 1], n) for d, n in zip(docs, number)])
        of = np.repeat(np.arange(len(docs)), number)
        gradients = _gradients(model, chunks[rows], of, number, good[docs])
        rate = 0.006 * min(1.0, 2 * (1 - step / (steps + 1)))
        for key, gradient in gradients.items():
            first[key] = 0.9 * first[key] + 0.1 * gradient
            second[key] = 0.99 * second[key] + 0.01 * gradient**2
            model[key] -= rate * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-6)
    model["out_bias"] = model["out_bias"] + np.float32(np.log(counts[1] / counts[0]))  # batches hold as many of each class
    return model


def _gradients(model, chunks, of, number, good):
    values = _filtered(_tables(model), chunks, model["filter_bias"])
    best = values.argmax(axis=1)
    pooled = np.take_along_axis(values, best[:, None, :], axis=1)[:, 0]
    active = np.maximum(pooled, 0)
    inner = active @ model["hidden"] + model["hidden_bias"]
    hidden = np.maximum(inner, 0)
    mean = np.zeros((len(good), HIDDEN), np.float32)
    np.add.at(mean, of, hidden / number[of, None].astype(np.float32))
    score = 1 / (1 + np.exp(-(mean @ model["out"] + model["out_bias"][0])))
    error = ((score - good) / len(good)).astype(np.float32)
    d_hidden = (error[of] / number[of])[:, None].astype(np.float32) * model["out"] * (inner > 0)
    d_pooled = (d_hidden @ model["hidden"].T) * (pooled > 0)
    window = np.stack([np.take_along_axis(chunks, best + place, axis=1) for place in range(WIDTH)])
    d_filters = np.zeros_like(model["filters"])
    d_bytes = np.zeros_like(model["bytes"])
    for place in range(WIDTH):
        d_filters[place] = np.einsum("nfb,nf->bf", model["bytes"][window[place]], d_pooled)
        np.add.at(d_bytes, window[place], d_pooled[:, :, None] * model["filters"][place].T[None])
    decay = 1e-4
    return {
        "bytes": d_bytes + decay * model["bytes"], "filters": d_filters + decay * model["filters"], "filter_bias": d_pooled.sum(axis=0),
        "hidden": active.T @ d_hidden + decay * model["hidden"], "hidden_bias": d_hidden.sum(axis=0), "out": mean.T @ error + decay * model["out"],
        "out_bias": np.array([error.sum()], np.float32),
    }


def score_texts(model, tables, data, offsets):
    """Probabilities of the rows of a slice."""
    lengths = np.diff(offsets)
    cells = np.maximum(CHUNK_CELLS, (lengths + WIDTH - 1 + CELL - 1) // CELL)
    begin = np.concatenate(([0], np.cumsum(cells)))
    padded = np.zeros(int(begin[-1]) * CELL + WIDTH - 1, dtype=np.uint8)
    shift = begin[:-1] * CELL - offsets[:-1]
    padded[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    pooled = np.empty((int(begin[-1]), FILTERS), np.float32)
    zone = 1 << 10
    last_cells = np.zeros(int(begin[-1]), dtype=bool)
    last_cells[begin[1:] - 1] = True
    for low in range(0, int(begin[-1]), zone):
        high = min(low + zone, int(begin[-1]))
        values = _filtered(tables, padded[low * CELL : high * CELL + WIDTH - 1], model["filter_bias"]).reshape(high - low, CELL, FILTERS)
        values[last_cells[low:high], CELL - WIDTH + 1 :] = 0  # windows that reach into the next row
        values.max(axis=1, out=pooled[low:high])
    np.maximum(pooled, 0, out=pooled)
    number = 1 + -(-(cells - CHUNK_CELLS) // CHUNK_STEP)
    of = np.repeat(np.arange(len(cells)), number)
    step = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    first = begin[of] + np.minimum(step * CHUNK_STEP, cells[of] - CHUNK_CELLS)
    chunk = pooled[first]
    for more in range(1, CHUNK_CELLS):
        np.maximum(chunk, pooled[first + more], out=chunk)
    hidden = np.maximum(chunk @ model["hidden"] + model["hidden_bias"], 0).astype(np.float64)
    mean = np.add.reduceat(hidden, np.cumsum(number) - number, axis=0) / number[:, None]
    return 1 / (1 + np.exp(-(mean @ model["out"].astype(np.float64) + float(model["out_bias"][0]))))


def fit_quality(docs, labels, id_column="doc_id", text="text"):
    """``(network or None, score without a network)``."""
    *sample, counts = sample_chunks(docs, labels, id_column, text)
    total = sum(counts.values())
    return fit(*sample, counts), counts.get(1, 0) / total if total else 0.5


def quality_scores(docs, fitted, keep=("doc_id",), text="text", threshold=THRESHOLD):
    """``keep`` columns, ``score`` and ``predicted`` (1 from the threshold on) of every document."""
    model, constant = fitted
    own = ("score", "predicted")
    asked = [name for name in keep if name not in own]
    kept = [name for name in asked if name != text]
    rows = docs.select(*[F.col(f"`{name}`").alias(name) for name in kept], F.col(f"`{text}`").alias("scored text"))
    passed = [*kept, "scored text"] if text in asked else kept  # a text goes to Python once
    schema = T.StructType([*(rows.schema[n] for n in passed), T.StructField("score", T.DoubleType())])

    def score(batches):
        tables = _tables(model) if model else None
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("scored text"), _SLICE):
                many = len(offsets) - 1
                scores = score_texts(model, tables, data, offsets) if model else np.full(many, constant)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, many) for i in range(len(passed))), pa.array(scores)], names=schema.fieldNames())

    scored = rows.mapInArrow(score, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    return scored.select(*[F.col("`scored text`").alias(text) if name == text else F.col(f"`{name}`") for name in asked], *own)
