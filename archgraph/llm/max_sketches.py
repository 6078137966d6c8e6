"""Ranked lexical search by hashed max-sketches.

A document's impact of a term depends on the term's occurrences and on the
document's length alone, and rises with the occurrences. Terms are hashed to
65,536 coordinates, and a coordinate keeps the greatest impact of the
document's terms that fall on it: as occurrences while the corpus statistics
are not yet known, as impact once they are. A query's weights, looked up
in the coordinates for a whole batch of queries at once, so give an upper bound
of its score. Documents are rescored exactly in the order of falling bounds,
in rounds, until no bound reaches the score of the last wanted place; what
stays behind that cannot be among the results.

One pass over the texts writes the sketches, the lengths and, for the terms of
the queries, the counts of documents. Equal texts have equal scores: each text
is rescored once and stands for at most ``k`` smallest ids, so a hot group of
copies costs no more than one document after the bounds. Queries are taken in
blocks of 1,000; a block's terms are sent to the tasks.

Terms are told apart by 64-bit hashes and texts by MD5. Null and empty texts,
and texts without a term, are found by nothing. Every row of the documents is a
document, also repeated ones; null ids come last among equals. Equal rows of the
queries are one query; a query without terms has no results. Further columns
are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.order import with_position, written_in_order
from archgraph.llm.sized import broadcast_if_small, scoped_batches
from archgraph.llm.text import LOWER, byte_table, hash_spans, ragged, row_offsets, spans, text_slices, word_counts
from archgraph.operators.topk import top_k
from archgraph.session import materialize

TOP_K = 10
QUERY_BLOCK = 1000
COORDINATE_BITS = 16
MOST_TF = 255  # kept exactly; beyond, the greatest impact of all stands in
FIRST_ROUND, LATER_ROUNDS = 64, 1024  # texts rescored per query and round
CELLS = 1 << 20  # of a document x query table held at once

_TERM = byte_table((ord("0"), ord("9")), (ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xFF))
# Fixed values of the ranking: units of an impact, and the shares of a document's length.
UNITS, SCALE, LENGTH_SHARE = 1_000_000_000, 1000, 90


def term_counts(data, offsets):
    """Per row its number of terms; and row, hash and occurrences of its distinct terms, in the order of rows."""
    rows = len(offsets) - 1
    low = LOWER[data]
    start, end, row = spans(low, offsets, _TERM)
    hashes = hash_spans(low, start, end)
    order = np.argsort(hashes)
    if rows <= 1 << 16:
        order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]  # by radix
    else:
        order = order[np.argsort(row[order], kind="stable")]
    row_of, hashes = row[order], hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (row_of[1:] != row_of[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return word_counts(row, rows), row_of[first], hashes[first], np.diff(np.append(first, len(order)))


def fold(row, hashes, times, rows):
    """Coordinatewise maxima of every row: coordinates and occurrences laid end to end, and their number per row."""
    coordinate = hashes >> np.uint64(64 - COORDINATE_BITS)
    packed = (row.astype(np.uint64) << np.uint64(32)) | (coordinate << np.uint64(8)) | np.minimum(times, MOST_TF).astype(np.uint64)
    packed.sort()
    cell = packed >> np.uint64(8)
    last = np.ones(len(cell), dtype=bool)
    last[:-1] = cell[1:] != cell[:-1]
    kept = packed[last]
    return (
        ((kept >> np.uint64(8)) & np.uint64(0xFFFF)).astype("<u2"), (kept & np.uint64(0xFF)).astype(np.uint8),
        np.bincount((kept >> np.uint64(32)).astype(np.int64), minlength=rows),
    )


def impact(times, length_norm):
    return (UNITS * times) // (SCALE * times + 8 * length_norm)


def length_norms(n, documents, words):
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // max(words, 1)


def query_terms(queries, item_id, text):
    """Written rows ``item``, the query's id and ``term`` hashes of all distinct queries, numbered in ``item`` from 0."""
    rows = queries.select(F.col(f"`{item_id}`").alias("asked_id"), F.col(f"`{text}`").alias("asked_text")).distinct()
    placed = with_position(written_in_order(rows, ["asked_id", "asked_text"], "asked"), "item")
    schema = T.StructType([T.StructField("item", T.LongType()), rows.schema["asked_id"], T.StructField("terms", T.ArrayType(T.LongType()))])

    def hashed(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column(2)):
                rows = len(offsets) - 1
                _, row, hashes, _ = term_counts(data, offsets)
                counts = np.bincount(row, minlength=rows)
                lists = pa.ListArray.from_arrays(pa.array(row_offsets(counts), pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), lists], names=schema.names)

    return materialize(placed.select("item", "asked_id", "asked_text").mapInArrow(hashed, schema), "asked-terms")


class Lookup:
    """The terms of a block of queries, by hash and by coordinate. Sent to tasks; its size is that of the block."""

    def __init__(self, items, terms):
        """``terms[i]`` are the hashes of query ``items[i]``."""
        self.items = np.array(items, dtype=np.int64)
        number = np.repeat(np.arange(len(items)), [len(x) for x in terms])
        flat = np.array([h for x in terms for h in x], dtype=np.int64).view(np.uint64)
        self.hashes, slot = np.unique(flat, return_inverse=True)
        order = np.argsort(slot, kind="stable")
        self.entry_item = number[order]
        self.slot_start = row_offsets(np.bincount(slot, minlength=len(self.hashes)))
        self.weights = None

    def weigh(self, documents, words, held):
        """Take the corpus statistics; ``held`` has the number of documents of a slot."""
        self.documents, self.words = documents, words
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(self.hashes))], dtype=np.int64)
        # Terms come sorted by hash and coordinates are its highest bits, so those of a coordinate lie together.
        at = (self.hashes >> np.uint64(64 - COORDINATE_BITS)).astype(np.int64)
        self.coordinate_start = np.searchsorted(at, np.arange((1 << COORDINATE_BITS) + 1))

    def slots_of(self, hashes):
        """Slot of every hash, -1 for terms that no query has."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def table(self, rows, row, slot, worth):
        """Sums of weight x worth for every row and query; ``worth`` belongs to entries (row, slot)."""
        each = self.slot_start[slot + 1] - self.slot_start[slot]
        entry = ragged(self.slot_start[slot], each)
        cell = np.repeat(row, each) * len(self.items) + self.entry_item[entry]
        value = np.repeat(worth * self.weights[slot], each)
        return np.bincount(cell, weights=value, minlength=rows * len(self.items)).reshape(rows, -1)

    def bounds(self, rows, row, coordinate, worth):
        first, last = self.coordinate_start[coordinate], self.coordinate_start[coordinate + 1]
        each = last - first
        return self.table(rows, np.repeat(row, each), ragged(first, each), np.repeat(worth, each))

    def rows_at_once(self):
        return max(1, CELLS // max(1, len(self.items)))


_SKETCHED = "terms long, coordinates binary, times binary, slot int, held long"


def sketches(docs, lookup, id_column="doc_id", text="text", sketched=True):
    """Written rows of all documents (id, ``text_key``, ``terms``, the sketch), and of every task's document counts by ``slot``."""
    rows = docs.select(F.col(f"`{id_column}`").alias("found_id"), F.col(f"`{text}`").alias("found_text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("found_text", F.lit("")))))
    schema = T.StructType([rows.schema["found_id"], T.StructField("text_key", T.BinaryType()), *T._parse_datatype_string(_SKETCHED).fields])
    hashes = lookup.hashes

    def sketch(batches):
        held = np.zeros(len(hashes), dtype=np.int64)
        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for first, data, offsets in text_slices(batch.column(1)):
                rows = len(offsets) - 1
                counts, row, terms, times = term_counts(data, offsets)
                slot = lookup.slots_of(terms)
                held += np.bincount(slot[slot >= 0], minlength=len(hashes))
                if not sketched:
                    continue
                at, most, number = fold(row, terms, times, rows)
                cuts = row_offsets(number)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(2).slice(first, rows), pa.array(counts, pa.int64()), _binary(at, cuts), _binary(most, cuts),
                     pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64())], names=schema.names)
        some = np.flatnonzero(held)
        if len(some):
            nulls = [pa.nulls(len(some), t) for t in (kind, pa.binary(), pa.int64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array(some, pa.int32()), pa.array(held[some])], names=schema.names)

    with scoped_batches(docs.sparkSession):
        return materialize(rows.select("found_id", "found_text", "text_key").mapInArrow(sketch, schema), "max-sketches")


def _binary(values, offsets):
    stops = (offsets * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(stops.tobytes()), pa.py_buffer(values.tobytes())])


def _flat(column, dtype):
    """Values of a binary column laid end to end, and their number per row."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw.view(dtype), np.diff(ends) // np.dtype(dtype).itemsize


def _keys(column):
    """The two halves of MD5 values, in the order of their bytes."""
    raw, _ = _flat(column, np.uint8)
    return raw.view(">u8").reshape(-1, 2).astype(np.uint64)


class Best:
    """Pairs of query and text met so far: the ``k`` best texts of every query, or with ``ties`` all that are as good as these."""

    def __init__(self, items, k, ties=False, most=200_000):
        self.k, self.ties, self.most = k, ties, most
        self.least = np.zeros(items)
        self.parts, self.held = [], 0

    def add(self, table, keys, row, item):
        self.parts.append((item, table[row, item], keys[row], row))
        self.held += len(row)

    def wanted(self, table, allowed=None):
        good = (table > 0) & (table >= self.least)
        return np.nonzero(good if allowed is None else good & allowed)

    def cut(self, extra=None):
        """Keep what can still be wanted; texts met twice count once."""
        if not self.parts:
            return None
        item, value, keys = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        ids = np.concatenate([p[3] for p in self.parts])
        order = np.lexsort((keys[:, 1], keys[:, 0], -value, item))
        item, value, keys, ids = item[order], value[order], keys[order], ids[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
        item, value, keys, ids = item[new], value[new], keys[new], ids[new]
        first = np.searchsorted(item, np.arange(len(self.least)))
        place = np.arange(len(item)) - first[item]
        last = place == self.k - 1
        self.least[item[last]] = value[last]
        kept = value >= self.least[item] if self.ties else place < self.k
        self.parts = [(item[kept], value[kept], keys[kept], ids[kept])]
        self.held = int(kept.sum())
        self.most = max(self.most, 2 * self.held)
        return self.parts[0]


def by_bound(written, lookup, cursor, floor, k):
    """The next ``k`` texts of every query by falling bound after the cursor, as ``item, bound, text_key`` and one ``found_id`` of the text."""
    rows = written.where("slot IS NULL AND terms > 0").select("found_id", "text_key", "terms", "coordinates", "times")
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("bound", T.DoubleType()), T.StructField("text_key", T.BinaryType()), rows.schema["found_id"]])
    at_bound, at_key = cursor

    def scan(batches):
        best = Best(len(lookup.items), k)
        id_parts, seen = [], 0
        for batch in batches:
            keys = _keys(batch.column(1))
            norms = length_norms(batch.column(2).to_numpy(), lookup.documents, lookup.words)
            coordinates, number = _flat(batch.column(3), "<u2")
            times, _ = _flat(batch.column(4), np.uint8)
            cuts = row_offsets(number)
            id_parts.append(batch.column(0))
            step = lookup.rows_at_once()
            for a in range(0, batch.num_rows, step):
                b = min(batch.num_rows, a + step)
                own = slice(cuts[a], cuts[b])
                row, tf = np.repeat(np.arange(b - a), number[a:b]), times[own].astype(np.int64)
                worth = np.where(tf < MOST_TF, impact(tf, norms[a:b][row]), UNITS // SCALE)
                table = lookup.bounds(b - a, row, coordinates[own].astype(np.int64), worth)
                high, low = keys[a:b, :1], keys[a:b, 1:]
                later = (high > at_key[:, 0]) | ((high == at_key[:, 0]) & (low > at_key[:, 1]))
                allowed = (table >= floor) & ((table < at_bound) | ((table == at_bound) & later))
                hit, item = best.wanted(table, allowed)
                best.parts.append((item, table[hit, item], keys[a:b][hit], seen + a + hit))
                best.held += len(hit)
                if best.held > best.most:
                    best.cut()
            seen += batch.num_rows
            if len(id_parts) > 64:
                id_parts = [pa.concat_arrays(id_parts)]
        kept = best.cut()
        if kept is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(lookup.items[kept[0]]), pa.array(kept[1]), _key_column(kept[2]), pa.concat_arrays(id_parts).take(pa.array(kept[3]))], names=schema.names)

    found = rows.mapInArrow(scan, schema).groupBy("item", "bound", "text_key").agg(F.min("found_id").alias("found_id"))
    return materialize(top_k(found, ["item"], [F.col("bound").desc(), F.col("text_key")], k), "by-bound")


def _key_column(keys):
    raw = keys.astype(">u8").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(raw)]).cast(pa.binary())


def rescored(docs, chosen, lookup, k, id_column, text):
    """Exact scores of the chosen texts for the queries of the block: ``item, text_key, score``; at least the ``k`` best of each query, ties whole."""
    rows = docs.select(F.col(f"`{id_column}`").alias("found_id"), F.col(f"`{text}`").alias("found_text"))
    rows = rows.withColumn("text_key", F.unhex(F.md5(F.coalesce("found_text", F.lit("")))))
    wanted = broadcast_if_small(materialize(chosen.select("text_key", F.col("found_id").alias("one_id")).distinct(), "chosen-texts"))
    texts = rows.join(wanted, (rows["text_key"] == wanted["text_key"]) & rows["found_id"].eqNullSafe(wanted["one_id"]), "left_semi")

    def score(batches):
        best = Best(len(lookup.items), k, ties=True)
        for batch in batches:
            keys = _keys(batch.column(1))
            for first, data, offsets in text_slices(batch.column(0)):
                counts, row, terms, times = term_counts(data, offsets)
                slot = lookup.slots_of(terms)
                own = slot >= 0
                row, slot, times = row[own], slot[own], times[own].astype(np.int64)
                norms = length_norms(counts.astype(np.int64), lookup.documents, lookup.words)
                cuts = np.searchsorted(row, np.arange(len(counts) + 1))
                for a in range(0, len(counts), lookup.rows_at_once()):
                    b = min(len(counts), a + lookup.rows_at_once())
                    part = slice(cuts[a], cuts[b])
                    table = lookup.table(b - a, row[part] - a, slot[part], impact(times[part], norms[row[part]]))
                    hit, item = best.wanted(table)
                    best.add(table, keys[first + a : first + b], hit, item)
                    if best.held > best.most:
                        best.cut()
        kept = best.cut()
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(lookup.items[kept[0]]), _key_column(kept[2]), pa.array(kept[1].astype(np.int64))], names=["item", "text_key", "score"])

    with scoped_batches(docs.sparkSession):
        return materialize(texts.select("found_text", "text_key").mapInArrow(score, "item long, text_key binary, score long"), "exact-scores")


def best_documents(docs, queries, k=TOP_K, id_column="doc_id", text="text", item_id="item_id", item_text="text", query_block=QUERY_BLOCK, rounds=(FIRST_ROUND, LATER_ROUNDS)):
    """The ``k`` documents of highest score above 0 of every query: the query's id, ``rank``, the document's id, ``score``.

    Exact for any number of documents and queries; equal scores by rising id of
    the document.
    """
    asked = query_terms(queries, item_id, item_text)
    number = asked.count()
    written, results = None, None
    for block in range(0, max(number, 1), query_block):
        own = asked.where((F.col("item") >= block) & (F.col("item") < block + query_block))
        collected = own.where(F.size("terms") > 0).select("item", "terms").orderBy("item").collect()  # at most query_block queries
        lookup = Lookup([r["item"] for r in collected], [r["terms"] for r in collected])
        pass_over = sketches(docs, lookup, id_column, text, sketched=written is None)
        written = pass_over if written is None else written
        scores = _block_scores(docs, written, pass_over, lookup, k, id_column, text, rounds)
        results = scores if results is None else results.unionByName(scores)
    keys = materialize(results.select("text_key").distinct(), "found-texts")
    all_ids = written.where("slot IS NULL").select("text_key", "found_id")
    order = F.col("found_id").asc_nulls_last()
    holders = materialize(top_k(all_ids.join(broadcast_if_small(keys), "text_key", "left_semi"), ["text_key"], [order], k).drop("rank"), "holders")
    names = materialize(asked.select("item", "asked_id"), "asked-ids")
    ranked = top_k(results.join(holders, "text_key"), ["item"], [F.col("score").desc(), order], k)
    return ranked.join(names, "item").select(F.col("asked_id").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("found_id").alias(id_column), "score")


def _block_scores(docs, written, pass_over, lookup, k, id_column, text, rounds):
    sums = written.where("slot IS NULL").agg(F.count_if(F.col("terms") > 0), F.sum("terms")).first()
    held = {r[0]: r[1] for r in pass_over.where("slot IS NOT NULL").groupBy("slot").agg(F.sum("held")).collect()}  # a row per term of the block
    lookup.weigh(sums[0] or 0, sums[1] or 0, held)
    items = len(lookup.items)
    number_of = {int(item): i for i, item in enumerate(lookup.items)}
    cursor = np.full(items, np.inf), np.zeros((items, 2), dtype=np.uint64)
    floor = np.ones(items)
    many = rounds[0]
    scores = None
    while True:
        chosen = by_bound(written, lookup, cursor, floor, many)
        last = chosen.where(F.col("rank") == many).select("item", "bound", "text_key").collect()  # at most one row per query
        new = rescored(docs, chosen, lookup, k, id_column, text)
        scores = new if scores is None else materialize(scores.unionByName(new).distinct(), "exact-scores")
        for row in top_k(scores.distinct(), ["item"], [F.col("score").desc(), F.col("text_key")], k).where(F.col("rank") == k).select("item", "score").collect():
            floor[number_of[row["item"]]] = row["score"]
        floor_now = scores.sparkSession.createDataFrame([(int(i), float(f)) for i, f in zip(lookup.items, floor)], "item long, floor double")
        if not last:
            return scores.distinct().join(broadcast_if_small(floor_now), "item").where("score >= floor").drop("floor")
        done = np.ones(items, dtype=bool)
        for row in last:
            i = number_of[row["item"]]
            done[i] = row["bound"] < floor[i]
            cursor[0][i], cursor[1][i] = row["bound"], np.frombuffer(bytes(row["text_key"]), dtype=">u8")
        floor = np.where(done, np.maximum(floor, 1), floor)
        cursor[0][done] = -1.0
        many = rounds[1]
