"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

A document is the set of its word shingles, hashed to 64 bits, and a signature
of coordinates: the minimum of one random function each over the set. Documents
are posted under each (coordinate, value). Documents with similar sets agree in
at least ``matches`` coordinates (see ``needed_matches``), so with the postings
of all documents in one order, rarest first, they meet among the first
``coordinates - matches + 1`` of each: longer lists are skipped, and a
value that no other document has needs no posting. Members of a posting count
collisions of whole signatures; those with enough are candidates.

Candidates are then confirmed: the sets of a candidate group's documents are
built again from the whole texts and compared exactly. Documents with equal
sets are one class from the start and are compared once. Postings and groups of
any size are cut into blocks, and every pair of blocks is compared in a task of
its own; within a task a document is compared only until it is joined, and the
links passed on are a spanning forest.

Texts without words, and null texts, are empty sets, linked with nothing. A
null id takes part like others and is never the smallest of a group unless all
are null. Repeated rows are separate documents with equal sets.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.components import connected_components
from archgraph.llm.grouped import dealt, fixed_binary_matrix, spanning_links, whole_groups
from archgraph.llm.sized import bounded_batches, broadcast_if_small
from archgraph.llm.text import LOWER, NOT_BLANK, hash_spans, mix64, row_offsets, shingles, spans, text_slices, word_counts
from archgraph.session import materialize

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
COORDINATES = 32
MISS = 1e-6
POSTING_BLOCK = 2048
GROUP_BLOCK = 256


def needed_matches(coordinates, percent, miss=MISS):
    """The most matches that a pair at the similarity fails to reach with a chance of at most ``miss``."""
    p, below = percent / 100, 0.0
    for matches in range(coordinates + 1):
        below += math.comb(coordinates, matches) * p**matches * (1 - p) ** (coordinates - matches)
        if below > miss:
            return max(matches, 1)
    return coordinates


def _functions(coordinates):
    seeds = mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    return seeds[:coordinates] | np.uint64(1), seeds[coordinates:]


def shingle_sets(data, offsets, size):
    """Distinct shingle hashes, sorted within rows and laid end to end, and their number per row."""
    data = LOWER[data]
    start, end, row = spans(data, offsets, NOT_BLANK)
    rows = len(offsets) - 1
    hashes, number = shingles(hash_spans(data, start, end), word_counts(row, rows), size)
    owner = np.repeat(np.arange(rows), number)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=rows)


def _reduced(operation, values, counts):
    """The operation over every row's values; rows without values give 0."""
    out = np.zeros(len(counts), dtype=values.dtype)
    filled = counts > 0
    if filled.any():
        out[filled] = operation.reduceat(values, row_offsets(counts)[:-1][filled])
    return out


def set_keys(hashes, counts):
    """128 bits that tell sets apart, as two signed numbers."""
    low = _reduced(np.add, mix64(hashes), counts)
    high = _reduced(np.bitwise_xor, mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), counts) + mix64(counts.astype(np.uint64))
    return low.view(np.int64), high.view(np.int64)


def signatures(docs, id_column="doc_id", text="text", shingle_words=SHINGLE_WORDS, coordinates=COORDINATES):
    """Per document: ``key`` (its id), ``text_hash``, ``n_shingles``, ``low``, ``high`` (of its set), ``signature``."""
    rows = docs.select(F.col(f"`{id_column}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("text_hash long, n_shingles long, low long, high long, signature array<int>").fields])
    factors, terms = _functions(coordinates)

    def sign(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                hashes, counts = shingle_sets(data, offsets, shingle_words)
                low, high = set_keys(hashes, counts)
                table = np.zeros((len(counts), coordinates), dtype=np.uint32)
                for at in range(coordinates):
                    table[:, at] = _reduced(np.minimum, ((hashes * factors[at] + terms[at]) >> np.uint64(32)).astype(np.uint32), counts)
                many = len(counts)
                values = pa.array(table.view(np.int32).reshape(-1))
                ends = pa.array(np.arange(many + 1, dtype=np.int32) * coordinates)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").slice(first, many), batch.column("text_hash").slice(first, many), pa.array(counts, pa.int64()),
                    pa.array(low), pa.array(high), pa.ListArray.from_arrays(ends, values),
                ], names=schema.fieldNames())

    return rows.mapInArrow(sign, schema)


def set_classes(signed):
    """One row per distinct set: ``node``, ``low``, ``high``, the smallest id, the document that stands for it, its signature."""
    classes = signed.where("n_shingles > 0").groupBy("low", "high").agg(
        F.min("key").alias("least_key"), F.min(F.struct("key", "text_hash")).alias("stand_in"), F.first("signature").alias("signature")
    )
    return materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def block_pairs(df, size, node, block):
    """Rows once per pair of blocks that their group needs: ``block_a``, ``block_b``; a group of at most ``block`` rows has one."""
    blocks = F.ceil(F.col(size) / block)
    own = F.pmod(F.xxhash64(node), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    paired = df.withColumn("own_block", own).withColumn("other_block", other)
    return paired.select(
        *df.columns, F.least("own_block", "other_block").alias("block_a"), F.greatest("own_block", "other_block").alias("block_b")
    )


def candidate_links(classes, matches, coordinates=COORDINATES):
    """``a``, ``b``: links that join the classes agreeing in enough coordinates as all such links would."""
    postings = classes.select("node", F.posexplode("signature").alias("coordinate", "value"))
    lengths = materialize(postings.groupBy("coordinate", "value").agg(F.count(F.lit(1)).alias("posted")).where("posted > 1"), "posting-lengths")
    shared = postings.join(lengths, ["coordinate", "value"])
    by_node = Window.partitionBy("node")
    turn = F.row_number().over(by_node.orderBy("posted", "coordinate", "value"))
    first = shared.select("*", turn.alias("turn"), F.count(F.lit(1)).over(by_node).alias("held"))
    first = first.where(F.col("turn") <= F.col("held") - matches + 1).select("node", "coordinate", "value", "posted")
    first = materialize(first, "first-postings")
    signed = classes.select("node", F.col("signature").alias("signature"))
    members = block_pairs(first, "posted", "node", POSTING_BLOCK).join(signed, "node")
    keys = ["coordinate", "value", "block_a", "block_b"]

    def count_collisions(batches):
        for table, begins in whole_groups(batches, keys):
            nodes = table.column("node").to_numpy()
            signature = table.column("signature").chunk(0).flatten().to_numpy().reshape(-1, coordinates)
            sizes = np.diff(begins)
            pairs = begins[:-1][sizes == 2]
            hit = (signature[pairs] == signature[pairs + 1]).sum(axis=1) >= matches
            ones, others = [nodes[pairs[hit]]], [nodes[pairs[hit] + 1]]
            for begin, size in zip(begins[:-1][sizes > 2], sizes[sizes > 2]):
                own = signature[begin : begin + size]
                one, other = spanning_links(int(size), lambda i, rest, own=own: (own[rest] == own[i]).sum(axis=1) >= matches)
                ones.append(nodes[begin + one])
                others.append(nodes[begin + other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ones)), pa.array(np.concatenate(others))], names=["a", "b"])

    return dealt(members.select(*keys, "node", "signature"), keys).mapInArrow(count_collisions, "a long, b long")


def confirmed_links(docs, classes, groups, percent, shingle_words, id_column="doc_id", text="text"):
    """``a``, ``b``: links that join the classes similar on their full sets as all such links would.

    ``groups`` (``node``, ``component``) are the candidates to compare.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    named = groups.join(sizes, "component").join(classes.select("node", "low", "high", "stand_in"), "node")
    wanted = materialize(named.select("node", "component", "members", "low", "high", F.col("stand_in.key").alias("wanted_key"), F.col("stand_in.text_hash").alias("wanted_hash")), "wanted-sets")
    texts = docs.select(F.col(f"`{id_column}`").alias("own_key"), F.col(f"`{text}`").alias("text"))
    found = texts.join(broadcast_if_small(wanted), (F.xxhash64("text") == F.col("wanted_hash")) & F.col("own_key").eqNullSafe(F.col("wanted_key")))
    found = found.select("node", "component", "members", "low", "high", "text")

    def build(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                hashes, counts = shingle_sets(data, offsets, shingle_words)
                low, high = set_keys(hashes, counts)
                many = len(counts)
                same = (low == batch.column("low").slice(first, many).to_numpy()) & (high == batch.column("high").slice(first, many).to_numpy())
                ends = (row_offsets(counts) * 8).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(hashes.tobytes())])
                names = ["node", "component", "members"]
                out = pa.RecordBatch.from_arrays([*(batch.column(n).slice(first, many) for n in names), sets], names=[*names, "shingles"])
                yield out.filter(pa.array(same))

    sets = found.mapInArrow(build, "node long, component long, members long, shingles binary")
    keys = ["component", "block_a", "block_b"]

    def compare(batches):
        for table, begins in whole_groups(batches, keys):
            nodes = table.column("node").to_numpy()
            blobs = table.column("shingles").chunk(0)
            ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for begin, end in zip(begins[:-1].tolist(), begins[1:].tolist()):
                at = begin + np.unique(nodes[begin:end], return_index=True)[1]
                sets = [np.frombuffer(blobs[int(i)].as_buffer(), dtype=np.uint64) for i in at]
                one, other = similar_sets(sets, percent)
                ones.append(nodes[at[one]])
                others.append(nodes[at[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ones)), pa.array(np.concatenate(others))], names=["a", "b"])

    paired = block_pairs(sets, "members", "node", GROUP_BLOCK)
    return dealt(paired.select(*keys, "node", "shingles"), keys).mapInArrow(compare, "a long, b long")


def similar_sets(sets, percent):
    """Links that join the sorted sets of at least the similarity as all such links would."""
    number = len(sets)
    if number < 2:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    lengths = np.array([len(s) for s in sets])
    everything = np.concatenate(sets)
    owner = np.repeat(np.arange(number), lengths)

    def linked(one, rest):
        size = lengths[one]
        fits = 100 * np.minimum(size, lengths[rest]) >= percent * np.maximum(size, lengths[rest])
        hit = np.zeros(len(rest), dtype=bool)
        near = rest[fits]
        if not len(near):
            return hit
        if len(near) * 4 > number:
            place = np.minimum(np.searchsorted(sets[one], everything), size - 1)
            common = np.bincount(owner, weights=sets[one][place] == everything, minlength=number)[near].astype(np.int64)
        else:
            common = np.array([(sets[one][np.minimum(np.searchsorted(sets[one], sets[i]), size - 1)] == sets[i]).sum() for i in near], dtype=np.int64)
        hit[fits] = 100 * common >= percent * (size + lengths[near] - common)
        return hit

    return spanning_links(number, linked)


def judged_documents(docs, id_column="doc_id", text="text", shingle_words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT, coordinates=COORDINATES):
    """Per document: ``key`` (its id), ``text_hash``, ``n_shingles``, ``component`` (a number of its group, null for empty sets), ``component_id``."""
    bounded_batches(docs.sparkSession)
    matches = needed_matches(coordinates, percent)
    signed = materialize(signatures(docs, id_column, text, shingle_words, coordinates), "signatures")
    classes = set_classes(signed)
    groups = connected_components(candidate_links(classes, matches, coordinates))
    links = confirmed_links(docs, classes, groups, percent, shingle_words, id_column, text)
    joined = connected_components(links)
    named = classes.join(joined, "node", "left").select("low", "high", "least_key", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "named-classes")
    least = materialize(named.groupBy("component").agg(F.min("least_key").alias("component_id")), "least-ids")
    answer = materialize(named.join(least, "component").select("low", "high", "component", "component_id"), "class-components")
    out = signed.select("key", "text_hash", "n_shingles", "low", "high").join(answer, ["low", "high"], "left")
    return out.select("key", "text_hash", "n_shingles", "component", F.coalesce("component_id", "key").alias("component_id"))


def near_duplicates(docs, id_column="doc_id", **options):
    """Per document: its id, ``n_shingles``, ``component_id`` (the smallest id reachable by links), ``kept`` (its id is that one)."""
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept")
    return judged_documents(docs, id_column, **options).select(F.col("key").alias(id_column), "n_shingles", "component_id", kept)


def without_near_duplicates(docs, id_column="doc_id", text="text", **options):
    """One document of every group, the one with the smallest id, and all documents with empty sets; the columns of ``docs``.

    The few that go are taken out by an anti-join, so the texts that stay are
    not shuffled while the list of those is small.
    """
    judged = materialize(judged_documents(docs, id_column, text, **options).where("component is not null"), "judged")
    first = judged.groupBy("component").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "text_hash")).alias("first"))
    first = materialize(first, "group-keepers")
    rows = judged.groupBy("component", "key", "text_hash").agg(F.count(F.lit(1)).alias("rows")).join(first, "component")
    keeps = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))
    rows = rows.select(F.col("key").alias("judged key"), F.col("text_hash").alias("judged hash"), keeps.alias("keeps"), "rows")
    rows = materialize(rows.where(~F.col("keeps") | (F.col("rows") > 1)), "not-kept")

    def same(df):
        return df[id_column].eqNullSafe(F.col("`judged key`")) & (F.xxhash64(df[text]) == F.col("`judged hash`"))

    left = docs.join(broadcast_if_small(rows), same(docs), "left_anti")
    repeated = rows.where("keeps")
    if repeated.isEmpty():
        return left
    met = docs.join(broadcast_if_small(repeated), same(docs))
    once = met.dropDuplicates(["judged key", "judged hash"]).select(*[F.col(f"`{name}`") for name in docs.columns])
    return left.unionByName(once)
