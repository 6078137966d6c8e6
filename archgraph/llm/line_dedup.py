"""Removal of boilerplate lines that spread over many sites.

A line is compared by its text without blanks at its ends. A HyperLogLog sketch
of the sites that hold it is merged by aggregation; lines whose estimate is too
near the threshold to be sure get exact distinct counts. Lines on at least
``MIN_SITES`` sites are candidates.

A candidate is boilerplate if ``MIN_SITES`` independent documents can be named
that hold it on as many different sites. Near copies count as one document,
which can be named for any one of its sites: lines that are widespread only
because whole documents were copied stay, for near-duplicate removal to judge
with their document, and copies outvote nothing. Documents are copies if the
smallest hashes of the five-word shingles of their lines are equal, candidates
left out, so a passage that unrelated documents share does not make them
copies. A document of candidates only is known by all of its shingles.

Boilerplate lines are removed from all documents. A document's other lines stay
as they are. Blank lines are never removed. A null site is a site of its own.
Null texts stay null. Repeated rows and documents with equal ids are treated
each by its own text. ``n_lines`` and ``n_removed`` replace input columns of
these names.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.llm.near_duplicates import shingle_sets
from archgraph.llm.sized import bounded_batches, broadcast_if_small
from archgraph.llm.text import BLANK, LOWER, NOT_BLANK, byte_table, hash_spans, row_offsets, shingles, spans, text_slices
from archgraph.session import materialize

MIN_SITES = 10
INDEPENDENT = True  # near copies count as one document
SHINGLE_WORDS = 5
SKETCH_BITS = 10
SENT_LINES = 1 << 21  # boilerplate hashes that are sent to every task: at most 16 MB
UNSURE = 4 * 1.04 / 2 ** (SKETCH_BITS / 2)  # four standard errors of an estimate

_NOT_BREAK = ~byte_table((0x0A, 0x0A))


def trimmed_lines(data, offsets):
    """Start and end without blanks at the ends, and row, of every line that is not blank."""
    start, end, row = spans(data, offsets, _NOT_BREAK)
    word = np.flatnonzero(~BLANK[data])
    if not len(word):
        return start[:0], end[:0], row[:0]
    low = np.searchsorted(word, start)
    high = np.searchsorted(word, end) - 1
    some = low <= high
    return word[low[some]], word[high[some]] + 1, row[some]


def _least(hashes, counts):
    """The smallest of every row's hashes, 0 for rows without any."""
    out = np.zeros(len(counts), dtype=np.uint64)
    if (counts > 0).any():
        out[counts > 0] = np.minimum.reduceat(hashes, row_offsets(counts)[:-1][counts > 0])
    return out.view(np.int64)


def _line_least(data, offsets, start, end):
    """The smallest shingle hash of every line."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    lower = LOWER[data]
    first, last, _ = spans(lower, offsets, NOT_BLANK)
    counts = np.searchsorted(first, end) - np.searchsorted(first, start)
    return _least(*shingles(hash_spans(lower, first, last), counts, SHINGLE_WORDS))


def line_rows(docs, id_column, site, text):
    """``key``, ``text_hash``, ``site``, ``line`` (its hash), ``least`` and ``whole`` (smallest shingle hash of the line and of the document): one row per document and distinct line."""
    rows = docs.select(
        F.col(f"`{id_column}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{site}`").cast("string")), F.lit("n")).alias("site"), F.col(f"`{text}`").alias("text"),
    )
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("text_hash long, site string, line long, least long, whole long").fields])

    def cut(batches):
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                start, end, row = trimmed_lines(data, offsets)
                line = hash_spans(data, start, end).view(np.int64)
                sets, counts = shingle_sets(data, offsets, SHINGLE_WORDS)
                whole = _least(sets, counts)
                least = _line_least(data, offsets, start, end)
                order = np.lexsort((line, row))
                line, row, least = line[order], row[order], least[order]
                fresh = np.ones(len(line), dtype=bool)
                fresh[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
                line, row, least = line[fresh], row[fresh], least[fresh]
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key").take(at), batch.column("text_hash").take(at), batch.column("site").take(at), pa.array(line), pa.array(least), pa.array(whole[row]),
                ], names=schema.fieldNames())

    return rows.mapInArrow(cut, schema)


def wide_lines(lines, min_sites=MIN_SITES):
    """``line``: hashes of the lines on at least ``min_sites`` sites."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(SKETCH_BITS)).alias("sites"), F.count(F.lit(1)).alias("held"))
    measured = sketched.select("line", "held", F.hll_sketch_estimate("sites").alias("sites"))
    possible = (F.col("held") >= min_sites) & (F.col("sites") >= min_sites * (1 - UNSURE))
    sure = F.col("sites") >= min_sites * (1 + UNSURE)
    likely = materialize(measured.where(possible).select("line", sure.alias("sure")), "likely-lines")
    unsure = lines.join(likely.where("not sure").select("line"), "line")
    sites = unsure.groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    return materialize(likely.where("sure").select("line").union(sites.where(F.col("sites") >= min_sites).select("line")), "wide-lines")


def held_lines(lines, wide):
    """``line``, ``site``, ``stands_for``: by which documents the wide lines are held, near copies as one."""
    doc = F.xxhash64("key", "text_hash").alias("doc")
    marked = lines.select(doc, "site", "line", "least", "whole").join(broadcast_if_small(wide.withColumn("wide", F.lit(True))), "line", "left")
    own = marked.groupBy("doc").agg(F.min(F.when(F.col("wide").isNull(), F.col("least"))).alias("own"), F.count("wide").alias("held")).where("held > 0 and own is not null")
    own = materialize(own.select("doc", "own"), "own-lines")
    named = marked.where("wide").join(own, "doc", "left")
    return named.select("line", "site", F.coalesce("own", "whole").alias("stands_for")).distinct()


def boilerplate_lines(lines, min_sites=MIN_SITES, independent=INDEPENDENT):
    """``line``: hashes of the boilerplate lines."""
    wide = wide_lines(lines, min_sites)
    if not independent or wide.isEmpty():
        return wide
    held = materialize(held_lines(lines, wide), "held-lines")
    one_site = held.groupBy("line", "stands_for").agg(F.min_by("site", F.xxhash64("site", "stands_for")).alias("site"))
    sites = one_site.groupBy("line", "site").agg(F.lit(1)).groupBy("line").agg(F.count(F.lit(1)).alias("sites"))
    sites = materialize(sites.select("line", (F.col("sites") >= min_sites).alias("sure")), "independent-sites")
    named = named_on_sites(held.join(sites.where("not sure").select("line"), "line"), min_sites)
    return materialize(sites.where("sure").select("line").union(named), "boilerplate-lines")


def named_on_sites(held, min_sites):
    """``line`` of those for which ``min_sites`` pairs of ``held`` have no document and no site in common.

    More than ``min_sites`` pairs of one document or of one site are of no
    use to that: with those alone all others could be paired first. Of what is
    left, ``min_sites`` squared pairs always hold enough, so no list is longer.
    """
    for one, other in (("stands_for", "site"), ("site", "stands_for")):
        turn = F.row_number().over(Window.partitionBy("line", one).orderBy(F.xxhash64(other), other))
        held = held.withColumn("turn", turn).where(F.col("turn") <= min_sites).drop("turn")
    held = materialize(held, "pairs-of-lines")
    counts = materialize(held.groupBy("line").agg(F.count(F.lit(1)).alias("pairs")).where(F.col("pairs") >= min_sites), "numbers-of-pairs")
    enough = F.col("pairs") >= min_sites**2
    few = held.join(counts.where(~enough).select("line"), "line").groupBy("line").agg(F.collect_list(F.struct("stands_for", "site")).alias("pairs"))
    paired = F.udf(lambda pairs: _most_pairs(pairs) >= min_sites, "boolean")
    return counts.where(enough).select("line").union(few.where(paired("pairs")).select("line"))


def _most_pairs(pairs):
    """The most pairs without a common document or site, by augmenting paths."""
    sites = {}
    for document, site in pairs:
        sites.setdefault(document, []).append(site)
    holder = {}

    def place(document, tried):
        for site in sites[document]:
            if site not in tried:
                tried.add(site)
                if site not in holder or place(holder[site], tried):
                    holder[site] = document
                    return True
        return False

    return sum(place(document, set()) for document in sites)


def remove_boilerplate(docs, id_column="doc_id", site="source", text="text", min_sites=MIN_SITES, independent=INDEPENDENT):
    """All documents with boilerplate lines taken out of the text, ``n_lines`` (not blank, before) and ``n_removed``."""
    bounded_batches(docs.sparkSession)
    lines = materialize(line_rows(docs, id_column, site, text), "line-rows")
    found = boilerplate_lines(lines, min_sites, independent)
    kept = [name for name in docs.columns if name not in ("n_lines", "n_removed")]
    rows = docs.select(F.struct(*[F.col(f"`{name}`") for name in kept if name != text]).alias("row"), F.col(f"`{id_column}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sent = None
    if found.count() <= SENT_LINES:
        sent = np.sort(found.toArrow().column("line").to_numpy())
        rows = rows.select("row", "text")
    else:
        rows = rows.transform(_with_hits, lines, found)
    schema = T.StructType([rows.schema["row"], T.StructField("text", docs.schema[text].dataType), *T.StructType.fromDDL("n_lines long, n_removed long").fields])

    def clean(batches):
        for batch in batches:
            texts = batch.column("text")
            for first, data, offsets in text_slices(texts):
                many = len(offsets) - 1
                start, end, row = trimmed_lines(data, offsets)
                line = hash_spans(data, start, end).view(np.int64)
                if sent is not None:
                    bad = np.zeros(len(line), dtype=bool) if not len(sent) else sent[np.minimum(np.searchsorted(sent, line), len(sent) - 1)] == line
                else:
                    bad = _is_hit(line, row, batch.column("hit_lines").slice(first, many))
                replaced = {}
                for own in np.unique(row[bad]).tolist():
                    lines_of = slice(*np.searchsorted(row, [own, own + 1]))
                    own_bad = start[lines_of][bad[lines_of]] - offsets[own]
                    replaced[own] = _without(data[offsets[own] : offsets[own + 1]].tobytes(), own_bad)
                part = texts.slice(first, many)
                if replaced:
                    part = pa.array([replaced.get(i, value) for i, value in enumerate(part.to_pylist())], texts.type)
                number, removed = np.bincount(row, minlength=many), np.bincount(row[bad], minlength=many)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, many), part, pa.array(number, pa.int64()), pa.array(removed, pa.int64())], names=schema.fieldNames())

    out = rows.mapInArrow(clean, schema)
    return out.select(*[F.col("text").alias(text) if name == text else F.col("row").getField(name).alias(name) for name in kept], "n_lines", "n_removed")


def _with_hits(rows, lines, found):
    """The documents with the hashes of their own boilerplate lines, for lists of lines too long to send to every task."""
    hits = lines.select("key", "text_hash", "line").join(found, "line")
    hits = materialize(hits.groupBy("key", "text_hash").agg(F.collect_set("line").alias("hit_lines")), "line-hits")  # at most the lines of one document
    hits = hits.withColumnsRenamed({"key": "hit_key", "text_hash": "hit_hash"})
    joined = rows.join(hits, F.col("key").eqNullSafe(F.col("hit_key")) & (F.xxhash64("text") == F.col("hit_hash")), "left")
    return joined.select("row", "text", "hit_lines")


def _is_hit(line, row, hits):
    """Which lines are in the list of their own row."""
    bad = np.zeros(len(line), dtype=bool)
    for own in np.flatnonzero(np.asarray(hits.is_valid())).tolist():
        lines_of = slice(*np.searchsorted(row, [own, own + 1]))
        bad[lines_of] = np.isin(line[lines_of], np.array(hits[own].as_py()))
    return bad


def _without(raw, starts):
    """The text without the lines that the given bytes are in."""
    gone = set(np.searchsorted([i for i, byte in enumerate(raw) if byte == 0x0A], starts).tolist())
    return b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in gone).decode()
