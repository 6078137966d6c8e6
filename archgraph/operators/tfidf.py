"""TF-IDF index and exact cosine search, one corpus per repository.

Neighbouring documents lie in one row of the index, whole, with their terms and
counts, lengths and idf; weights are made where a row is read. Questions of not too many terms are sent to the rows, so that no weight
is shuffled. For more, the index marks the greatest weight of every term in
blocks of documents: a question's weights times these bound the score of every
document of a block. The blocks of highest bounds are scored first; the k-th
score found there is a threshold, and blocks that cannot reach it are never
scored. (Block maxima: Ding, Suel, "Faster top-k document retrieval using block-max indexes",
SIGIR 2011.)
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archgraph.functions.stopwords import ENGLISH
from archgraph.functions.text import strip
from archgraph.operators.groups import ragged
from archgraph.operators.topk import top_k
from archgraph.schemas import SEARCHABLE_TYPES
from archgraph.session import materialize, settings

# Fixed value: default hits.
TOP_K = 8

TOKEN = r"([\p{L}\p{N}_]{2,})"

# Sums are taken in whole multiples of these, so they do not depend on the order of their terms:
# equal texts have equal scores, and ties fall to the document order.
SCORE_UNITS = 10**15
SQUARES = "decimal(28,9)"
SQUARE_UNITS = 10**9
# Cosines of a matrix product agree to this, wherever in a block a vector stands.
DENSE_UNITS = 1e12
QUERIES_SENT = 2_000
# A block has at most 2 ** BLOCK_BITS documents, neighbours in the order of their ids.
BLOCK_BITS = 5


# A row of the index holds the documents of about so many words, whole.
ROW_WORDS = 1 << 16
# Whole texts that a task holds at once.
BATCH_BYTES = 4 << 20
# Question terms that are sent to every task; more meet the index in joins.
ASKED_SENT = 100_000
# Terms of most rows whose idf is sent to every task; that of the others meets the rows in a join.
TERMS_SENT = 100_000
# Products that a task holds at once.
PRODUCTS = 1 << 21


class TfidfIndex(NamedTuple):
    vocabulary: DataFrame  # repo_id, term, df, total, idf
    weights: DataFrame  # repo_id, block, doc_id, term, weight (unit length per document)
    blocks: DataFrame  # repo_id, block, term, top_weight
    docs: DataFrame  # repo_id, doc_id
    rows: DataFrame  # as written: neighbouring documents in one row, with their terms, counts, lengths and idf


def search_documents(symbols: DataFrame) -> DataFrame:
    """One text per file, class, function and method row; empty texts are dropped.

    doc_id orders the documents of a repository as they were emitted.
    """
    text = F.concat_ws(
        "\n", "qualified_name",
        F.coalesce(F.array_join("decorators", " "), F.lit("")), F.coalesce("docstring", F.lit("")))
    return (
        symbols.filter(F.col("symbol_type").isin(*SEARCHABLE_TYPES))
        .select(
            "repo_id", F.format_string("%s#%08d", "file_path", "seq").alias("doc_id"),
            F.col("uid").alias("symbol_uid"), strip(text).alias("text"), "symbol_type", "name",
            "qualified_name", "file_path", "start_line", "end_line",
        )
        .filter(F.col("text") != "")
    )


def term_counts(texts: DataFrame, keys, text="text") -> DataFrame:
    """Occurrences of every term that is no stop word; whole texts are tokenised."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(1))
    return (
        texts.select(*keys, F.explode(tokens).alias("term"))
        .filter(~F.col("term").isin(*ENGLISH))
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("tf"))
    )


def _length(raw):
    """Euclidean length of the values of a window, whatever their order."""
    return lambda window: F.sqrt(F.sum((raw * raw).cast(SQUARES)).over(window).cast("double"))


def fit_tfidf(docs: DataFrame, max_terms: int | None = None) -> TfidfIndex:
    """Build the index over docs (repo_id, doc_id, text)."""
    tokens = F.regexp_extract_all(F.lower(F.col("text")), F.lit(TOKEN), F.lit(1))
    texts = _ordered(docs.select("repo_id", "doc_id", "text")).select("repo_id", "doc_id", "place", tokens.alias("terms"), F.lit(1).cast("long").alias("tf"))
    return _index_of_rows(_counted_rows(texts), docs.select("repo_id", "doc_id"), max_terms)


def term_vocabulary(per_term: DataFrame, docs: DataFrame, max_terms: int | None = None) -> DataFrame:
    """Terms of every repository with their idf = ln((1 + n) / (1 + df)) + 1, from parts (repo_id, term, df, total).

    All terms; with ``max_terms`` those of most occurrences, ties by term. ``parts`` tells how many there were of a term.
    """
    sizes = docs.groupBy("repo_id").agg(F.count("*").alias("n"))
    best = per_term.groupBy("repo_id", "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.count("*").alias("parts"))
    if max_terms is not None:
        best = top_k(best, ["repo_id"], [F.col("total").desc(), F.col("term")], max_terms).drop("rank")
    return best.join(sizes, "repo_id").select(
        "repo_id", "term", "df", "total", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "parts")


def index_of_counts(counts: DataFrame, docs: DataFrame, max_terms: int | None = None) -> TfidfIndex:
    """The index from counts (repo_id, doc_id, term, tf) and all documents (repo_id, doc_id); no text is read."""
    ordered = _ordered(counts.select("repo_id", "doc_id", "term", "tf"))
    return _index_of_rows(_counted_rows(ordered.select("repo_id", "doc_id", "place", F.array("term").alias("terms"), F.col("tf").cast("long"))), docs, max_terms)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows of a document together, neighbours in the order of ids in one task; no task orders a whole repository."""
    ordered = rows.repartitionByRange("repo_id", "doc_id").sortWithinPartitions("repo_id", "doc_id")
    return ordered.withColumn("place", F.monotonically_increasing_id())  # rises along the range partitions


def _index_of_rows(counted: DataFrame, docs: DataFrame, max_terms: int | None) -> TfidfIndex:
    """Terms of a row meet the vocabulary once for all its documents, by their place in the row; the commonest are
    looked up where the row is, and whole postings are shuffled once, packed in their rows."""
    with _small_batches(counted):
        counted = materialize(counted, "tfidf-counts")
        per_term = counted.select("repo_id", "word_sizes", "words", "dfs", "totals").mapInArrow(_listed, "repo_id string, term string, df long, total long")
        vocabulary = materialize(term_vocabulary(per_term, docs, max_terms), "tfidf-vocabulary")
        sent, rest = _sent_terms(vocabulary)
        others = counted.select("repo_id", "part", "word_sizes", "words").mapInArrow(_unsent(sent), "repo_id string, part long, place int, term string")
        idf = others.join(rest, ["repo_id", "term"]).select("repo_id", "part", "place", "idf")
        key, types = ["repo_id", "part"], dict(counted.dtypes)
        schema = f"repo_id string, part long, docs {types['docs']}, idfs array<double>, lengths array<double>, {_PACKED}"
        rows = materialize(
            counted.drop("dfs", "totals").groupBy(*key).cogroup(idf.groupBy(*key)).applyInArrow(_measured(sent), schema), "tfidf-rows")
    doc_type = types["docs"][len("array<"):-1]
    weights = rows.mapInArrow(_unfold(["block", "doc_id", "term", "weight"], False), f"repo_id string, block long, doc_id {doc_type}, term string, weight double")
    blocks = rows.mapInArrow(_unfold(["block", "term", "top_weight"], True), "repo_id string, block long, term string, top_weight double")
    return TfidfIndex(vocabulary.drop("parts"), weights, blocks, docs, rows)


def _small_batches(rows: DataFrame):
    """Rows of the index go to Python a few at a time, whatever the session's batches are."""
    return settings(rows.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES})


def _sent_terms(vocabulary: DataFrame):
    """idf of the terms of most rows, by repository and term, at most TERMS_SENT; and a table of the others."""
    level = F.floor(F.log2("parts") * 8)
    numbers = vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()  # a few hundred levels at most
    least, free = None, TERMS_SENT
    for row in sorted(numbers, key=lambda r: -r.level):
        free -= row.n
        if free < 0:
            break
        least = row.level
    rest = vocabulary if least is None else vocabulary.filter(level < least)
    sent = {}
    if least is not None:
        common = vocabulary.filter(level >= least).select("repo_id", "term", "idf").toArrow()  # counted before
        for repo, term, idf in zip(*(column.to_pylist() for column in common.columns)):
            sent.setdefault(repo, {})[term] = idf
    return sent, rest.select("repo_id", "term", "idf")


def _listed(batches):
    """Terms of rows with their counts there."""
    for batch in batches:
        for row in _rows_of(batch):
            terms = _terms(row)
            yield pa.RecordBatch.from_arrays([_same(row["repo_id"], len(terms)), terms, pa.array(_wide(row["dfs"])), pa.array(_wide(row["totals"]))],
                                             names=["repo_id", "term", "df", "total"])


def _unsent(sent):
    """Terms of rows whose idf was not sent, with their place in the row."""
    def scan(batches):
        for batch in batches:
            for row in _rows_of(batch):
                terms, known = _terms(row), sent.get(row["repo_id"].as_py(), {})
                at = np.flatnonzero([term not in known for term in terms.to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [_same(row["repo_id"], len(at)), _same(row["part"], len(at)), pa.array(at.astype(np.int32)), terms.take(pa.array(at))],
                    names=["repo_id", "part", "place", "term"])

    return scan


def _same(value, times: int):
    return pa.array([value.as_py()], value.type).take(pa.array(np.zeros(times, dtype=np.int32)))


_PACKED = "word_sizes binary, words binary, doc_terms binary, steps binary, tfs binary"


def _counted_rows(texts: DataFrame) -> DataFrame:
    """Documents (repo_id, doc_id, place, terms, tf), in order and of one or several rows each, packed with their counts.

    ``part`` numbers the rows of a repository and is the first block of the
    row. The others are compressed lists: the terms as ``words``, end to end, and
    their ``word_sizes``; ``dfs`` and ``totals`` of the terms; ``doc_terms``, how many
    each document has; ``steps`` and ``tfs`` of the postings, in the order of the
    documents. A step leads from the document's last term to the next one.
    """
    schema = f"repo_id string, part long, docs array<{dict(texts.dtypes)['doc_id']}>, dfs binary, totals binary, {_PACKED}"
    return texts.mapInArrow(_pack, schema)


def _pack(batches):
    held, words, block = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if block is None:
            block = batch.column("place")[0].as_py() >> BLOCK_BITS
        held.append(batch)
        words += pc.sum(pc.list_value_length(batch.column("terms"))).as_py() or 0
        if words < ROW_WORDS:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(_document_begins(table)[0][-1])  # it may go on in the next batch
        for row in _packed_rows(table.slice(0, last), block):
            block = row.column("part")[0].as_py() + _blocks(len(row.column("docs")[0]))
            yield row
        rest = table.slice(last).combine_chunks()
        held, words = rest.to_batches(), 0
    if held:
        yield from _packed_rows(pa.Table.from_batches(held).combine_chunks(), block)


def _document_begins(table):
    """First rows of documents, and whether a repository begins there."""
    def codes(column):
        return table.column(column).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def change(values):
        return np.append(True, values[1:] != values[:-1])

    new_repository = change(codes("repo_id"))
    begins = np.flatnonzero(new_repository | change(codes("doc_id")))
    return begins, new_repository[begins]


def _packed_rows(table, block: int):
    if not table.num_rows:
        return
    begins, new_repository = _document_begins(table)
    lengths = pc.fill_null(pc.list_value_length(table.column("terms")), 0).to_numpy()
    words = np.add.reduceat(lengths, begins)
    share = np.cumsum(words, dtype=np.int64) // ROW_WORDS
    cuts = np.flatnonzero(new_repository | np.append(True, share[1:] != share[:-1]))
    for first, after in zip(cuts, np.append(cuts[1:], len(begins))):
        stop = begins[after] if after < len(begins) else table.num_rows
        own = table.slice(begins[first], stop - begins[first]).combine_chunks()
        row = _packed_row(own, begins[first:after] - begins[first], lengths[begins[first]:stop], block)
        if row is not None:
            block += _blocks(int(after - first))
            yield row


def _blocks(number: int) -> int:
    return -(-number >> BLOCK_BITS)


def _packed_row(own, begins, lengths, block: int):
    number = len(begins)
    of_row = np.repeat(np.arange(number), np.diff(np.append(begins, own.num_rows)))
    words = pa.concat_arrays([c.flatten() for c in own.column("terms").chunks]).dictionary_encode()
    if not len(words):
        return None
    code = words.indices.to_numpy().astype(np.int64)
    known = len(words.dictionary)
    kept = ~pc.is_in(words.dictionary, value_set=pa.array(ENGLISH)).to_numpy(zero_copy_only=False)[code]
    if not kept.any():
        return None
    postings, at = np.unique((np.repeat(of_row, lengths) * known + code)[kept], return_inverse=True)
    tfs = np.bincount(at, weights=np.repeat(own.column("tf").to_numpy(), lengths)[kept])
    used, term_no = np.unique(postings % known, return_inverse=True)
    terms = words.dictionary.take(pa.array(used))
    lists = {
        "docs": own.column("doc_id").combine_chunks().take(pa.array(begins)), "dfs": _narrow(np.bincount(term_no)), "totals": _narrow(np.bincount(term_no, weights=tfs).astype(np.int64)),
        "word_sizes": _narrow(pc.binary_length(terms).to_numpy()), "words": _narrow(np.frombuffer("".join(terms.to_pylist()).encode(), dtype=np.uint8)),
        **_packed_postings(postings // known, term_no, tfs.astype(np.int64), number),
    }
    return _row(own.column("repo_id")[0].as_py(), block, lists)


def _packed_postings(doc_no, term_no, tfs, number: int) -> dict:
    """Postings in the order of documents and terms."""
    steps = np.diff(term_no, prepend=0)
    first = np.flatnonzero(np.diff(doc_no, prepend=-1))
    steps[first] = term_no[first]
    return {"doc_terms": _narrow(np.bincount(doc_no, minlength=number)), "steps": _narrow(steps), "tfs": _narrow(tfs)}


def _narrow(numbers) -> bytes:
    """Whole numbers from 0 on, in the narrowest type that holds them all, compressed."""
    width = np.min_scalar_type(int(numbers.max()) if len(numbers) else 0).itemsize
    raw = numbers.astype(f"<u{width}").tobytes()
    return bytes([width]) + len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _wide(held):
    width, raw = _opened(held)
    return np.frombuffer(raw, dtype=f"<u{width}").astype(np.int64)


def _opened(held):
    data = held.as_buffer()
    size = int.from_bytes(data.slice(1, 8).to_pybytes(), "little")
    return data[0], pa.decompress(data.slice(9), size, codec="zstd") if size else b""


def _row(repo, part: int, lists: dict):
    """One row with a list or the bytes of one per column."""
    columns = [pa.array([repo], pa.string()), pa.array([part], pa.int64())]
    for values in lists.values():
        if isinstance(values, bytes):
            columns.append(pa.array([values], pa.binary()))
            continue
        values = values if isinstance(values, pa.Array) else pa.array(values)
        columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
    return pa.RecordBatch.from_arrays(columns, names=["repo_id", "part", *lists])


def _terms(row):
    sizes = _wide(row["word_sizes"])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(_opened(row["words"])[1]))


def _counts(row):
    """The documents and terms of a row, and document, term and count of its postings; terms and ids stay Arrow arrays."""
    docs, doc_terms, steps = row["docs"].values, _wide(row["doc_terms"]), _wide(row["steps"])
    reached = np.cumsum(steps)
    first = np.cumsum(doc_terms)[doc_terms > 0] - doc_terms[doc_terms > 0]
    return {"docs": docs, "terms": _terms(row), "doc_no": np.repeat(np.arange(len(docs)), doc_terms),
            "term_no": reached - np.repeat((reached - steps)[first], doc_terms[doc_terms > 0]), "tfs": _wide(row["tfs"])}


def _postings(row):
    """The same of a row of the index, with the blocks of the documents and the weights of the postings."""
    own = _counts(row)
    idfs, lengths = (row[name].values.to_numpy(zero_copy_only=False) for name in ("idfs", "lengths"))
    own["blocks"] = row["part"].as_py() + (np.arange(len(own["docs"])) >> BLOCK_BITS)
    own["weights"] = own["tfs"] * idfs[own["term_no"]] / lengths[own["doc_no"]]
    return own


def _greatest(own):
    """Postings of the greatest weight of every term in every block."""
    block, term_no = own["blocks"][own["doc_no"]], own["term_no"]
    order = np.lexsort((-own["weights"], term_no, block))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (block[order][1:] != block[order][:-1]) | (term_no[order][1:] != term_no[order][:-1])
    return np.sort(order[first])


def _rows_of(table):
    for i in range(table.num_rows):
        yield {name: table.column(name)[i] for name in table.schema.names}


def _measured(sent):
    """Rows with the idf of their terms and the lengths of their documents; terms outside the vocabulary and documents
    without an id are left out."""
    def measured(counted, idf):
        done = []
        places, values = idf.column("place").to_numpy().astype(np.int64), idf.column("idf").to_numpy()
        for row in _rows_of(counted):
            own = _counts(row)
            common = sent.get(row["repo_id"].as_py(), {})
            known = np.array([common.get(term, np.nan) for term in own["terms"].to_pylist()], dtype=np.float64)
            known[places] = values
            raw = own["tfs"] * known[own["term_no"]]
            kept = ~np.isnan(raw) & own["docs"].is_valid().to_numpy(zero_copy_only=False)[own["doc_no"]]
            raw, doc_no = raw[kept], own["doc_no"][kept]
            number = len(own["docs"])
            lists = {"docs": own["docs"], "idfs": known, "lengths": _lengths(raw, doc_no, number), "word_sizes": row["word_sizes"].as_py(), "words": row["words"].as_py(),
                     **_packed_postings(doc_no, own["term_no"][kept], own["tfs"][kept], number)}
            done.append(_row(row["repo_id"].as_py(), row["part"].as_py(), lists))
        if done:
            return pa.Table.from_batches(done)
        schema = pa.schema([("repo_id", pa.string()), ("part", pa.int64()), ("docs", counted.schema.field("docs").type), *((name, pa.list_(pa.float64())) for name in ("idfs", "lengths")),
                            *((field.split()[0], pa.binary()) for field in _PACKED.split(", "))])
        return schema.empty_table()

    return measured


def _lengths(raw, doc_no, number):
    """Euclidean lengths; squares are summed in whole multiples of 1e-9, so in any order."""
    squares = raw * raw
    whole = np.floor(squares)
    units = np.rint((squares - whole) * SQUARE_UNITS)
    sums = np.bincount(doc_no, weights=whole, minlength=number), np.bincount(doc_no, weights=units, minlength=number)
    return np.sqrt([(int(w) * SQUARE_UNITS + int(u)) / SQUARE_UNITS for w, u in zip(*sums)])


def _unfold(columns, only_top: bool):
    """One row per posting of the written rows, or per greatest weight of a term in a block."""
    def unfold(batches):
        for batch in batches:
            for row in _rows_of(batch):
                own = _postings(row)
                at = _greatest(own) if only_top else np.arange(len(own["weights"]))
                doc_no, term_no = own["doc_no"][at], own["term_no"][at]
                if not len(at):
                    continue
                values = {"block": pa.array(own["blocks"][doc_no]), "term": own["terms"].take(pa.array(term_no))}
                if "doc_id" in columns:
                    values["doc_id"] = own["docs"].take(pa.array(doc_no))
                values["weight"] = values["top_weight"] = pa.array(own["weights"][at])
                repo = pa.array(np.zeros(len(at), dtype=np.int32))
                arrays = [pa.array([row["repo_id"].as_py()], pa.string()).take(repo), *(values[c] for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["repo_id", *columns])

    return unfold


def question_weights(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unit-length term weights of questions (query_id, repo_id, question)."""
    counts = term_counts(questions, ["query_id", "repo_id"], "question")
    raw = counts.join(vocabulary, ["repo_id", "term"]).select(
        "query_id", "repo_id", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    whole = Window.partitionBy("query_id", "repo_id")
    return raw.withColumn("query_weight", F.col("raw") / _length(F.col("raw"))(whole)).drop("raw")


def _products(weight: str):
    """Sum of the products with the question's weights; a greater weight never gives a smaller sum."""
    return F.sum(F.floor(F.col(weight) * F.col("query_weight") * float(SCORE_UNITS))) / float(SCORE_UNITS)


def block_bounds(asked: DataFrame, index: TfidfIndex) -> DataFrame:
    """The most that a document of each block can score: query_id, repo_id, block, bound; blocks without a term are absent."""
    return index.blocks.join(asked, ["repo_id", "term"]).groupBy("query_id", "repo_id", "block").agg(_products("top_weight").alias("bound"))


def scored_blocks(asked: DataFrame, index: TfidfIndex, chosen: DataFrame) -> DataFrame:
    """Exact scores of the documents of the chosen (query_id, repo_id, block): query_id, repo_id, doc_id, score.

    Postings of terms that nobody asks for, and of blocks that nobody chose, are dropped before the join.
    """
    terms = chosen.select("query_id", "repo_id", "block").join(asked, ["query_id", "repo_id"])
    near = (
        index.weights.join(asked.select("repo_id", "term").distinct(), ["repo_id", "term"], "left_semi")
        .join(chosen.select("repo_id", "block").distinct(), ["repo_id", "block"], "left_semi")
    )
    return near.join(terms, ["repo_id", "block", "term"]).groupBy("query_id", "repo_id", "doc_id").agg(_products("weight").alias("score"))


def best_scores(asked: DataFrame, index: TfidfIndex, k: int, asked_sent: int | None = None) -> DataFrame:
    """Exact scores of all documents that can be among the k best of a question, and of few others.

    ``asked`` is a written table. Up to ``asked_sent`` question terms are
    counted, sent to every task, and multiplied with the weights where those
    are; no weight is shuffled, and a task keeps what can be among its own k
    best. More question terms go by blocks. Both ways give the same hits.
    """
    most = ASKED_SENT if asked_sent is None else asked_sent
    with _small_batches(index.rows):
        if asked.limit(most + 1).count() <= most:
            return materialize(_best_of_rows(asked, index, k), "row-scores")
        return _best_of_blocks(asked, index, k)


def _best_of_rows(asked: DataFrame, index: TfidfIndex, k: int) -> DataFrame:
    """Scores of whole documents, in a map over the rows of the index."""
    named = asked.filter(F.col("query_id").isNotNull())  # as in the joins
    terms = named.select("query_id", "repo_id", "term", "query_weight").toArrow().combine_chunks()  # counted before
    ids = terms.column("query_id").combine_chunks().dictionary_encode()
    frame = pd.DataFrame({"repo_id": terms.column("repo_id").to_pandas(), "term": terms.column("term").to_pandas(),
                          "query": ids.indices.to_numpy(), "weight": terms.column("query_weight").to_numpy()})
    sent = {}
    for repo, own in frame.groupby("repo_id"):
        own = own.sort_values("term", kind="stable")
        words, starts, counts = np.unique(own["term"].to_numpy(dtype=object), return_index=True, return_counts=True)
        queries, number = np.unique(own["query"].to_numpy(), return_inverse=True)
        sent[repo] = pa.array(words, pa.string()), starts, counts, number, own["weight"].to_numpy(), ids.dictionary.take(pa.array(queries))
    types = dict(asked.dtypes)["query_id"], dict(index.docs.dtypes)["doc_id"]

    def scan(batches):
        kth = {repo: np.zeros(len(own[-1])) for repo, own in sent.items()}  # no document of fewer is a hit any more
        for batch in batches:
            for row in _rows_of(batch):
                repo = row["repo_id"].as_py()
                if repo not in sent:
                    continue
                own = _postings(row)
                doc, query, score = _row_scores(own, sent[repo])
                if not len(doc):
                    continue
                hits = score >= kth[repo][query]
                doc, query, score = doc[hits], query[hits], score[hits]
                order = np.lexsort((doc, -score, query))
                doc, query, score = doc[order], query[order], score[order]
                begins = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, dtype=np.int64)
                sizes = np.diff(np.append(begins, len(query)))
                place = np.arange(len(query)) - np.repeat(begins, sizes)
                full = begins[sizes >= k] + k - 1
                kth[repo][query[full]] = score[full]
                best = place < k
                asking = sent[repo][-1].take(pa.array(query[best]))
                repos = pa.array([repo], pa.string()).take(pa.array(np.zeros(len(asking), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [asking, repos, own["docs"].take(pa.array(doc[best])), pa.array(score[best] / float(SCORE_UNITS))],
                    names=["query_id", "repo_id", "doc_id", "score"])

    return index.rows.mapInArrow(scan, f"query_id {types[0]}, repo_id string, doc_id {types[1]}, score double")


def _row_scores(own, sent):
    """Document, question and summed products, for all pairs with a common term."""
    words, starts, counts, number, query_weights, queries = sent
    found = pc.fill_null(pc.index_in(own["terms"], value_set=words), -1).to_numpy(zero_copy_only=False)
    term = found[own["term_no"]]
    at = np.flatnonzero(term >= 0)
    at = at[np.argsort(own["doc_no"][at], kind="stable")]
    pairs, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    # Documents are taken as long as their products fit.
    doc_no, times = own["doc_no"][at], counts[term[at]]
    share = np.cumsum(times) // PRODUCTS
    begins = np.flatnonzero(np.append(True, doc_no[1:] != doc_no[:-1])) if len(at) else at
    cuts = begins[np.append(True, share[begins][1:] != share[begins][:-1])] if len(at) else at
    for first, after in zip(cuts, np.append(cuts[1:], len(at))):
        some = at[first:after]
        many = times[first:after]
        asking = ragged(starts[term[some]], many)
        products = np.floor(np.repeat(own["weights"][some], many) * query_weights[asking] * float(SCORE_UNITS))
        pair, place = np.unique(np.repeat(doc_no[first:after].astype(np.int64), many) * len(queries) + number[asking], return_inverse=True)
        pairs.append(pair)
        sums.append(np.bincount(place, weights=products))  # whole numbers below 2 ** 53
    pair = np.concatenate(pairs)
    return pair // len(queries), pair % len(queries), np.concatenate(sums)


def _best_of_blocks(asked: DataFrame, index: TfidfIndex, k: int) -> DataFrame:
    """The same by joins.

    The k blocks of highest bounds hold at least k documents with a common
    term, if there are so many; the k-th best of them is the threshold. Of the
    other blocks only those with a bound at or above it are scored.
    """
    key = ["query_id", "repo_id"]
    bounds = materialize(block_bounds(asked, index), "block-bounds")
    ranked = top_k(bounds, key, [F.col("bound").desc(), F.col("block")], k)
    first = materialize(ranked, "first-blocks")
    scores = materialize(scored_blocks(asked, index, first), "first-scores")
    kth = top_k(scores, key, [F.col("score").desc(), F.col("doc_id")], k).filter(F.col("rank") == k)
    threshold = materialize(kth.select(*key, F.col("score").alias("threshold")), "thresholds")
    left = (
        bounds.join(threshold, key, "left").filter(F.col("bound") >= F.coalesce("threshold", F.lit(0.0)))
        .join(first, [*key, "block"], "left_anti")
    )
    left = materialize(left.select(*key, "block"), "later-blocks")
    return scores if left.isEmpty() else scores.unionByName(materialize(scored_blocks(asked, index, left), "later-scores"))


def search(questions: DataFrame, index: TfidfIndex, k: int = TOP_K, pad: bool = False) -> DataFrame:
    """Exact top k by cosine: query_id, repo_id, doc_id, score, rank.

    Only documents of blocks that can hold a hit are scored; their terms meet
    those of the question in an equi-join, and the products are summed with a
    map-side combine. With ``pad`` a question always gets k hits (or all
    documents): documents without a common term follow at score 0 in document
    order, of which the first k of a repository are always enough.
    """
    asked = materialize(question_weights(questions, index.vocabulary), "question-weights")
    order = [F.col("score").desc(), F.col("doc_id")]
    hits = top_k(best_scores(asked, index, k), ["query_id", "repo_id"], order, k)
    if not pad:
        return hits
    first = top_k(index.docs, ["repo_id"], [F.col("doc_id")], k).drop("rank")
    fill = (
        questions.select("query_id", "repo_id").distinct().join(first, "repo_id")
        .withColumn("score", F.lit(0.0))
    )
    both = hits.drop("rank").unionByName(fill.select("query_id", "repo_id", "doc_id", "score"))
    best = both.groupBy("query_id", "repo_id", "doc_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id", "repo_id"], order, k)


def search_dense(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, rows_per_block: int = 20_000,
                 queries_per_block: int = 500, queries_sent: int = QUERIES_SENT) -> DataFrame:
    """Exact cosine top k of queries (query_id, repo_id, embedding) among vectors (repo_id, vec_id, embedding).

    Up to ``queries_sent`` queries are counted, sent to every task, and
    multiplied with the vectors where those are; a task keeps k rows per query
    and only they are shuffled. More queries meet the vectors block by block.
    Both ways give the same rows.

    Vectors that are null or empty, or hold null or non-finite components, take
    no part, and a query meets vectors of its own number of dimensions only. A
    zero vector scores 0 with all.
    """
    asked = comparable(queries.select("query_id", "repo_id", "embedding"))
    stored = comparable(vectors.select("repo_id", "vec_id", "embedding"))
    if asked.limit(queries_sent + 1).count() <= queries_sent:
        found = _best_in_place(asked, stored, k)
    else:
        found = _best_by_blocks(asked, stored, k, rows_per_block, queries_per_block)
    return top_k(found, ["query_id", "repo_id"], [F.col("score").desc(), F.col("vec_id")], k)


def comparable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding has numbers only, with its ``dims``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("embedding").isNotNull() & finite & (F.size("embedding") > 0)).withColumn("dims", F.size("embedding"))


def _best_in_place(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """At most k rows per query and task, in a map over the vectors."""
    rows = asked.toPandas()  # counted before
    matrices = {repo: (own["query_id"].to_numpy(), unit_rows(own["embedding"])) for repo, own in rows.groupby(["repo_id", "dims"])}
    types = dict(vectors.dtypes)["vec_id"], dict(asked.dtypes)["query_id"]
    columns = ["query_id", "repo_id", "vec_id", "score"]

    def scan(batches):
        best = []
        for batch in batches:
            for part, own in batch.groupby(["repo_id", "dims"]):
                if part in matrices:
                    ids, matrix = matrices[part]
                    best.append(best_of_product(ids, matrix, part[0], own.sort_values("vec_id", ignore_index=True), k))
            if len(best) > 1:
                best = [_first_of_each(pd.concat(best), k)]
        yield best[0] if best else pd.DataFrame(columns=columns)

    return vectors.mapInPandas(scan, f"query_id {types[1]}, repo_id string, vec_id {types[0]}, score double")


def _first_of_each(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["score", "vec_id"], ascending=[False, True])
    return ordered.groupby(["repo_id", "query_id"], sort=False).head(k)


def best_of_product(ids, matrix, repo, vector_rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of the vectors, which are in the order of their ids, for every query."""
    scores = np.floor(matrix @ unit_rows(vector_rows["embedding"]).T * DENSE_UNITS) / DENSE_UNITS
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({
        "query_id": np.repeat(ids, best.shape[1]), "repo_id": repo,
        "vec_id": vector_rows["vec_id"].to_numpy()[best.ravel()],
        "score": np.take_along_axis(scores, best, axis=1).ravel(),
    })


def _best_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, rows_per_block: int, queries_per_block: int) -> DataFrame:
    """At most k rows per query and block of vectors.

    Both sides are dealt into numbered blocks of bounded size and every pair of
    blocks meets in one task, which multiplies two matrices. No pair of rows is
    ever emitted, and a repository of any size is spread over as many tasks as
    it has blocks.
    """
    vector_blocks = _block_counts(vectors, rows_per_block, "vector_blocks")
    query_blocks = _block_counts(queries, queries_per_block, "query_blocks")
    alike = ["repo_id", "dims"]
    blocks = materialize(vector_blocks.join(query_blocks, alike), "dense-blocks")

    def every(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    dealt_vectors = vectors.join(blocks, alike).select(
        *alike, F.pmod(F.xxhash64("vec_id"), F.col("vector_blocks")).cast("int").alias("vector_block"),
        every("query_blocks").alias("query_block"), "vec_id", "embedding")
    dealt_queries = queries.join(blocks, alike).select(
        *alike, every("vector_blocks").alias("vector_block"),
        F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("query_block"),
        "query_id", "embedding")
    id_types = dict(vectors.dtypes)["vec_id"], dict(queries.dtypes)["query_id"]

    def best_of_block(query_rows: pd.DataFrame, vector_rows: pd.DataFrame) -> pd.DataFrame:
        if query_rows.empty or vector_rows.empty:
            return pd.DataFrame(columns=["query_id", "repo_id", "vec_id", "score"])
        ids, repo = query_rows["query_id"].to_numpy(), query_rows["repo_id"].iloc[0]
        return best_of_product(ids, unit_rows(query_rows["embedding"]), repo, vector_rows.sort_values("vec_id", ignore_index=True), k)

    cell = [*alike, "vector_block", "query_block"]
    return dealt_queries.groupBy(*cell).cogroup(dealt_vectors.groupBy(*cell)).applyInPandas(
        best_of_block, f"query_id {id_types[1]}, repo_id string, vec_id {id_types[0]}, score double")


def _block_counts(rows: DataFrame, size: int, name: str) -> DataFrame:
    return rows.groupBy("repo_id", "dims").agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def unit_rows(embeddings: pd.Series) -> np.ndarray:
    """Rows of equal dimensions scaled to length one; a zero row stays zero."""
    matrix = np.concatenate(embeddings.to_numpy()).astype(np.float64).reshape(len(embeddings), -1)
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)
