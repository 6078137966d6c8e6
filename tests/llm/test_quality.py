import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archgraph.llm import quality as ql
from archgraph.llm.text import text_slices

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def fitted(tables):
    return ql.fit_quality(*tables)


def test_held_out_accuracy(tables, fitted):
    docs, labels = tables
    scored = ql.quality_scores(docs, fitted).join(labels.select("doc_id", "quality"), "doc_id")
    rows = scored.where(ql.remainder(F.col("doc_id")) == ql.HELD_OUT).collect()
    assert len(rows) > 50
    right = [r.predicted == r.quality for r in rows]
    assert np.mean(right) > 0.93
    assert np.mean([r.predicted == 1 for r in rows if r.quality == 1]) > 0.95
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)


def test_held_out_rows_are_never_learned_from(tables):
    usable = ql.usable_labels(tables[1])
    assert {zlib.crc32(str(r.doc_id).encode()) % 4 for r in usable.collect()} == {0, 1, 3}


def test_a_repeated_id_is_sampled_once(make, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    usable = {r.doc_id for r in ql.usable_labels(labels).collect()}
    often = min(usable)
    rows = [(i, f"text {i} " * 20, "a") for i in range(40)] + [(often, f"text {often} " * (20 + i % 3), "a") for i in range(300)]
    docs = make(rows).repartition(3)
    chunks, owner, good, _ = ql.sample_chunks(docs, labels)
    assert len(good) == len(usable) == len(set(owner.tolist()))
    assert len(chunks) <= ql.SAMPLE_CHUNKS * len(usable)
    again = ql.sample_chunks(docs.repartition(5), labels)
    assert all(np.array_equal(a, b) for a, b in zip((chunks, owner, good), again))


def test_scores_do_not_depend_on_batches_and_see_the_end(fitted):
    model, _ = fitted
    tables_ = ql._tables(model)
    clean = "This and that were there. The other one was, of all things, in the house. " * 30
    texts = ["", clean, "x", clean + "|" + " a | b" * 800, clean * 40, None, "é" * 300]

    def scores(most):
        return np.concatenate([ql.score_texts(model, tables_, data, offsets) for _, data, offsets in text_slices(pa.array(texts), most)])

    together, apart = scores(1 << 30), scores(1)
    assert np.allclose(together, apart, atol=1e-9)
    assert together[0] == together[5]
    assert together[3] < together[1]


def test_windows_of_one_row_never_read_the_next(fitted):
    model, _ = fitted
    tables_ = ql._tables(model)
    for length in range(250, 262):
        alone = [ql.score_texts(model, tables_, d, o)[0] for _, d, o in text_slices(pa.array(["a" * length]))]
        followed = [ql.score_texts(model, tables_, d, o)[0] for _, d, o in text_slices(pa.array(["a" * length, "!!||" * 90]))]
        assert alone[0] == pytest.approx(followed[0], abs=1e-12)


def test_odd_documents_and_missing_labels(spark, odd, nothing, tables, fitted):
    assert ql.quality_scores(odd, fitted).count() == odd.count()
    assert ql.quality_scores(nothing, fitted).collect() == []
    labels = tables[1]
    without = ql.fit_quality(tables[0], labels.where("false"))
    assert without == (None, 0.5)
    assert {r.score for r in ql.quality_scores(odd, without).collect()} == {0.5}
    assert ql.fit_quality(tables[0], labels.where("quality = 1"))[1] == 1.0
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert ql.fit_quality(tables[0], nulls)[0] is None


def test_fitting_is_repeatable(tables, fitted):
    again, _ = ql.fit_quality(*tables)
    assert all(np.allclose(again[k], fitted[0][k], atol=1e-4) for k in again)


def test_score_is_that_of_a_plain_convolution(fitted):
    """Loops over positions, filters and chunks, from the weights alone."""
    model = {name: np.asarray(value, dtype=np.float64) for name, value in fitted[0].items()}

    def plain(raw):
        def filters_at(start):
            window = [raw[i] if i < len(raw) else 0 for i in range(start, start + 5)]
            return sum(model["bytes"][byte] @ model["filters"][place] for place, byte in enumerate(window)) + model["filter_bias"]

        cells = max(4, -(-(len(raw) + 4) // 64))
        # The last four windows of the padded text would read past it.
        starts = [[p for p in range(64 * c, 64 * c + 64) if p < 64 * cells - 4] for c in range(cells)]
        pooled = [np.maximum(np.max([filters_at(p) for p in own], axis=0), 0) for own in starts]
        firsts = sorted({min(first, cells - 4) for first in range(0, cells - 4 + 3, 3)})
        hidden = [np.maximum(np.max(pooled[f : f + 4], axis=0) @ model["hidden"] + model["hidden_bias"], 0) for f in firsts]
        return 1 / (1 + np.exp(-(np.mean(hidden, axis=0) @ model["out"] + model["out_bias"][0])))

    texts = ["", "x", "Plain words, and more of them. " * 9, "a | b » ünï" * 61, "1234567" * 90 + "end"]
    for text in texts:
        (_, data, offsets), = text_slices(pa.array([text]))
        assert ql.score_texts(fitted[0], ql._tables(fitted[0]), data, offsets)[0] == pytest.approx(plain(text.encode()), abs=1e-5)
