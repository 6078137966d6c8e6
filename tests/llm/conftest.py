"""Awkward documents that every operator must take."""

import pytest
from pyspark.sql import types as T

CLASHES = ("row", "key", "size", "target", "taken", "component", "text_hash", "n_lines", "score", "predicted", "places", "n_words", "piece", "length", "first")
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, rows, clashes=()):
    """``rows`` of (doc_id, text, source)."""
    schema = T.StructType([*SCHEMA.fields, *(T.StructField(name, T.StringType()) for name in clashes)])
    full = [(i, text, "en", source, len(text) if text is not None else None, *("x" for _ in clashes)) for i, text, source in rows]
    return spark.createDataFrame(full, schema)


LONG = " ".join(f"word{i % 977}" for i in range(30_000))

ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "a"), (2, "alpha beta gamma delta epsilon zeta eta theta", "b"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "b"), (3, None, "a"), (4, "", None), (5, "   \n\t ", "a"), (6, "one", None),
    (6, "one", None), (7, "Zwei Wörter", "ü"), (8, LONG, "a"), (9, LONG + " end", "b"), (None, "no id here at all, none", "a"), (10, "\n\nx\n", ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD, CLASHES)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows, clashes=(): documents(spark, rows, clashes)
