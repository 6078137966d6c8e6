"""Source files to symbol, relationship and parse-error tables."""

from itertools import count
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from archgraph.functions.text import symbol_uid
from archgraph.operators.python_source import extract_python
from archgraph.schemas import IR_ROWS, PARSE_ERRORS, RELATIONSHIPS, SYMBOLS
from archgraph.session import materialize
from archgraph.sources.files import extractable

# Language -> generator of (kind, fields) for one file. Register more here.
EXTRACTORS = {"python": extract_python}

# Kind of the row of a file that is gone: its content is null.
REMOVED = "removed"

# Rows a task gathers before it hands a batch back.
OUTPUT_ROWS = 5000


class ExtractedTables(NamedTuple):
    symbols: DataFrame
    relationships: DataFrame
    parse_errors: DataFrame


def extract_rows(files: DataFrame, extractors=None) -> DataFrame:
    """One row per symbol, relationship, error or removed file; a map over files.

    Files are dealt out by repository and path first. Small texts come in few
    large parts (a Parquet row group holds a hundred thousand of them), and
    parsing costs far more than moving a text.
    """
    registry = dict(EXTRACTORS if extractors is None else extractors)
    arrow_schema = to_arrow_schema(IR_ROWS)

    def rows_of(repo_id, path, language, content, version):
        if content is None:
            yield {"kind": REMOVED, "repo_id": repo_id, "file_path": path, "seq": 0, "version": version}
            return
        emitted = registry[language](path, content)
        for seq in count():
            try:
                kind, fields = next(emitted)
            except StopIteration:
                return
            except Exception as problem:  # one bad file must not stop the job
                kind, fields = "error", f"{type(problem).__name__}: {problem}"
            yield {"kind": kind, "repo_id": repo_id, "file_path": path, "seq": seq,
                   "version": version, kind: fields}

    def extract(batches):
        rows = []
        for batch in batches:
            for file in zip(*(column for column in batch.columns)):
                rows.extend(rows_of(*(value.as_py() for value in file)))
                if len(rows) >= OUTPUT_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, arrow_schema)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, arrow_schema)

    version = F.col("version") if "version" in files.columns else F.lit(None).cast("string")
    wanted = extractable(files, registry).select("repo_id", "path", "language", "content", version)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: by their size texts would be gathered into a few
    return wanted.repartition(tasks, "repo_id", "path").mapInArrow(extract, IR_ROWS)


def split_rows(rows: DataFrame) -> ExtractedTables:
    symbols = (
        rows.filter(F.col("kind") == "symbol")
        .select("repo_id", "file_path", "seq", "symbol.*")
        .withColumn("uid", symbol_uid(F.col("repo_id"), F.col("id")))
        .select(*SYMBOLS.fieldNames())
    )
    relationships = (
        rows.filter(F.col("kind") == "relationship")
        .select("repo_id", "seq", F.col("file_path").alias("source_file"), "relationship.*")
        .select(*RELATIONSHIPS.fieldNames())
    )
    errors = rows.filter(F.col("kind") == "error").select(*PARSE_ERRORS.fieldNames())
    return ExtractedTables(symbols, relationships, errors)


def extract_ir(files: DataFrame, extractors=None) -> ExtractedTables:
    """Parse every file once, into a written table that the three results read."""
    return split_rows(materialize(extract_rows(files, extractors), "ir"))


def parse_summary(files: DataFrame, parse_errors: DataFrame, extractors=None) -> DataFrame:
    """Parsed files and parse errors of every repository."""
    registry = EXTRACTORS if extractors is None else extractors
    parsed = extractable(files, registry).filter(F.col("content").isNotNull()).groupBy("repo_id").agg(F.count("*").alias("parsed_files"))
    errors = parse_errors.groupBy("repo_id").agg(F.count("*").alias("parse_errors"))
    return parsed.join(errors, "repo_id", "left").fillna(0, ["parse_errors"])
