import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from archgraph import schemas  # noqa: E402
from archgraph.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Tables:
    """Small tables from tuples, with defaults for the columns a test does not care for."""

    def __init__(self, spark):
        self.spark = spark

    def symbols(self, *rows):
        """(symbol_type, id) or dicts; repo r unless given."""
        full = []
        for i, row in enumerate(rows):
            given = row if isinstance(row, dict) else {"symbol_type": row[0], "id": row[1]}
            base = {"repo_id": "r", "seq": i, "file_path": "src/a.py", "start_line": 1, "end_line": 2,
                    "language": "python", "decorators": [], "docstring": None} | given
            base.setdefault("qualified_name", base["id"])
            dotted = base["symbol_type"] == "import"
            base.setdefault("name", base["qualified_name"] if dotted else base["qualified_name"].rsplit(".", 1)[-1])
            base.setdefault("uid", f"{base['repo_id']}:{base['id']}")
            full.append(tuple(base[c] for c in schemas.SYMBOLS.fieldNames()))
        return self.spark.createDataFrame(full, schemas.SYMBOLS)

    def relationships(self, *rows):
        full = []
        for i, row in enumerate(rows):
            base = {"repo_id": "r", "seq": i, "target_id": None, "target_name": "", "relationship_type": "calls",
                    "source_file": "src/a.py", "source_line": i, "confidence": 0.5} | row
            full.append(tuple(base[c] for c in schemas.RELATIONSHIPS.fieldNames()))
        return self.spark.createDataFrame(full, schemas.RELATIONSHIPS)

    def graph(self, symbols, relationships):
        from archgraph.plans.graph import build_graph

        return build_graph(self.symbols(*symbols), self.relationships(*relationships))

    def rows(self, names, *rows):
        return self.spark.createDataFrame(list(rows), names)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark)


def call(source, target, line=1, kind="calls", **more):
    """A resolved relationship."""
    return {"source_id": source, "target_id": target, "target_name": target, "relationship_type": kind,
            "source_line": line, "confidence": 0.75} | more
