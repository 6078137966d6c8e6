"""Run registered queries on Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare [--sf 0.01] [name ...]
"""

import argparse
import math
import time

import duckdb

from archgraph.session import local_session
from checks.derived import TABLES
from checks.oracles import STATEMENTS, oracle
from checks.queries import QUERIES

TESTDATA = "/root/testdata/sf{}"


def connect(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    return repr(float(value)) if isinstance(value, int) else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir, name):
    """(same, number of rows, Spark seconds, oracle seconds, note)"""
    begin = time.time()
    frame = QUERIES[name](spark, sf_dir)
    columns, rows = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    spark_seconds = time.time() - begin
    if name not in STATEMENTS:
        return True, len(rows), spark_seconds, 0.0, "no oracle"
    begin = time.time()
    result = connection.execute(oracle(name))
    expected_columns, expected = canonical([c[0] for c in result.description], result.fetchall())
    oracle_seconds = time.time() - begin
    note = ""
    if columns != expected_columns:
        note = f"columns {columns} != {expected_columns}"
    elif rows != expected:
        missing, extra = set(expected) - set(rows), set(rows) - set(expected)
        note = (f"{len(rows)} rows, expected {len(expected)}; only expected: {sorted(missing)[:2]}; "
                f"only here: {sorted(extra)[:2]}")
    return not note, len(rows), spark_seconds, oracle_seconds, note


def main():
    arguments = argparse.ArgumentParser()
    arguments.add_argument("--sf", default="0.01")
    arguments.add_argument("names", nargs="*")
    options = arguments.parse_args()
    sf_dir = TESTDATA.format(options.sf)
    spark = local_session("checks")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    wrong = 0
    for name in options.names or QUERIES:
        try:
            same, n, seconds, oracle_seconds, note = compare(spark, connection, sf_dir, name)
        except Exception as problem:
            same, n, seconds, oracle_seconds, note = False, 0, 0.0, 0.0, str(problem)[:600]
        wrong += not same
        print(f"{'ok ' if same else 'BAD'} {name:32s} rows={n:<8d} spark={seconds:6.2f}s oracle={oracle_seconds:5.2f}s {note}",
              flush=True)
    raise SystemExit(wrong)


if __name__ == "__main__":
    main()
