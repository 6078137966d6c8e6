import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from archgraph.session import materialize


SF = "/root/testdata/sf0.001"


def brute_groups(rows, size, percent):
    """Smallest reachable id per document, by comparing all pairs of shingle sets; a document without words is alone."""
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[doc_id] = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    group[y] = x
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def staged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_stages_keep_the_columns_of_documents(staged):
    for before, after in zip(staged, staged[1:-1]):
        assert after.schema.simpleString() == before.schema.simpleString()


def test_stages_work_on_what_the_one_before_kept(staged):
    documents, good, lines, single, mixed, packed = (df.collect() for df in staged)
    ids = lambda rows: Counter(r.doc_id for r in rows)
    assert 0.7 * len(documents) < len(good) < len(documents)
    assert not ids(good) - ids(documents) and not ids(lines) - ids(good) and not ids(single) - ids(lines)
    assert set(ids(mixed)) <= set(ids(single)) and max(ids(mixed).values()) <= 3
    assert ids([r for r in packed if r.piece == 0]) == ids(mixed)
    assert all(r.n_chars == len(r.text) for r in lines)
    groups = brute_groups([(r.doc_id, r.text) for r in lines], pipeline.SHINGLE_WORDS, pipeline.SIMILARITY_PERCENT)
    assert ids(single) == Counter(set(groups.values()))


def test_run_gives_the_last_stage(spark, staged):
    rows = pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, rows)) == Counter(map(key, staged[-1].collect()))


def test_stages_take_odd_documents(spark, odd, nothing):
    for rows in (odd, nothing):
        docs = materialize(rows, "odd")
        for _, stage in pipeline.STAGES[1:-1]:
            docs = materialize(stage(spark, docs, SF), "odd-stage")
            assert docs.columns == rows.columns
        assert pipeline.STAGES[-1][1](spark, docs, SF).columns[:2] == ["doc_id", "piece"]
    scored = pipeline.good_quality(spark, odd, SF)
    assert scored.columns == odd.columns and scored.count() <= odd.count()


def test_registered_queries():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


def test_registered_statements_agree(spark):
    import duckdb

    from archgraph.llm.queries import QUERIES, STATEMENTS

    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    for name, statement in STATEMENTS.items():
        result = connection.execute(statement)
        columns = [c[0] for c in result.description]
        expected = Counter(map(tuple, result.fetchall()))
        assert Counter(map(tuple, QUERIES[name](spark, SF).select(*columns).collect())) == expected, name
