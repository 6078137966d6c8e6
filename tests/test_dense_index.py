"""Search with pivots against search of all vectors: the same rows, and what is left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from archgraph.operators import dense_index
from archgraph.operators.dense_index import build_dense_index, search_dense_index
from archgraph.operators.tfidf import search_dense

VECTORS = "repo_id string, vec_id long, embedding array<float>"
QUERIES = "query_id long, repo_id string, embedding array<double>"


def rows_of(found):
    return sorted((r.query_id, r.repo_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())


def clusters(dice, n, each, dims, spread=0.05):
    middle = dice.normal(size=(n, dims))
    return np.concatenate([m / np.linalg.norm(m) + spread * dice.normal(size=(each, dims)) / np.sqrt(dims) for m in middle])


@pytest.mark.parametrize("sizes", [(20_000, 500), (30, 2)])
def test_same_rows_as_all_vectors(tables, sizes):
    dice = np.random.default_rng(8)
    grouped, uniform = clusters(dice, 6, 40, 8), np.round(dice.normal(size=(150, 8)), 1)
    uniform[::10] = 0
    hot = np.tile(grouped[3], (100, 1))  # equal vectors: ties by id
    stored = [("a", i, v.tolist()) for i, v in enumerate(np.concatenate([grouped, hot]))]
    stored += [("b", i, v.tolist()) for i, v in enumerate(uniform)] + [("b", 3, [1.0] * 8), ("b", 900, [1.0, 2.0])]
    asked = [(i, repo, v.tolist()) for i, v in enumerate([*grouped[::60], *uniform[::30], np.zeros(8)]) for repo in ("a", "b", "none")]
    asked += [(77, "b", [0.5, -1.0])]
    vectors, queries = tables.rows(VECTORS, *stored), tables.rows(QUERIES, *asked)
    found = search_dense_index(queries, build_dense_index(vectors, sizes[0]), 7, *sizes)
    assert rows_of(found) == rows_of(search_dense(queries, vectors, 7))


def test_odd_rows(tables):
    nan, inf = float("nan"), float("inf")
    vectors = tables.rows(VECTORS, ("r", 1, [1.0, 0.0]), ("r", 2, None), ("r", 3, []), ("r", 4, [1.0, None]), ("r", 5, [nan, 1.0]), ("r", 6, [inf, 1.0]),
                          ("r", 7, [1.0, 0.0, 0.0]), ("r", 8, [0.0, 0.0]), ("r", 9, [0.6, 0.8]), ("z", 1, [0.0, 0.0]))
    queries = tables.rows(QUERIES, (1, "r", [2.0, 0.0]), (2, "r", [0.0, 0.0, 3.0]), (3, "r", None), (4, "r", [nan, 0.0]), (5, "r", [1.0]), (6, "z", [-1.0, 0.0]))
    found = search_dense_index(queries, build_dense_index(vectors), 5)
    assert rows_of(found) == rows_of(search_dense(queries, vectors, 5))
    assert {r[0] for r in rows_of(found)} == {1, 2, 6}
    none = build_dense_index(tables.rows(VECTORS))
    assert search_dense_index(queries, none, 5).isEmpty()
    assert search_dense_index(tables.rows(QUERIES), build_dense_index(vectors), 5).isEmpty()


def test_other_clusters_are_left_out(tables, monkeypatch):
    """The vectors of rings that are scored, against queries times vectors."""
    dice = np.random.default_rng(9)
    points = clusters(dice, 40, 50, 64)
    vectors = tables.rows(VECTORS, *[("r", i, v.tolist()) for i, v in enumerate(points)])
    queries = tables.rows(QUERIES, *[(i, "r", v.tolist()) for i, v in enumerate(points[::100])])
    index, scored, real = build_dense_index(vectors), [], dense_index.score_rings

    def counting(asked, chosen, index, k, rows_per_block):
        scored.append(chosen.join(index.rings, ["repo_id", "dims", "pivot", "ring"]).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0])
        return real(asked, chosen, index, k, rows_per_block)

    monkeypatch.setattr(dense_index, "score_rings", counting)
    found = search_dense_index(queries, index, 8)
    assert rows_of(found) == rows_of(search_dense(queries, vectors, 8))
    assert sum(scored) < len(points) * 20 / 8
