import numpy as np
import pytest

from archgraph.llm import nearest as nn
from archgraph.llm import vector_duplicates as vd

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, node string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA)


def cloud(seed=1, number=400, width=12):
    draw = np.random.default_rng(seed)
    points = draw.normal(size=(number, width))
    points[100:160] = points[99] + draw.normal(size=(60, width)) * 0.12
    points[200:230] = points[199]
    points[300:310] *= 40
    return points.astype(np.float32)


ODD = [(1000, None), (1001, []), (1002, [0.0] * 12), (1003, [1.0, None] + [0.0] * 10), (1004, [float("nan")] * 12), (1005, [float("inf")] + [1.0] * 11)]


def brute(points):
    wide = points.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    group = np.arange(len(points))
    while True:
        lower = np.minimum(group, np.where(linked, group[None, :], len(points)).min(axis=1))
        if (lower == group).all():
            return linked.sum(axis=1), group
        group = lower


@pytest.mark.parametrize("block", [1024, 16])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vd, "BLOCK", block)
    points = cloud()
    found = vd.near_duplicate_vectors(table(spark, [*enumerate(points.tolist()), *ODD])).collect()
    links, group = brute(points)
    expected = {(i, int(links[i]), int(group[i])) for i in range(len(points))} | {(i, 0, i) for i, _ in ODD}
    assert len(found) == len(expected)
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_no_link_of_a_dense_group_is_lost(spark):
    draw = np.random.default_rng(5)
    points = draw.normal(size=(6000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[:2000] = points[0] + draw.normal(size=(2000, 64)) * 0.175 / 8
    points[4000:5000] = points[5000:] + draw.normal(size=(1000, 64)) * 0.31 / 8  # cosines on both sides of the threshold
    points = points.astype(np.float32)
    links, group = brute(points)
    found = {r.vec_id: (r.n_links, r.component_id) for r in vd.near_duplicate_vectors(table(spark, list(enumerate(points.tolist())))).collect()}
    assert 1000 * 1000 < links.sum() and 200 < (links[4000:5000] > 0).sum() < 900
    assert found == {i: (int(links[i]), int(group[i])) for i in range(len(points))}


def test_guests_reach_every_cell_of_a_partner():
    draw = np.random.default_rng(6)
    for width in (3, 8):
        found = draw.normal(size=(9, width))
        found /= np.linalg.norm(found, axis=1, keepdims=True)
        points = draw.normal(size=(700, width))
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        own, guest = vd.visited_cells(points, found)
        one, other = np.nonzero(points @ points.T >= vd.THRESHOLD)
        met = guest[one, own[other]].astype(int) + guest[other, own[one]]
        assert (met == (own[one] != own[other])).all()


def test_no_vectors_to_compare(spark):
    assert vd.near_duplicate_vectors(table(spark, [])).collect() == []
    assert {r.n_links for r in vd.near_duplicate_vectors(table(spark, ODD)).collect()} == {0}
    assert nn.nearest(table(spark, []), table(spark, [])).collect() == []


def test_equal_ids_and_null_ids_stay_rows(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.01]), (7, [0.0, 1.0, 0.0])]
    found = sorted(((r.vec_id or -1, r.n_links, r.component_id) for r in vd.near_duplicate_vectors(table(spark, rows)).collect()))
    assert found == [(-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7)]


def expected_neighbours(points, queries, neighbours):
    wide = points.astype(np.float64)
    out = {}
    for q in queries:
        scores = (wide[q] * wide).sum(axis=1)
        order = sorted((i for i in range(len(points)) if i != q), key=lambda i: (-scores[i], i))[:neighbours]
        out[q] = [(i, scores[i]) for i in order]
    return out


@pytest.mark.parametrize("group, block", [(8192, 1024), (64, 7)])
def test_whole_share_is_exact(spark, monkeypatch, group, block):
    monkeypatch.setattr(nn, "GROUP_ENTRIES", group)
    monkeypatch.setattr(nn, "BLOCK_QUERIES", block)
    points = cloud(4)
    vectors = table(spark, [*enumerate(points.tolist()), *ODD, (None, [1.0] * 12)])
    rows = nn.nearest(vectors, vectors.where("vec_id % 20 = 0"), share=1.0).collect()
    none = [r for r in rows if r.vec_id is None]
    assert not none
    expected = expected_neighbours(points, range(0, 400, 20), 20)
    for q, best in expected.items():
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r[1] for r in own] == [i for i, _ in best]
        assert [r[0] for r in own] == list(range(1, 21))
        assert np.allclose([r[2] for r in own], [s for _, s in best], rtol=1e-12)


def test_share_finds_nine_tenths(spark):
    draw = np.random.default_rng(8)
    points = draw.normal(size=(3000, 64)).astype(np.float32)
    vectors = table(spark, list(enumerate(points.tolist())))
    found = {(r.query_id, r.vec_id) for r in nn.nearest(vectors, vectors.where("vec_id % 20 = 0")).collect()}
    wanted = {(q, i) for q, best in expected_neighbours(points, range(0, 3000, 20), 20).items() for i, _ in best}
    assert len(found) == len(wanted) and len(found & wanted) >= 0.9 * len(wanted)


@pytest.mark.parametrize("group", [8192, 32])
def test_repeated_queries_and_entries_count_once(spark, monkeypatch, group):
    """Every row twice, a third of all rows one vector id, and an id with two vectors."""
    monkeypatch.setattr(nn, "GROUP_ENTRIES", group)
    draw = np.random.default_rng(5)
    points = draw.normal(size=(120, 6)).astype(np.float32)
    rows = list(enumerate(points.tolist()))
    vectors = table(spark, [*rows, *rows, *[rows[7]] * 120, (3, (-points[3]).tolist())])
    found = nn.nearest(vectors, table(spark, [rows[20], rows[20], rows[40]]), share=1.0).collect()
    for query in (20, 40):
        scores = (points[query].astype(np.float64) * points).sum(axis=1)
        scores[3] = max(scores[3], -scores[3])
        best = sorted((i for i in range(120) if i != query), key=lambda i: (-scores[i], i))[:20]
        own = sorted((r.rank, r.vec_id) for r in found if r.query_id == query)
        assert own == list(enumerate(best, 1))
    assert len(found) == 40


def test_ids_with_a_common_factor_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(nn, "GROUP_ENTRIES", 40)
    vectors = table(spark, [(20 * i, [1.0, 1.0 + i % 3 / 1e6]) for i in range(400)])
    rows = nn.nearest(vectors, vectors.where("vec_id = 0"), share=1.0).collect()
    assert len(rows) == 20
    ids = np.arange(400, dtype=np.uint64) * np.uint64(20)
    dealt = np.bincount((nn.mix64(ids) % np.uint64(10)).astype(np.int64), minlength=10)
    assert dealt.min() > 20 and dealt.max() < 65


def test_fewer_candidates_than_neighbours(spark):
    vectors = table(spark, [(i, [1.0, float(i)]) for i in range(4)])
    rows = nn.nearest(vectors, vectors.where("vec_id = 0"), share=1.0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 1), (2, 2), (3, 3)]


def test_walk_follows_summed_products():
    draw = np.random.default_rng(0)
    first, second = draw.normal(size=7), draw.normal(size=5)
    counts = draw.integers(0, 4, 35)
    visited = nn.walk(first, second, counts, counts.sum())
    sums = (first[:, None] + second[None, :]).reshape(-1)
    assert visited == [c for c in np.argsort(-sums).tolist() if counts[c]]
    assert len(nn.walk(first, second, counts, 5)) < len(visited)
