"""File scan, limits, URLs, repository states, graph store."""

import datetime as dt

import pytest

from archgraph.schemas import REPOSITORIES, STATUS_LOG
from archgraph.session import shared_folder
from archgraph.sources import files, graph_store, repositories, urls
from tests.conftest import call


def test_scan_of_a_folder(spark, tmp_path):
    for name, content in {
        "r1/src/app.py": "x = 1\n", "r1/build/gen.py": "y\n", "r1/a/node_modules/b/c.js": "z", "r2/Main.JAVA": "class M {}",
        "r2/README": "hello", "r2/lat.py": b"# caf\xe9\n", "r1/src/build": "a file of an ignored name",
    }.items():
        path = tmp_path / "build" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    scanned = files.read_source_files(spark, str(tmp_path / "build"))
    rows = {(r.repo_id, r.path): r for r in scanned.collect()}
    assert set(rows) == {("r1", "src/app.py"), ("r2", "Main.JAVA"), ("r2", "README"), ("r2", "lat.py")}
    assert rows["r1", "src/app.py"].size_bytes == 6 and rows["r1", "src/app.py"].content == "x = 1\n"
    assert rows["r2", "lat.py"].content == "# caf�\n"
    profile = {r.repo_id: r for r in files.profile_repositories(scanned).collect()}
    assert profile["r2"].languages == {"java": 1, "python": 1} and profile["r2"].file_count == 3
    assert files.extractable(scanned, ["python"]).count() == 2


@pytest.mark.parametrize("path, language", [
    ("a/b.py", "python"), ("a/b.PY", "python"), ("b.tsx", "typescript"), ("b.mjs", "javascript"), ("b.hpp", "cpp"),
    ("b.tar.cc", "cpp"), (".py", None), ("b", None), ("b.", None), ("a.py/b", None), ("b.txt", None)])
def test_languages(tables, path, language):
    assert files.with_language(tables.rows("path string", (path,))).first().language == language


def test_limits_are_inclusive_and_files_come_first(tables):
    mb = 1024 * 1024
    profile = tables.rows("repo_id string, file_count long, total_size_bytes long",
                          ("at", 5000, 500 * mb), ("files", 5001, 501 * mb), ("bytes", 1, 500 * mb + 1))
    limited = files.apply_limits(profile, 5000, 500)
    reasons = {r.repo_id: r.reject_reason for r in limited.collect()}
    assert reasons == {"at": None, "files": "more than 5000 files", "bytes": "more than 500 MB"}
    listed = tables.rows("repo_id string, path string", ("at", "a"), ("files", "b"))
    assert [r.repo_id for r in files.accepted_files(listed, limited).collect()] == ["at"]


ACCEPTED = {
    "https://github.com/octo/tools": ("octo", "tools"), "https://github.com/octo/tools.git": ("octo", "tools"),
    "https://github.com/octo/tools/": ("octo", "tools"), " \thttps://github.com/octo/to.ols.git/\n": ("octo", "to.ols"),
    "https://github.com/a/.git": None,
}
REJECTED = [
    "https://example.org/octo/tools", "ext::sh -c ls", "file:///etc/hosts", "git@github.com:octo/tools.git",
    "https://github.com/octo/../../etc", "http://github.com/octo/tools", "https://github.com/octo", "", None,
    "https://github.com/octo/..", "https://github.com/octo/.", "https://github.com/-octo/tools",
    "https://github.com/octo/tools/issues", "https://github.com/" + "o" * 40 + "/tools", "https://github.com/octo/a b",
    "https://github.com/octo/" + "t" * 101,
]


def test_urls(tables):
    everything = list(ACCEPTED) + REJECTED
    rows = urls.validate_repo_urls(tables.rows("i int, url string", *enumerate(everything))).orderBy("i").collect()
    for row, expected in zip(rows, [*ACCEPTED.values(), *[None] * len(REJECTED)]):
        if row.url == "https://github.com/a/.git":
            continue  # a repository of that very name
        assert (row.url_error is None) == (expected is not None), row.url
        if expected:
            assert (row.owner, row.repo) == expected
            assert row.clone_url == f"https://github.com/{expected[0]}/{expected[1]}.git"
        else:
            assert row.owner is None and row.clone_url is None


def test_registration(tables):
    at = dt.datetime(2024, 1, 1)
    rows = urls.register_repositories(tables.rows(
        "id string, url string, submitted_at timestamp", ("1", "https://github.com/o/t", at), ("2", "nope", at))).collect()
    assert [(r.id, r.url, r.owner, r.name, r.status) for r in rows] == [
        ("1", "https://github.com/o/t.git", "o", "t", "pending")]


def test_states(tables, spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    log = spark.createDataFrame([
        ("a", day[0], 0, "cloning", None, None, None, None), ("a", day[2], 2, "ready", None, 5, 6, 7),
        ("a", day[2], 1, "embedding", None, None, None, None), ("b", day[3], 3, "failed", "boom", None, None, None),
        ("c", day[1], 0, "parsing", None, None, None, None), ("d", day[1], 0, "pending", None, None, None, None),
    ], STATUS_LOG)
    latest = repositories.latest_status(log)
    rows = {r.repo_id: r for r in latest.collect()}
    assert (rows["a"].status, rows["a"].file_count, rows["a"].created_at, rows["a"].updated_at) == (
        "ready", 5, day[0], day[2])
    assert rows["b"].error == "boom"
    assert [r.repo_id for r in repositories.list_repositories(latest).collect()] == ["b", "c", "d", "a"]
    assert repositories.get_repository(latest, "c").count() == 1
    asked = tables.rows("repo_id string, x int", ("a", 1), ("b", 2), ("z", 3))
    assert [r.x for r in repositories.only_ready(asked, latest).collect()] == [1]
    assert {r.repo_id: (r.readiness, r.response_code) for r in repositories.readiness(asked, latest).collect()} == {
        "a": ("ready", 200), "b": ("not_ready", 409), "z": ("missing", 404)}
    states = {}
    for r in repositories.stage_states(latest).orderBy("position").collect():
        states.setdefault(r.repo_id, []).append(r.state)
    assert states == {"a": ["done"] * 5 + ["active"], "b": ["pending"] * 6, "d": ["pending"] * 6,
                      "c": ["done", "done", "active", "pending", "pending", "pending"]}


def test_records(tables, spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    registered = urls.register_repositories(tables.rows(
        "id string, url string, submitted_at timestamp", ("a", "https://github.com/o/a", day[0]),
        ("b", "https://github.com/o/b", day[1])))
    log = spark.createDataFrame([("a", day[2], 0, "ready", None, 3, 6, 7)], STATUS_LOG)
    profile = files.profile_repositories(tables.rows("repo_id string, path string, size_bytes long",
                                                     ("a", "x.py", 5), ("a", "y.txt", 5)))
    records = repositories.repository_records(registered, repositories.latest_status(log), profile)
    assert records.columns == REPOSITORIES.fieldNames()
    b, a = repositories.list_repositories(records).collect()
    assert (a.status, a.file_count, a.symbol_count, a.languages, a.updated_at) == ("ready", 2, 6, {"python": 1}, day[2])
    assert (b.status, b.file_count, b.relationship_count, b.languages, b.updated_at) == ("pending", 0, 0, {}, day[1])
    assert repositories.get_repository(records, "b").first().owner == "o"
    limited = files.apply_limits(profile, max_files=1, max_megabytes=500)
    assert [tuple(r) for r in repositories.scan_status(limited).collect()] == [("a", "failed", "more than 1 files", 2)]


def test_store_keeps_one_snapshot_per_repository(spark, tables, tmp_path):
    store = str(tmp_path / "store")

    def put(batch, repo, names):
        symbols = [{"symbol_type": "function", "id": n, "repo_id": repo} for n in names]
        graph = tables.graph(symbols, [call(names[0], n, repo_id=repo) for n in names])
        graph_store.write_graph(graph, store, batch, buckets=4)
        graph_store.write_status(tables.rows("repo_id string", (repo,)), store, batch, "ready")

    def stored(**more):
        nodes, edges = graph_store.read_graph(spark, store, **more)
        return {r.uid for r in nodes.collect()}, edges.count()

    put(1, "a", ["f", "g"])
    put(2, "b", ["h"])
    assert stored() == ({"a:f", "a:g", "b:h"}, 3)
    put(3, "a", ["f"])
    assert stored() == ({"a:f", "b:h"}, 2)
    put(3, "a", ["f", "k"])  # the same batch again replaces itself
    assert stored() == ({"a:f", "a:k", "b:h"}, 3)
    assert stored(repo_ids=["b"]) == ({"b:h"}, 1)
    plan = graph_store.read_graph(spark, store, ["b"]).nodes._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo_bucket" in plan or "repo_bucket" in plan.split("PartitionFilters:")[1]
    # Half-written batches are not visible.
    graph_store.write_graph(tables.graph([{"symbol_type": "function", "id": "late", "repo_id": "b"}], []), store, 9, 4)
    assert stored(repo_ids=["b"]) == ({"b:h"}, 1)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured in shared_folder(spark)
