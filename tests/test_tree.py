"""The folder of repositories as a data source."""

import os

import pytest

from archgraph.sources import files
from archgraph.sources.tree import list_source_tree, read_source_tree

FILES = {
    "r1/src/app.py": b"x = 1\n", "r1/src/app.txt": b"text", "r1/build/gen.py": b"y\n", "r1/a/node_modules/b/c.js": b"z", "r2/Main.JAVA": b"class M {}",
    "r2/README": b"hello", "r2/lat.py": b"# caf\xe9\n", "r1/src/build": b"a file of an ignored name", "r2/deep/er/est/x.ts": b"let x", "venv/in.py": b"repository of an ignored name",
    "loose.py": b"in no repository", "r3/empty.py": b"",
}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "build"
    for name, content in FILES.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(base)


def rows(frame):
    return {(r.repo_id, r.path): r for r in frame.collect()}


def test_the_same_rows_as_the_scan_of_all_files(spark, root):
    found = rows(read_source_tree(spark, root))
    expected = rows(files.read_source_files(spark, root))
    assert set(found) == set(expected) | {("r3", "empty.py")}  # Spark's own reader leaves out empty files
    for key, row in expected.items():
        assert (found[key].size_bytes, found[key].content) == (row.size_bytes, row.content)


@pytest.mark.parametrize("address", ["{}", "file:{}", "file://{}", "{}/"])
def test_listing(spark, root, address):
    listed = list_source_tree(spark, address.format(root))
    assert listed.rdd.getNumPartitions() == 4  # one per folder of the root
    assert {(r.repo_id, r.path, r.size_bytes) for r in listed.collect()} == {
        (*name.split("/", 1), len(content)) for name, content in FILES.items()
        if "/" in name and not set(name.split("/")[1:]) & set(files.IGNORED_DIRS)}


def test_only_files_that_are_kept_are_opened(spark, root):
    for name in ("r1/src/app.txt", "r2/README", "r2/Main.JAVA"):
        os.chmod(f"{root}/{name}", 0)
    found = rows(read_source_tree(spark, root, languages=["python"], max_bytes=6))
    assert set(found) == {("r1", "src/app.py"), ("r3", "empty.py")}
    assert found["r3", "empty.py"].content == ""


def test_ignored_folders_are_never_entered(spark, root, monkeypatch):
    """A folder that cannot be listed, and links in circles, stand in ignored folders."""
    os.makedirs(f"{root}/r1/.git")
    os.symlink("loop", f"{root}/r1/.git/loop")
    os.symlink(root, f"{root}/r1/node_modules")
    os.chmod(f"{root}/r1/build", 0)
    assert ("r1", "src/app.py") in rows(read_source_tree(spark, root))
    from pyarrow import fs

    from archgraph.sources import tree

    entered = []
    original = tree._entries
    monkeypatch.setattr(tree, "_entries", lambda system, folder: entered.append(folder) or original(system, folder))
    reader = tree.TreeReader(root)
    for partition in reader.partitions():
        list(reader.read(partition))
    assert isinstance(tree.open_root(root)[0], fs.LocalFileSystem)
    assert not [f for f in entered if set(f.removeprefix(root).split("/")[2:]) & set(files.IGNORED_DIRS)]


def test_asked_repositories_are_the_only_partitions(spark, root):
    found = list_source_tree(spark, root, repo_ids=["r2", "r9"])
    assert {r.repo_id for r in found.collect()} == {"r2"}
    assert found.rdd.getNumPartitions() == 1


def test_empty_root(spark, tmp_path):
    assert read_source_tree(spark, str(tmp_path)).collect() == []
