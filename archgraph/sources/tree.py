"""A folder of repositories as a Spark data source.

The folders below the root are repositories; each is a partition, walked in its
own task. Ignored folders are never entered, so nothing in them is listed,
opened or needs to be readable. The listing is small; contents are read after
it, by tasks that share the files of all repositories evenly, and only those of
files that are kept.

The root is any address that Arrow's file systems reach. For stores that only
Spark reads there is ``files.read_source_files``, which lists ignored folders
before it drops them, and leaves out empty files as Spark's reader does.
"""

import json

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from archgraph.schemas import SOURCE_FILES
from archgraph.sources.files import IGNORED_DIRS, language_of

LISTED = "repo_id string, path string, size_bytes long"
BATCH_ROWS, BATCH_BYTES = 5_000, 8 << 20


def open_root(root: str):
    """(file system, path) of an address; plain paths and Hadoop's ``file:/path`` are local."""
    if root.startswith("file:") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def _entries(system, folder):
    """Folders and files directly in a folder, by name, without those of ignored names."""
    found = system.get_file_info(fs.FileSelector(folder, recursive=False))
    kept = sorted((info for info in found if info.base_name not in IGNORED_DIRS), key=lambda info: info.base_name)
    return [i for i in kept if i.type == fs.FileType.Directory], [i for i in kept if i.type == fs.FileType.File]


class Repository(InputPartition):
    def __init__(self, name):
        super().__init__(name)
        self.name = name


class TreeReader(DataSourceReader):
    def __init__(self, root, names=None):
        self.root = root
        self.names = names

    def partitions(self):
        system, path = open_root(self.root)
        # A repository may have any name.
        found = system.get_file_info(fs.FileSelector(path, recursive=False))
        names = sorted(i.base_name for i in found if i.type == fs.FileType.Directory)
        return [Repository(name) for name in names if self.names is None or name in self.names]

    def read(self, partition):
        if partition is None:  # a root without folders
            return
        system, path = open_root(self.root)
        rows = []
        pending = [(f"{path.rstrip('/')}/{partition.name}", "")]
        while pending:
            folder, prefix = pending.pop()
            folders, files = _entries(system, folder)
            pending.extend((i.path, f"{prefix}{i.base_name}/") for i in reversed(folders))
            rows.extend((partition.name, prefix + i.base_name, i.size) for i in files)
            if len(rows) >= BATCH_ROWS:
                yield _listed(rows)
                rows = []
        if rows:
            yield _listed(rows)


def _listed(rows):
    repos, paths, sizes = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(repos), pa.array(paths), pa.array(sizes, pa.int64())], names=["repo_id", "path", "size_bytes"])


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: the files of all repositories, without contents.

    The option ``repositories``, a JSON list of names, leaves out the others.
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTED

    def reader(self, schema):
        names = self.options.get("repositories")
        return TreeReader(self.options["path"], None if names is None else set(json.loads(names)))


def list_source_tree(spark: SparkSession, root: str, repo_ids=None) -> DataFrame:
    """repo_id, path, size_bytes of every file under ``<root>/<repo_id>/...`` outside ignored folders."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree")
    if repo_ids is not None:
        reader = reader.option("repositories", json.dumps(list(repo_ids)))
    return reader.load(root)


def read_source_tree(spark: SparkSession, root: str, languages=None, max_bytes: int | None = None, repo_ids=None) -> DataFrame:
    """The same with ``content``, for files of the given languages and sizes; no other file is opened.

    Bytes that are no UTF-8 become replacement characters. A file that is gone
    by the time it is read has null content, as a removed file has.
    """
    kept = list_source_tree(spark, root, repo_ids)
    if languages is not None:
        kept = kept.filter(language_of(F.col("path")).isin(*languages))
    if max_bytes is not None:
        kept = kept.filter(F.col("size_bytes") <= max_bytes)
    fields = ["repo_id", "path", "size_bytes"]

    def with_content(batches):
        system, base = open_root(root)
        for batch in batches:
            held, size = [], 0
            for row in batch.to_pylist():
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{row['repo_id']}/{row['path']}") as stream:
                        content = stream.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    content = None
                held.append(row | {"content": content})
                size += row["size_bytes"]
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held, size = [], 0
            yield pa.RecordBatch.from_pylist(held, _ARROW)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return kept.select(*fields).repartition(width, "repo_id", "path").mapInArrow(with_content, SOURCE_FILES)


_ARROW = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.string())])
