"""Tables on shared storage, kept per repository as a base and the changes after it.

A batch adds folders and never touches those of another batch, so a repeated
batch replaces only itself and a lost job cannot damage what was there. A
repository's rows are those of its last base, a batch that holds all of it, and
of the changes after it. A change writes only rows that are new or different,
and the keys of all rows that it replaces or removes: files for extracted rows
and the text index, symbols for nodes, sources for edges. A row counts unless a
later change names its key. Edges from a repository to its files are columns of
the files' nodes and are not stored. Degrees are kept as signed differences: a
base counts all edges, a change those that it takes away and adds, and the sum
is the present count.

The manifest tells which batches are finished and what they are to a
repository. It is written last, so a batch is seen whole or not at all. A batch
adds one small entry; entries are merged, and rows before a base dropped, when
there are more than a few. Readers open only folders that the manifest names,
so neither a batch nor a query lists the history.

Folders are by batch and by a hash bucket of the repository, so their number
does not follow the number of repositories. The rebalance hint splits a
bucket that holds a hot repository into several files and merges small ones.
Rows of a file are sorted by repository, so readers of a few skip row groups.
The number of buckets is chosen at the first write, by the size that the store
will have, and kept in the store.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archgraph.operators.build import repository_edges
from archgraph.operators.degrees import merged_counts
from archgraph.schemas import EDGES, IR_ROWS, REPOSITORIES, REPOSITORY_NODE, STATUS_LOG, SYMBOLS, Graph

BUCKETS = 64
# Entries of the manifest that are read one by one; more are merged.
ENTRIES = 8

_PLACE = [T.StructField("batch_id", T.LongType()), T.StructField("repo_bucket", T.IntegerType())]


def _texts(*names):
    return [T.StructField(name, T.StringType()) for name in names]


SCHEMAS = {
    "ir": T.StructType(IR_ROWS.fields + _PLACE),
    "nodes": T.StructType(SYMBOLS.fields + _PLACE),
    "edges": T.StructType(EDGES.fields + _PLACE),
    "documents": T.StructType([
        T.StructField(name, T.IntegerType() if name.endswith("_line") else T.StringType())
        for name in ("repo_id", "doc_id", "symbol_uid", "text", "symbol_type", "name", "qualified_name", "file_path",
                     "start_line", "end_line")] + _PLACE),
    "term_counts": T.StructType([*_texts("repo_id", "file_path", "doc_id", "term"), T.StructField("tf", T.LongType()), *_PLACE]),
    "degrees": T.StructType([*_texts("repo_id", "uid", "symbol_type", "file_path", "relationship_type"), T.StructField("change", T.LongType()), *_PLACE]),
    "file_keys": T.StructType([*_texts("repo_id", "file_path"), *_PLACE]),
    "node_keys": T.StructType([*_texts("repo_id", "uid"), *_PLACE]),
    "edge_keys": T.StructType([*_texts("repo_id", "src"), *_PLACE]),
}
# Table -> the table of the keys that changes replace, and the key.
REPLACED_BY = {
    "ir": ("file_keys", "file_path"), "documents": ("file_keys", "file_path"), "term_counts": ("file_keys", "file_path"),
    "nodes": ("node_keys", "uid"), "edges": ("edge_keys", "src"),
}
STATUS = T.StructType([f for f in STATUS_LOG.fields if f.name != "status"]
                      + [_PLACE[0], T.StructField("status", T.StringType())])
MANIFEST = T.StructType([
    T.StructField("repo_id", T.StringType()), T.StructField("batch_id", T.LongType()), T.StructField("is_base", T.BooleanType()),
    *[T.StructField(name, T.LongType()) for name in ("file_count", "symbol_count", "relationship_count")]])


def repo_bucket(repo_id, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(repo_id), F.lit(buckets)).cast("int")


def store_buckets(spark: SparkSession, store: str, buckets: int = BUCKETS) -> int:
    """The store's number of buckets; the first call fixes it."""
    layout = spark.createDataFrame([(buckets,)], "buckets int").coalesce(1)
    layout.write.mode("ignore").parquet(f"{store}/layout")
    return spark.read.schema("buckets int").parquet(f"{store}/layout").first().buckets


def write_snapshot(df: DataFrame, store: str, name: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """Write the rows of one batch; the same batch written again replaces itself."""
    write_rows(df, store, name, batch_id, store_buckets(df.sparkSession, store, buckets))


def write_rows(df: DataFrame, store: str, name: str, batch_id: int, buckets: int) -> None:
    """The same in a store whose number of buckets the caller has looked up."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("long"))
        .withColumn("repo_bucket", repo_bucket(F.col("repo_id"), buckets))
        .hint("rebalance", "repo_bucket").sortWithinPartitions("repo_bucket", "repo_id")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "repo_bucket")
        .parquet(f"{store}/{name}")
    )


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def read_batches(spark: SparkSession, store: str, name: str, batches) -> DataFrame:
    """Rows that the given batches wrote; no other folder is listed."""
    folders = [f"{store}/{name}/batch_id={batch}" for batch in sorted(batches)]
    there = [folder for folder in folders if _exists(spark, folder)]
    if not there:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).option("basePath", f"{store}/{name}").parquet(*there)


def _exists(spark, folder):
    system, path = _file_system(spark, folder)
    return system.exists(path)


# Status and manifest ---------------------------------------------------------

def write_status(rows: DataFrame, store: str, batch_id: int, status: str) -> None:
    """Append status rows (repo_id and counts) of one stage of one batch.

    'ready' finishes the batch: an entry of the manifest follows. The batch is
    a repository's base unless its row has ``is_base`` = false.
    """
    sequence = F.lit(batch_id).cast("long")
    filled = rows
    for field in STATUS.fields:
        if field.name not in filled.columns:
            filled = filled.withColumn(field.name, F.lit(None).cast(field.dataType))
    (
        filled.withColumn("ts", F.current_timestamp()).withColumn("seq", sequence)
        .withColumn("batch_id", sequence).withColumn("status", F.lit(status))
        .select(*STATUS.fieldNames())
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "status").parquet(f"{store}/status")
    )
    if status == "ready":
        entry = filled if "is_base" in filled.columns else filled.withColumn("is_base", F.lit(True))
        _write_entry(entry.withColumn("batch_id", sequence).select(*MANIFEST.fieldNames()), store, batch_id)


def read_status(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(STATUS).parquet(f"{store}/status")


def _entry(kind: str, batch_id: int) -> str:
    return f"{kind}-{batch_id:012d}"


def _write_entry(entry: DataFrame, store: str, batch_id: int) -> None:
    """Add an entry; merge those of earlier batches when there are many.

    The entry of this batch stays as it is, since only the last batch of a
    stream can be repeated.
    """
    spark = entry.sparkSession
    entry.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/{_entry('entry', batch_id)}")
    merged, entries = _manifest_folders(spark, store)
    earlier = [e for e in entries if e < _entry("entry", batch_id)]
    if len(earlier) < ENTRIES:
        return
    last = int(earlier[-1].rsplit("-", 1)[1])
    live = live_entries(spark, store, last + 1)
    # A small table: a row per repository and live change.
    live.repartition(1).write.mode("overwrite").parquet(f"{store}/manifest/{_entry('merged', last)}")
    for old in [*merged, *earlier]:
        if old != _entry("merged", last):
            system, path = _file_system(spark, f"{store}/manifest/{old}")
            system.delete(path, True)


def _manifest_folders(spark: SparkSession, store: str):
    """Finished merges and entries, oldest first; their number is bounded by the merging."""
    if not _exists(spark, f"{store}/manifest"):
        return [], []
    system, path = _file_system(spark, f"{store}/manifest")
    names = sorted(status.getPath().getName() for status in system.listStatus(path))
    done = [name for name in names if _exists(spark, f"{store}/manifest/{name}/_SUCCESS")]
    return [n for n in done if n.startswith("merged-")], [n for n in done if n.startswith("entry-")]


def live_entries(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """Finished batches that hold rows of a repository's current state, or of the state ``before`` a batch."""
    merged, entries = _manifest_folders(spark, store)
    folders = entries
    if merged:
        from_merge = merged[-1].rsplit("-", 1)[1]
        folders = [merged[-1], *(e for e in entries if e.rsplit("-", 1)[1] > from_merge)]
    if not folders:
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(*[f"{store}/manifest/{folder}" for folder in folders])
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    base = F.max(F.when(F.col("is_base"), F.col("batch_id"))).over(Window.partitionBy("repo_id"))
    return rows.withColumn("base", base).filter(F.col("batch_id") >= F.col("base")).drop("base")


def current_snapshots(spark: SparkSession, store: str) -> DataFrame:
    """(repo_id, batch_id) of the last finished batch of every repository."""
    return live_entries(spark, store).groupBy("repo_id").agg(F.max("batch_id").alias("batch_id"))


def remove_superseded(spark: SparkSession, store: str) -> int:
    """Delete the batches that hold nothing of any repository's current state; returns their number.

    For a store that no one is reading an older state of.
    """
    needed = {r.batch_id for r in live_entries(spark, store).select("batch_id").distinct().collect()}  # one row per batch
    batches = {r.batch_id for r in read_status(spark, store).select("batch_id").distinct().collect()}
    old = [b for b in sorted(batches - needed) if needed and b < max(needed)]
    for name in SCHEMAS:
        for batch in old:
            system, path = _file_system(spark, f"{store}/{name}/batch_id={batch}")
            system.delete(path, True)
    return len(old)


# Records and rows --------------------------------------------------------------

def write_repositories(records: DataFrame, store: str) -> None:
    """Replace the table of repository records (identity, address, branch, commit, last status)."""
    records.select(*REPOSITORIES.fieldNames()).write.mode("overwrite").parquet(f"{store}/repositories")


def read_repositories(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(REPOSITORIES).parquet(f"{store}/repositories")


def write_graph(graph: Graph, store: str, batch_id: int, buckets: int = BUCKETS) -> None:
    write_snapshot(graph.nodes, store, "nodes", batch_id, buckets)
    write_snapshot(graph.edges.filter(F.col("src_type") != REPOSITORY_NODE), store, "edges", batch_id, buckets)


def live_rows(spark: SparkSession, store: str, name: str, entries: DataFrame, buckets=None) -> DataFrame:
    """Rows of a table in the state that ``entries`` make up, with their place.

    ``buckets`` prunes the folders. The keys that changes replaced are few
    beside the rows; without changes there are none and no join.
    """
    batches = {r.batch_id: r.bases for r in entries.groupBy("batch_id").agg(F.min("is_base").alias("bases")).collect()}  # a row per live batch

    def read(table, wanted):
        rows = read_batches(spark, store, table, wanted)
        if buckets is not None:
            rows = rows.filter(F.col("repo_bucket").isin(*buckets))
        return rows.join(entries.select("repo_id", "batch_id"), ["repo_id", "batch_id"], "left_semi").select(*SCHEMAS[table].fieldNames())

    rows = read(name, batches)
    changes = [batch for batch, only_bases in batches.items() if not only_bases]
    if not changes or name not in REPLACED_BY:
        return rows
    keys, key = REPLACED_BY[name]
    newest = read(keys, changes).groupBy("repo_id", key).agg(F.max("batch_id").alias("replaced_in"))
    kept = rows.join(newest, ["repo_id", key], "left").filter(
        F.col("replaced_in").isNull() | (F.col("batch_id") >= F.col("replaced_in")))
    return kept.select(*SCHEMAS[name].fieldNames())


def current_rows(spark: SparkSession, store: str, name: str, repo_ids=None) -> DataFrame:
    """Current rows of a table; with ``repo_ids`` only the folders of their buckets are read."""
    entries = live_entries(spark, store)
    folders = None
    if repo_ids is not None:
        entries = entries.filter(F.col("repo_id").isin(*repo_ids))
        buckets = store_buckets(spark, store)
        folders = [repo_bucket(F.lit(r), buckets) for r in repo_ids]
    rows = live_rows(spark, store, name, entries, folders)
    if repo_ids is not None:
        rows = rows.filter(F.col("repo_id").isin(*repo_ids))
    return rows.select(*[f.name for f in SCHEMAS[name].fields if f not in _PLACE])


def read_graph(spark: SparkSession, store: str, repo_ids=None) -> Graph:
    """The current graph."""
    nodes = current_rows(spark, store, "nodes", repo_ids)
    return Graph(nodes, current_rows(spark, store, "edges", repo_ids).unionByName(repository_edges(nodes)))


def read_degrees(spark: SparkSession, store: str, repo_ids=None) -> DataFrame:
    """Edges of every symbol by kind (repo_id, uid, symbol_type, file_path, relationship_type, degree); no edge is read."""
    return merged_counts(current_rows(spark, store, "degrees", repo_ids))
