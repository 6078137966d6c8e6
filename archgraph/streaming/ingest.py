"""Incremental analysis of arriving source files.

Repositories of which few files arrive are changed: only rows of these files,
and of names and symbols that they concern, are written (see ``changes``). New
repositories, and those of which many files arrive or that were changed often,
are linked as a whole, which makes a new base.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.operators.build import graph_counts
from archgraph.operators.degrees import edge_counts
from archgraph.operators.extract import REMOVED, extract_rows, split_rows
from archgraph.operators.resolve import resolve_relationships
from archgraph.plans.ask import index_rows
from archgraph.plans.graph import link_graph
from archgraph.schemas import REPOSITORY_NODE, SOURCE_FILES
from archgraph.session import materialize, scratch
from archgraph.sources.graph_store import BUCKETS, live_entries, live_rows, repo_bucket, store_buckets, write_rows, write_status
from archgraph.streaming.changes import graph_change

# A repository is changed if at most one in so many of its files arrives, and it has fewer changes than these.
FILES_PER_ARRIVED = 4
CHANGES = 16


def arriving_files(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of source_files rows with the place they came from: time, file, row."""
    return (
        spark.readStream.schema(SOURCE_FILES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        .withColumn("landed", F.struct(F.col("_metadata.file_modification_time").alias("at"),
                                       F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.row_index").alias("row")))
    )


def planned(touched: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """The touched repositories with ``is_base``: whether the batch makes a new base; and their counts so far."""
    known = entries.groupBy("repo_id").agg(
        F.count_if(~F.col("is_base")).alias("changes"),
        F.max_by(F.struct("file_count", "symbol_count", "relationship_count"), "batch_id").alias("so_far"))
    arrived = files.groupBy("repo_id").agg(F.count("*").alias("arrived"))
    few = (F.coalesce("arrived", F.lit(0)) * FILES_PER_ARRIVED <= F.col("so_far.file_count")) & (F.col("changes") < CHANGES)
    return (
        touched.join(arrived, "repo_id", "left").join(known, "repo_id", "left")
        .select("repo_id", "repo_bucket", "so_far", (~F.coalesce(few, F.lit(False))).alias("is_base"))
    )


def ingest_batch(files: DataFrame, batch_id: int, store: str, buckets: int = BUCKETS) -> None:
    """Extract the files of a batch and bring graph and text index of their repositories up to date.

    Of several versions of a file the last one counts. A file with null content
    is removed. Intermediate tables go with the batch.
    """
    spark = files.sparkSession
    buckets = store_buckets(spark, store, buckets)
    version = F.concat_ws(
        "|", F.lpad(F.lit(str(batch_id)), 12, "0"),
        F.lpad(F.unix_micros("landed.at").cast("string"), 20, "0"), F.col("landed.file"),
        F.lpad(F.col("landed.row").cast("string"), 12, "0"))
    arrived = files.withColumn("version", version).drop("landed")
    with scratch(spark, "batch"):
        touched = materialize(
            arrived.select("repo_id").distinct().withColumn("repo_bucket", repo_bucket(F.col("repo_id"), buckets)),
            "touched")
        repos = touched.select("repo_id")
        try:
            write_status(repos, store, batch_id, "parsing")
            rows = materialize(extract_rows(arrived), "arrived")
            last = materialize(rows.groupBy("repo_id", "file_path").agg(F.max("version").alias("version")), "arrived-files")
            rows = materialize(rows.join(last, ["repo_id", "file_path", "version"], "left_semi").filter(F.col("kind") != REMOVED), "arrived-rows")
            write_status(repos, store, batch_id, "building_graph")
            before = materialize(live_entries(spark, store, batch_id).join(repos, "repo_id", "left_semi"), "live-before")
            plan = materialize(planned(touched, before, last), "plan")
            kinds = {r.is_base for r in plan.select("is_base").distinct().collect()}
            parts = [
                part(spark, store, plan.filter(F.col("is_base") == is_base), before, rows, last.drop("version"))
                for is_base, part in ((True, _whole), (False, _changed)) if is_base in kinds
            ]
            _write(parts, store, batch_id, buckets, lambda: write_status(repos, store, batch_id, "embedding"))
            counts = [part["counts"] for part in parts]
            done = counts[0].unionByName(counts[1]) if len(counts) > 1 else counts[0]
            write_status(touched.select("repo_id").join(done, "repo_id", "left").join(plan.select("repo_id", "is_base"), "repo_id"),
                         store, batch_id, "ready")
        except Exception as problem:
            # Leave a record, then fail the batch: the stream repeats it on restart.
            write_status(repos.withColumn("error", F.lit(f"graph build failed: {problem}")), store, batch_id, "failed")
            raise


def _write(parts, store, batch_id, buckets, before_index):
    """One write per table, as a batch's second write of a folder would replace its first."""
    for name in ("ir", "nodes", "edges", "degrees", "file_keys", "node_keys", "edge_keys", "documents", "term_counts"):
        if name == "documents":
            before_index()
        tables = [part[name] for part in parts if name in part]
        if tables:
            write_rows(tables[0].unionByName(tables[1]) if len(tables) > 1 else tables[0], store, name, batch_id, buckets)


def _state(spark, store, name, repos, before):
    """Rows of the repositories before the batch; their buckets, at most as many as there are, prune the folders."""
    folders = [r.repo_bucket for r in repos.select("repo_bucket").distinct().collect()]
    entries = before.join(repos.select("repo_id"), "repo_id", "left_semi")
    return live_rows(spark, store, name, entries, folders).drop("batch_id", "repo_bucket")


def _whole(spark, store, repos, before, rows, files):
    """All rows of repositories that get a new base: of the files that arrived, and of all others as they were."""
    own = rows.join(repos.select("repo_id"), "repo_id", "left_semi")
    kept = _state(spark, store, "ir", repos, before).join(files, ["repo_id", "file_path"], "left_anti")
    ir = materialize(own.select(*kept.columns).unionByName(kept), "base-rows")
    extracted = split_rows(ir)
    resolved = materialize(resolve_relationships(extracted.symbols, extracted.relationships), "resolved")
    graph = link_graph(extracted.symbols, resolved)
    documents, term_counts = index_rows(extracted.symbols)
    n_files = extracted.symbols.filter(F.col("symbol_type") == "file").groupBy("repo_id").agg(F.count("*").alias("file_count"))
    counts = graph_counts(extracted.symbols, resolved).join(n_files, "repo_id", "left")
    return {
        "ir": ir, "nodes": graph.nodes, "edges": graph.edges.filter(F.col("src_type") != REPOSITORY_NODE), "documents": documents,
        "term_counts": term_counts, "counts": counts.select("repo_id", "file_count", "symbol_count", "relationship_count"),
        "degrees": edge_counts(graph.edges),
    }


def _changed(spark, store, repos, before, rows, files):
    """What differs in repositories of which few files arrived."""
    own = rows.join(repos.select("repo_id"), "repo_id", "left_semi")
    keys = files.join(repos.select("repo_id"), "repo_id", "left_semi")
    ir, nodes, edges = (_state(spark, store, name, repos, before) for name in ("ir", "nodes", "edges"))
    change = graph_change(ir, nodes, edges, own, keys)
    documents, term_counts = index_rows(split_rows(own).symbols)
    difference = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("file_count", "symbol_count", "relationship_count")}
    counts = repos.select("repo_id", "so_far").join(change.counts, "repo_id", "left").select(
        "repo_id", *[(F.coalesce(F.col(f"so_far.{n}"), F.lit(0)) + d).alias(n) for n, d in difference.items()])
    return {
        "ir": own.select(*ir.columns), "file_keys": keys, "nodes": change.nodes, "node_keys": change.node_keys, "edges": change.edges,
        "edge_keys": change.edge_keys, "documents": documents, "term_counts": term_counts, "counts": counts, "degrees": change.degrees,
    }


def stream_ingest(spark: SparkSession, source: str, store: str, checkpoint: str, buckets: int = BUCKETS,
                  files_per_batch: int = 1000, **trigger):
    """Start the stream; ``trigger`` is passed on (default: all there is now, then stop)."""

    def handle(batch, batch_id):
        ingest_batch(batch, batch_id, store, buckets)

    return (
        arriving_files(spark, source, files_per_batch).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
