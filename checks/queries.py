"""Registered queries: every operator over the whole given or derived tables."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions import classify
from archgraph.operators import build, components, degrees, dense_index, extract, reach, resolve, symbol_search, tfidf, views
from archgraph.plans import ask, graph, impact, smells
from archgraph.schemas import RELATIONSHIPS, SOURCE_FILES, SYMBOLS, Graph
from archgraph.session import bounded_tasks, materialize, new_folder
from archgraph.sources import files, graph_store, repositories, tree, urls
from archgraph.streaming.ingest import stream_ingest
from checks.derived import derived, given

QUERIES = {}

_written = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def once(function):
    """Build a written table set once per application and input folder.

    This is how the engine is meant to be used: a graph is built and stored,
    and then asked many times.
    """

    @wraps(function)
    def cached(spark: SparkSession, sf_dir: str):
        key = (function.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _written:
            _written[key] = function(spark, sf_dir)
        return _written[key]

    return cached


# Shared inputs ------------------------------------------------------------

def symbols_of(spark, sf_dir) -> DataFrame:
    decorators = F.when(F.col("decorator") == "", F.array().cast("array<string>")).otherwise(F.array("decorator"))
    return (
        derived(spark, sf_dir, "fx_symbols")
        .withColumn("uid", F.concat("repo_id", F.lit(":"), "id"))
        .withColumn("language", F.lit("python")).withColumn("decorators", decorators)
        .select(*SYMBOLS.fieldNames())
    )


def relationships_of(spark, sf_dir) -> DataFrame:
    return derived(spark, sf_dir, "fx_relationships").select(*RELATIONSHIPS.fieldNames())


@once
def extracted(spark, sf_dir):
    """Symbols and relationships as written tables."""
    symbols = materialize(symbols_of(spark, sf_dir), "symbols")
    with bounded_tasks(spark, given(spark, sf_dir, "lineitem").count(), graph.EDGES_PER_TASK):
        return symbols, materialize(relationships_of(spark, sf_dir), "relationships")


@once
def graph_nodes(spark, sf_dir) -> DataFrame:
    """The nodes alone, for what makes the edges itself."""
    return graph.written_nodes(extracted(spark, sf_dir)[0])


@once
def code_graph(spark, sf_dir) -> Graph:
    symbols, relationships = extracted(spark, sf_dir)
    resolved = resolve.resolve_relationships(symbols, relationships)
    return graph.link_nodes(graph_nodes(spark, sf_dir), resolved, relationships.count())


@once
def symbol_name_index(spark, sf_dir) -> symbol_search.SymbolIndex:
    return symbol_search.symbol_index(code_graph(spark, sf_dir).nodes)


@once
def document_index(spark, sf_dir) -> tfidf.TfidfIndex:
    return tfidf.fit_tfidf(derived(spark, sf_dir, "fx_docs"))


@once
def symbol_index(spark, sf_dir) -> ask.RepositoryIndex:
    return ask.index_symbols(extracted(spark, sf_dir)[0])


@once
def answers(spark, sf_dir) -> ask.Answers:
    return ask.answer_context(derived(spark, sf_dir, "fx_symbol_questions"), symbol_index(spark, sf_dir),
                              code_graph(spark, sf_dir))


@once
def suggested_targets(spark, sf_dir) -> DataFrame:
    """The suggested symbols of every repository, and one unknown symbol each."""
    nodes, edges = code_graph(spark, sf_dir)
    best = degrees.suggest_symbols(nodes, edges).select("repo_id", "uid")
    unknown = nodes.select("repo_id", F.concat("repo_id", F.lit(":no.such.symbol")).alias("uid")).distinct()
    return materialize(best.unionByName(unknown), "targets")


@once
def impact_reports(spark, sf_dir) -> impact.ImpactReport:
    return impact.impact_report(code_graph(spark, sf_dir), suggested_targets(spark, sf_dir))


@once
def smell_tables(spark, sf_dir) -> smells.SmellReport:
    return smells.detect_smells(code_graph(spark, sf_dir))


@once
def landed_files(spark, sf_dir) -> str:
    """The source files as a folder of Parquet files, for the batch job and the stream."""
    folder = new_folder(spark, "landing")
    derived(spark, sf_dir, "fx_source_files").repartition(8, "path").write.parquet(folder)
    return folder


def source_files(spark, sf_dir) -> DataFrame:
    return spark.read.schema(SOURCE_FILES).parquet(landed_files(spark, sf_dir))


@once
def parsed(spark, sf_dir) -> extract.ExtractedTables:
    return extract.extract_ir(source_files(spark, sf_dir))


# Sources ------------------------------------------------------------------

@query
def language_of_file(spark, sf_dir):
    return files.with_language(derived(spark, sf_dir, "fx_repo_files")).select("repo_id", "path", "language")


@query
def repo_profile(spark, sf_dir):
    profile = files.profile_repositories(derived(spark, sf_dir, "fx_repo_files"))
    counted = F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return profile.select("repo_id", "file_count", "total_size_bytes", F.array_join(counted, ",").alias("languages"))


@query
def repo_limits(spark, sf_dir):
    listed = derived(spark, sf_dir, "fx_repo_files")
    limited = files.apply_limits(files.profile_repositories(listed), max_files=500, max_megabytes=75)
    return limited.select("repo_id", "file_count", "total_size_bytes", "reject_reason")


@query
def scan_status(spark, sf_dir):
    listed = derived(spark, sf_dir, "fx_repo_files")
    return repositories.scan_status(
        files.apply_limits(files.profile_repositories(listed), max_files=500, max_megabytes=75))


@query
def accepted_files(spark, sf_dir):
    listed = derived(spark, sf_dir, "fx_repo_files")
    limited = files.apply_limits(files.profile_repositories(listed), max_files=500, max_megabytes=75)
    return files.accepted_files(listed, limited).select("repo_id", "path", "size_bytes")


@once
def source_tree(spark, sf_dir) -> str:
    """The source files as a folder of repositories, written by the tasks that hold them."""
    folder = new_folder(spark, "source-tree")

    def write(rows):
        system, base = tree.open_root(folder)
        for row in rows:
            path = f"{base}/{row.repo_id}/{row.path}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as stream:
                stream.write(row.content.encode())

    derived(spark, sf_dir, "fx_source_files").repartition(8, "path").foreachPartition(write)
    return folder


@query
def scan_source_tree(spark, sf_dir):
    """All files of a folder of repositories, without those in ignored folders."""
    scanned = tree.read_source_tree(spark, source_tree(spark, sf_dir), languages=["python"])
    return scanned.select("repo_id", "path", "size_bytes", F.md5("content").alias("content_md5"))


@query
def validate_repo_urls(spark, sf_dir):
    return urls.validate_repo_urls(derived(spark, sf_dir, "fx_repo_urls")).select(
        "id", "owner", "repo", "clone_url", "url_error")


@query
def register_repositories(spark, sf_dir):
    submitted = derived(spark, sf_dir, "fx_repo_urls").withColumn("submitted_at", F.current_timestamp())
    return urls.register_repositories(submitted).drop("created_at", "updated_at")


@query
def latest_status(spark, sf_dir):
    return repositories.latest_status(derived(spark, sf_dir, "fx_status_log")).select(
        "repo_id", "status", "error", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("updated_us"))


@query
def list_repositories(spark, sf_dir):
    latest = repositories.latest_status(derived(spark, sf_dir, "fx_status_log"))
    return repositories.list_repositories(latest).select("repo_id", "status")


@query
def get_repository(spark, sf_dir):
    """The one repository asked for by id."""
    latest = repositories.latest_status(derived(spark, sf_dir, "fx_status_log"))
    return repositories.get_repository(latest, "7").select("repo_id", "status", "error")


@query
def ready_only(spark, sf_dir):
    log = derived(spark, sf_dir, "fx_status_log")
    return repositories.only_ready(log, repositories.latest_status(log)).select("repo_id", "seq", "status")


@query
def readiness(spark, sf_dir):
    """Every customer asks; only those with events are known repositories."""
    asked = given(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo_id"))
    latest = repositories.latest_status(derived(spark, sf_dir, "fx_status_log"))
    return repositories.readiness(asked, latest)


@query
def stage_states(spark, sf_dir):
    return repositories.stage_states(repositories.latest_status(derived(spark, sf_dir, "fx_status_log")))


# Extraction ---------------------------------------------------------------

@query
def extract_symbols(spark, sf_dir):
    return parsed(spark, sf_dir).symbols.select(
        "repo_id", "uid", "seq", "name", "qualified_name", "symbol_type", "file_path", "start_line", "end_line",
        F.array_join("decorators", " ").alias("decorators"), "docstring")


@query
def extract_relationships(spark, sf_dir):
    return parsed(spark, sf_dir).relationships


@query
def parse_summary(spark, sf_dir):
    return extract.parse_summary(source_files(spark, sf_dir), parsed(spark, sf_dir).parse_errors)


def first_line(path, content):
    """An extractor for another language: the file, and its first line as a symbol."""
    yield "symbol", {"id": path, "name": path.rsplit("/", 1)[-1], "qualified_name": path, "symbol_type": "file",
                     "start_line": 1, "end_line": 1, "language": "javascript", "decorators": [], "docstring": None}
    yield "symbol", {"id": f"{path}.first", "name": "first", "qualified_name": content, "symbol_type": "function",
                     "start_line": 1, "end_line": 1, "language": "javascript", "decorators": [], "docstring": None}


@query
def extract_with_registered_extractor(spark, sf_dir):
    """Files of another language, extracted by an extractor that the caller registers."""
    listed = derived(spark, sf_dir, "fx_repo_files").withColumn("content", F.concat(F.lit("in "), "path"))
    symbols = extract.extract_ir(listed, {"javascript": first_line}).symbols
    return symbols.select("repo_id", "uid", "seq", "name", "qualified_name", "symbol_type", "language")


@query
def extract_broken_blocks(spark, sf_dir):
    """One file per part with a fault inside of an if, try, with, for, while or match."""
    symbols = extract.extract_ir(derived(spark, sf_dir, "fx_broken_files")).symbols
    return symbols.select("repo_id", "qualified_name", "symbol_type", "start_line")


# Resolution and construction ----------------------------------------------

@query
def resolve_relationships(spark, sf_dir):
    return resolve.resolve_relationships(*extracted(spark, sf_dir)).drop("seq")


@query
def build_nodes(spark, sf_dir):
    return build.build_nodes(extracted(spark, sf_dir)[0]).drop("decorators", "language")


@query
def build_edges(spark, sf_dir):
    symbols, relationships = extracted(spark, sf_dir)
    return build.build_edges(graph_nodes(spark, sf_dir), resolve.resolve_relationships(symbols, relationships))


@query
def graph_counts(spark, sf_dir):
    symbols, relationships = extracted(spark, sf_dir)
    return build.graph_counts(symbols, resolve.resolve_relationships(symbols, relationships))


@query
def unique_violations(spark, sf_dir):
    return build.unique_violations(extracted(spark, sf_dir)[0], ["uid"])


# Graph queries ------------------------------------------------------------

@query
def degree_all_types(spark, sf_dir):
    return degrees.degrees(code_graph(spark, sf_dir).edges)


@query
def degree_calls_inherits(spark, sf_dir):
    return degrees.degrees(code_graph(spark, sf_dir).edges, ("CALLS", "INHERITS"))


@query
def suggest_symbols(spark, sf_dir):
    return degrees.suggest_symbols(*code_graph(spark, sf_dir))


@query
def search_symbols(spark, sf_dir):
    found = symbol_search.search_symbols(
        code_graph(spark, sf_dir).nodes, derived(spark, sf_dir, "fx_symbol_queries"), index=symbol_name_index(spark, sf_dir))
    return found.select("query_id", "rank", "uid", "symbol_type", "qualified_name")


@query
def search_short_queries(spark, sf_dir):
    """Queries of one and two letters: the beginnings of the words that are asked for."""
    words = derived(spark, sf_dir, "fx_symbol_queries").filter(F.trim("query") != "")
    parts = words.select("repo_id", F.explode(F.array(F.substring(F.trim("query"), 1, 1), F.substring(F.trim("query"), 2, 2))).alias("query")).distinct()
    asked = parts.withColumn("query_id", F.concat("repo_id", F.lit("/"), "query"))
    found = symbol_search.search_symbols(code_graph(spark, sf_dir).nodes, asked, index=symbol_name_index(spark, sf_dir))
    return found.select("query_id", "rank", "uid", "symbol_type", "qualified_name")


@query
def file_view_nodes(spark, sf_dir):
    return views.file_view(*code_graph(spark, sf_dir)).nodes


@query
def file_view_edges(spark, sf_dir):
    return views.file_view(*code_graph(spark, sf_dir)).edges


@query
def file_view_truncated(spark, sf_dir):
    return views.file_view(*code_graph(spark, sf_dir), limit=20).truncated


@query
def class_view_nodes(spark, sf_dir):
    return views.class_view(*code_graph(spark, sf_dir)).nodes


@query
def class_view_edges(spark, sf_dir):
    return views.class_view(*code_graph(spark, sf_dir)).edges


@query
def class_view_truncated(spark, sf_dir):
    return views.class_view(*code_graph(spark, sf_dir), limit=85).truncated


@query
def neighbourhood(spark, sf_dir):
    nodes, edges = code_graph(spark, sf_dir)
    return degrees.neighbourhood(edges, nodes)


# Impact -------------------------------------------------------------------

@query
def dependents(spark, sf_dir):
    return reach.dependents(code_graph(spark, sf_dir).edges, suggested_targets(spark, sf_dir))


@query
def impact_summary(spark, sf_dir):
    return impact_reports(spark, sf_dir).summary.select(
        "repo_id", "target_uid", "found", "target_qualified_name", "target_symbol_type", "target_file_path", "degree",
        "direct_count", "indirect_count", "affected_apis", "affected_services", "affected_tests", "external_count",
        F.array_join("external_names", ",").alias("external_names"), "risk_score", "risk_level", "explanation")


@query
def risk_signals(spark, sf_dir):
    return impact_reports(spark, sf_dir).summary.select(
        "target_uid", F.explode("risk_signals").alias("signal")).select("target_uid", "signal.*")


@query
def impact_dependents(spark, sf_dir):
    return impact_reports(spark, sf_dir).dependents.select(
        "target_uid", "uid", "depth", "symbol_type", "qualified_name", "file_path", "start_line", "is_api",
        "is_service", "is_test")


@query
def external_dependencies(spark, sf_dir):
    return impact_reports(spark, sf_dir).external_dependencies


@query
def dependents_preview(spark, sf_dir):
    preview = impact.dependents_preview(impact_reports(spark, sf_dir).dependents)
    names = F.transform("dependents", lambda d: d["qualified_name"])
    return preview.select("target_uid", "total", "more", F.array_join(names, ",").alias("dependents"))


@query
def classify_imports(spark, sf_dir):
    names = derived(spark, sf_dir, "fx_imports").select("dotted").distinct()
    return names.withColumn("category", classify.classify_import(F.col("dotted")))


# Smells -------------------------------------------------------------------

_FINDING = ["repo_id", "smell_type", "severity", "subject", "metric", "title", "evidence"]


@query
def god_classes(spark, sf_dir):
    return smells.god_classes(code_graph(spark, sf_dir)).findings.select(*_FINDING)


@query
def large_functions(spark, sf_dir):
    return smells.large_functions(code_graph(spark, sf_dir)).findings.select(*_FINDING)


@query
def dead_code(spark, sf_dir):
    return smells.dead_code_candidates(code_graph(spark, sf_dir)).findings.select(*_FINDING)


@query
def strongly_connected_components(spark, sf_dir):
    calls = code_graph(spark, sf_dir).edges.filter(F.col("relationship_type") == "CALLS")
    return components.strongly_connected_components(calls)


@query
def strongly_connected_components_by_rounds(spark, sf_dir):
    """The same with the largest repositories solved by rounds over tables."""
    calls = code_graph(spark, sf_dir).edges.filter(F.col("relationship_type") == "CALLS")
    return components.strongly_connected_components(calls, local_bytes=180_000)


@query
def circular_dependencies(spark, sf_dir):
    return smells.circular_dependencies(code_graph(spark, sf_dir)).findings.select(*_FINDING)


@query
def smell_report(spark, sf_dir):
    return smells.ordered_findings(smell_tables(spark, sf_dir).findings).select(*_FINDING)


@query
def smell_affected(spark, sf_dir):
    return smell_tables(spark, sf_dir).affected


@query
def top_findings(spark, sf_dir):
    return smells.top_findings(smell_tables(spark, sf_dir).findings).select(*_FINDING)


@query
def hidden_findings(spark, sf_dir):
    return smells.hidden_findings(smell_tables(spark, sf_dir).findings, repositories=code_graph(spark, sf_dir).nodes)


@query
def affected_preview(spark, sf_dir):
    preview = smells.affected_preview(smell_tables(spark, sf_dir).affected)
    names = F.transform("symbols", lambda s: s["qualified_name"])
    return preview.select("smell_type", "subject", "total", "more", F.array_join(names, ",").alias("symbols"))


# Retrieval ----------------------------------------------------------------

def rounded(hits):
    """Scores as they are compared with the SQL; ranks are those of the whole values."""
    return hits.withColumn("score", F.round("score", 6))


@query
def search_documents(spark, sf_dir):
    return tfidf.search_documents(extracted(spark, sf_dir)[0]).select("repo_id", "doc_id", "symbol_uid", "text")


@query
def tfidf_top_terms(spark, sf_dir):
    return document_index(spark, sf_dir).vocabulary.withColumn("idf", F.round("idf", 6))


@query
def search_topk(spark, sf_dir):
    return rounded(tfidf.search(derived(spark, sf_dir, "fx_questions"), document_index(spark, sf_dir)))


@query
def search_topk_padded(spark, sf_dir):
    hits = tfidf.search(derived(spark, sf_dir, "fx_symbol_questions"), symbol_index(spark, sf_dir).terms, pad=True)
    return rounded(hits)


def _label_questions(spark, sf_dir):
    """The mean vector of every label asks among all vectors."""
    rows = given(spark, sf_dir, "embeddings")
    means = (
        rows.select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))),
                                          lambda p: p["mean"]).alias("embedding"))
    )
    queries = means.select(F.col("label").alias("query_id"), F.lit("all").alias("repo_id"), "embedding")
    return queries, rows.select(F.lit("all").alias("repo_id"), "vec_id", "embedding")


@query
def search_dense_topk(spark, sf_dir):
    return rounded(tfidf.search_dense(*_label_questions(spark, sf_dir)))


@query
def search_dense_index_topk(spark, sf_dir):
    """The same rows by way of pivots and rings."""
    queries, vectors = _label_questions(spark, sf_dir)
    return rounded(dense_index.search_dense_index(queries, dense_index.build_dense_index(vectors)))


@query
def evidence(spark, sf_dir):
    found = answers(spark, sf_dir).evidence
    return found.select("query_id", "rank", "symbol_uid", F.round("score", 6).alias("relevance"),
                        F.size("related").cast("long").alias("related"))


@query
def evidence_confidence(spark, sf_dir):
    return answers(spark, sf_dir).confidence.withColumn("confidence_score", F.round("confidence_score", 9))


@query
def evidence_text(spark, sf_dir):
    return answers(spark, sf_dir).prompts.select("query_id", "evidence_block")


@query
def prompts(spark, sf_dir):
    return answers(spark, sf_dir).prompts.select("query_id", F.explode("messages").alias("m")).select("query_id", "m.*")


# Streaming ----------------------------------------------------------------

@once
def streamed_store(spark, sf_dir) -> str:
    """All source files arrive as a stream of several batches; the folder of the store."""
    folder = new_folder(spark, "stream")
    stream_ingest(spark, landed_files(spark, sf_dir), f"{folder}/store", f"{folder}/progress", buckets=4,
                  files_per_batch=4).awaitTermination()
    return f"{folder}/store"


@query
def stream_ingest_graph(spark, sf_dir):
    return _kinds(*graph_store.read_graph(spark, streamed_store(spark, sf_dir)))


@query
def stream_ingest_status(spark, sf_dir):
    log = graph_store.read_status(spark, streamed_store(spark, sf_dir))
    return repositories.latest_status(log).select("repo_id", "status", "file_count", "symbol_count",
                                                  "relationship_count")


@query
def stream_ingest_index(spark, sf_dir):
    """The text index that the stream keeps beside the graph."""
    vocabulary = ask.read_index(spark, streamed_store(spark, sf_dir)).terms.vocabulary
    return vocabulary.select("repo_id", "term", "df", "total", F.round("idf", 6).alias("idf"))


@query
def stream_degrees(spark, sf_dir):
    """Ends of edges by kind, from the counts that the stream keeps."""
    counts = graph_store.read_degrees(spark, streamed_store(spark, sf_dir))
    return counts.groupBy("repo_id", "relationship_type").agg(F.sum("degree").alias("ends"))


@query
def stream_removed_files(spark, sf_dir):
    """All source files arrive, then the broken ones are removed; symbols and edges that are left."""
    folder = new_folder(spark, "stream")
    arrived = source_files(spark, sf_dir)
    arrived.write.parquet(f"{folder}/landing")
    gone = arrived.filter(F.contains("content", F.lit("= ="))).withColumn("content", F.lit(None).cast("string"))

    def run():
        stream_ingest(spark, f"{folder}/landing", f"{folder}/store", f"{folder}/progress", buckets=4).awaitTermination()

    run()
    gone.select(*SOURCE_FILES.fieldNames()).write.mode("append").parquet(f"{folder}/landing")
    run()
    return _kinds(*graph_store.read_graph(spark, f"{folder}/store"))


def _kinds(nodes, edges):
    counted = nodes.select("repo_id", F.col("symbol_type").alias("kind")).unionByName(
        edges.select("repo_id", F.col("relationship_type").alias("kind")))
    return counted.groupBy("repo_id", "kind").agg(F.count("*").alias("n"))


@query
def stored_repositories(spark, sf_dir):
    """Repository records as the store keeps them, with branch and commit."""
    folder = new_folder(spark, "records")
    graph_store.write_repositories(_records(spark, sf_dir), folder)
    return graph_store.read_repositories(spark, folder).select(
        "id", "url", "owner", "name", "status", "default_branch", "commit_sha", "file_count", "symbol_count")


@query
def repository_records(spark, sf_dir):
    """Registered repositories with the last status of the stream and the profile of their files."""
    counted = F.transform(F.map_entries("languages"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return _records(spark, sf_dir).select(
        "id", "url", "owner", "name", "status", "file_count", "symbol_count", "relationship_count", "error",
        F.array_join(counted, ",").alias("languages"))


def _records(spark, sf_dir):
    registered = urls.register_repositories(
        derived(spark, sf_dir, "fx_members").select("repo_id").distinct().select(
            F.col("repo_id").alias("id"), F.concat(F.lit("https://github.com/org/"), "repo_id").alias("url"),
            F.current_timestamp().alias("submitted_at"))
    ).withColumn("default_branch", F.lit("main")).withColumn("commit_sha", F.md5("id"))
    latest = repositories.latest_status(graph_store.read_status(spark, streamed_store(spark, sf_dir)))
    profile = files.profile_repositories(derived(spark, sf_dir, "fx_repo_files"))
    return repositories.repository_records(registered, latest, profile)
