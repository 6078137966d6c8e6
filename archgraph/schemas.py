"""Table schemas and the value sets shared by several modules."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Graph(NamedTuple):
    nodes: DataFrame  # SYMBOLS, one row per uid
    edges: DataFrame  # EDGES


# The declared symbol and relationship kinds.
SYMBOL_TYPES = ("file", "class", "function", "method", "import", "variable")
DEFINITION_TYPES = ("class", "function", "method")
CALLABLE_TYPES = ("function", "method")
SEARCHABLE_TYPES = ("file", "class", "function", "method")
RELATIONSHIP_TYPES = ("contains", "imports", "calls", "inherits")
REPOSITORY_NODE = "repository"

# Repository life cycle, in order.
STATUSES = ("pending", "cloning", "cloned", "parsing", "building_graph", "embedding", "ready", "failed")

SOURCE_FILES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size_bytes", T.LongType()),
    T.StructField("content", T.StringType()),
])

SYMBOLS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("qualified_name", T.StringType()),
    T.StructField("symbol_type", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("decorators", T.ArrayType(T.StringType())),
    T.StructField("docstring", T.StringType()),
])

RELATIONSHIPS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("target_id", T.StringType()),
    T.StructField("target_name", T.StringType()),
    T.StructField("relationship_type", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_line", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
])

PARSE_ERRORS = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("error", T.StringType()),
])

# One row per symbol, relationship or error, as the extraction step emits them.
# version is null unless the files carry one.
IR_ROWS = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("repo_id", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("symbol", T.StructType([
        f for f in SYMBOLS.fields if f.name not in ("repo_id", "uid", "seq", "file_path")])),
    T.StructField("relationship", T.StructType([
        f for f in RELATIONSHIPS.fields if f.name not in ("repo_id", "seq", "source_file")])),
    T.StructField("error", T.StringType()),
    T.StructField("version", T.StringType()),
])

# Edges carry the columns of both ends that graph queries filter or print, so
# those queries scan one table and need no join back to the nodes.
EDGES = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("relationship_type", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_line", T.IntegerType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("src_type", T.StringType()),
    T.StructField("src_name", T.StringType()),
    T.StructField("src_path", T.StringType()),
    T.StructField("src_start", T.IntegerType()),
    T.StructField("dst_type", T.StringType()),
    T.StructField("dst_name", T.StringType()),
    T.StructField("dst_path", T.StringType()),
    T.StructField("dst_start", T.IntegerType()),
])

STATUS_LOG = T.StructType([
    T.StructField("repo_id", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("file_count", T.LongType()),
    T.StructField("symbol_count", T.LongType()),
    T.StructField("relationship_count", T.LongType()),
])

REPOSITORIES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("default_branch", T.StringType()),
    T.StructField("commit_sha", T.StringType()),
    T.StructField("languages", T.MapType(T.StringType(), T.LongType())),
    T.StructField("file_count", T.LongType()),
    T.StructField("symbol_count", T.LongType()),
    T.StructField("relationship_count", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])
