"""File scan, language profile and size limits."""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archgraph.functions.text import file_name
from archgraph.session import materialize

# Directories never scanned.
IGNORED_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", "dist", "build",
    ".next", ".nuxt", "target", ".idea", ".vscode", "vendor", "site-packages",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "coverage", ".tox", "egg-info",
)

# File suffix to language.
SUFFIX_LANGUAGE = {
    ".py": "python",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".java": "java",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".h": "cpp",
}


def not_ignored(path: Column) -> Column:
    """No component of the repository-relative path is an ignored directory."""
    ignored = F.array(*[F.lit(d) for d in IGNORED_DIRS])
    return ~F.arrays_overlap(F.split(path, "/"), ignored)


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))
    pairs = [F.lit(x) for pair in SUFFIX_LANGUAGE.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), suffix)


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of(F.col("path")))


def suffix_glob(languages) -> str:
    """A file name pattern of all suffixes of the languages, in either case."""
    suffixes = [s for s, language in SUFFIX_LANGUAGE.items() if language in languages]
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*{" + ",".join(either) + "}"


def read_source_files(spark: SparkSession, root: str, languages=None, max_bytes: int | None = None) -> DataFrame:
    """Files under ``<root>/<repo_id>/...`` as repo_id, path, size_bytes, content.

    The content is read from storage only by plans that use the column. With
    ``languages`` only files of their suffixes are listed, so images, archives
    and repository metadata are never opened; files over ``max_bytes`` are left
    out by their listed size, unread. Without either every file is a row, which
    is what profiles and limits count.
    """
    base = root.rstrip("/")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if languages is not None:
        reader = reader.option("pathGlobFilter", suffix_glob(languages))
    raw = reader.load(base)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    layout = f"^.*{re.escape(base)}/([^/]+)/(.+)$"
    return (
        raw.select(
            F.regexp_extract("path", layout, 1).alias("repo_id"),
            F.regexp_extract("path", layout, 2).alias("path"),
            F.col("length").alias("size_bytes"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        )
        .filter((F.col("path") != "") & not_ignored(F.col("path")))
    )


def extractable(files: DataFrame, languages) -> DataFrame:
    """Keep files outside ignored folders whose language has an extractor."""
    return with_language(files).filter(not_ignored(F.col("path")) & F.col("language").isin(*languages))


def profile_repositories(files: DataFrame) -> DataFrame:
    """File count, bytes and files per language of every repository.

    The first aggregate is per language, so the second sees at most one row
    per known language and one for the rest.
    """
    per_language = (
        with_language(files.filter(not_ignored(F.col("path"))))
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    )
    entry = F.when(F.col("language").isNotNull(), F.struct("language", "n"))
    return per_language.groupBy("repo_id").agg(
        F.sum("n").alias("file_count"),
        F.sum("bytes").alias("total_size_bytes"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("languages"),
    )


def apply_limits(profile: DataFrame, max_files: int, max_megabytes: int) -> DataFrame:
    """Add ``reject_reason``; null means accepted. Limits are the caller's, and inclusive."""
    return profile.withColumn(
        "reject_reason",
        F.when(F.col("file_count") > max_files, F.lit(f"more than {max_files} files"))
        .when(F.col("total_size_bytes") > max_megabytes * 1024 * 1024,
              F.lit(f"more than {max_megabytes} MB")),
    )


def accepted_files(files: DataFrame, limited: DataFrame) -> DataFrame:
    """Files of repositories within the limits."""
    # Written, so that adaptive execution can split the files of a large repository.
    accepted = materialize(limited.filter(F.col("reject_reason").isNull()).select("repo_id"), "accepted")
    return files.join(accepted, "repo_id", "left_semi")
