"""The repository table, derived from an append-only status log."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.schemas import REPOSITORIES
from archgraph.session import materialize

# The stages shown to a user, in order.
STAGES = ("cloning", "cloned", "parsing", "building_graph", "embedding", "ready")


def latest_status(status_log: DataFrame) -> DataFrame:
    """One row per repository: first and last time seen, and the last status row."""
    rest = [c for c in status_log.columns if c not in ("repo_id", "ts", "seq")]
    return (
        status_log.groupBy("repo_id")
        .agg(
            F.min("ts").alias("created_at"),
            F.max("ts").alias("updated_at"),
            F.max_by(F.struct(*rest), F.struct("ts", "seq")).alias("last"),
        )
        .select("repo_id", "created_at", "updated_at", "last.*")
    )


def scan_status(limited: DataFrame) -> DataFrame:
    """Status rows of scanned repositories: cloned, or failed with the limit they exceed."""
    rejected = F.col("reject_reason").isNotNull()
    return limited.select(
        "repo_id", F.when(rejected, "failed").otherwise("cloned").alias("status"),
        F.col("reject_reason").alias("error"), "file_count")


def repository_records(registered: DataFrame, latest: DataFrame, profile: DataFrame) -> DataFrame:
    """One full record per registered repository: registration, last status, profile.

    ``registered`` is (id, url, owner, name, created_at) and may carry
    default_branch and commit_sha; all three tables have one row per repository.
    """
    known = registered
    for name in ("default_branch", "commit_sha"):
        if name not in known.columns:
            known = known.withColumn(name, F.lit(None).cast("string"))
    status = latest.select(
        F.col("repo_id").alias("id"), F.col("status").alias("last_status"), "error", "symbol_count",
        "relationship_count", "updated_at")
    scanned = profile.select(F.col("repo_id").alias("id"), "languages", "file_count")
    empty = F.create_map().cast("map<string,bigint>")
    return (
        known.select("id", "url", "owner", "name", "default_branch", "commit_sha", "created_at")
        .join(status, "id", "left").join(scanned, "id", "left")
        .withColumn("status", F.coalesce("last_status", F.lit("pending")))
        .withColumn("updated_at", F.coalesce("updated_at", "created_at"))
        .withColumn("languages", F.coalesce("languages", empty))
        .fillna(0, ["file_count", "symbol_count", "relationship_count"])
        .select(*REPOSITORIES.fieldNames())
    )


def list_repositories(repositories: DataFrame) -> DataFrame:
    """Newest first."""
    return repositories.orderBy(F.col("created_at").desc(), F.col(_key(repositories)))


def get_repository(repositories: DataFrame, repo_id: str) -> DataFrame:
    return repositories.filter(F.col(_key(repositories)) == repo_id)


def _key(repositories: DataFrame) -> str:
    return "id" if "id" in repositories.columns else "repo_id"


def only_ready(df: DataFrame, repositories: DataFrame) -> DataFrame:
    """Rows of repositories that may be analysed."""
    # Written, so that adaptive execution can split the rows of a large repository.
    ready = materialize(repositories.filter(F.col("status") == "ready").select("repo_id"), "ready")
    return df.join(ready, "repo_id", "left_semi")


def readiness(requests: DataFrame, repositories: DataFrame) -> DataFrame:
    """Requests with the outcome 'missing' (404), 'not_ready' (409) or 'ready' (200)."""
    known = repositories.select("repo_id", F.col("status").alias("_status"))
    outcome = (
        F.when(F.col("_status").isNull(), F.lit("missing"))
        .when(F.col("_status") == "ready", F.lit("ready"))
        .otherwise(F.lit("not_ready"))
    )
    code = F.when(outcome == "missing", 404).when(outcome == "ready", 200).otherwise(409)
    return (
        requests.join(known, "repo_id", "left")
        .withColumn("readiness", outcome)
        .withColumn("response_code", code)
        .drop("_status")
    )


def stage_states(repositories: DataFrame) -> DataFrame:
    """Six rows per repository: every stage done, active or pending.

    A status that is not a stage (pending, failed) leaves all stages pending.
    """
    stages = F.array(*[F.lit(s) for s in STAGES])
    current = F.array_position(stages, F.col("status"))
    exploded = repositories.select("repo_id", "status", F.posexplode(stages).alias("position", "stage"))
    place = F.col("position") + 1
    return exploded.select(
        "repo_id", "status", "stage", F.col("position").cast("int").alias("position"),
        F.when(place < current, "done").when(place == current, "active").otherwise("pending").alias("state"),
    )
