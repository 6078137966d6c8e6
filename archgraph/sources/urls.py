"""Repository URL check."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.functions.text import strip

# The one accepted URL form (group 1 owner, group 2 repository).
REPOSITORY_URL = (
    r"^https://github\.com/"
    r"([A-Za-z0-9](?:[A-Za-z0-9-]{0,38}))/"
    r"([A-Za-z0-9_.-]{1,100}?)"
    r"(?:\.git)?/?$"
)


def validate_repo_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Add owner, repo, clone_url and url_error; invalid rows keep only the error."""
    text = F.coalesce(strip(F.col(url)), F.lit(""))
    owner = F.regexp_extract(text, REPOSITORY_URL, 1)
    repo = F.regexp_extract(text, REPOSITORY_URL, 2)
    checked = df.withColumn("_owner", owner).withColumn("_repo", repo).withColumn(
        "url_error",
        F.when(F.col("_owner") == "", F.lit("not a https://github.com/<owner>/<repo> address"))
        .when(F.col("_repo").isin(".", ".."), F.lit("not a repository name")),
    )
    valid = F.col("url_error").isNull()
    return (
        checked.withColumn("owner", F.when(valid, F.col("_owner")))
        .withColumn("repo", F.when(valid, F.col("_repo")))
        .withColumn("clone_url", F.when(valid, F.concat(
            F.lit("https://github.com/"), F.col("_owner"), F.lit("/"), F.col("_repo"), F.lit(".git"))))
        .drop("_owner", "_repo")
    )


def register_repositories(submissions: DataFrame) -> DataFrame:
    """Pending repository rows for the valid submissions (id, url, submitted_at)."""
    return (
        validate_repo_urls(submissions)
        .filter(F.col("url_error").isNull())
        .select(
            "id", F.col("clone_url").alias("url"), "owner", F.col("repo").alias("name"),
            F.lit("pending").alias("status"),
            F.col("submitted_at").alias("created_at"), F.col("submitted_at").alias("updated_at"),
        )
    )
