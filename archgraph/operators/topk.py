"""Top k rows per key."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Up to this k Spark prunes every map task to k rows per key before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_k(df: DataFrame, keys, order, k: int, rank="rank", salted=False, spread=64, tasks: int | None = None) -> DataFrame:
    """The first k rows of every key under a total order, numbered in ``rank``.

    Salted, the rows of a key are first cut to k in each of ``spread`` hashed
    parts, so that no task sorts a whole hot key. That is done for a large k,
    and asked for where the rows come from a join by the same key: there is no
    shuffle left then that the pruning could precede. With ``tasks`` both cuts
    of salted rows are dealt out to so many, so no task sorts more than its share.
    """
    keys = list(keys)
    if salted or k > GROUP_LIMIT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
        within = Window.partitionBy(*keys, "_part").orderBy(*order)
        parts = df.withColumn("_part", part)
        if tasks is not None:
            parts = parts.repartition(tasks, *keys, "_part")
        df = (
            parts.withColumn("_place", F.row_number().over(within))
            .filter(F.col("_place") <= k)
            .drop("_part", "_place")
        )
        if tasks is not None:
            df = df.repartition(tasks, *keys)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
