"""Session settings, the shared folder that intermediate tables go to, and the code that workers need."""

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name="archgraph", cores="*", shuffle_partitions=8, memory="8g"):
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Every executor must reach it, so only a local master may fall back to a
    temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="archgraph-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


_open_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession, label: str):
    """Intermediate tables written inside the block go when it ends.

    What is needed later is written elsewhere by then, or with
    ``materialize(..., outside=True)``.
    """
    folder = new_folder(spark, label)
    scopes = _open_scopes.__dict__.setdefault("folders", [])
    scopes.append(folder)
    try:
        yield folder
    finally:
        scopes.pop()
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, label: str, outside: bool = False) -> str:
    """A name not used before, in the innermost open scratch scope, or in the one around it."""
    scopes = _open_scopes.__dict__.get("folders", [])
    inner = scopes[: len(scopes) - 1] if outside else scopes
    return f"{inner[-1] if inner else shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_shipped = set()


def ship_code(spark: SparkSession, *packages: str) -> None:
    """Send packages to the workers, once per application, so that jobs run from any folder."""
    key = (spark.sparkContext.applicationId, packages)
    if key in _shipped:
        return
    _shipped.add(key)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    local = tempfile.mkdtemp(prefix="archgraph-code-")  # the driver's own; Spark serves the archive to the workers
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    for package in packages:
        shutil.copytree(os.path.join(root, package), os.path.join(local, "code", package), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(local, "archgraph-code"), "zip", os.path.join(local, "code")))


# Bytes of shuffled rows that a task reads; sorted in memory, rows of long repeated names take many times that.
TASK_BYTES = 4 << 20


@contextmanager
def settings(spark: SparkSession, values: dict):
    """Settings for the jobs run inside the block; the session has its own again afterwards."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int, rows_per_task: int):
    """Shuffles of the jobs run inside the block are dealt to enough tasks for so many rows.

    Adaptive execution still joins small parts, up to a few MB, and splits hot
    keys, which a fixed number of partitions would prevent. Settings that
    ask for smaller tasks stay.
    """
    count, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    read = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    with settings(spark, {count: max(int(spark.conf.get(count)), -(-rows // rows_per_task)),
                          size: min(read(spark.conf.get(size)), TASK_BYTES)}):
        yield


def materialize(df: DataFrame, label: str, outside: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage of iterative operators, survives the loss of
    executors, and gives the planner the true size of the table: a side is
    then broadcast only when its files are below the broadcast threshold.
    """
    spark = df.sparkSession
    folder = new_folder(spark, label, outside)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
