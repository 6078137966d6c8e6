"""Bounds: broadcasts behind a count of the rows, and the size of Arrow batches."""

from contextlib import contextmanager

from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000  # of a few numbers each: at most some 30 MB


_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
ARROW_BYTES = 4 << 20


def bounded_batches(spark):
    """Batches of at most 4 MB of whole texts in Arrow tasks, unless the session sets its own bound.

    A task holds a batch, its result, and the next batch, on both sides.
    """
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(ARROW_BYTES))


@contextmanager
def scoped_batches(spark):
    """The same bound for the jobs run inside the block; the session keeps its own setting afterwards."""
    before = spark.conf.get(_BATCH_SETTING)
    bounded_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def broadcast_if_small(written, rows=None):
    """A written table of narrow rows, sent to all tasks if it has few rows; else left to a shuffle join."""
    most = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(written) if written.count() <= most else written
