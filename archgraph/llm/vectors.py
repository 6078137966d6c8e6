"""Vectors of an embeddings table: which can be compared, exact copies, bounded samples, centroids."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from archgraph.session import materialize

SAMPLE = 20_000
ROUNDS = 8


def comparable(vector):
    """True for vectors without null or non-finite components that are not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_classes(vectors, id_column, vector):
    """One row per distinct comparable vector: ``node``, ``vector``, ``copies``, ``least_id``."""
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector}`").alias("vector")).where(comparable(F.col("vector")))
    classes = rows.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"))
    return materialize(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")


def matrix(column, width):
    """An Arrow list column as doubles; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values).astype(np.float64)[ends[0] : ends[-1]] if len(column) else np.zeros(0)
    lengths = np.diff(ends)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], lengths)] = values
    return out


def unit(vectors):
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def sample(classes, width, most=SAMPLE):
    """At most ``most`` distinct vectors, the same at every run."""
    drawn = classes.orderBy(F.xxhash64("vector"), "vector").limit(most).select("vector").toArrow()
    return matrix(drawn.column("vector"), width)


def centroids(points, number, spherical, seed=11, rounds=ROUNDS):
    """k-means centroids; spherical ones are unit vectors of the largest cosine."""
    draw = np.random.default_rng(seed)
    number = max(1, min(number, len(points)))
    found = points[draw.choice(len(points), number, replace=False)].copy() if len(points) else np.zeros((1, points.shape[1]))
    for _ in range(rounds if len(points) else 0):
        nearest = (points @ found.T - (0 if spherical else 0.5 * (found**2).sum(axis=1))).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=number)
        size = np.linalg.norm(sums, axis=1) if spherical else counts
        moved = size > 1e-12
        found[moved] = sums[moved] / size[moved, None]
    return found


def widest(classes):
    return int(classes.agg(F.max(F.size("vector"))).first()[0] or 1)
