"""Exact dense search that leaves out vectors which cannot be among the best.

Every vector lies in the cell of its nearest pivot, and in a ring of that cell
by its angle to the pivot. By the triangle inequality of angles a query at
angle a to the pivot has a cosine of at most cos(|a - b|) with a vector at angle
b, so a ring has a bound for every query. The rings of highest bounds are scored
first; rings whose bound is below the k-th score found there are never scored.
(Pivots and rings: Chávez, Navarro, Baeza-Yates, Marroquín, "Searching in metric
spaces", ACM Computing Surveys 2001.)

How much is left out depends on the vectors: nearly all of other clusters where
there are clusters, nothing where vectors of many dimensions are uniform.
"""

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archgraph.operators.tfidf import TOP_K, best_of_product, comparable, unit_rows
from archgraph.operators.topk import top_k
from archgraph.session import materialize

# Width of a ring in radians.
RING = 0.05
# The angle of two vectors is known to some 3e-8 near 0; bounds are raised by more.
SLACK = 1e-6
# The first rings of a query hold at least so many vectors per hit asked for.
FIRST_ROWS = 8

_PART = ["repo_id", "dims"]
_CELL = [*_PART, "pivot"]
_RING = [*_CELL, "ring"]


class DenseIndex(NamedTuple):
    vectors: DataFrame  # repo_id, dims, pivot, ring, vec_id, embedding
    rings: DataFrame  # repo_id, dims, pivot, ring, nearest, farthest (angles), rows
    pivots: DataFrame  # repo_id, dims, pivot, embedding


def build_dense_index(vectors: DataFrame, rows_per_block: int = 20_000) -> DenseIndex:
    """Index of ``vectors`` (repo_id, vec_id, embedding), for each repository and number of dimensions.

    About as many pivots as the square root of the number of vectors are taken,
    by the hash of their components, so equal vectors give one pivot. Vectors
    that ``search_dense`` leaves out are left out. Zero vectors are in ring -1
    of cell 0; their cosine is 0 with all. Repeated ids stay.
    """
    rows = comparable(vectors.select("repo_id", "vec_id", "embedding"))
    nonzero = F.exists("embedding", lambda x: x != 0)
    counts = materialize(
        rows.groupBy(*_PART).agg(
            F.count("*").alias("n"), F.ceil(F.count("*") / rows_per_block).cast("int").alias("chunks"),
            F.min(F.when(nonzero, F.xxhash64("embedding"))).alias("least")),
        "dense-counts")
    key = F.xxhash64("embedding")
    taken = (F.pmod(key, F.col("n")) < F.ceil(F.sqrt("n"))) | (key == F.col("least"))
    pivots = materialize(
        rows.join(counts, _PART).filter(nonzero & taken)
        .groupBy(*_PART, key.alias("pivot")).agg(F.first("embedding").alias("embedding")),
        "dense-pivots")

    dealt = rows.join(counts.select(*_PART, "chunks"), _PART).withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).drop("chunks")
    everywhere = pivots.join(counts.select(*_PART, "chunks"), _PART).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    types = dict(rows.dtypes)

    def nearest_pivot(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        found = own[["repo_id", "dims", "vec_id", "embedding"]].copy()
        matrix = unit_rows(own["embedding"]) if len(own) else np.zeros((0, 1))
        pivot, ring, angle = np.zeros(len(own), np.int64), np.full(len(own), -1, np.int32), np.full(len(own), np.pi / 2)
        rows_there = np.flatnonzero(matrix.any(axis=1))
        if len(rows_there) and len(around):
            cosines = matrix[rows_there] @ unit_rows(around["embedding"]).T
            place = cosines.argmax(axis=1)
            pivot[rows_there] = around["pivot"].to_numpy()[place]
            angle[rows_there] = np.arccos(np.clip(cosines[np.arange(len(place)), place], -1, 1))
            ring[rows_there] = angle[rows_there] // RING
        found["pivot"], found["ring"], found["angle"] = pivot, ring, angle
        return found

    chunk = [*_PART, "chunk"]
    assigned = materialize(
        dealt.groupBy(*chunk).cogroup(everywhere.groupBy(*chunk)).applyInPandas(
            nearest_pivot,
            f"repo_id string, dims int, vec_id {types['vec_id']}, embedding {types['embedding']}, pivot long, ring int, angle double"),
        "dense-assigned")
    rings = materialize(
        assigned.groupBy(*_RING).agg(F.min("angle").alias("nearest"), F.max("angle").alias("farthest"), F.count("*").alias("rows")),
        "dense-rings")
    return DenseIndex(assigned.drop("angle"), rings, pivots)


def search_dense_index(queries: DataFrame, index: DenseIndex, k: int = TOP_K, rows_per_block: int = 20_000,
                       queries_per_block: int = 500) -> DataFrame:
    """The rows of ``search_dense``, found in two passes over parts of the index."""
    asked = materialize(comparable(queries.select("query_id", "repo_id", "embedding")), "dense-asked")
    first = materialize(_rings_asked(asked, index, k, queries_per_block), "dense-first")
    found = materialize(score_rings(asked, first, index, k, rows_per_block), "dense-hits")
    threshold = (
        top_k(found, ["query_id", "repo_id", "dims"], [F.col("score").desc(), F.col("vec_id")], k)
        .groupBy("query_id", "repo_id", "dims").agg(F.count("*").alias("hits"), F.min("score").alias("least"))
        .filter(F.col("hits") == k).drop("hits")
    )
    after = _rings_asked(asked, index, k, queries_per_block, threshold)
    rest = materialize(after.join(first, ["query_id", *_RING], "left_anti"), "dense-rest")
    every = found.unionByName(score_rings(asked, rest, index, k, rows_per_block)).drop("dims")
    return top_k(every, ["query_id", "repo_id"], [F.col("score").desc(), F.col("vec_id")], k)


def _rings_asked(asked: DataFrame, index: DenseIndex, k: int, queries_per_block: int, threshold: DataFrame | None = None) -> DataFrame:
    """Query and ring: the rings of highest bounds that hold ``FIRST_ROWS`` * k vectors, or all that reach the threshold.

    Queries in blocks meet the pivots and rings of their repository, of which
    there are few against its vectors.
    """
    blocks = materialize(asked.groupBy(*_PART).agg(F.ceil(F.count("*") / queries_per_block).cast("int").alias("blocks")), "dense-query-blocks")
    dealt = asked.join(blocks, _PART).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("blocks")
    if threshold is None:
        dealt = dealt.withColumn("least", F.lit(None).cast("double"))
    else:
        dealt = dealt.join(threshold, ["query_id", *_PART], "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    # A row per cell: a half circle has few rings.
    cells = index.rings.groupBy(*_CELL).agg(F.collect_list(F.struct("ring", "nearest", "farthest", "rows")).alias("rings"))
    around = (
        cells.join(index.pivots, _CELL, "left").join(blocks, _PART)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    )
    is_first, wanted = threshold is None, FIRST_ROWS * k

    def choose(own: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        if own.empty or cells.empty:
            return pd.DataFrame(columns=["query_id", *_RING])
        pivots = np.flatnonzero(cells["embedding"].notna())
        matrix = unit_rows(cells["embedding"].iloc[pivots]) if len(pivots) else None
        place = np.repeat(np.arange(len(cells)), cells["rings"].str.len())
        rings = pd.DataFrame([tuple(r.values()) for own_rings in cells["rings"] for r in own_rings], columns=["ring", "nearest", "farthest", "rows"])
        rings["pivot"] = cells["pivot"].to_numpy()[place]
        found = []
        for query_id, query, least in zip(own["query_id"], unit_rows(own["embedding"]), own["least"]):
            angles = np.zeros(len(cells))
            if matrix is not None:
                angles[pivots] = np.arccos(np.clip(matrix @ query, -1, 1))
            bounds = _bounds(query, angles[place], rings)
            if is_first:
                order = np.argsort(-bounds, kind="stable")
                held = rings["rows"].to_numpy()[order]
                chosen = order[np.cumsum(held) - held < wanted]
            else:
                chosen = np.flatnonzero(bounds + SLACK >= least)
            found.append(rings.iloc[chosen][["pivot", "ring"]].assign(query_id=query_id))
        return pd.concat(found).assign(repo_id=own["repo_id"].iloc[0], dims=own["dims"].iloc[0])[["query_id", *_RING]]

    block = [*_PART, "block"]
    return dealt.groupBy(*block).cogroup(around.groupBy(*block)).applyInPandas(
        choose, f"query_id {dict(asked.dtypes)['query_id']}, repo_id string, dims int, pivot long, ring int")


def _bounds(query: np.ndarray, angles: np.ndarray, rings: pd.DataFrame) -> np.ndarray:
    """The greatest cosine that a query, at these angles to the pivots of the rings, can have in each."""
    if not query.any():
        return np.zeros(len(rings))
    gap = np.maximum(rings["nearest"].to_numpy() - angles, angles - rings["farthest"].to_numpy())
    return np.where(rings["ring"].to_numpy() < 0, 0.0, np.cos(np.maximum(gap, 0)))


def score_rings(asked: DataFrame, chosen: DataFrame, index: DenseIndex, k: int, rows_per_block: int) -> DataFrame:
    """At most k rows for every query, chosen ring and block of ``rows_per_block`` vectors of a cell.

    A cell of any size is dealt over blocks; the queries that chose one of its rings go to each.
    """
    cells = index.rings.groupBy(*_CELL).agg(F.ceil(F.sum("rows") / rows_per_block).cast("int").alias("blocks"))
    cells = materialize(cells.join(chosen, _CELL, "left_semi"), "dense-cells")
    dealt = index.vectors.join(cells, _CELL).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).drop("blocks")
    sent = chosen.join(asked, ["query_id", *_PART]).join(cells, _CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    types = dict(index.vectors.dtypes)["vec_id"], dict(asked.dtypes)["query_id"]
    columns = ["query_id", "repo_id", "dims", "vec_id", "score"]

    def score(query_rows: pd.DataFrame, vector_rows: pd.DataFrame) -> pd.DataFrame:
        vectors_of = dict(tuple(vector_rows.sort_values("vec_id", ignore_index=True).groupby("ring")))
        best = []
        for ring, own in query_rows.groupby("ring"):
            if ring in vectors_of:
                best.append(best_of_product(own["query_id"].to_numpy(), unit_rows(own["embedding"]), own["repo_id"].iloc[0], vectors_of[ring], k))
        if not best:
            return pd.DataFrame(columns=columns)
        rows = pd.concat(best)
        rows["dims"] = query_rows["dims"].iloc[0]
        return rows.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("query_id", sort=False).head(k)[columns]

    group = [*_CELL, "block"]
    return sent.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInPandas(
        score, f"query_id {types[1]}, repo_id string, dims int, vec_id {types[0]}, score double")
