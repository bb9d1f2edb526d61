"""Exact k-nearest neighbours: a join of a query set with all base rows, each query's k nearest kept.

Neighbours are ordered by (distance, id). Base rows fall to blocks and queries to blocks; a task holds one of each,
keeps the k nearest of its block for each query, and a window merges the blocks' lists. Neither side is
broadcast, and few pairs of rows leave a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import INNER_PRODUCT, L2, METRICS, distance, distances

#: Rows of a base block and of a query block, about.
BASE_ROWS, QUERY_ROWS = 32_768, 2_048
#: Relative error that the expanded distances of the SQL form's screen are allowed, far above that of doubles.
SCREEN_ERROR = 1e-9
#: Queries that the screen asks at once.
SCREEN_QUERIES = 128

NEIGHBOURS = "qid long, id long, dist double"


def top_k(neighbours: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, dist of each query's k nearest rows of neighbours(qid, id, dist)."""
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return neighbours.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def _nearest(k: int, metric: str) -> Callable:
    def nearest(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(queries):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        rows, ids = np.stack(base["vec"].to_numpy()).astype(np.float64), base["id"].to_numpy(np.int64)
        asked = np.stack(queries["vec"].to_numpy()).astype(np.float64)
        if rows.shape[1] != asked.shape[1]:
            raise ValueError(f"queries have {asked.shape[1]} dimensions, the base {rows.shape[1]}")
        far = distances(metric, asked, rows)
        n = min(k, len(ids))
        out = []
        for q, d in zip(queries["qid"].to_numpy(np.int64), far, strict=True):
            cut = np.partition(d, n - 1)[n - 1]
            at = np.nonzero(d <= cut)[0]  # ties at the cut included: ids decide among them
            at = at[np.lexsort((ids[at], d[at]))][:n]
            out.append((np.full(len(at), q), ids[at], d[at]))
        qid, id_, dist = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"qid": qid, "id": id_, "dist": dist})

    return nearest


def _tiles(queries: DataFrame, base: DataFrame):  # noqa: ANN202
    """Blocks of base rows, each with each block of queries, cogrouped."""
    n_base, n_queries = base.count(), queries.count()
    blocks, parts = max(1, -(-n_base // BASE_ROWS)), max(1, -(-n_queries // QUERY_ROWS))
    # a small base still feeds all cores
    blocks = max(blocks, min(n_base // 256 + 1, base.sparkSession.sparkContext.defaultParallelism))
    all_parts, all_blocks = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = base.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", all_parts)
    right = queries.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int")).withColumn("block", all_blocks)
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = L2) -> DataFrame:
    """qid, rank, id, dist: the k nearest rows of base(id, vec) of each row of queries(qid, vec).

    Fewer than k where the base is smaller; empty tables give an empty one; null vectors take no part. Vectors
    of different lengths are an error.
    """
    if metric not in METRICS or k < 1:
        raise ValueError("unknown metric or k below 1")
    base, queries = base.where("vec is not null").select("id", "vec"), queries.where("vec is not null").select("qid", "vec")
    return top_k(_tiles(queries, base).applyInPandas(_nearest(k, metric), NEIGHBOURS), k)


def _near(k: int, metric: str) -> Callable:
    def near(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """The pairs of a tile that may be among the k nearest of their query, by matrix products."""
        if not len(base) or not len(queries):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "asked": pd.Series(dtype="object"), "id": pd.Series(dtype="int64"), "vec": pd.Series(dtype="object")})
        rows, asked = (np.stack(df["vec"].to_numpy()).astype(np.float64) for df in (base, queries))
        if rows.shape[1] != asked.shape[1]:
            raise ValueError(f"queries have {asked.shape[1]} dimensions, the base {rows.shape[1]}")
        square, n, of, at = np.einsum("ij,ij->i", rows, rows), min(k, len(rows)), [], []
        for start in range(0, len(asked), SCREEN_QUERIES):
            some = asked[start : start + SCREEN_QUERIES]
            own = np.einsum("ij,ij->i", some, some)[:, None]
            far = -(some @ rows.T) if metric == INNER_PRODUCT else own + square - 2 * (some @ rows.T)
            cut = np.partition(far, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero(~(far > cut + SCREEN_ERROR * (own + square.max())))  # what isn't a number stays
            of.append(i + start)
            at.append(j)
        of, at = np.concatenate(of), np.concatenate(at)
        return pd.DataFrame({"qid": queries["qid"].to_numpy(np.int64)[of], "asked": queries["vec"].to_numpy()[of], "id": base["id"].to_numpy(np.int64)[at], "vec": base["vec"].to_numpy()[at]})

    return near


def knn_sql(queries: DataFrame, base: DataFrame, k: int, metric: str = L2) -> DataFrame:
    """The same with distances by SQL expressions, which decide the order.

    Expressions over all pairs take microseconds a pair, so a screen of another formula than knn()'s leaves them those that can be
    among the k nearest of their tile.
    """
    if metric not in METRICS or k < 1:
        raise ValueError("unknown metric or k below 1")
    base, queries = base.where("vec is not null").select("id", "vec"), queries.where("vec is not null").select("qid", "vec")
    schema = f"qid long, asked {dict(queries.dtypes)['vec']}, id long, vec {dict(base.dtypes)['vec']}"
    pairs = _tiles(queries, base).applyInPandas(_near(k, metric), schema)
    return top_k(pairs.select("qid", "id", distance(metric, "asked", "vec").alias("dist")), k)


def distances_to(queries: DataFrame, base: DataFrame, pairs: DataFrame, metric: str = L2) -> DataFrame:
    """qid, id, dist of named pairs(qid, id)."""
    joined = pairs.select("qid", "id").join(base.select("id", "vec"), "id").join(queries.select("qid", F.col("vec").alias("asked")), "qid")
    return joined.select("qid", "id", distance(metric, "asked", "vec").alias("dist"))
