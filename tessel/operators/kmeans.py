"""Lloyd's k-means over a table of vectors, with its seedings and the reseeding of empty clusters.

Centroids are k small rows that the driver holds and sends to the tasks; rows are read where they are, each
task returns sums by cluster, and only those are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import L2, distances

RANDOM_SAMPLE, PLUS_PLUS = "random", "kmeans++"
#: Centroids times dimensions that a fit holds at most.
MOST_CELLS = 50_000_000


@dataclass(frozen=True)
class KMeansFit:
    centroids: np.ndarray
    inertia: float
    iterations: int


def vectors_of(batch: pa.RecordBatch, column: str = "vec") -> np.ndarray:
    """The list column of a batch as a float64 matrix."""
    lists = batch.column(column)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def nearest_centroids(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest nearest centroid, squared distance) of each row."""
    best, least = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    for c, far in enumerate(distances(L2, centroids, rows)):
        closer = far < least
        best[closer], least[closer] = c, far[closer]
    return best, least


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, list_id, dist of every row of vectors(id, vec); the lowest centroid wins ties."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, least = nearest_centroids(vectors_of(batch), centroids) if batch.num_rows else (np.empty(0, np.int64), np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(least)], ["id", "list_id", "dist"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, list_id int, dist double")


def _sums(centroids: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, dim = centroids.shape
        total, count, inertia = np.zeros((n, dim)), np.zeros(n, np.int64), np.zeros(n)
        for batch in batches:
            if batch.num_rows:
                rows = vectors_of(batch)
                best, least = nearest_centroids(rows, centroids)
                np.add.at(total, best, rows)
                count += np.bincount(best, minlength=n)
                inertia += np.bincount(best, least, minlength=n)
        used = np.nonzero(count)[0]
        cell = np.repeat(used, dim)
        pos = np.tile(np.arange(dim), len(used))
        cols = [pa.array(cell.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(total[used].reshape(-1)), pa.array(np.repeat(count[used], dim)), pa.array(np.where(pos == 0, np.repeat(inertia[used], dim), 0.0))]
        yield pa.RecordBatch.from_arrays(cols, ["c", "pos", "total", "n", "inertia"])

    return run


def _farthest(vectors: DataFrame, centroids: np.ndarray, n: int) -> list[np.ndarray]:
    """The n rows farthest from their centroids, the smallest id first among ties."""
    far = assign(vectors, centroids).orderBy(F.desc("dist"), "id").limit(n)
    return [np.array(r["vec"], np.float64) for r in far.join(vectors, "id").orderBy(F.desc("dist"), "id").select("vec").collect()]


def lloyd_step(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float]:
    """(updated centroids, inertia of the given ones); an empty cluster moves onto the row farthest from its
    own centroid, in ascending order of clusters, each taking another row."""
    parts = vectors.select("vec").mapInArrow(_sums(centroids), "c int, pos int, total double, n long, inertia double")
    rows = parts.groupBy("c", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("inertia").alias("inertia")).collect()
    new, seen, inertia = centroids.copy(), set(), 0.0
    for r in sorted(rows, key=lambda r: (r["c"], r["pos"])):
        new[r["c"], r["pos"]] = r["total"] / r["n"]
        inertia += r["inertia"]
        seen.add(r["c"])
    empty = [c for c in range(len(centroids)) if c not in seen]
    if empty:
        for c, v in zip(empty, _farthest(vectors, centroids, len(empty)), strict=False):
            new[c] = v
    return new, inertia


def sample(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the first in the order of a seeded hash of their ids."""
    return vectors.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(n)


def random_seeds(vectors: DataFrame, k: int, seed: int = 42) -> np.ndarray:
    rows = sample(vectors.select("id", "vec"), k, seed).collect()
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["id"])], np.float64)


def plus_plus_seeds(rows: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """k-means++ over a training sample in memory: each next seed is drawn in proportion to the squared distance to
    the nearest seed so far, uniformly where all distances are 0."""
    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(rows)))]
    least = distances(L2, rows[picked], rows)[0]
    while len(picked) < k:
        total = least.sum()
        at = int(rng.integers(len(rows))) if total <= 0 else int(np.searchsorted(np.cumsum(least), rng.random() * total, side="right"))
        picked.append(min(at, len(rows) - 1))
        least = np.minimum(least, distances(L2, rows[picked[-1:]], rows)[0])
    return rows[picked].copy()


def fit_kmeans(vectors: DataFrame, k: int, iterations: int = 25, seed: int = 42, init: str = PLUS_PLUS, seeds: np.ndarray | None = None, train_rows: int = 100_000) -> KMeansFit:
    """Centroids of vectors(id, vec). k must be 1 or more and no more than the rows.

    An iteration that lowers the inertia by no more than 1e-7 of it is the last. k-means++ seeds
    are drawn from a sample of train_rows; the iterations run over all rows.
    """
    n = vectors.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be from 1 to {n}")
    if seeds is None:
        if init == PLUS_PLUS:
            held = sample(vectors.select("id", "vec"), train_rows, seed).toPandas().sort_values("id")
            seeds = plus_plus_seeds(np.stack(held["vec"].to_numpy()).astype(np.float64), k, seed)
        else:
            seeds = random_seeds(vectors, k, seed)
    if seeds.size > MOST_CELLS:
        raise ValueError(f"{seeds.size} cells of centroids; {MOST_CELLS} at most")
    centroids, before, done = seeds, np.inf, 0
    for done in range(1, iterations + 1):
        new, inertia = lloyd_step(vectors, centroids)
        if before - inertia <= 1e-7 * max(1.0, before) and before < np.inf:
            break
        centroids, before = new, inertia
    final = assign(vectors, centroids).agg(F.sum("dist")).first()[0]
    return KMeansFit(centroids, float(final or 0.0), done)


def fit_in_memory(rows: np.ndarray, k: int, iterations: int, seed: int, init: str = RANDOM_SAMPLE) -> np.ndarray:
    """The same over a matrix, for samples that one task holds."""
    k = min(k, len(rows))
    rng = np.random.default_rng(seed)
    centroids = plus_plus_seeds(rows, k, seed) if init == PLUS_PLUS else rows[np.sort(rng.permutation(len(rows))[:k])].copy()
    before = np.inf
    for _ in range(iterations):
        best, least = nearest_centroids(rows, centroids)
        inertia = least.sum()
        if before < np.inf and before - inertia <= 1e-7 * max(1.0, before):
            break
        before = inertia
        count = np.bincount(best, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, best, rows)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
        for c in np.nonzero(count == 0)[0]:
            far = int(least.argmax())
            centroids[c], least[far] = rows[far], 0.0
    return centroids
