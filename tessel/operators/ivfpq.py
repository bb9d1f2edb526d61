"""Inverted lists of product-quantized residuals: build and search.

The index is tables: postings(list_id, id, code), and the centroids and codebooks, which are small. A search
joins the queries' probed lists with the postings, so only probed lists are read, and scans each list in
tasks that keep the nearest rows of their part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.params import check_divides
from ..functions.vectors import L2, distances
from .kmeans import PLUS_PLUS, RANDOM_SAMPLE, KMeansFit, assign, fit_kmeans, nearest_centroids, sample, vectors_of
from .knn import NEIGHBOURS, top_k
from .pq import CODEWORDS, ProductQuantizer, train_pq

#: Postings that a task scans at once.
PART_ROWS = 65_536


@dataclass(frozen=True)
class IvfPqConfig:
    nlist: int = 1024
    m: int = 16
    nprobe: int = 8
    iterations: int = 25
    points_per_centroid: int = 256
    seed: int = 42
    init: str = RANDOM_SAMPLE
    metric: str = L2

    def __post_init__(self) -> None:
        if self.metric != L2:
            raise ValueError("inverted lists are for squared L2 only")
        if min(self.nlist, self.m, self.nprobe, self.iterations, self.points_per_centroid) < 1:
            raise ValueError("counts must be 1 or more")

    def with_nprobe(self, nprobe: int) -> IvfPqConfig:
        return replace(self, nprobe=min(nprobe, self.nlist))

    def coarse_training_rows(self, n: int) -> int:
        return min(n, self.nlist * self.points_per_centroid)

    def pq_training_rows(self, n: int) -> int:
        return min(n, CODEWORDS * self.points_per_centroid)

    def short_name(self) -> str:
        return f"nlist={self.nlist},m={self.m},nprobe={self.nprobe}" + (",init=kmeans++" if self.init == PLUS_PLUS else "")


@dataclass(frozen=True)
class IvfPqIndex:
    config: IvfPqConfig
    centroids: np.ndarray
    pq: ProductQuantizer
    postings: DataFrame

    def with_nprobe(self, nprobe: int) -> IvfPqIndex:
        """The same index, searched with another number of lists."""
        return replace(self, config=self.config.with_nprobe(nprobe))

    def list_sizes(self) -> DataFrame:
        """list_id, size of every list, empty ones included."""
        lists = self.postings.sparkSession.range(len(self.centroids)).select(F.col("id").cast("int").alias("list_id"))
        counted = self.postings.groupBy("list_id").agg(F.count("*").alias("n"))
        return lists.join(counted, "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("size"))

    def bytes(self, n: int) -> int:
        """Size of the index in memory: codes, ids, list ends, centroids and codebooks in float32."""
        dim = self.centroids.shape[1]
        return ivfpq_bytes(n, dim, len(self.centroids), self.pq.m)


def ivfpq_bytes(n: int, dim: int, nlist: int, m: int) -> int:
    return n * m + 4 * n + 4 * (nlist + 1) + 4 * nlist * dim + 4 * m * (dim // m) * CODEWORDS


def train_coarse(vectors: DataFrame, config: IvfPqConfig) -> KMeansFit:
    """Coarse centroids, fitted on a sample of nlist * points_per_centroid rows; they serve any m."""
    n = vectors.count()
    held = sample(vectors.select("id", "vec"), config.coarse_training_rows(n), config.seed)
    return fit_kmeans(held, min(config.nlist, n), config.iterations, config.seed, config.init)


def _encoder(centroids: np.ndarray, pq: ProductQuantizer) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = vectors_of(batch)
            best, _ = nearest_centroids(rows, centroids)
            codes = pq.encode(rows - centroids[best]).astype(np.int16)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * pq.m, pa.int32()), pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32)), batch.column("id"), lists], ["list_id", "id", "code"])

    return run


def residuals(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, list_id, vec: each row less its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = vectors_of(batch)
            best, _ = nearest_centroids(rows, centroids)
            rest = rows - centroids[best]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rest) + 1) * rest.shape[1], pa.int32()), pa.array(rest.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), lists], ["id", "list_id", "vec"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, list_id int, vec array<double>")


def build_ivfpq(vectors: DataFrame, config: IvfPqConfig, coarse: KMeansFit | None = None) -> IvfPqIndex:
    """Assign, train on sampled residuals, encode all residuals. A coarse quantizer from another build may be given."""
    first = vectors.select(F.size("vec").alias("n")).first()
    if first is None:
        raise ValueError("no vectors to index")
    check_divides(first["n"], config.m)
    if coarse is not None and coarse.centroids.shape != (min(config.nlist, len(coarse.centroids)), first["n"]):
        raise ValueError("the coarse quantizer has other lists or dimensions")
    coarse = coarse or train_coarse(vectors, config)
    n = vectors.count()
    held = sample(vectors.select("id", "vec"), config.pq_training_rows(n), config.seed)
    pq = train_pq(residuals(held, coarse.centroids), config.m, config.iterations, config.seed, config.init, config.points_per_centroid)
    postings = vectors.select("id", "vec").mapInArrow(_encoder(coarse.centroids, pq), "list_id int, id long, code array<short>")
    return IvfPqIndex(replace(config, nlist=len(coarse.centroids)), coarse.centroids, pq, postings)


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """qid, asked (the query), rank, list_id: the nprobe nearest lists of each query, by (distance, list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = distances(L2, vectors_of(batch), centroids)
            order = np.argsort(far, axis=1, kind="stable")[:, :nprobe]
            n = order.shape[1]
            at = np.repeat(np.arange(len(far)), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid").take(pa.array(at)), batch.column("vec").take(pa.array(at)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(far))), pa.array(order.reshape(-1).astype(np.int32))],
                ["qid", "asked", "rank", "list_id"],
            )

    kind = dict(queries.dtypes)["vec"]
    return queries.select("qid", "vec").mapInArrow(run, f"qid long, asked {kind}, rank int, list_id int")


def _scanner(centroids: np.ndarray, quantizer: ProductQuantizer, k: int) -> Callable:
    def scan(posts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(posts) or not len(asked):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "dist": pd.Series(dtype="float64")})
        ids, codes = posts["id"].to_numpy(np.int64), np.stack(posts["code"].to_numpy()).astype(np.int64)
        centroid = centroids[int(posts["list_id"].iloc[0])]
        out = []
        for q, v in zip(asked["qid"], asked["asked"], strict=True):
            d = quantizer.scan(quantizer.tables(np.asarray(v, np.float64) - centroid), codes)
            at = np.lexsort((ids, d))[:k]
            out.append((np.full(len(at), q), ids[at], d[at]))
        qid, id_, dist = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"qid": qid, "id": id_, "dist": dist})

    return scan


def search_ivfpq(index: IvfPqIndex, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, dist: the k nearest rows of the probed lists; dist is the asymmetric approximation. Fewer
    than k where the lists hold fewer. Long lists are cut into parts that are scanned apart."""
    sizes = index.list_sizes().where(f"size > {PART_ROWS}").select("list_id", F.ceil(F.col("size") / PART_ROWS).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    # at most one row a list, of which there are few
    posts = index.postings.join(F.broadcast(sizes), "list_id", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    asked = probes(queries, index.centroids, index.config.nprobe).join(F.broadcast(sizes), "list_id", "left")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("list_id", "part", "qid", "asked")
    met = posts.groupBy("list_id", "part").cogroup(asked.groupBy("list_id", "part"))
    return top_k(met.applyInPandas(_scanner(index.centroids, index.pq, k), NEIGHBOURS), k)


__all__ = ["IvfPqConfig", "IvfPqIndex", "assign", "build_ivfpq", "ivfpq_bytes", "probes", "residuals", "search_ivfpq", "train_coarse"]
