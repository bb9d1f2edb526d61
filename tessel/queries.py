"""Registered queries of the vector and report operators, each with the SQL that gives the same rows.

Searches take as queries every row whose id is divisible by 20, against all rows. Lists and codebooks that SQL
has to know are the mean vectors of the labels; measurement rows are derived from the table part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import params
from .functions.vectors import accumulation_tolerance, residual
from .operators import evaluation, hnsw, ivfpq, kmeans, knn, pq, reports
from .operators.hnsw_graph import HnswConfig

K, PROBES, SUBSPACES, GRAPH_K = 10, 3, 8, 8

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# inputs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), "vec")


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list_id (labels in order, from 0), pos (from 1), mean."""
    cells = vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("pos", "x")).groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    # a few labels times the dimensions
    ranked = cells.withColumn("list_id", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))
    return ranked.select("list_id", (F.col("pos") + 1).alias("pos"), "mean")


def mean_matrix(spark: SparkSession, sf_dir: str) -> np.ndarray:
    rows = label_means(spark, sf_dir).collect()
    out = np.zeros((max(r["list_id"] for r in rows) + 1, max(r["pos"] for r in rows)))
    for r in rows:
        out[r["list_id"], r["pos"] - 1] = r["mean"]
    return out


def label_index(spark: SparkSession, sf_dir: str, nprobe: int = PROBES) -> ivfpq.IvfPqIndex:
    """An inverted-file index whose lists and codewords are the mean vectors."""
    centroids = mean_matrix(spark, sf_dir)
    size = centroids.shape[1] // SUBSPACES
    quantizer = pq.ProductQuantizer([centroids[:, j * size : (j + 1) * size] for j in range(SUBSPACES)])
    rows = vectors(spark, sf_dir)
    postings = rows.select("id", "vec").mapInArrow(ivfpq._encoder(centroids, quantizer), "list_id int, id long, code array<short>")
    return ivfpq.IvfPqIndex(ivfpq.IvfPqConfig(nlist=len(centroids), m=SUBSPACES, nprobe=nprobe), centroids, quantizer, postings)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """harness, dataset, params, recall_at_k, mean_latency_us, build_seconds, index_bytes, base_bytes, timestamp, ord of every part."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    name = params.hnsw_name(pick((8, 16, 32), size % 3), pick((100, 200, 400), F.floor(key / 2) % 3), pick((16, 32, 64, 128, 256, 512), F.floor(key / 6) % 6))
    return _table(spark, sf_dir, "part").select(
        F.when(key % 2 == 0, "own").otherwise("other").alias("harness"), F.when(size <= 25, "small").otherwise("large").alias("dataset"), F.lit("hnsw").alias("index"), name.alias("params"),
        (size / 50.0).alias("recall_at_k"), F.col("p_retailprice").alias("mean_latency_us"), (F.col("p_retailprice") + size).alias("build_seconds"),
        (key * 1000).alias("index_bytes"), (size.cast("long") * 100000).alias("base_bytes"), F.lpad(key.cast("string"), 12, "0").alias("timestamp"), key.alias("ord"),
    )


def harness_rows(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    return reports.first_of_block(measurements(spark, sf_dir).where(F.col("harness") == harness), ["params"], "ord")


_MEAS = """meas AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE 'other' END AS harness, CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS dataset, 'hnsw' AS "index",
  'M=' || [8,16,32][p_size % 3 + 1] || ',efC=' || [100,200,400][(p_partkey // 2) % 3 + 1] || ',ef=' || [16,32,64,128,256,512][(p_partkey // 6) % 6 + 1] AS params,
  [8,16,32][p_size % 3 + 1] AS m, [16,32,64,128,256,512][(p_partkey // 6) % 6 + 1] AS ef, 'M=' || [8,16,32][p_size % 3 + 1] || ',efC=' || [100,200,400][(p_partkey // 2) % 3 + 1] AS block,
  p_size / 50.0::DOUBLE AS recall_at_k, p_retailprice AS mean_latency_us, p_retailprice + p_size AS build_seconds, p_partkey * 1000 AS index_bytes, p_size::BIGINT * 100000 AS base_bytes,
  lpad(p_partkey::VARCHAR, 12, '0') AS "timestamp", p_partkey AS ord FROM part),
own AS (SELECT * FROM meas WHERE harness = 'own' QUALIFY row_number() OVER (PARTITION BY params ORDER BY ord) = 1),
other AS (SELECT * FROM meas WHERE harness = 'other' QUALIFY row_number() OVER (PARTITION BY params ORDER BY ord) = 1),
pairs AS (SELECT own.params, own.m, own.ef, own.mean_latency_us AS own, other.mean_latency_us AS other, own.mean_latency_us / other.mean_latency_us AS ratio FROM own JOIN other USING (params)),
ownb AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY block ORDER BY ord) = 1), otherb AS (SELECT * FROM other QUALIFY row_number() OVER (PARTITION BY block ORDER BY ord) = 1),
blk AS (SELECT block, ownb.build_seconds / otherb.build_seconds AS ratio, otherb."timestamp" AS started FROM ownb JOIN otherb USING (block)),
dev AS (SELECT *, greatest(ratio / (SELECT median(ratio) FROM blk), (SELECT median(ratio) FROM blk) / ratio) AS deviation FROM blk),
sus AS (SELECT *, coalesce(started >= (SELECT min(started) FROM dev WHERE deviation > 1.25), false) AS suspect FROM dev)"""

_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings), q AS (SELECT id AS qid, vec FROM v WHERE id % 20 = 0)"
_KNN = "truth AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, list_distance(q.vec, v.vec) ** 2 AS dist FROM q, v) QUALIFY rank <= 10)"
_CELLS = "cells AS (SELECT dense_rank() OVER (ORDER BY label) - 1 AS list_id, pos, avg(x) AS mean FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM v) GROUP BY label, pos)"
_CENT = _CELLS + ", cent AS (SELECT list_id, list(mean ORDER BY pos) AS vec FROM cells GROUP BY list_id)"
_ASSIGN = "far AS (SELECT id, v.vec, list_id, cent.vec AS c, list_distance(v.vec, cent.vec) ** 2 AS dist FROM v, cent), own AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, list_id) = 1)"
_PROBE = "probe AS (SELECT qid, q.vec, list_id, cent.vec AS c, row_number() OVER (PARTITION BY qid ORDER BY list_distance(q.vec, cent.vec) ** 2, list_id) AS rank FROM q, cent QUALIFY rank <= 3)"
_SUB = "sub AS (SELECT unnest(range(8)) AS j), word AS (SELECT list_id AS code, j, vec[j * 8 + 1 : j * 8 + 8] AS w FROM cent, sub)"
_RES = "res AS (SELECT id, list_id, list_transform(list_zip(vec, c), lambda x: x[1] - x[2]) AS r FROM own)"
_CODE = "code AS (SELECT id, list_id, res_j.j, word.code, word.w FROM (SELECT id, list_id, j, r[j * 8 + 1 : j * 8 + 8] AS p FROM res, sub) res_j JOIN word ON word.j = res_j.j QUALIFY row_number() OVER (PARTITION BY id, res_j.j ORDER BY list_distance(p, w) ** 2, word.code) = 1)"
_IVF = f"{_V}, {_CENT}, {_ASSIGN}, {_PROBE}, {_SUB}, {_RES}, {_CODE}, ask AS (SELECT qid, list_id, j, list_transform(list_zip(vec, c), lambda x: x[1] - x[2])[j * 8 + 1 : j * 8 + 8] AS p FROM probe, sub), found AS (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, sum(list_distance(p, w) ** 2) AS dist FROM ask JOIN code USING (list_id, j) GROUP BY qid, id) QUALIFY rank <= 10)"
_RECALL = "recall AS (SELECT qid, count(found.id) / 10.0::DOUBLE AS recall FROM truth LEFT JOIN found USING (qid, id) GROUP BY qid)"
_GRAPH = "edge AS (SELECT src, dst FROM (SELECT a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec) ** 2, b.id) AS rank FROM v a, v b WHERE a.id <> b.id) WHERE rank <= 8), entry AS (SELECT min(id) AS node FROM v), orphan AS (SELECT id AS node FROM v WHERE id NOT IN (SELECT dst FROM edge) AND id NOT IN (SELECT node FROM entry))"


# searches


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("dist", 6).alias("dist"))


@_query(f"WITH {_V}, {_KNN} SELECT qid, rank, id, round(dist, 6) AS dist FROM truth")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), K))


@_query(f"WITH {_V} SELECT qid, rank, id, round(dist, 6) AS dist FROM (SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, id, -list_inner_product(q.vec, v.vec) AS dist FROM q, v)) WHERE rank <= 10")
def knn_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), K, "inner_product"))


@_query(f"WITH {_V}, {_KNN} SELECT qid, rank, id, round(dist, 6) AS dist FROM truth")
def knn_sql_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(knn.knn_sql(asked(spark, sf_dir), vectors(spark, sf_dir), K))


@_query("SELECT count(*) AS queries, count(*) AS identical, 0.0::DOUBLE AS worst FROM embeddings WHERE vec_id % 20 = 0")
def kernel_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    return evaluation.kernel_check(knn.knn(q, v, K), knn.knn_sql(q, v, K)).withColumn("worst", F.round("worst", 9))


@_query("SELECT count(*) AS queries, count(*) AS distance_matches, 0::BIGINT AS tie_only, 0::BIGINT AS errors FROM embeddings WHERE vec_id % 20 = 0")
def oracle_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    return evaluation.validation_summary(knn.knn(q, v, K), knn.knn_sql(q, v, K), accumulation_tolerance(64))


@_query(f"WITH {_V} SELECT a.id AS qid, b.id AS id, round(list_distance(a.vec, b.vec) ** 2, 6) AS dist FROM v a JOIN v b ON b.id = a.id + 1")
def distance_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    pairs = v.select(F.col("id").alias("qid"), (F.col("id") + 1).alias("id"))
    return knn.distances_to(v.select(F.col("id").alias("qid"), "vec"), v, pairs).withColumn("dist", F.round("dist", 6))


@_query("SELECT count(*) AS vectors, min(len(embedding))::BIGINT AS least_dim, max(len(embedding))::BIGINT AS most_dim FROM embeddings")
def vector_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size("vec").cast("long")
    return vectors(spark, sf_dir).agg(F.count("*").alias("vectors"), F.min(size).alias("least_dim"), F.max(size).alias("most_dim"))


# lists, k-means, quantization


@_query(f"WITH {_V}, {_CELLS} SELECT list_id, pos, round(mean, 9) AS mean FROM cells")
def group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_means(spark, sf_dir).select(F.col("list_id").cast("long").alias("list_id"), F.col("pos").cast("long").alias("pos"), F.round("mean", 9).alias("mean"))


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN} SELECT id, list_id, round(dist, 6) AS dist FROM own")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.assign(vectors(spark, sf_dir), mean_matrix(spark, sf_dir))
    return found.select("id", F.col("list_id").cast("long").alias("list_id"), F.round("dist", 6).alias("dist"))


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN} SELECT round(sum(dist), 4) AS inertia FROM own")
def inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(vectors(spark, sf_dir), mean_matrix(spark, sf_dir)).agg(F.round(F.sum("dist"), 4).alias("inertia"))


_STEP = """a{n} AS (SELECT id, v.vec, list_id FROM v, c{p} QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(v.vec, c{p}.vec) ** 2, list_id) = 1),
u{n} AS (SELECT list_id, pos, avg(x) AS mean FROM (SELECT list_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM a{n}) GROUP BY list_id, pos), c{n} AS (SELECT list_id, list(mean ORDER BY pos) AS vec FROM u{n} GROUP BY list_id)"""


@_query(f"WITH {_V}, {_CENT}, c0 AS (SELECT * FROM cent), {_STEP.format(n=1, p=0)}, {_STEP.format(n=2, p=1)} SELECT list_id, pos, round(mean, 6) AS mean FROM u2")
def kmeans_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = vectors(spark, sf_dir), mean_matrix(spark, sf_dir)
    for _ in range(2):
        c, _ = kmeans.lloyd_step(v, c)
    rows = [(i, p + 1, float(x)) for i, row in enumerate(c) for p, x in enumerate(row)]
    return spark.createDataFrame(rows, "list_id long, pos long, mean double").withColumn("mean", F.round("mean", 6))


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN} SELECT cent.list_id, count(own.id) AS size FROM cent LEFT JOIN own USING (list_id) GROUP BY cent.list_id")
def list_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_index(spark, sf_dir).list_sizes().select(F.col("list_id").cast("long").alias("list_id"), "size")


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN}, s AS (SELECT cent.list_id, count(own.id) AS size FROM cent LEFT JOIN own USING (list_id) GROUP BY cent.list_id) SELECT min(size) AS smallest, list(size ORDER BY size)[count(*) // 2 + 1] AS median_size, max(size) AS largest FROM s")
def list_size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.upper_median(label_index(spark, sf_dir).list_sizes(), "size")


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN} SELECT id, list_id, round(list_sum(list_transform(list_zip(vec, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS norm FROM own")
def residual_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = ivfpq.residuals(vectors(spark, sf_dir), mean_matrix(spark, sf_dir))
    zero = F.transform("vec", lambda x: F.lit(0.0))
    norm = F.aggregate(residual("vec", zero), F.lit(0.0), lambda s, x: s + x * x)
    return rest.select("id", F.col("list_id").cast("long").alias("list_id"), F.round(norm, 6).alias("norm"))


@_query(f"WITH {_V}, {_CENT}, {_PROBE} SELECT qid, rank, list_id FROM probe")
def probed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ivfpq.probes(asked(spark, sf_dir), mean_matrix(spark, sf_dir), PROBES)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), F.col("list_id").cast("long").alias("list_id"))


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN}, {_SUB}, {_RES}, {_CODE} SELECT id, j AS subspace, code FROM code")
def pq_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = label_index(spark, sf_dir).postings.select("id", F.posexplode("code").alias("subspace", "code"))
    return codes.select("id", F.col("subspace").cast("long").alias("subspace"), F.col("code").cast("long").alias("code"))


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN}, {_SUB}, {_RES}, {_CODE} SELECT id, j AS subspace, code FROM code")
def pq_codes_sql_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = label_index(spark, sf_dir)
    rest = ivfpq.residuals(vectors(spark, sf_dir), index.centroids)
    found = pq.pq_encode_sql(rest, index.pq.frame(spark), SUBSPACES)
    return found.select("id", F.col("subspace").cast("long").alias("subspace"), F.col("code").cast("long").alias("code"))


@_query(f"WITH {_V}, {_CENT}, {_ASSIGN}, {_SUB}, {_RES}, {_CODE}, part AS (SELECT id, j, r[j * 8 + 1 : j * 8 + 8] AS p FROM res, sub) SELECT id, round(sum(list_distance(p, w) ** 2), 6) AS error FROM part JOIN code USING (id, j) GROUP BY id")
def pq_reconstruction_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = label_index(spark, sf_dir)
    rest = ivfpq.residuals(vectors(spark, sf_dir), index.centroids)
    back = pq.pq_decode(index.postings, index.pq).withColumnRenamed("vec", "back")
    d = F.aggregate(residual("vec", "back"), F.lit(0.0), lambda s, x: s + x * x)
    return rest.join(back, "id").select("id", F.round(d, 6).alias("error"))


@_query(f"WITH {_IVF} SELECT qid, rank, id, round(dist, 6) AS dist FROM found")
def ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(ivfpq.search_ivfpq(label_index(spark, sf_dir), asked(spark, sf_dir), K))


# evaluation


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    return ivfpq.search_ivfpq(label_index(spark, sf_dir), q, K), knn.knn(q, v, K)


@_query(f"WITH {_IVF}, {_KNN}, {_RECALL} SELECT qid, round(recall, 6) AS recall FROM recall")
def recall_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_per_query(*_found(spark, sf_dir), K).withColumn("recall", F.round("recall", 6))


@_query(f"WITH {_IVF}, {_KNN}, {_RECALL} SELECT round(avg(recall), 6) AS recall FROM recall")
def mean_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mean_recall(*_found(spark, sf_dir), K).withColumn("recall", F.round("recall", 6))


@_query(f"WITH {_IVF}, {_KNN}, t AS (SELECT qid, list(id ORDER BY rank) AS l FROM truth GROUP BY qid), f AS (SELECT qid, list(id ORDER BY rank) AS l FROM found GROUP BY qid) SELECT round(avg(coalesce(t.l = f.l, false)::INT), 6) AS exact_rate FROM t LEFT JOIN f USING (qid)")
def exact_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.exact_match_rate(*_found(spark, sf_dir), K).withColumn("exact_rate", F.round("exact_rate", 6))


def knn_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges to the GRAPH_K nearest others, and the entry of the exact neighbour graph."""
    v = vectors(spark, sf_dir)
    near = knn.knn(v.select(F.col("id").alias("qid"), "vec"), v, GRAPH_K + 1).where("qid <> id")
    edges = knn.top_k(near, GRAPH_K).select(F.col("qid").alias("src"), F.col("id").alias("dst")).persist()
    return v.select(F.col("id").alias("node")), edges, v.agg(F.min("id").alias("node"))


@_query(
    f"WITH RECURSIVE {_V}, {_GRAPH}, seen AS (SELECT node FROM entry UNION SELECT dst FROM edge JOIN seen ON src = node), deg AS (SELECT v.id, count(dst) AS d FROM v LEFT JOIN edge ON src = v.id GROUP BY v.id), "
    "n AS (SELECT count(*) AS nodes, sum(d)::BIGINT AS edges, min(d) AS min_degree, max(d) AS max_degree FROM deg), o AS (SELECT count(*) AS orphans FROM orphan), i AS (SELECT (SELECT count(*) FROM v) - count(*) AS isolated FROM seen) "
    "SELECT *, greatest(0, isolated - orphans) AS fragmented FROM n, o, i"
)
def graph_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.diagnostics(*knn_graph(spark, sf_dir))


@_query(f"WITH {_V}, {_GRAPH} SELECT node FROM orphan")
def graph_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.orphans(*knn_graph(spark, sf_dir))


@_query(
    f"WITH {_IVF}, {_KNN}, {_RECALL}, {_GRAPH}, ends AS (SELECT qid, sqrt(max(dist) FILTER (rank = 1)) AS d1, sqrt(max(dist) FILTER (rank = 10)) AS dk FROM truth GROUP BY qid), lost AS (SELECT qid, count(*) AS lost FROM truth WHERE id IN (SELECT node FROM orphan) GROUP BY qid) "
    "SELECT qid AS query, round(recall, 6) AS recall, round(d1, 5) AS d1, round(dk, 5) AS dk, CASE WHEN d1 = 0 THEN 1.0 ELSE round(dk / d1, 5) END AS spread, coalesce(lost, 0)::INTEGER AS orphan_neighbours FROM recall JOIN ends USING (qid) LEFT JOIN lost USING (qid)"
)
def failure_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.failure_analysis(*_found(spark, sf_dir), K, hnsw.orphans(*knn_graph(spark, sf_dir)))
    return out.select("query", F.round("recall", 6).alias("recall"), F.round("d1", 5).alias("d1"), F.round("dk", 5).alias("dk"), F.round("spread", 5).alias("spread"), "orphan_neighbours")


@_query(None)
def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    index = hnsw.build_hnsw(v, HnswConfig(16, 100, 64))
    return evaluation.recall_per_query(hnsw.search_hnsw(index, q, K), knn.knn(q, v, K), K)


@_query(None)
def ivfpq_trained_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir).persist()
    index = ivfpq.build_ivfpq(v, ivfpq.IvfPqConfig(nlist=16, m=16, nprobe=8, iterations=8))
    return evaluation.recall_per_query(ivfpq.search_ivfpq(index, q, K), knn.knn(q, v, K), K)


@_query(None)
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).persist()
    fit = kmeans.fit_kmeans(v, 16, iterations=10)
    return kmeans.assign(v, fit.centroids)


@_query("SELECT event_type, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.latency_summary(_table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


# the report layer


@_query(f"WITH {_MEAS} SELECT params, m::BIGINT AS m, ef::BIGINT AS ef, block FROM meas")
def params_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("params")
    return measurements(spark, sf_dir).select("params", params.number(p, "M").cast("long").alias("m"), F.element_at(params.parse(p), "ef").cast("long").alias("ef"), params.block(p).alias("block"))


@_query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM (SELECT *, min(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM part) WHERE b IS NULL OR p_retailprice < b")
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pareto(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice", "p_partkey")


@_query("SELECT p_brand, p_partkey, p_size, p_retailprice FROM part WHERE p_size >= 25 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) = 1")
def cheapest_reaching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cheapest_reaching(_table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice"), ["p_brand"], "p_size", "p_retailprice", "p_partkey", 25)


@_query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1")
def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_of(_table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ratios(harness_rows(spark, sf_dir, "own"), harness_rows(spark, sf_dir, "other"), "mean_latency_us")


def _suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.suspect_blocks(harness_rows(spark, sf_dir, "own"), harness_rows(spark, sf_dir, "other"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("block", params.block("params"))
    return pairs.join(_suspects(spark, sf_dir).select("block", "suspect"), "block")


@_query(f"WITH {_MEAS} SELECT params, round(ratio, 6) AS ratio FROM pairs")
def harness_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("params", F.round("ratio", 6).alias("ratio"))


@_query(f"WITH {_MEAS} SELECT m::BIGINT AS m, ef::BIGINT AS ef, round(avg(ratio), 6) AS mean_ratio FROM pairs GROUP BY GROUPING SETS ((m), (ef))")
def ratio_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ratio_sets(_pairs(spark, sf_dir)).select(F.col("m").cast("long").alias("m"), F.col("ef").cast("long").alias("ef"), F.round("mean_ratio", 6).alias("mean_ratio"))


@_query(
    f"WITH {_MEAS}, f AS (SELECT pairs.*, suspect FROM pairs JOIN sus ON sus.block = regexp_replace(params, ',(ef|nprobe)=[0-9]+', '')) SELECT ef::BIGINT AS ef, m::BIGINT AS m, round(coalesce(avg(ratio) FILTER (NOT suspect), avg(ratio) FILTER (suspect)), 6) AS ratio, "
    "CASE WHEN count(*) FILTER (NOT suspect) = count(*) THEN 'clean' WHEN count(*) FILTER (NOT suspect) > 0 THEN 'partial' ELSE 'none' END AS state FROM f GROUP BY ef, m"
)
def ratio_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.ratio_cells(_flagged(spark, sf_dir)).select(F.col("ef").cast("long").alias("ef"), F.col("m").cast("long").alias("m"), F.round("ratio", 6).alias("ratio"), "state")


@_query(f"WITH {_MEAS} SELECT block, round(ratio, 6) AS ratio, round(deviation, 6) AS deviation, started, suspect FROM sus")
def suspect_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suspects(spark, sf_dir).select("block", F.round("ratio", 6).alias("ratio"), F.round("deviation", 6).alias("deviation"), "started", "suspect")


@_query(f"WITH {_MEAS}, f AS (SELECT pairs.*, suspect FROM pairs JOIN sus ON sus.block = regexp_replace(params, ',(ef|nprobe)=[0-9]+', '')) SELECT count(*) FILTER (own < other AND NOT suspect) AS wins, count(*) AS pairs FROM f")
def win_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.wins(_flagged(spark, sf_dir))


@_query(f"WITH {_MEAS} SELECT round(ceil(max(abs(own - other) / other) * 1000) / 10, 1) AS gap FROM pairs")
def worst_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.worst_gap(_pairs(spark, sf_dir)).withColumn("gap", F.round("gap", 1))


@_query(f"WITH {_MEAS} SELECT round(min(ratio), 6) AS low, round(max(ratio), 6) AS high FROM blk")
def build_ratio_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.build_ratio_span(harness_rows(spark, sf_dir, "own"), harness_rows(spark, sf_dir, "other"))
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_query(f"WITH {_MEAS} SELECT round(min(ratio), 6) AS low, round(max(ratio), 6) AS high FROM pairs WHERE params LIKE '%ef=64'")
def search_ratio_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.span(_pairs(spark, sf_dir).where("params like '%ef=64'"), [], "ratio")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_query(f"""WITH {_MEAS} SELECT harness, "index", round((max(recall_at_k) FILTER (dataset = 'large') - max(recall_at_k) FILTER (dataset = 'small')) * 100, 4) AS "drop" FROM meas GROUP BY ALL""")
def recall_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recall_drop(measurements(spark, sf_dir), "small", "large").withColumn("drop", F.round("drop", 4))


@_query(f"WITH {_MEAS} SELECT harness, dataset, round((0.99944 - max(recall_at_k)) * 100000, 2) AS slots FROM meas GROUP BY ALL")
def oracle_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.oracle_gap(measurements(spark, sf_dir), 0.99944, ["harness", "dataset"]).withColumn("slots", F.round("slots", 2))


@_query(f"WITH {_MEAS} SELECT round(build_seconds, 3) AS build, params, recall_at_k AS recall FROM meas QUALIFY row_number() OVER (PARTITION BY round(build_seconds, 3) ORDER BY recall_at_k DESC, ord) = 1")
def best_per_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.best_per_build(measurements(spark, sf_dir))


@_query(f"""WITH {_MEAS} SELECT ord, CASE WHEN index_bytes > base_bytes THEN index_bytes - base_bytes ELSE index_bytes END AS index_bytes FROM meas""")
def repaired_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.repair_memory(measurements(spark, sf_dir)).select("ord", "index_bytes")


@_query(
    f"""WITH {_MEAS} SELECT ord, harness || ',' || dataset || ',"hnsw","' || params || '",10,' || printf('%.6f', recall_at_k) || ',' || printf('%.3f', mean_latency_us) || ',' || printf('%.3f', mean_latency_us) || ',' || printf('%.3f', build_seconds) || ','
    || index_bytes || ',' || base_bytes || ',100,3,' || "timestamp" AS line FROM meas"""
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measurements(spark, sf_dir).withColumns({"k": F.lit(10), "p95_latency_us": F.col("mean_latency_us"), "queries": F.lit(100), "runs": F.lit(3)})
    return rows.select("ord", reports.csv_row(rows).alias("line"))


@_query(
    f"""WITH {_MEAS}, grid AS (SELECT 'hnsw' AS family, 'M=' || m || ',efC=' || c || ',ef=' || e AS params FROM unnest([8,16,32]) a(m), unnest([100,200,400]) b(c), unnest([16,32,64,128,256,512]) d(e)
    UNION ALL SELECT 'ivfpq', 'nlist=' || n || ',m=' || m || ',nprobe=' || p FROM unnest([1024,4096]) a(n), unnest([8,16,32]) b(m), unnest([1,4,8,16,32,64]) d(p))
    SELECT family, params FROM grid WHERE NOT EXISTS (SELECT 1 FROM meas WHERE harness = 'own' AND meas.params = grid.params AND family = 'hnsw')"""
)
def sweep_still_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = measurements(spark, sf_dir).where("harness = 'own'").select(F.lit("hnsw").alias("family"), "params").distinct()
    return reports.still_to_run(reports.sweep_grid(spark), done)


@_query(
    "WITH e AS (SELECT quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges FROM lineitem), b AS (SELECT len(list_filter(edges, lambda x: x <= l_extendedprice)) AS bucket, l_extendedprice, l_quantity FROM lineitem, e) "
    "SELECT bucket, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high, round(avg(l_quantity), 6) AS mean FROM b GROUP BY bucket"
)
def deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.deciles(_table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), "l_extendedprice", "l_quantity")
    return out.withColumn("bucket", F.col("bucket").cast("long")).withColumn("mean", F.round("mean", 6))


_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"


@_query(f"SELECT o_orderkey, round(100.0 * (o_totalprice - lag(o_totalprice) {_W}) / lag(o_totalprice) {_W}, 4) AS change, round(first_value(o_totalprice) {_W} / o_totalprice, 6) AS speedup FROM orders")
def step_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.steps(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", F.round("change", 4).alias("change"), F.round("speedup", 6).alias("speedup"))


@_query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_value, arg_max(o_totalprice, o_orderkey) AS last_value, round(arg_min(o_totalprice, o_orderkey) / arg_max(o_totalprice, o_orderkey), 6) AS speedup FROM orders GROUP BY o_custkey")
def cumulative_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_and_last(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").withColumn("speedup", F.round("speedup", 6))


@_query(f"SELECT o_custkey, coalesce(bool_and(d > 0), true) AS rising, coalesce(bool_and(d < 0), true) AS falling FROM (SELECT o_custkey, o_totalprice - lag(o_totalprice) {_W} AS d FROM orders) GROUP BY o_custkey")
def monotone_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.monotone(_table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@_query(f"SELECT o_custkey, NOT bool_or(s = 1 AND NOT f) AS contiguous FROM (SELECT o_custkey, o_totalprice > 150000 AS f, max((o_totalprice > 150000)::INT) {_W} AS s FROM orders) GROUP BY o_custkey")
def contiguous_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("flag", F.col("o_totalprice") > 150000)
    return reports.tail_is_contiguous(rows, ["o_custkey"], "o_orderkey", "flag")


@_query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest(_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@_query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def first_of_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_of_block(_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@_query("SELECT event_type AS frame, count(*) FILTER (event_id % 5 = 0) AS self, count(DISTINCT user_id) AS total FROM events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20")
def hot_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), (F.col("event_id") % 5).alias("depth"), F.col("event_type").alias("frame"))
    return reports.hot_methods(samples, 20)


@_query("SELECT nlist, m, (n * m + 4 * n + 4 * (nlist + 1) + 4 * nlist * 64 + 4 * 64 * 256)::BIGINT AS bytes FROM (SELECT count(*) AS n FROM embeddings), unnest([16::BIGINT, 64::BIGINT]) a(nlist), unnest([8::BIGINT, 16::BIGINT, 32::BIGINT]) b(m)")
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vectors(spark, sf_dir).count()
    rows = [(nlist, m, ivfpq.ivfpq_bytes(n, 64, nlist, m)) for nlist in (16, 64) for m in (8, 16, 32)]
    return spark.createDataFrame(rows, "nlist long, m long, bytes long")
