"""Registered queries of what is trained, built or written to files, with SQL.

Trained states can't be said in SQL; what must hold of them can. Such a query works a state out, recomputes each row of
it by another way (SQL expressions beside the tasks' matrices), and counts the rows that agree; its SQL counts all
rows of the table. Queries of sources write the tables as files of the format, read them back, and are held against the tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import params
from .functions.vectors import l2_squared
from .operators import evaluation, hnsw, ivfpq, kmeans, knn, pq, reports
from .operators.hnsw_graph import HnswConfig
from .queries import _CENT, _KNN, _MEAS, _V, K, _found, _query, _table, asked, knn_graph, mean_matrix, measurements, vectors
from .sources import reports as files
from .sources import vecs
from .storage import shared_folder

CLUSTERS = 16
GRAPH = HnswConfig(16, 100, 64)


# vector files

_RECORDS = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, len(embedding)::INTEGER AS dim, embedding[1]::DOUBLE AS first, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings"


def _as_fvecs(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "fvecs")
    vecs.write_table(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path, "fvecs")
    return path


def _records(rows: DataFrame) -> DataFrame:
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.size("vec").alias("dim"), F.get("vec", F.lit(0)).cast("double").alias("first"), F.round(total, 6).alias("total"))


@_query(_RECORDS)
def fvecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(vecs.read_fvecs(spark, _as_fvecs(spark, sf_dir)))


@_query(f"SELECT * FROM ({_RECORDS}) WHERE id < 123")
def fvecs_first_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs.register(spark)
    return _records(spark.read.format("fvecs").option("maxVectors", 123).option("partitionRecords", 50).load(_as_fvecs(spark, sf_dir)))


@_query("SELECT 1::BIGINT AS files_dimensions, count(*) AS records, max(len(embedding))::BIGINT AS dim FROM embeddings")
def fvecs_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the files' sizes and heads alone."""
    path = _as_fvecs(spark, sf_dir)
    dims = {at.dim for _, at in vecs.layouts(path)}
    return spark.createDataFrame([(len(dims), vecs.count_vectors(path), vecs.dimension_of(path))], "files_dimensions long, records long, dim long")


@_query(f"WITH {_V}, {_KNN} SELECT dense_rank() OVER (ORDER BY qid) - 1 AS qid, rank, id FROM truth")
def ivecs_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of the queries as a truth file, read back."""
    near = knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), K)
    lists = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("int")).alias("ids"))
    path = shared_folder(spark, "ivecs")
    vecs.write_table(lists, path, "ivecs")
    return vecs.read_ivecs(spark, path).select("qid", F.posexplode("neighbours").alias("p", "id")).select("qid", (F.col("p") + 1).cast("long").alias("rank"), F.col("id").cast("long").alias("id"))


# report files


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measurements(spark, sf_dir).withColumns({"k": F.lit(10), "p95_latency_us": F.lit(None).cast("double"), "queries": F.lit(100), "runs": F.lit(3)})


@_query(f"""WITH {_MEAS} SELECT harness, dataset, "index", params, 10 AS k, round(recall_at_k, 6) AS recall, round(mean_latency_us, 3) AS latency, index_bytes, "timestamp" AS at FROM meas""")
def measurement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders of CSV, one appended to twice, read as one."""
    rows, a, b = _measured(spark, sf_dir), shared_folder(spark, "csv"), shared_folder(spark, "csv")
    for some, path in (("harness = 'own' and dataset = 'small'", a), ("harness = 'own' and dataset = 'large'", a), ("harness = 'other'", b)):
        files.append_measurements(rows.where(some), path)
    back = files.read_measurements(spark, a, b)
    return back.select("harness", "dataset", "index", "params", "k", F.round("recall_at_k", 6).alias("recall"), F.round("mean_latency_us", 3).alias("latency"), "index_bytes", F.col("timestamp").alias("at"))


@_query(f"""WITH {_MEAS} SELECT ord, harness || ',' || dataset || ',"hnsw","' || params || '",10,' || index_bytes AS line FROM meas""")
def quoting_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of which every second one has its fields written bare."""
    rows = measurements(spark, sf_dir)
    bare = lambda c: F.when(F.col("ord") % 2 == 0, F.col(c)).otherwise(reports.quoted(F.col(c)))
    line = F.concat_ws(",", "harness", "dataset", bare("index"), bare("params"), F.lit("10"), F.col("index_bytes").cast("string"))
    return rows.select("ord", reports.repair_quoting(line).alias("line"))


@_query(f"WITH {_V}, {_KNN} SELECT qid AS query, round(sqrt(max(dist) FILTER (rank = 1)), 4) AS d1, round(sqrt(max(dist) FILTER (rank = 10)), 4) AS dk FROM truth GROUP BY qid")
def per_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "per-query")
    files.write_per_query(evaluation.failure_analysis(*_found(spark, sf_dir), K, hnsw.orphans(*knn_graph(spark, sf_dir))), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("query").cast("long").alias("query"), *(F.col(c).cast("double").alias(c) for c in ("d1", "dk")))


@_query(
    "WITH a AS (SELECT p_brand AS benchmark, p_size AS param, min(p_retailprice) AS score FROM part GROUP BY ALL), b AS (SELECT p_brand AS benchmark, p_size AS param, max(p_retailprice) + 1 AS score FROM part WHERE p_size <= 25 GROUP BY ALL), "
    "m AS (SELECT benchmark, param, coalesce(b.score, a.score) AS score FROM a LEFT JOIN b USING (benchmark, param)) "
    "SELECT benchmark, param, round(score, 6) AS score, round(1e9 / score, 3) AS rate, round(first_value(score) OVER (PARTITION BY param ORDER BY benchmark) / score, 6) AS speedup, round(64 / score, 6) AS gb_s FROM m"
)
def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two microbenchmark files, the later of which overrides some results of the earlier, as a table of rates."""
    part, paths = _table(spark, sf_dir, "part"), []
    for some, score in (("true", F.min("p_retailprice")), ("p_size <= 25", F.max("p_retailprice") + 1)):
        rows = part.where(some).groupBy("p_brand", "p_size").agg(score.alias("s"))
        one = F.struct(F.col("p_brand").alias("benchmark"), F.create_map(F.lit("dim"), F.col("p_size").cast("string")).alias("params"), F.struct(F.col("s").alias("score"), F.lit("ns/op").alias("scoreUnit")).alias("primaryMetric"))
        paths.append(shared_folder(spark, "benchmarks"))
        # a results file is one array; brands times sizes bound it
        rows.agg(F.to_json(F.collect_list(one)).alias("value")).write.text(paths[-1])
    rates = files.benchmark_rates(files.read_benchmarks(spark, paths), 64)
    return rates.select("benchmark", "param", F.round("score", 6).alias("score"), F.round("rate", 3).alias("rate"), F.round("speedup", 6).alias("speedup"), F.round("gb_s", 6).alias("gb_s"))


@_query("SELECT o_orderkey::DOUBLE AS number, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 2) END AS total FROM orders WHERE o_orderkey % 2 = 0")
def log_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    total = F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(", total "), F.format_number("o_totalprice", 2)))
    line = F.when(key % 2 == 0, F.concat(F.lit("run "), key.cast("string"), total)).otherwise(F.lit("nothing to see"))
    path = shared_folder(spark, "log")
    _table(spark, sf_dir, "orders").select(line.alias("value")).write.text(path)
    return files.read_log_numbers(spark, path, {"number": r"run ([0-9]+)", "total": r"total ([0-9,.]+)"}).select("number", F.round("total", 2).alias("total"))


@_query(
    "WITH f AS (SELECT event_id, 'app.' || event_type AS frame, 0 AS depth FROM events UNION ALL SELECT event_id, 'user.u' || user_id % 3, 1 FROM events UNION ALL SELECT event_id, 'app.' || event_type, 2 FROM events WHERE event_id % 2 = 0) "
    "SELECT frame, count(*) FILTER (depth = 0) AS self, count(DISTINCT event_id) AS total FROM f GROUP BY frame"
)
def stack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stack samples of two or three frames, one an event; a frame that stands twice in a sample counts once."""
    e = _table(spark, sf_dir, "events")
    top, user = F.concat(F.lit("    app."), F.col("event_type"), F.lit("() line: 1")), F.concat(F.lit("    user.u"), (F.col("user_id") % 3).cast("string"), F.lit("(int) line: 22"))
    again = F.when(F.col("event_id") % 2 == 0, top)
    path = shared_folder(spark, "stacks")
    e.select(F.concat_ws("\n", F.lit("sample {"), F.lit("  stackTrace = ["), top, user, again, F.lit("  ]"), F.lit("}")).alias("value")).write.text(path)
    return reports.hot_methods(files.read_stack_samples(spark, path), 1000)


_IVF_MEAS = """m AS (SELECT p_partkey % 2 = 0 AS own, p_size <= 25 AS small, 'nlist=' || [1024, 4096][p_size % 2 + 1] || ',m=' || [8, 16, 32][p_partkey // 2 % 3 + 1] || ',nprobe=' || [1, 4, 16, 64][p_partkey // 6 % 4 + 1] AS params, p_retailprice AS us, p_size / 50.0::DOUBLE AS recall, p_partkey AS ord,
  p_partkey % 5 <> 0 AS lists FROM part), f AS (SELECT * FROM m WHERE lists QUALIFY row_number() OVER (PARTITION BY own, params ORDER BY ord) = 1), pr AS (SELECT a.params, a.us / b.us AS ratio FROM f a JOIN f b USING (params) WHERE a.own AND NOT b.own)"""


def _list_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of which four of five are of inverted lists."""
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    name = params.ivfpq_name(pick((1024, 4096), size % 2), pick((8, 16, 32), F.floor(key / 2) % 3), pick((1, 4, 16, 64), F.floor(key / 6) % 4))
    family = F.when(key % 5 != 0, F.when(key % 2 == 0, "IVF-PQ").otherwise("ivfpq")).otherwise("hnsw")
    rows = _table(spark, sf_dir, "part").select(F.when(key % 2 == 0, "own").otherwise("other").alias("harness"), family.alias("index"), name.alias("params"), F.col("p_retailprice").alias("mean_latency_us"), (size / 50.0).alias("recall_at_k"), key.alias("ord"))
    return rows.where(params.is_ivfpq(F.col("index")) & ~params.is_hnsw(F.col("index")))


def _list_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _list_measurements(spark, sf_dir)
    own, other = (reports.first_of_block(rows.where(F.col("harness") == h), ["params"], "ord") for h in ("own", "other"))
    return reports.ratios(own, other, "mean_latency_us")


@_query(f"WITH {_IVF_MEAS} SELECT round(min(ratio), 6) AS low, round(max(ratio), 6) AS high FROM pr WHERE params LIKE '%,nprobe=64'")
def list_search_ratio_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = params.number(F.col("params"), "nprobe") == 64
    out = reports.span(_list_pairs(spark, sf_dir).where(at), [], "ratio")
    return out.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@_query(f"WITH {_IVF_MEAS} SELECT own, regexp_replace(params, ',nprobe=.*', '') AS block, count(*) AS rows, round(max(recall), 6) AS best FROM m WHERE lists GROUP BY ALL")
def list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _list_measurements(spark, sf_dir)
    return rows.groupBy((F.col("harness") == "own").alias("own"), params.block("params").alias("block")).agg(F.count("*").alias("rows"), F.round(F.max("recall_at_k"), 6).alias("best"))


# k-means


@_query("SELECT * FROM (VALUES ('kmeans++', 16::BIGINT, 16::BIGINT, true), ('random', 16::BIGINT, 16::BIGINT, true)) t(method, seeds, rows_of_the_table, repeatable)")
def kmeans_seedings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds are different rows of the table, and the same again for the same seed of the generator."""
    v, out = vectors(spark, sf_dir), []
    held = np.array([r["vec"] for r in kmeans.sample(v.select("id", "vec"), 300).orderBy("id").collect()], np.float64)
    for name, draw in (("kmeans++", lambda: kmeans.plus_plus_seeds(held, CLUSTERS)), ("random", lambda: kmeans.random_seeds(v, CLUSTERS))):
        seeds = draw()
        table = spark.createDataFrame([(s.tolist(),) for s in seeds], "seed array<double>")
        own = v.select(F.transform("vec", lambda x: x.cast("double")).alias("seed"))
        out.append((name, len(seeds), table.distinct().join(own, "seed", "left_semi").count(), bool((seeds == draw()).all())))
    return spark.createDataFrame(out, "method string, seeds long, rows_of_the_table long, repeatable boolean")


@_query("SELECT range AS step, true AS falls FROM range(1, 6)")
def kmeans_inertia_falls(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    centroids, seen = kmeans.random_seeds(v, CLUSTERS), []
    for _ in range(6):
        centroids, inertia = kmeans.lloyd_step(v, centroids)
        seen.append(inertia)
    return spark.createDataFrame([(k, seen[k] <= seen[k - 1]) for k in range(1, 6)], "step long, falls boolean")


@_query(f"WITH {_V}, {_CENT}, far AS (SELECT id, min(list_distance(v.vec, cent.vec) ** 2) AS dist FROM v, cent GROUP BY id) SELECT id FROM far ORDER BY round(dist, 9) DESC, id LIMIT 1")
def empty_cluster_reseeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centroid that no row is near moves onto the row farthest from its own."""
    means = mean_matrix(spark, sf_dir)
    new, _ = kmeans.lloyd_step(vectors(spark, sf_dir), np.vstack([means, np.full((1, means.shape[1]), 1e6)]))
    at = spark.createDataFrame([(new[-1].tolist(),)], "seed array<double>")
    return vectors(spark, sf_dir).join(at, F.transform("vec", lambda x: x.cast("double")) == F.col("seed"), "left_semi").agg(F.min("id").alias("id"))


@_query("SELECT count(*) AS rows, count(*) AS nearest, true AS centroids_are_means FROM embeddings")
def kmeans_fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit run to its end: every row is with its nearest centroid by the SQL kernel, and centroids are their rows' means."""
    v = vectors(spark, sf_dir)
    fit = kmeans.fit_kmeans(v, CLUSTERS, iterations=100)
    own = kmeans.assign(v, fit.centroids)
    by_sql = _nearest(v, _centroid_table(spark, fit.centroids)).withColumnRenamed("list_id", "nearest")
    n = own.join(by_sql, "id").agg(F.count("*").alias("rows"), F.count_if(F.col("list_id") == F.col("nearest")).alias("nearest"))
    cells = own.join(v, "id").select("list_id", F.posexplode("vec").alias("pos", "x")).groupBy("list_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    given = _centroid_table(spark, fit.centroids).select("list_id", F.posexplode("centroid").alias("pos", "c"))
    off = cells.join(given, ["list_id", "pos"]).agg(F.max(F.abs(F.col("mean") - F.col("c"))).alias("off")).first()["off"]
    return n.withColumn("centroids_are_means", F.lit(off < 1e-3))


def _centroid_table(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list_id int, centroid array<double>")


def _nearest(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """id, list_id by SQL expressions; the few centroids are sent as one array."""
    table = centroids.agg(F.array_sort(F.collect_list(F.struct("list_id", "centroid"))).alias("table"))
    far: Column = F.transform("table", lambda c: F.struct(l2_squared(F.col("vec"), c["centroid"]).alias("d"), c["list_id"].alias("list_id")))
    return rows.join(F.broadcast(table)).select("id", F.array_min(far)["list_id"].alias("list_id"))


# trained indexes


@_query("SELECT count(*) AS postings, count(DISTINCT vec_id) AS ids, count(*) AS nearest_list, count(*) * 8 AS nearest_codes, 16::BIGINT AS lists, 256::BIGINT AS codewords FROM embeddings")
def trained_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained index: each row once, in its nearest list, each residual's parts with their nearest codewords, by SQL kernels."""
    v = vectors(spark, sf_dir)
    index = ivfpq.build_ivfpq(v, ivfpq.IvfPqConfig(nlist=16, m=8, nprobe=8, iterations=4))
    held = index.postings.join(_nearest(v, _centroid_table(spark, index.centroids)).withColumnRenamed("list_id", "nearest"), "id")
    lists = held.agg(F.count("*").alias("postings"), F.count_distinct("id").alias("ids"), F.count_if(F.col("list_id") == F.col("nearest")).alias("nearest_list")).first()
    rest = ivfpq.residuals(v, index.centroids).select("id", "vec")
    best = pq.pq_encode_sql(rest, index.pq.frame(spark), index.pq.m).select("id", "subspace", F.col("code").alias("by_sql"))
    codes = index.postings.select("id", F.posexplode("code").alias("subspace", "code")).join(best, ["id", "subspace"])
    right = codes.where("code = by_sql").count()
    words = max(len(np.unique(b, axis=0)) for b in index.pq.codebooks)
    return spark.createDataFrame([(*lists, right, len(index.centroids), words)], "postings long, ids long, nearest_list long, nearest_codes long, lists long, codewords long")


@_query("SELECT vec_id AS qid, 10::BIGINT AS found, true AS all_lists_no_worse FROM embeddings WHERE vec_id % 20 = 0")
def probe_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index searched with one list and with all: all lists give k rows, and each no farther than one list's of its rank."""
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    index = ivfpq.build_ivfpq(v, ivfpq.IvfPqConfig(nlist=16, m=8, nprobe=1, iterations=4))
    one, all_ = (ivfpq.search_ivfpq(index.with_nprobe(p), q, K) for p in (1, 100))
    met = all_.select("qid", "rank", F.col("dist").alias("d")).join(one, ["qid", "rank"], "left")
    return met.groupBy("qid").agg(F.count("*").alias("found"), F.bool_and(F.coalesce(F.col("d") <= F.col("dist") + 1e-9, F.lit(True))).alias("all_lists_no_worse"))


@_query("SELECT count(*) AS nodes, 2::BIGINT AS entries, 0::BIGINT AS over_degree, 0::BIGINT AS loops, 0::BIGINT AS strangers, 0::BIGINT AS twice, 0::BIGINT AS gaps FROM embeddings")
def graph_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of two shards: every row a node, an entry a shard on its top layer, links within caps, to other nodes of the same
    shard and layer, none twice; a node of a layer stands on all layers below."""
    index = hnsw.build_hnsw(vectors(spark, sf_dir), GRAPH, shards=2)
    adj, nodes = index.adjacency, index.nodes()
    caps = F.when(F.col("layer") == 0, GRAPH.max_degree(0)).otherwise(GRAPH.max_degree(1))
    links = adj.select("shard", "layer", "node", F.explode("neighbours").alias("to"))
    known = adj.select("shard", "layer", F.col("node").alias("to"))
    own = adj.agg(F.count_distinct("node").alias("nodes"), F.count_if(F.size("neighbours") > caps).alias("over_degree"), F.count_if(F.array_contains("neighbours", F.col("node"))).alias("loops"), F.count_if(F.size(F.array_distinct("neighbours")) < F.size("neighbours")).alias("twice")).first()
    strangers = links.join(known, ["shard", "layer", "to"], "left_anti").count()
    entries = index.meta.join(nodes.withColumnRenamed("node", "entry_point"), ["shard", "entry_point"]).where("level = top_layer").count()
    gaps = adj.groupBy("shard", "node").agg(F.count("*").alias("n"), F.max("layer").alias("top")).where("n <> top + 1").count()
    index.adjacency.unpersist()
    return spark.createDataFrame([(own["nodes"], entries, own["over_degree"], own["loops"], strangers, own["twice"], gaps)], "nodes long, entries long, over_degree long, loops long, strangers long, twice long, gaps long")


@_query("SELECT * FROM (VALUES (10, true, true), (64, true, true), (256, true, true)) t(ef, whole_answers, near_enough)")
def graph_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build searched with three beams: k answers a query, and a recall of 0.6, 0.9 and 0.97 at least."""
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    truth, index, out = knn.knn(q, v, K).persist(), hnsw.build_hnsw(v, GRAPH), []
    for ef, least in ((10, 0.6), (64, 0.9), (256, 0.97)):
        found = hnsw.search_hnsw(index.with_ef_search(ef), q, K).persist()
        whole = found.groupBy("qid").count().where(F.col("count") != K).count() == 0
        out.append((ef, whole, evaluation.mean_recall(found, truth, K).first()[0] >= least))
        found.unpersist()
    truth.unpersist()
    return spark.createDataFrame(out, "ef int, whole_answers boolean, near_enough boolean")


@_query(f"WITH {_V} SELECT qid, rank, id FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY list_distance(q.vec, v.vec) ** 2, id) AS rank FROM q, v WHERE id % 50 = 7)")
def short_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k beyond the rows of the base: all of them, ranked."""
    base = vectors(spark, sf_dir).where("id % 50 = 7")
    return knn.knn(asked(spark, sf_dir), base, 100_000).select("qid", F.col("rank").cast("long").alias("rank"), "id")
