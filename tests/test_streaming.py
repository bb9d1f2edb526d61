import numpy as np

from tessel.operators.hnsw_graph import HnswConfig
from tessel.operators.knn import knn
from tessel.plans import catalog, sweeps
from tessel.streaming.search import search_stream


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{key} long, vec array<double>")


def test_stream_of_queries(spark, tmp_path):
    rng = np.random.default_rng(1)
    base, queries = frame(spark, rng.normal(size=(80, 4))), frame(spark, rng.normal(size=(6, 4)), "qid")
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    search_stream(stream, base, 3, lambda found, n: found.write.mode("append").parquet(out), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, knn(queries, base, 3).collect()))


def test_resumable_sweep(spark):
    rng = np.random.default_rng(2)
    base, queries = frame(spark, rng.normal(size=(120, 8))).persist(), frame(spark, rng.normal(size=(5, 8)), "qid").persist()
    bench = catalog.Workload("tiny", base, queries, knn(queries, base, 10).persist())
    grid = spark.createDataFrame([("hnsw", "M=4,efC=20,ef=16"), ("hnsw", "M=4,efC=20,ef=32"), ("ivfpq", "nlist=4,m=3,nprobe=2")], "family string, params string")
    done = spark.createDataFrame([("hnsw", "M=4,efC=20,ef=16")], "family string, params string")
    rows = []
    assert sweeps.full_sweep(spark, bench, done, lambda df: rows.extend(df.collect()), grid, k=5, runs=1) == 1  # 3 doesn't divide 8
    assert [(r["index"], r["params"], r["k"], r["queries"]) for r in rows] == [("hnsw", "M=4,efC=20,ef=32", 5, 5)]
    assert 0.5 <= rows[0]["recall_at_k"] <= 1 and rows[0]["base_bytes"] == 120 * 8 * 4
    assert HnswConfig().max_degree(0) == 32
