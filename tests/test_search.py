import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import evaluation, hnsw, ivfpq, kmeans, knn, pq
from tessel.operators.hnsw_graph import HnswConfig, HnswGraph


def frame(spark, rows, key="id"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], f"{key} long, vec array<double>")


def clustered(n, dim, centres, sigma, seed):
    rng = np.random.default_rng(seed)
    c = rng.uniform(0, 100, (centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(0, sigma, (n, dim))


def brute(queries, base, k):
    d = ((queries[:, None, :] - base[None, :, :]) ** 2).sum(axis=2)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def ids_of(found):
    out = {}
    for r in found.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def test_exact_search_matches_brute_force_and_sql(spark):
    base, queries = clustered(700, 8, 10, 5, 1), clustered(9, 8, 10, 5, 2)
    b, q = frame(spark, base), frame(spark, queries, "qid")
    want = {i: x.tolist() for i, x in enumerate(brute(queries, base, 5))}
    assert ids_of(knn.knn(q, b, 5)) == want
    assert ids_of(knn.knn_sql(q, b, 5)) == want


def test_exact_search_edges(spark):
    one = frame(spark, np.array([[1.0, 2.0, 3.0, 4.0]]))
    q = frame(spark, np.array([[1.0, 2.0, 3.0, 4.0]]), "qid")
    got = knn.knn(q, one, 5).collect()
    assert [(r["rank"], r["id"], r["dist"]) for r in got] == [(1, 0, 0.0)]
    assert knn.knn(q, one.where("id < 0"), 5).count() == 0
    assert knn.knn(q.where("qid < 0"), one, 5).count() == 0
    same = frame(spark, np.zeros((6, 4)))
    assert ids_of(knn.knn(frame(spark, np.zeros((1, 4)), "qid"), same, 3)) == {0: [0, 1, 2]}
    with pytest.raises(Exception, match="dimensions"):
        knn.knn(frame(spark, np.zeros((1, 3)), "qid"), same, 3).collect()
    with pytest.raises(ValueError):
        knn.knn(q, one, 0)


def test_unit_vectors_rank_alike_by_both_metrics(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    b, q = frame(spark, v), frame(spark, v[:5], "qid")
    assert ids_of(knn.knn(q, b, 4)) == ids_of(knn.knn(q, b, 4, "inner_product"))


def test_kmeans_recovers_separated_clusters(spark):
    rng = np.random.default_rng(4)
    centres = np.arange(6)[:, None] * np.full((6, 8), 1000.0)
    rows = np.repeat(centres, 40, axis=0) + rng.normal(size=(240, 8))
    fit = kmeans.fit_kmeans(frame(spark, rows), 6, iterations=10)
    assert fit.inertia / 240 < 20
    got = kmeans.assign(frame(spark, rows), fit.centroids).collect()
    assert len({r["list_id"] for r in got}) == 6
    for c in range(6):
        assert len({r["list_id"] for r in got if r["id"] // 40 == c}) == 1


def test_kmeans_edges(spark):
    rng = np.random.default_rng(4)
    rows = rng.uniform(0, 1, (20, 3))
    assert kmeans.fit_kmeans(frame(spark, rows), 20, init=kmeans.RANDOM_SAMPLE).inertia == pytest.approx(0, abs=1e-12)
    for k in (0, 21):
        with pytest.raises(ValueError):
            kmeans.fit_kmeans(frame(spark, rows), k)
    # two far rows, three centroids of which two are empty: each takes another farthest row
    data = np.array([[0.0], [1.0], [10.0], [20.0]])
    new, _ = kmeans.lloyd_step(frame(spark, data), np.array([[0.0], [500.0], [900.0]]))
    assert new[1:].tolist() == [[20.0], [10.0]]


def test_product_quantizer(spark):
    rng = np.random.default_rng(6)
    rows = rng.normal(0, 10, (400, 16))
    df = frame(spark, rows)
    errors = []
    for m in (2, 4, 8):
        q = pq.train_pq(df, m, iterations=4)
        codes = q.encode(rows)
        back = q.decode(codes)
        errors.append(((rows - back) ** 2).sum())
        query = rng.normal(0, 10, 16)
        assert np.allclose(q.scan(q.tables(query), codes), ((back - query) ** 2).sum(axis=1))
    assert errors[0] > errors[1] > errors[2]
    got = {r["id"]: r["code"] for r in pq.pq_encode(df, q).collect()}
    assert all(got[i] == codes[i].tolist() for i in range(400))
    decoded = {r["id"]: r["vec"] for r in pq.pq_decode(pq.pq_encode(df, q), q).collect()}
    assert np.allclose(decoded[7], back[7])
    with pytest.raises(ValueError):
        pq.train_pq(df, 5)


def test_ivfpq_recall_rises_with_probes(spark):
    base = clustered(1500, 16, 20, 25, 1)
    queries = clustered(20, 16, 20, 25, 2)
    b, q = frame(spark, base).persist(), frame(spark, queries, "qid")
    index = ivfpq.build_ivfpq(b, ivfpq.IvfPqConfig(nlist=12, m=8, iterations=5))
    truth = knn.knn(q, b, 10).persist()
    recalls = [evaluation.mean_recall(ivfpq.search_ivfpq(index.with_nprobe(n), q, 10), truth, 10).first()[0] for n in (1, 4, 12)]
    assert recalls == sorted(recalls) and recalls[-1] > 0.5
    assert sum(r["size"] for r in index.list_sizes().collect()) == 1500
    assert index.with_nprobe(99).config.nprobe == 12
    assert ivfpq.ivfpq_bytes(1_000_000, 128, 1024, 16) == 20_659_460
    with pytest.raises(ValueError):
        ivfpq.IvfPqConfig(metric="inner_product")


def test_graph_search_and_invariants():
    base, queries = clustered(1200, 16, 20, 3, 1), clustered(50, 16, 20, 3, 2)
    graph = HnswGraph.build(base, HnswConfig(8, 60, 60))
    want = brute(queries, base, 10)
    found = [[e for _, e in graph.search(q, 10)] for q in queries]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, want.tolist(), strict=True)]) > 0.9
    for layer, node, links in graph.edges():
        assert len(links) <= graph.config.max_degree(layer) and node not in links and len(set(links)) == len(links)
    graph.connect()
    assert graph.reachable().all()
    assert HnswGraph.build(np.empty((0, 4)), HnswConfig()).search(np.zeros(4), 3) == []
    single = HnswGraph.build(np.array([[1.0, 2.0, 3.0, 4.0]]), HnswConfig())
    assert single.search(np.array([1.0, 2.0, 3.0, 4.0]), 5) == [(0.0, 0)]
    near = HnswGraph.build(base[:300], HnswConfig(8, 60, 60, selection="nearest"))
    assert near.config.short_name() == "M=8,efC=60,ef=60,sel=nearestM"


def test_sharded_graph(spark):
    base, queries = clustered(600, 8, 10, 5, 1), clustered(12, 8, 10, 5, 2)
    b, q = frame(spark, base), frame(spark, queries, "qid")
    index = hnsw.build_hnsw(b, HnswConfig(8, 40, 40), shards=3)
    truth = knn.knn(q, b, 10)
    assert evaluation.mean_recall(hnsw.search_hnsw(index, q, 10), truth, 10).first()[0] > 0.9
    assert index.meta.agg(F.sum("count")).first()[0] == 600
    assert index.edge_count() > 600
    stats = hnsw.degree_stats(index.adjacency).first()
    assert stats["max_degree"] <= 16
    assert hnsw.hnsw_bytes(1_000_000, 16, 0) == 4 * (1_000_000 * 33 + 2_000_000)


def test_graph_diagnostics(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2), (4, 0)], "src long, dst long")
    entry = spark.createDataFrame([(0,)], "node long")
    r = hnsw.diagnostics(nodes, edges, entry).first()
    assert (r["nodes"], r["edges"], r["orphans"], r["isolated"], r["fragmented"]) == (6, 5, 2, 4, 2)


def test_heuristic_selection():
    v = {0: np.array([1.0, 0.0]), 1: np.array([1.1, 0.0]), 2: np.array([0.0, 2.0])}
    assert hnsw.select_heuristic([(1.0, 0), (1.21, 1), (4.0, 2)], v, 3) == [0, 2]


def test_sql_form_takes_any_number_of_queries(spark):
    q = spark.range(20_050).selectExpr("id AS qid", "array(double(id), double(id % 7)) AS vec")
    base = spark.range(0, 20_050, 401).selectExpr("id", "array(float(id), 0F) AS vec")
    for metric in ("l2", "inner_product"):
        got = {(r["qid"], r["rank"]): (r["id"], r["dist"]) for r in knn.knn_sql(q, base, 2, metric).collect()}
        assert got == {(r["qid"], r["rank"]): (r["id"], r["dist"]) for r in knn.knn(q, base, 2, metric).collect()}
        assert len(got) == 2 * 20_050


def test_beams_of_many_queries_find_what_each_finds():
    rng = np.random.default_rng(9)
    base = rng.normal(size=(600, 12))
    base = np.concatenate([base, base[:60].repeat(3, axis=0) + rng.normal(0, 0.05, (180, 12))])
    graph = HnswGraph.build(base, HnswConfig(m=6, ef_construction=32))
    queries = np.concatenate([base[:300], rng.normal(size=(40, 12))])
    for ef in (1, 8, 200):
        got = graph.within_each(queries, 1.0, ef)
        assert [sorted(g.tolist()) for g in got] == [sorted(graph.within(q, 1.0, ef)[0].tolist()) for q in queries]
    assert graph.within_each(queries[:0], 1.0, 8) == []
    assert [len(g) for g in HnswGraph(base[:0], HnswConfig()).within_each(queries[:2], 1.0, 8)] == [0, 0]
