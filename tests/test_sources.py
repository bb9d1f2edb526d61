import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import ivfpq
from tessel.operators import reports as ops
from tessel.plans import catalog, sweeps
from tessel.sources import reports, vecs


def test_fvecs_round_trip(spark, tmp_path):
    rows = np.linspace(-1, 1, 21 * 6, dtype=np.float32).reshape(21, 6) ** 3
    path = str(tmp_path / "cubes.fvecs")
    vecs.write_vecs(rows, path)
    for place in (path, f"file://{path}"):
        got = {r["id"]: r["vec"] for r in vecs.read_fvecs(spark, place).collect()}
        assert sorted(got) == list(range(21)) and all(np.array_equal(np.float32(got[k]), rows[k]) for k in got)
    assert (vecs.count_vectors(path), vecs.dimension_of(path)) == (21, 6)
    assert sorted(r["id"] for r in vecs.read_fvecs(spark, path, 4).collect()) == [0, 1, 2, 3]


def test_folders_written_by_tasks(spark, tmp_path):
    """A table written in ranges reads back in its order, also in small partitions and cut short; nothing temporary stays."""
    path = f"file://{tmp_path}/squares"
    table = spark.range(40, 0, -1).selectExpr("id AS n", "array(cast(id AS int), cast(id * id AS int))").repartition(5)
    vecs.write_table(table, path, "ivecs")
    assert vecs.count_vectors(path) == 40 and not (tmp_path / "squares" / "_temporary").exists()
    read = spark.read.format("ivecs").option("partitionRecords", 7).load(path)
    assert {r["qid"]: r["neighbours"] for r in read.collect()} == {n - 1: [n, n * n] for n in range(1, 41)}
    assert [r["qid"] for r in vecs.read_ivecs(spark, path, 9).orderBy("qid").collect()] == list(range(9))
    vecs.write_vecs(np.zeros((2, 3), np.int32), str(tmp_path / "squares" / "part-z"))
    with pytest.raises(vecs.VecsError, match="different dimensions"):
        vecs.count_vectors(path)
    with pytest.raises(Exception, match="one dimension"):
        vecs.write_table(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "n long, v array<double>").coalesce(1), f"{tmp_path}/uneven", "fvecs")


def test_bad_files(tmp_path):
    good = struct.pack("<i4f", 4, 1, 2, 3, 4)
    for name, data in {"cut": good[:-3], "short": b"ab", "zero": struct.pack("<i", 0), "huge": struct.pack("<i", 1 << 21)}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(vecs.VecsError):
            vecs.layout_of(str(tmp_path / name))
    ragged = good + struct.pack("<i4f", 3, 1, 2, 3, 4)
    (tmp_path / "ragged").write_bytes(ragged)
    with pytest.raises(vecs.VecsError, match="record 1"):
        list(vecs.read_chunks(str(tmp_path / "ragged"), vecs.layout_of(str(tmp_path / "ragged")), 0, 2, "<f4"))


def test_workloads(spark, tmp_path):
    rng = np.random.default_rng(1)
    root, paths = str(tmp_path), catalog.file_paths(str(tmp_path), "tiny")
    assert catalog.missing(root, "tiny") == ["base", "queries", "truth"]
    (tmp_path / "tiny").mkdir()
    vecs.write_vecs(rng.normal(size=(24, 4)).astype(np.float32), paths["base"])
    vecs.write_vecs(rng.normal(size=(5, 4)).astype(np.float32), paths["queries"])
    vecs.write_vecs(np.array([[4, 9, 2]] * 5, np.int32), paths["truth"])
    assert not catalog.missing(root, "tiny")
    whole = catalog.open_workload(spark, root, "tiny", 4, query_rows=3)
    assert not whole.computed and sorted(map(tuple, whole.truth.collect())) == [(q, r, i) for q in range(3) for r, i in ((1, 4), (2, 9), (3, 2))]
    part = catalog.open_workload(spark, root, "tiny", 4, base_rows=15)
    assert part.computed and part.truth.agg(F.max("id")).first()[0] < 15 and part.truth.count() == 5 * 15
    rows = sweeps.ivfpq_sweep(spark, part, ivfpq.IvfPqConfig(nlist=2, m=2, iterations=2), [1, 2, 5], k=2, runs=1)
    assert [(r["params"], r["p95_latency_us"]) for r in rows.orderBy("params").collect()] == [("nlist=2,m=2,nprobe=1", None), ("nlist=2,m=2,nprobe=2", None)]
    assert ",," in rows.select(ops.csv_row(rows)).first()[0]
    with pytest.raises(vecs.VecsError):
        catalog.open_workload(spark, root, "tiny", 5)
    assert catalog.banner(spark).count() == 5


def test_measurement_csv_round_trip(spark, tmp_path):
    row = ("own", "sift", 'hnsw "fast", v2', "M=16,efC=200,ef=64", 10, 0.9704, 92.0, 117.0, 225.2, 144568308, 512000000, 10000, 3, "2026-01-01T00:00:00Z")
    df = spark.createDataFrame([row], ops.MEASUREMENT)
    reports.append_measurements(df, str(tmp_path / "dir"))
    reports.append_measurements(df, str(tmp_path / "dir"))
    assert [tuple(r) for r in reports.read_measurements(spark, str(tmp_path / "dir")).collect()] == [row, row]
    one = str(tmp_path / "sub" / "one.csv")
    reports.append_csv_file(df, one)
    reports.append_csv_file(df, one)
    assert open(one).read().count("harness") == 1
    assert [tuple(r) for r in reports.read_measurements(spark, one).collect()] == [row, row]


def test_quoting_repair(spark):
    bare = "own,sift,hnsw,M=16,efC=200,ef=64,10,0.9,1.0,2.0,3.0,4,5,6,7,t"
    fixed = 'own,sift,"hnsw","M=16,efC=200,ef=64",10,0.9,1.0,2.0,3.0,4,5,6,7,t'
    df = spark.createDataFrame([(bare,), (fixed,)], "l string")
    assert [r[0] for r in df.select(ops.repair_quoting(F.col("l"))).collect()] == [fixed, fixed]


def test_benchmark_json_later_file_wins(spark, tmp_path):
    for k, score in enumerate((50.0, 25.0)):
        body = [{"benchmark": "b.l2", "params": {"dim": "128"}, "primaryMetric": {"score": score, "scoreUnit": "ns/op"}}]
        (tmp_path / f"{k}.json").write_text(json.dumps(body))
    rows = reports.read_benchmarks(spark, [str(tmp_path / "0.json"), str(tmp_path / "1.json")])
    assert [tuple(r) for r in rows.collect()] == [("b.l2", 128, 25.0, "ns/op")]
    assert reports.benchmark_rates(rows, 1024).first()["rate"] == 4e7


def test_logs_and_stacks(spark, tmp_path):
    (tmp_path / "log").write_text("start\nrecall 0.999440 of 10,000\nend\n")
    got = reports.read_log_numbers(spark, str(tmp_path / "log"), {"recall": r"recall ([0-9.]+)", "n": r"of ([0-9,]+)"}).collect()
    assert [(r["recall"], r["n"]) for r in got] == [(0.99944, 10000.0)]
    (tmp_path / "jfr").write_text("x {\n  stackTrace = [\n    a.b()  line: 1\n    c.d() line: 2\n  ]\n}\ny {\n  stackTrace = [\n    a.b() line: 9\n  ]\n}\n")
    hot = ops.hot_methods(reports.read_stack_samples(spark, str(tmp_path / "jfr")))
    assert [tuple(r) for r in hot.collect()] == [("a.b", 2, 2), ("c.d", 0, 1)]


def test_regions():
    text = "a\n<!-- t:start -->\nold\n<!-- t:end -->\nb"
    assert reports.replace_region(text, "t", "new") == "a\n<!-- t:start -->\nnew\n<!-- t:end -->\nb"
    with pytest.raises(ValueError):
        reports.replace_region(text, "u", "new")
