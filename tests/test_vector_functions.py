import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.functions import params, vectors


def test_sql_and_numpy_kernels_agree(spark):
    rng = np.random.default_rng(3)
    for dim in (1, 2, 7, 16, 33):
        a, b = rng.uniform(-5, 5, (6, dim)), rng.uniform(-5, 5, (6, dim))
        df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))], "i long, a array<double>, b array<double>")
        got = df.select("i", vectors.l2_squared("a", "b").alias("l2"), vectors.inner_product("a", "b").alias("ip"), vectors.negative_inner_product("a", "b").alias("n")).collect()
        for r in got:
            i = r["i"]
            assert r["l2"] == pytest.approx(vectors.distances("l2", a[i : i + 1], b[i : i + 1])[0, 0], rel=1e-12)
            assert r["ip"] == pytest.approx(float(a[i] @ b[i]), rel=1e-9, abs=1e-12)
            assert r["n"] == -r["ip"]


def test_integer_vectors_are_exact(spark):
    df = spark.createDataFrame([([0.0, 16.0, 35.0], [5.0, 32.0, 31.0])], "a array<float>, b array<float>")
    assert df.select(vectors.l2_squared("a", "b")).first()[0] == 25 + 256 + 16


def test_unknown_metric_is_an_error():
    with pytest.raises(ValueError):
        vectors.distance("cosine", F.lit(1), F.lit(1))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=20))
def test_distance_to_itself_is_zero(v):
    a = np.array([v])
    assert vectors.distances("l2", a, a)[0, 0] == 0


def test_residual_subvector_spread_and_tolerance(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1.0, 1.0, 1.0, 1.0], 0.0, 2.0)], "a array<double>, b array<double>, d1 double, dk double")
    r = df.select(vectors.residual("a", "b").alias("r"), vectors.subvector("a", 1, 2).alias("s"), vectors.spread(F.col("d1"), F.col("dk")).alias("x"), vectors.spread(F.col("dk"), F.col("dk")).alias("y")).first()
    assert (r["r"], r["s"], r["x"], r["y"]) == ([0.0, 1.0, 2.0, 3.0], [3.0, 4.0], 1.0, 1.0)
    near = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.1], [1.0, 2.0]), ([0.5, 2.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [x[0] for x in near.select(vectors.not_worse_than("a", "b", 1e-6)).collect()] == [True, False, True]
    assert vectors.accumulation_tolerance(960) == pytest.approx(5.9e-5, rel=0.01)


def test_registered_functions(spark):
    vectors.register(spark)
    assert spark.sql("SELECT l2_squared(array(1D, 2D), array(1D, 4D)), inner_product(array(1D, 2D), array(3D, 4D))").first()[:] == (4.0, 11.0)


def test_params(spark):
    df = spark.createDataFrame([("M=16,efC=200,ef=64",), ("nlist=1024,m=8,nprobe=4",)], "p string")
    got = df.select(params.number("p", "M"), params.number("p", "ef"), params.block("p"), F.element_at(params.parse("p"), "m")).collect()
    assert [tuple(r) for r in got] == [(16, 64, "M=16,efC=200", None), (None, None, "nlist=1024,m=8", "8")]
    one = F.lit(8)
    named = df.limit(1).select(params.hnsw_name(one, one, one, F.lit(True)), params.ivfpq_name(one, one, one, F.lit(False))).first()
    assert tuple(named) == ("M=8,efC=8,ef=8,sel=nearestM", "nlist=8,m=8,nprobe=8")
    with pytest.raises(ValueError):
        params.check_divides(10, 4)
