"""Column functions of vectors: distances, residuals, subvectors. All compute in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

L2, INNER_PRODUCT = "l2", "inner_product"
METRICS = (L2, INNER_PRODUCT)


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences; the root is never taken."""
    return _total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def negative_inner_product(a: Column | str, b: Column | str) -> Column:
    return -inner_product(a, b)


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    """The distance by which smaller is nearer."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return l2_squared(a, b) if metric == L2 else negative_inner_product(a, b)


def residual(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def subvector(vec: Column | str, subspace: Column | int, size: int) -> Column:
    """Components of a subspace, counted from 0."""
    start = (F.lit(subspace) if isinstance(subspace, int) else subspace) * size + 1
    return F.slice(vec, start, F.lit(size))


def spread(d1: Column, dk: Column) -> Column:
    """Distance ratio of the k-th and the first neighbour; 1 where the first is at distance 0."""
    return F.when(d1 == 0, F.lit(1.0)).otherwise(dk / d1)


def accumulation_tolerance(dim: int) -> float:
    """Relative error that float32 sums of dim terms may have."""
    return 16 * dim**0.5 * 2.0**-23


def not_worse_than(mine: Column | str, theirs: Column | str, tolerance: float) -> Column:
    """Whether no distance of mine exceeds the one at its rank in theirs by more than the tolerance."""
    within = lambda a, b: a <= b + F.lit(tolerance) * F.greatest(F.lit(1e-12), F.abs(b))
    return F.forall(F.zip_with(mine, theirs, within), lambda ok: ok)


def distances(metric: str, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distances [query, base row] of float64 matrices, the numpy twin of `distance`.

    Squared L2 is summed over differences, not expanded, so near distances keep their digits.
    """
    if metric == INNER_PRODUCT:
        return -(queries @ base.T)
    out = np.empty((len(queries), len(base)))
    for k, q in enumerate(queries):
        d = base - q
        out[k] = np.einsum("ij,ij->i", d, d)
    return out


def register(spark: SparkSession) -> None:
    """The scalar functions as SQL functions l2_squared, inner_product, negative_inner_product."""
    for name, body in {
        "l2_squared": "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)",
        "inner_product": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        "negative_inner_product": "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    }.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
