"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and its neighbours.

    The minimum is pre-aggregated before its shuffle; the join back is a sort-merge join on u
    whose hot keys adaptive execution splits.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return pairs.join(least, F.col("a") == F.col("k")).select("a", "b", "m")


def _rounds(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step; edges keep a > b."""
    near = _with_least(_both(edges))
    large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    small = _with_least(large)
    hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); component: the smallest node reachable.

    Null ends and loops are ignored; repeated edges count once. An empty table gives an empty
    one. Each round is a table in the shared folder, so a lost executor repeats one round only.
    At the fixed point every edge joins a node to the smallest of its component.
    """
    now = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        after = materialise(_rounds(now), "edges")
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    star = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = star.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    out._tessel_path = now._tessel_path  # for discard()
    return out
