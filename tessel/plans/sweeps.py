"""Parameter sweeps: one build, many searches, measured as batches and resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from ..functions.params import block
from ..operators.evaluation import mean_recall
from ..operators.hnsw import build_hnsw, hnsw_bytes, search_hnsw
from ..operators.hnsw_graph import HnswConfig
from ..operators.ivfpq import IvfPqConfig, build_ivfpq, search_ivfpq, train_coarse
from ..operators.reports import MEASUREMENT, still_to_run, sweep_grid
from .catalog import Workload


def measure(search: Callable[[], DataFrame], truth: DataFrame, k: int, queries: int, runs: int = 3) -> tuple[float, float, None]:
    """(mean recall, median microseconds a query, no percentile) of whole passes over the queries, after one that isn't counted.

    A pass is a batch job, so time is the batch's divided by its queries, and no query has a latency of its own.
    """
    found = search().persist()
    recall = mean_recall(found, truth, k).first()[0]
    found.unpersist()
    times = []
    for _ in range(runs):
        began = time.perf_counter()
        search().write.format("noop").mode("overwrite").save()
        times.append((time.perf_counter() - began) / max(1, queries) * 1e6)
    return recall, median(times), None


def _row(bench: Workload, index: str, params: str, k: int, measured: tuple[float, float, None], built: float, size: int, base_bytes: int, queries: int, runs: int) -> tuple:
    return ("tessel", bench.name, index, params, k, *measured, built, size, base_bytes, queries, runs, datetime.now(UTC).isoformat().replace("+00:00", "Z"))


def hnsw_sweep(spark: SparkSession, bench: Workload, config: HnswConfig, beams: Iterable[int], k: int = 10, runs: int = 3, shards: int | None = None) -> DataFrame:
    """Measurement rows of one build searched with each beam."""
    began = time.perf_counter()
    index = build_hnsw(bench.base, config, shards)
    index.adjacency.count()
    built, n, nq = time.perf_counter() - began, bench.base.count(), bench.queries.count()
    levels = index.nodes().agg({"level": "sum"}).first()[0] or 0
    size, dim = hnsw_bytes(n, config.m, levels), len(bench.base.first()["vec"])
    rows = []
    for ef in beams:
        view = index.with_ef_search(ef)
        measured = measure(lambda v=view: search_hnsw(v, bench.queries, k), bench.truth, k, nq, runs)
        rows.append(_row(bench, "hnsw", view.config.short_name(), k, measured, built, size, 4 * n * dim, nq, runs))
    return spark.createDataFrame(rows, MEASUREMENT)


def ivfpq_sweep(spark: SparkSession, bench: Workload, config: IvfPqConfig, probes: Iterable[int], k: int = 10, runs: int = 3, coarse=None) -> DataFrame:  # noqa: ANN001
    """Measurement rows of one build searched with each number of lists; more than there are is left out."""
    began = time.perf_counter()
    index = build_ivfpq(bench.base, config, coarse)
    index.postings.persist().count()
    built, n, nq = time.perf_counter() - began, bench.base.count(), bench.queries.count()
    rows = []
    for p in probes:
        if p > index.config.nlist:
            continue
        view = index.with_nprobe(p)
        measured = measure(lambda v=view: search_ivfpq(v, bench.queries, k), bench.truth, k, nq, runs)
        rows.append(_row(bench, "ivfpq", view.config.short_name(), k, measured, built, index.bytes(n), 4 * n * index.centroids.shape[1], nq, runs))
    index.postings.unpersist()
    return spark.createDataFrame(rows, MEASUREMENT)


def full_sweep(spark: SparkSession, bench: Workload, done: DataFrame, write: Callable[[DataFrame], None], grid: DataFrame | None = None, k: int = 10, runs: int = 3) -> int:
    """Run every configuration of the grid without a row in done(family, params), a build for each block; how many were run.

    The grid is a few hundred rows at most. A coarse quantizer serves all m of its nlist; its time is part of each build.
    """
    todo = still_to_run(grid if grid is not None else sweep_grid(spark), done).withColumn("block", block("params")).collect()
    blocks: dict[tuple[str, str], list[str]] = {}
    for r in todo:
        blocks.setdefault((r["family"], r["block"]), []).append(r["params"])
    coarse: dict[int, tuple] = {}
    dim = len(bench.base.first()["vec"])
    count = 0
    for (family, name), params in sorted(blocks.items()):
        of = {a: int(b) for a, b in (x.split("=") for x in name.split(","))}
        knobs = sorted(int(p.rsplit("=", 1)[1]) for p in params)
        if family == "hnsw":
            rows = hnsw_sweep(spark, bench, HnswConfig(of["M"], of["efC"]), knobs, k, runs)
        else:
            if dim % of["m"]:
                continue
            config = IvfPqConfig(nlist=of["nlist"], m=of["m"])
            if of["nlist"] not in coarse:
                began = time.perf_counter()
                coarse[of["nlist"]] = (train_coarse(bench.base, config), time.perf_counter() - began)
            fit, spent = coarse[of["nlist"]]
            rows = ivfpq_sweep(spark, bench, config, knobs, k, runs, fit)
            rows = rows.withColumn("build_seconds", rows["build_seconds"] + spent)
        write(rows)
        count += len(knobs)
    return count
