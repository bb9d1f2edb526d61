"""The report layer: frontiers, ratios, suspect rows, deciles and steps over measurement rows.

Measurement columns are those of MEASUREMENT; `ord` is a row's place in its file, which breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import params

MEASUREMENT = (
    "harness string, dataset string, index string, params string, k int, recall_at_k double, mean_latency_us double, p95_latency_us double, "
    "build_seconds double, index_bytes long, base_bytes long, queries int, runs int, timestamp string"
)


def pareto(rows: DataFrame, by: list[str], gain: str, cost: str, order: str) -> DataFrame:
    """Rows of each series that are cheaper than every row of a larger gain (or of the same one, earlier in order)."""
    before = Window.partitionBy(*by).orderBy(F.desc(gain), order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(cost).over(before)
    return rows.withColumn("best_before", best).where(F.col("best_before").isNull() | (F.col(cost) < F.col("best_before"))).drop("best_before")


def cheapest_reaching(rows: DataFrame, by: list[str], gain: str, cost: str, order: str, least: float) -> DataFrame:
    """The cheapest row of each group whose gain is at least `least`; the first in order of equal ones; no row where none does."""
    picked = F.min_by(F.struct(*rows.columns), F.struct(cost, order)).alias("row")
    return rows.where(F.col(gain) >= least).groupBy(*by).agg(picked).select("row.*")


def best_of(rows: DataFrame, by: list[str], gain: str, order: str) -> DataFrame:
    """The row of the largest gain of each group, the first in order of equal ones."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), F.struct(-F.col(gain), F.col(order))).alias("row")).select("row.*")


def ratios(own: DataFrame, other: DataFrame, value: str, suspects: DataFrame | None = None) -> DataFrame:
    """params, ratio of own to other where both have a row; suspects(params) are left out."""
    both = own.select("params", F.col(value).alias("own")).join(other.select("params", F.col(value).alias("other")), "params")
    both = both if suspects is None else both.join(suspects.select("params"), "params", "left_anti")
    return both.select("params", "own", "other", (F.col("own") / F.col("other")).alias("ratio"))


def ratio_sets(pairs: DataFrame) -> DataFrame:
    """m, ef, mean_ratio over each m and over each ef: two grouping sets of ratios(params, ratio)."""
    keyed = pairs.withColumn("m", params.number("params", "M")).withColumn("ef", params.number("params", "ef"))
    return keyed.groupingSets([["m"], ["ef"]], "m", "ef").agg(F.avg("ratio").alias("mean_ratio"))


def ratio_cells(pairs: DataFrame) -> DataFrame:
    """ef, m, state and mean ratio of each cell of pairs(params, ratio, suspect): of its clean rows, else of its
    suspect ones ('partial': some of either)."""
    keyed = pairs.withColumn("m", params.number("params", "M")).withColumn("ef", params.number("params", "ef"))
    clean, dirty = F.avg(F.when(~F.col("suspect"), F.col("ratio"))), F.avg(F.when(F.col("suspect"), F.col("ratio")))
    n_clean, n = F.count_if(~F.col("suspect")), F.count("*")
    state = F.when(n_clean == n, "clean").when(n_clean > 0, "partial").otherwise("none")
    return keyed.groupBy("ef", "m").agg(F.coalesce(clean, dirty).alias("ratio"), state.alias("state"))


def suspect_blocks(own: DataFrame, other: DataFrame, most: float = 1.25) -> DataFrame:
    """block, ratio, deviation, started, suspect of each block of params that both tables have.

    The first row of a block gives its build ratio; one that differs from the median ratio by more than `most` either
    way is bad, and all blocks of the other table from the earliest bad start on are suspect. Blocks are few: one a build.
    """
    first = Window.partitionBy("block").orderBy("ord")
    heads = lambda df: df.withColumn("block", params.block("params")).withColumn("n", F.row_number().over(first)).where("n = 1")
    a = heads(own).select("block", F.col("build_seconds").alias("own"))
    b = heads(other).select("block", F.col("build_seconds").alias("other"), F.col("timestamp").alias("started"))
    both = a.join(b, "block").withColumn("ratio", F.col("own") / F.col("other"))
    # one row each: the median, and the first bad start
    dev = both.crossJoin(F.broadcast(both.agg(F.expr("percentile(ratio, 0.5)").alias("middle")))).withColumn("deviation", F.greatest(F.col("ratio") / F.col("middle"), F.col("middle") / F.col("ratio")))
    cut = dev.where(F.col("deviation") > most).agg(F.min("started").alias("cut"))
    return dev.crossJoin(F.broadcast(cut)).select("block", "ratio", "deviation", "started", F.coalesce(F.col("started") >= F.col("cut"), F.lit(False)).alias("suspect"))


def deciles(rows: DataFrame, at: str, value: str, buckets: int = 10) -> DataFrame:
    """bucket (from 0), n, low, high, mean of the value, between linearly interpolated quantiles of `at`.

    Buckets are half-open, the last one closed; empty ones are absent. The quantiles are one row.
    """
    edges = rows.agg(F.expr(f"percentile(`{at}`, array({','.join(str(k / buckets) for k in range(buckets + 1))}))").alias("edges"))
    held = rows.crossJoin(F.broadcast(edges)).where(F.col(at).isNotNull())
    inner = F.slice("edges", 2, buckets - 1)
    bucket = F.size(F.filter(inner, lambda e: e <= F.col(at)))
    return held.withColumn("bucket", bucket).groupBy("bucket").agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"), F.avg(value).alias("mean"))


def steps(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each row with its change in percent on the one before, whether that is below 1, and the speed-up on the first."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(value).over(w)
    change = F.lit(100.0) * (F.col(value) - before) / before
    return rows.withColumn("change", change).withColumn("same", F.abs("change") < 1).withColumn("speedup", F.first(value).over(w) / F.col(value))


def first_and_last(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """speedup of each group: the first value over the last."""
    first, last = F.min_by(value, order), F.max_by(value, order)
    return rows.groupBy(*by).agg(first.alias("first_value"), last.alias("last_value"), (first / last).alias("speedup"))


def monotone(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """rising, falling: whether each value is above (below) the one before."""
    d = rows.withColumn("d", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(order)))
    return d.groupBy(*by).agg(F.coalesce(F.bool_and(F.col("d") > 0), F.lit(True)).alias("rising"), F.coalesce(F.bool_and(F.col("d") < 0), F.lit(True)).alias("falling"))


def tail_is_contiguous(rows: DataFrame, by: list[str], order: str, flag: str) -> DataFrame:
    """contiguous: whether no unflagged row follows a flagged one."""
    seen = F.max(F.col(flag).cast("int")).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("broken", (seen == 1) & ~F.col(flag)).groupBy(*by).agg((~F.bool_or("broken")).alias("contiguous"))


def latest(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of each key that comes last: later files override earlier ones. Partial maxima go before the shuffle."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def first_of_block(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), order).alias("row")).select("row.*")


def best_per_build(rows: DataFrame) -> DataFrame:
    """build (seconds to 3 places), recall and params of the best row of each build."""
    picked = F.min_by(F.struct("params", "recall_at_k"), F.struct(-F.col("recall_at_k"), F.col("ord")))
    return rows.groupBy(F.round("build_seconds", 3).alias("build")).agg(picked.alias("row")).select("build", "row.params", F.col("row.recall_at_k").alias("recall"))


def wins(pairs: DataFrame) -> DataFrame:
    """wins, pairs: own below other; a suspect row of the other never makes a win. pairs(own, other, suspect)."""
    return pairs.agg(F.count_if((F.col("own") < F.col("other")) & ~F.col("suspect")).alias("wins"), F.count("*").alias("pairs"))


def span(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """low, high of a value."""
    return (rows.groupBy(*by) if by else rows).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def worst_gap(pairs: DataFrame) -> DataFrame:
    """gap: the largest relative difference in percent, rounded up to one place. pairs(own, other)."""
    return pairs.agg((F.ceil(F.max(F.abs(F.col("own") - F.col("other")) / F.col("other")) * 1000) / 10).alias("gap"))


def recall_drop(rows: DataFrame, a: str, b: str) -> DataFrame:
    """harness, index, drop: best recall on dataset b less that on a, in points."""
    best = rows.where(F.col("dataset").isin(a, b)).groupBy("harness", "index").pivot("dataset", [a, b]).agg(F.max("recall_at_k"))
    return best.select("harness", "index", ((F.col(b) - F.col(a)) * 100).alias("drop"))


def oracle_gap(rows: DataFrame, oracle: float, by: list[str]) -> DataFrame:
    """slots: result slots in 100,000 by which the best recall misses the oracle's."""
    return rows.groupBy(*by).agg(((F.lit(oracle) - F.max("recall_at_k")) * 100000).alias("slots"))


def build_ratio_span(own: DataFrame, other: DataFrame) -> DataFrame:
    """low, high of the build-time ratio, first row of each build."""
    w = Window.partitionBy("block").orderBy("ord")
    heads = lambda df, name: df.withColumn("block", params.block("params")).withColumn("n", F.row_number().over(w)).where("n = 1").select("block", F.col("build_seconds").alias(name))
    return span(heads(own, "own").join(heads(other, "other"), "block").withColumn("ratio", F.col("own") / F.col("other")), [], "ratio")


def repair_memory(rows: DataFrame) -> DataFrame:
    """index_bytes of graph rows without the raw vectors, where they were counted in."""
    counted = params.is_hnsw(F.col("index")) & (F.col("index_bytes") > F.col("base_bytes"))
    return rows.withColumn("index_bytes", F.when(counted, F.col("index_bytes") - F.col("base_bytes")).otherwise(F.col("index_bytes")))


def quoted(text: Column) -> Column:
    """A CSV field in quotes, those inside doubled."""
    return F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))


def csv_row(rows: DataFrame) -> Column:
    """A measurement as one CSV line: index and params quoted, 6 places of recall and 3 of times, whatever the locale."""
    six, three = (lambda c: F.format_string("%.6f", F.col(c))), (lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.3f", F.col(c))))
    return F.concat_ws(
        ",", "harness", "dataset", quoted(F.col("index")), quoted(F.col("params")), F.col("k").cast("string"), six("recall_at_k"), three("mean_latency_us"), three("p95_latency_us"),
        three("build_seconds"), F.col("index_bytes").cast("string"), F.col("base_bytes").cast("string"), F.col("queries").cast("string"), F.col("runs").cast("string"), "timestamp",
    )


def repair_quoting(line: Column) -> Column:
    """A line whose params=value fields were written bare, with them quoted; a quoted line is left alone."""
    bare = r"^([^,\"]*),([^,\"]*),([^,\"]*),((?:[A-Za-z]+=[^,\"]*)(?:,[A-Za-z]+=[^,\"]*)*),(\d+,.*)$"
    return F.regexp_replace(line, bare, '$1,$2,"$3","$4",$5')


def sweep_grid(spark, hnsw: dict | None = None, ivfpq: dict | None = None) -> DataFrame:  # noqa: ANN001
    """family, params of every configuration of the two grids; lists given take the place of the usual ones."""
    h = {"M": (8, 16, 32), "efC": (100, 200, 400), "ef": (16, 32, 64, 128, 256, 512)} | (hnsw or {})
    i = {"nlist": (1024, 4096), "m": (8, 16, 32), "nprobe": (1, 4, 8, 16, 32, 64)} | (ivfpq or {})
    rows = [("hnsw", f"M={m},efC={c},ef={e}") for m in h["M"] for c in h["efC"] for e in h["ef"]]
    rows += [("ivfpq", f"nlist={n},m={m},nprobe={p}") for n in i["nlist"] for m in i["m"] for p in i["nprobe"] if p <= n]
    return spark.createDataFrame(rows, "family string, params string")


def still_to_run(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Configurations of the grid without a row in done(family, params)."""
    return grid.join(done.select("family", "params"), ["family", "params"], "left_anti")


def hot_methods(samples: DataFrame, limit: int = 20, prefix: str = "") -> DataFrame:
    """frame, self, total of the most frequent frames of samples(sample_id, depth, frame): self where it is the top
    frame, total once for each sample."""
    own = samples.where(F.col("frame").startswith(prefix))
    out = own.groupBy("frame").agg(F.count_if(F.col("depth") == 0).alias("self"), F.count_distinct("sample_id").alias("total"))
    return out.orderBy(F.desc("self"), F.desc("total"), "frame").limit(limit)
