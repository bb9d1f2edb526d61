"""Tables of a nearest-neighbour workload, read from its files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import knn
from ..sources.vecs import VecsError, count_vectors, dimension_of, read_fvecs, read_ivecs

#: Public collections with the stem of their file names and their dimensions, and how their files are named.
COLLECTIONS = {"sift1m": ("sift", 128), "gist1m": ("gist", 960)}
FILES = {"base": "base.fvecs", "queries": "query.fvecs", "truth": "groundtruth.ivecs"}
#: Neighbours a query that a truth computed here holds at least.
TRUTH_WIDTH = 100


@dataclass(frozen=True)
class Workload:
    """base(id, vec), queries(qid, vec), truth(qid, rank, id); computed: the truth is a search's and not a file's."""

    name: str
    base: DataFrame
    queries: DataFrame
    truth: DataFrame
    computed: bool = False


def file_paths(root: str, stem: str) -> dict[str, str]:
    return {part: f"{root}/{stem}/{stem}_{name}" for part, name in FILES.items()}


def missing(root: str, stem: str) -> list[str]:
    """The parts of a collection whose files can't be read."""
    out = []
    for part, path in file_paths(root, stem).items():
        try:
            dimension_of(path)
        except (OSError, VecsError):
            out.append(part)
    return out


def open_workload(spark: SparkSession, root: str, stem: str, dim: int, base_rows: int | None = None, query_rows: int | None = None, k: int = 10) -> Workload:
    """A collection, or its first rows. A truth file speaks of the whole base, so with fewer base rows the truth is searched
    for, max(k, TRUTH_WIDTH) wide. Vectors of another dimension than `dim` are an error."""
    paths = file_paths(root, stem)
    for part in ("base", "queries"):
        if (found := dimension_of(paths[part])) != dim:
            raise VecsError(f"{paths[part]}: dimension {found} in place of {dim}")
    base = read_fvecs(spark, paths["base"], base_rows)
    queries = read_fvecs(spark, paths["queries"], query_rows).withColumnRenamed("id", "qid")
    if base_rows is not None and base_rows < count_vectors(paths["base"]):
        return Workload(stem, base, queries, knn(queries, base, max(k, TRUTH_WIDTH)), True)
    ranked = read_ivecs(spark, paths["truth"], query_rows).select("qid", F.posexplode("neighbours").alias("place", "near"))
    return Workload(stem, base, queries, ranked.select("qid", (F.col("place") + 1).alias("rank"), F.col("near").cast("long").alias("id")))


def banner(spark: SparkSession) -> DataFrame:
    """key, value: versions and settings that a run depends on."""
    keys = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    rows = [("spark", spark.version), ("parallelism", str(spark.sparkContext.defaultParallelism)), *((k, spark.conf.get(k)) for k in keys)]
    return spark.createDataFrame(rows, "key string, value string")
