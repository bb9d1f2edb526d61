"""Nearest neighbours of queries that arrive as a stream, against a base that doesn't change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import L2
from ..operators.knn import knn


def search_stream(queries: DataFrame, base: DataFrame, k: int, write: Callable[[DataFrame, int], None], checkpoint: str, metric: str = L2, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Each micro-batch of queries(qid, vec) is searched exactly and handed to write(neighbours, batch id)."""
    run = lambda batch, n: write(knn(batch, base, k, metric), n)
    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
