"""Helpers shared by the corpus operators: storage, word hashing, table access."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of the 64-bit finaliser (fixed values of splitmix64).
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

UPPER_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Bytes of a batch of rows on its way to a Python worker, in place of Spark's 64 MB.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Batches of whole texts are bounded in bytes, not by rows alone; a session's own smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory of this Python process to the machine; pools would hold it while the worker waits."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(step: Callable) -> Callable:
    """A step of mapInArrow that gives its freed memory back at the end of each task.

    Workers outlive their tasks, and what two of them hold counts beside the heap of their executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def lean_group(step: Callable) -> Callable:
    """lean() for a step that turns one group's frame into another."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return step(rows)
        finally:
            give_back()

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a local master gets a temporary folder; a cluster gets an error,
    since a machine-local folder would lose data there.
    """
    bound_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at replicated files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessel-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessel_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once no later result reads it."""
    path = getattr(df, "_tessel_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Broadcast hint only where the counted rows keep within the bound."""
    return F.broadcast(df) if rows <= most_rows else df


#: Rows of a bit filter at most, 64 bits each.
FILTER_ROWS = 1 << 20


def _filter_place(key: Column, rows: int) -> tuple[Column, Column]:
    """The row of a key in a filter of so many rows, and the three bits that it sets there."""
    h = F.xxhash64(key)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return F.shiftright(h, 20).bitwiseAND(F.lit(rows - 1)), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def bit_filter(keys: DataFrame, key: str) -> DataFrame:
    """A blocked bloom filter of a column's values as rows (filter_row, filter_bits), of about 16 bits a value.

    It has FILTER_ROWS rows at most, so it can be broadcast whatever the number of keys; with more keys
    than they serve well, more of what maybe_in() lets pass is not among the keys.
    """
    wanted, rows = keys.count() // 4, 1
    while rows < min(wanted, FILTER_ROWS):
        rows *= 2
    row, bits = _filter_place(F.col(key), rows)
    out = keys.select(row.alias("filter_row"), bits.alias("bits")).groupBy("filter_row").agg(F.bit_or("bits").alias("filter_bits"))
    out._tessel_rows = rows
    return out


def maybe_in(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose key may be in the filter; all whose key is in it, and few others."""
    row, bits = _filter_place(F.col(key), wanted._tessel_rows)
    at, mask = fresh_name(df, "filter_at"), fresh_name(df, "filter_mask")
    out = df.withColumn(at, row).withColumn(mask, bits).join(F.broadcast(wanted), F.col(at) == F.col("filter_row"))
    return out.where(F.col("filter_bits").bitwiseAND(F.col(mask)) == F.col(mask)).select(*df.columns)


def without(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of df whose key isn't among the keys of gone(key); rows of a null key stay.

    Rows that the filter of the keys lets out stay where they are; only the others, which are about those that go, are
    shuffled to be looked up.
    """
    wanted = bit_filter(gone, gone.columns[0])
    row, bits = _filter_place(F.col(key), wanted._tessel_rows)
    at, held = fresh_name(df, "filter_at"), fresh_name(df, "filter_held")
    seen = df.withColumn(at, row).join(F.broadcast(wanted.select(F.col("filter_row").alias(f"{at}_row"), F.col("filter_bits").alias(held))), F.col(at) == F.col(f"{at}_row"), "left")
    maybe = F.coalesce(F.col(held).bitwiseAND(bits) == bits, F.lit(False))
    asked = seen.where(maybe).select(*df.columns).join(gone.hint("merge"), F.col(key) == gone[gone.columns[0]], "left_anti")
    return seen.where(~maybe).select(*df.columns).unionAll(asked)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while base in have:
        base += "_"
    return base


def fold(doc_id: str, parts: int):
    """crc32 of the id's decimal text modulo parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def scaled(k: int) -> np.uint64:
    """k times GOLDEN, modulo 2**64."""
    return np.uint64(k * int(GOLDEN) & 0xFFFF_FFFF_FFFF_FFFF)


#: How many times the wanted rows a hash sample is expected to hold before it is cut.
SAMPLE_MARGIN = 4


def hash_sample(df: DataFrame, rows: int, *hashed) -> DataFrame:
    """The `rows` rows of df with the smallest hashes, ties by all columns.

    Only rows below a hash that leaves SAMPLE_MARGIN times as many in expectation are ordered, so what the one
    ordering task reads doesn't grow with the number of partitions.
    """
    key = F.pmod(F.xxhash64(*hashed), F.lit(1 << 40))
    n = df.count()
    rest = df.where(key < int((1 << 40) * SAMPLE_MARGIN * rows / n) + 1) if n > SAMPLE_MARGIN * rows else df
    return rest.orderBy(key, *df.columns).limit(rows)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64); wraps modulo 2**64."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, in order."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of size words; fewer words make one shingle."""
    if not len(words):
        return words
    width = min(size, len(words))
    h = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for k in range(width):
        h = mix64(h * GOLDEN + words[k : len(words) - width + 1 + k])
    return np.unique(h)


def blocks_of(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Spans of rows whose texts hold about `most` bytes together, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        held += size
        if held >= most or k + 1 == len(sizes):
            yield start, k + 1
            start, held = k + 1, 0
