"""fvecs and ivecs files as a Spark data source, for reading and writing.

A record is a little-endian int32 dimension and as many float32 (int32) values. The first record gives the
dimension; the number of records follows from the size of the file. Partitions are ranges of records, read in
chunks. A path is a file, or a folder whose files stand in the order of their names; it may lie in any store
that pyarrow reaches (file, s3, gs, hdfs). Options: path, maxVectors (the first so many records), partitionRecords.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MOST_DIMENSIONS = 1 << 20
CHUNK_BYTES = 8 << 20


class VecsError(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    dim: int
    records: int

    @property
    def record_bytes(self) -> int:
        return 4 + 4 * self.dim


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[str]:
    """The file itself, or a folder's files by name; those that begin with _ or . are left out."""
    store, inner = _store(path)
    info = store.get_file_info(inner)
    if info.type != pafs.FileType.Directory:
        return [path]
    found = [f for f in store.get_file_info(pafs.FileSelector(inner)) if f.type == pafs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(f.base_name for f in found) if n[0] not in "_."]


def layout_of(path: str) -> Layout:
    """Dimension and number of records of a file, from the size and the first four bytes."""
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        size = f.size()
        if size < 4:
            raise VecsError(f"{path}: {size} bytes are too few for a record")
        (dim,) = struct.unpack("<i", f.read(4))
    if not 0 < dim <= MOST_DIMENSIONS:
        raise VecsError(f"{path}: dimension {dim}")
    if size % (4 + 4 * dim):
        raise VecsError(f"{path}: {size} bytes aren't whole records of dimension {dim}")
    return Layout(dim, size // (4 + 4 * dim))


def layouts(path: str) -> list[tuple[str, Layout]]:
    """Each file of a path with its layout; files of different dimensions are an error."""
    out = [(f, layout_of(f)) for f in files_of(path)]
    if len({at.dim for _, at in out}) > 1:
        raise VecsError(f"{path}: files of different dimensions")
    return out


def count_vectors(path: str) -> int:
    return sum(at.records for _, at in layouts(path))


def dimension_of(path: str) -> int:
    found = layouts(path)
    if not found:
        raise VecsError(f"{path}: no files")
    return found[0][1].dim


def read_chunks(path: str, layout: Layout, start: int, end: int, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first record, matrix) of whole-record chunks; a record of another dimension is an error."""
    per = max(1, CHUNK_BYTES // layout.record_bytes)
    store, inner = _store(path)
    with store.open_input_file(inner) as f:
        f.seek(start * layout.record_bytes)
        for at in range(start, end, per):
            n = min(per, end - at)
            raw = np.frombuffer(f.read(n * layout.record_bytes), "<i4").reshape(n, layout.dim + 1)
            if (raw[:, 0] != layout.dim).any():
                bad = at + int(np.nonzero(raw[:, 0] != layout.dim)[0][0])
                raise VecsError(f"{path}: record {bad} has another dimension than {layout.dim}")
            yield at, raw[:, 1:].view(kind)


@dataclass
class _Range(InputPartition):
    """Records of a file; `before` records stand in the files ahead of it."""

    file: str
    before: int
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str, names: tuple[str, str]):
        self.path = options["path"]
        self.most = int(options.get("maxvectors", options.get("maxVectors", 1 << 62)))
        self.step = int(options.get("partitionrecords", options.get("partitionRecords", 1 << 17)))
        self.kind, self.names = kind, names

    def partitions(self) -> list[_Range]:
        out, before = [], 0
        for file, layout in layouts(self.path):
            n = min(self.most - before, layout.records)
            out += [_Range(file, before, a, min(n, a + self.step)) for a in range(0, n, self.step)]
            before += layout.records
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        layout = layout_of(partition.file)
        for at, rows in read_chunks(partition.file, layout, partition.start, partition.end, self.kind):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * layout.dim, pa.int32()), pa.array(np.ascontiguousarray(rows).reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(rows)) + partition.before), lists], list(self.names))


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    name: str


class _Writer(DataSourceArrowWriter):
    """One file a task, named by its partition. A task writes a file of its own under _temporary, which the commit
    renames, so a repeated or failed task leaves nothing behind; rows have one dimension."""

    def __init__(self, options: dict, kind: str, suffix: str):
        self.path, self.kind, self.suffix = options["path"].rstrip("/"), kind, suffix

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, inner = _store(self.path)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.{self.suffix}"
        temporary = f"{inner}/_temporary/{task.taskAttemptId()}-{name}"
        store.create_dir(f"{inner}/_temporary")
        wrote = False
        with store.open_output_stream(temporary) as f:
            for batch in batches:
                lists = batch.column(1)
                if not len(lists):
                    continue
                sizes = np.diff(lists.offsets.to_numpy())
                if lists.null_count or (sizes != sizes[0]).any() or not sizes[0]:
                    raise VecsError("vectors must be there and have one dimension")
                out = np.empty((len(lists), int(sizes[0]) + 1), "<i4")
                out[:, 0] = sizes
                out[:, 1:] = lists.flatten().to_numpy(zero_copy_only=False).astype(self.kind).view("<i4").reshape(len(lists), -1)
                f.write(out.tobytes())
                wrote = True
        return _Written(temporary, name if wrote else "")

    def commit(self, messages: list[_Written | None]) -> None:
        store, inner = _store(self.path)
        store.create_dir(inner)
        for m in messages:
            if m and m.name:
                store.move(m.temporary, f"{inner}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, inner = _store(self.path)
        if store.get_file_info(f"{inner}/_temporary").type == pafs.FileType.Directory:
            store.delete_dir(f"{inner}/_temporary")


class FvecsSource(DataSource):
    """format("fvecs"): id long, vec array<float>."""

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        layouts(self.options["path"])
        return "id long, vec array<float>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options), "<f4", ("id", "vec"))

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(dict(self.options), "<f4", "fvecs")


class IvecsSource(DataSource):
    """format("ivecs"): qid long, neighbours array<int>."""

    @classmethod
    def name(cls) -> str:
        return "ivecs"

    def schema(self) -> str:
        layouts(self.options["path"])
        return "qid long, neighbours array<int>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options), "<i4", ("qid", "neighbours"))

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        return _Writer(dict(self.options), "<i4", "ivecs")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)


def read_fvecs(spark: SparkSession, path: str, max_vectors: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("fvecs")
    return (reader if max_vectors is None else reader.option("maxVectors", max_vectors)).load(path)


def read_ivecs(spark: SparkSession, path: str, max_vectors: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("ivecs")
    return (reader if max_vectors is None else reader.option("maxVectors", max_vectors)).load(path)


def write_table(rows: DataFrame, path: str, form: str) -> None:
    """A table (number, list) as a folder of fvecs or ivecs files, in the order of its first column, by which it is dealt to
    files in ranges. The numbers themselves aren't kept: a record's number is its place."""
    spark, (number, values) = rows.sparkSession, rows.columns
    register(spark)
    kind = "array<float>" if form == "fvecs" else "array<int>"
    dealt = rows.select(F.col(number).cast("long").alias(number), F.col(values).cast(kind).alias(values)).repartitionByRange(number).sortWithinPartitions(number)
    dealt.write.format(form).mode("append").save(path)


def write_vecs(rows: np.ndarray, path: str) -> None:
    """A float32 or int32 matrix as an fvecs or ivecs file."""
    kind = "<f4" if rows.dtype.kind == "f" else "<i4"
    out = np.empty((len(rows), rows.shape[1] + 1), "<i4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = np.ascontiguousarray(rows, kind).view("<i4")
    out.tofile(path)
