"""Token ids of documents, written as patched frame-of-reference segments in doc_id order."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks_of, lean, shared_dir
from .pfor import decode_segment, encode_segment

#: A segment is closed at the first document at which it holds so many ids, or some more.
SEGMENT_IDS = 1 << 18
#: Bytes of text that a task encodes at once, or one longer text.
TEXT_BLOCK = 2 << 20
#: Distinct words held with their ids by one Python worker; beyond it the table starts afresh.
TABLE_ENTRIES = 300_000

#: An ASCII letter and the run of other printable ASCII after it, no digits, up to white space or the end.
MARKS_AT_END = r"([a-z])([!-/:-@\[-`{-~]+)([\t\n\f\r ]|$)"

SEGMENT_SCHEMA = "part int, seq int, start long, n_docs int, n_ids long, payload binary"

#: Byte-level vocabularies write bytes that have no printable Latin-1 character as these.
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, each distinct word encoded once.

    The tokenizer drops white space and no pre-token crosses it, so a text's ids are the ids of its words
    one after another. Text is cut at ASCII white space only. A word of Latin-1 letters,
    with a comma or full stop after it at most, is unchanged by composition and lower-cased
    letter by letter, so its letters are one pre-token for the model; any other word is
    left to the whole library.
    """

    def __init__(self, file: str, entries: int = TABLE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.entries = entries

    def _letters(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of lower-case letters or one mark, which are a word of the table like another."""
        found = self.words.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_CHARACTERS)
            found = self.words[piece] = self._letters(shown)
        return found

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha() and word.islower():
            return self._letters(word)
        core, end = (word[:-1], word[-1]) if word[-1:] in ",." else (word, "")
        if core.isalpha() and (core.isascii() or max(core) <= "\xff"):
            return self._piece(core.lower()) + (self._piece(end) if end else b"")
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _loosened(self, texts: pa.StringArray) -> pa.StringArray:
        """Texts of the same ids with fewer distinct words: letters lower-cased, marks at a word's end set apart.

        A text that may hold an added token, which is found as it is written, stays as it is.
        """
        loose = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS_AT_END, r"\1 \2\3")
        for token in self.added:
            named = pc.match_substring(texts, token, ignore_case=True)
            if pc.any(named).as_py():
                loose = pc.if_else(named, texts, loose)
        return loose

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self.words) > self.entries:
            self.words.clear()
        cut = pc.ascii_split_whitespace(self._loosened(pc.fill_null(texts, "")))
        coded = cut.flatten().dictionary_encode()
        known, ids = self.words, []
        for w in coded.dictionary.to_pylist():
            found = known.get(w)
            if found is None:
                found = known[w] = self._word(w) if w else b""
            ids.append(found)
        index = coded.indices.to_numpy()
        n_of = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, at = np.frombuffer(b"".join(ids), "<u4"), np.concatenate(([0], np.cumsum(n_of)))
        each = n_of[index]
        ends = np.concatenate(([0], np.cumsum(each)))
        place = np.repeat(at[index] - ends[:-1], each)
        place += np.arange(ends[-1])
        return table[place], np.diff(ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()])


def word_encoder(file: str) -> WordEncoder:
    if file not in _encoders:
        _encoders[file] = WordEncoder(file)
    return _encoders[file]


def _writer(file: str, end_id: int, segment_ids: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(file), TaskContext.get().partitionId()
        seq = start = size = 0
        doc_ids, lengths, held = [], [], []

        def segment() -> pa.RecordBatch:
            data = encode_segment(doc_ids, np.concatenate(lengths), np.concatenate(held))
            row = [[part], [seq], [start], [len(doc_ids)], [size], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "start", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for a, b in blocks_of(batch.column("text"), TEXT_BLOCK):
                ids, n = encoder.encode(batch.column("text")[a:b])
                held.append(np.insert(ids, np.cumsum(n), end_id).astype(np.uint32))
                lengths.append((n + 1).astype(np.uint32))
                doc_ids.extend(batch.column("doc_id")[a:b].to_pylist())
                size += len(held[-1])
                if size >= segment_ids:
                    yield segment()
                    seq, start = seq + 1, start + size
                    doc_ids, lengths, held, size = [], [], [], 0
        if doc_ids:
            yield segment()

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode docs(doc_id, text) and write segments, in ascending doc_id order, under path.

    Rows are dealt by ranges of doc_id, one file a range, and sorted within it (equal ids by
    text, null ids first); a document's ids stand in one segment. The writer is Spark's own, so a lost
    executor or a repeated task leaves no half files, and any store that Spark reaches will do.
    Null texts are empty and give the end id alone. No rows give files without segments.
    """
    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(lean(_writer(tokenizer_file, end_id, segment_ids)), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, start, payload in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("payload"), strict=True):
            doc_ids, lengths, ids = decode_segment(payload.as_py())
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = memoryview(np.ascontiguousarray(ids, "<u4").tobytes())
            sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under path.

    start adds to a file's own offsets the totals of the files before it: one row a file,
    broadcast (a file holds a range of many documents, so these are few).
    """
    from pyspark.sql import Window

    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = files.select("part", "start", "payload").mapInArrow(lean(_read), "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_file_digests(docs: DataFrame, tokenizer_file: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write the token files of docs (to the shared folder unless a path is given) and read them back."""
    import uuid

    spark = docs.sparkSession
    where = path or f"{shared_dir(spark)}/tessel-ids-{uuid.uuid4().hex}"
    write_token_files(docs, where, tokenizer_file, end_id)
    return read_token_files(spark, where)
