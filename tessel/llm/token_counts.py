"""Token counts without ids: pieces of each distinct pre-token are counted once and joined
to the documents' pre-token frequencies.

1. Documents are taken in blocks. A block lists its distinct pre-tokens in the order of a hash, and each document's
   frequencies point into that list.
2. The hash deals the lists out to buckets, so that all uses of a pre-token meet in one bucket, where
   the distinct ones are counted once.
3. The counts go back to the blocks, where they are multiplied with the frequencies and summed.

Lists and frequencies travel packed: a row holds what one block has in one bucket, not one pre-token.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, discard, materialise

#: Bytes of text of a block, about; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Pre-tokens of a bucket, about: those that all blocks list, before equal ones are taken together.
BUCKET_TOKENS = 1_000_000

BLOCK_SCHEMA = "doc_ids array<long>, n_bytes array<long>, n_listed long, tokens binary, ends binary, places binary, times binary"

_tables: dict[str, PieceTable] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, such that no piece of the vocabulary crosses from one to the next.

    The library writes a space as U+2581, puts one before the text and lets a piece hold it at
    its start only; so a pre-token is a run of spaces with the characters up to the next one.
    One space before is implied, as the library itself puts it there. A closing run of
    spaces is a pre-token of its own.
    """
    if not text:
        return []
    parts = text.replace("▁", " ").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for p in parts:
        if p:
            out.append(" " * spaces + p)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(" " * spaces)
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32, their first bytes together, then their second ones and so on, compressed."""
    return zstandard.ZstdCompressor(1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_tokens(tokens: list[bytes]) -> bytes:
    sizes = pack(np.fromiter(map(len, tokens), np.int64, len(tokens)))
    return len(sizes).to_bytes(8, "little") + sizes + zstandard.ZstdCompressor(1).compress(b"".join(tokens))


def unpack_tokens(data: bytes) -> pa.BinaryArray:
    at = 8 + int.from_bytes(data[:8], "little")
    ends = np.cumsum(np.concatenate(([0], unpack(data[8:at]))))
    spelled = zstandard.ZstdDecompressor().decompress(data[at:])
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(spelled)])


def frequencies(texts: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pre-tokens by ascending crc32, ends, places, times): text k has the pre-token places[j] times[j] times, j from
    ends[k - 1] to ends[k], places ascending."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
    # where runs of spaces aren't words with one space before them, texts are cut one by one
    odd = pc.or_(pc.equal(texts, ""), pc.match_substring_regex(texts, "^ |  | $")).to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    coded = cut.flatten().dictionary_encode()
    tokens = coded.dictionary.cast(pa.binary()).to_pylist()
    owner = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    plain = ~odd[owner]
    owners, places, times = [owner[plain]], [coded.indices.to_numpy()[plain].astype(np.int64)], [np.ones(int(plain.sum()), np.int64)]
    place = {t: k for k, t in enumerate(tokens)} if odd.any() else {}
    for k in np.nonzero(odd)[0].tolist():
        counted = Counter(pre_tokens(texts[k].as_py()))
        owners.append(np.full(len(counted), k))
        places.append(np.array([place.setdefault(t.encode(), len(place)) for t in counted], np.int64))
        times.append(np.fromiter(counted.values(), np.int64, len(counted)))
    tokens = list(place) or tokens
    places = np.concatenate(places)
    used = np.flatnonzero(np.bincount(places, minlength=len(tokens)))
    hashes = np.fromiter((zlib.crc32(tokens[k]) for k in used.tolist()), np.int64, len(used))
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(tokens), np.int64)
    rank[used[order]] = np.arange(len(used))
    key, at = np.unique(np.concatenate(owners) * max(1, len(used)) + rank[places], return_inverse=True)
    sums = np.bincount(at, np.concatenate(times), len(key)).astype(np.int64)
    ends = np.searchsorted(key, (np.arange(len(texts)) + 1) * max(1, len(used)))
    return [tokens[k] for k in used[order].tolist()], ends, key % max(1, len(used)), sums


def document_sums(pieces: np.ndarray, ends: np.ndarray, places: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Pieces of each text, from the pieces of each distinct pre-token."""
    upto = np.concatenate(([0], np.cumsum(pieces[places] * times)))
    return np.diff(upto[np.concatenate(([0], ends))])


class PieceTable:
    """The number of pieces of pre-tokens, as the library for a model file gives them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)

    def pieces(self, tokens: list[bytes]) -> np.ndarray:
        # a closing run of k spaces stands for k of them: one is put there by the library itself
        asked = [(t if t.strip(b" ") else t[1:]).decode() for t in tokens]
        encoded = self.model.encode(asked, num_threads=1) if asked else []
        return np.array([len(ids) if shown else 1 for shown, ids in zip(asked, encoded, strict=True)], np.int64)

    def totals(self, texts: pa.StringArray) -> np.ndarray:
        """Pieces of each text of one block."""
        tokens, *rest = frequencies(texts)
        return document_sums(self.pieces(tokens), *rest)


def _table(model_file: str) -> PieceTable:
    if model_file not in _tables:
        _tables[model_file] = PieceTable(model_file)
    return _tables[model_file]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block of documents. A place is held as its distance from the one before it in its document."""
    for batch in batches:
        for a, b in blocks_of(batch.column("text"), BLOCK_BYTES):
            texts = batch.column("text")[a:b]
            tokens, ends, places, times = frequencies(texts)
            steps = np.diff(places, prepend=0)
            first = np.concatenate(([0], ends))[:-1]
            first = first[first < ends]
            steps[first] = places[first]
            lists = [batch.column("doc_id")[a:b].to_pylist(), pc.fill_null(pc.binary_length(texts), 0).to_pylist()]
            data = [pack_tokens(tokens), *map(pack, (ends, steps, times))]
            arrays = [*(pa.array([v], pa.list_(pa.int64())) for v in lists), pa.array([len(tokens)], pa.int64()), *(pa.array([d], pa.binary()) for d in data)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_ids", "n_bytes", "n_listed", "tokens", "ends", "places", "times"])


def _dealer(buckets: int) -> Callable:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, of_block, tokens): a block's list cut into the buckets' ranges of hashes."""
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("tokens"), strict=True):
                tokens = unpack_tokens(data.as_py()).to_pylist()
                of = np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens)) * buckets >> 32
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                cut = [tokens[x:y] for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(tokens)])]
                arrays = [pa.array(of[starts]), pa.array([block] * len(cut), pa.int64()), pa.array(map(pack_tokens, cut), pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["bucket", "of_block", "tokens"])

    return deal


def _bucket_counter(model_file: str) -> Callable:
    def count(bucket: pa.Table) -> pa.Table:
        """(bucket, of_block, pieces): the pieces of each list's pre-tokens, of which each distinct one is encoded once."""
        lists = [unpack_tokens(t.as_py()) for t in bucket.column("tokens")]
        coded = pa.concat_arrays(lists).dictionary_encode()
        pieces = _table(model_file).pieces(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        cut = np.split(pieces, np.cumsum([len(x) for x in lists])[:-1])
        return pa.table([bucket.column("bucket"), bucket.column("of_block"), pa.array(map(pack, cut), pa.binary())], ["bucket", "of_block", "pieces"])

    return count


def _sum_block(block: pa.Table, counted: pa.Table) -> pa.Table:
    """Rows of a block's documents; counted: (bucket, pieces) of its list, in the order of buckets."""
    parts = counted.sort_by("bucket").column("pieces")
    pieces = np.concatenate([np.empty(0, np.int64), *(unpack(p.as_py()) for p in parts)])
    row = {c: block.column(c)[0] for c in block.column_names}
    ends, steps, times = (unpack(row[c].as_py()) for c in ("ends", "places", "times"))
    first = np.concatenate(([0], ends))[:-1]
    sizes = np.diff(ends, prepend=0)
    upto = np.cumsum(steps)
    places = upto - np.repeat((upto - steps)[first[sizes > 0]], sizes[sizes > 0])
    return pa.table([row["doc_ids"].values, row["n_bytes"].values, pa.array(document_sums(pieces, ends, places, times))], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text).

    Each distinct pre-token of the corpus is encoded once, whatever its number of documents. Null and empty texts have 0 bytes and tokens; a null doc_id stays null; repeated rows each give a row; other columns are
    ignored; an empty table gives an empty one. A task holds one block of texts (or one longer text) or one bucket.
    """
    blocks = docs.select("doc_id", "text").mapInArrow(_cut, BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id())
    blocks = materialise(blocks, "frequencies")
    listed = blocks.agg(F.coalesce(F.sum("n_listed"), F.lit(0))).first()[0]
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, -(-listed // BUCKET_TOKENS))
    dealt = blocks.select("block", "tokens").mapInArrow(_dealer(buckets), "bucket long, of_block long, tokens binary")
    counted = dealt.groupBy("bucket").applyInArrow(_bucket_counter(model_file), "bucket long, of_block long, pieces binary")
    rows = blocks.drop("tokens", "n_listed").groupBy("block").cogroup(counted.groupBy("of_block")).applyInArrow(_sum_block, "doc_id long, n_bytes long, n_tokens long")
    out = materialise(rows.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} AS over_limit"), "counts")
    discard(blocks)
    return out
