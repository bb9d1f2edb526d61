"""Patched frame-of-reference blocks: the binary format of token-id files.

A segment holds the ids of consecutive whole documents:

    magic "PFOR0001", u32 documents, u32 blocks, u64 ids, u32 exceptions
    i64 doc_id of each document, u8 null flag of each, u32 number of ids of each
    u64 block index: the word of the payload at which each block starts, and the end
    u32 minimum of each block, u8 width of each block, u32 first exception of each block (and the end)
    u8 place of each exception in its block, u32 its bits above the width
    u64 payload words

A block is 128 ids (the last one is filled up with its minimum). The block's minimum is
subtracted; the width holds at least the given percentile of the rest, and what stands above
the width is kept in the exception list. Integers are little-endian.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
MAGIC = b"PFOR0001"
PERCENTILE = 95


def _bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of integers below 2**32."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of BLOCK * width / 64 words."""
    out = np.zeros((2 * width, len(values)), np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for k in range(BLOCK):
        word, shift = divmod(k * width, 64)
        out[word] |= columns[k] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return out.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, len(words)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for k in range(BLOCK):
        word, shift = divmod(k * width, 64)
        v = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (columns[word + 1] << np.uint64(64 - shift))
        out[k] = v & mask
    return out.T


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of documents whose ids (uint32) stand one after another."""
    blocks = -(-len(ids) // BLOCK)
    rows = np.zeros((blocks, BLOCK), np.uint32)
    if blocks:
        flat = rows.reshape(-1)
        flat[: len(ids)] = ids
        flat[len(ids) :] = ids[(blocks - 1) * BLOCK :].min()
    least = rows.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = rows - least[:, None]
    rank = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    widths = _bits(np.partition(rest, rank, axis=1)[:, rank]) if blocks else np.empty(0, np.uint8)
    above = rest >> widths[:, None].astype(np.uint32) if blocks else rest
    above[widths == 32] = 0
    at_block, at_place = np.nonzero(above)
    starts = np.concatenate(([0], np.cumsum(2 * widths.astype(np.uint64)))).astype(np.uint64)
    payload = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(widths):
        if w:
            own = np.nonzero(widths == w)[0]
            kept = rest[own] & np.uint32((1 << int(w)) - 1)
            payload[(starts[own][:, None] + np.arange(2 * int(w), dtype=np.uint64)).astype(np.int64)] = _pack(kept, int(w))
    first = np.searchsorted(at_block, np.arange(blocks + 1)).astype(np.uint32)
    parts = [
        np.array([len(doc_ids), blocks], "<u4"), np.array([len(ids)], "<u8"), np.array([len(at_block)], "<u4"),
        np.array([0 if d is None else d for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.asarray(lengths, "<u4"),
        starts.astype("<u8"), least.astype("<u4"), widths, first.astype("<u4"),
        at_place.astype("u1"), above[at_block, at_place].astype("<u4"), payload.astype("<u8"),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a segment."""
    if data[:8] != MAGIC:
        raise ValueError("not a PFOR segment")
    at = 8

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at)
        at += out.nbytes
        return out

    docs, blocks = map(int, take("<u4", 2))
    total, extra = int(take("<u8", 1)[0]), int(take("<u4", 1)[0])
    doc_ids, null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    starts, least, widths = take("<u8", blocks + 1), take("<u4", blocks), take("u1", blocks)
    first, place, above = take("<u4", blocks + 1), take("u1", extra), take("<u4", extra)
    payload = take("<u8", int(starts[-1]))
    rows = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(widths):
        if w:
            own = np.nonzero(widths == w)[0]
            rows[own] = _unpack(payload[(starts[own][:, None] + np.arange(2 * int(w), dtype=np.uint64)).astype(np.int64)], int(w))
    if extra:
        block = np.repeat(np.arange(blocks), np.diff(first.astype(np.int64)))
        rows[block, place] |= above << widths[block].astype(np.uint32)
    rows += least[:, None]
    return [None if n else int(d) for d, n in zip(doc_ids, null, strict=True)], lengths, rows.reshape(-1)[:total]


def read_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block, found by the index of block starts (padding included)."""
    docs, blocks = np.frombuffer(data, "<u4", 2, 8)
    total = int(np.frombuffer(data, "<u8", 1, 16)[0])
    extra = int(np.frombuffer(data, "<u4", 1, 24)[0])
    if not 0 <= block < blocks:
        raise IndexError(block)
    docs, blocks = int(docs), int(blocks)
    at_starts = 28 + 13 * docs
    at_least = at_starts + 8 * (blocks + 1)
    at_width = at_least + 4 * blocks
    at_first = at_width + blocks
    at_place = at_first + 4 * (blocks + 1)
    at_above, at_payload = at_place + extra, at_place + 5 * extra
    start, end = map(int, np.frombuffer(data, "<u8", 2, at_starts + 8 * block))
    width = data[at_width + block]
    out = _unpack(np.frombuffer(data, "<u8", end - start, at_payload + 8 * start)[None, :], width)[0] if width else np.zeros(BLOCK, np.uint32)
    a, b = map(int, np.frombuffer(data, "<u4", 2, at_first + 4 * block))
    if b > a:
        out[np.frombuffer(data, "u1", b - a, at_place + a)] |= np.frombuffer(data, "<u4", b - a, at_above + 4 * a) << np.uint32(width)
    out = out + np.frombuffer(data, "<u4", 1, at_least + 4 * block)[0]
    return out[: max(0, min(BLOCK, total - block * BLOCK))]
