"""Jaccard self-join of documents on word shingles.

1. A document's set is sorted 64-bit shingle hashes. Documents of equal sets form a class; the class
   with its smallest doc_id stands for them from here on. Where a doc_id is repeated it may lead several classes, and
   classes are numbered instead.
2. Sets are banded by size, and in a band hashes deal shingles to parts. Two linked sets differ in at most so many
   shingles, hence in so many parts; so of the filled parts in their order, one more than that many of each set's first
   ones must hold an equal part. Equal parts put sets into one tile, that of the smallest class among them. (A
   set that fills too few parts is dealt out again by other hashes.)
3. In a tile, hashed bitmaps bound overlaps from above: each bit in which two of them differ is a shingle
   that only one set has. Components of the pairs that the bound leaves are groups. A component too large for a block, such as a
   chain over many tiles, falls to its parts in each tile where these bring fewer sets than its blocks would.
4. Only members of groups bring their sets, once a group that they are in. Within a group the bounds are looked at again, and what they leave
   is intersected exactly; two sets that share several groups link in the first of them. Links leave the task as counts and a star, and components join the stars.

No pair of documents leaves a task, so a group of copies costs rows in proportion to its size. Tiles
of large groups are cut into blocks, each pair of which is a task's work. Keys are dealt out by ranges of
(key, class), so that the classes of a frequent key are spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, bit_filter, blocks_of, discard, fresh_name, lean, lean_group, materialise, maybe_in, mix64, scaled, shingle_set, without, word_hashes
from .components import connected_components

#: Bands grow by this factor.
BAND_STEP = 1.5
#: Shingles that one block of a tile holds.
BLOCK_SHINGLES = 1_000_000
#: Bitmaps that one block of a tile holds.
BLOCK_MEMBERS = 4096
#: How often a set that fills too few parts is dealt out again; one that still does so meets its like by one key a band.
DEALS = 8
#: Keys that one task sorts, about.
TASK_KEYS = 2_000_000
#: Shingles of candidates that are looked up at once.
LOOKUP = 1 << 18
#: Bytes of text that a task turns into sets at once, or one longer text.
TEXT_BLOCK = 1 << 20


@dataclass(frozen=True)
class Threshold:
    """Link where 100 * intersection >= percent * union."""

    percent: int

    def least_partner(self, size: int) -> int:
        """The size of the smallest set that can link with a set of this size."""
        return -(-size * self.percent // 100)

    def most_different(self, size: int, other: int) -> int:
        """Shingles that linked sets of at most these sizes have in one of them alone."""
        return (100 - self.percent) * (size + other) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        """The size of the largest set that can link with a set of this size."""
        return size * 100 // self.percent

    def links(self, common: np.ndarray, total: np.ndarray) -> np.ndarray:
        """common: size of the intersection, total: sum of the two sizes."""
        return (100 + self.percent) * common >= self.percent * total


def bands(up_to: int) -> np.ndarray:
    """First sizes of the bands, one past up_to included."""
    out = [1]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_STEP)))
    return np.array(out, np.int64)


BANDS = bands(1 << 40)
MIX_PART = np.uint64(0x2545F4914F6CDD1D)


def parts_of(threshold: Threshold, band: int) -> int:
    """Parts of a band: some more than its largest sets may differ in. A set of the band, or a smaller partner, so fills
    more parts than it may differ in, but for rare sets."""
    last = int(BANDS[band + 1]) - 1
    differ = threshold.most_different(last, last)
    return differ + differ // 4 + 3


def tile_keys(shingles: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Keys of the tiles that a set belongs to: its own band's and, where a larger partner can be in
    the next band, that one's. Two linked sets share a key.

    Of a set that differs from a partner in at most d parts, at least (filled - d) parts are the partner's too, so the
    first d + 1 filled parts of either hold a common one wherever one of them fills more than d. Only where
    neither does, both go on to the next deal.
    """
    n, out = len(shingles), []
    band = int(np.searchsorted(BANDS, n, side="right")) - 1
    while True:
        partner = min(threshold.largest_partner(n), int(BANDS[band + 1]) - 1)
        differ = threshold.most_different(n, partner)
        parts = parts_of(threshold, band) if differ else 1
        for deal in range(DEALS):
            h = mix64(shingles + scaled(band * DEALS + deal))
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, mix64(h ^ MIX_PART))
            filled = np.nonzero(np.bincount(part, minlength=parts))[0]
            first = filled[: differ + 1]
            out.append(mix64(sums[first] ^ mix64(first.astype(np.uint64) + scaled(band * DEALS + deal) + np.uint64(1))))
            if len(filled) > differ:
                break
        else:
            out.append(mix64(np.array([0xFFFF_FFFF], np.uint64) + scaled(band * DEALS)))
        band += 1
        if n < threshold.least_partner(int(BANDS[band])):
            return np.concatenate(out)


def _identity(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A set's signature of as many bits as it has shingles or more, a power of two from 64 on."""
    bits = 64
    while bits < len(shingles):
        bits *= 2
    at = mix64(shingles * GOLDEN) & np.uint64(bits - 1)
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """The signature that the same set has at fewer bits."""
    return np.bitwise_or.reduce(signature.reshape(-1, words), axis=0)


SIGNATURE = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, n_keys long, keys binary, bits binary"


def _signer(size: int, threshold: Threshold) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "n_keys", "keys", "bits"]
        for whole in batches:
            for start, end in blocks_of(whole.column("text"), TEXT_BLOCK):
                batch = whole[start:end]
                n, a, b, keys, bits = [], [], [], [], []
                for t in batch.column("text"):
                    s = shingle_set(word_hashes(t.as_py()), size)
                    n.append(len(s))
                    ident = _identity(s) if len(s) else (None, None)
                    a.append(ident[0])
                    b.append(ident[1])
                    keys.append(tile_keys(s, threshold).tobytes() if len(s) else b"")
                    bits.append(bitmap(s).tobytes())
                longs = [pa.array(x, pa.int64()) for x in (n, a, b, [len(k) // 8 for k in keys])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *longs, pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], names)

    return sign


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, key) of rows (class, keys)."""
    for batch in batches:
        held = [np.frombuffer(k.as_buffer(), np.int64) for k in batch.column("keys")]
        of = np.repeat(batch.column("class").to_numpy(), [len(k) for k in held])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *held]))], ["class", "key"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, class, edge) of rows (class, key) in the order of key and class: the classes of each key that has several,
    under the smallest of them that this task has.

    A key may go on in the tasks beside: the rows of a task's first key bring it as edge, and so does
    one row of its last key, also where there is but one class.
    """

    def rows(group: np.ndarray, classes: np.ndarray, edge: np.ndarray | None = None) -> pa.RecordBatch:
        edges = pa.nulls(len(group), pa.int64()) if edge is None else pa.array(edge, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(classes, pa.int64()), edges], ["group", "class", "edge"])

    first = key = least = None
    alone = False  # the last row is the first of its key and hasn't left
    for batch in batches:
        classes, keys = batch.column("class").to_numpy(), batch.column("key").to_numpy()
        if not len(keys):
            continue
        first = keys[0] if first is None else first
        goes_on = key is not None and keys[0] == key
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        counts = np.diff(np.append(starts, len(keys)))
        leasts = classes[starts].copy()
        shared = (counts > 1) | (keys[starts] == first)
        if goes_on:
            leasts[0], shared[0] = least, True
            if alone and key != first:
                yield rows(np.array([least]), np.array([least]))
        own, kept = np.repeat(leasts, counts), np.repeat(shared, counts)
        edge = keys[kept] == first
        for some, mark in ((edge, True), (~edge, False)):
            if some.any():
                yield rows(own[kept][some], classes[kept][some], np.full(int(some.sum()), first) if mark else None)
        key, least, alone = keys[-1], leasts[-1], not shared[-1]
    if key is not None:
        yield rows(np.array([least]), np.array([least]), np.array([key]))


def meetings(classes: DataFrame) -> DataFrame:
    """group, class: the classes that share a key, under the smallest of them; from rows (class, n_keys, keys)."""
    n = classes.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_KEYS))
    keyed = classes.select("class", "keys").mapInArrow(lean(_key_rows), "class long, key long")
    dealt = keyed.repartitionByRange(tasks, "key", "class").sortWithinPartitions("key", "class")
    found = materialise(dealt.mapInArrow(lean(_groups), "group long, class long, edge long").distinct(), "meetings")
    # a task brings one row of its last key, and rows of its first one under one group: at most two groups a task
    roots = found.where("edge is not null").groupBy("edge").agg(F.min("group").alias("root"))
    out = found.join(F.broadcast(roots), "edge", "left").select(F.coalesce("root", "group").alias("group"), "class").distinct()
    out = materialise(out, "tiles")
    discard(found)
    return out


def _setter(size: int) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, end in blocks_of(whole.column("text"), TEXT_BLOCK):
                batch = whole[start:end]
                found = [shingle_set(word_hashes(t.as_py()), size) for t in batch.column("text")]
                idents = [_identity(s) for s in found]
                same = [i == (x, y) for i, x, y in zip(idents, batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
                sizes, data = pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("class", "copies", "seats")), sizes, data], ["class", "copies", "seats", "n", "set"])
                yield out.filter(pa.array(same, pa.bool_()))  # another text of a repeated doc_id isn't the class's set

    return sets


def bitmaps(local: np.ndarray, owner: np.ndarray, n_sets: int, bits: int) -> np.ndarray:
    """Bitmap signatures [set, word] of sets given as flat element numbers with their owners."""
    out = np.zeros((n_sets, bits // 64), np.uint64)
    at = mix64(local.astype(np.uint64) * GOLDEN) & np.uint64(bits - 1)
    np.bitwise_or.at(out.reshape(-1), owner * (bits // 64) + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def join_sets(sets: list[np.ndarray], threshold: Threshold, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, linked j) for i of left with the j of right that come after it by size; each pair once.

    left, right: positions of sets, each ascending by size; where they share sets, a pair
    is met once. Size and bitmap bounds come first, the exact intersection last.
    """
    order = np.unique(np.concatenate([left, right]))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(order, sizes[order])
    shingle, local = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    local = local.astype(np.int32)  # a block's shingles are far fewer
    starts = np.zeros(len(sets) + 1, np.int64)
    starts[order + 1] = sizes[order]
    starts = np.cumsum(starts)
    bits = 64
    while 2 * bits < sizes[order].max():
        bits *= 2
    maps = bitmaps(local, owner, len(sets), bits)
    mark = np.zeros(len(shingle), np.int32)
    for i, j in screened(sizes, maps, threshold, left, right):
        mark[local[starts[i] : starts[i + 1]]] = 1
        parts = []
        for some in np.split(j, np.flatnonzero(np.diff(np.cumsum(sizes[j]) // LOOKUP)) + 1):
            n = sizes[some]
            ends = np.cumsum(n)
            at = np.repeat(starts[some] - (ends - n), n) + np.arange(ends[-1])
            parts.append(np.add.reduceat(mark[local[at]], ends - n))
        common = np.concatenate(parts)
        mark[local[starts[i] : starts[i + 1]]] = 0
        j = j[threshold.links(common, sizes[j] + sizes[i])]
        if len(j):
            yield i, j


def screened(sizes: np.ndarray, maps: np.ndarray, threshold: Threshold, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, j that the bitmaps let link with i) for i of left; left and right ascend by size, each pair once."""
    is_right = np.zeros(len(sizes), bool)
    is_right[right] = True
    own = sizes[right]
    for i in left.tolist():
        low = np.searchsorted(own, threshold.least_partner(int(sizes[i])), side="left")
        high = np.searchsorted(own, sizes[i] * 100 // threshold.percent, side="right")
        j = right[low:high]
        j = j[j > i] if is_right[i] else j
        if len(j):
            total = sizes[j] + sizes[i]
            differ = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
            j = j[(100 + threshold.percent) * (total - differ) >= 2 * threshold.percent * total]
            if len(j):
                yield i, j


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Positions to be met with each other: side 0 is a block on its own, 1 and 2 are two blocks of a tile."""
    side, every = g["side"].to_numpy(), np.arange(len(g))
    left, right = (every[side == 1], every[side == 2]) if side.any() else (every, every)
    return (left, right) if len(g) > 1 and len(left) and len(right) else (every[:0], every[:0])


def _screen(threshold: Threshold) -> Callable:
    def screen(rows: pd.DataFrame) -> pd.DataFrame:
        """(tile group, least, class) of the pairs that bitmaps leave in each group of one tile: rows (group, side, low, class, n, bits).

        least: the smallest class of a component of those pairs; of a group that is cut into blocks, which are tasks of their own, the group.
        """
        out = [np.empty((0, 3), np.int64)]
        for group, g in rows.groupby("group", sort=False):
            g = g.sort_values(["n", "class"], kind="stable")
            left, right = _sides(g)
            if not len(left):
                continue
            maps = [np.frombuffer(b, np.uint64) for b in g["bits"]]
            words = min(map(len, maps))
            maps = np.stack([folded(m, words) for m in maps])
            parent, ids = np.arange(len(g)), g["class"].to_numpy()
            for i, js in screened(g["n"].to_numpy(), maps, threshold, left, right):
                _join(parent, i, js)
            stars = _stars(parent, ids)
            least = stars[:, 1] if g["low"].iloc[0] < 0 else np.full(len(stars), group)
            out.append(np.stack([np.full(len(stars), group), least, stars[:, 0]], axis=1))
        found = np.concatenate(out)
        return pd.DataFrame({"tile_group": found[:, 0], "least": found[:, 1], "class": found[:, 2]})

    return screen


def _first_met(group: int, groups: list[np.ndarray]) -> Callable:
    """Which js share no smaller group with i than this one; groups: those of each member."""
    smaller = [np.asarray(x, np.int64)[np.asarray(x, np.int64) < group] for x in groups]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in smaller])))
    flat = np.concatenate(smaller)

    def keep(i: int, js: np.ndarray) -> np.ndarray:
        if not len(smaller[i]):
            return js
        held = np.concatenate(([0], np.cumsum(np.isin(flat, smaller[i]))))
        return js[held[starts[js + 1]] == held[starts[js]]]

    return keep


def _join(parent: np.ndarray, i: int, js: np.ndarray) -> None:
    if not len(js):
        return
    a = _find(parent, i)
    for r in np.unique(parent[js]).tolist():
        b = _find(parent, r)
        if a != b:
            a, b = min(a, b), max(a, b)
            parent[b] = a


def _stars(parent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """[id, smallest id of its group] of the members of groups of two or more."""
    root = np.array([_find(parent, k) for k in range(len(parent))])
    least = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    some = np.bincount(root, minlength=len(parent))[root] > 1
    return np.stack([ids[some], least[root][some]], axis=1)


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _tile(threshold: Threshold) -> Callable:
    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        """Links within the groups of one tile: rows (group, side, class, copies, n, set, groups).

        side 0: a block on its own, its members met with each other; 1 and 2: the two blocks of
        a tile, of which members of different blocks are met. groups: all groups of a class.
        """
        out = []
        for group, g in rows.groupby("group", sort=False):
            g = g.sort_values(["n", "class"], kind="stable").reset_index(drop=True)
            left, right = _sides(g)
            if not len(left):
                continue
            sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
            copies, links = g["copies"].to_numpy(), np.zeros(len(g), np.int64)
            parent, ids = np.arange(len(g)), g["class"].to_numpy()
            first_met = _first_met(group, g["groups"].tolist())
            for i, js in join_sets(sets, threshold, left, right):
                js = first_met(i, js)
                links[i] += copies[js].sum()
                links[js] += copies[i]
                _join(parent, i, js)
            both = _stars(parent, ids)
            out.append(pd.DataFrame({"a": both[:, 0], "b": both[:, 1], "links": links[links > 0]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})

    return verify


def _linked(docs: DataFrame, shingle: int, percent: int, block_shingles: int, block_members: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """signed rows, those that can link, their classes, stars of linked classes with link counts, whether doc_ids are repeated."""
    threshold = Threshold(percent)
    signed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(_signer(shingle, threshold)), SIGNATURE)
    wide = materialise(signed, "signatures")
    signed = materialise(wide.drop("n_keys", "keys", "bits"), "sets")
    of_sets = "doc_id is not null and n_shingles > 0"
    whole = signed.where(of_sets)
    repeats = _repeats(whole)
    # the copies of a class meet by partial results; equal sets have equal keys and bits
    one = lambda c: F.first(c).alias(c)
    classes = wide.where(of_sets).groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("lead"), F.count("*").alias("copies"), one("n_keys"), one("keys"), one("bits"))
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id() if repeats else F.col("lead")), "classes")
    discard(wide)  # keys and bits are the classes' from here on, and the next shuffle is the largest
    # tiles: the classes that share a key with a smaller one, seated with it
    met = meetings(classes)
    info = classes.select("class", F.col("n_shingles").alias("n"), "bits")
    screen = _seated(met.withColumn("weight", F.lit(1)), block_members).join(info, "class").select("class", "n", "bits", "seat.*")
    close = screen.groupBy("tile", "low", "high").applyInPandas(lean_group(_screen(threshold)), "tile_group long, least long, class long")
    # two groups of one hash are one group, in which each pair is met once all the same
    close = materialise(close.select(F.xxhash64("tile_group", "least").alias("group"), "class", "least").distinct(), "parts")
    whole_groups = connected_components(close.select(F.col("class").alias("a"), F.col("least").alias("b")))
    near = materialise(_lighter(close.select("group", "class"), whole_groups, classes.select("class", F.col("n_shingles").alias("n")), block_shingles), "groups")
    for used in (close, whole_groups):
        discard(used)

    members = classes.join(near, F.col("class") == F.col("node")).select("set_a", "set_b", "lead", "class", "copies", "group", F.col("n_shingles").alias("weight"))
    seats = _seated(members, block_shingles)
    by_class = seats.groupBy("class", "lead", "set_a", "set_b", "copies").agg(F.collect_list("seat").alias("seats"))
    by_class = materialise(by_class, "members")
    # texts that no group needs stay where they are
    texts = maybe_in(docs.select("doc_id", "text"), "doc_id", bit_filter(by_class.select("lead"), "lead"))
    texts = texts.join(by_class.hint("merge"), F.col("doc_id") == F.col("lead")).select("text", "class", "set_a", "set_b", "copies", "seats")
    sets = texts.mapInArrow(lean(_setter(shingle)), f"class long, copies long, seats {dict(by_class.dtypes)['seats']}, n long, set binary")
    # rows of a repeated doc_id bring the same set again
    groups = F.array_distinct(F.transform("seats", lambda s: s["group"]))
    seated = sets.select("class", "copies", "n", "set", groups.alias("groups"), F.explode("seats").alias("seat")).select("class", "copies", "n", "set", "groups", "seat.*")
    seated = _once(seated, ["class", "group", "low", "high"], repeats)
    found = seated.groupBy("tile", "low", "high").applyInPandas(lean_group(_tile(threshold)), "a long, b long, links long")
    found = materialise(found, "links")
    for used in (met, near, by_class):
        discard(used)
    return signed, whole, classes, found, repeats


def _lighter(parts: DataFrame, wholes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """group, node: wholes(node, component), but for those that are heavier when cut into blocks of `most` than their parts(group, class)."""
    cut = lambda weight: weight * F.ceil(weight / most)
    of = sizes.join(wholes, F.col("class") == F.col("node")).select("class", "component", "n")
    by_whole = of.groupBy("component").agg(cut(F.sum("n")).alias("seated"), F.sum("n").alias("total")).where(f"total > {most}")
    in_parts = parts.join(of.join(by_whole.select("component"), "component", "left_semi"), "class")
    by_part = in_parts.groupBy("component", "group").agg(cut(F.sum("n")).alias("w")).groupBy("component").agg(F.sum("w").alias("apart"))
    split = by_whole.join(by_part, "component").where("apart < seated").select("component")
    kept = wholes.join(split, "component", "left_anti").select(F.col("component").alias("group"), "node")
    return kept.unionAll(in_parts.join(split, "component", "left_semi").select("group", F.col("class").alias("node")))


def _once(rows: DataFrame, key: list[str], repeats: bool) -> DataFrame:
    """One row a key; without repeated ids there is no more."""
    return rows.dropDuplicates(key) if repeats else rows


def ngram_jaccard_join(docs: DataFrame, shingle: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs(doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their shingle sets; n_links counts
    the other rows that a row links with, component_id is the smallest doc_id that links reach. Null and empty
    texts, and texts of white space, have empty sets: they link with nothing and are their own component.
    Rows of one doc_id share its component; a null doc_id has a null component and takes part in no link. Other
    columns are ignored; an empty table gives an empty one.
    """
    signed, whole, classes, found, repeats = _linked(docs, shingle, percent, block_shingles, block_members)
    aliases = whole.join(classes.select("set_a", "set_b", "lead", "copies"), ["set_a", "set_b"])
    copies = aliases.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    stars = found.select("a", "b")
    if repeats:  # from classes to doc_ids
        for end in ("a", "b"):
            stars = stars.join(classes.select(F.col("class").alias(end), F.col("lead").alias(f"{end}_lead")), end)
        stars = stars.select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b"))
    parts = connected_components(stars.unionAll(copies))
    linked = found.groupBy("a").agg(F.sum("links").alias("links"))
    per_class = classes.join(linked, F.col("class") == F.col("a"), "left").select("set_a", "set_b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(per_class, ["set_a", "set_b"], "left")
    out = out.join(parts, F.col("doc_id") == F.col("node"), "left")
    n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0)))
    out = materialise(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), n_links.alias("n_links")), "joined")
    for used in (signed, classes, found, parts):
        discard(used)
    return out


def _seated(members: DataFrame, most: int) -> DataFrame:
    """members(group, class, weight) with the column seat: tile, low, high, group, side.

    A group of at most `most` in weight is a block of its own and shares a tile with others by its hash; a heavier
    one is cut into blocks by hashes of its classes, and each pair of blocks is a tile. The blocks of a group are
    joined to its members, so a heavy group is split by adaptive execution like any skewed key.
    """
    weight = members.groupBy("group").agg(F.sum("weight").alias("total"))
    tiles = max(1, 8 * -(-(weight.agg(F.sum("total")).first()[0] or 0) // most))
    sized = members.join(weight.select("group", F.ceil(F.col("total") / most).cast("int").alias("blocks")), "group")
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    placed = sized.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    seat = F.struct(
        F.when(alone, F.pmod(F.xxhash64("group"), F.lit(tiles))).otherwise(F.col("group")).alias("tile"),
        F.when(alone, -1).otherwise(F.least("block", "other")).alias("low"), F.when(alone, -1).otherwise(F.greatest("block", "other")).alias("high"),
        F.col("group"), side.alias("side"),
    )
    return placed.select(*(c for c in members.columns if c not in ("group", "weight")), seat.alias("seat"))


def _repeats(rows: DataFrame) -> bool:
    return bool(rows.groupBy("doc_id").count().where("count > 1").limit(1).count())


def keep_one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id, all columns kept.

    Of the rows of one doc_id in a component one stays; rows of a null doc_id stay.
    """
    found = ngram_jaccard_join(docs, shingle, percent)
    name = fresh_name(docs, "gone")
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    rest = without(docs, "doc_id", gone)
    if not _repeats(docs.where("doc_id is not null")):
        return rest
    return rest.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rest.where("doc_id is null"))


def drop_copies(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked sets, the one of the smallest doc_id, all columns kept.

    Groups are of sets, not of doc_ids: where a doc_id is repeated with different texts, a row goes only if its own set reaches
    a kept one by links. Rows of empty sets are copies of each other where they have one doc_id; rows of a null doc_id stay.
    """
    if not _repeats(docs.where("doc_id is not null")):
        return keep_one_of_each(docs, shingle, percent)
    signed, _, classes, found, _ = _linked(docs, shingle, percent, BLOCK_SHINGLES, BLOCK_MEMBERS)
    parts = connected_components(found.select("a", "b"))
    rows = signed.where("doc_id is not null").join(classes.select("set_a", "set_b", "class"), ["set_a", "set_b"], "left").join(parts, F.col("class") == F.col("node"), "left")
    group = F.coalesce("component", "class")
    first = rows.groupBy(group.alias("group"), F.when(group.isNull(), F.col("doc_id")).alias("alone")).agg(F.min(F.struct("doc_id", "text_hash")).alias("kept"))
    id_, hash_ = fresh_name(docs, "kept_id"), fresh_name(docs, "kept_hash")
    first = materialise(first.select(F.col("kept.doc_id").alias(id_), F.col("kept.text_hash").alias(hash_)), "kept")
    for used in (signed, classes, found, parts):
        discard(used)
    kept = docs.join(first, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(hash_)), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
