"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are words (runs of letters and digits, lower-cased). A mask looks at some of the words of a
window and ignores the rest, so a hash of the words it looks at still agrees where an ignored word was
substituted. The masks of a window are chosen so that, wherever the substitutions that it may hold fall,
some mask at some place of the window looks at none of them. Hashes of benchmark windows are joined with those of the
documents that pass a broadcast filter of them, so only likely hits are shuffled, each with the words around it; there the
document and the item are aligned and a window of words is verified with some substitutions allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, bounded_broadcast, discard, fresh_name, materialise, maybe_in

#: Masks of one window size at most; they look at as many words as so many masks allow.
MOST_MASKS = 3
#: Windows up to so many words have spaced masks, found by enumeration; longer ones have a run of words.
ENUMERATED = 13
#: Items that are broadcast at most, by their words in all; more are joined by a shuffle.
BROADCAST_WORDS = 2_000_000
#: Documents are looked through in pieces of so many words, each with the words around it that a window can reach.
PIECE = 1024


@dataclass(frozen=True)
class Overlap:
    """A document holds an item where, of `window` aligned words (or all, of a shorter item), at
    least `percent` in a hundred agree. Items of under `least` words match nothing."""

    window: int = 13
    percent: int = 75
    least: int = 1

    def __post_init__(self) -> None:
        if self.window < 1 or not 1 <= self.percent <= 100:
            raise ValueError("the window must be 1 or more, the percentage 1 to 100")

    def allowed(self, size: int) -> int:
        """Substitutions that a window of `size` words may hold."""
        return size - -(-size * self.percent // 100)


Mask = tuple[int, ...]


def _covered(mask: Mask, size: int, patterns: list[int]) -> int:
    """A bit for each pattern of substitutions that the mask avoids at some place of a window."""
    places = [sum(1 << p + shift for p in mask) for shift in range(size - mask[-1])]
    return sum(1 << k for k, x in enumerate(patterns) if not all(x & p for p in places))


@lru_cache(maxsize=None)
def masks_for(size: int, allowed: int) -> tuple[Mask, ...]:
    """Masks (word positions from 0) of which some one, at some place of a window of `size` words, avoids any `allowed` positions."""
    run = size // (allowed + 1)  # one of allowed + 1 equal parts holds no substitution
    if size <= ENUMERATED:
        patterns = [sum(1 << p for p in at) for at in combinations(range(size), allowed)]
        for weight in range(size - allowed, run, -1):
            able = {m: _covered(m, size, patterns) for m in ((0, *rest) for rest in combinations(range(1, size), weight - 1))}
            left, chosen = (1 << len(patterns)) - 1, []
            while left and len(chosen) < MOST_MASKS:
                chosen.append(max(able, key=lambda m: ((able[m] & left).bit_count(), -m[-1])))
                left &= ~able[chosen[-1]]
            if not left:
                return tuple(chosen)
    return (tuple(range(run)),)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words; two words are taken for the same where their hashes are."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(masks: dict[Mask, list[int]], hashes: Column, at: Column, window: Column | None = None) -> Column:
    """The hash of each mask laid at the position `at` (from 0), null where it doesn't fit or isn't one of the window's size."""
    fits = lambda mask: at + mask[-1] < F.size(hashes)
    used = lambda mask: fits(mask) if window is None else fits(mask) & window.isin(masks[mask])
    return F.array(*(F.when(used(mask), F.xxhash64(F.lit(k), *(F.get(hashes, at + p) for p in mask))) for k, mask in enumerate(masks)))


def benchmark_items(benchmark: DataFrame, overlap: Overlap) -> tuple[DataFrame, DataFrame]:
    """(item_key, item) of the items' different word sequences, and (item_key, item_id) of all items that have them."""
    named = benchmark.where("text is not null").select("item_id", word_hashes(F.col("text")).alias("item")).where(F.size("item") >= max(1, overlap.least))
    items = materialise(named.groupBy("item").agg(F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("item_key"), "item"), "items")
    return items, materialise(named.join(items, "item").select("item_key", "item_id").distinct(), "item-names")


def _window(overlap: Overlap) -> Column:
    return F.least(F.lit(overlap.window), F.size("item"))


def masks_of(sizes: list[int], overlap: Overlap) -> dict[Mask, list[int]]:
    """The masks of windows of these sizes, each with the sizes that it serves."""
    out: dict[Mask, list[int]] = {}
    for size in sorted(sizes):
        for mask in masks_for(size, overlap.allowed(size)):
            out.setdefault(mask, []).append(size)
    return out


def benchmark_seeds(items: DataFrame, masks: dict[Mask, list[int]], overlap: Overlap) -> DataFrame:
    """seed, item_key, item_at, span of every masked window of every item."""
    placed = items.select("item_key", "item", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("item_at"))
    seeds = placed.select("item_key", "item_at", F.posexplode(_seeds(masks, F.col("item"), F.col("item_at"), _window(overlap))).alias("mask", "seed")).where("seed is not null")
    spans = F.element_at(F.array(*(F.lit(m[-1] + 1) for m in masks)), F.col("mask") + 1)
    return seeds.select("seed", "item_key", "item_at", spans.alias("span"))


def _best_window(overlap: Overlap) -> Column:
    """Most agreeing words of the windows that hold a hit; columns piece, at (in the piece), item, item_at, span."""
    size = _window(overlap)
    shift = F.col("at") - F.col("item_at")
    first = F.greatest(F.lit(0), -shift, F.col("item_at") + F.col("span") - size)
    last = F.least(F.col("item_at"), F.size("item") - size, F.size("piece") - shift - size)
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    agree = lambda s: F.size(F.filter(F.zip_with(F.slice("item", s + 1, size), F.slice("piece", s + shift + 1, size), lambda a, b: a == b), lambda same: same))
    return F.array_max(F.transform(starts, agree))


def _found(docs: DataFrame, items: DataFrame, overlap: Overlap, key: tuple[str, ...]) -> DataFrame:
    """key_0 and so on, item_key, matched, window, doc_at of each document and word sequence that it holds; a table."""
    reach = overlap.window - 1
    keys = [f"key_{k}" for k in range(len(key))]
    words, windows = items.agg(F.coalesce(F.sum(F.size("item")), F.lit(0)), F.collect_set(_window(overlap))).first()
    masks = masks_of(windows or [overlap.window], overlap)
    seeds = materialise(benchmark_seeds(items, masks, overlap), "seeds")
    cut = docs.where("text is not null").select(*(F.col(c).alias(k) for c, k in zip(key, keys, strict=True)), word_hashes(F.col("text")).alias("hashes"))
    starts = F.when(F.size("hashes") > 0, F.sequence(F.lit(0), F.size("hashes") - 1, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda b: F.slice("hashes", F.greatest(b - reach, F.lit(0)) + 1, F.least(b, F.lit(reach)) + PIECE + reach))
    cut = cut.select(*keys, F.posexplode(pieces).alias("nth", "piece"))
    own = F.when(F.col("nth") == 0, 0).otherwise(reach)  # where the piece's own words start
    last = F.least(own + PIECE, F.size("piece") - min(m[-1] for m in masks)) - 1
    cut = cut.where(last >= own)
    placed = cut.select(*keys, "nth", "piece", F.explode(F.sequence(own, last)).alias("at"))
    probes = placed.select(*keys, "nth", "piece", "at", F.explode(_seeds(masks, F.col("piece"), F.col("at"))).alias("seed")).where("seed is not null")
    likely = maybe_in(probes, "seed", bit_filter(seeds.select("seed").distinct(), "seed"))
    # a hit takes only the words around it along
    around = F.slice("piece", F.greatest(F.col("at") - reach, F.lit(0)) + 1, 2 * reach + 1)
    doc_at = F.col("nth") * PIECE - own + F.col("at")
    likely = likely.select(*keys, doc_at.alias("doc_at"), around.alias("piece"), F.least("at", F.lit(reach)).alias("at"), "seed")
    met = likely.join(seeds, "seed").join(bounded_broadcast(items, words, BROADCAST_WORDS), "item_key")
    found = met.select(*keys, "item_key", "doc_at", _window(overlap).alias("window"), _best_window(overlap).alias("matched"))
    found = found.where(F.col("matched") * 100 >= F.col("window") * overlap.percent)
    most = [F.max(c).cast("long").alias(c) for c in ("matched", "window")]
    out = materialise(found.groupBy(*keys, "item_key").agg(*most, F.min("doc_at").cast("long").alias("doc_at")), "found")
    discard(seeds)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap(), key: tuple[str, ...] = ("doc_id",)) -> DataFrame:  # noqa: B008
    """One row for each document and item that it holds: the key, item_id, matched (most agreeing words of
    a window), window (its words), doc_at (the first place of a hit, in words from 0).

    docs(doc_id, text) may hold null texts (no words, no match) and repeated rows (one row together, as
    long as the key is the same); a null doc_id is a key like another. benchmark(item_id, text) may be empty: no rows
    then. Items of the same words are each reported; repeated rows of one item once. Other columns are ignored.
    A document's words are dealt out in pieces, so a long document costs no more a word than a short one.
    """
    items, names = benchmark_items(benchmark, overlap)
    found = _found(docs, items, overlap, key)
    named = found.join(names, "item_key").select(*(F.col(f"key_{k}").alias(c) for k, c in enumerate(key)), "item_id", "matched", "window", "doc_at")
    out = materialise(named, "contaminated")
    for used in (items, names, found):
        discard(used)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:  # noqa: B008
    """The rows of docs that hold no item, all columns kept.

    Rows are told apart by doc_id and a hash of their text, so a clean row whose doc_id
    is null or repeated stays.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    items, names = benchmark_items(benchmark, overlap)
    bad_id, bad_hash = fresh_name(docs, "bad_id"), fresh_name(docs, "bad_hash")
    bad = _found(hashed, items, overlap, ("doc_id", "text_hash")).select(F.col("key_0").alias(bad_id), F.col("key_1").alias(bad_hash)).distinct()
    for used in (items, names):
        discard(used)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(bad_hash)), "left_anti")
