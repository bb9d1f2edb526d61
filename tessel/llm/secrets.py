"""Secret scan in DataFrame operations only: fixed patterns, and character Markov models of random strings
and ordinary identifiers compared by their log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hash_sample, materialise

#: Fixed patterns. Java's (?i) folds ASCII letters alone. Runs of hex digits and of access-key characters are
#: matched whole, so shorter ones than wanted need not be matched.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

#: Strings that the models judge: whole runs of these characters, of 20 at least.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Labelled strings of each kind that the models are fitted on at most, and the texts that the ordinary ones come from.
SAMPLE_STRINGS, SAMPLE_TEXTS = 20_000, 2_000
#: The least ratio of a secret, in nats a character pair on average.
LEAST_RATIO = 0.5


@dataclass(frozen=True)
class MarkovModels:
    """Log-likelihood ratio, random over ordinary, of each pair of neighbouring characters: [first * width + second]."""

    ratio: tuple[float, ...]

    @property
    def width(self) -> int:
        return len(ALPHABET)


SPAN = "struct<start: bigint, kind: int, length: bigint, match: string>"
#: Elements that one step of a running fold goes over, as a power of two.
FOLD_BITS = 7
#: Halving steps of a search in a sorted array.
HALVES = [1 << k for k in range(30, -1, -1)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row: a lambda's variable isn't replaced by its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of longs, its values up to there merged, from 0.

    Blocks of 2**FOLD_BITS values are merged first and each place looks at the blocks before it and its own, so the
    work grows with the number of values and hardly with its square.
    """
    fold = lambda part: F.aggregate(part, F.lit(0).cast("long"), merge)
    width = 1 << FOLD_BITS

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, FOLD_BITS))
        own = lambda k: fold(F.slice(v, k - F.pmod(k, F.lit(width)) + 1, F.pmod(k, F.lit(width)) + 1))
        whole = F.transform(blocks, lambda b: fold(F.slice(v, b * width + 1, F.lit(width))))
        before = lambda sums: F.transform(blocks, lambda b: fold(F.slice(sums, F.lit(1), b)))
        reach = lambda upto: F.transform(v, lambda _, k: merge(F.get(upto, F.shiftright(k, FOLD_BITS)), own(k)))
        some = _let(whole, lambda sums: _let(before(sums), reach))
        return F.when(F.size(v) > 0, some).otherwise(F.array().cast("array<long>"))

    return _let(values, of)


def _placed(kind: int, pattern: str) -> Column:
    """(start, kind, length, match) of the matches of a kind in `text`, in code points: a match starts after the texts
    between the matches before it and those matches."""
    sizes = lambda strings: F.transform(strings, lambda x: F.length(x).cast("long"))

    def spans(m: Column) -> Column:
        matches_before = F.concat(F.array(F.lit(0).cast("long")), F.slice(sizes(m), F.lit(1), F.size(m) - 1))
        texts_before = F.slice(sizes(F.split("text", pattern, -1)), F.lit(1), F.size(m))
        starts = _running(F.zip_with(texts_before, matches_before, lambda a, b: a + b), lambda a, b: a + b)
        span = lambda at, x: F.struct(at.alias("start"), F.lit(kind).alias("kind"), F.length(x).cast("long").alias("length"), x.alias("match"))
        return F.when(F.size(m) > 0, F.zip_with(starts, m, span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _let(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), spans)


def ordinary_and_random(docs: DataFrame, samples: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled strings (string, random boolean) that the corpus itself labels, at most `samples` of each kind, in the
    order of their hashes: values that the fixed patterns find are random strings; words of 6 letters or more, with joints of _ and -, are
    ordinary identifiers where they don't stand in such a match.
    """
    text = F.coalesce("text", F.lit(""))
    # ordinary words come from SAMPLE_TEXTS different texts
    some = docs.where("text is not null")
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    # the texts of the smallest hashes: only hashes are ordered
    chosen = hash_sample(some.select(h.alias("h")).distinct(), SAMPLE_TEXTS, F.col("h"))
    # at most SAMPLE_TEXTS hashes: small enough to broadcast
    rows = some.withColumn("h", h).join(F.broadcast(chosen), "h", "left_semi").select("text").distinct()
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = rows.select(F.explode(F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?:[_-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("string")).where("length(string) >= 6")
    found = docs.where("text is not null").select(
        F.explode(F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))).alias("string")
    ).where(rf"length(string) >= 12 and string rlike '[0-9]' and string rlike '^[{ALPHABET}]+$'")
    tables = [materialise(df.distinct(), "strings") for df in (words, found)]
    pick = lambda df, random: hash_sample(df, samples, F.col("string")).select("string", F.lit(random).alias("random"))
    out = pick(tables[0], False).unionAll(pick(tables[1], True))
    out._tessel_tables = tables
    return out


def corpus_models(docs: DataFrame, samples: int = SAMPLE_STRINGS) -> MarkovModels:
    """Models fitted on the strings that the corpus itself labels."""
    labelled = ordinary_and_random(docs, samples)
    models = train_markov(labelled)
    for used in labelled._tessel_tables:
        discard(used)
    return models


def train_markov(labelled: DataFrame, smoothing: float = 0.5, backoff: float = 4.0) -> MarkovModels:
    """First-order models of the labelled strings (string, random), counted by Spark; the counts are one row
    a pair of characters and kind. A model's P(b after a) falls back, with the weight of `backoff` sightings, on its P(b),
    which is smoothed; with no strings of a kind, that model is uniform. Null strings are left out."""
    place = F.expr("sequence(1, length(string) - 1)")
    pairs = labelled.where("length(string) >= 2").select("random", "string", F.explode(place).alias("k"))
    counts = pairs.groupBy("random", F.expr("substring(string, k, 1)").alias("a"), F.expr("substring(string, k + 1, 1)").alias("b")).count()
    kept = counts.where(F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET))
    at = {c: k for k, c in enumerate(ALPHABET)}
    w = len(ALPHABET)
    n = {kind: [[0] * w for _ in range(w)] for kind in (False, True)}
    for r in kept.collect():  # at most 2 * 67 * 67 rows
        n[r["random"]][at[r["a"]]][at[r["b"]]] += r["count"]
    log = {}
    for kind, seen in n.items():
        single = [smoothing + sum(row[b] for row in seen) for b in range(w)]
        total = sum(single)
        log[kind] = [math.log((seen[a][b] + backoff * single[b] / total) / (sum(seen[a]) + backoff)) for a in range(w) for b in range(w)]
    return MarkovModels(tuple(r - o for r, o in zip(log[True], log[False], strict=True)))


def log_ratio(string: Column, models: MarkovModels) -> Column:
    """Mean log-likelihood ratio of a string's character pairs; 0 of strings under two characters."""
    table = F.array(*(F.lit(x) for x in models.ratio))
    place = F.array(*(F.lit(ALPHABET.find(chr(k))) for k in range(128)))
    # the last character has no successor and adds 0
    pair = lambda a, b: F.coalesce(F.get(table, a * models.width + b), F.lit(0.0))
    total = lambda codes: F.aggregate(F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), pair), F.lit(0.0), lambda a, x: a + x)
    mean = _let(F.transform(F.split(string, ""), lambda c: F.get(place, F.ascii(c))), total) / (F.length(string) - 1)
    return F.when(F.length(string) >= 2, mean).otherwise(0.0)


def _apart(added: Column, base: Column) -> Column:
    """The added spans that meet no base span; base spans ascend by start."""

    def kept(ends: Column) -> Column:  # the furthest end of the base spans up to each
        def meets(m: Column) -> Column:
            starts_before = lambda n: F.get(base, n - 1)["start"] < m["start"] + m["length"]
            further = lambda n, step: F.when((n + step <= F.size(base)) & starts_before(n + step), n + step).otherwise(n)
            count = F.aggregate(F.array(*map(F.lit, HALVES)), F.lit(0), further)
            return F.coalesce(F.get(ends, count - 1) > m["start"], F.lit(False))

        return F.filter(added, lambda m: ~meets(m))

    ends = _running(F.transform(base, lambda b: b["start"] + b["length"]), lambda a, b: F.greatest(a, b))
    return F.when((F.size(added) > 0) & (F.size(base) > 0), _let(ends, kept)).otherwise(added)


def scan_secrets(docs: DataFrame, models: MarkovModels, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """doc_id and spans: array of (start, kind number as in KINDS, length, match), by start, then kind.

    One row for each row of docs(doc_id, text); a null text is empty and has no spans; repeated rows each give a
    row; other columns are ignored. Matches of a kind are the leftmost ones that don't overlap. Strings that the
    models call random are added where they don't overlap a span of the fixed patterns. The work grows with a text's
    length and its matches, also where one run or one text holds a million characters or many thousand matches.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assigned = F.filter(_placed(0, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_LEAST)
    added = F.filter(_placed(3, CANDIDATE), lambda s: log_ratio(s["match"], models) >= least_ratio)
    join = lambda base: F.array_sort(F.concat(base, _let(added, lambda a: _apart(a, base))))
    spans = _let(F.array_sort(F.concat(assigned, _placed(1, ACCESS), _placed(2, HEX))), join)
    return text.select("doc_id", spans.alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; code points, end exclusive."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), (s["start"] + s["length"]).cast("string"))), ",")
