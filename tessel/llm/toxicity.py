"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all the ordered thresholds t_0 < t_1 < ...;
the severity is the expected grade.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, discard, hash_sample, lean, materialise

#: Labelled rows of the fitted sample.
SAMPLE_ROWS = 12_000
#: Words that the model weighs at most, the rows of the sample that must hold one, and the least chi-squared statistic
#: of its presence against the label (15: one of ten thousand unrelated words).
FEATURES, LEAST_ROWS, LEAST_STRENGTH = 4096, 4, 15.0
#: A toxic row's grade by how often words occur in it that mark toxic rows: so many for grades 2 and 3.
GRADE_CUTS = (2, 4)

_WORDS_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct words, how often each occurs); words: runs of letters and digits, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS_ONLY).split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(h, return_counts=True)


def _weighed(words: np.ndarray, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(places in `words`, ascending hashes, of those that the text holds; how often it holds each)."""
    h, n = word_counts(text)
    if not len(words):
        return np.empty(0, np.int64), n[:0]
    at = np.searchsorted(words, h)
    hit = words[np.minimum(at, len(words) - 1)] == h
    return at[hit], n[hit]


@dataclass(frozen=True)
class ToxicityModel:
    words: np.ndarray
    """Hashes of the weighed words, ascending."""
    weights: np.ndarray
    thresholds: np.ndarray
    """Ascending, one less than there are grades."""

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for [text, k]."""
        z = np.zeros(len(texts))
        for i, t in enumerate(texts):
            at, n = _weighed(self.words, t)
            z[i] = self.weights[at] @ np.log2(1.0 + n) if len(at) else 0.0
        return 1 / (1 + np.exp(-(z[:, None] - self.thresholds[None, :]).clip(-500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_columns: int, levels: int, steps: int = 600, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model of a sparse matrix, by Adam on its
    likelihood. Thresholds are t_0 plus sums of exponentials, hence ordered."""
    n = max(1, len(grades))
    shares = [min(max(np.mean(grades > k) if len(grades) else 0.5, 1e-3), 1 - 1e-3) for k in range(levels - 1)]
    start = np.maximum.accumulate(np.array([-np.log(s / (1 - s)) for s in shares]) + 1e-2 * np.arange(levels - 1))
    p = np.concatenate([np.zeros(n_columns), start[:1], np.log(np.diff(start) + 1e-2)])
    m, v = np.zeros_like(p), np.zeros_like(p)

    def thresholds(p: np.ndarray) -> np.ndarray:
        return p[n_columns] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_columns + 1 :].clip(-20, 5)))])

    pad = np.arange(len(grades))
    for t in range(1, steps + 1):
        z = np.bincount(rows, p[columns] * values, minlength=len(grades))
        cuts = thresholds(p)
        s = np.hstack([np.ones((len(grades), 1)), 1 / (1 + np.exp(-(z[:, None] - cuts).clip(-60, 60))), np.zeros((len(grades), 1))])
        d = s * (1 - s)
        chance = (s[pad, grades] - s[pad, grades + 1]).clip(1e-12)
        low, high = -d[pad, grades] / chance, d[pad, grades + 1] / chance  # of the negative log-likelihood
        by_cut = np.zeros((len(grades), levels + 1))
        by_cut[pad, grades] += low
        by_cut[pad, grades + 1] += high
        g_cut = -by_cut[:, 1:levels].sum(axis=0) / n
        g = np.empty_like(p)
        g[:n_columns] = np.bincount(columns, (low + high)[rows] * values, minlength=n_columns) / n + l2 * p[:n_columns]
        g[n_columns] = g_cut.sum()
        g[n_columns + 1 :] = np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(p[n_columns + 1 :].clip(-20, 5))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p[:n_columns], thresholds(p)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic) of each distinct word of each text."""
    for batch in batches:
        for a, b in blocks_of(batch.column("text")):
            held = [word_counts(t.as_py())[0] for t in batch.column("text")[a:b]]
            toxic = np.repeat(batch.column("toxic")[a:b].to_numpy() > 0, [len(h) for h in held])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64)), pa.array(toxic)], ["word", "toxic"])


def _counter(words: np.ndarray) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grade label, places of the chosen words that a text holds and how often it holds them."""
        for batch in batches:
            held = [_weighed(words, t.as_py()) for t in batch.column("text")]
            columns = [pa.array([x.astype("<u4").tobytes() for x, _ in held], pa.binary()), pa.array([np.minimum(n, 2**32 - 1).astype("<u4").tobytes() for _, n in held], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", "at", "n"])

    return count


def train_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, features: int = FEATURES) -> ToxicityModel:
    """Fit on at most `rows` labelled rows, in the order of their hashes, with their whole texts.

    labels(doc_id, toxic): 0 is grade 0. Where toxic is above 1 anywhere in the sample, it is the grade.
    A 0/1 label is graded: chosen words that occur mostly in toxic rows (log-odds above 2) are counted, and a toxic
    row has grade 1, 2 or 3 by GRADE_CUTS. Null ids, null labels and null texts are left out; of
    several labels of a document the largest counts. Without labelled rows nothing is toxic.

    Words are counted by Spark over the sample, which is a table in the shared folder; the driver gets the chosen
    words, and of each row how often it holds them, so its memory is bounded by rows and features, whatever the texts' length.
    """
    nothing = ToxicityModel(np.empty(0, np.uint64), np.empty(0), np.array([20.0, 21.0, 22.0]))
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("k")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = hash_sample(known, rows, F.col("k"))
    # at most `rows` ids: small enough to broadcast
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("toxic", "text")
    texts = materialise(texts, "toxicity")
    n, n_bad, top = texts.agg(F.count("*"), F.count_if(F.col("toxic") > 0), F.max("toxic")).first()
    if not n_bad or n_bad == n:
        discard(texts)
        return nothing
    seen = texts.mapInArrow(lean(_presence), "word long, toxic boolean").groupBy("word").agg(F.count("*").alias("held"), F.count_if("toxic").alias("bad")).where(F.col("held") >= LEAST_ROWS)
    expected = F.col("held") * F.lit(n_bad / n)
    strength = (F.col("bad") - expected) ** 2 / (expected * F.lit(1 - n_bad / n))
    best = seen.withColumn("strength", strength).where(F.col("strength") >= LEAST_STRENGTH).orderBy(F.desc("strength"), "word").limit(features).collect()
    best = sorted((np.int64(r["word"]).view(np.uint64), r["held"], r["bad"]) for r in best)
    words, held, bad = np.array([w for w, *_ in best], np.uint64), *(np.array([b[k] for b in best], np.float64) for k in (1, 2))
    got = texts.mapInArrow(lean(_counter(words)), "toxic int, at binary, n binary").toPandas()
    discard(texts)
    got = got.sort_values(["toxic", "at", "n"], kind="stable")  # the same sums whatever the order of the rows
    toxic = got["toxic"].to_numpy(np.int64)
    column, value = (np.concatenate([np.frombuffer(b, "<u4") for b in got[c]]).astype(np.int64) for c in ("at", "n"))
    row = np.repeat(np.arange(n), [len(b) // 4 for b in got["at"]])
    if top > 1:
        grades, levels = toxic, int(top) + 1
    else:
        odds = np.log((bad + 0.5) / (n_bad - bad + 0.5)) - np.log((held - bad + 0.5) / (n - n_bad - held + bad + 0.5))
        marks = np.bincount(row, value * (odds > 2)[column], minlength=n)
        grades = np.where(toxic > 0, 1 + sum(marks >= c for c in GRADE_CUTS), 0)
        levels = 2 + len(GRADE_CUTS)
    weights, thresholds = fit_ordinal(row, column, np.log2(1.0 + value), grades, len(words), levels)
    return ToxicityModel(words, weights, thresholds)


def _scorer(model: ToxicityModel) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = np.concatenate([np.empty((0, len(model.thresholds))), *(model.above(batch.column("text")[k : k + 256].to_pylist()) for k in range(0, batch.num_rows, 256))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(above.sum(axis=1)), pa.array(above[:, 0])], [*batch.schema.names[:-1], "severity", "p_toxic"])

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, reject_at: float = 0.5) -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (of a grade above 0), toxic (p_toxic >= reject_at).

    One row for each row of docs(doc_id, text). Null and empty texts have no words and the score
    of a text without any weighed word; a null doc_id stays null; other columns are ignored.
    """
    scored = docs.select("doc_id", "text").mapInArrow(lean(_scorer(model)), "doc_id long, severity double, p_toxic double")
    return scored.withColumn("toxic", F.col("p_toxic") >= reject_at)


def reject_toxic(docs: DataFrame, model: ToxicityModel, reject_at: float = 0.5) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns, in one pass."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            stays = [model.above(texts[k : k + 256].to_pylist())[:, 0] < reject_at for k in range(0, batch.num_rows, 256)]
            yield batch.filter(pa.array(np.concatenate(stays) if stays else np.empty(0, bool)))

    return docs.mapInArrow(lean(keep), docs.schema)
