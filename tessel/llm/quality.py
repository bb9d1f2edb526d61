"""Quality classifier by positive-unlabelled learning: a linear model of text statistics that
minimises the non-negative unbiased risk of trusted positives and unlabelled web text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

#: Rows of each kind, positive and unlabelled, of the fitted sample.
SAMPLE_ROWS = 6000

_CLASSES = 16


def _class_table() -> np.ndarray:
    table = np.full(256, 15, np.uint8)
    table[128:] = 1  # bytes of letters beyond ASCII, mostly
    for k, chars in enumerate(
        [b"abcdefghijklmnopqrstuvwxyz", b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"'\"", b"()[]{}<>", b"|", b"#$%&*@^~`", b"-_=+/\\"]
    ):
        for c in chars:
            table[c] = k
    return table


_TABLE = _class_table()
FEATURES = _CLASSES * _CLASSES + 10


def text_features(text: str | None) -> np.ndarray:
    """Statistics of a whole text: shares of pairs of neighbouring character classes, and how
    words and lines repeat, and their lengths."""
    out = np.zeros(FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return out
    c = _TABLE[np.frombuffer(raw, np.uint8)].astype(np.int64)
    pairs = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / max(1, len(c) - 1))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, k = max(1, len(words)), max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    out[_CLASSES * _CLASSES :] = [
        1.0, len(set(words)) / n ** 0.9, same / n, np.sqrt(same / n), len(set(lines)) / k, lengths.mean() / 10 if len(words) else 0, (lengths > 30).mean() if len(words) else 0, np.log1p(len(words)) / 10, min(1.0, 20 / n), len(words) / k / 100,
    ]
    return out


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def _adam(gradient: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float = 0.02) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-60, 60)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 150) -> float:
    """Share of positives among the unlabelled rows.

    A classifier of positive against unlabelled rows is fitted on one half and ranks the other. Above
    any threshold the unlabelled share divided by the positive share is at least the prior, and
    equals it where negatives are absent; the least ratio, with a margin for its sampling error, is taken.
    """
    fit_p, ask_p, fit_u, ask_u = positive[::2], positive[1::2], unlabelled[::2], unlabelled[1::2]
    if min(map(len, (fit_p, ask_p, fit_u, ask_u))) == 0:
        return 0.5
    x = np.concatenate([fit_p, fit_u])
    y = np.concatenate([np.full(len(fit_p), 0.5 / len(fit_p)), np.zeros(len(fit_u))])
    c = np.concatenate([np.full(len(fit_p), 0.5 / len(fit_p)), np.full(len(fit_u), 0.5 / len(fit_u))])
    w = _adam(lambda w: x.T @ (c * _sigmoid(x @ w) - y) + 1e-4 * w, x.shape[1], steps)
    p, u = np.sort(ask_p @ w), np.sort(ask_u @ w)
    least = 1.0
    for at in np.quantile(p, np.linspace(0, 0.7, 71)):
        tail_p, tail_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        margin = np.sqrt(tail_u * (1 - tail_u) / len(u)) + np.sqrt(tail_p * (1 - tail_p) / len(p))
        least = min(least, (tail_u + margin) / tail_p)
    return float(min(max(least, 0.02), 0.98))


def fit_quality(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 400) -> QualityModel:
    """Non-negative PU learning with the logistic loss.

    Risk: prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]). Where the second part falls
    below 0, its gradient is followed upwards, so that the negatives' risk isn't driven below zero.
    Without positive or unlabelled rows every score is the prior (0.5 if that is unknown).
    """
    d = positive.shape[1]
    if not len(positive) or not len(unlabelled):
        p = 0.5 if prior is None else prior
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(p / (1 - p))), p)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 0.02
    p, u = (np.hstack([((x - mean) / scale).clip(-8, 8), np.ones((len(x), 1))]) for x in (positive, unlabelled))
    prior = estimate_prior(p, u) if prior is None else prior

    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
        negative = np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
        down = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        if negative < 0:
            return -down
        return prior * (p.T @ (sp - 1)) / len(p) + down + 1e-4 * w

    w = _adam(gradient, d + 1, steps)
    return QualityModel(mean, scale, w[:-1], float(w[-1]), prior)


def _featuriser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(rows, pa.binary())], ["kind", "x"])


def _sampled(ids: DataFrame, kind: int, rows: int) -> DataFrame:
    picked = hash_sample(ids.select("doc_id").where("doc_id is not null").distinct(), rows, F.col("doc_id"), F.lit(kind))
    return picked.select(F.col("doc_id").alias("k"), F.lit(kind).alias("kind"))


def train_quality(docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on a bounded sample: `rows` training rows labelled 1 (trusted) and `rows` of all
    training rows, their labels unread (unlabelled web text), both in the order of their hashes."""
    positive = _sampled(labels.where("quality = 1").where(train), 1, rows)
    unlabelled = _sampled(docs.where(train), 0, rows)
    chosen = positive.unionAll(unlabelled)
    # at most 2 * rows ids: small enough to broadcast
    texts = docs.where(train).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("kind", "text")
    got = texts.mapInArrow(_featuriser, "kind int, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES).astype(np.float64)
    # a fixed order, so that a fit doesn't depend on how rows were dealt out
    order = np.lexsort((*x.T[:12], x.T[-3], got["kind"].to_numpy()))
    x, kind = x[order], got["kind"].to_numpy()[order]
    mixed = np.random.default_rng(7).permutation(len(x))
    x, kind = x[mixed], kind[mixed]
    return fit_quality(x[kind == 1], x[kind == 0])


def _scorer(model: QualityModel) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(np.stack([text_features(t.as_py()) for t in batch.column("text")[k : k + 512]])) for k in range(0, batch.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["doc_id", "score"])

    return score


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, predicted of every row of docs(doc_id, text).

    Null and empty texts have the score of a text without characters; a null doc_id stays
    null; repeated rows each give a row; other columns are ignored.
    """
    scored = docs.select("doc_id", "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
