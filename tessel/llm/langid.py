"""Language identification by cross-parsing: a text is cut into the longest phrases that occur
in a language's labelled text, found with its suffix automaton; the language that needs
the fewest phrases a letter wins.

Automata are built once, a task a language, and sent to the workers as one hash table of their edges, whose size
follows the sampled text and not the number of different letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLDEN, blocks_of

#: Texts are parsed in pieces of at most so many characters; a phrase ends with its piece.
PIECE = 2048
SEPARATOR = 0
CODES = 0x110000
#: Whole texts that are learned from: rows of a language at most, the characters at which no further row is taken, and
#: the characters of all languages together (shared out evenly where there are many languages).
SAMPLE_ROWS, SAMPLE_CHARS, ALL_CHARS = 64, 100_000, 4_000_000


@dataclass(frozen=True)
class LanguageSamples:
    """Labelled text by language (bounded by the sample's parameters)."""

    texts: tuple[tuple[str, tuple[str, ...]], ...] = field(default_factory=tuple)


_is_letter: np.ndarray | None = None


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; other characters are one separator a run."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(k).isalpha() for k in range(CODES)), bool, CODES)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_is_letter[c], c, SEPARATOR)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SEPARATOR) | (c[:-1] != SEPARATOR)
    return c[keep].astype(np.int64)


def suffix_automaton(codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(states, edges, targets) of the suffix automaton of a code sequence; an edge is state * CODES + code, the root is 0."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes.tolist():
        now = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = now
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    state = np.repeat(np.arange(len(nxt)), [len(to) for to in nxt])
    code = np.fromiter((c for to in nxt for c in to), np.int64, len(state))
    target = np.fromiter((t for to in nxt for t in to.values()), np.int64, len(state))
    return len(nxt), state * CODES + code, target


class EdgeTable:
    """Edges in an open-addressed hash table, filled to a half at most."""

    def __init__(self, edges: np.ndarray, targets: np.ndarray):
        bits = max(1, int(2 * len(edges)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edges, self.targets = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._place(edges), np.arange(len(edges))
        while len(left):
            free = self.edges[at[left]] < 0
            self.edges[at[left[free]]] = edges[left[free]]
            own = self.edges[at[left]] == edges[left]
            self.targets[at[left[own]]] = targets[left[own]]
            left = left[~own]
            at[left] = (at[left] + 1) & self.mask

    def _place(self, edges: np.ndarray) -> np.ndarray:
        return ((edges.astype(np.uint64) * GOLDEN) >> self.shift).astype(np.int64)

    def find(self, edges: np.ndarray) -> np.ndarray:
        """The target of each edge, -1 where there is none."""
        at = self._place(edges)
        seen = self.edges[at]
        out = np.where(seen == edges, self.targets[at], -1)
        left = np.flatnonzero((seen != edges) & (seen >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            seen = self.edges[at[left]]
            same = seen == edges[left]
            out[left[same]] = self.targets[at[left[same]]]
            left = left[~same & (seen >= 0)]
        return out


class CrossParser:
    """The automata of all languages in one table of edges."""

    def __init__(self, samples: LanguageSamples | None = None, automata: list[tuple[str, int, np.ndarray, np.ndarray]] | None = None):
        if automata is None:
            automata = [(lang, *suffix_automaton(letter_codes("\n".join(texts)))) for lang, texts in samples.texts]
        self.languages = [lang for lang, *_ in automata]
        ends = np.cumsum([0, *(states for _, states, *_ in automata)])
        self.roots = ends[:-1].astype(np.int64)
        none = np.empty(0, np.int64)
        edges = np.concatenate([none, *(e + first * CODES for (*_, e, _), first in zip(automata, self.roots, strict=True))])
        self.table = EdgeTable(edges, np.concatenate([none, *(t + first for (*_, t), first in zip(automata, self.roots, strict=True))]))

    codes = staticmethod(letter_codes)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases [text, language], letters of each text)."""
        codes = [self.codes(t) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        letters = np.array([np.count_nonzero(c != SEPARATOR) for c in codes], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *codes])
        ends = np.cumsum(sizes)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - sizes)[owner] + nth * PIECE
        long = np.minimum(PIECE, ends[owner] - start)
        order = np.argsort(-long, kind="stable")
        start, long, owner = start[order], long[order], owner[order]
        languages = len(self.languages)
        # pieces by languages, so that those still read are the first rows
        root = np.broadcast_to(self.roots, (len(start), languages))
        state, count = root.copy(), np.zeros((len(start), languages), np.int64)
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")
        for t, n in enumerate(active.tolist()):
            c = np.repeat(flat[start[:n] + t], languages)
            now, done = state[:n].reshape(-1), count[:n].reshape(-1)
            to = self.table.find(now * CODES + c)
            failed = np.flatnonzero(to < 0)
            first = root[:n].reshape(-1)[failed]
            again = self.table.find(first * CODES + c[failed])
            to[failed] = np.where(again < 0, first, again)
            now[:] = to
            done[failed] += 1
        out = np.zeros((len(texts), languages), np.int64)
        np.add.at(out, owner, count + 1)  # the phrase that a piece's end closes
        return out, letters

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text; score: how far the runner-up's phrases exceed the winner's."""
        counts, letters = self.phrases([t or "" for t in texts])
        names = np.array([*self.languages, "und"], object)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = counts.argmin(axis=1)
        ranked = np.sort(counts, axis=1)
        second = ranked[:, 1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(letters > 0, 1 - ranked[:, 0] / second, 0.0)
        best = np.where(letters > 0, best, len(self.languages))
        return names[best].tolist(), np.nan_to_num(score)


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """lang, n, text: whole labelled texts, per language at most `rows` different ones in the order of their hashes, and none
    once those before it hold `chars` characters (fewer where ALL_CHARS is shared by many languages). Texts longer than
    that come last, so one is taken only where shorter ones don't suffice. Rows without language or letters are left out."""
    labelled = docs.select("lang", "text").where("lang is not null and lang <> 'und' and text rlike '\\\\p{L}'")
    key = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    # a row a language; of a language with many rows, only small hashes are ranked
    counts = [(r["lang"], int((1 << 40) * min(1.0, 16 * rows / r["n"]))) for r in labelled.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()]
    if not counts:
        return labelled.limit(0).select("lang", F.lit(0).alias("n"), "text")
    chars = min(chars, ALL_CHARS // len(counts))
    below = F.create_map(*(F.lit(x) for c in counts for x in c))[F.col("lang")]
    picked = labelled.where(key <= below).select("lang", key.alias("h"), "text", F.length("text").alias("size")).distinct()
    order = Window.partitionBy("lang").orderBy(F.col("size") > chars, "h", "text")
    held = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return picked.select("lang", F.row_number().over(order).alias("n"), "text", held.alias("held")).where((F.col("n") <= rows) & (F.col("held") < chars)).drop("held")


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    states, edges, targets = suffix_automaton(letter_codes("\n".join(rows.sort_values("n")["text"])))
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "states": [states], "edges": [edges.tobytes()], "targets": [targets.astype("<u4").tobytes()]})


def train_parser(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> CrossParser:
    """The automata of the sampled texts of docs(lang, text); about 20 bytes a sampled character reach the driver."""
    built = sample_texts(docs, rows, chars).groupBy("lang").applyInPandas(_build, "lang string, states long, edges binary, targets binary")
    of = lambda r: (r["lang"], r["states"], np.frombuffer(r["edges"], np.int64), np.frombuffer(r["targets"], "<u4").astype(np.int64))
    return CrossParser(automata=sorted(map(of, built.collect()), key=lambda a: a[0]))


def identify_languages(docs: DataFrame, train: Column, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs(doc_id, text, lang).

    Only rows where `train` holds are learned from, and of them text and lang alone. `und`, score 0:
    null texts, texts without a letter, and all texts where no labelled row exists. Ties go to the
    language first in order. Whole texts are learned from and parsed; repeated rows each give a row; other columns are
    ignored.
    """
    # bounded by the sample's parameters
    sent = docs.sparkSession.sparkContext.broadcast(train_parser(docs.where(train), rows, chars))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = sent.value
        for batch in batches:
            names, scores = [], [np.empty(0)]
            for a, b in blocks_of(batch.column("text"), 4 << 20):
                n, s = parser.predict(batch.column("text")[a:b].to_pylist())
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
