"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 4).

The two ratings of a labelled document make one grade: 0 low quality, 1 sound but toxic, 2 good.
P(grade <= k) = sigmoid(t_k - w.x), with one weight vector over hashed words and ordered thresholds
t_0 < t_1. A text gets its expected grade and the tail probability P(grade >= 2), which selects.

Features are the distinct words of the whole text and their beginnings, and the marks that words end with together
with how frequent they are, all hashed, and a few shares that describe its shape (capitals, digits, repetition). Hashed features
seen in fewer than ``min_docs`` training documents have no weight. Which marks and words tell is learnt from the labels alone.

The fit uses at most ``sample`` labelled rows, those with the smallest hash of their id, and of a longer text the
``MOST_BUCKETS`` hashed features that come first in a mixed order, so what reaches the driver is bounded in bytes (160 MB by default)
and repeatable whatever the size of the labels and the texts; scoring is one map over all documents and their whole texts, with
the weights (at most ``most_weights`` pairs) in the task's closure.

Defined cases: very long texts are scored whole, repeated rows each by itself and alike; null and empty texts have no words and are scored by the thresholds alone; labels that
are null, repeated or without a document are left out (of repeated ones the smallest grade holds);
with labels of fewer than two grades nothing is rejected; other columns are ignored.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts

GRADES, DIMENSIONS = 3, 1 << 22
SAMPLE, MIN_DOCS, MOST_WEIGHTS, MOST_BUCKETS = 20_000, 8, 200_000, 2048
#: Tail probability from which a document is kept.
LEAST = 0.75
EPOCHS, SELECT, SHRINK = 40, 8e-3, 2e-5
SHAPES, BEGINNINGS = 6, (4, 5)
PUNCTUATION = ".,;:!?\"'()[]{}«»„“”‘’…-*#%$&|"
MARK_BYTES = frozenset(string.punctuation.encode())


def word_buckets(word: bytes) -> tuple[int, ...]:
    """Hash buckets of a word without punctuation at its ends and without case, and of its beginnings."""
    plain = word.decode("utf-8", "replace").lower().strip(PUNCTUATION)
    if not plain:
        return ()
    return tuple(zlib.crc32(b"%d:" % k + plain[: k or None].encode()) % DIMENSIONS for k in (0, *BEGINNINGS) if k < len(plain))


def mark_of(word: bytes) -> bytes:
    """The punctuation that a word ends with, three characters of it at most."""
    end = len(word)
    while end and len(word) - end < 3 and word[end - 1] in MARK_BYTES:
        end -= 1
    return word[end:]


def mark_buckets(counts: dict[bytes, int], n: int) -> list[int]:
    """Hash buckets of the marks of a text of ``n`` words, each with the power of two that its share comes to."""
    return [zlib.crc32(b"m%d:" % (n // c).bit_length() + mark) % DIMENSIONS for mark, c in counts.items()]


def shape(text: bytes, words: list[bytes]) -> list[float]:
    """Shares of digits and capitals, of repeated lines and words, and the mean length of words."""
    n = len(words)
    if not n:
        return [0.0] * SHAPES
    digits = len(text) - len(text.translate(None, b"0123456789"))
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lines = [x for x in text.split(b"\n") if x]
    again = 1 - len(set(lines)) / max(1, len(lines))
    runs = [b" ".join(words[k : k + 4]) for k in range(0, max(1, n - 3))]
    return [min(1.0, digits / n), capitals / len(text), again, 1 - len(set(runs)) / len(runs), min(1.0, len(text) / n / 20), 1.0 / n]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    lookup: dict[int, float]
    marks: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k below the top grade."""
        return sigmoid(score[:, None] - self.thresholds[None, :])

    def score_text(self, text: bytes, cache: dict[bytes, dict[int, float]]) -> float:
        words = text.split()
        found: dict[int, float] = {}
        marks: dict[bytes, int] = {}
        for w, n in Counter(words).items():
            known = cache.get(w)
            if known is None:
                known = {b: self.lookup[b] for b in word_buckets(w) if b in self.lookup}, mark_of(w)
                if len(cache) > 300_000:
                    cache.clear()
                cache[w] = known
            hit, mark = known
            if hit:
                found.update(hit)
            if mark:
                marks[mark] = marks.get(mark, 0) + n
        found.update((b, self.lookup[b]) for b in mark_buckets(marks, len(words)) if b in self.lookup)
        return sum(found.values()) + float(np.dot(self.marks, shape(text, words)))


def fit(rows: list[tuple[int, np.ndarray, list[float]]], epochs: int = EPOCHS, min_docs: int = MIN_DOCS, most_weights: int = MOST_WEIGHTS, select: float = SELECT, shrink: float = SHRINK) -> Model:
    """Fit over ``(grade, distinct buckets, shape)``: a sparse fit picks the words, a second one weighs them."""
    grades = np.array([g for g, _, _ in rows], np.int64)
    if len(set(grades.tolist())) < 2:
        return Model({}, np.zeros(SHAPES), np.full(GRADES - 1, -40.0))
    seen = np.bincount(np.concatenate([b for _, b, _ in rows]).astype(np.int64), minlength=DIMENSIONS)
    often = np.flatnonzero(seen >= min_docs)
    if len(often) > most_weights:
        often = np.sort(often[np.argsort(-seen[often], kind="stable")[:most_weights]])
    shares = np.array([m for _, _, m in rows])
    for penalty, pace in ((select, 0.3), (shrink, 5.0)):
        place = np.full(DIMENSIONS, -1, np.int32)
        place[often] = np.arange(len(often))
        docs = [p[p >= 0] for p in (place[b] for _, b, _ in rows)]
        w, v, t = _descend(docs, shares, grades, len(often), epochs, penalty, pace)
        some = np.flatnonzero(w)
        often, w = often[some], w[some]
    return Model(dict(zip(often.tolist(), w.tolist(), strict=True)), v, t)


def _descend(docs: list[np.ndarray], shares: np.ndarray, grades: np.ndarray, n: int, epochs: int, penalty: float, first_rate: float, size: int = 512):
    """Proximal adaptive-gradient descent on the cumulative-link likelihood; the penalty makes weights vanish."""
    w, v = np.zeros(n), np.zeros(SHAPES)
    tally = np.bincount(grades, minlength=GRADES) + 1.0
    below = np.cumsum(tally)[:-1] / tally.sum()
    t = np.log(below / (1 - below))
    sw, sv, st = np.full(n, 1e-3), np.full(SHAPES, 1e-3), np.full(GRADES - 1, 1e-3)
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        rate = first_rate / (1 + epoch / 6)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), size):
            pick = order[at : at + size]
            lens = np.array([len(docs[i]) for i in pick])
            flat = np.concatenate([docs[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), lens)
            f = np.bincount(owner, w[flat], minlength=len(pick)) + shares[pick] @ v
            y = grades[pick]
            wide = np.concatenate([[-np.inf], t, [np.inf]])
            upper, lower = sigmoid(wide[y + 1] - f), sigmoid(wide[y] - f)
            g = 1 - upper - lower  # the slope of -log(upper - lower) in f
            grad = np.bincount(flat, g[owner], minlength=n) / len(pick)
            sw += grad * grad
            pace = rate / np.sqrt(sw)
            w -= pace * grad
            w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
            gv = shares[pick].T @ g / len(pick)
            sv += gv * gv
            v -= rate * gv / np.sqrt(sv)
            mass = np.maximum(upper - lower, 1e-9)
            gt = np.array([((lower * (1 - lower) / mass)[y == k + 1].sum() - (upper * (1 - upper) / mass)[y == k].sum()) / len(pick) for k in range(GRADES - 1)])
            st += gt * gt
            t = np.maximum.accumulate(t - rate * gt / np.sqrt(st) + np.arange(GRADES - 1) * 1e-9)
    return w, v, t


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[int, np.ndarray, list[float]]]:
    """Grades and features of the bounded sample of labelled documents."""
    quality, toxic = F.col("quality"), F.col("toxic")
    graded = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.when(quality <= 0, 0).when(toxic > 0, 1).otherwise(2)).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers

    def each(batch):
        buckets, shares = [], []
        for text in texts(batch.column(1)):
            words = text.split()
            found, marks = set(), {}
            for w, n in Counter(words).items():
                found.update(word_buckets(w))
                if mark := mark_of(w):
                    marks[mark] = marks.get(mark, 0) + n
            found.update(mark_buckets(marks, len(words)))
            if len(found) > MOST_BUCKETS:
                found = sorted(found, key=lambda b: (b * 0x9E3779B1) % DIMENSIONS)[:MOST_BUCKETS]
            buckets.append(sorted(found))
            shares.append(shape(text, words))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float64()))], names=["doc_id", "grade", "buckets", "shares"])

    got = map_texts(rows, ["doc_id", "text", "grade"], each, "doc_id long, grade int, buckets array<int>, shares array<double>").toArrow()
    seen, out = set(), []
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    buckets, shares = got.column("buckets").combine_chunks(), got.column("shares").to_pylist()
    for k in order.tolist():
        doc = got.column("doc_id")[k].as_py()
        if doc not in seen:
            seen.add(doc)
            out.append((got.column("grade")[k].as_py(), buckets[k].values.to_numpy(), shares[k]))
    return out


def score(docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """Score, expected grade, tail probability and verdict of every document."""

    def run(batches):
        from .common import sliced

        cache: dict = {}
        for batch in sliced(batches):
            s = np.array([model.score_text(t, cache) for t in texts(batch.column(1))])
            tails = model.tails(s)
            top = tails[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(tails.sum(1)), pa.array(top), pa.array(top >= least)], names=["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, expected_grade double, tail_probability double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """Fit on the labels' sample and score all documents."""
    return score(docs, fit(training_rows(docs, labels, sample)), least)
