"""Quality classifier: cumulative-link ordinal regression on graded ratings.

Grades come from the labels: 0 low quality, 1 acceptable but toxic, 2 good. The model has one weight per hashed text
feature, shared by all grades, and ordered thresholds: P(grade <= k | x) = sigmoid(threshold_k - w.x). It gives the
expected grade and the tail probability P(grade >= SELECT_GRADE), which decides: ``KEEP_AT`` is the threshold, among 0.4
to 0.9, with the best sum of good texts kept and toxic texts rejected on held-out labels of check_s (see README).

Features of a text: for each word its lower-cased form, its first four and five bytes, its shape (case, digits, trailing
signs), and a mark for repeating the word before; a feature's value is the square root of its share of the text's words.
Features that fewer than ``MIN_TEXTS`` training texts have get no weight, so words of one text are not learned by heart.

Training reads at most ``sample_rows`` labelled rows per grade (those whose doc_id hashes lowest), weights grades
equally, and runs a fixed number of full-batch steps, so the model depends on the tables only. Scoring reads whole texts.

Defined cases: null, empty or wordless text has no features: it is scored by the thresholds alone and is never kept;
labels with nulls or without a document are not used; a doc_id labelled twice takes its lowest grade; if no labelled
row, or only one grade, is found, all texts with a word are kept with probability 1; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows

BITS, SAMPLE_ROWS, STEPS, MIN_TEXTS, SELECT_GRADE, KEEP_AT = 18, 2500, 250, 3, 2, 0.5
CACHE_ENTRIES = 300_000
_SIGNS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")


def _hash(feature: bytes, bits: int) -> int:
    """A bucket from 1 on; bucket 0 stands for no feature."""
    return (zlib.crc32(feature) * 0x9E3779B1 % (1 << 32) >> (32 - bits)) or 1


def word_features(word: bytes, bits: int = BITS) -> tuple[int, int, int, int]:
    tail = _SIGNS.search(word)
    end = tail[0][-1:] * min(len(tail[0]), 3) if tail else b""
    core = word[: tail.start()] if tail else word
    case = b"U" if core.isupper() and len(core) > 1 else b"D" if core.isdigit() else b"M" if any(48 <= c <= 57 for c in core) else b"E" if not core else b"w"
    low = core.lower()
    return _hash(b"w:" + low, bits), _hash(b"s:" + case + end, bits), _hash(b"p:" + low[:4], bits) if len(low) > 4 else 0, _hash(b"p:" + low[:5], bits) if len(low) > 5 else 0


class Features:
    """Hashed features of texts, with a bounded cache of words."""

    def __init__(self, bits: int = BITS):
        self.bits, self.repeat, self.cache = bits, _hash(b"repeat", bits), {}

    def __call__(self, data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = data.split() if data else []
        if not words:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
        counts = Counter(words)
        found = list(map(self.cache.get, counts))
        if None in found:
            for i, w in enumerate(counts):
                if found[i] is None:
                    found[i] = struct.pack("<4i", *word_features(w, self.bits))
                    if len(self.cache) < CACHE_ENTRIES:
                        self.cache[w] = found[i]
        tokens = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        at, place = np.unique(np.frombuffer(b"".join(found), dtype="<i4"), return_inverse=True)
        share = np.bincount(place, weights=np.repeat(tokens, 4))
        at, share = (at[1:], share[1:]) if at[0] == 0 else (at, share)
        if again := sum(map(eq, words, words[1:])):
            at, share = np.append(at, self.repeat), np.append(share, again)
        return at.astype(np.int32), np.sqrt(share / len(words)).astype(np.float32)


class OrdinalModel:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, grades: int):
        self.weights, self.thresholds, self.grades = weights, thresholds, grades

    def probabilities(self, score: float) -> np.ndarray:
        """P(grade = k) for each grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds - score, -60, 60)))
        return np.diff(np.concatenate(([0.0], below, [1.0])))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = 3, bits: int = BITS, steps: int = STEPS, min_texts: int = MIN_TEXTS, decay: float = 1e-4, rate: float = 0.15) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood; thresholds are a first one plus positive gaps."""
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    common = np.bincount(at, minlength=1 << bits)[at] >= min_texts
    at, value, owner = at[common], value[common], owner[common]
    share = np.bincount(grades, minlength=n_grades).astype(float)
    weight = 1 / (share[grades] * np.count_nonzero(share))
    free = np.concatenate((np.zeros(1 << bits), [-1.0], np.full(n_grades - 2, 0.5)))
    m, v = np.zeros_like(free), np.zeros_like(free)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        w, first, gaps = free[: 1 << bits], free[1 << bits], np.exp(free[(1 << bits) + 1 :])
        cuts = first + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(owner, weights=w[at] * value, minlength=len(rows))
        upper = np.where(grades < n_grades - 1, sigmoid(cuts[np.minimum(grades, n_grades - 2)] - score), 1.0)
        lower = np.where(grades > 0, sigmoid(cuts[np.maximum(grades - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight  # of log p, by the cut
        d_score = d_upper - d_lower  # of -log p, by the score
        d_cuts = np.bincount(np.minimum(grades, n_grades - 2), weights=-d_upper, minlength=n_grades - 1) + np.bincount(np.maximum(grades - 1, 0), weights=d_lower, minlength=n_grades - 1)
        grad = np.concatenate((np.bincount(at, weights=value * d_score[owner], minlength=1 << bits) + decay * w, [d_cuts.sum()], [d_cuts[i + 1 :].sum() * gaps[i] for i in range(n_grades - 2)]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        free -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = free[1 << bits] + np.concatenate(([0.0], np.cumsum(np.exp(free[(1 << bits) + 1 :]))))
    return OrdinalModel(free[: 1 << bits].astype(np.float32), cuts, n_grades)


def graded(labels: DataFrame) -> DataFrame:
    """(label_id, grade): 0 low quality, 1 acceptable but toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel | None:
    """The model, or None if the labelled rows found have fewer than two grades."""
    rated, sample = graded(labels), None
    for grade in range(3):
        part = rated.where(F.col("grade") == grade).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("data")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("data", "grade", "label_id")

    def make():
        features = Features()

        def each(datas, grades, ids):
            for data, grade, label_id in zip(datas, grades, ids):
                at, value = features(data)
                if len(at):
                    yield at.tobytes(), value.tobytes(), grade, label_id

        return each

    found = map_rows(texts, make, "at binary, value binary, grade int, label_id long")
    first = found.orderBy(F.xxhash64("label_id"), "label_id", F.xxhash64("at", "value")).limit(4 * sample_rows)  # more only if ids repeat
    rows = sorted(first.collect(), key=lambda r: (r.label_id, bytes(r.at)))
    grades = np.array([r.grade for r in rows], dtype=np.int64)
    if len(set(grades.tolist())) < 2:
        return None
    return fit([(np.frombuffer(r.at, dtype=np.int32), np.frombuffer(r.value, dtype=np.float32)) for r in rows], grades)


REPORT = "doc_id long, expected_grade double, tail_probability double, kept boolean"


def _judge(model: OrdinalModel | None, features: Features, data: bytes | None, keep_at: float) -> tuple[float, float, bool]:
    at, value = features(data)
    if model is None:
        return float(SELECT_GRADE), 1.0, bool(len(at))
    p = model.probabilities(float(model.weights[at] @ value) if len(at) else 0.0)
    tail = float(p[SELECT_GRADE:].sum())
    return float(p @ np.arange(model.grades)), tail, bool(len(at)) and tail >= keep_at


def classify(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, sample_rows: int = SAMPLE_ROWS, model: OrdinalModel | None = None) -> DataFrame:
    """One row per document row: expected grade, tail probability and verdict."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, sample_rows))

    def make():
        known, features = shared.value, Features()

        def each(ids, texts):
            for doc_id, text in zip(ids, texts):
                yield doc_id, *_judge(known, features, text, keep_at)

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, REPORT)


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, sample_rows: int = SAMPLE_ROWS, model: OrdinalModel | None = None) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels, sample_rows))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        known, features = shared.value, Features()
        for batch in batches:
            kept = [_judge(known, features, t.as_py().encode() if t.is_valid else None, keep_at)[2] for t in batch.column(names.index("text"))]
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return map_batches(docs, run, docs.schema)
