"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Base patterns are matched leftmost and non-overlapping per kind over the whole text; matches that are too short are
dropped after matching. The method looks at every part of a run of ``[A-Za-z0-9+/_.=-]`` that no base span covers and
that has ``MIN_LENGTH`` characters or more: two first-order character models, one trained on labelled random strings and
one on labelled ordinary identifiers, give a log-likelihood ratio per character. A part above the threshold is added as
kind ``markov``; of another part, the stretch between separators that exceeds the threshold most in sum is added, and
what is left on its two sides is searched again. Counts are smoothed by back-off, so that few samples do. The threshold
lies midway between the best stretches of a share ``QUANTILE`` of the held-out ordinary identifiers and the scores that a
share ``RANDOM_SHARE`` of the held-out random strings reach, at least ``MARGIN`` above the first. Each document's best
ratio (the highest score of an uncovered part or added stretch) is reported, so that the method shows where it adds none.

Training takes labelled samples from a table (sample, is_random), at most ``SAMPLE_WORDS`` of each label (those that hash
lowest). Without such a table it reads the whole texts of at most ``SAMPLE_DOCS`` documents (those whose id hashes
lowest): up to ``SAMPLE_WORDS`` of their words (those that hash lowest), and identifiers joined from them, are the samples
labelled ordinary, and the samples labelled random come from a seeded generator.

Defined cases: null text is empty and has no spans; repeated rows are answered one by one; offsets are code points, end
exclusive; a markov span never overlaps a base span; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "markov")
MIN_LENGTH, MARGIN, QUANTILE, RANDOM_SHARE, SAMPLE_DOCS, SAMPLE_WORDS, SEED = 16, 0.15, 0.995, 0.99, 400, 40_000, 7
BACK_OFF, PRIOR = 2.0, 0.5
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(len(ALPHABET))
_RUNS = bytes(b if _CODE[b] >= 0 else 32 for b in range(256))
_EDGES = b"+/_.=-"
_PIECE = re.compile(rb"[^+/_.=-]+")

REPORT = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, best_ratio double"


class MarkovModel:
    """First-order character model over ALPHABET: transitions drawn towards the characters' own shares, those towards equal
    shares. ``BACK_OFF`` and ``PRIOR`` are the counts that the drawing is worth."""

    def __init__(self, samples: list[str]):
        size = len(ALPHABET)
        counts = np.zeros((size, size))
        single = np.full(size, PRIOR)
        for s in samples:
            codes = _CODE[np.frombuffer(s.encode(), dtype=np.uint8)]
            codes = codes[codes >= 0]
            np.add.at(counts, (codes[:-1], codes[1:]), 1)
            np.add.at(single, codes, 1)
        self.log = np.log((counts + BACK_OFF * single / single.sum()) / (counts.sum(axis=1, keepdims=True) + BACK_OFF))


class RandomnessModel:
    """Log-likelihood ratio per character of random strings against ordinary identifiers. Every fifth sample of each label
    is held out; the threshold is the middle between what almost all held-out ordinary samples stay below and what almost
    all held-out random ones reach, but never within ``margin`` of the ordinary ones."""

    def __init__(self, random_strings: list[str], ordinary: list[str], margin: float = MARGIN):
        held = [[s for i, s in enumerate(x) if i % 5 == 0 and len(s) >= MIN_LENGTH] for x in (random_strings, ordinary)]
        self.ratio = MarkovModel([s for i, s in enumerate(random_strings) if i % 5]).log - MarkovModel([s for i, s in enumerate(ordinary) if i % 5]).log
        high = [self.score(s.encode()) for s in held[0]]
        low = [x for x in (self.best_stretch(s.encode()) for s in held[1]) if np.isfinite(x)]
        least, most = float(np.quantile(high, 1 - RANDOM_SHARE)) if high else np.inf, float(np.quantile(low, QUANTILE)) if low else 0.0
        self.threshold = max(most + margin, (most + least) / 2) if high else most + 2 * margin

    def score(self, run: bytes) -> float:
        codes = _CODE[np.frombuffer(run, dtype=np.uint8)]
        return float(self.ratio[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else -np.inf

    def best_stretch(self, run: bytes) -> float:
        """The highest score of a stretch of whole pieces with MIN_LENGTH characters or more."""
        ends = [m.span() for m in _PIECE.finditer(run)]
        return max((self.score(run[a:b]) for i, (a, _) in enumerate(ends) for _, b in ends[i:] if b - a >= MIN_LENGTH), default=-np.inf)

    def stretches(self, run: bytes) -> list[tuple[int, int]]:
        """The stretches above the threshold: the whole run, or those of its pieces, the largest excess first."""
        if len(run) < MIN_LENGTH:
            return []
        if self.score(run) > self.threshold:
            return [(0, len(run))]
        codes = _CODE[np.frombuffer(run, dtype=np.uint8)]
        total = np.concatenate(([0.0, 0.0], np.cumsum(self.ratio[codes[:-1], codes[1:]] - self.threshold)))  # up to a character
        total, pieces, out = total[1:], [m.span() for m in _PIECE.finditer(run)], []
        todo = [(0, len(pieces))]
        while todo:
            low, high = todo.pop()
            first, start, found = low, None, (0.0, None, None)
            for j in range(low, high):
                while first <= j and pieces[j][1] - pieces[first][0] >= MIN_LENGTH:
                    if start is None or total[pieces[first][0]] < total[pieces[start][0]]:
                        start = first
                    first += 1
                if start is not None and total[pieces[j][1] - 1] - total[pieces[start][0]] > found[0]:
                    found = (total[pieces[j][1] - 1] - total[pieces[start][0]], start, j)
            if found[1] is not None:
                out.append((pieces[found[1]][0], pieces[found[2]][1]))
                todo += [(low, found[1]), (found[2] + 1, high)]
        return sorted(out)


def random_samples(n: int = 6000, seed: int = SEED) -> list[str]:
    """Strings labelled random: base-62, base-64, upper-case keys and hex digits, 16 to 64 characters."""
    rng = random.Random(seed)
    sets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
    return ["".join(rng.choices(sets[i % 4], k=rng.randint(16, 64))) for i in range(n)]


def words_of(text: bytes) -> set[bytes]:
    return {w for w in text.translate(_RUNS).split() if len(w) > 3 and w.isalpha()}


def ordinary_samples(found: list[bytes], seed: int = SEED) -> list[str]:
    """Strings labelled ordinary: the words, and identifiers, paths and file names joined from them."""
    rng = random.Random(seed)
    words = [w.decode() for w in sorted(found)]
    rng.shuffle(words)
    words = words or ["ordinary", "words", "when", "there", "none"]
    joined = []
    for i in range(min(SAMPLE_WORDS, 4 * len(words))):
        parts = rng.choices(words, k=rng.randint(2, 4))
        joined.append((lambda p: ("_".join(p), "-".join(p).lower(), p[0].lower() + "".join(x.capitalize() for x in p[1:]), "/".join(p) + ".txt", "_".join(p).upper(), ".".join(p))[i % 6])(parts))
    return words + joined


def labelled_samples(samples: DataFrame) -> RandomnessModel:
    """The model of a table of labelled samples: sample string, is_random boolean. Nulls are not used."""
    told = [samples.where(F.col("is_random") == flag).where("sample is not null").select("sample").distinct().orderBy(F.xxhash64("sample"), "sample").limit(SAMPLE_WORDS).collect() for flag in (True, False)]
    kept = [["".join(c for c in r.sample if c in ALPHABET) for r in rows] for rows in told]  # bounded training samples
    return RandomnessModel(*kept)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, samples: DataFrame | None = None) -> RandomnessModel:
    if samples is not None:
        return labelled_samples(samples)
    ids = docs.select(F.col("doc_id").alias("sample_id")).where("sample_id is not null").distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(sample_docs)

    def make():
        def each(texts):
            for text in texts:
                yield from ((w,) for w in words_of(text or b""))

        return each

    texts = docs.join(F.broadcast(ids), docs["doc_id"] == ids["sample_id"]).select(F.col("text").cast("binary").alias("data"))
    words = map_rows(texts, make, "word binary").distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS)
    return RandomnessModel(random_samples(), ordinary_samples([bytes(r.word) for r in words.collect()]))  # a bounded training sample


def long_runs(data: bytes) -> list[tuple[int, bytes]]:
    """Maximal runs of MIN_LENGTH or more ALPHABET bytes, with their byte offsets."""
    blanked, out, at = data.translate(_RUNS), [], 0
    for run in blanked.split():
        if len(run) >= MIN_LENGTH:
            at = blanked.find(run, at)
            out.append((at, run))
            at += len(run)
    return out


def _uncovered(start: int, end: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) outside the base spans, which are sorted by start."""
    parts = []
    for low, high in base:
        if high > start and low < end:
            parts.append((start, low))
            start = max(start, high)
    return [(low, high) for low, high in (*parts, (start, end)) if high - low >= MIN_LENGTH]


def find_spans(data: bytes | None, model: RandomnessModel | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in code points, by start, then kind."""
    return scan_text(data, model)[0]


def scan_text(data: bytes | None, model: RandomnessModel | None) -> tuple[list[tuple[int, int, str]], float | None]:
    """The spans of ``find_spans``, and the best ratio (None if no uncovered part is long enough)."""
    if not data:
        return [], None
    spans: list[tuple[int, int, str]] = []
    text, best = data.decode(), None
    if b"=" in data or b":" in data:
        spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    runs: list[tuple[int, bytes]] = []
    plain = len(text) == len(data)
    for at, run in long_runs(data):
        start = at if plain else len(data[:at].decode())
        inner = run.decode()
        if "AKIA" in inner:
            spans += [(start + m.start(), start + m.end(), "access") for m in ACCESS.finditer(inner) if len(m[0]) >= 18]
        spans += [(start + m.start(), start + m.end(), "hex") for m in HEX.finditer(inner) if len(m[0]) >= 16]
        runs.append((start, run))
    if model is not None:
        base = sorted(x[:2] for x in spans)
        for start, run in runs:
            for low, high in _uncovered(start, start + len(run), base):
                part = run[low - start : high - start]
                core = part.strip(_EDGES)
                low += len(part) - len(part.lstrip(_EDGES))
                found = model.stretches(core)
                spans += [(low + a, low + b, "markov") for a, b in found]
                if len(core) >= MIN_LENGTH:
                    best = max([*(model.score(core[a:b]) for a, b in found), model.score(core), *([] if best is None else [best])])
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])), best


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secret_scan(docs: DataFrame, model: RandomnessModel | None = None) -> DataFrame:
    """One row per document row: counts per kind, digest of the base spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def make():
        known = shared.value

        def each(ids, texts):
            for doc_id, text in zip(ids, texts):
                spans, best = scan_text(text, known)
                n = [sum(s[2] == kind for s in spans) for kind in KINDS]
                yield doc_id, *n, hashlib.sha256(_joined(s for s in spans if s[2] != "markov").encode()).hexdigest(), _joined(spans), best

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, REPORT)


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str = "<SECRET>") -> str | None:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    if not spans:
        return text
    out, last, end = [], 0, -1
    for start, stop, _ in sorted(spans):
        if start >= end:
            out.append(text[last:start] + mark)
        end = max(end, stop)
        last = end
    return "".join(out) + text[last:]


def redact_secrets(docs: DataFrame, model: RandomnessModel | None = None, mark: str = "<SECRET>") -> DataFrame:
    """The documents with every secret replaced by a mark; all rows stay, n_chars follows the text where it exists."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        known, at = shared.value, names.index("text")
        for batch in batches:
            texts = [redact(t, find_spans(t.encode(), known), mark) if t else t for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
