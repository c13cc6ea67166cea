"""Benchmark decontamination: a broadcast set of normalised test n-grams scanned over token windows.

An item of ``window`` words or more gives all its windows of consecutive words; a shorter one (but not an empty one) is
one window of its own length. Window hashes propose hits, the window's word ids confirm them, so results are exact.

The index is broadcast only while the benchmark's checked size is below ``broadcast_chars``; beyond it, document and
benchmark windows are shuffled on their hashes and joined, with the same result.

Defined cases: null or wordless text has no words and no hits; an item with a null id counts as item "" in
``items_sha256`` and like any other elsewhere; repeated item rows count once; repeated document rows are answered one by
one; an empty benchmark leaves every document clean; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_id, map_batches, map_rows, stored, word_list

WINDOW = 10
BROADCAST_CHARS = 64 << 20
_ODD = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) | 1 for i in range(64)], dtype=np.uint64)


def item_windows(words: list[bytes], window: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    k = min(window, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


class WindowIndex:
    """Word ids, and per window length the sorted hashes and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        lengths: dict[int, set[int]] = {}
        for name, text in items:
            for gram in item_windows(word_list(text), window):
                key = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in gram], dtype=np.uint64)
                self.items.setdefault(key.tobytes(), set()).add(name)
                lengths.setdefault(len(gram), set()).add(int(self.hashes(key, len(gram))[0]))
        self.lengths = {k: np.array(sorted(v), dtype=np.uint64) for k, v in lengths.items()}

    @staticmethod
    def hashes(ids: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(ids) - k + 1) if at is None else at
        total = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            total = (total ^ ids[at + j]) * _ODD[j % 64] + np.uint64(j + 1)
        return total

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        n = len(words)
        hit, found = np.zeros(n, dtype=bool), set()
        if not n or not self.lengths:
            return hit, found
        ids = np.fromiter(map(self.ids.get, words, repeat(0)), dtype=np.uint64, count=n)
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for k, hashes in self.lengths.items():
            if n < k:
                continue
            at = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(at):
                continue
            h = self.hashes(ids, k, at)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[place] == h].tolist():
                if items := self.items.get(ids[i : i + k].tobytes()):
                    found |= items
                    hit[i : i + k] = True
        return hit, found


def _report(doc_id, words, hit, found) -> tuple:
    n_hit = int(hit.sum())
    return doc_id, len(words), n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n_hit > 0


REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("data"))


def _small(benchmark: DataFrame, broadcast_chars: int) -> bool:
    return (benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0) <= broadcast_chars


def _broadcast_index(benchmark: DataFrame, window: int):
    rows = _items(benchmark).collect()  # below broadcast_chars, see _small
    return benchmark.sparkSession.sparkContext.broadcast(WindowIndex([(r.item, r.data) for r in rows], window))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per document row: words, hit words, items found, their digest, and the verdict."""
    if not _small(benchmark, broadcast_chars):
        return _shuffled(docs, benchmark, window)
    index = _broadcast_index(benchmark, window)

    def make():
        idx = index.value

        def each(ids, texts):
            for doc_id, text in zip(ids, texts):
                words = word_list(text)
                yield _report(doc_id, words, *idx.scan(words))

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), make, REPORT)


def _gram_hash(gram) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(gram), digest_size=8).digest(), "little", signed=True)


def _row_key():
    return F.xxhash64(key_id(), F.col("text"))


def _shuffled_hits(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The way beyond the broadcast bound: windows of both sides meet in a join on 64-bit hash and word count, and the
    joined windows' words confirm the hit. One row per row key with a hit: key, spans (i, k) in words, sorted items."""

    def bench_make():
        def each(items, texts):
            for item, text in zip(items, texts):
                for gram in item_windows(word_list(text), window):
                    yield _gram_hash(gram), len(gram), b" ".join(gram).decode(), item

        return each

    grams = stored(map_rows(_items(benchmark), bench_make, "h long, k int, gram string, item string").distinct())
    lengths = [r.k for r in grams.select("k").distinct().collect()]  # at most ``window`` values

    def doc_make():
        def each(keys, texts):
            for key, text in zip(keys, texts):
                words = word_list(text)
                for k in lengths:
                    for i in range(len(words) - k + 1):
                        gram = words[i : i + k]
                        yield key, _gram_hash(gram), k, b" ".join(gram).decode(), i

        return each

    keyed = docs.select(_row_key().alias("key"), F.col("text").cast("binary").alias("data")).distinct()
    hits = map_rows(keyed, doc_make, "key long, h long, k int, gram string, i int").join(grams, ["h", "k", "gram"])
    return hits.groupBy("key").agg(F.collect_set(F.struct("i", "k")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))


def _mask(n: int, spans) -> np.ndarray:
    """Which of n words the spans hit."""
    hit = np.zeros(n, dtype=bool)
    for x in spans or ():
        hit[x["i"] : x["i"] + x["k"]] = True
    return hit


def _shuffled(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data"), _row_key().alias("key"))
    per_doc = _shuffled_hits(docs, benchmark, window)

    def report_make():
        def each(ids, texts, spans, items):
            for doc_id, text, s, found in zip(ids, texts, spans, items):
                words = word_list(text)
                yield _report(doc_id, words, _mask(len(words), s), set(found or ()))

        return each

    return map_rows(keyed.join(per_doc, "key", "left").select("doc_id", "data", "spans", "items"), report_make, REPORT)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "span", window: int = WINDOW, max_hit_share: float = 0.5, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Documents without benchmark passages, with their columns.

    mode "span" cuts the hit words out of the text and drops documents of whose words more than ``max_hit_share`` are
    hit; mode "document" drops every document with a hit. n_chars follows the text where it exists. Clean rows pass
    unchanged, null texts included. Both ways of finding the hits (see ``broadcast_chars``) give the same rows.
    """
    if mode not in ("span", "document"):
        raise ValueError(f"mode must be span or document, not {mode!r}")
    names, schema = docs.columns, docs.schema
    if _small(benchmark, broadcast_chars):
        index, rows = _broadcast_index(benchmark, window), docs
    else:
        spans = "spans"  # a name that no column of docs has
        while spans.lower() in {c.lower() for c in names}:
            spans += "_"
        hits = _shuffled_hits(docs, benchmark, window).select("key", F.col("spans").alias(spans))
        index, rows = None, docs.select(F.struct("*").alias("row"), _row_key().alias("key")).join(hits, "key", "left").select(*[F.col(f"row.`{c}`") for c in names], spans)

    def run(batches):
        import pyarrow as pa

        idx = index.value if index else None
        for batch in batches:
            at, keep, texts = names.index("text"), [], []
            found = repeat(None) if idx else batch.column(len(names)).to_pylist()
            for text, spans in zip(batch.column(at).to_pylist(), found):
                words = word_list(text.encode()) if text else []
                hit = idx.scan(words)[0] if idx else _mask(len(words), spans)
                share = hit.mean() if len(words) else 0.0
                keep.append(not (hit.any() and (mode == "document" or share > max_hit_share)))
                texts.append(cut_words(text, hit) if hit.any() and keep[-1] else text)
            columns = list(batch.columns)[: len(names)]
            columns[at] = pa.array(texts, type=batch.schema.field(at).type)
            out = pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[: len(names)]))
            yield out.filter(pa.array(keep, type=pa.bool_()))

    out = map_batches(rows, run, schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def cut_words(text: str, hit: np.ndarray) -> str:
    """The text without the hit words and what stands between two of them; white space around a cut becomes one space."""
    import re

    spans, kept, last = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)], [], 0
    i = 0
    while i < len(spans):
        if hit[i]:
            j = i
            while j + 1 < len(spans) and hit[j + 1]:
                j += 1
            kept.append(text[last : spans[i][0]].rstrip() + " ")
            last = spans[j][1]
            i = j
        i += 1
    return ("".join(kept) + text[last:]).strip()
