"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Texts become sets of hashed word 5-grams (a text of fewer words is one gram). Texts with equal sets form a class, which
takes part once, under its smallest doc_id. Each class's signature is cut into bands; the numbers of bands and rows are
chosen so that a pair at the similarity threshold is missed with at most ``1 - recall``. Classes that share a band hash
are candidates; only (class, smallest class of the bucket) pairs are made, so a bucket costs as much as it has members.

Candidates that hang together meet for verification in blocks: a component of any size is cut into blocks of bounded
numbers of classes and grams, each pair of blocks is one group, and in it all intersections come from products of 0/1
matrices. All pairs of a component are so compared on their full sets, but only links per class and a spanning forest
leave a task. Connected components of verified links are the groups.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined cases: null or wordless text has no grams and no links and is a group of its own; rows with a null doc_id are
not documents and are left out (``keep_one`` keeps them); rows with the same doc_id are one document of a group;
repeated rows are answered one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regions import connected_components
from .common import map_batches, map_rows, stored, word_list

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
BLOCK_CLASSES, BLOCK_GRAMS = 512, 150_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows per band, hence fewest chance candidates, that reach the recall within max_hashes."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


class Grams:
    """Hashed gram sets of texts."""

    def __init__(self, n: int = NGRAM):
        self.n = n

    def __call__(self, data: bytes | None) -> np.ndarray:
        words = word_list(data)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        codes = _word_codes(words)
        k = min(self.n, len(words))
        total = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            total = (total ^ codes[j : len(words) - k + 1 + j]) * _MIX + (total >> np.uint64(29))
        return np.unique(_mixed(total))


def _word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit codes of words, from their bytes alone: joined bytes are hashed by position, then summed per word."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = (np.arange(len(flat)) - np.repeat(starts, lengths)).astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed((flat + np.uint64(1)) * _MIX2 ^ (inside + np.uint64(1)) * _MIX), starts) ^ lengths.astype(np.uint64))


class Sketcher:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def bands_of(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.uint64(2**64 - 1))
        for at in range(0, len(grams), 2048):
            part = grams[at : at + 2048]
            np.minimum(least, ((part[None, :] ^ self.c[:, None]) * self.a[:, None]).min(axis=1), out=least)
        least, total = least.reshape(self.bands, self.rows), self.salt.copy()
        for j in range(self.rows):
            total = _mixed(total ^ least[:, j])
        return total.view(np.int64)


def class_key(grams: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    with np.errstate(over="ignore"):
        return np.array([_mixed(grams).sum(dtype=np.uint64), _mixed(grams ^ _MIX).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class key (null without grams), number of grams, band hashes."""
    plan = band_plan(threshold, recall)

    def make():
        grams_of, sketcher = Grams(n), Sketcher(*plan)

        def each(ids, texts):
            for doc_id, text in zip(ids, texts):
                grams = grams_of(text)
                yield (doc_id, class_key(grams), len(grams), sketcher.bands_of(grams).tolist()) if len(grams) else (doc_id, None, 0, None)

        return each

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return map_rows(rows, make, "doc_id long, class_key binary, n_grams int, bands array<long>")


def verified_links(docs: DataFrame, members: DataFrame, n: int, threshold: float, partitions: int) -> DataFrame:
    """Per class and pair of blocks: links to other classes and documents, and the smallest class it hangs together with.

    members: rid, class_key, size (documents in the class), comp, n_blocks, block.
    """
    import pyarrow as pa

    def fetch():
        grams_of = Grams(n)

        def each(texts, rids, keys, sizes, comps, n_blocks, blocks):
            for text, rid, key, size, comp, total, block in zip(texts, rids, keys, sizes, comps, n_blocks, blocks):
                grams = grams_of(text)
                if class_key(grams) == key:
                    yield rid, key, size, comp, total, block, grams.tobytes()

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("rid"), F.col("text").cast("binary").alias("data")).join(members, "rid").select("data", "rid", "class_key", "size", "comp", "n_blocks", "block")
    held = map_rows(texts, fetch, "rid long, class_key binary, size long, comp long, n_blocks int, block int, grams binary")
    paired = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select("comp", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rid", "class_key", "size", "grams")
    sent = paired.repartition(partitions, "comp", "b1", "b2").sortWithinPartitions("comp", "b1", "b2", "rid", "class_key")

    def verify(batches):
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out = []
            for row in zip(*columns):
                if row[:3] != key:
                    out += _linked(key, rows, threshold)
                    key, rows = row[:3], []
                rows.append(row[3:])
            yield _batch(out)
        yield _batch(_linked(key, rows, threshold))

    def _batch(out):
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["rid", "hub", "class_links", "doc_links"])

    return map_batches(sent, verify, "rid long, hub long, class_links long, doc_links long")


def _linked(key, rows: list[tuple], threshold: float) -> list[tuple]:
    """Links inside a block, or between the two blocks of a pair; rows: block, rid, class key, size, grams."""
    distinct: dict[tuple, tuple] = {(r[1], r[2]): r for r in rows}  # a doc_id that stands twice brings its text twice
    rows = list(distinct.values())
    if len(rows) < 2:
        return []
    grams = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
    sizes = np.array([len(g) for g in grams])
    flat, owner = np.concatenate(grams), np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    if not shared.any():
        return []
    _, column = np.unique(column[shared], return_inverse=True)
    owner, common, step = owner[shared], np.zeros((len(rows), len(rows)), dtype=np.float32), 4096
    for at in range(0, int(column[-1]) + 1, step):
        lo, hi = np.searchsorted(column, (at, at + step))
        part = np.zeros((len(rows), step), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = common >= threshold * union - 1e-6 * union
    np.fill_diagonal(linked, False)
    blocks = np.array([r[0] for r in rows])
    if key[1] != key[2]:
        linked &= blocks[:, None] != blocks[None, :]
    weight = np.array([r[3] for r in rows], dtype=np.int64)
    n_class, n_doc = linked.sum(axis=1), linked @ weight
    hub = np.array([r[1] for r in rows], dtype=np.int64)
    while True:  # the smallest doc_id that each hangs together with
        least = np.minimum(hub, np.where(linked, hub[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == hub).all():
            break
        hub = least
    return [(r[1], int(hub[i]), int(n_class[i]), int(n_doc[i])) for i, r in enumerate(rows) if n_class[i]]


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block_classes: int = BLOCK_CLASSES, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per document row: class_id (smallest doc_id of its group), set_id (smallest doc_id with the same gram
    set), n_links (other documents at the threshold or above) and n_class_links (other gram sets among them)."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketch = stored(sketches(docs, n, threshold, recall))
    classes = stored(sketch.where("n_grams > 0").groupBy("class_key").agg(F.min("doc_id").alias("rid"), F.count("*").alias("size"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")))
    bands = classes.select("rid", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("rid").alias("hub"), F.max("rid").alias("last")).where("hub < last").select("band", "hub")
    edges = bands.join(hubs, "band").where("rid <> hub").select(F.col("rid").alias("src"), F.col("hub").alias("dst")).distinct()
    found = connected_components(edges)  # node, comp
    members = classes.drop("bands").join(found.withColumnRenamed("node", "rid"), "rid")
    totals = members.groupBy("comp").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"))
    total_blocks = F.greatest(F.ceil(F.col("n") / block_classes), F.ceil(F.col("grams") / block_grams)).cast("int")
    members = members.join(totals.select("comp", total_blocks.alias("n_blocks")), "comp").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("n_blocks").cast("long")).cast("int"))
    links = stored(verified_links(docs, members.select("rid", "class_key", "size", "comp", "n_blocks", "block"), n, threshold, partitions))
    groups = connected_components(links.where("rid <> hub").select(F.col("rid").alias("src"), F.col("hub").alias("dst")).distinct())
    counts = links.groupBy("rid").agg(F.sum("class_links").alias("class_links"), F.sum("doc_links").alias("doc_links"))
    per_class = classes.select("class_key", "rid", "size").join(counts, "rid", "left").join(groups.withColumnRenamed("node", "rid"), "rid", "left")
    rows = sketch.select("doc_id", "class_key").join(per_class, "class_key", "left")
    return rows.select(
        "doc_id",
        F.coalesce("comp", "rid", "doc_id").alias("class_id"),
        F.coalesce("rid", "doc_id").alias("set_id"),
        (F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("doc_links", F.lit(0))).alias("n_links"),
        F.coalesce("class_links", F.lit(0)).alias("n_class_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest doc_id stays, once."""
    joined = stored(jaccard_join(docs, **options))
    losers = joined.where("doc_id <> class_id").select(F.col("doc_id").alias("_loser")).distinct()
    # their number grows with the corpus, so they are never broadcast: one plan at every size
    kept = docs.join(losers.hint("merge"), docs["doc_id"] == losers["_loser"], "left_anti")
    twice = joined.groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return kept
    again = kept.join(twice, kept["doc_id"] == twice["_twice"], "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, kept["doc_id"] == twice["_twice"], "left_anti").unionByName(again)
