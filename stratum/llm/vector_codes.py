"""Product codes of vectors, with entries searched by fixed pivots (LAESA).

Components become integers floor(4096 x); a vector is cut into ``PARTS`` equal consecutive parts. Each part position has
a codebook that starts as the parts of the ``ENTRIES`` smallest vec_ids. ``ROUNDS`` rounds assign every part to the nearest
entry (squared Euclidean distance, ties to the lower index) and move each entry to the floored mean of its parts; an entry
without parts stays. At last the parts are assigned once more.

The distances of every part to ``PIVOTS`` fixed pivots (the first entries of the starting codebooks) are computed once
and stored with the parts. In each round the distances of entries to pivots give, by the triangle inequality, a lower
bound of each part's distance to each entry. Entries are tried in the order of their bounds, and only while the bound is
not above the best exact integer distance so far. Bounds are lowered by more than rounding can amount to, so that no
nearest entry is lost.

Vectors stay where they are stored: a round sends codebooks (bounded by PARTS x ENTRIES parts) out, and sums per entry
and component back, which Spark adds up.

Defined cases: null vectors and vectors with null, NaN or infinite components are dropped; equal vec_ids are separate
rows, ordered among themselves by their components, and null vec_ids come last; with fewer vectors than ``ENTRIES`` there
are as many entries as vectors; shorter vectors, and lengths that ``PARTS`` does not divide, are filled up with zeros;
integers beyond 2^28 on either side become 2^28, so that all sums are exact; null labels are equal; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, slices, stored

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
LIMIT = 1 << 28
#: Vectors looked at together, so that the bounds of a slice stay small.
SLICE = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    return ((a - b) ** 2).sum(axis=-1)


class PivotSearch:
    """Nearest entries of one part's codebook, by lower bounds from fixed pivots."""

    def __init__(self, entries: np.ndarray, pivots: np.ndarray):
        self.entries = entries
        self.to_pivots = np.sqrt(squared(entries[:, None], pivots[None]).astype(np.float64))
        self.evaluations = 0

    def bounds(self, known: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, one row per part: known are its distances to the pivots."""
        gap, total = np.zeros((len(known), len(self.entries))), np.zeros((len(known), len(self.entries)))
        for p in range(known.shape[1]):
            np.maximum(gap, np.abs(known[:, p, None] - self.to_pivots[None, :, p]), out=gap)
            np.maximum(total, known[:, p, None] + self.to_pivots[None, :, p], out=total)
        return np.maximum(gap - 1e-9 * (total + 1), 0) ** 2

    def nearest(self, parts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and the exact squared distance."""
        low = self.bounds(known)
        order = np.argsort(low, axis=1, kind="stable")
        best, index = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
        open_ = np.arange(len(parts))
        for rank in range(len(self.entries)):
            entry = order[open_, rank]
            go = low[open_, entry] <= best[open_]  # later entries have no lower bounds
            open_, entry = open_[go], entry[go]
            if not len(open_):
                break
            self.evaluations += len(open_)
            d = squared(parts[open_], self.entries[entry])
            better = (d < best[open_]) | ((d == best[open_]) & (entry < index[open_]))
            best[open_[better]], index[open_[better]] = d[better], entry[better]
        return index, best


def _parts_table(vectors: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, q (PARTS x width integers) and known (PARTS x PIVOTS distances), stored."""
    ddl = "vec_id long, label long, q array<long>, known array<double>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE):
                q = filled(part.column(2), width)
                known = np.sqrt(squared(q[:, :, None], pivots[None]).astype(np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(q), _lists(known)], schema=schema)

    return stored(map_batches(vectors, run, ddl))


def filled(column: pa.Array, width: int) -> np.ndarray:
    """rows x PARTS x width integers from lists of at most PARTS * width."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < lengths[:, None]] = column.flatten().to_numpy()
    return out.reshape(len(column), PARTS, width)


def _lists(values: np.ndarray) -> pa.ListArray:
    size = math.prod(values.shape[1:])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * size), pa.array(values.ravel()))


def _shaped(batch: pa.RecordBatch, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers and pivot distances as rows x PARTS x components."""
    n, (_, count, width) = batch.num_rows, pivots.shape
    return batch.column(2).flatten().to_numpy().reshape(n, PARTS, width), batch.column(3).flatten().to_numpy().reshape(n, PARTS, count)


def _sums(parts: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """part, entry, count and sums of the parts that an entry is nearest to."""
    ddl = "part int, entry int, n long, sums array<long>"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [PivotSearch(b, p) for b, p in zip(books, pivots)]
        n, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for piece in slices(batch, SLICE):
                q, known = _shaped(piece, pivots)
                for m in range(PARTS):
                    index, _ = search[m].nearest(q[:, m], known[:, m])
                    n[m] += np.bincount(index, minlength=len(n[m]))
                    np.add.at(sums[m], index, q[:, m])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), _lists(sums[part, entry])], schema=schema)

    return map_batches(parts, run, ddl)


def _moved(parts: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after one round. At most PARTS x ENTRIES rows come back."""
    sums = [F.sum(F.col("sums")[i].cast("decimal(38, 0)")).alias(f"s{i}") for i in range(books.shape[2])]
    after = books.copy()
    for row in _sums(parts, books, pivots).groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        after[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(books.shape[2])]
    return after


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and q, the components as integers, of the vectors that are kept."""
    whole = F.transform("embedding", lambda x: F.floor(SCALE * F.greatest(F.least(x.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    held = F.transform(whole, lambda v: F.greatest(F.least(v, F.lit(LIMIT)), F.lit(-LIMIT)).cast("long"))
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return embeddings.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), held.alias("q"))


def product_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code and error of every kept vector, and the final codebooks (parts x entries x components)."""
    vectors = integer_vectors(embeddings)
    longest = vectors.agg(F.max(F.size("q"))).first()[0] or 0
    width = -(-longest // PARTS)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "q").limit(ENTRIES).select("q").collect()  # at most ENTRIES rows
    start = filled(pa.array([r["q"] for r in first], pa.list_(pa.int64())), width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    pivots = books[:, :PIVOTS].copy()
    ddl = "vec_id long, label long, code string, error long"
    if not len(first):
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    parts = _parts_table(vectors, width, pivots)
    for _ in range(rounds):
        books = _moved(parts, books, pivots)
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [PivotSearch(b, p) for b, p in zip(books, pivots)]
        for batch in batches:
            for piece in slices(batch, SLICE):
                q, known = _shaped(piece, pivots)
                found = [search[m].nearest(q[:, m], known[:, m]) for m in range(PARTS)]
                code = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(d for _, d in found))], schema=schema)

    return map_batches(parts, run, ddl), books


def decoded(code: str, books: np.ndarray) -> np.ndarray:
    """The integer vector that a code stands for."""
    return np.concatenate([books[m, i] for m, i in enumerate(bytes.fromhex(code))])


def code_digests(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and the SHA-256 of the codebooks, per kept vector."""
    codes, books = product_codes(embeddings, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = stored(codes)
    by_label = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    met = codes.join(by_label, codes["label"].eqNullSafe(by_label["of"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
