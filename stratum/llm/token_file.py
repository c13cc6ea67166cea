"""Token output as directly addressable codes.

Each id is cut into chunks of ``chunk_bits`` bits, lowest first. Level l holds the l-th chunk of every id that has one;
its continuation bitmap says which ids go on to level l + 1, and a rank directory (ones before every block of 512
bits) gives an id's place there, so any token is read from a few bytes without decoding a block.

Layout of a segment: magic, number of ids, number of levels, then per level: bits, entries, packed chunks, bitmap, rank
directory. Documents lie in ascending doc_id order: rows are range-partitioned by doc_id, sorted, and written as rows
(part, seq, ids before it in its part, documents, token counts, codes) of a Parquet dataset, which any store that Spark
reaches can hold. A segment ends after ``segment_tokens`` ids at a document's end, so only a single document can make a
larger one. There are as many parts as ``PART_BYTES`` of text need; a reader adds up one number per part.

Defined cases: null text is empty and gets only the end id; null doc_ids come first; rows with the same doc_id are
ordered by a hash of the text, then by the text, and may lie in several parts; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches
from .tokens import encoder, tokenizer_path

MAGIC = b"DAC1"
CHUNK_BITS, BLOCK_BITS = 8, 512
SEGMENT_TOKENS, PART_BYTES = 1 << 18, 48 << 20
END_ID = 2
SEGMENTS = "part int, seq int, base long, doc_ids array<long>, lengths array<long>, codes binary"


def encode_codes(ids: np.ndarray, chunk_bits: int = CHUNK_BITS) -> bytes:
    """A segment's bytes."""
    if not 1 <= chunk_bits <= 16:
        raise ValueError("chunk_bits must be 1 to 16")
    rest, levels = ids.astype(np.uint64), []
    while True:
        chunk = rest & np.uint64((1 << chunk_bits) - 1)
        more = rest >> np.uint64(chunk_bits) > 0
        packed = chunk.astype(np.uint8).tobytes() if chunk_bits == 8 else np.packbits((chunk[:, None] >> np.arange(chunk_bits, dtype=np.uint64)) & np.uint64(1) != 0, bitorder="little").tobytes()
        bitmap = np.packbits(more, bitorder="little").tobytes()
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS)) if len(more) else np.zeros(0, dtype=np.int64)
        ranks = np.concatenate(([0], np.cumsum(blocks)))[: len(blocks)].astype("<u4").tobytes()
        levels.append(struct.pack("<BQQQQ", chunk_bits, len(rest), len(packed), len(bitmap), len(ranks)) + packed + bitmap + ranks)
        if not more.any():
            break
        rest = rest[more] >> np.uint64(chunk_bits)
    return MAGIC + struct.pack("<QB", len(ids), len(levels)) + b"".join(levels)


class CodeReader:
    """Random access to, and full decoding of, a segment."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.data = data
        self.n, count = struct.unpack_from("<QB", data, 4)
        self.levels, at = [], 13
        for _ in range(count):
            bits, n, a, b, c = struct.unpack_from("<BQQQQ", data, at)
            at += 33
            self.levels.append((bits, n, at, at + a, at + a + b))
            at += a + b + c

    def __len__(self) -> int:
        return self.n

    def _chunk(self, level: tuple, i: int) -> int:
        bits, _, base, _, _ = level
        if bits == 8:
            return self.data[base + i]
        first = i * bits
        span = int.from_bytes(self.data[base + first // 8 : base + (first + bits + 7) // 8], "little")
        return span >> first % 8 & (1 << bits) - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for level in self.levels:
            bits, _, _, bitmap, ranks = level
            value |= self._chunk(level, i) << shift
            if not self.data[bitmap + i // 8] >> i % 8 & 1:
                return value
            block = i // BLOCK_BITS
            before = self.data[bitmap + block * BLOCK_BITS // 8 : bitmap + i // 8]
            inside = int.from_bytes(before, "little").bit_count() + (self.data[bitmap + i // 8] & (1 << i % 8) - 1).bit_count()
            i = struct.unpack_from("<I", self.data, ranks + 4 * block)[0] + inside
            shift += bits
        return value

    def decode(self) -> np.ndarray:
        out = np.zeros(self.n, dtype=np.uint64)
        at, shift = np.arange(self.n), 0
        for bits, n, base, bitmap, ranks in self.levels:
            raw = np.frombuffer(self.data, dtype=np.uint8, count=bitmap - base, offset=base)
            if bits == 8:
                chunk = raw[:n].astype(np.uint64)
            else:
                chunk = (np.unpackbits(raw, bitorder="little")[: n * bits].reshape(n, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            out[at] |= chunk << np.uint64(shift)
            more = np.unpackbits(np.frombuffer(self.data, dtype=np.uint8, count=ranks - bitmap, offset=bitmap), bitorder="little")[:n].astype(bool)
            at, shift = at[more], shift + bits
        return out.astype(np.uint32)


def write_token_file(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS, chunk_bits: int = CHUNK_BITS) -> None:
    """Encodes every text, appends end_id, and writes the segments to a folder, in doc_id order."""
    import pyarrow as pa

    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(2 * spark.sparkContext.defaultParallelism, math.ceil(size / PART_BYTES))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq, base = encoder(path), TaskContext.get().partitionId(), 0, 0
        held, total = [], 0  # (doc_ids, lengths, ids) of stretches of documents

        def segment():
            tokens, doc_ids, lengths = np.concatenate([h[2] for h in held]), pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held])
            bounds = pa.array([0, len(lengths)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([base], pa.int64()), pa.ListArray.from_arrays(bounds, doc_ids), pa.ListArray.from_arrays(bounds, pa.array(lengths)), pa.array([encode_codes(tokens, chunk_bits)], pa.binary())], names=["part", "seq", "base", "doc_ids", "lengths", "codes"])

        for batch in batches:
            at = 0
            for n, ids, bounds in enc.encode(batch.column(1), end_id):
                first = 0
                while first < n:
                    last = min(n, max(first + 1, int(np.searchsorted(bounds, bounds[first] + segment_tokens - total))))
                    held.append((batch.column(0).slice(at + first, last - first), np.diff(bounds[first : last + 1]), ids[bounds[first] : bounds[last]]))
                    total += int(bounds[last] - bounds[first])
                    if total >= segment_tokens:
                        yield segment()
                        held, total, seq, base = [], 0, seq + 1, base + total
                    first = last
                at += n
        if held:
            yield segment()

    map_batches(ordered, run, SEGMENTS).write.parquet(folder)


def read_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, decoded from the segments: doc_id, start, n_tokens, ids_crc32 (of the ids as written)."""
    segments = spark.read.schema(SEGMENTS).parquet(folder)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    parts = segments.groupBy(F.col("part").alias("of_part")).agg(F.max(F.col("base") + size).alias("n"))  # a row per written partition
    before = parts.select("of_part", (F.sum("n").over(W.orderBy("of_part")) - F.col("n")).alias("part_start"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):  # a segment at a time
                ids, lengths = batch.column(1)[i].values, batch.column(2)[i].values.to_numpy()
                tokens = memoryview(CodeReader(batch.column(3)[i].as_py()).decode().astype("<u4", copy=False)).cast("B")
                bounds = np.concatenate(([0], np.cumsum(lengths)))
                crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(batch.column(0)[i].as_py() + bounds[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = segments.join(F.broadcast(before), F.col("part") == F.col("of_part")).select(F.col("part_start") + F.col("base"), "doc_ids", "lengths", "codes")
    return map_batches(joined, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
