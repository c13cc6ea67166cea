"""Suffix-array dedup: repeated byte strings of ``LENGTH`` or more, by merging sampled Burrows-Wheeler transforms.

Every byte that a LENGTH-byte string covers which also starts anywhere else is found, in documents of any number.

Sampling. Of each string of LENGTH bytes one suffix is kept: the one that starts at its anchor, the place with the least
hash of the next 8 bytes among the string's first ``WIDTH`` places (the last such place on ties). Equal strings have
their anchors at equal places, so they meet at suffixes that share at least REACH = LENGTH - WIDTH + 1 bytes. Hashes of
the first REACH bytes are counted with partial sums, and suffixes whose hash stands once are dropped.

Shard transforms. A shard is a batch of documents. Its remaining suffixes are sorted once, by their first REACH bytes'
hash and by what follows, and once by what precedes them, last byte first (in place of the Burrows-Wheeler transform's
one preceding symbol: all bytes up to the start of the first string that the anchor serves). A row carries its shard,
its rank in both orders, and the common prefix with the row before it in both.

Merge. Rows of all shards with one hash meet in a bucket as runs in shard order. ``merge_interleave`` starts with the
runs one after the other as one interval; each round splits every interval by the next symbol (eight bytes). A run's own
common prefixes say where its symbol changes, so only the heads of equal stretches are compared and whole stretches are
moved; no suffix is sorted again. The round and byte at which neighbours part is their common prefix. A string with l
bytes before its anchor is repeated if another row lies in the same interval of common prefixes of LENGTH - REACH - l
more bytes and of common preceding strings of l bytes.

Buckets of more than ``HOT_ROWS`` rows are not gathered: their strings are hashed (128 bits) one by one and counted in
an aggregation with partial sums, which finds the same. Rows of one document with the same bytes on both sides prove
each other and are sent once.

Defined cases: null text is empty; texts below LENGTH bytes have no such string; repeated rows are strings that start
elsewhere, so both copies lose them; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, key_id, map_batches, map_rows, stored

LENGTH, WIDTH, HOT_ROWS = 400, 192, 20_000
BATCH_ROWS, SHARD_ROWS, CHUNK = 8192, 16_384, 4 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xD6E8FEB86659FD93)
_POS = (1 << 24) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MUL
    x = (x ^ (x >> np.uint64(32))) * _MUL2
    return x ^ (x >> np.uint64(29))


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place, as integers."""
    return np.lib.stride_tricks.as_strided(data, shape=(len(data) - 7, 8), strides=(1, 1)).copy().view(np.uint64).ravel()


def string_anchors(data: np.ndarray, length: int, width: int) -> np.ndarray:
    """For each start of a length-byte string, the place of its anchor."""
    starts = len(data) - length + 1
    if starts <= 0:
        return np.zeros(0, dtype=np.int64)
    out = np.empty(starts, dtype=np.int64)
    for at in range(0, starts, CHUNK):
        own = min(CHUNK, starts - at)
        value = _mixed(_words_at(data[at : at + own + width + 6]))  # own + width - 1 places
        value = (value & ~np.uint64(_POS)) | (np.uint64(_POS) - np.arange(len(value), dtype=np.uint64))
        blocks = -(-len(value) // width)
        padded = np.full(blocks * width, np.uint64(2**64 - 1))
        padded[: len(value)] = value
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:own], ahead[width - 1 : width - 1 + own])
        out[at : at + own] = at + _POS - (least & np.uint64(_POS)).astype(np.int64)
    return out


def anchors_of(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last start that it serves, hash of its first length - width + 1 bytes)."""
    chosen = string_anchors(data, length, width)
    if not len(chosen):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    begin = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    anchor, low = chosen[begin], begin
    high = np.concatenate((begin[1:], [len(chosen)])) - 1
    reach = length - width + 1
    words, total = _words_at(data), np.full(len(anchor), np.uint64(reach), dtype=np.uint64)
    for k in [*range(0, reach - 8, 8), reach - 8]:
        total = _mixed(total ^ words[anchor + k]) + np.uint64(k + 1)
    return anchor, low, high, total


def _pack(anchor, low, high) -> np.ndarray:
    return (anchor << 20) | ((anchor - low) << 10) | (anchor - high)


def _unpack(place):
    anchor = place >> 20
    return anchor, anchor - ((place >> 10) & 1023), anchor - (place & 1023)


ANCHORS = "h long, did long, fp long, place long"


def sampled_suffixes(texts: DataFrame, length: int, width: int) -> DataFrame:
    """texts: did, fp, data. One row per sampled suffix."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            h, did, fp, place = [], [], [], []
            for d, f, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = np.frombuffer(text.as_py(), dtype=np.uint8)
                anchor, low, high, total = anchors_of(data, length, width)
                if len(anchor):
                    h.append(total)
                    place.append(_pack(anchor, low, high))
                    did.append(np.full(len(anchor), d, dtype=np.int64))
                    fp.append(np.full(len(anchor), f, dtype=np.int64))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (did, fp, place))], names=["h", "did", "fp", "place"])

    return map_batches(texts, run, ANCHORS)


def repeated_only(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose hash stands twice or more, with that number n. Counting combines on the map side, and the join
    reads its right side, one row per hash, from a stored table, so Spark can split a hash that stands very often."""
    often = stored(suffixes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    return suffixes.join(often.hint("merge"), "h").select("h", "did", "fp", "place", "n")  # one plan at every size


ROWS = "h long, did long, fp long, place long, ahead binary, behind binary, start long, stop long, shard long, rank_a int, rank_b int, common_a int, common_b int"


def shard_order(hashes: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's transform: the rank of each row by (hash, string), and its common prefix with the row before (-1: none
    with this hash)."""
    order = np.array(sorted(range(len(strings)), key=list(zip(hashes.tolist(), strings)).__getitem__), dtype=np.int64)
    symbols = _symbols([strings[i] for i in order.tolist()], width)
    common = np.full(len(order), -1, dtype=np.int32)
    differ = symbols[1:] != symbols[:-1]
    column = np.where(differ.any(axis=1), differ.argmax(axis=1), symbols.shape[1] - 1)
    rows = np.arange(len(column))
    shared = 8 * column + np.where(differ.any(axis=1), _equal_bytes(symbols[1:][rows, column] ^ symbols[:-1][rows, column]), 8)
    common[1:] = np.where(hashes[order][1:] == hashes[order][:-1], shared, -1)
    rank, own = np.empty(len(order), dtype=np.int32), np.empty(len(order), dtype=np.int32)
    rank[order], own[order] = np.arange(len(order)), common
    return rank, own


def transform_rows(texts: DataFrame, suffixes: DataFrame, length: int, width: int) -> DataFrame:
    """Rows of the shards' transforms: per suffix the bytes after its first reach, and the bytes before it, last first.
    Rows with start and stop are repeats already proven inside one document; they have no shard."""
    import pyarrow as pa

    reach, schema = length - width + 1, arrow_schema(ROWS)
    per_doc = suffixes.groupBy("did", "fp").agg(F.collect_list("h").alias("hs"), F.collect_list("place").alias("places"))
    joined = texts.join(per_doc, ["did", "fp"]).select("did", "fp", "data", "hs", "places")

    def document(row, rows, proven):
        did, fp, text, hs, places = (c.as_py() for c in row)
        seen: dict[tuple, int] = {}
        for h, place in zip(hs, places):
            anchor, low, high = _unpack(place)
            key = (h, text[anchor + reach : high + length], text[low:anchor][::-1], anchor - high)
            if key in seen:
                for p in {seen[key], place}:
                    _, lo, hi = _unpack(p)
                    proven.append((h, did, fp, p, None, None, lo, hi + length, None, None, None, None, None))
            else:
                rows.append((h, did, fp, place, key[1], key[2], None, None))
            seen[key] = place

    def shard(number, rows, proven):
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in list(schema)[:8]]
        if rows:
            hashes = columns[0].to_numpy()
            (rank_a, common_a), (rank_b, common_b) = (shard_order(hashes, [r[k] for r in rows], width - 1) for k in (4, 5))
            columns += [pa.array(np.full(len(rows), number)), *map(pa.array, (rank_a, rank_b, common_a, common_b))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)
        if proven:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*proven), schema)], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        number, rows, proven = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                document([batch.column(k)[i] for k in range(5)], rows, proven)
                if len(rows) + len(proven) >= SHARD_ROWS:
                    yield from shard(number, rows, proven)
                    number, rows, proven = number + 1, [], []
        yield from shard(number, rows, proven)

    return map_batches(joined, run, ROWS)


def _symbols(strings: list[bytes], width: int) -> np.ndarray:
    """Rows of eight-byte symbols, big-endian so that they order as bytes do; short strings are padded with zeros."""
    columns = -(-width // 8)
    joined = b"".join(s.ljust(columns * 8, b"\0") for s in strings)
    return np.frombuffer(joined, dtype=">u8").reshape(len(strings), columns).astype(np.uint64)


def _equal_bytes(differ: np.ndarray) -> np.ndarray:
    """How many first bytes are zero in each symbol that is not zero."""
    top = np.floor(np.log2(np.maximum((differ >> np.uint64(32)).astype(np.float64) * 2.0**32 + (differ & np.uint64(0xFFFFFFFF)).astype(np.float64), 1)))
    return np.clip(7 - top.astype(np.int64) // 8, 0, 7)


def merge_interleave(bucket: np.ndarray, shard: np.ndarray, rank: np.ndarray, common: np.ndarray, strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' runs of each bucket: (order, prefix) with prefix[i] the common prefix of rows order[i - 1] and
    order[i], -1 across buckets. rank and common: place in the run, and common prefix with the row before in the run."""
    n = len(bucket)
    symbols = _symbols(strings, width)
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=n)
    order = np.lexsort((rank, shard, bucket))  # the runs, one after the other
    prefix, split = np.full(n, width, dtype=np.int64), np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))
    prefix[split] = -1
    for k in range(symbols.shape[1]):
        interval = np.cumsum(split) - 1
        places = np.flatnonzero(np.bincount(interval)[interval] > 1)
        if not len(places):
            break
        rows, own = order[places], interval[places]
        head = np.concatenate(([True], (own[1:] != own[:-1]) | (shard[rows[1:]] != shard[rows[:-1]]) | (common[rows[1:]] < 8 * k + 8)))
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, len(rows)))
        symbol = symbols[rows[first], k]
        moved = np.lexsort((symbol, own[first]))  # heads of stretches only; stable, so runs keep their order
        stops = np.cumsum(sizes[moved])
        order[places] = rows[np.repeat(first[moved] - stops + sizes[moved], sizes[moved]) + np.arange(len(rows))]
        symbol, inside = symbol[moved], own[first][moved]
        parts = np.flatnonzero((inside[1:] == inside[:-1]) & (symbol[1:] != symbol[:-1])) + 1
        at = places[stops[parts - 1]]
        prefix[at] = 8 * k + _equal_bytes(symbol[parts] ^ symbol[parts - 1])
        split[at] = True
    shorter = np.minimum(lengths[order], np.concatenate(([0], lengths[order][:-1])))
    return order, np.where(prefix < 0, -1, np.minimum(prefix, shorter))


def repeated_strings(bucket: np.ndarray, shard: np.ndarray, ahead: tuple, behind: tuple, near: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the least and greatest number of bytes before the anchor with which a string is repeated (-1: none).
    ahead, behind: (strings, ranks, common prefixes) of the shards; near: the least number for which the row has a string."""
    n, rest = len(bucket), width - 1
    far = np.fromiter(map(len, behind[0]), dtype=np.int64, count=n)
    a_order, a_common = merge_interleave(bucket, shard, ahead[1], ahead[2], ahead[0], rest)
    b_order, b_common = merge_interleave(bucket, shard, behind[1], behind[2], behind[0], rest)
    most_a, most_b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    most_a[a_order] = np.maximum(a_common, np.append(a_common[1:], -1))
    most_b[b_order] = np.maximum(b_common, np.append(b_common[1:], -1))
    low, high = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    first, last = np.maximum(near, rest - most_a), np.minimum(far, most_b)  # what neighbours allow
    first[most_a < 0], a_class, b_class = n + width, np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    live = np.flatnonzero(first <= last)
    for before in range(int(first[live].min()), int(last[live].max()) + 1) if len(live) else ():
        own = live[(first[live] <= before) & (before <= last[live])]
        if len(own) < 2:
            continue
        a_class[a_order] = np.cumsum(a_common < rest - before)
        b_class[b_order] = np.cumsum(b_common < before)
        key = a_class[own] * (n + 1) + b_class[own]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        found = own[count[inverse] > 1]
        low[found] = np.where(low[found] < 0, before, low[found])
        high[found] = before
    return low, high


SPANS = "did long, fp long, start long, stop long"


def merged_spans(rows: DataFrame, length: int, width: int, partitions: int) -> DataFrame:
    """Repeated spans of each document: buckets meet by hash, and are merged in batches of whole buckets."""
    import pyarrow as pa

    def solve(held):
        table = pa.concat_tables(held).combine_chunks()
        known = table.filter(table.column("stop").is_valid())
        table = table.filter(table.column("stop").is_null())
        out = [np.stack([known.column(c).to_numpy() for c in ("did", "fp", "start", "stop")])]
        if table.num_rows:
            anchor, low, high = _unpack(table.column("place").to_numpy())
            ahead, behind = ((table.column(name).to_pylist(), table.column(f"rank_{k}").to_numpy(), table.column(f"common_{k}").to_numpy()) for name, k in (("ahead", "a"), ("behind", "b")))
            least, most = repeated_strings(table.column("h").to_numpy(), table.column("shard").to_numpy(), ahead, behind, anchor - high, length, width)
            own = np.flatnonzero(most >= 0)
            out.append(np.stack([table.column("did").to_numpy()[own], table.column("fp").to_numpy()[own], anchor[own] - most[own], anchor[own] - least[own] + length]))
        spans = np.concatenate(out, axis=1).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in spans], names=["did", "fp", "start", "stop"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column(0).to_numpy()
            last = int(np.searchsorted(h, h[-1]))  # where the last, perhaps unfinished, bucket begins
            table = pa.Table.from_batches([batch])
            if last == 0 and held and held[-1].column("h")[-1].as_py() == h[0]:
                held.append(table)
                n += table.num_rows
                continue
            held.append(table.slice(0, last))
            n += last
            if n >= BATCH_ROWS:
                yield solve(held)
                held, n = [], 0
            held.append(table.slice(last))
            n += table.num_rows - last
        if n:
            yield solve(held)

    return map_batches(rows.repartition(partitions, "h").sortWithinPartitions("h"), run, SPANS)


def counted_spans(texts: DataFrame, suffixes: DataFrame, length: int) -> DataFrame:
    """The same for buckets too large to gather: strings are hashed one by one and counted. A string that stands twice in
    a document is proven there; others leave the document once, so a hash has as many rows as documents hold it."""
    per_doc = suffixes.groupBy("did", "fp").agg(F.collect_list("place").alias("places"))

    def make():
        def each(dids, fps, datas, places):
            for did, fp, data, own in zip(dids, fps, datas, places):
                first, repeated = {}, set()
                for place in own:
                    _, low, high = _unpack(place)
                    for start in range(low, high + 1):
                        digest = hashlib.blake2b(data[start : start + length], digest_size=16).digest()
                        if digest in first:
                            yield fp ^ start, None, did, fp, start  # the first number only spreads the rows
                            repeated.add(digest)
                        else:
                            first[digest] = start
                for digest, start in first.items():  # a string that is proven here counts for other documents, too
                    if digest in repeated:
                        yield fp ^ start, None, did, fp, start
                    yield int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), did, fp, start

        return each

    strings = map_rows(texts.join(per_doc, ["did", "fp"]).select("did", "fp", "data", "places"), make, "s1 long, s2 long, did long, fp long, start long")
    again = strings.where("s2 is not null").groupBy("s1", "s2").agg(F.count("*").alias("n")).where("n > 1")
    found = strings.join(again.hint("merge"), ["s1", "s2"], "left").where("n is not null or s2 is null")
    return found.select("did", "fp", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(texts: DataFrame, length: int = LENGTH, width: int = WIDTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """did, fp, start, stop of repeated strings; spans of a document may overlap. texts: did, fp, data."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = stored(repeated_only(stored(sampled_suffixes(texts, length, width))))
    cold = merged_spans(transform_rows(texts, suffixes.where(F.col("n") <= hot_rows), length, width), length, width, partitions)
    hot = suffixes.where(F.col("n") > hot_rows)
    return cold if hot.isEmpty() else cold.unionByName(counted_spans(texts, hot, length))


def merge_intervals(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(key_id().alias("did"), F.xxhash64(text).alias("fp"), text.cast("binary").alias("data"))


def _texts_and_spans(docs: DataFrame, length: int, width: int, hot_rows: int) -> DataFrame:
    """did, data, spans of each document row."""
    if width + 7 > length or not 8 <= width <= 1000:
        raise ValueError("width must be 8 to 1000 and at most length - 7")
    texts = keyed_texts(docs)
    spans = repeated_spans(texts, length, width, hot_rows).groupBy("did", "fp").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return texts.join(spans, ["did", "fp"], "left").select("did", "data", "spans")


def _kept(data: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the removed runs."""
    runs, kept, last = merge_intervals([(s["start"], s["stop"]) for s in spans or ()]), [], 0
    for a, b in runs:
        kept.append(data[last:a])
        last = b
    return b"".join([*kept, data[last:]]), runs


def dedup_texts(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document row: doc_id, the bytes that are left (a cut may fall inside a character), and removed runs."""

    def make():
        def each(dids, datas, spans):
            for did, data, own in zip(dids, datas, spans):
                kept, runs = _kept(data, own)
                yield (None if did == -(2**63) else did), kept, [a for a, _ in runs], [b for _, b in runs]

        return each

    return map_rows(_texts_and_spans(docs, length, width, hot_rows), make, "doc_id long, kept binary, starts array<long>, stops array<long>")


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, repeated boolean"


def dedup_digests(docs: DataFrame, length: int = LENGTH, width: int = WIDTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document row: bytes, removed bytes, maximal removed runs, digest and number of bytes of what is left,
    and whether anything was removed."""

    def make():
        def each(dids, datas, spans):
            for did, data, own in zip(dids, datas, spans):
                kept, runs = _kept(data, own)
                yield (None if did == -(2**63) else did), len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), len(kept), bool(runs)

        return each

    return map_rows(_texts_and_spans(docs, length, width, hot_rows), make, DIGESTS)
