"""Best-fit packing by linear grouping.

Texts are encoded and cut into pieces of at most ``capacity`` tokens. Only counts per length (at most ``capacity`` of
them) reach the driver, where the plan is made:

1. Large lengths are sorted and split into groups of equal cardinality (a length each, if there are few lengths); each
   is rounded up to its group's largest.
2. A linear program over the few rounded sizes picks configurations (column generation, knapsack pricing); its whole
   parts say how many sequences use each configuration.
3. The group's actual lengths take the configuration's slots, which leaves room at least as large as planned.
4. Exchanges of pieces between configured sequences fill most of them and gather the room that rounding left in the rest.
5. Everything else (small pieces, and what the whole parts left over), in decreasing order, goes to the open sequence
   with the least sufficient room.
6. Room is gathered once more, and the sequences that have it are packed again where that takes fewer.

The plan is a list of recipes (lengths in one sequence, number of such sequences); a piece finds its place by its rank
among the pieces of its length, which tasks compute from counts per (task, length). Nothing is grouped by length.

Defined cases: null text is empty and gets only the end id; a document of more than ``capacity`` tokens is cut into
full pieces and a rest; null and repeated doc_ids are packed row by row; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from heapq import heappop, heappush
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, stored
from .tokens import encoder, tokenizer_path

CAPACITY, END_ID, GROUPS, SMALL_SHARE = 2048, 0, 160, 4


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable configuration (counts per size): a knapsack, one item more per layer."""
    best, layers = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        more, item = best.copy(), np.full(capacity + 1, -1)
        for i, (size, value) in enumerate(zip(sizes, values)):
            if value > 1e-12:
                better = best[:-size] + value > more[size:] + 1e-12
                more[size:][better] = best[:-size][better] + value
                item[size:][better] = i
        if (item < 0).all():
            break
        layers.append(item)
        best = more
    column, room = [0] * len(sizes), capacity
    for item in reversed(layers):  # an item of -1: this layer adds nothing here
        if item[room] >= 0:
            column[item[room]] += 1
            room -= sizes[item[room]]
    return float(best[capacity]), column


def solve_configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """The linear program: configurations (counts per size) and how often each is used, least total."""
    k = len(sizes)
    columns = [tuple(capacity // s if i == j else 0 for j in range(k)) for i, s in enumerate(sizes)]
    inverse, x = np.diag([1.0 / c[i] for i, c in enumerate(columns)]), np.array([d / c[i] for i, (c, d) in enumerate(zip(columns, demand))])
    for turn in range(40 * k):
        value, column = best_configuration(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        direction = inverse @ np.array(column, dtype=float)
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leaves = int(np.argmin(ratios))
        if not np.isfinite(ratios[leaves]):
            break
        columns[leaves] = tuple(column)
        if turn % 50 == 49:  # rounding errors of the updates do not add up
            inverse = np.linalg.inv(np.array(columns, dtype=float).T)
            x = np.maximum(inverse @ np.array(demand, dtype=float), 0)
        else:
            row, step = inverse[leaves] / direction[leaves], x[leaves] / direction[leaves]
            inverse -= np.outer(direction, row)
            inverse[leaves] = row
            x = np.maximum(x - direction * step, 0)
            x[leaves] = step
    x = np.linalg.inv(np.array(columns, dtype=float).T) @ np.array(demand, dtype=float)
    return [(c, float(v)) for c, v in zip(columns, x) if v > 1e-9]


def linear_groups(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] of each group, largest lengths first; groups have equal numbers of pieces, up to one."""
    total = sum(counts.values())
    out, done = [[]], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = total * len(out) // groups - done
            if room <= 0:
                out.append([])
                continue
            n = min(left, room)
            out[-1].append([length, n])
            left, done = left - n, done + n
    return [g for g in out if g]


Recipes = list[tuple[int, tuple[int, ...]]]


def configured(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> tuple[Recipes, dict[int, int]]:
    """(recipes of the full and of the configured sequences, counts of the pieces left over)."""
    left = {k: v for k, v in counts.items() if v > 0}
    recipes: Recipes = []
    if n := left.pop(capacity, 0):
        recipes.append((n, (capacity,)))
    large = {k: left.pop(k) for k in [k for k in left if k * small_share > capacity]}
    if not large:
        return recipes, left
    grouped = linear_groups(large, groups) if len(large) > groups else [[[k, large[k]]] for k in sorted(large, reverse=True)]
    merged: list[list[list[int]]] = []
    for g in grouped:  # groups that round to one size are one size
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    sizes, demand = [g[0][0] for g in merged], [sum(n for _, n in g) for g in merged]
    for column, used in solve_configurations(sizes, demand, capacity):
        slots = [i for i, c in enumerate(column) for _ in range(c)]
        times = min([int(used + 1e-9), *(sum(n for _, n in merged[i]) // c for i, c in enumerate(column) if c)])
        if not times or not slots:
            continue
        runs = []
        for i in slots:  # the group's actual lengths, largest first
            taken, need = [], times
            while need:
                n = min(need, merged[i][0][1])
                taken.append([merged[i][0][0], n])
                merged[i][0][1] -= n
                need -= n
                if not merged[i][0][1]:
                    merged[i].pop(0)
            runs.append(taken)
        while runs[0]:
            n = min(r[0][1] for r in runs)
            recipes.append((n, tuple(r[0][0] for r in runs)))
            for r in runs:
                r[0][1] -= n
                if not r[0][1]:
                    r.pop(0)
    for g in merged:
        for length, n in g:
            left[length] = left.get(length, 0) + n
    return recipes, left


def plan_recipes(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_share: int = SMALL_SHARE) -> Recipes:
    """(number of sequences, lengths in each) for pieces counted by length. Its size depends on the distinct lengths only."""
    recipes, left = configured(counts, capacity, groups, small_share)
    return repacked(gathered(best_fit(left, gathered(recipes, capacity), capacity), capacity), capacity)


def repacked(recipes: Recipes, capacity: int) -> Recipes:
    """The sequences with the most room packed again, if that takes fewer: as few of them as reach the least number."""
    found = [recipes]
    for least in (capacity // 64, capacity // 128, capacity // 256, 1):
        loose: dict[int, int] = {}
        for n, items in recipes:
            if capacity - sum(items) >= max(1, least):
                for length in items:
                    loose[length] = loose.get(length, 0) + n
        found.append(best_fit(loose, [r for r in recipes if capacity - sum(r[1]) < max(1, least)], capacity))
    return min(found, key=lambda r: sum(n for n, _ in r))


def gathered(recipes: Recipes, capacity: int) -> Recipes:
    """The configured sequences with their room in few of them, where small pieces fit. A sequence with a little room
    gives a piece to another one with room for a piece that is longer by just that room: the one is full, the other's room
    grows. Every exchange fills sequences for good."""
    full, loose, holders, queue = [], {}, {}, []

    def put(n: int, items: tuple[int, ...]) -> None:
        room = capacity - sum(items)
        if not room:
            full.append((n, items))
            return
        key = next(numbers)
        loose[key] = (n, items, room)
        for length in set(items):
            holders.setdefault(length, set()).add(key)
        heappush(queue, (room, key))

    def take(key: int) -> tuple[int, tuple[int, ...]]:
        n, items, _ = loose.pop(key)
        for length in set(items):
            holders[length].discard(key)
        return n, items

    def exchanged(items: tuple[int, ...], gone: int, come: int) -> tuple[int, ...]:
        at = items.index(gone)
        return (*items[:at], come, *items[at + 1 :])

    numbers = count()
    for n, items in recipes:
        put(n, items)
    for _ in range(20 * len(recipes)):
        while queue and queue[0][1] not in loose:
            heappop(queue)
        if not queue:
            break
        room, key = heappop(queue)
        partners = [(loose[k][2], k, length) for length in set(loose[key][1]) for k in holders.get(length + room, ()) if k != key]
        if partners:
            _, other, length = max(partners)
            (n, items), (m, others) = take(key), take(other)
            both = min(n, m)
            put(both, exchanged(items, length, length + room))
            put(both, exchanged(others, length + room, length))
            for rest, own in ((n - both, items), (m - both, others)):
                if rest:
                    put(rest, own)
    return full + [(n, items) for n, items, _ in loose.values()]


def best_fit(counts: dict[int, int], open_recipes: Recipes, capacity: int) -> Recipes:
    """Decreasing best fit over counted lengths: equal sequences are handled together and split only where needed."""
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(n: int, items: tuple[int, ...]) -> None:
        room = capacity - sum(items)
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([n, items])

    for n, items in open_recipes:
        put(n, items)
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    put(n // each, (length,) * each)
                    n %= each
                else:
                    put(1, (length,) * n)
                    n = 0
                continue
            room = rooms[at]
            have, items = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            used = min(have, n)
            n -= used
            if have > used:
                put(have - used, items)
            put(used, (*items, length))
    return [(n, items) for room in sorted(by_room) for n, items in by_room[room]]


def placements(recipes: Recipes) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset), by rank; the r-th piece of a length goes to the last row at or below r."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for n, items in recipes:
        offset = 0
        for length in items:
            first = rank.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, offset))
            rank[length] = first + n
            offset += length
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its task and its rank among that task's pieces of the same length; with_ids adds ids binary
    (little-endian unsigned 32-bit integers)."""
    import pyarrow as pa

    path, schema = path or tokenizer_path("word_bpe_49k.json"), PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            at = 0
            for n, ids, bounds in enc.encode(batch.column(1), end_id):
                sizes = np.diff(bounds)
                counts = -(-sizes // capacity)
                owner = np.repeat(np.arange(n), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(capacity, sizes[owner] - start)
                first = bounds[owner] + start
                raw = memoryview(ids).cast("B")
                crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())), dtype=np.int64, count=len(first))
                order = np.argsort(length, kind="stable")  # ranks among the pieces of a length
                ordered = length[order]
                inside = np.arange(len(order)) - np.searchsorted(ordered, ordered)
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = inside + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                doc_ids = batch.column(0).slice(at, n).take(pa.array(owner))
                columns = [doc_ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(owner), part, dtype=np.int32)), pa.array(rank)]
                if with_ids:
                    columns.append(pa.array([raw[4 * a : 4 * (a + k)].tobytes() for a, k in zip(first.tolist(), length.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += n

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """One row per piece with the sequence that holds it and its place there, and its ids if asked for."""
    import pyarrow as pa

    cut = stored(pieces(docs, path, capacity, end_id, with_ids))
    by_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = docs.sparkSession.sparkContext.broadcast(placements(plan_recipes(counts, capacity, groups)))
    first = by_task.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("task_rank"))

    def run(batches):
        known = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                rows = known[int(n)]
                at = np.searchsorted(rows[:, 0], rank[own], side="right") - 1
                sequence[own] = rows[at, 1] + rank[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns[:5]), pa.array(sequence), pa.array(offset), *(batch.column(c) for c in own_columns[5:])], names=[*own_columns[:5], "sequence_id", "offset", *own_columns[5:]])

    own_columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = cut.join(first, ["part", "length"]).select(*own_columns, (F.col("task_rank") + F.col("local_rank")).alias("rank"))
    return map_batches(ranked, run, PLACED + (", ids binary" if with_ids else ""))


def packed_sequences(docs: DataFrame, **options) -> DataFrame:
    """One row per sequence: sequence_id, its number of tokens, their ids (little-endian unsigned 32-bit integers), and the
    documents and lengths of its pieces in order. A sequence is bounded by the capacity. Options are those of ``pack``."""
    placed = pack(docs, with_ids=True, **options)
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return rows.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
