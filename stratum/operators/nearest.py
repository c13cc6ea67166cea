"""k nearest neighbours of any density, by one quadtree of counts over both sides.

Both sides' points are counted in nested squares. A square is split while it holds more than ``MOST`` points of either
side that are not all in one place; a job counts ``STEP`` levels at once, and only points in squares that are still to be split go on. So leaves follow
the density, and a far point costs levels, not candidates.

Each leaf with left points then looks for the leaves that can hold their neighbours, from the root down: of the squares
it still considers, those whose farthest corner is near enough hold k points together, and that distance bounds the
search; squares that begin beyond it are dropped, the others are replaced by their parts. Boxes are those of the points,
not of the squares. A leaf found sends a left leaf only the points that can be among the k nearest somewhere in its box:
not those that k others beat at all four corners, and so everywhere inside. At last they meet the left leaf's points in
one group, where NumPy keeps the k nearest of each; nothing but results leaves it. A leaf of more than ``MOST`` left points (all in one place) is dealt out
in portions. Of right points in one place only the lowest ids that can count take part from the beginning, and groups of
keys without points of both sides drop out before anything is counted.

Tables of squares, leaves and pairs grow with the points but are packed so well in files that Spark would take them for
small ones and send them whole through the driver; so their joins ask for a merge.

Defined cases: points without finite coordinates have no neighbours and are none; fewer than k right points in a group
give as many as there are; equal distances go to the lowest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ship_package, spread_out, stored

MOST, STEP, DEPTH = 512, 7, 42
#: Levels that the search goes down at once.
DOWN = 3
#: Left leaves that a group of one right leaf serves, and points that may beat others there.
SERVED, BEST = 2048, 64
_BOX = ("x0", "x1", "y0", "y1")


def _shift(c: str, by: int) -> Column:
    return F.shiftright(F.col(c), by)


def _placed(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with their place (gx, gy) on the finest level of their group's square; groups without both sides are left out."""
    ends = points.groupBy(*keys).agg(F.min("x").alias("_x"), F.min("y").alias("_y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("_side"), (F.bool_or("is_right") & ~F.bool_and("is_right")).alias("_both")).where("_both").drop("_both")
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"_{c}")) / F.when(F.col("_side") > 0, F.col("_side")).otherwise(1.0) * float(1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    return points.join(ends, keys).withColumns({"gx": at("x"), "gy": at("y")}).drop("_x", "_y", "_side")


_CELL = "node boolean, level int, cx long, cy long, leaf boolean, nl long, nr long, " + ", ".join(f"{s}_{c} double" for s in "lr" for c in _BOX)


def _split_cells(cells: DataFrame, keys: list[str], base: int, fine: int, most: int) -> DataFrame:
    """The squares from level base to fine above some finest cells (node), and each cell with its leaf's level (not node;
    null if it is to be split further). The cells of one square of level base, at most 4 ** STEP, are one group."""
    names, sums = [*keys, *(part.split()[0] for part in _CELL.split(", "))], ("nl", "nr")
    bounds = [f"{s}_{c}" for s in "lr" for c in _BOX]
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([*((k, pa.int64()) for k in keys), *((n, kinds[t]) for n, t in (part.split() for part in _CELL.split(", ")))])

    def compute(group: pa.Table) -> pa.Table:
        at = {c: group.column(c).to_numpy() for c in ("cx", "cy", *sums)} | {c: group.column(c).to_numpy(zero_copy_only=False).astype(float) for c in bounds}
        n = group.num_rows
        inner = [at[c] & ((1 << (fine - base)) - 1) for c in ("cx", "cy")]
        open_cells, leaf_level, out = np.ones(n, bool), np.full(n, -1), []
        for level in range(base, fine + 1):
            square = ((inner[0] >> (fine - level)) << STEP) | (inner[1] >> (fine - level))
            _, first, own, size = np.unique(square, return_index=True, return_inverse=True, return_counts=True)
            order, starts = np.argsort(own, kind="stable"), np.cumsum(size) - size
            total = {c: np.add.reduceat(at[c][order], starts) for c in sums}
            box = {c: (np.fmin if c[-1] == "0" else np.fmax).reduceat(at[c][order], starts) for c in bounds}  # NaN: no points
            apart = [np.fmax(box[f"l_{c}1"], box[f"r_{c}1"]) > np.fmin(box[f"l_{c}0"], box[f"r_{c}0"]) for c in "xy"]
            split = ((total["nl"] > most) | (total["nr"] > most)) & (level < DEPTH) & (apart[0] | apart[1])
            seen = np.flatnonzero(open_cells[first] & (level > base or base == 0))  # a square exists if all above it are split
            out.append({"node": np.ones(len(seen), bool), "level": np.full(len(seen), level), "cx": at["cx"][first[seen]] >> (fine - level), "cy": at["cy"][first[seen]] >> (fine - level), "leaf": ~split[seen]} | {c: v[seen] for c, v in (total | box).items()})
            leaf_level[open_cells & ~split[own]] = level
            open_cells &= split[own]
        nodes = {c: np.concatenate([o[c] for o in out]) for c in out[0]}
        told = {"node": np.zeros(n, bool), "level": leaf_level, "cx": at["cx"], "cy": at["cy"]}
        columns = [np.full(n + len(nodes["node"]), group.column(k)[0].as_py()) for k in keys]
        columns += [np.concatenate([nodes[c], told.get(c, np.full(n, np.nan) if c in bounds else np.zeros(n, nodes[c].dtype))]) for c in names[len(keys) :]]
        blank = {"level": columns[names.index("level")] < 0} | {c: np.isnan(columns[names.index(c)]) for c in bounds}
        return pa.Table.from_arrays([pa.array(c, f.type, mask=blank.get(f.name)) for c, f in zip(columns, schema)], names=names)

    ship_package(cells.sparkSession)
    square = [_shift(c, fine - base).alias(f"base_{c}") for c in ("cx", "cy")]
    return cells.withColumns({"base_cx": square[0], "base_cy": square[1]}).groupBy(*keys, "base_cx", "base_cy").applyInArrow(compute, ", ".join([*(f"{k} long" for k in keys), _CELL]))


def quadtree(points: DataFrame, keys: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(points with their leaf: level, cx, cy; nodes: keys, level, cx, cy, leaf, nl, nr, and the boxes l_* and r_* of both
    sides). points: keys, is_right, id, x, y."""
    open_points, base = stored(_placed(points, keys)), 0
    done, nodes = [], []
    left, right = ~F.col("is_right"), F.col("is_right")
    while True:
        fine = min(base + STEP, DEPTH)
        counts = [F.count(F.when(left, 1)).alias("nl"), F.count(F.when(right, 1)).alias("nr")]
        boxes = [f(F.when(side, F.col(c))).alias(f"{s}_{c}{i}") for s, side in (("l", left), ("r", right)) for c in "xy" for i, f in ((0, F.min), (1, F.max))]
        cells = open_points.groupBy(*keys, _shift("gx", DEPTH - fine).alias("cx"), _shift("gy", DEPTH - fine).alias("cy")).agg(*counts, *boxes)
        told = stored(_split_cells(cells, keys, base, fine, most))
        nodes.append(told.where("node").drop("node"))
        leaves = told.where("not node").select(*keys, "cx", "cy", "level")
        met = stored(open_points.withColumns({"cx": _shift("gx", DEPTH - fine), "cy": _shift("gy", DEPTH - fine)}).join(leaves.hint("merge"), [*keys, "cx", "cy"]))
        done.append(met.where("level is not null").withColumns({"cx": F.expr(f"shiftright(cx, {fine} - level)"), "cy": F.expr(f"shiftright(cy, {fine} - level)")}))
        open_points = met.where("level is null").drop("cx", "cy", "level")
        if open_points.isEmpty():
            break
        base = fine
    return _union(done), _union(nodes)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _found_leaves(nodes: DataFrame, keys: list[str], need: int) -> DataFrame:
    """keys, block (level, x, y of a leaf with left points), n of its left points and their box b_*, and level, cx, cy of the
    leaves to read."""
    block = F.struct(F.col("level").alias("level"), F.col("cx").alias("x"), F.col("cy").alias("y")).alias("block")
    blocks = nodes.where("leaf and nl > 0").select(*keys, block, F.col("nl").alias("n"), *[F.col(f"l_{c}").alias(f"b_{c}") for c in _BOX])
    tree = nodes.where((F.col("nr") > 0) & (F.col("leaf") | (F.col("level") % DOWN == 0))).select(*keys, "level", "cx", "cy", "leaf", "nr", *[f"r_{c}" for c in _BOX])
    parts = tree.where("level > 0").withColumn("up", (F.floor((F.col("level") - 1) / DOWN) * DOWN).cast("int")).withColumns({"px": F.expr("shiftright(cx, level - up)"), "py": F.expr("shiftright(cy, level - up)")})
    front = blocks.join(tree.where("level = 0").hint("merge"), keys)
    square = lambda c: c * c
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"r_{a}0") - F.col(f"b_{a}1"), F.col(f"b_{a}0") - F.col(f"r_{a}1"))
    span = lambda a: F.greatest(F.abs(F.col(f"r_{a}1") - F.col(f"b_{a}0")), F.abs(F.col(f"b_{a}1") - F.col(f"r_{a}0")))
    own = W.partitionBy(*keys, "block")  # a block's squares, at most a few hundred
    while True:
        known = front.withColumns({"near": F.sqrt(square(gap("x")) + square(gap("y"))), "far": F.sqrt(square(span("x")) + square(span("y")))})
        enough = F.sum("nr").over(own.orderBy("far").rowsBetween(W.unboundedPreceding, 0)) >= need
        bound = known.withColumn("_enough", enough).withColumn("bound", F.min(F.when(F.col("_enough"), F.col("far"))).over(own))
        front = stored(bound.where("bound is null or near <= bound * (1 + 1e-9)").drop("near", "far", "_enough", "bound"))
        inner = front.where("not leaf")
        if inner.isEmpty():
            return front.select(*keys, "block", "n", "level", "cx", "cy", *[f"b_{c}" for c in _BOX])
        down = inner.select(*keys, "block", "n", *[f"b_{c}" for c in _BOX], F.col("level").alias("up"), F.col("cx").alias("px"), F.col("cy").alias("py")).join(parts.hint("merge"), [*keys, "up", "px", "py"])
        front = front.where("leaf").unionByName(down.select(*front.columns))


def _beaten(to: np.ndarray, less: np.ndarray, by: int) -> np.ndarray:
    """How many of the by points nearest to each box are nearer at all its corners: to (corner, box, point) below less."""
    best = np.argpartition(to.sum(axis=0), by - 1, axis=1)[:, :by]
    than, count = np.take_along_axis(to, best[None], axis=2), np.zeros(to.shape[1:], np.int16)
    for t in range(by):
        nearer = than[0, :, t, None] < less[0]
        for corner in range(1, 4):
            nearer &= than[corner, :, t, None] < less[corner]
        count += nearer
    return count


def near_somewhere(x: np.ndarray, y: np.ndarray, x0, x1, y0, y1, need: int) -> np.ndarray:
    """Which points can be among the need nearest of a place in the box; a row per box, if these are arrays. Where one point
    is nearer than another is a half plane, so a point that is nearer at all corners is nearer everywhere inside; differences
    that rounding may turn do not count."""
    left, right, low, high = (np.reshape(c, (-1, 1)) for c in (x0, x1, y0, y1))
    kept = np.ones((len(left), len(x)), bool)
    rows = max(1, (1 << 17) // max(1, len(x)))
    for at in range(0, len(left) if len(x) > need else 0, rows):
        s = slice(at, at + rows)
        to = np.stack([dx + dy for dx in ((x - left[s]) ** 2, (x - right[s]) ** 2) for dy in ((y - low[s]) ** 2, (y - high[s]) ** 2)])
        less = to - 1e-9 * to.max(axis=(0, 2))[:, None]
        own = _beaten(to, less, min(2 * need, len(x))) < need  # a few beat most of the points already
        count = own.sum(axis=1)
        alike = np.ceil(np.log2(np.maximum(count, 1))).astype(int)
        for size in np.unique(alike[count > need]):
            of = np.flatnonzero(alike == size)
            most = int(count[of].max())
            place = np.argsort(~own[of], axis=1, kind="stable")[:, :most]
            held = np.arange(most) < count[of, None]
            rest, below = (np.where(held, np.take_along_axis(c[:, of], place[None], axis=2), np.inf) for c in (to, less))
            again = np.zeros((len(of), len(x)), bool)
            np.put_along_axis(again, place, held & (_beaten(rest, below, min(max(BEST, 2 * need), most)) < need), axis=1)
            own[of] = again
        kept[s] = own
    return kept if np.ndim(x0) else kept[0]


def _sent_points(rights: DataFrame, pairs: DataFrame, keys: list[str], need: int) -> DataFrame:
    """to_keys, to_block, portions, id, x, y: what each right leaf sends the left leaves that read it. rights: keys, level, cx,
    cy, id, x, y. A leaf that very many read is dealt out, SERVED of them a group."""
    leaf = [*keys, "level", "cx", "cy"]
    deals = stored(pairs.groupBy(*leaf).agg(F.ceil(F.count("*") / SERVED).cast("int").alias("deals")))
    boxes = [f"b_{c}" for c in _BOX]
    of = F.col("block")
    readers = pairs.join(deals.hint("merge"), leaf).select(*[F.col(c).alias(f"of_{c}") for c in leaf], F.pmod(F.xxhash64("block"), F.col("deals")).cast("int").alias("of_deal"), of["level"].alias("to_level"), of["x"].alias("to_x"), of["y"].alias("to_y"), F.col("portions").cast("long").alias("portions"), *boxes)
    dealt = rights.join(deals.hint("merge"), leaf).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select(*leaf, "deal", "id", "x", "y")
    told = [*[(f"to_{c}", pa.int64()) for c in keys], ("to_level", pa.int32()), ("to_x", pa.int64()), ("to_y", pa.int64()), ("portions", pa.int64()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64())]
    schema = pa.schema(told)

    def compute(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ids, x, y = (a.column(c).to_numpy() for c in ("id", "x", "y"))
        box = np.stack([b.column(c).to_numpy() for c in boxes], axis=1)
        reader, which = np.nonzero(near_somewhere(x, y, *box.T, need))
        reader = pa.array(reader)
        group = [pa.array(np.full(len(which), a.column(c)[0].as_py())) for c in keys]
        to = [b.column(c).combine_chunks().take(reader) for c in ("to_level", "to_x", "to_y", "portions")]
        return pa.Table.from_arrays([*group, *to, pa.array(ids[which]), pa.array(x[which]), pa.array(y[which])], schema=schema)

    ship_package(rights.sparkSession)
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double"}
    by, of_by = [*leaf, "deal"], [f"of_{c}" for c in (*leaf, "deal")]
    sent = spread_out(dealt, *by).groupBy(*by).cogroup(spread_out(readers, *of_by).groupBy(*of_by)).applyInArrow(compute, ", ".join(f"{n} {names[t]}" for n, t in told))
    block = F.struct(F.col("to_level").alias("level"), F.col("to_x").alias("x"), F.col("to_y").alias("y"))
    return sent.select(*[f"to_{c}" for c in keys], block.alias("to_block"), "portions", "id", "x", "y")


def nearest_rows(xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray, k: int, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest b of each a; b is in order of its id. same marks pairs to leave out."""
    d = np.sqrt((xa[:, None] - xb[None]) ** 2 + (ya[:, None] - yb[None]) ** 2)
    if same is not None:
        d[same] = np.inf
    k = min(k, d.shape[1])
    limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    below, equal = d < limit, d == limit
    chosen = below | equal & (np.cumsum(equal, axis=1) <= k - below.sum(axis=1, keepdims=True))
    a, b = np.nonzero(chosen & np.isfinite(d))
    return a, b, d[a, b]


def knn_join(left: DataFrame, right: DataFrame, k: int, keys=("grp",), other: bool = False, most: int = MOST) -> DataFrame:
    """The k nearest right points of each left point, any distance: keys, id_a, id_b, xa, ya, xb, yb, distance, rank. Both
    sides: keys, id, x, y. other leaves pairs of one id out."""
    keys, need = list(keys), k + (1 if other else 0)
    finite = (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    side = lambda df, flag: df.where(finite).select(*[F.col(c).cast("long").alias(c) for c in keys], F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(flag).alias("is_right"))
    lowest = (F.dense_rank if other else F.row_number)().over(W.partitionBy(*keys, "x", "y").orderBy("id"))  # of a place
    rights = side(right, True).withColumn("_r", lowest).where(F.col("_r") <= need).drop("_r")
    points, nodes = quadtree(side(left, False).unionByName(rights), keys, most)
    pairs = stored(_found_leaves(nodes, keys, need).withColumn("portions", F.ceil(F.col("n") / most)))
    rights = points.where("is_right").select(*keys, "level", "cx", "cy", "id", "x", "y")
    sent = _sent_points(rights, pairs, keys, need).withColumn("to_portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1))).drop("portions")
    sizes = pairs.select(*keys, "block", "portions").distinct()
    lefts = points.where("not is_right").withColumn("block", F.struct(F.col("level").alias("level"), F.col("cx").alias("x"), F.col("cy").alias("y"))).join(sizes.hint("merge"), [*keys, "block"])
    lefts = lefts.select(*keys, "block", F.pmod(F.xxhash64("id"), F.col("portions")).alias("portion"), *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y")])
    names = [*keys, "id_a", "id_b", "xa", "ya", "xb", "yb", "distance", "rank"]
    kinds = [pa.int64()] * (len(keys) + 2) + [pa.float64()] * 5 + [pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def compute(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        group = [a.column(c)[0].as_py() for c in keys]
        ia, xa, ya = (a.column(c).to_numpy() for c in ("a_id", "a_x", "a_y"))
        order = np.argsort(b.column("id").to_numpy(), kind="stable")
        ib, xb, yb = (b.column(c).to_numpy()[order] for c in ("id", "x", "y"))
        found = []
        rows = max(1, (1 << 22) // len(ib))  # distances held at once
        for at in range(0, len(ia), rows):
            s = slice(at, at + rows)
            i, j, d = nearest_rows(xa[s], ya[s], xb, yb, k, ia[s, None] == ib[None] if other else None)
            by = np.lexsort((ib[j], d, i))
            i, j, d = i[by], j[by], d[by]
            rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
            found.append((ia[s][i], ib[j], xa[s][i], ya[s][i], xb[j], yb[j], d, rank))
        columns = [np.concatenate(c) for c in zip(*found)]
        return pa.Table.from_arrays([*(pa.array([g] * len(columns[0]), pa.int64()) for g in group), *(pa.array(c, t) for c, t in zip(columns, kinds[len(keys) :]))], schema=schema)

    ship_package(left.sparkSession)
    ddl = ", ".join(f"{n} {'double' if t == pa.float64() else 'long'}" for n, t in zip(names, kinds))
    by, to_by = [*keys, "block", "portion"], [f"to_{c}" for c in (*keys, "block", "portion")]
    return spread_out(lefts, *by).groupBy(*by).cogroup(spread_out(sent, *to_by).groupBy(*to_by)).applyInArrow(compute, ddl)
