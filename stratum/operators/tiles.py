"""Rasters as array tiles (image_id, channel, ty, tx, data), and resampling by windows.

A tile holds size x size values in rows, less at the right and lower edges. Every operation states, for each tile of its
result, the box of source pixels that it reads (``boxes``). Source tiles meet the boxes that touch them and send only the
part inside each box, so that what is shuffled is the boxes' area, about the image itself for maps near the identity.
The parts of a box are put together in one Arrow group per result tile, where NumPy computes the tile; a group is as large
as a box, whatever the image. Boxes are a row per tile; the table of who needs what is broadcast only up to
``BROADCAST_NEEDS`` rows, beyond that the tiles are shuffled once to meet it.

Defined cases: places without a source pixel give the fill value (0 unless said otherwise); pixels that are missing in the
input count as 0 once in a tile; positions that are not finite are outside.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stored

SIZE, BROADCAST_NEEDS = 256, 200_000
TILE = "image_id long, channel long, ty long, tx long, data array<double>"
_CROP = "image_id long, ty long, tx long, channel long, y0 long, x0 long, w long, data array<double>"


@dataclass(frozen=True)
class Shape:
    """Height and width of a raster, and the side of its tiles."""

    height: int
    width: int
    size: int = SIZE

    def tile(self, ty: int, tx: int) -> tuple[int, int, int, int]:
        """First row, first column, height and width of a tile."""
        y, x = ty * self.size, tx * self.size
        return y, x, min(self.size, self.height - y), min(self.size, self.width - x)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (part.split() for part in ddl.split(", "))])


def to_tiles(pixels: DataFrame, shape: Shape, keys=("image_id", "channel"), values=("v",)) -> DataFrame:
    """Tiles of pixel rows: keys, ty, tx, and an array per value (named data if there is one only)."""
    names = ["data"] if len(values) == 1 else list(values)
    size = shape.size
    place = F.struct((F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))).cast("long").alias("i"), *[F.col(v).cast("double").alias(n) for v, n in zip(values, names)])
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < shape.height) & (F.col("x") < shape.width)
    cut = pixels.where(inside).groupBy(*keys, F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")).agg(F.collect_list(place).alias("p"))  # a tile's values
    heads = [*keys, "ty", "tx"]
    ddl = ", ".join([*(f"{k} long" for k in heads), *(f"{n} array<double>" for n in names)])
    schema = _schema(ddl)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {n: [] for n in names}
            for r in range(batch.num_rows):
                _, _, h, w = shape.tile(batch.column(len(keys))[r].as_py(), batch.column(len(keys) + 1)[r].as_py())
                own = batch.column(len(heads))[r].values
                i = own.field("i").to_numpy()
                for n in names:
                    full = np.zeros(size * size)
                    full[i] = own.field(n).to_numpy(zero_copy_only=False)
                    out[n].append(full.reshape(size, size)[:h, :w].ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(pa.int64()) for k in range(len(heads))), *(pa.array(out[n], pa.list_(pa.float64())) for n in names)], schema=schema)

    ship_package(pixels.sparkSession)
    return cut.mapInArrow(dense, ddl)


def to_pixels(tiles: DataFrame, shape: Shape) -> DataFrame:
    """Pixel rows (image_id, channel, y, x, v) of tiles."""
    wide = F.least(F.lit(shape.size), F.lit(shape.width) - F.col("tx") * shape.size)
    rows = tiles.select("image_id", "channel", "ty", "tx", wide.alias("w"), F.posexplode("data").alias("i", "v"))
    return rows.select("image_id", "channel", (F.col("ty") * shape.size + F.floor(F.col("i") / F.col("w"))).alias("y"), (F.col("tx") * shape.size + F.col("i") % F.col("w")).alias("x"), "v")


def tile_grid(tiles: DataFrame, shape: Shape) -> DataFrame:
    """image_id, its channels, and ty, tx for every tile of a raster of this shape."""
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(-(-n // shape.size) - 1)).cast("array<bigint>"))
    return tiles.groupBy("image_id").agg(F.sort_array(F.collect_set("channel")).alias("channels")).withColumn("ty", line(shape.height)).withColumn("tx", line(shape.width))


def _needs(boxes: DataFrame, source: Shape) -> DataFrame:
    """Per source tile (image_id, sy, sx) the result tiles that read it, with the part they read."""
    side = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / source.size), F.floor(F.col(b) / source.size)))
    met = boxes.where("y0 <= y1 and x0 <= x1").withColumn("sy", side("y0", "y1")).withColumn("sx", side("x0", "x1"))
    low = lambda c, s: F.greatest(F.col(c), F.col(s) * source.size).cast("long").alias(c)
    high = lambda c, s: F.least(F.col(c), (F.col(s) + 1) * source.size - 1).cast("long").alias(c)
    part = met.select("image_id", "sy", "sx", F.struct("ty", "tx", low("y0", "sy"), high("y1", "sy"), low("x0", "sx"), high("x1", "sx")).alias("part"))
    return part.groupBy("image_id", "sy", "sx").agg(F.collect_list("part").alias("parts"))


def read_area(boxes: DataFrame) -> int:
    """Pixels that the boxes read, overlaps counted: what is shuffled per channel."""
    return boxes.where("y0 <= y1 and x0 <= x1").agg(F.sum((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1))).first()[0] or 0


def _sent(tiles: DataFrame, needs: DataFrame, source: Shape) -> DataFrame:
    """The parts of tiles inside each box."""
    needs = stored(needs)
    if needs.count() <= BROADCAST_NEEDS:
        needs = F.broadcast(needs)
    met = tiles.select("image_id", "channel", F.col("ty").alias("sy"), F.col("tx").alias("sx"), "data").join(needs, ["image_id", "sy", "sx"])
    schema = _schema(_CROP)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                image, sy, sx, channel = (batch.column(n)[r].as_py() for n in ("image_id", "sy", "sx", "channel"))
                y, x, h, w = source.tile(sy, sx)
                data = batch.column("data")[r].values.to_numpy().reshape(h, w)
                rows = [(image, p["ty"], p["tx"], channel, p["y0"], p["x0"], p["x1"] - p["x0"] + 1, data[p["y0"] - y : p["y1"] - y + 1, p["x0"] - x : p["x1"] - x + 1].ravel()) for p in batch.column("parts")[r].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ship_package(tiles.sparkSession)
    return met.mapInArrow(cut, _CROP)


Sampler = Callable[[dict, np.ndarray, int, int], np.ndarray]


def map_windows(tiles: DataFrame, source: Shape, boxes: DataFrame, make: Callable[[dict], Callable[[np.ndarray], np.ndarray]]) -> DataFrame:
    """Result tiles. boxes: image_id, channels, ty, tx, y0, y1, x0, x1 (of source pixels, inclusive, within the image; empty
    if y1 < y0 or x1 < x0) and whatever else ``make`` reads. make(box) gives a function from the box's window to the
    values of the tile; a window is zero where no pixel is known, and has no cells if the box is empty."""
    boxes = stored(boxes)
    crops = _sent(tiles, _needs(boxes, source), source)
    schema = _schema(TILE)

    def compute(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            box = left.slice(0, 1).to_pylist()[0]
            box |= {n: left.column(n)[0].values.to_numpy() for n in left.column_names if pa.types.is_list(left.schema.field(n).type) and n != "channels"}
            h, w, apply = max(0, box["y1"] - box["y0"] + 1), max(0, box["x1"] - box["x0"] + 1), make(box)
            windows = {c: np.zeros((h, w)) for c in box["channels"]}
            for r in range(right.num_rows):
                part = right.column("data")[r].values.to_numpy()
                wide, y, x = (right.column(n)[r].as_py() for n in ("w", "y0", "x0"))
                y, x = y - box["y0"], x - box["x0"]
                windows[right.column("channel")[r].as_py()][y : y + len(part) // wide, x : x + wide] = part.reshape(-1, wide)
            out = [(box["image_id"], c, box["ty"], box["tx"], apply(window).ravel()) for c, window in windows.items()]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    key = ("image_id", "ty", "tx")
    return boxes.groupBy(*key).cogroup(crops.groupBy(*key)).applyInArrow(compute, TILE)


def bilinear(window: np.ndarray, y: np.ndarray, x: np.ndarray, box: dict, source: Shape, border: bool, fill: float) -> np.ndarray:
    """Values at positions (y, x): the four pixels around, those outside the image left out (or the border's)."""
    total, seen = np.zeros(y.shape), np.zeros(y.shape, bool)
    fine = np.isfinite(y) & np.isfinite(x)
    y, x = np.where(fine, y, -9.0), np.where(fine, x, -9.0)
    low_y, low_x = np.floor(y), np.floor(x)
    for dy in (0, 1):
        for dx in (0, 1):
            weight = (y - low_y if dy else 1 - (y - low_y)) * (x - low_x if dx else 1 - (x - low_x))
            _gather(window, low_y + dy, low_x + dx, weight, fine & (weight > 0), box, source, border, total, seen)
    return np.where(seen, total, fill)


def nearest(window: np.ndarray, y: np.ndarray, x: np.ndarray, box: dict, source: Shape, border: bool, fill: float) -> np.ndarray:
    """Values of the nearest pixels (half to even)."""
    total, seen = np.zeros(y.shape), np.zeros(y.shape, bool)
    fine = np.isfinite(y) & np.isfinite(x)
    _gather(window, np.rint(np.where(fine, y, -9.0)), np.rint(np.where(fine, x, -9.0)), np.ones(y.shape), fine, box, source, border, total, seen)
    return np.where(seen, total, fill)


def _gather(window, y, x, weight, use, box, source, border, total, seen) -> None:
    if border:
        y, x = np.clip(y, 0, source.height - 1), np.clip(x, 0, source.width - 1)
    use = use & (y >= 0) & (y < source.height) & (x >= 0) & (x < source.width)
    if use.any():
        total[use] += weight[use] * window[(y[use] - box["y0"]).astype(np.int64), (x[use] - box["x0"]).astype(np.int64)]
        seen |= use


_MODES = {"bilinear": bilinear, "nearest": nearest}


def _span(low: Column, high: Column, n: int, border: bool, axis: str) -> dict[str, Column]:
    """The pixels that positions from low to high read. Positions far outside do not make a box larger."""
    low, high = F.floor(F.greatest(F.least(low, F.lit(float(n))), F.lit(-2.0))), F.floor(F.greatest(F.least(high, F.lit(float(n))), F.lit(-2.0))) + 1
    first, last = F.greatest(low, F.lit(0)), F.least(high, F.lit(n - 1))
    if border:
        first, last = F.least(first, F.lit(n - 1)), F.greatest(last, F.lit(0))
    return {f"{axis}0": first.cast("long"), f"{axis}1": last.cast("long")}


def _edges(target: Shape) -> tuple[Column, Column, Column, Column]:
    """First and last row and column of a result tile."""
    y, x = F.col("ty") * target.size, F.col("tx") * target.size
    return y, F.least(y + target.size, F.lit(target.height)) - 1, x, F.least(x + target.size, F.lit(target.width)) - 1


def warp_affine(tiles: DataFrame, matrices: DataFrame, source: Shape, target: Shape | None = None, fill: float = 0.0, border: bool = False, mode: str = "bilinear") -> DataFrame:
    """Tiles under a map a..f from target (x, y) to source. matrices: image_id, a..f."""
    target = target or source
    y0, y1, x0, x1 = _edges(target)
    grid = tile_grid(tiles, target).join(matrices.select("image_id", *[F.col(c).cast("double").alias(c) for c in "abcdef"]), "image_id")
    sx = [F.col("a") * x + F.col("b") * y + F.col("c") for x in (x0, x1) for y in (y0, y1)]
    sy = [F.col("d") * x + F.col("e") * y + F.col("f") for x in (x0, x1) for y in (y0, y1)]
    boxes = grid.withColumns(_span(F.least(*sy), F.greatest(*sy), source.height, border, "y") | _span(F.least(*sx), F.greatest(*sx), source.width, border, "x"))

    def make(box: dict):
        y, x, h, w = target.tile(box["ty"], box["tx"])
        yy, xx = np.mgrid[y : y + h, x : x + w].astype(float)
        sy, sx = box["d"] * xx + box["e"] * yy + box["f"], box["a"] * xx + box["b"] * yy + box["c"]
        return lambda window: _MODES[mode](window, sy, sx, box, source, border, fill)

    return map_windows(tiles, source, boxes, make)


def sample_field(tiles: DataFrame, positions: DataFrame, source: Shape, target: Shape, border: bool = False, fill: float = 0.0, mode: str = "bilinear") -> DataFrame:
    """Values at positions. positions: tiles of the target's shape (image_id, ty, tx, sy, sx), as ``to_tiles`` makes them."""
    low = lambda c: F.array_min(F.filter(c, lambda v: F.abs(v) < float("inf")))
    high = lambda c: F.array_max(F.filter(c, lambda v: F.abs(v) < float("inf")))
    channels = tiles.groupBy("image_id").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    span = _span(low("sy"), high("sy"), source.height, border, "y") | _span(low("sx"), high("sx"), source.width, border, "x")
    boxes = positions.join(channels, "image_id").withColumns({k: F.coalesce(v, F.lit(0 if k[1] == "0" else -1)).cast("long") for k, v in span.items()})

    def make(box: dict):
        _, _, h, w = target.tile(box["ty"], box["tx"])
        sy, sx = box["sy"].reshape(h, w), box["sx"].reshape(h, w)
        return lambda window: _MODES[mode](window, sy, sx, box, source, border, fill)

    return map_windows(tiles, source, boxes, make)


def resample(tiles: DataFrame, source: Shape, target: Shape, mode: str = "bilinear", align_corners: bool = False) -> DataFrame:
    """Resize. Positions: (t + .5) * scale - .5 without align_corners (cut at the border), t * (n - 1) / (m - 1) with it,
    floor(t * scale) for the nearest pixel."""

    def at(t, n: int, m: int, floor, low, high):
        if mode == "nearest":
            return floor(t * n / m)
        if align_corners:
            return t * ((n - 1) / (m - 1) if m > 1 else 0.0)
        return low(high((t + 0.5) * (n / m) - 0.5, 0.0), float(n - 1))

    column = lambda t, n, m: at(t, n, m, lambda c: F.floor(c).cast("double"), lambda c, v: F.least(c, F.lit(v)), lambda c, v: F.greatest(c, F.lit(v)))
    y0, y1, x0, x1 = _edges(target)
    y, x = (lambda t: column(t, source.height, target.height)), (lambda t: column(t, source.width, target.width))
    boxes = tile_grid(tiles, target).withColumns(_span(y(y0), y(y1), source.height, False, "y") | _span(x(x0), x(x1), source.width, False, "x"))

    def make(box: dict):
        first_y, first_x, h, w = target.tile(box["ty"], box["tx"])
        line = lambda first, k, n, m: at(np.arange(first, first + k, dtype=float), n, m, np.floor, np.minimum, np.maximum)
        sy, sx = np.meshgrid(line(first_y, h, source.height, target.height), line(first_x, w, source.width, target.width), indexing="ij")
        return lambda window: _MODES[mode](window, sy, sx, box, source, False, 0.0)

    return map_windows(tiles, source, boxes, make)


def _kernel(size: int, sigma: float) -> np.ndarray:
    w = np.array([math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)])
    return w / w.sum()


def _smoothed(window: np.ndarray, rows: slice, columns: slice, kernel: np.ndarray) -> np.ndarray:
    """The weighted sums at the given rows and columns of a window, zero outside it."""
    half = len(kernel) // 2
    padded = np.pad(window, half)
    down = sum(k * padded[rows.start + i : rows.stop + i] for i, k in enumerate(kernel))
    return sum(k * down[:, columns.start + i : columns.stop + i] for i, k in enumerate(kernel))


def _around(grid: DataFrame, source: Shape, target: Shape, half: int, factor: int) -> DataFrame:
    """Boxes of the factor-fold tile and half pixels around it."""
    y0, y1, x0, x1 = _edges(target)
    low, high = (lambda c: F.greatest(c * factor - half, F.lit(0)).cast("long")), (lambda c, n: F.least((c + 1) * factor - 1 + half, F.lit(n - 1)).cast("long"))
    return grid.withColumns({"y0": low(y0), "y1": high(y1, source.height), "x0": low(x0), "x1": high(x1, source.width)})


def gaussian_smooth(tiles: DataFrame, source: Shape, size: int = 3, sigma: float = 1.0) -> DataFrame:
    """Separable normalised Gaussian with zero padding."""
    kernel = _kernel(size, sigma)

    def make(box: dict):
        y, x, h, w = source.tile(box["ty"], box["tx"])
        at, to = y - box["y0"], x - box["x0"]
        return lambda window: _smoothed(window, slice(at, at + h), slice(to, to + w), kernel)

    return map_windows(tiles, source, _around(tile_grid(tiles, source), source, source, size // 2, 1), make)


def half(tiles: DataFrame, source: Shape, size: int = 3, sigma: float = 1.0) -> tuple[DataFrame, Shape]:
    """The next level: smoothed, then the mean of 2 x 2 (of what there is at an odd edge)."""
    target, kernel = Shape(-(-source.height // 2), -(-source.width // 2), source.size), _kernel(size, sigma)

    def make(box: dict):
        y, x, h, w = target.tile(box["ty"], box["tx"])
        at, to = 2 * y - box["y0"], 2 * x - box["x0"]
        rows, columns = min(2 * h, source.height - 2 * y), min(2 * w, source.width - 2 * x)

        def apply(window: np.ndarray) -> np.ndarray:
            full = np.full((2 * h, 2 * w), np.nan)
            full[:rows, :columns] = _smoothed(window, slice(at, at + rows), slice(to, to + columns), kernel)
            return np.nanmean(full.reshape(h, 2, w, 2).swapaxes(1, 2).reshape(h, w, 4), axis=2)

        return apply

    return map_windows(tiles, source, _around(tile_grid(tiles, target), source, target, size // 2, 2), make), target


def pyramid(tiles: DataFrame, source: Shape, levels: int) -> list[tuple[DataFrame, Shape]]:
    """Tiles and shape of each level; level 0 is the input. Each level is stored before the next one reads it."""
    out = [(tiles, source)]
    for _ in range(1, levels):
        finer, shape = out[-1]
        coarser, smaller = half(finer, shape)
        out.append((stored(coarser), smaller))
    return out
