"""Rasters in array tiles, against NumPy on whole images."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratum.operators import tiles as T


def rows_of(spark, images):
    """Tiles of {(image_id, channel): array}, all of one shape."""
    rows = [(i, c, y, x, float(v)) for (i, c), a in images.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "image_id long, channel long, y long, x long, v double")


def arrays_of(pixels, shape):
    out = {}
    for r in pixels.collect():
        out.setdefault((r.image_id, r.channel), np.full(shape, np.nan))[r.y, r.x] = r.v
    return out


def sampled(a, sy, sx, border=False, fill=0.0):
    h, w = a.shape
    if not (math.isfinite(sy) and math.isfinite(sx)):
        return fill
    total, seen = 0.0, False
    for y, wy in ((math.floor(sy), 1 - (sy - math.floor(sy))), (math.floor(sy) + 1, sy - math.floor(sy))):
        for x, wx in ((math.floor(sx), 1 - (sx - math.floor(sx))), (math.floor(sx) + 1, sx - math.floor(sx))):
            if border:
                y2, x2 = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
            elif 0 <= y < h and 0 <= x < w:
                y2, x2 = y, x
            else:
                continue
            if wy * wx > 0:
                total, seen = total + wy * wx * a[y2, x2], True
    return total if seen else fill


def images(h=23, w=37):
    rng = np.random.default_rng(1)
    return {(i, c): rng.integers(0, 256, (h, w)).astype(float) for i in (3, 8) for c in (0, 2)}


def test_tiles_and_back(spark):
    made, shape = images(), T.Shape(23, 37, 8)
    tiles = T.to_tiles(rows_of(spark, made), shape)
    assert tiles.count() == 4 * 3 * 5
    back = arrays_of(T.to_pixels(tiles, shape), (23, 37))
    assert all((back[k] == made[k]).all() for k in made)
    holes = arrays_of(T.to_pixels(T.to_tiles(rows_of(spark, made).where("y <> 5 and x < 30"), shape), shape), (23, 37))[3, 0]
    assert (holes[5, :30] == 0).all() and (holes[4, :30] == made[3, 0][4, :30]).all()
    assert T.to_tiles(rows_of(spark, made).where("false"), shape).count() == 0


@pytest.mark.parametrize(("border", "fill"), [(False, 0.0), (False, -7.0), (True, 0.0)])
def test_affine_against_whole_images(spark, border, fill):
    made, source, target = images(), T.Shape(23, 37, 8), T.Shape(30, 19, 16)
    maps = {3: (0.8, -0.4, 9.5, 0.5, 0.9, -6.0), 8: (-1.3, 0.0, 40.0, 0.0, 2.5, -11.25)}
    matrices = spark.createDataFrame([(i, *m) for i, m in maps.items()], "image_id long, a double, b double, c double, d double, e double, f double")
    found = arrays_of(T.to_pixels(T.warp_affine(T.to_tiles(rows_of(spark, made), source), matrices, source, target, fill, border), target), (30, 19))
    for (i, c), a in made.items():
        k = maps[i]
        want = [[sampled(a, k[3] * x + k[4] * y + k[5], k[0] * x + k[1] * y + k[2], border, fill) for x in range(19)] for y in range(30)]
        assert np.allclose(found[i, c], want)


def test_field_with_odd_positions(spark):
    made, shape = images(), T.Shape(23, 37, 8)
    rng = np.random.default_rng(2)
    sy, sx = rng.uniform(-4, 27, (23, 37)), rng.uniform(-4, 41, (23, 37))
    sy[0, 0], sx[5, 5], sy[9, 9], sx[20, 30] = math.nan, math.inf, 1e18, -1e18
    places = spark.createDataFrame([(i, y, x, float(sy[y, x]), float(sx[y, x])) for i in (3, 8) for y in range(23) for x in range(37)], "image_id long, y long, x long, sy double, sx double")
    positions = T.to_tiles(places, shape, ("image_id",), ("sy", "sx"))
    for mode in ("bilinear", "nearest"):
        found = arrays_of(T.to_pixels(T.sample_field(T.to_tiles(rows_of(spark, made), shape), positions, shape, shape, mode=mode), shape), (23, 37))
        for k, a in made.items():
            for y, x in np.ndindex(23, 37):
                p, q = sy[y, x], sx[y, x]
                if mode == "nearest":
                    inside = math.isfinite(p) and math.isfinite(q) and 0 <= round(p) < 23 and 0 <= round(q) < 37
                    want = a[round(p), round(q)] if inside else 0.0
                else:
                    want = sampled(a, p, q)
                assert abs(found[k][y, x] - want) < 1e-9


def test_smoothing_and_levels_of_odd_sizes(spark):
    made, shape = images(), T.Shape(23, 37, 8)
    kernel = T._kernel(5, 1.3)

    def smooth(a, kernel):
        half = len(kernel) // 2
        p = np.pad(a, half)
        return sum(kernel[i] * kernel[j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(len(kernel)) for j in range(len(kernel)))

    tiles = T.to_tiles(rows_of(spark, made), shape)
    found = arrays_of(T.to_pixels(T.gaussian_smooth(tiles, shape, 5, 1.3), shape), (23, 37))
    assert all(np.allclose(found[k], smooth(made[k], kernel)) for k in made)
    want = made
    for tiles, own in T.pyramid(tiles, shape, 4)[1:]:
        before, want = want, {}
        for k, a in before.items():
            full = np.full((2 * own.height, 2 * own.width), np.nan)
            full[: a.shape[0], : a.shape[1]] = smooth(a, T._kernel(3, 1.0))
            want[k] = np.nanmean(full.reshape(own.height, 2, own.width, 2), axis=(1, 3))
        found = arrays_of(T.to_pixels(tiles, own), (own.height, own.width))
        assert all(np.allclose(found[k], want[k]) for k in made)
    assert (own.height, own.width) == (3, 5)


@pytest.mark.parametrize(("mode", "corners"), [("bilinear", False), ("bilinear", True), ("nearest", False)])
def test_resizing(spark, mode, corners):
    made, source, target = images(), T.Shape(23, 37, 8), T.Shape(31, 11, 8)
    found = arrays_of(T.to_pixels(T.resample(T.to_tiles(rows_of(spark, made), source), source, target, mode, corners), target), (31, 11))

    def at(t, n, m):
        if mode == "nearest":
            return math.floor(t * n / m)
        return t * (n - 1) / (m - 1) if corners else min(max((t + 0.5) * n / m - 0.5, 0), n - 1)

    for k, a in made.items():
        assert np.allclose(found[k], [[sampled(a, at(y, 23, 31), at(x, 37, 11)) for x in range(11)] for y in range(31)])


def big_tiles(spark, shape):
    """One 4096 x 4096 image whose pixel (y, x) is 3 y + 5 x, made tile by tile."""
    n = -(-shape.height // shape.size)

    def make(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                y, x, h, w = shape.tile(i // n, i % n)
                data = (3.0 * np.arange(y, y + h)[:, None] + 5.0 * np.arange(x, x + w)[None]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([0]), pa.array([i // n]), pa.array([i % n]), pa.array([data], pa.list_(pa.float64()))], names=["image_id", "channel", "ty", "tx", "data"])

    return spark.range(0, n * n, 1, 8).mapInArrow(make, T.TILE)


def test_a_large_image_is_read_once(spark):
    """A turn by 0.1 radians of 4096 x 4096 pixels reads less than one and a half times the image."""
    shape = T.Shape(4096, 4096)
    c, s = math.cos(0.1), math.sin(0.1)
    matrices = spark.createDataFrame([(0, c, -s, 200.0, s, c, -150.0)], "image_id long, a double, b double, c double, d double, e double, f double")
    areas = []
    needs = T._needs

    def watched(boxes, source):
        areas.append(T.read_area(boxes))
        return needs(boxes, source)

    T._needs = watched
    try:
        warped = T.warp_affine(big_tiles(spark, shape), matrices, shape)
        rows = warped.select("ty", "tx", F.posexplode("data").alias("i", "v")).where("i % 977 = 0").collect()
    finally:
        T._needs = needs
    assert areas[0] < 1.5 * 4096 * 4096
    seen = 0
    for r in rows:
        y, x = 256 * r.ty + r.i // 256, 256 * r.tx + r.i % 256
        sx, sy = c * x - s * y + 200, s * x + c * y - 150
        if 0 <= sx <= 4095 and 0 <= sy <= 4095:  # a plane is its own interpolation
            assert abs(r.v - (3 * sy + 5 * sx)) < 1e-6
            seen += 1
        elif sx < -1 or sy < -1 or sx > 4096 or sy > 4096:
            assert r.v == 0
    assert seen > 10_000


@pytest.mark.parametrize(("kind", "tile"), [("cubic", 256), ("cubic", 8), ("linear", 8)])
def test_bspline_field_by_tiles(spark, kind, tile):
    """Against a sum per pixel, with missing, repeated, NaN and null control points and an image without a known one; no row per
    pixel and neighbour is made."""
    from stratum.operators import raster

    rng = np.random.default_rng(5)
    rows = [(i, ci, cj, *rng.normal(size=2).tolist()) for i in (0, 3) for ci in range(-1, 14) for cj in range(-1, 20) if rng.random() < 0.8]
    rows += [(0, 2, 2, 1.0, -2.0), (0, 3, 3, float("nan"), 5.0), (3, 4, 4, None, 7.0), (7, 900, 900, 1.0, 1.0)]
    control = spark.createDataFrame(rows, "image_id long, ci long, cj long, dx double, dy double")
    made = raster.bspline_field(control, 1.7, 21, 30, kind, tile)
    assert "Generate explode(array" not in made._jdf.queryExecution().toString()
    got = {(r.image_id, r.y, r.x): (r.dx, r.dy) for r in made.collect()}
    assert len(got) == 3 * 21 * 30
    known = {}
    for i, ci, cj, *d in rows:
        old = known.get((i, ci, cj), (0.0, 0.0))
        known[i, ci, cj] = [o + (0.0 if v is None or v != v else v) for o, v in zip(old, d)]
    w = (lambda t: [1 - t, t]) if kind == "linear" else (lambda t: [(1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6])
    first = 0 if kind == "linear" else -1
    for (i, y, x), d in got.items():
        by, bx = math.floor(y / 1.7), math.floor(x / 1.7)
        want = [0.0, 0.0]
        for a, ka in enumerate(w(y / 1.7 - by)):
            for b, kb in enumerate(w(x / 1.7 - bx)):
                want = [s + ka * kb * v for s, v in zip(want, known.get((i, by + a + first, bx + b + first), (0.0, 0.0)))]
        assert np.allclose(d, want, atol=1e-12)


@pytest.mark.parametrize("tile", [256, 10])
def test_ssim_by_tiles(spark, tile):
    """Against the windows of whole images, also across tiles and with missing pixels; pixels are shuffled once, not once per
    product and axis."""
    from stratum.operators import ml

    rng = np.random.default_rng(8)
    h, w, half = 27, 33, 2
    made = {(i, c): rng.uniform(0, 1, (2, h, w)) for i in (0, 4) for c in (0, 1)}
    kept = rng.uniform(size=(h, w)) < 0.9
    rows = [(i, c, y, x, *p[:, y, x].tolist()) for (i, c), p in made.items() for y in range(h) for x in range(w) if i or kept[y, x]]
    met = spark.createDataFrame(rows, "image_id long, channel long, y long, x long, a double, b double")
    found = ml.ssim(met, h, w, 5, 1.5, tile=tile)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    got, kernel = {r.image_id: r.loss for r in found.collect()}, T._kernel(5, 1.5)
    weights = np.outer(kernel, kernel)
    for i in (0, 4):
        values = []
        for c in (0, 1):
            a, b = (p * kept if i == 0 else p for p in made[i, c])
            for y in range(half, h - half):
                for x in range(half, w - half):
                    if i or kept[y, x]:
                        s, t = (p[y - half : y + half + 1, x - half : x + half + 1] for p in (a, b))
                        ma, mb = (weights * s).sum(), (weights * t).sum()
                        va, vb, vab = (weights * s * s).sum() - ma**2, (weights * t * t).sum() - mb**2, (weights * s * t).sum() - ma * mb
                        values.append((2 * ma * mb + 1e-4) * (2 * vab + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4)))
        assert abs(got[i] - (1 - np.mean(values))) < 1e-9
    assert got.keys() == {0, 4}
