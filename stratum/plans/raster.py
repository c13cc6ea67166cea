"""Registered queries of raster, tile and region operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as Q
from ..operators import points as P
from ..operators import raster as X
from ..operators import regions as G
from ..operators import tiles as T
from ..operators import windows as N
from ..session import stored
from ..sources import tables as S
from ..sources.views import Book
from .points import MATRIX
from .spatial import RING

book = Book()
QUERIES, SQL = book.queries, book.sql
R = lambda c, n=5: F.round(c, n).alias(c)
L = lambda c: F.col(c).cast("long").alias(c)
PX = ("image_id", "channel", "y", "x")
ids = lambda df: df.select("grp", F.col("cell_id").alias("id"), "x", "y", "label")

CANVAS = "(SELECT unnest(range(0, {n})) AS {a})"


def grid(n_y: int, n_x: int, y: str = "y", x: str = "x") -> str:
    return f"(SELECT {y}, {x} FROM {CANVAS.format(n=n_y, a=y)}, {CANVAS.format(n=n_x, a=x)})"


@book.query("s11_raster_scan", "SELECT p.image_id AS image_id, c AS channel, y, x, v FROM pixels p, (SELECT unnest(range(0, 3)) AS c) WHERE p.channel = 1")
def _(v):
    return S.gray_to_rgb(v.pixels.where("channel = 1")).select(*PX, "v")


@book.query("s12_raster_sink", "SELECT image_id, channel, CAST(f AS BIGINT) AS level, CAST(floor(y / f) AS BIGINT) AS y, CAST(floor(x / f) AS BIGINT) AS x, round(avg(v), 5) AS v FROM pixels, (SELECT unnest([1, 4, 5, 8]) AS f) WHERE y < floor(32 / f) * f AND x < floor(32 / f) * f GROUP BY 1, 2, 3, 4, 5")
def _(v):
    from ..session import shared_folder

    folder = shared_folder(v.spark)
    S.write_raster(S.downsampled(v.pixels, 32, 32, (1, 4, 5, 8)), folder)
    return S.read_raster(v.spark, folder).select(L("image_id"), "channel", L("level"), "y", "x", R("v"))


@book.query("s13_spatial_dataset_sink")
def _(v):
    from ..session import shared_folder

    return S.write_elements({"cells": v.cells, "pixels": v.pixels}, shared_folder(v.spark)).select("element")


@book.query("r15_layer_stack_select", "SELECT image_id, channel, y, x, v FROM pixels WHERE image_id IN (0, 2) AND y >= 4 AND y < 20 AND x >= 8 AND x < 16")
def _(v):
    return X.layer_stack(v.pixels, [0, 2], (4, 20), (8, 16)).select(*PX, "v")


@book.query("p15_to_gray", "SELECT image_id, y, x, CAST(floor(least(greatest(CASE WHEN image_id % 2 = 0 THEN 3 * (255 - avg(v)) ELSE 5 * max(CASE WHEN channel = 1 THEN v END) END, 0), 255)) AS BIGINT) AS v FROM pixels GROUP BY image_id, y, x")
def _(v):
    return X.to_gray(v.pixels, F.col("image_id") % 2 == 0).select("image_id", "y", "x", L("v"))


@book.query("p16_value_rescale", "WITH e AS (SELECT image_id, channel, min(v) AS lo, max(v) AS hi FROM pixels GROUP BY 1, 2) SELECT p.image_id AS image_id, p.channel AS channel, y, x, round(v / 255, 6) AS unit, round((v / 255 - 0.5) / 0.5, 6) AS signed, CAST(floor((v - lo) / (hi - lo) * 255) AS BIGINT) AS stretched FROM pixels p JOIN e ON p.image_id = e.image_id AND p.channel = e.channel")
def _(v):
    return X.value_rescale(v.pixels).select(*PX, R("unit", 6), R("signed", 6), L("stretched"))


@book.query("r1_patchify", f"WITH q AS (SELECT image_id, channel, g.y AS yy, g.x AS xx, v FROM {grid(35, 35)} g JOIN pixels p ON p.y = least(g.y, 31) AND p.x = least(g.x, 31)) SELECT image_id, channel, CAST(floor(yy / 7) AS BIGINT) AS ty, CAST(floor(xx / 7) AS BIGINT) AS tx, list(v ORDER BY yy, xx) AS data FROM q GROUP BY 1, 2, 3, 4")
def _(v):
    return X.patchify(v.pixels, 7, 32, 32).select("image_id", "channel", L("ty"), L("tx"), "data")


@book.query("r2_crop_or_pad", f"SELECT i.image_id AS image_id, i.channel AS channel, g.y AS y, g.x AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT image_id, channel FROM pixels) i, {grid(40, 36)} g LEFT JOIN pixels p ON p.image_id = i.image_id AND p.channel = i.channel AND p.y = g.y AND p.x = g.x")
def _(v):
    return X.crop_or_pad(v.pixels, 32, 32, 40, 36).select(*PX, "v")


@book.query("r2_crop_or_pad_centred", f"SELECT i.image_id AS image_id, i.channel AS channel, g.y AS y, g.x AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT image_id, channel FROM pixels) i, {grid(41, 36)} g LEFT JOIN pixels p ON p.image_id = i.image_id AND p.channel = i.channel AND p.y = g.y - 4 AND p.x = g.x - 2")
def _(v):
    return X.crop_or_pad(v.pixels, 32, 32, 41, 36, centred=True).select(*PX, "v")


SMOOTH = f"""w1 AS (SELECT unnest([-1, 0, 1]) AS d, unnest([exp(-0.5e0), 1e0, exp(-0.5e0)]) / (1 + 2 * exp(-0.5e0)) AS w),
  smooth AS (SELECT p.image_id AS image_id, p.channel AS channel, g.y AS y, g.x AS x, sum(a.w * b.w * p.v) AS v FROM {grid(32, 32)} g, w1 a, w1 b, pixels p WHERE p.y = g.y + a.d AND p.x = g.x + b.d GROUP BY 1, 2, 3, 4)"""


@book.query("r9_gaussian_smooth", f"WITH {SMOOTH} SELECT image_id, channel, y, x, round(v, 4) AS v FROM smooth")
def _(v):
    shape = T.Shape(32, 32, 16)
    return T.to_pixels(T.gaussian_smooth(stored(T.to_tiles(v.pixels, shape)), shape), shape).select(*PX, R("v", 4))


@book.query(
    "r9_gaussian_smooth_volume",
    """WITH w AS (SELECT unnest([-1, 0, 1]) AS d, unnest([exp(-0.5e0), 1e0, exp(-0.5e0)]) / (1 + 2 * exp(-0.5e0)) AS w), n AS (SELECT max(image_id) AS z1 FROM pixels),
       g AS (SELECT channel, image_id AS z, y, x, v FROM pixels),
       gz AS (SELECT g.channel AS channel, g.z AS z, g.y AS y, g.x AS x, sum(w * p.v) AS v FROM g, n, w, g p WHERE p.channel = g.channel AND p.z = greatest(0, least(z1, g.z + d)) AND p.y = g.y AND p.x = g.x GROUP BY 1, 2, 3, 4),
       gy AS (SELECT g.channel AS channel, g.z AS z, g.y AS y, g.x AS x, sum(w * p.v) AS v FROM gz g, w, gz p WHERE p.channel = g.channel AND p.z = g.z AND p.y = greatest(0, least(31, g.y + d)) AND p.x = g.x GROUP BY 1, 2, 3, 4)
       SELECT g.channel AS channel, g.z AS z, g.y AS y, g.x AS x, round(sum(w * p.v), 4) AS v FROM gy g, w, gy p WHERE p.channel = g.channel AND p.z = g.z AND p.y = g.y AND p.x = greatest(0, least(31, g.x + d)) GROUP BY 1, 2, 3, 4""",
)
def _(v):
    depth = v.pixels.agg(F.max("image_id") + 1).first()[0] or 1
    volume = v.pixels.select(F.col("channel").alias("image_id"), F.col("image_id").alias("z"), "y", "x", "v")
    return X.gaussian_smooth_volume(volume, depth, 32, 32).select(F.col("image_id").alias("channel"), "z", "y", "x", R("v", 4))


@book.query("r3_pyramid", f"WITH {SMOOTH} SELECT image_id, channel, CAST(floor(y / 2) AS BIGINT) AS y, CAST(floor(x / 2) AS BIGINT) AS x, round(avg(v), 4) AS v FROM smooth GROUP BY 1, 2, 3, 4")
def _(v):
    return X.pyramid(v.pixels, 2, 32, 32, tile=16).where("level = 1").select(*PX, R("v", 4))


def sampled(places: str, border: bool = False) -> str:
    """SQL of bilinear sampling at (sy, sx) of places (image_id, channel, ty, tx, sy, sx)."""
    y, x = ("greatest(0, least(31, floor(sy) + a))", "greatest(0, least(31, floor(sx) + b))") if border else ("floor(sy) + a", "floor(sx) + b")
    return f"""places AS ({places}), four AS (SELECT *, {y} AS yy, {x} AS xx, (CASE a WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE b WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
        FROM places, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)),
        got AS (SELECT f.image_id AS image_id, f.channel AS channel, ty AS y, tx AS x, round(coalesce(sum(w * p.v), 0), 4) AS v FROM four f LEFT JOIN pixels p ON p.image_id = f.image_id AND p.channel = f.channel AND p.y = yy AND p.x = xx GROUP BY 1, 2, 3, 4)"""


ALL = f"(SELECT DISTINCT image_id, channel FROM pixels) i, {grid(32, 32, 'ty', 'tx')} g"


@book.query("r4_resample", f"WITH {sampled('SELECT image_id, channel, ty, tx, least(greatest((ty + 0.5e0) * (32 / 20e0) - 0.5e0, 0), 31) AS sy, least(greatest((tx + 0.5e0) * (32 / 24e0) - 0.5e0, 0), 31) AS sx FROM (SELECT DISTINCT image_id, channel FROM pixels) i, ' + grid(20, 24, 'ty', 'tx') + ' g')} SELECT image_id, channel, y, x, v FROM got")
def _(v):
    return X.resample(v.pixels, 32, 32, 20, 24, tile=16).select(*PX, R("v", 4))


@book.query("r5_warp_affine", f"WITH {sampled('SELECT image_id, channel, ty, tx, 0.9e0 * tx - 0.2e0 * ty + 3.3e0 AS sx, 0.2e0 * tx + 0.9e0 * ty - 1.7e0 AS sy FROM ' + ALL)} SELECT image_id, channel, y, x, v FROM got")
def _(v):
    m = v.pixels.select("image_id").distinct().withColumns({k: F.lit(x) for k, x in zip("abcdef", (0.9, -0.2, 3.3, 0.2, 0.9, -1.7))})
    return X.warp_affine(v.pixels, m, 32, 32, tile=16).select(*PX, R("v", 4))


CHAIN_PLACES = f"""SELECT i.image_id AS image_id, channel, ty, tx, (e * (tx - c) - b * (ty - f)) / (a * e - b * d) - 4 AS sx, (a * (ty - f) - d * (tx - c)) / (a * e - b * d) - 4 AS sy
    FROM (SELECT DISTINCT image_id, channel FROM pixels) i JOIN full_m m ON m.layer = i.image_id % 5 AND m.grp = CAST(floor(i.image_id / 5) AS BIGINT) % 5, {grid(40, 40, 'ty', 'tx')} g"""


@book.query(
    "r5_warp_chain",
    f"""WITH {MATRIX.lstrip().removeprefix(",")}, px AS (SELECT grp, layer, step, a, b, (c - a - b + 1) * 20 AS c, d, e, (f - d - e + 1) * 20 AS f FROM mat),
        m0 AS (SELECT * FROM px WHERE step = 0), m1 AS (SELECT * FROM px WHERE step = 1),
        full_m AS (SELECT m0.grp AS grp, m0.layer AS layer, m1.a * m0.a + m1.b * m0.d AS a, m1.a * m0.b + m1.b * m0.e AS b, m1.a * m0.c + m1.b * m0.f + m1.c AS c,
          m1.d * m0.a + m1.e * m0.d AS d, m1.d * m0.b + m1.e * m0.e AS e, m1.d * m0.c + m1.e * m0.f + m1.f AS f FROM m0 JOIN m1 ON m0.grp = m1.grp AND m0.layer = m1.layer),
        {sampled(CHAIN_PLACES)} SELECT image_id, channel, y, x, v FROM got""",
)
def _(v):
    slide = {"layer": F.col("image_id") % 5, "grp": F.floor(F.col("image_id") / 5) % 5}
    images = v.pixels.select("image_id").distinct().withColumns({"height": F.lit(32), "width": F.lit(32)} | slide)
    steps = v.transforms.join(images.select("image_id", "grp", "layer"), ["grp", "layer"])
    return X.warp_chain(v.pixels, P.pad_plan(images, "grp", 40), steps, 32, 32, (40, 40), tile=16).select(*PX, R("v", 4))


@book.query("r7_grid_sample_blocks", f"WITH {sampled('SELECT c.image_id AS image_id, channel, i AS ty, j AS tx, (gx + 1) / 2 * 31 AS sx, (gy + 1) / 2 * 31 AS sy FROM field f JOIN (SELECT DISTINCT image_id, channel FROM pixels) c ON f.image_id = c.image_id')} SELECT image_id, channel, y, x, v FROM got")
def _(v):
    return X.grid_sample(v.pixels, v.field, 32, 32, align_corners=True, tile=16).select(*PX, R("v", 4))


@book.query("r6_warp_displacement", f"WITH {sampled('SELECT c.image_id AS image_id, channel, i AS ty, j AS tx, (((2 * j + 1) / 32e0 - 1 + gx + 1) * 32 - 1) / 2 AS sx, (((2 * i + 1) / 32e0 - 1 + gy + 1) * 32 - 1) / 2 AS sy FROM field f JOIN (SELECT DISTINCT image_id, channel FROM pixels) c ON f.image_id = c.image_id', True)} SELECT image_id, channel, y, x, v FROM got")
def _(v):
    return X.warp_displacement(v.pixels, v.field, 32, 32, border=True, tile=16).select(*PX, R("v", 4))


@book.query("r6_warp_displacement_nearest", "WITH s AS (SELECT c.image_id AS image_id, channel, i, j, round_even((((2 * j + 1) / 32e0 - 1 + gx + 1) * 32 - 1) / 2, 0) AS sx, round_even((((2 * i + 1) / 32e0 - 1 + gy + 1) * 32 - 1) / 2, 0) AS sy FROM field f JOIN (SELECT DISTINCT image_id, channel FROM pixels) c ON f.image_id = c.image_id) SELECT s.image_id AS image_id, s.channel AS channel, i AS y, j AS x, coalesce(p.v, 0) AS v FROM s LEFT JOIN pixels p ON p.image_id = s.image_id AND p.channel = s.channel AND p.y = s.sy AND p.x = s.sx")
def _(v):
    return X.warp_displacement(v.pixels, v.field, 32, 32, mode="nearest", tile=16).select(*PX, "v")


@book.query("r8_grid_disp_convert", "SELECT image_id, i, j, round(gx - ((2 * j + 1) / 32e0 - 1), 6) AS gx, round(gy - ((2 * i + 1) / 32e0 - 1), 6) AS gy FROM field")
def _(v):
    return X.grid_to_displacement(v.field, 32, 32).select("image_id", "i", "j", R("gx", 6), R("gy", 6))


@book.query(
    "r10_morphology",
    f"""WITH d AS (SELECT g.y AS y, g.x AS x, image_id, max(v) AS v FROM {grid(32, 32)} g JOIN masks m ON abs(m.y - g.y) <= 1 AND abs(m.x - g.x) <= 1 GROUP BY 1, 2, 3)
        SELECT a.image_id AS image_id, a.y AS y, a.x AS x, CAST(min(b.v) AS BIGINT) AS v FROM d a JOIN d b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3""",
)
def _(v):
    return X.morphology(v.masks, 3, "close").select("image_id", "y", "x", L("v"))


@book.query(
    "r11_bspline_field",
    f"""WITH ctl AS (SELECT image_id, i AS ci, j AS cj, gx AS dx, gy AS dy FROM field),
        p AS (SELECT image_id, y, x, floor(y / 1.25e0) AS b_y, floor(x / 1.25e0) AS b_x, y / 1.25e0 - floor(y / 1.25e0) AS u, x / 1.25e0 - floor(x / 1.25e0) AS w FROM (SELECT DISTINCT image_id FROM ctl) i, {grid(32, 32)} g),
        n AS (SELECT image_id, y, x, b_y + a - 1 AS ci, b_x + b - 1 AS cj,
          (CASE a WHEN 0 THEN power(1 - u, 3) / 6 WHEN 1 THEN (3 * power(u, 3) - 6 * power(u, 2) + 4) / 6 WHEN 2 THEN (-3 * power(u, 3) + 3 * power(u, 2) + 3 * u + 1) / 6 ELSE power(u, 3) / 6 END) *
          (CASE b WHEN 0 THEN power(1 - w, 3) / 6 WHEN 1 THEN (3 * power(w, 3) - 6 * power(w, 2) + 4) / 6 WHEN 2 THEN (-3 * power(w, 3) + 3 * power(w, 2) + 3 * w + 1) / 6 ELSE power(w, 3) / 6 END) AS k
          FROM p, {CANVAS.format(n=4, a='a')}, {CANVAS.format(n=4, a='b')})
        SELECT n.image_id AS image_id, y, x, round(coalesce(sum(k * dx), 0), 9) AS dx, round(coalesce(sum(k * dy), 0), 9) AS dy FROM n LEFT JOIN ctl c ON n.image_id = c.image_id AND n.ci = c.ci AND n.cj = c.cj GROUP BY 1, 2, 3""",
)
def _(v):
    return X.bspline_field(control_points(v), 1.25, 32, 32).select("image_id", "y", "x", R("dx", 9), R("dy", 9))


def control_points(v):
    return v.field.select("image_id", F.col("i").alias("ci"), F.col("j").alias("cj"), F.col("gx").alias("dx"), F.col("gy").alias("dy"))


@book.query(
    "r11_bspline_field_linear",
    f"""WITH p AS (SELECT image_id, y, x, floor(y / 1.25e0) AS b_y, floor(x / 1.25e0) AS b_x, y / 1.25e0 - floor(y / 1.25e0) AS u, x / 1.25e0 - floor(x / 1.25e0) AS w FROM (SELECT DISTINCT image_id FROM field) i, {grid(32, 32)} g),
        n AS (SELECT image_id, y, x, b_y + a AS ci, b_x + b AS cj, (CASE a WHEN 0 THEN 1 - u ELSE u END) * (CASE b WHEN 0 THEN 1 - w ELSE w END) AS k FROM p, {CANVAS.format(n=2, a='a')}, {CANVAS.format(n=2, a='b')})
        SELECT n.image_id AS image_id, y, x, round(coalesce(sum(k * gx), 0), 9) AS dx, round(coalesce(sum(k * gy), 0), 9) AS dy FROM n LEFT JOIN field c ON n.image_id = c.image_id AND n.ci = c.i AND n.cj = c.j GROUP BY 1, 2, 3""",
)
def _(v):
    return X.bspline_field(control_points(v), 1.25, 32, 32, "linear").select("image_id", "y", "x", R("dx", 9), R("dy", 9))


@book.query("r13_embedding_to_pixels", f"SELECT e.image_id AS image_id, g.y AS y, g.x AS x, round(CAST(features[1] AS DOUBLE), 5) AS f0 FROM {grid(16, 16)} g JOIN blocks16 e ON e.y = floor(g.y / 4) AND e.x = floor(g.x / 4)")
def _(v):
    cells = v.blocks16.withColumnsRenamed({"y": "ty", "x": "tx"})
    return X.embedding_to_pixels(cells, 4, 16, 16).select("image_id", "y", "x", F.round(F.col("features")[0].cast("double"), 5).alias("f0"))


@book.query(
    "r14_descriptor_sample",
    """WITH c AS (SELECT * FROM blocks16), p AS (SELECT CAST(c_custkey % (SELECT max(image_id) + 1 FROM blocks16) AS BIGINT) AS image_id, c_custkey AS id, (c_custkey % 24) + 4.3e0 AS x, (c_custkey % 23) + 4.6e0 AS y FROM customer),
       s AS (SELECT image_id, id, (x - 3.5e0) / 8 AS sx, (y - 3.5e0) / 8 AS sy FROM p), f AS (SELECT *, floor(sy) + a AS yy, floor(sx) + b AS xx, (CASE a WHEN 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE b WHEN 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w FROM s, (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b)),
       v AS (SELECT f.image_id, f.id, k, sum(w * CAST(features[k] AS DOUBLE)) AS v FROM f JOIN c ON f.image_id = c.image_id AND f.yy = c.y AND f.xx = c.x, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2, 3)
       SELECT image_id, id, round(max(CASE WHEN k = 1 THEN v END) / sqrt(sum(v * v)), 5) AS f0 FROM v GROUP BY 1, 2""",
)
def _(v):
    cells = v.blocks16
    images = cells.agg((F.max("image_id") + 1).alias("n"))  # one row
    at = v.customer.join(F.broadcast(images)).select((F.col("c_custkey") % F.col("n")).alias("image_id"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 24 + 4.3).alias("x"), (F.col("c_custkey") % 23 + 4.6).alias("y"))
    return X.descriptor_sample(at, cells, 8).select("image_id", "id", F.round(F.col("features")[0], 5).alias("f0"))


@book.query(
    "a20_channel_percentile_scale",
    """WITH s AS (SELECT image_id, channel, quantile_cont(CASE WHEN v > 0 THEN v END, 0.9) AS p, avg(v) AS m FROM pixels GROUP BY 1, 2),
       t AS (SELECT q.*, floor(least(greatest(255 * v / p, 0), 255)) AS w, m FROM pixels q JOIN s ON q.image_id = s.image_id AND q.channel = s.channel), g AS (SELECT image_id, channel, avg(w - m) AS gain FROM t GROUP BY 1, 2)
       SELECT t.image_id AS image_id, t.channel AS channel, y, x, CASE WHEN gain >= 12 THEN v ELSE w END AS v FROM t JOIN g ON t.image_id = g.image_id AND t.channel = g.channel""",
)
def _(v):
    return X.percentile_scale(v.pixels, 0.9, 12).select(*PX, "v")


@book.query("a22_spectral_unmix_apply", "SELECT a.image_id AS image_id, a.channel AS channel, a.y AS y, a.x AS x, CAST(floor(greatest(0, a.v - greatest(0, b.v - 20e0) * 0.375e0)) AS BIGINT) AS v FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND a.y = b.y AND a.x = b.x WHERE a.channel = 0 AND b.channel = 1")
def _(v):
    c = v.region.limit(1).select(F.lit(0).cast("long").alias("channel"), F.lit(0.375).alias("alpha"), F.lit(20.0).alias("background"))
    return X.unmix(v.pixels, c, 1).select(*PX, L("v"))


@book.query("a21_colinear_removal")
def _(v):
    return X.colinear_removal(v.pixels.withColumn("v", F.when(F.col("channel") == 0, F.col("v") / 2 + F.col("x") * 4).otherwise(F.col("x") * 8.0)), 1).select(*PX, R("v", 3))


@book.query(
    "a23_background_cosine_mask",
    """WITH e AS (SELECT * FROM blocks100),
       u AS (SELECT image_id, y, x, k, CAST(features[k] AS DOUBLE) AS f FROM e, (SELECT unnest(range(1, 65)) AS k)),
       m AS (SELECT image_id, k, avg(f) AS bg FROM u WHERE y BETWEEN 1 AND 8 AND x BETWEEN 1 AND 8 AND (y IN (1, 2, 7, 8) OR x IN (1, 2, 7, 8)) GROUP BY 1, 2),
       c AS (SELECT u.image_id, y, x, sum(f * bg) / sqrt(sum(f * f) * sum(bg * bg)) AS cosine FROM u JOIN m ON u.image_id = m.image_id AND u.k = m.k GROUP BY 1, 2, 3)
       SELECT image_id, CAST(y AS BIGINT) AS y, x, round(cosine, 5) AS cosine, CAST(cosine > 0.15 OR y < 1 OR y >= 9 OR x < 1 OR x >= 9 AS BIGINT) AS v FROM c""",
)
def _(v):
    return G.background_mask(v.blocks100, 10, 10, 1, 2, 0.15).select("image_id", "y", "x", R("cosine"), L("v"))


def strongest(name: str, source: str, axis: str) -> str:
    """SQL: the strongest run of means along an axis of each image of a table, as table name (image_id, s, e)."""
    return f"""{name}p AS (SELECT image_id, {axis} AS idx, avg(v) AS v FROM {source} GROUP BY 1, 2),
       {name}f AS (SELECT *, v > 0.6 AS up, idx - row_number() OVER (PARTITION BY image_id, v > 0.6 ORDER BY idx) AS island FROM {name}p),
       {name}g AS (SELECT image_id, min(idx) AS s, max(idx) AS e, round(avg(v), 9) AS m FROM {name}f WHERE up GROUP BY image_id, island HAVING count(*) >= 2),
       {name}b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY m DESC, s) AS k FROM {name}g),
       {name} AS (SELECT a.image_id AS image_id, coalesce(b.s, a.s) AS s, coalesce(b.e, a.e) AS e FROM (SELECT image_id, min(idx) AS s, max(idx) AS e FROM {name}p GROUP BY image_id) a LEFT JOIN {name}b b ON a.image_id = b.image_id AND b.k = 1)"""


@book.query(
    "a24_crop_margins",
    f"""WITH {strongest("ya", "masks", "y")}, {strongest("xa", "masks", "x")},
       cut AS (SELECT m.image_id AS image_id, m.y AS y, m.x AS x, m.v AS v FROM masks m JOIN ya ON m.image_id = ya.image_id JOIN xa ON m.image_id = xa.image_id WHERE m.y BETWEEN ya.s AND ya.e AND m.x BETWEEN xa.s AND xa.e),
       {strongest("yb", "cut", "y")}, {strongest("xb", "cut", "x")}
       SELECT yb.image_id AS image_id, yb.s AS y0, yb.e AS y1, xb.s AS x0, xb.e AS x1, round(greatest(0, yb.s / 32e0 - 0.1e0), 6) AS top, round(greatest(0, xb.s / 32e0 - 0.1e0), 6) AS left_side, round(least(1, (yb.e + 1) / 32e0 + 0.1e0), 6) AS bottom, round(least(1, (xb.e + 1) / 32e0 + 0.1e0), 6) AS right_side FROM yb JOIN xb ON yb.image_id = xb.image_id""",
)
def _(v):
    found = X.crop_margins(v.masks, 0.6, 2, 32, 32)
    return found.select("image_id", L("y0"), L("y1"), L("x0"), L("x1"), R("top", 6), F.round("left", 6).alias("left_side"), R("bottom", 6), F.round("right", 6).alias("right_side"))


@book.query("a23_keep_largest_foreground", None)
def _(v):
    mask = G.keep_largest_foreground(G.background_mask(v.blocks100, 10, 10, 1, 2, 0.15))
    return G.apply_background(v.blocks100, mask).select("image_id", "y", "x", F.round(F.col("features")[0].cast("double"), 5).alias("f0"))


MET = "met AS (SELECT a.image_id AS image_id, a.channel AS channel, a.y AS y, a.x AS x, a.v AS a, b.v AS b FROM pixels a JOIN pixels b ON b.image_id = a.image_id + 1 AND a.channel = b.channel AND a.y = b.y AND a.x = b.x)"


@book.query(
    "a25_image_similarity",
    f"WITH {MET} SELECT image_id, round(-covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS ncc_loss, round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine_loss, round(1 - (2 * sum(a * b / 65025) + 1) / (sum(a / 255) + sum(b / 255) + 1), 6) AS dice_loss, round(avg(abs(a - b)), 5) AS l1, round(avg(power(a - b, 2)), 4) AS l2 FROM met GROUP BY image_id",
)
def _(v):
    return Q.image_similarity(Q.image_pairs(v.pixels)).select("image_id", R("ncc_loss", 6), R("cosine_loss", 6), R("dice_loss", 6), R("l1"), R("l2", 4))


@book.query(
    "a26_ncc_local",
    f"""WITH {MET}, s AS (SELECT g.y AS y, g.x AS x, image_id, channel, sum(a) AS sa, sum(b) AS sb, sum(a * a) AS saa, sum(b * b) AS sbb, sum(a * b) AS sab FROM {grid(32, 32)} g JOIN met m ON abs(m.y - g.y) <= 2 AND abs(m.x - g.x) <= 2 GROUP BY 1, 2, 3, 4)
        SELECT image_id, round(-avg(power(sab - sa * sb / 25, 2) / ((saa - sa * sa / 25) * (sbb - sb * sb / 25) + 1e-5)), 5) AS loss FROM s GROUP BY image_id""",
)
def _(v):
    return X.ncc_local(Q.image_pairs(v.pixels), 5).select("image_id", R("loss"))


@book.query(
    "a27_field_smoothness",
    """WITH d AS (SELECT image_id, lead(gx) OVER a - gx AS igx, lead(gy) OVER a - gy AS igy, lead(gx) OVER b - gx AS jgx, lead(gy) OVER b - gy AS jgy FROM field WINDOW a AS (PARTITION BY image_id, j ORDER BY i), b AS (PARTITION BY image_id, i ORDER BY j))
       SELECT image_id, round((avg(power(igx * 32, 2)) + avg(power(igy * 32, 2)) + avg(power(jgx * 32, 2)) + avg(power(jgy * 32, 2))) / 4, 4) AS diffusion, round((stddev_samp(igx) + stddev_samp(igy) + stddev_samp(jgx) + stddev_samp(jgy)) / 4, 6) AS gradient_loss FROM d GROUP BY image_id""",
)
def _(v):
    return Q.field_smoothness(v.field, 32).select("image_id", R("diffusion", 4), R("gradient_loss", 6))


@book.query("a34_zscore_columns", "WITH s AS (SELECT image_id, channel, avg(v) AS m, stddev_pop(v) AS sd FROM pixels GROUP BY 1, 2) SELECT p.image_id AS image_id, p.channel AS channel, y, x, CAST(floor(round(least(greatest((v - s.m) / s.sd * r.sd + r.m, 0), 255), 6)) AS BIGINT) AS v FROM pixels p JOIN s ON p.image_id = s.image_id AND p.channel = s.channel JOIN s r ON r.channel = p.channel AND r.image_id = 0 WHERE p.image_id > 0")
def _(v):
    return X.zscore(v.pixels, 0).where("image_id > 0").select(*PX, L("v"))


@book.query(
    "a35_tile_plan",
    """WITH b AS (SELECT grp, layer, floor(min(x)) AS ax, floor(max(x)) AS bx, floor(min(y)) AS ay, floor(max(y)) AS b_y FROM points GROUP BY 1, 2),
       t AS (SELECT p.grp AS grp, p.layer AS layer, ax + floor((x - ax) / 400) * 400 AS x0, ay + floor((y - ay) / 400) * 400 AS y0, bx, b_y FROM points p JOIN b ON p.grp = b.grp AND p.layer = b.layer),
       n AS (SELECT grp, layer, x0, y0, count(*) AS n FROM t WHERE x0 < bx AND y0 < b_y GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8)
       SELECT grp, layer, n, CAST(least(greatest(x0, 0), 1600) AS BIGINT) AS x0, CAST(least(greatest(y0, 0), 1600) AS BIGINT) AS y0, CAST(least(greatest(x0 + 400, 0), 1600) AS BIGINT) AS x1, CAST(least(greatest(y0 + 400, 0), 1600) AS BIGINT) AS y1,
       CAST(least(greatest(x0 - 20, 0), 1600) AS BIGINT) AS ex0, CAST(least(greatest(y0 - 20, 0), 1600) AS BIGINT) AS ey0, CAST(least(greatest(x0 + 420, 0), 1600) AS BIGINT) AS ex1, CAST(least(greatest(y0 + 420, 0), 1600) AS BIGINT) AS ey1 FROM n""",
)
def _(v):
    return G.tile_plan(v.points, 400, 0.1, 8, 1600).select("grp", "layer", *[L(c) for c in ("n", "x0", "y0", "x1", "y1", "ex0", "ey0", "ex1", "ey1")])


@book.query(
    "a36_overlap_average",
    f"""WITH t AS (SELECT image_id, (x % 2) * 12 + y AS y, (y % 2) * 12 + x AS x, v * 32 AS dx, (255 - v) * 32 AS dy FROM pixels WHERE channel = 0),
        m AS (SELECT image_id, y, x, avg(dx) / 48 AS dx, avg(dy) / 48 AS dy, count(*) AS n FROM t GROUP BY 1, 2, 3)
        SELECT i.image_id AS image_id, g.y AS y, g.x AS x, round(coalesce(dx, 0), 5) AS dx, round(coalesce(dy, 0), 5) AS dy, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id FROM t) i, {grid(48, 48)} g LEFT JOIN m ON m.image_id = i.image_id AND m.y = g.y AND m.x = g.x""",
)
def _(v):
    tiles = v.pixels.where("channel = 0").select("image_id", ((F.col("x") % 2) * 12).alias("y0"), ((F.col("y") % 2) * 12).alias("x0"), "y", "x", F.lit(32).alias("size"), F.col("v").alias("dx"), (255 - F.col("v")).alias("dy"))
    return X.overlap_average(tiles, 48, 48).select("image_id", "y", "x", R("dx"), R("dy"), "n")


@book.query("a37_multi_lag_loss", "WITH l AS (SELECT a.image_id AS i, b.image_id - a.image_id AS lag, avg(abs(a.v - b.v)) AS l1 FROM pixels a JOIN pixels b ON b.image_id BETWEEN a.image_id + 1 AND a.image_id + 3 AND a.channel = b.channel AND a.y = b.y AND a.x = b.x GROUP BY 1, 2) SELECT round(sum(l1) / (SELECT count(DISTINCT image_id) FROM pixels), 4) AS loss FROM l")
def _(v):
    return Q.multi_lag_loss(v.pixels, 3).select(R("loss", 4))


@book.query("a46_border_background", "SELECT image_id, channel, round((avg(CASE WHEN y = 0 THEN v END) + avg(CASE WHEN y = 31 THEN v END) + avg(CASE WHEN x = 0 THEN v END) + avg(CASE WHEN x = 31 THEN v END)) / 4, 5) AS background FROM pixels GROUP BY 1, 2")
def _(v):
    return X.border_background(v.pixels, 32, 32).select("image_id", "channel", R("background"))


@book.query("a43_coords_pivot", f"SELECT x, {', '.join(f'avg(CASE WHEN y = {y} THEN v END) AS y{y}' for y in range(32))} FROM pixels WHERE channel = 0 GROUP BY x")
def _(v):
    return X.coords_pivot(v.pixels.where("channel = 0"), list(range(32)))


@book.query("a15_label_mean_features", "SELECT p.image_id AS image_id, CAST(floor(p.v / 64) AS BIGINT) AS label, round(avg(q.v), 5) AS f1 FROM pixels p JOIN pixels q ON p.image_id = q.image_id AND p.y = q.y AND p.x = q.x AND q.channel = 1 WHERE p.channel = 0 AND floor(p.v / 64) > 0 GROUP BY 1, 2")
def _(v):
    labels = v.pixels.where("channel = 0").select("image_id", "y", "x", F.floor(F.col("v") / 64).alias("label"))
    return G.label_mean_features(v.pixels, labels).select("image_id", "label", F.round("1", 5).alias("f1"))


COMPONENTS = """cells_on AS (SELECT image_id, y, x, image_id * 1024 + y * 32 + x AS node FROM masks WHERE v = 1),
        e AS (SELECT a.node AS a, b.node AS b FROM cells_on a, (SELECT unnest([0, 0, 1, -1]) AS dy, unnest([1, -1, 0, 0]) AS dx) s, cells_on b WHERE a.image_id = b.image_id AND b.y = a.y + dy AND b.x = a.x + dx),
        r(node, m) USING KEY (node) AS (SELECT node, node FROM cells_on UNION SELECT e.b, min(r.m) FROM r JOIN e ON r.node = e.a JOIN recurring.r o ON o.node = e.b WHERE r.m < o.m GROUP BY e.b)"""


@book.query(
    "a28_connected_components",
    f"WITH RECURSIVE {COMPONENTS} SELECT image_id, y, x, CAST(floor((m % 1024) / 32) AS BIGINT) AS cy, m % 32 AS cx FROM cells_on c JOIN r ON r.node = c.node",
)
def _(v):
    found = G.raster_components(v.masks, width=1024)
    return found.select("image_id", "y", "x", F.floor(F.col("comp") % (1024 * 1024) / 1024).alias("cy"), (F.col("comp") % 1024).alias("cx"))


@book.query(
    "a29_component_filter",
    f"WITH RECURSIVE {COMPONENTS}, n AS (SELECT m FROM r GROUP BY m HAVING count(*) >= 4) SELECT image_id, y, x FROM cells_on c JOIN r ON r.node = c.node WHERE m IN (SELECT m FROM n)",
)
def _(v):
    return G.component_filter(G.raster_components(v.masks, width=1024), 4).select("image_id", "y", "x")


@book.query("r10_inner_holes")
def _(v):
    return G.inner_holes(v.masks, 32, 32).select("image_id", "y", "x")


@book.query("a14_density_boxes")
def _(v):
    return G.density_boxes(v.cells, 12).select("grp", L("x0"), L("y0"), L("x1"), L("y1"), "score")


@book.query("a30_label_regions")
def _(v):
    return G.label_regions(ids(v.cells), 3, 10.0, 20, 100).select("grp", "label", "area", "x0", "y0", "x1", "y1")


@book.query(
    "k11_rasterize_shapes",
    "SELECT grp, CAST(floor(y / 10) + dy AS BIGINT) AS y, CAST(floor(x / 10) + dx AS BIGINT) AS x, max_by(label, cell_id) AS label FROM cells, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE dx * dx + dy * dy <= 4 AND floor(y / 10) + dy BETWEEN 0 AND 99 AND floor(x / 10) + dx BETWEEN 0 AND 99 GROUP BY 1, 2, 3",
)
def _(v):
    return G.rasterize_points(ids(v.cells).withColumns({"x": F.col("x") / 10, "y": F.col("y") / 10}), 2, 100, 100).select("grp", "y", "x", "label")


@book.query(
    "k11_rasterize_polygons",
    f"""WITH {RING},
       discs AS (SELECT grp, CAST(floor(y / 10) + dy AS BIGINT) AS y, CAST(floor(x / 10) + dx AS BIGINT) AS x, cell_id % 200 AS o, label FROM cells, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy) WHERE dx * dx + dy * dy <= 4),
       hit AS (SELECT s.grp AS grp, g.y AS y, g.x AS x, shape_id % 200 AS o, 'shape ' || shape_id AS label FROM {grid(100, 100)} g, sides s GROUP BY s.grp, g.y, g.x, shape_id
               HAVING count(*) FILTER (WHERE (s.y0 / 10 > g.y + 0.5e0) <> (s.y1 / 10 > g.y + 0.5e0) AND g.x + 0.5e0 < (s.x1 / 10 - s.x0 / 10) * (g.y + 0.5e0 - s.y0 / 10) / (s.y1 / 10 - s.y0 / 10) + s.x0 / 10) % 2 = 1)
       SELECT grp, y, x, max_by(label, (o, label)) AS label FROM (SELECT * FROM discs UNION ALL SELECT * FROM hit) WHERE y BETWEEN 0 AND 99 AND x BETWEEN 0 AND 99 GROUP BY 1, 2, 3""",
)
def _(v):
    from ..operators.spatial import with_ring

    points = v.cells.select("grp", (F.col("cell_id") % 200).alias("order"), (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), "label")
    ring = F.transform("ring", lambda p: F.struct((p["x"] / 10).alias("x"), (p["y"] / 10).alias("y")))
    polygons = with_ring(v.shapes).select("grp", (F.col("shape_id") % 200).alias("order"), ring.alias("ring"), F.concat(F.lit("shape "), F.col("shape_id").cast("string")).alias("label"))
    return G.rasterize_shapes(points, polygons, 2, 100, 100).select("grp", "y", "x", "label")


@book.query(
    "k10_region_signal",
    f"""WITH {RING},
       ar AS (SELECT grp, shape_id, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM sides GROUP BY 1, 2),
       hit AS (SELECT c.grp AS grp, c.y AS y, c.x AS x, s.shape_id AS shape_id FROM (SELECT DISTINCT image_id AS grp, y, x, (x + 0.5e0) * 10 AS px, (y + 0.5e0) * 10 AS py FROM pixels WHERE image_id < 3) c JOIN sides s ON c.grp = s.grp
               GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (WHERE (s.y0 > py) <> (s.y1 > py) AND px < (s.x1 - s.x0) * (py - s.y0) / (s.y1 - s.y0) + s.x0) % 2 = 1),
       m AS (SELECT h.grp AS grp, shape_id, channel, avg(v) AS mean FROM hit h JOIN pixels p ON p.image_id = h.grp AND p.y = h.y AND p.x = h.x GROUP BY 1, 2, 3),
       told AS (SELECT s.grp AS grp, s.shape_id AS shape_id, area, channel, mean, CASE WHEN mean IS NULL THEN CASE WHEN cx - rx >= 320 OR cy - ry >= 320 OR cx + rx <= 0 OR cy + ry <= 0 THEN 'outside' WHEN area / 100 < 8 THEN 'small' ELSE 'empty' END END AS reason
                FROM shapes s JOIN ar ON s.grp = ar.grp AND s.shape_id = ar.shape_id LEFT JOIN m ON m.grp = s.grp AND m.shape_id = s.shape_id AND area / 100 >= 8)
       SELECT t.grp AS grp, shape_id, channel, round(mean, 4) AS mean, reason, round(CASE WHEN o = 0 THEN area END, 4) AS area FROM told t JOIN (SELECT grp, count(reason) AS o FROM told GROUP BY grp) w ON t.grp = w.grp""",
)
def _(v):
    from ..operators.spatial import with_ring

    images = v.pixels.withColumnRenamed("image_id", "grp")
    return G.region_signal(images, with_ring(v.shapes), 10.0, 32, 32, least_area=8.0).select("grp", "shape_id", "channel", R("mean", 4), "reason", R("area", 4))


def pooled(value: str, out: str, source: str) -> str:
    """SQL: the largest value in 5 x 5 windows, as column out of tables out and out + 1."""
    along = lambda a, b: f"OVER (PARTITION BY image_id, {a} ORDER BY {b} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
    return f"{out}1 AS (SELECT *, max({value}) {along('y', 'x')} AS p_{out} FROM {source}), {out} AS (SELECT *, max(p_{out}) {along('x', 'y')} AS {out} FROM {out}1)"


@book.query(
    "w8_keypoint_nms",
    f"""WITH s AS (SELECT image_id, y, x, v FROM pixels WHERE channel = 0), {pooled("v", "ma", "s")}, a AS (SELECT *, CASE WHEN v = ma THEN 1 ELSE 0 END AS top_a FROM ma),
       {pooled("top_a", "near_b", "a")}, b0 AS (SELECT *, CASE WHEN near_b > 0 THEN 0 ELSE v END AS rest_b FROM near_b), {pooled("rest_b", "mb", "b0")}, b AS (SELECT *, CASE WHEN top_a = 1 OR (rest_b = mb AND near_b = 0) THEN 1 ELSE 0 END AS top_b FROM mb),
       {pooled("top_b", "near_c", "b")}, c0 AS (SELECT *, CASE WHEN near_c > 0 THEN 0 ELSE v END AS rest_c FROM near_c), {pooled("rest_c", "mc", "c0")}, c AS (SELECT *, CASE WHEN top_b = 1 OR (rest_c = mc AND near_c = 0) THEN 1 ELSE 0 END AS top_c FROM mc)
       SELECT image_id, y, x, v AS nms FROM c WHERE top_c = 1 AND v > 0""",
)
def _(v):
    return N.keypoint_nms(v.pixels.where("channel = 0").select("image_id", "y", "x", "v"), 2).where("nms > 0").select("image_id", "y", "x", "nms")
