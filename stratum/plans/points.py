"""Registered queries of the point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import points as P
from ..sources.views import Book

book = Book()
QUERIES, SQL = book.queries, book.sql
R = lambda c, n=5: F.round(c, n).alias(c)

PLAN = """
  plan0 AS (SELECT grp, layer, height, width, max(height) OVER (PARTITION BY grp) AS th, max(width) OVER (PARTITION BY grp) AS tw FROM slides),
  plan AS (SELECT grp, layer, height, width, th, tw, 1.0 AS ratio, floor((tw - width) / 2.0) AS pl, floor((th - height) / 2.0) AS pu,
           tw - width - floor((tw - width) / 2.0) AS pr, th - height - floor((th - height) / 2.0) AS pd FROM plan0)"""
MATRIX = """
  mat AS (SELECT grp, layer, step, fx * cos(theta) * exp(-sx) AS a, -fx * sin(theta) * exp(-sy) AS b, tx AS c,
          fy * sin(theta) * exp(-sx) AS d, fy * cos(theta) * exp(-sy) AS e, ty AS f FROM transforms)"""
CHAIN = f"""{PLAN}, {MATRIX},
  px AS (SELECT m.grp, m.layer, step, a, b * tw / th AS b, (c - a - b + 1) * tw / 2.0 AS c, d * th / tw AS d, e, (f - d - e + 1) * th / 2.0 AS f
         FROM mat m JOIN plan p ON m.grp = p.grp AND m.layer = p.layer),
  m0 AS (SELECT * FROM px WHERE step = 0), m1 AS (SELECT * FROM px WHERE step = 1),
  full_m AS (SELECT m0.grp AS grp, m0.layer AS layer, m1.a * m0.a + m1.b * m0.d AS a, m1.a * m0.b + m1.b * m0.e AS b, m1.a * m0.c + m1.b * m0.f + m1.c AS c,
          m1.d * m0.a + m1.e * m0.d AS d, m1.d * m0.b + m1.e * m0.e AS e, m1.d * m0.c + m1.e * m0.f + m1.f AS f
          FROM m0 JOIN m1 ON m0.grp = m1.grp AND m0.layer = m1.layer)"""
ALIGNED = f"""{CHAIN},
  aligned AS (SELECT p.grp AS grp, p.layer AS layer, kpt_id, a * (x + pl) + b * (y + pu) + c AS x, d * (x + pl) + e * (y + pu) + f AS y
          FROM points p JOIN plan s ON p.grp = s.grp AND p.layer = s.layer JOIN full_m m ON p.grp = m.grp AND p.layer = m.layer)"""


def aligned_points(v):
    return P.landmarks_to_aligned(v.points, P.pad_plan(v.slides), v.transforms)


@book.query("p1_points_scale", "SELECT p.grp AS grp, p.layer AS layer, kpt_id, round(x / width + 1e-9, 6) AS x, round(y / height + 1e-9, 6) AS y FROM points p JOIN slides s ON p.grp = s.grp AND p.layer = s.layer")
def _(v):  # the two engines round halves unlike each other, so values are moved off them
    edge = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)
    return P.points_scale(v.points, v.slides).select("grp", "layer", "kpt_id", edge("x"), edge("y"))


@book.query("p2_points_pad", f"WITH {PLAN} SELECT p.grp AS grp, p.layer AS layer, kpt_id, round(x + pr, 5) AS x, round(y + pd, 5) AS y FROM points p JOIN plan s ON p.grp = s.grp AND p.layer = s.layer")
def _(v):
    return P.points_pad(v.points, P.pad_plan(v.slides)).select("grp", "layer", "kpt_id", R("x"), R("y"))


@book.query("p2_points_unpad", f"WITH {PLAN} SELECT p.grp AS grp, p.layer AS layer, kpt_id, round(x - pl, 5) AS x, round(y - pu, 5) AS y FROM points p JOIN plan s ON p.grp = s.grp AND p.layer = s.layer")
def _(v):
    return P.points_pad(v.points, P.pad_plan(v.slides), inverse=True).select("grp", "layer", "kpt_id", R("x"), R("y"))


@book.query(
    "p3_pad_plan",
    """WITH r AS (SELECT grp, layer, height, width, greatest(height / 1300.0, width / 1300.0, 1.0) AS ratio FROM slides),
       n AS (SELECT *, CAST(floor(height / ratio) AS BIGINT) AS new_h, CAST(floor(width / ratio) AS BIGINT) AS new_w FROM r)
       SELECT grp, layer, round(ratio, 6) AS ratio, new_h, new_w, CAST(floor((1300 - new_w) / 2.0) AS BIGINT) AS pad_left, CAST(1300 - new_w - floor((1300 - new_w) / 2.0) AS BIGINT) AS pad_right,
       CAST(floor((1300 - new_h) / 2.0) AS BIGINT) AS pad_up, CAST(1300 - new_h - floor((1300 - new_h) / 2.0) AS BIGINT) AS pad_down, round(avg(ratio) OVER (PARTITION BY grp), 6) AS mean_ratio FROM n""",
)
def _(v):
    long = lambda c: F.col(c).cast("long").alias(c)
    return P.pad_plan(v.slides, max_size=1300).select("grp", "layer", R("ratio", 6), *map(long, ("new_h", "new_w", "pad_left", "pad_right", "pad_up", "pad_down")), R("mean_ratio", 6))


@book.query("p4_points_flip", "SELECT p.grp AS grp, p.layer AS layer, kpt_id, round(CASE WHEN flip_x = 1 THEN width - x ELSE x END, 5) AS x, round(CASE WHEN flip_y = 1 THEN height - y ELSE y END, 5) AS y FROM points p JOIN slides s ON p.grp = s.grp AND p.layer = s.layer JOIN angles a ON p.grp = a.grp AND p.layer = a.layer")
def _(v):
    flagged = v.points.join(v.angles.select("grp", "layer", "flip_x", "flip_y"), ["grp", "layer"])
    return P.points_flip(flagged, v.slides, "flip_x", "flip_y").select("grp", "layer", "kpt_id", R("x"), R("y"))


@book.query("p5_params_to_matrix", f"WITH {MATRIX} SELECT grp, layer, step, round(a, 8) AS a, round(b, 8) AS b, round(c, 8) AS c, round(d, 8) AS d, round(e, 8) AS e, round(f, 8) AS f FROM mat")
def _(v):
    return P.params_to_matrix(v.transforms).select("grp", "layer", "step", *[R(c, 8) for c in "abcdef"])


@book.query("p5_matrix_inverse", f"WITH {MATRIX} SELECT grp, layer, step, round(e / (a*e-b*d), 7) AS a, round(-b / (a*e-b*d), 7) AS b, round((b*f - e*c) / (a*e-b*d), 7) AS c, round(-d / (a*e-b*d), 7) AS d, round(a / (a*e-b*d), 7) AS e, round((d*c - a*f) / (a*e-b*d), 7) AS f FROM mat")
def _(v):
    return P.invert_matrix(P.params_to_matrix(v.transforms)).select("grp", "layer", "step", *[R(c, 7) for c in "abcdef"])


@book.query(
    "p6_matrix_to_params",
    "SELECT grp, layer, step, round(CASE WHEN fx < 0 THEN theta - pi() ELSE theta END, 6) AS theta, round(tx, 6) AS tx, round(ty, 6) AS ty, round(sx, 6) AS sx, round(sy, 6) AS sy, 1.0e0 AS fx, CASE WHEN fx < 0 THEN -1.0e0 ELSE 1.0e0 END AS fy FROM transforms",
)
def _(v):  # a flip of x is the same map as a flip of y and half a turn, which comes first
    found = P.matrix_to_params(P.params_to_matrix(v.transforms), ["grp", "layer", "step"])
    return found.select("grp", "layer", "step", R("theta", 6), R("tx", 6), R("ty", 6), R("sx", 6), R("sy", 6), R("fx", 1), R("fy", 1))


@book.query("p7_transform_points", f"WITH {MATRIX} SELECT p.grp AS grp, p.layer AS layer, step, kpt_id, round(a * x + b * y + c, 4) AS x, round(d * x + e * y + f, 4) AS y FROM points p JOIN mat m ON p.grp = m.grp AND p.layer = m.layer")
def _(v):
    keys = ("grp", "layer", "step")
    points = v.points.join(v.transforms.select(*keys), ["grp", "layer"])
    return P.transform_points(points, P.params_to_matrix(v.transforms), keys).select(*keys, "kpt_id", R("x", 4), R("y", 4))


@book.query("p8_landmarks_raw_to_aligned", f"WITH {ALIGNED} SELECT grp, layer, kpt_id, round(x, 3) AS x, round(y, 3) AS y FROM aligned")
def _(v):
    return aligned_points(v).select("grp", "layer", "kpt_id", R("x", 3), R("y", 3))


@book.query("p9_landmarks_aligned_to_raw", "SELECT grp, layer, kpt_id, round(x, 3) AS x, round(y, 3) AS y FROM points")
def _(v):
    back = P.landmarks_to_raw(aligned_points(v), P.pad_plan(v.slides), v.transforms)
    return back.select("grp", "layer", "kpt_id", R("x", 3), R("y", 3))


@book.query("p12_crop_points", "SELECT grp, layer_f, kpt_id, round((xf - 160) * 1.0, 5) AS xf, round((yf - 320) * 1.0, 5) AS yf, round((xm - 160) * 2.0, 5) AS xm, round((ym - 320) * 2.0, 5) AS ym FROM pairs WHERE xf > 160 AND xf < 1280 AND yf > 320 AND xm > 160 AND xm < 1280 AND ym > 320")
def _(v):
    return P.crop_points(v.pairs, (0.1, 0.8, 0.2, -1.0), 1600, (1.0, 2.0)).select("grp", "layer_f", "kpt_id", R("xf"), R("yf"), R("xm"), R("ym"))


@book.query("p13_crop_window", "SELECT image_id, channel, y - 6 AS y, x - 3 AS x, v FROM pixels WHERE y >= 6 AND y < 24 AND x >= 3 AND x < 28")
def _(v):
    return P.crop_window(v.pixels, (0.2, 0.75, 0.1, 0.9), 32, 32).select("image_id", "channel", "y", "x", "v")


@book.query("p14_scale_translate_geometry", "SELECT shape_id, round((cx - rx) * 0.25 + 7, 6) AS x0, round((cy - ry) * 0.25 - 3, 6) AS y0, round((cx + rx) * 0.25 + 7, 6) AS x1, round((cy + ry) * 0.25 - 3, 6) AS y1 FROM shapes")
def _(v):
    from ..operators.spatial import with_ring

    moved = P.scale_translate_rings(with_ring(v.shapes), 0.25, 7.0, -3.0)
    side = lambda f, c: F.round(f(F.transform("ring", lambda p: p[c])), 6)
    return moved.select("shape_id", side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


@book.query("p17_border_filter", "SELECT grp, layer, kpt_id FROM points WHERE x >= 100 AND x < 1500 AND y >= 100 AND y < 1500")
def _(v):
    return P.border_filter(v.points, 100, 1600, 1600).select("grp", "layer", "kpt_id")


@book.query(
    "p19_enumerate_candidates",
    """SELECT grp, layer, CAST(fx * 64 + fy * 32 + si * 8 + ai AS BIGINT) AS ord, CAST(fx AS BIGINT) AS flip_x, CAST(fy AS BIGINT) AS flip_y, CAST(s AS BIGINT) AS scale, CAST(ai * 45 AS BIGINT) AS angle
       FROM slides, (SELECT unnest([0, 1]) AS fx) a, (SELECT unnest([0, 1]) AS fy) b, (SELECT unnest([0, 1, 2, 3]) AS si, unnest([1, 2, 4, 8]) AS s) c, (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS ai) d""",
)
def _(v):
    found = P.enumerate_candidates(v.slides.select("grp", "layer"))
    return found.select("grp", "layer", *[F.col(c).cast("long").alias(c) for c in ("ord", "flip_x", "flip_y", "scale", "angle")])


@book.query(
    "p20_orient_layers",
    """WITH q AS (SELECT p.grp, p.layer, kpt_id, radians(-angle) AS t, CASE WHEN flip_x = 1 THEN 1600 - x ELSE x END - 800 AS u, CASE WHEN flip_y = 1 THEN 1600 - y ELSE y END - 800 AS w FROM points p JOIN angles a ON p.grp = a.grp AND p.layer = a.layer)
       SELECT grp, layer, kpt_id, round(cos(t) * u - sin(t) * w + 800, 4) AS x, round(sin(t) * u + cos(t) * w + 800, 4) AS y FROM q""",
)
def _(v):
    return P.orient_points(v.points, v.angles, 1600.0).select("grp", "layer", "kpt_id", R("x", 4), R("y", 4))


@book.query(
    "p21_normalize_keypoints",
    """WITH s AS (SELECT grp, layer, 1 + max(x) - min(x) AS w, 1 + max(y) - min(y) AS h FROM points GROUP BY grp, layer)
       SELECT p.grp AS grp, p.layer AS layer, kpt_id, round((x - w / 2) / (greatest(w, h) / 2), 6) AS x, round((y - h / 2) / (greatest(w, h) / 2), 6) AS y FROM points p JOIN s ON p.grp = s.grp AND p.layer = s.layer""",
)
def _(v):
    return P.normalize_keypoints(v.points).select("grp", "layer", "kpt_id", R("x", 6), R("y", 6))
