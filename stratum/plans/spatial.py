"""Registered queries of the spatial joins and of registration metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitting as A
from ..operators import metrics as Q
from ..operators import points as P
from ..operators import spatial as K
from ..sources.views import Book
from .points import ALIGNED

book = Book()
QUERIES, SQL = book.queries, book.sql
R = lambda c, n=5: F.round(c, n).alias(c)
L = lambda c: F.col(c).cast("long").alias(c)
ids = lambda df: df.select("grp", F.col("cell_id").alias("id"), "x", "y", "label")

RING = """
  corners AS (SELECT grp, shape_id, cx, cy, rx, ry, k, CASE k WHEN 0 THEN cx - rx WHEN 1 THEN cx - 0.5e0 * rx WHEN 2 THEN cx + 0.5e0 * rx WHEN 3 THEN cx + rx WHEN 4 THEN cx + 0.5e0 * rx ELSE cx - 0.5e0 * rx END AS x,
              CASE WHEN k IN (0, 3) THEN cy WHEN k IN (1, 2) THEN cy - ry ELSE cy + ry END AS y FROM shapes, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k)),
  sides AS (SELECT a.grp AS grp, a.shape_id AS shape_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM corners a JOIN corners b ON a.grp = b.grp AND a.shape_id = b.shape_id AND b.k = (a.k + 1) % 6),
  placed AS (SELECT c.grp AS grp, cell_id, label, shape_id, c.x AS x, c.y AS y, bool_or(false) AS z,
             count(*) FILTER (WHERE (s.y0 > c.y) <> (s.y1 > c.y) AND c.x < (s.x1 - s.x0) * (c.y - s.y0) / (s.y1 - s.y0) + s.x0) % 2 = 1 AS inside,
             min(sqrt(power(c.x - s.x0 - greatest(0, least(1, ((c.x-s.x0)*(s.x1-s.x0)+(c.y-s.y0)*(s.y1-s.y0)) / (power(s.x1-s.x0,2)+power(s.y1-s.y0,2)))) * (s.x1-s.x0), 2)
                    + power(c.y - s.y0 - greatest(0, least(1, ((c.x-s.x0)*(s.x1-s.x0)+(c.y-s.y0)*(s.y1-s.y0)) / (power(s.x1-s.x0,2)+power(s.y1-s.y0,2)))) * (s.y1-s.y0), 2))) AS dist
             FROM cells c JOIN sides s ON c.grp = s.grp GROUP BY c.grp, cell_id, label, shape_id, c.x, c.y)"""
D = "sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))"


@book.query(
    "k2_knn_join",
    f"""WITH d AS (SELECT a.grp AS grp, a.cell_id AS id_a, b.cell_id AS id_b, {D} AS distance, row_number() OVER (PARTITION BY a.grp, a.cell_id ORDER BY {D}, b.cell_id) AS rank
        FROM cells a JOIN targets b ON a.grp = b.grp) SELECT grp, id_a, id_b, round(distance, 5) AS distance, rank FROM d WHERE rank <= 5""",
)
def _(v):
    return K.knn_join(ids(v.cells), ids(v.targets), 5).select("grp", "id_a", "id_b", R("distance"), L("rank"))


@book.query(
    "k2_knn_within",
    f"""WITH d AS (SELECT a.grp AS grp, a.cell_id AS id_a, b.cell_id AS id_b, {D} AS distance, row_number() OVER (PARTITION BY a.grp, a.cell_id ORDER BY {D}, b.cell_id) AS rank
        FROM cells a JOIN targets b ON a.grp = b.grp AND {D} <= 40) SELECT grp, id_a, id_b, round(distance, 5) AS distance, rank FROM d WHERE rank <= 3""",
)
def _(v):
    return K.knn_within(ids(v.cells), ids(v.targets), 3, 40.0).select("grp", "id_a", "id_b", R("distance"), L("rank"))


@book.query(
    "k3_knn_mean_lookup",
    f"""WITH d AS (SELECT a.grp AS grp, a.cell_id AS id, b.x AS bx, b.y AS b_y, b.x + 2 AS fx, b.y - 1 AS fy, row_number() OVER (PARTITION BY a.grp, a.cell_id ORDER BY {D}, b.cell_id) AS rank
        FROM cells a JOIN targets b ON a.grp = b.grp) SELECT grp, id, round(avg(bx), 4) AS mx, round(avg(b_y), 4) AS my, round(avg(fx), 4) AS fx, round(avg(fy), 4) AS fy FROM d WHERE rank <= 5 GROUP BY grp, id""",
)
def _(v):
    fixed = ids(v.targets).withColumns({"x": F.col("x") + 2, "y": F.col("y") - 1})
    return A.knn_mean_lookup(ids(v.cells), ids(v.targets), fixed, 5).select("grp", "id", *[R(c, 4) for c in ("mx", "my", "fx", "fy")])


@book.query("k15_radius_join", f"SELECT a.grp AS grp, a.cell_id AS id_a, b.cell_id AS id_b, round({D}, 5) AS distance FROM cells a JOIN targets b ON a.grp = b.grp WHERE {D} < 25")
def _(v):
    return K.radius_join(ids(v.cells), ids(v.targets), 25.0).select("grp", "id_a", "id_b", R("distance"))


@book.query("k6_point_in_polygon_join", f"WITH {RING} SELECT grp, cell_id AS id, max(shape_id) AS shape_id FROM placed WHERE inside AND dist > 0 GROUP BY grp, cell_id")
def _(v):
    return K.point_in_polygon(ids(v.cells), K.with_ring(v.shapes), 64.0)


@book.query("k6_point_in_polygon_intersects", f"WITH {RING} SELECT grp, cell_id AS id, max(shape_id) AS shape_id FROM placed WHERE inside OR dist = 0 GROUP BY grp, cell_id")
def _(v):
    return K.point_in_polygon(ids(v.cells), K.with_ring(v.shapes), 64.0, predicate="intersects")


@book.query("k7_ring_join_attributes", f"WITH {RING} SELECT p.grp AS grp, cell_id AS id, p.shape_id AS shape_id, CASE WHEN inside THEN 'inner' ELSE 'outer' END AS band, rx, ry FROM placed p JOIN shapes s ON p.grp = s.grp AND p.shape_id = s.shape_id WHERE dist <= 12")
def _(v):
    return K.ring_join(ids(v.cells), K.with_ring(v.shapes), 12.0, 64.0, tolerance=0.01, keep=("rx", "ry")).select("grp", "id", "shape_id", "band", "rx", "ry")


@book.query("k7_ring_join", f"WITH {RING} SELECT grp, cell_id AS id, shape_id, CASE WHEN inside THEN 'inner' ELSE 'outer' END AS band, round(dist, 5) AS edge_distance FROM placed WHERE dist <= 12")
def _(v):
    return K.ring_join(ids(v.cells), K.with_ring(v.shapes), 12.0, 64.0).select("grp", "id", "shape_id", "band", R("edge_distance"))


INTERACT = f"""{RING},
  o AS (SELECT grp, cell_id, x, y, label, max(shape_id) AS roi FROM placed WHERE dist <= 15 AND NOT inside GROUP BY grp, cell_id, x, y, label),
  i AS (SELECT grp, cell_id, x, y, label, max(shape_id) AS roi FROM placed WHERE dist <= 15 AND inside GROUP BY grp, cell_id, x, y, label),
  near AS (SELECT a.grp AS grp, a.cell_id AS cell_i, b.cell_id AS cell_j, {D} AS distance, a.label AS key_i, b.label AS key_j, a.roi AS roi_i, row_number() OVER (PARTITION BY a.grp, a.cell_id ORDER BY {D}, b.cell_id) AS rank
           FROM o a JOIN i b ON a.grp = b.grp AND {D} <= 50),
  inter AS (SELECT grp, cell_i, cell_j, distance, key_i, key_j, roi_i, least(key_i, key_j) || '-' || greatest(key_i, key_j) AS type FROM near WHERE rank <= 4)"""


def interactions(v):
    return K.boundary_interactions(ids(v.cells), K.with_ring(v.shapes), 15.0, 4, 50.0, 64.0)


@book.query("k8_boundary_interaction", f"WITH {INTERACT} SELECT grp, cell_i, cell_j, round(distance, 5) AS distance, key_i, key_j, roi_i, type FROM inter")
def _(v):
    return interactions(v).withColumn("distance", F.round("distance", 5))


@book.query("k20_exclude_labels", f"WITH {INTERACT} SELECT grp, cell_i, cell_j, type FROM inter WHERE key_i NOT IN ('BUILDING', 'MACHINERY') AND key_j NOT IN ('BUILDING', 'MACHINERY')")
def _(v):
    return K.exclude_labels(interactions(v), ["BUILDING", "MACHINERY"]).select("grp", "cell_i", "cell_j", "type")


@book.query("a17_interaction_graph", f"WITH {INTERACT} SELECT least(key_i, key_j) AS a, greatest(key_i, key_j) AS b, count(*) AS weight, 2 * count(*) AS width FROM inter GROUP BY 1, 2")
def _(v):
    from ..operators.regions import interaction_edges

    return interaction_edges(interactions(v))


@book.query("a17_interaction_nodes", f"WITH {INTERACT} SELECT label, count(*) AS size FROM (SELECT key_i AS label FROM inter UNION ALL SELECT key_j FROM inter) GROUP BY label")
def _(v):
    from ..operators.regions import interaction_nodes

    return interaction_nodes(interactions(v))


@book.query("a18_interaction_top_types", f"WITH {INTERACT}, n AS (SELECT label, count(*) AS n FROM inter, (SELECT DISTINCT label FROM cells) l WHERE key_i = label OR key_j = label GROUP BY label) SELECT label, n, round(n / max(n) OVER (), 6) AS share FROM n")
def _(v):
    from ..operators.regions import label_shares

    return label_shares(interactions(v)).select("label", "n", R("share", 6))


@book.query(
    "k9_patch_mean",
    """WITH p AS (SELECT image_id, c_custkey AS id, CAST(round_even((c_custkey * 7 % 64) / 2.0, 0) AS BIGINT) AS cx, CAST(round_even((c_custkey * 11 % 64) / 2.0, 0) AS BIGINT) AS cy FROM visitors)
       SELECT p.image_id AS image_id, id, channel, round(avg(v), 5) AS mean, count(*) AS n FROM p JOIN pixels q ON p.image_id = q.image_id AND abs(q.x - cx) <= 3 AND abs(q.y - cy) <= 3 GROUP BY 1, 2, 3""",
)
def _(v):
    at = v.visitors.select("image_id", F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 64 / 2).alias("x"), (F.col("c_custkey") * 11 % 64 / 2).alias("y"))
    return K.patch_mean(at, v.pixels, 3, 32, 32).select("image_id", "id", "channel", R("mean"), "n")


@book.query(
    "k17_box_iou_join",
    """WITH p AS (SELECT a.grp AS grp, a.box_id AS i, b.box_id AS j, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
       (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1
       FROM boxes a JOIN boxes b ON a.grp = b.grp AND a.box_id < b.box_id) SELECT grp, i, j, round(inter / (aa + ab - inter + 1e-6), 6) AS iou, x0, y0, x1, y1 FROM p WHERE inter > 0""",
)
def _(v):
    return K.box_iou(v.boxes, 100.0).withColumn("iou", F.round("iou", 6))


@book.query(
    "a16_knn_density",
    f"""WITH d AS (SELECT a.grp AS grp, a.cell_id AS id, {D} AS distance, row_number() OVER (PARTITION BY a.grp, a.cell_id ORDER BY {D}, b.cell_id) AS rank FROM cells a JOIN cells b ON a.grp = b.grp AND a.cell_id <> b.cell_id)
        SELECT grp, id, round(least(avg(distance), 60), 4) AS density FROM d WHERE rank <= 10 GROUP BY grp, id""",
)
def _(v):
    return K.knn_density(ids(v.cells)).select("grp", "id", R("density", 4))


@book.query(
    "a13_hist2d_count",
    """WITH e AS (SELECT grp, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM cells GROUP BY grp)
       SELECT p.grp AS grp, CAST(least(floor((x - a) / ((b - a) / 12)), 11) AS BIGINT) AS bx, CAST(least(floor((y - c) / ((d - c) / 12)), 11) AS BIGINT) AS by, count(*) AS n FROM cells p JOIN e ON p.grp = e.grp GROUP BY 1, 2, 3""",
)
def _(v):
    return K.hist2d(v.cells, 12).select("grp", L("bx"), L("by"), "n")


@book.query("a1_tre", "SELECT grp, layer_f, kpt_id, round(sqrt(power(xf - xm, 2) + power(yf - ym, 2)), 5) AS tre FROM pairs")
def _(v):
    return Q.tre(v.pairs).select("grp", "layer_f", "kpt_id", R("tre"))


@book.query("a2_rtre", "WITH t AS (SELECT grp, layer_f, sqrt(power(xf - xm, 2) + power(yf - ym, 2)) / 2262.75 AS r FROM pairs) SELECT grp, layer_f, round(avg(r), 6) AS mean_rtre, round(quantile_cont(r, 0.5), 6) AS median_rtre, round(max(r), 6) AS max_rtre, count(*) AS n FROM t GROUP BY grp, layer_f")
def _(v):
    return Q.rtre(v.pairs, 2262.75).select("grp", "layer_f", R("mean_rtre", 6), R("median_rtre", 6), R("max_rtre", 6), "n")


@book.query("a3_fiducials_from_pairs", "SELECT grp, layer_f, fid, y1, x1, y2, x2 FROM (SELECT grp, layer_f, row_number() OVER (PARTITION BY grp, layer_f ORDER BY kpt_id) AS fid, yf AS y1, xf AS x1, ym AS y2, xm AS x2 FROM pairs) WHERE fid <= 7")
def _(v):
    return Q.fiducials_from_pairs(v.pairs, 7).withColumn("fid", F.col("fid").cast("long"))


@book.query("a4_pairwise_tre", "SELECT a.grp AS grp, a.layer AS layer, a.kpt_id AS kpt_id, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 5) AS tre FROM points a JOIN points b ON a.grp = b.grp AND a.kpt_id = b.kpt_id AND b.layer = a.layer + 1")
def _(v):
    return Q.pairwise_tre_global(v.points).select("grp", "layer", "kpt_id", R("tre"))


@book.query("a4_pairwise_tre_rows", "SELECT p.grp AS grp, layer_f, kpt_id, round(sqrt(power(xf - xm, 2) + power(yf - ym, 2)) * 0.46, 5) AS tre FROM pairs p JOIN (SELECT grp, max(layer_f) AS last FROM pairs GROUP BY grp) l ON p.grp = l.grp AND layer_f < last")
def _(v):
    return Q.pairwise_tre(v.pairs, 0.46, more_points=True).select("grp", "layer_f", "kpt_id", R("tre"))


@book.query(
    "a5_accumulated_tre",
    """WITH m AS (SELECT grp, layer_f, avg(xm - xf) AS dx, avg(ym - yf) AS dy FROM pairs GROUP BY grp, layer_f), s AS (SELECT grp, layer_f, sum(dx) OVER w AS sx, sum(dy) OVER w AS sy FROM m WINDOW w AS (PARTITION BY grp ORDER BY layer_f ROWS UNBOUNDED PRECEDING))
       SELECT grp, layer_f, round(sqrt(sx * sx + sy * sy), 4) AS atre FROM s""",
)
def _(v):
    return Q.accumulated_tre(v.pairs).select("grp", "layer_f", R("atre", 4))


@book.query(
    "a6_linearfit_tre",
    """WITH f AS (SELECT grp, kpt_id, regr_slope(x, layer * 5.0) AS kx, regr_slope(y, layer * 5.0) AS ky, avg(x) AS mx, avg(y) AS my, avg(layer * 5.0) AS mz FROM points GROUP BY grp, kpt_id)
       SELECT p.grp AS grp, layer, p.kpt_id AS kpt_id, round(sqrt(power(x - mx - kx * (layer * 5.0 - mz), 2) + power(y - my - ky * (layer * 5.0 - mz), 2)), 4) AS fit_tre FROM points p JOIN f ON p.grp = f.grp AND p.kpt_id = f.kpt_id""",
)
def _(v):
    return Q.linearfit_tre(v.points, 5.0).select("grp", "layer", "kpt_id", R("fit_tre", 4))


@book.query(
    "a7_registration_report",
    """WITH t AS (SELECT grp, layer_f, avg(sqrt(power(xf - xm, 2) + power(yf - ym, 2))) * 0.46 AS v, avg(xm - xf) * 0.46 AS dx, avg(ym - yf) * 0.46 AS dy FROM pairs GROUP BY grp, layer_f),
       s AS (SELECT grp, layer_f, v, sum(dx) OVER w AS sx, sum(dy) OVER w AS sy FROM t WINDOW w AS (PARTITION BY grp ORDER BY layer_f ROWS UNBOUNDED PRECEDING)), u AS (SELECT grp, v, sqrt(sx * sx + sy * sy) AS a FROM s)
       SELECT grp, round(avg(v), 4) AS mean_pairwise, round(max(v), 4) AS max_pairwise, round(stddev_pop(v), 4) AS std_pairwise, round(avg(a), 4) AS mean_accumulated, round(max(a), 4) AS max_accumulated, round(stddev_pop(a), 4) AS std_accumulated FROM u GROUP BY grp""",
)
def _(v):
    df = Q.registration_report(v.pairs)
    return df.select("grp", *[R(c, 4) for c in df.columns if c != "grp"])


@book.query(
    "a7_registration_report_global",
    """WITH u AS (SELECT grp, layer, kpt_id, x * 0.46 AS x, y * 0.46 AS y FROM points),
       t AS (SELECT a.grp AS grp, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS v FROM u a JOIN u b ON a.grp = b.grp AND a.kpt_id = b.kpt_id AND b.layer = a.layer + 1),
       f AS (SELECT grp, kpt_id, regr_slope(x, layer * 5.0) AS kx, regr_slope(y, layer * 5.0) AS ky, avg(x) AS mx, avg(y) AS my, avg(layer * 5.0) AS mz FROM u GROUP BY grp, kpt_id),
       d AS (SELECT u.grp AS grp, sqrt(power(x - mx - kx * (layer * 5.0 - mz), 2) + power(y - my - ky * (layer * 5.0 - mz), 2)) AS a FROM u JOIN f ON u.grp = f.grp AND u.kpt_id = f.kpt_id)
       SELECT p.grp AS grp, mean_pairwise, max_pairwise, std_pairwise, mean_accumulated, max_accumulated, std_accumulated
       FROM (SELECT grp, round(avg(v), 4) AS mean_pairwise, round(max(v), 4) AS max_pairwise, round(stddev_pop(v), 4) AS std_pairwise FROM t GROUP BY grp) p
       JOIN (SELECT grp, round(avg(a), 4) AS mean_accumulated, round(max(a), 4) AS max_accumulated, round(stddev_pop(a), 4) AS std_accumulated FROM d GROUP BY grp) q ON p.grp = q.grp""",
)
def _(v):
    df = Q.registration_report(v.points)
    return df.select("grp", *[R(c, 4) for c in df.columns if c != "grp"])


@book.query("a8_keypoint_l1_weighted", "SELECT grp, round(avg((1 + kpt_id % 4) / 4e0 * (abs(xf - xm) + abs(yf - ym)) / 2) + 0.1e0 * (1 - avg((1 + kpt_id % 4) / 4e0)), 4) AS loss FROM pairs GROUP BY grp")
def _(v):
    return Q.keypoint_l1_weighted(v.pairs.withColumn("attr", (1 + F.col("kpt_id") % 4) / 4)).select("grp", R("loss", 4))


@book.query("a8_keypoint_l1", "WITH l AS (SELECT grp, layer_f, avg((abs(xf - xm) + abs(yf - ym)) / 2) AS l1, avg(xf - xm) AS ex, avg(yf - ym) AS ey FROM pairs GROUP BY grp, layer_f) SELECT grp, round(avg(l1) + 0.5 * avg(sqrt(ex * ex + ey * ey)), 4) AS loss FROM l GROUP BY grp")
def _(v):
    return Q.keypoint_l1(v.pairs, 0.5).select("grp", R("loss", 4))


FIT = """
  n AS (SELECT grp, layer_f, xm / 800 - 1 AS u, ym / 800 - 1 AS v, xf / 800 - 1 AS p, yf / 800 - 1 AS q FROM pairs),
  m AS (SELECT grp, layer_f, avg(u) AS mu, avg(v) AS mv, avg(p) AS mp, avg(q) AS mq, var_pop(u) AS uu, covar_pop(u, v) AS uv, var_pop(v) AS vv, covar_pop(u, p) AS up, covar_pop(v, p) AS vp, covar_pop(u, q) AS uq, covar_pop(v, q) AS vq FROM n GROUP BY grp, layer_f),
  fit AS (SELECT grp, layer_f, (up * vv - vp * uv) / (uu * vv - uv * uv) AS a, (vp * uu - up * uv) / (uu * vv - uv * uv) AS b, (uq * vv - vq * uv) / (uu * vv - uv * uv) AS d, (vq * uu - uq * uv) / (uu * vv - uv * uv) AS e, mu, mv, mp, mq FROM m)"""


@book.query("a9_affine_fit", f"WITH {FIT} SELECT grp, layer_f, round(a, 6) AS a, round(b, 6) AS b, round(mp - a * mu - b * mv, 6) AS c, round(d, 6) AS d, round(e, 6) AS e, round(mq - d * mu - e * mv, 6) AS f FROM fit")
def _(v):
    return A.affine_fit(v.pairs, ["grp", "layer_f"], 1600, 1600).select("grp", "layer_f", *[R(c, 6) for c in "abcdef"])


@book.query("a10_rotation_fit", f"WITH {FIT} SELECT grp, layer_f, round(degrees(atan2(d, a)), 3) AS angle FROM fit")
def _(v):
    return A.rotation_fit(v.pairs, ["grp", "layer_f"], 1600, 1600).select("grp", "layer_f", R("angle", 3))


@book.query("p11_move_kpts_fit", f"WITH {FIT} SELECT p.grp AS grp, p.layer_f AS layer_f, kpt_id, round((a * (xm / 800 - 1) + b * (ym / 800 - 1) + mp - a * mu - b * mv + 1) * 800, 3) AS xm, round((d * (xm / 800 - 1) + e * (ym / 800 - 1) + mq - d * mu - e * mv + 1) * 800, 3) AS ym FROM pairs p JOIN fit f ON p.grp = f.grp AND p.layer_f = f.layer_f")
def _(v):
    keys = ["grp", "layer_f"]
    return P.move_by_fit(v.pairs, A.affine_fit(v.pairs, keys, 1600, 1600), keys, 1600, 1600).select("grp", "layer_f", "kpt_id", R("xm", 3), R("ym", 3))


@book.query(
    "a11_displacement_bin_mean",
    """WITH g AS (SELECT DISTINCT grp, layer_f FROM pairs), ij AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 10)) AS j)),
       b AS (SELECT grp, layer_f, CAST(floor(yf / 160) AS BIGINT) AS i, CAST(floor(xf / 160) AS BIGINT) AS j, avg(xf - xm) AS dx, avg(yf - ym) AS dy, count(*) AS n FROM pairs WHERE xf < 1600 AND yf < 1600 GROUP BY 1, 2, 3, 4)
       SELECT g.grp AS grp, g.layer_f AS layer_f, ij.i AS i, ij.j AS j, round(coalesce(dx, 0), 4) AS dx, round(coalesce(dy, 0), 4) AS dy, coalesce(n, 0) AS n FROM g, ij LEFT JOIN b ON b.grp = g.grp AND b.layer_f = g.layer_f AND b.i = ij.i AND b.j = ij.j""",
)
def _(v):
    return A.displacement_bins(v.pairs, ["grp", "layer_f"], 1600, 10).select("grp", "layer_f", "i", "j", R("dx", 4), R("dy", 4), "n")


@book.query("a12_displacement_grid_fit")
def _(v):
    return A.displacement_fit(v.pairs, ["grp", "layer_f"], 1600, 8).select("grp", "layer_f", "i", "j", R("dx", 4), R("dy", 4))


@book.query(
    "p10_landmarks_nonrigid",
    f"""WITH {FIT}, {ALIGNED},
       moved AS (SELECT p.grp AS grp, p.layer_f AS layer_f, xf, yf, (a * (xm / 800 - 1) + b * (ym / 800 - 1) + mp - a * mu - b * mv + 1) * 800 AS xm, (d * (xm / 800 - 1) + e * (ym / 800 - 1) + mq - d * mu - e * mv + 1) * 800 AS ym FROM pairs p JOIN fit f ON p.grp = f.grp AND p.layer_f = f.layer_f),
       bins AS (SELECT grp, layer_f, CAST(floor(yf / 200) AS BIGINT) AS i, CAST(floor(xf / 200) AS BIGINT) AS j, avg(xf - xm) AS dx, avg(yf - ym) AS dy, count(*) AS n FROM moved WHERE xf < 1600 AND yf < 1600 GROUP BY 1, 2, 3, 4),
       sent AS (SELECT grp, layer_f, i + oa AS i, j + ob AS j, dx, dy, n * exp(-(oa * oa + ob * ob) / 2e0) AS w FROM bins, (SELECT unnest([-1, 0, 1]) AS oa), (SELECT unnest([-1, 0, 1]) AS ob)),
       smooth AS (SELECT grp, layer_f, i, j, sum(w * dx) / sum(w) AS dx, sum(w * dy) / sum(w) AS dy FROM sent WHERE i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4)
       SELECT p.grp AS grp, p.layer AS layer, kpt_id, round(x + coalesce(dx, 0), 3) AS x, round(y + coalesce(dy, 0), 3) AS y FROM aligned p LEFT JOIN smooth s ON s.grp = p.grp AND s.layer_f = p.layer AND s.i = floor(p.y / 200) AND s.j = floor(p.x / 200)""",
)
def _(v):
    from .points import aligned_points

    cells = A.displacement_fit(v.pairs, ["grp", "layer_f"], 1600, 8).withColumnRenamed("layer_f", "layer")
    return A.apply_cells(aligned_points(v), cells, ["grp", "layer"], 1600, 8).select("grp", "layer", "kpt_id", R("x", 3), R("y", 3))


@book.query("a38_stage_quality_curve", "SELECT grp, layer_f, round(avg((abs(xf - xm) + abs(yf - ym)) / 2), 4) AS RAW, round(avg((abs(xf - xm) + abs(yf - ym)) / 4), 4) AS HALF FROM pairs GROUP BY grp, layer_f")
def _(v):
    both = v.pairs.withColumn("stage", F.lit("RAW")).unionByName(v.pairs.withColumns({c: F.col(c) / 2 for c in ("xf", "yf", "xm", "ym")}).withColumn("stage", F.lit("HALF")))
    return Q.stage_quality(both, ["RAW", "HALF"]).select("grp", "layer_f", R("RAW", 4), R("HALF", 4))


@book.query("k5_inverse_grid_lookup", "SELECT visitors.image_id AS image_id, c_custkey AS id, round(coalesce((gx + 1) / 2 * 32, -1), 5) AS x, round(coalesce((gy + 1) / 2 * 32, -1), 5) AS y FROM visitors LEFT JOIN field ON field.image_id = visitors.image_id AND i = floor(c_custkey % 41 + 0.5) AND j = floor(c_custkey % 37 + 0.25)")
def _(v):
    at = v.visitors.select("image_id", F.col("c_custkey").alias("id"), (F.col("c_custkey") % 37 + 0.25).alias("x"), (F.col("c_custkey") % 41 + 0.5).alias("y"))
    return A.inverse_grid_lookup(at, v.field, 32, 32).select("image_id", "id", R("x"), R("y"))


@book.query(
    "k4_warp_points_by_grid",
    """WITH l AS (SELECT image_id, c_custkey AS id, (c_custkey * 7 % 97) / 97e0 AS x, (c_custkey * 11 % 89) / 89e0 AS y FROM visitors),
       g AS (SELECT image_id, i * 32 + j AS flat, (2 * j + 1) / 32e0 - 1 + gx / 16 AS gx, (2 * i + 1) / 32e0 - 1 + gy / 16 AS gy FROM field),
       d AS (SELECT l.image_id AS image_id, id, flat, row_number() OVER (PARTITION BY l.image_id, id ORDER BY sqrt(power(2 * x - 1 - gx, 2) + power(2 * y - 1 - gy, 2)), flat) AS k FROM l JOIN g ON l.image_id = g.image_id)
       SELECT image_id, id, round((flat % 32 + 0.5) / 32, 6) AS x, round((floor(flat / 32) + 0.5) / 32, 6) AS y FROM d WHERE k = 1""",
)
def _(v):
    at = v.visitors.select("image_id", F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 97 / 97).alias("x"), (F.col("c_custkey") * 11 % 89 / 89).alias("y"))
    grid = v.field.withColumns({"gx": (2 * F.col("j") + 1) / 32 - 1 + F.col("gx") / 16, "gy": (2 * F.col("i") + 1) / 32 - 1 + F.col("gy") / 16})
    return A.warp_by_grid(at, grid, 32, 32).select("image_id", "id", R("x", 6), R("y", 6))
