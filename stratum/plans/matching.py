"""Registered queries of layer pairing, orientation, ranking and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import windows as X
from ..sources import tables as S
from ..sources.views import Book

book = Book()
QUERIES, SQL = book.queries, book.sql
R = lambda c, n=5: F.round(c, n).alias(c)
L = lambda c: F.col(c).cast("long").alias(c)


@book.query("s1_manifest_scan", "SELECT project, grp, sample, layer, type FROM manifest WHERE project = 'demo' AND grp = 2")
def _(v):
    return S.select_group(v.manifest, "demo", 2)


@book.query("s2_layer_lookup", "SELECT p.grp AS grp, p.layer AS layer, kpt_id, sample, type FROM points p JOIN manifest m ON p.grp = m.grp AND p.layer = m.layer")
def _(v):
    return S.layer_lookup(v.points, v.manifest).select("grp", "layer", "kpt_id", "sample", "type")


@book.query("s3_manifest_build", "SELECT 'p' AS project, CAST(n_regionkey AS VARCHAR) AS grp, lower(n_name) AS sample, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS BIGINT) AS layer, 'HE' AS type FROM nation")
def _(v):
    files = v.nation.select(F.concat(F.lit("/slides/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name"), F.lit(".tiff")).alias("path"))
    return S.manifest_from_paths(files, "p", "HE")


@book.query("s6_landmark_scan", "SELECT kpt_id, round(x / 0.5, 4) AS ihc_x, round(y / 0.5, 4) AS ihc_y, round((x + 1) / 0.25, 4) AS he_x, round((y + 1) / 0.25, 4) AS he_y FROM points WHERE kpt_id % 7 <> 0")
def _(v):
    raw = v.points.select("kpt_id", F.when(F.col("kpt_id") % 7 != 0, F.col("x")).alias("ihc_x"), F.col("y").alias("ihc_y"), (F.col("x") + 1).alias("he_x"), (F.col("y") + 1).alias("he_y"), F.lit(0.5).alias("mpp_ihc_10X"), F.lit(0.25).alias("mpp_he_10X"))
    return S.paired_landmarks(raw).select("kpt_id", *[R(c, 4) for c in ("ihc_x", "ihc_y", "he_x", "he_y")])


@book.query("s7_fiducial_unpivot", "SELECT s_suppkey AS layer, 'a' AS annotator, CAST(k AS BIGINT) AS kpt, CAST(s_suppkey * 10 + 2 * k AS DOUBLE) AS x, CAST(s_suppkey * 10 + 2 * k - 1 AS DOUBLE) AS y FROM supplier, (SELECT unnest([1, 2, 3, 4]) AS k)")
def _(v):
    wide = v.supplier.select(F.col("s_suppkey").alias("layer"), *[(F.col("s_suppkey") * 10 + i).cast("double").alias(f"c{i}") for i in range(1, 9)])
    return S.fiducials_long({"a": wide})


@book.query("s8_marker_panel", "SELECT 'P' || CAST(r_regionkey AS VARCHAR) AS panel, 'g' || CAST(i AS VARCHAR) AS gene, CAST((i * 2) % 5 AS BIGINT) AS channel FROM region, (SELECT unnest([0, 1, 2, 3, 4]) AS i)")
def _(v):
    panels = v.region.select(F.create_map(F.concat(F.lit("P"), F.col("r_regionkey").cast("string")), F.array(*[F.lit(f"g{i}") for i in range(5)])).alias("genes"), F.array(*[F.lit((i * 2) % 5) for i in range(5)]).alias("order_label"))
    return S.marker_panel(panels)


@book.query("s9_cluster_name_map", "SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 10 THEN 'low' WHEN c_nationkey < 12 THEN 'mid' END AS name FROM customer")
def _(v):
    names = {str(i): "low" for i in range(10)} | {"10": "mid", "11": "mid"}
    import json

    texts = v.region.limit(1).select(F.lit(json.dumps({"g": names})).alias("json"))
    rows = v.customer.select("c_custkey", "c_nationkey", F.lit("g").alias("grp"), F.col("c_nationkey").cast("string").alias("cluster"))
    return S.cluster_names(rows, texts).select("c_custkey", "c_nationkey", "name")


@book.query("s10_feature_table_scan", "SELECT 'cell_' || CAST(vec_id AS VARCHAR) AS cell, vec_id % 17 AS x, CAST(floor(vec_id / 17) AS BIGINT) AS y, round(CAST(embedding[1] AS DOUBLE), 6) AS f0 FROM embeddings")
def _(v):
    raw = v.embeddings.select(F.col("vec_id").alias("id"), F.array(F.floor(F.col("vec_id") / 17), F.col("vec_id") % 17).alias("coords"), F.col("embedding").alias("features"))
    return S.feature_table(raw).select("cell", "x", "y", F.round(F.col("features")[0].cast("double"), 6).alias("f0"))


@book.query("k1_adjacent_layer_join", "SELECT f.grp AS grp, f.layer AS layer_f, CAST(m.layer - f.layer AS BIGINT) AS zdist, f.kpt_id AS kpt_id, f.x AS xf, f.y AS yf, m.x AS xm, m.y AS ym FROM points f JOIN points m ON f.grp = m.grp AND f.kpt_id = m.kpt_id AND m.layer BETWEEN f.layer + 1 AND f.layer + 3")
def _(v):
    return M.adjacent_layers(v.points, 3).select("grp", "layer_f", L("zdist"), "kpt_id", "xf", "yf", "xm", "ym")


@book.query(
    "k12_mutual_nn_match",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY pair, j ORDER BY score DESC, i) AS rj FROM scores)
       SELECT pair, i, CASE WHEN rj = 1 AND score > 0.9 THEN j ELSE -1 END AS j, round(CASE WHEN rj = 1 AND score > 0.9 THEN score ELSE 0 END, 6) AS score FROM r WHERE ri = 1""",
)
def _(v):
    return M.mutual_matches(v.scores, 0.9).select("pair", "i", L("j"), R("score", 6))


DESCRIPTOR_MATCHES = """WITH a AS (SELECT id, features FROM descriptors WHERE image = 0), b AS (SELECT id, features FROM descriptors WHERE image = 1),
       s AS (SELECT a.id AS i, b.id AS j, list_cosine_similarity(CAST(a.features AS DOUBLE[]), CAST(b.features AS DOUBLE[])) AS score FROM a, b),
       r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY score DESC, i) AS rj FROM s)
       SELECT CAST(0 AS BIGINT) AS pair, i, CASE WHEN rj = 1 AND score > 0.1 THEN j ELSE -1 END AS j, round(CASE WHEN rj = 1 AND score > 0.1 THEN score ELSE 0 END, 5) AS score FROM r WHERE ri = 1"""


@book.query(
    "k12_descriptor_match",
    DESCRIPTOR_MATCHES,
)
def _(v):
    side = lambda n: v.descriptors.where(F.col("image") == n).select(F.lit(0).cast("long").alias("pair"), "id", "features")
    return M.descriptor_matches(side(0), side(1), 0.1).select("pair", "i", L("j"), R("score"))


@book.query(
    "k16_nearest_typed_layer",
    """WITH c AS (SELECT a.grp, a.layer, m.type, m.layer AS other, row_number() OVER (PARTITION BY a.grp, a.layer, m.type ORDER BY abs(m.layer - a.layer), -m.layer) AS r
          FROM manifest a JOIN manifest m ON a.grp = m.grp WHERE a.type = 'HE')
       SELECT grp, layer, max(CASE WHEN type = 'P1' AND r = 1 THEN other END) AS near_P1, max(CASE WHEN type = 'P3' AND r = 1 THEN other END) AS near_P3 FROM c GROUP BY grp, layer""",
)
def _(v):
    return M.nearest_typed_layer(v.manifest, "HE", ["P1", "P3"])


@book.query(
    "w3_best_candidate",
    """WITH c AS (SELECT o_custkey % 50 AS pair, o_orderkey AS ord, CAST(o_totalprice AS BIGINT) % 40 AS n, (o_orderkey % 8) * 45 AS angle, o_orderkey % 2 AS fx, CAST(floor(o_orderkey / 2) AS BIGINT) % 2 AS fy FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, ord) AS k FROM c)
       SELECT pair, ord, n, CASE WHEN fx = 1 AND fy = 1 AND angle > 90 AND angle < 270 THEN (angle + 180) % 360 ELSE angle END AS angle,
              CASE WHEN fx = 1 AND fy = 1 AND angle > 90 AND angle < 270 THEN 0 ELSE fx END AS flip_x, CASE WHEN fx = 1 AND fy = 1 AND angle > 90 AND angle < 270 THEN 0 ELSE fy END AS flip_y FROM r WHERE k = 1""",
)
def _(v):
    c = v.orders.select((F.col("o_custkey") % 50).alias("pair"), F.col("o_orderkey").alias("ord"), (F.bround("o_totalprice").cast("long") % 40).alias("n"), ((F.col("o_orderkey") % 8) * 45).alias("angle"), (F.col("o_orderkey") % 2).alias("flip_x"), (F.floor(F.col("o_orderkey") / 2) % 2).alias("flip_y"))
    return M.best_candidate(c, ("pair",)).select("pair", "ord", "n", L("angle"), L("flip_x"), L("flip_y"))


@book.query(
    "w4_cumulative_orientation",
    """WITH RECURSIVE s AS (SELECT grp, layer, CAST(angle AS DOUBLE) AS angle, flip_x, flip_y FROM angles),
       t AS (SELECT grp, layer, angle + 180 * flip_x AS a, (flip_x + flip_y) % 2 AS odd FROM s),
       c AS (SELECT grp, layer, a AS total, odd FROM t WHERE layer = 0
             UNION ALL SELECT c.grp, t.layer, c.total + t.a * (1 - 2 * c.odd), (c.odd + t.odd) % 2 FROM c JOIN t ON c.grp = t.grp AND t.layer = c.layer + 1)
       SELECT grp, layer, round(total + 180 - 360 * floor((total + 180) / 360) - 180, 4) AS angle, CAST(0 AS BIGINT) AS flip_x, CAST(odd AS BIGINT) AS flip_y FROM c""",
)
def _(v):
    return M.cumulative_orientation(v.angles).select("grp", "layer", R("angle", 4), L("flip_x"), L("flip_y"))


@book.query("t1_reorder_by_distance", "SELECT grp, layer_f, kpt_id, is_match, round(abs(xf - xm) + abs(yf - ym), 5) AS dist, row_number() OVER (PARTITION BY grp, layer_f ORDER BY abs(xf - xm) + abs(yf - ym), kpt_id) - 1 AS new_id FROM pairs")
def _(v):
    return M.reorder_by_distance(v.pairs).select("grp", "layer_f", "kpt_id", "is_match", R("dist"), L("new_id"))


@book.query("t2_topk_keypoints", "SELECT grp, layer, kpt_id, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp, layer ORDER BY score DESC, kpt_id) AS rank FROM points) WHERE rank <= 20")
def _(v):
    return M.top_k(v.points, 20, ["grp", "layer"], [F.desc("score"), "kpt_id"]).select("grp", "layer", "kpt_id", L("rank"))


@book.query("t3_percentile_keep", "WITH q AS (SELECT grp, layer, quantile_cont(score, 0.95) AS m FROM points GROUP BY grp, layer) SELECT p.grp AS grp, p.layer AS layer, kpt_id FROM points p JOIN q ON p.grp = q.grp AND p.layer = q.layer WHERE score <= m")
def _(v):
    return M.percentile_keep(v.points, "score", 0.95, ["grp", "layer"]).select("grp", "layer", "kpt_id")


@book.query("t4_top_boxes", "SELECT grp, box_id, round(score, 4) AS score, round(score / ((x1 - x0) * (y1 - y0)), 6) AS density FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, box_id) AS k FROM boxes) WHERE k <= 10")
def _(v):
    dense = v.boxes.withColumn("density", F.col("score") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))))
    return M.top_k(dense, 10, ["grp"], [F.desc("score"), "box_id"]).select("grp", "box_id", R("score", 4), R("density", 6))


@book.query("w1_sliding_median", "SELECT series, idx, quantile_cont(v, 0.5) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS med FROM signal")
def _(v):
    return X.sliding_median(v.signal, 5).select("series", "idx", "med")


@book.query("w2_detrend_median", "SELECT series, idx, round(v - quantile_cont(v, 0.5) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 4) AS residual FROM signal")
def _(v):
    return X.detrend_median(v.signal, 50).select("series", "idx", R("residual", 4))


@book.query(
    "w5_strongest_run",
    """WITH f AS (SELECT *, v > 8 AS up, idx - row_number() OVER (PARTITION BY series, v > 8 ORDER BY idx) AS island FROM signal),
       g AS (SELECT series, min(idx) AS s, max(idx) AS e, round(avg(v), 9) AS m FROM f WHERE up GROUP BY series, island HAVING count(*) >= 2),
       b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY m DESC, s) AS k FROM g)
       SELECT a.series AS series, coalesce(b.s, a.s) AS run_start, coalesce(b.e, a.e) AS run_end FROM (SELECT series, min(idx) AS s, max(idx) AS e FROM signal GROUP BY series) a LEFT JOIN b ON a.series = b.series AND b.k = 1""",
)
def _(v):
    return X.strongest_run(v.signal, 8.0, 2).select("series", L("run_start"), L("run_end"))


@book.query(
    "w6_overlapping_batches",
    """WITH n AS (SELECT series, max(idx) + 1 AS n, CAST(floor((max(idx) + 1 - 8) / 24.1 + 1) AS BIGINT) AS k FROM signal GROUP BY series)
       SELECT s.series AS series, s.idx AS idx, CAST(b AS BIGINT) AS batch FROM signal s JOIN n ON s.series = n.series, (SELECT unnest(range(0, 200)) AS b) t WHERE b < k AND idx >= b * 24 AND idx < b * 24 + 32""",
)
def _(v):
    return X.overlapping_batches(v.signal, 32, 8).select("series", "idx", L("batch"))


@book.query(
    "w7_stratified_sample",
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('7-' || CAST(cell_id AS VARCHAR)), cell_id) AS k FROM cells),
       w AS (SELECT label, cell_id, CAST(greatest(0, least(floor(x) - 32, 936)) AS BIGINT) AS x0, CAST(greatest(0, least(floor(y) - 32, 936)) AS BIGINT) AS y0 FROM s WHERE k <= 5)
       SELECT label, cell_id, x0, y0, x0 + 64 AS x1, y0 + 64 AS y1 FROM w""",
)
def _(v):
    return M.crop_around(M.stratified_sample(v.cells, 5, "label", "cell_id", 7), 64, 1000, 1000).select("label", "cell_id", L("x0"), L("y0"), L("x1"), L("y1"))


@book.query("u1_concat_tables", "SELECT cell_id, x, y, 'a' AS sample FROM cells UNION ALL SELECT cell_id, x, y, 'b' FROM targets")
def _(v):
    return S.concat_tables({"a": v.cells.select("cell_id", "x", "y", F.lit(1).alias("only_a")), "b": v.targets.select("cell_id", "y", "x")}, "sample")


@book.query("u1_concat_unique_names", "SELECT CASE WHEN k = 0 THEN name ELSE name || '-' || k END AS name, sample, x FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY sample, x) - 1 AS k FROM (SELECT 'c' || cell_id AS name, 'a' AS sample, x FROM cells UNION ALL SELECT 'c' || cell_id, 'b', x FROM targets))")
def _(v):
    named = lambda df: df.select(F.concat(F.lit("c"), F.col("cell_id").cast("string")).alias("name"), "x")
    return S.concat_tables({"a": named(v.cells), "b": named(v.targets)}, "sample", "name").select("name", "sample", "x")


@book.query("u2_merge_spatial_datasets", "SELECT 'x' || CAST(cell_id AS VARCHAR) AS element, round(x * 0.25 + 1, 5) AS x FROM cells UNION ALL SELECT 'x' || CAST(cell_id AS VARCHAR), round(x, 5) FROM targets WHERE cell_id NOT IN (SELECT cell_id FROM cells)")
def _(v):
    name = lambda df: df.select(F.concat(F.lit("x"), F.col("cell_id").cast("string")).alias("element"), "x")
    return S.merge_elements(name(v.targets), name(v.cells.withColumn("x", F.col("x") * 0.25 + 1))).select("element", R("x"))


@book.query("u3_append_keypoints", "SELECT grp, layer_f, kpt_id, 'sparse' AS origin FROM pairs WHERE is_match UNION ALL SELECT grp, layer_f, kpt_id, 'dense' FROM pairs")
def _(v):
    return S.append_keypoints(v.pairs.where("is_match"), v.pairs).select("grp", "layer_f", "kpt_id", "origin")


@book.query("u4_shared_keypoints", "SELECT c_custkey, CAST(len(list_intersect([c_custkey % 5, c_custkey % 7, c_custkey % 11], [c_custkey % 3, c_custkey % 4])) AS BIGINT) AS shared FROM customer")
def _(v):
    ids = lambda *m: F.array(*[F.col("c_custkey") % k for k in m])
    return M.shared_keypoints(v.customer.select("c_custkey", ids(5, 7, 11).alias("a"), ids(3, 4).alias("b")), "a", "b").select("c_custkey", "shared")


@book.query("k14_greedy_assign", None)
def _(v):
    return M.greedy_assign(v.scores.select(F.col("pair").alias("grp"), F.col("i").alias("f"), F.col("j").alias("m"), (1 - F.col("score")).alias("score"))).select("grp", "f", "m", R("score", 6))


def nearest(side: str, cells: str, x: str, y: str) -> str:
    """SQL: the five nearest keypoints of each cell, with the displacement to them."""
    d = f"sqrt(power(c.x - k.{x}, 2) + power(c.y - k.{y}, 2))"
    return f"{side} AS (SELECT grp, cell_id, id, dx, dy FROM (SELECT c.grp AS grp, c.cell_id AS cell_id, k.id AS id, c.x - k.{x} AS dx, c.y - k.{y} AS dy, row_number() OVER (PARTITION BY c.grp, c.cell_id ORDER BY {d}, k.id) AS r FROM {cells} c JOIN k ON c.grp = k.grp) WHERE r <= 5)"


@book.query(
    "k13_cell_match_candidates",
    f"""WITH k AS (SELECT grp, kpt_id * 4 + layer_f AS id, xf / 1.7e0 AS xf, yf / 1.7e0 AS yf, xf / 1.7e0 + 3 AS xm, yf / 1.7e0 - 2 AS ym FROM pairs),
       {nearest("nf", "cells", "xf", "yf")}, {nearest("nm", "targets", "xm", "ym")}
       SELECT nf.grp AS grp, nf.cell_id AS f, nm.cell_id AS m, count(*) AS shared, round(avg((abs(nf.dx - nm.dx) + abs(nf.dy - nm.dy)) / 2), 5) AS score FROM nf JOIN nm ON nf.grp = nm.grp AND nf.id = nm.id GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
)
def _(v):
    kpts = v.pairs.select("grp", (F.col("kpt_id") * 4 + F.col("layer_f")).alias("id"), (F.col("xf") / 1.7).alias("xf"), (F.col("yf") / 1.7).alias("yf"), (F.col("xf") / 1.7 + 3).alias("xm"), (F.col("yf") / 1.7 - 2).alias("ym"))
    ids = lambda df: df.select("grp", F.col("cell_id").alias("id"), "x", "y")
    return M.cell_match_candidates(ids(v.cells), ids(v.targets), kpts).select("grp", "f", "m", L("shared"), R("score"))


@book.query("a42_type_layer_lists", "SELECT grp, type, list(layer ORDER BY layer) AS layers FROM manifest GROUP BY grp, type")
def _(v):
    return M.type_layer_lists(v.manifest)
