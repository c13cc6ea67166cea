"""Registered queries of cell typing, embeddings and plugins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import plugins
from ..operators import classify as C
from ..operators import metrics as Q
from ..operators import ml
from ..operators import points as P
from ..operators import spatial as K
from ..sources.views import Book
from .matching import DESCRIPTOR_MATCHES

book = Book()
QUERIES, SQL = book.queries, book.sql
R = lambda c, n=5: F.round(c, n).alias(c)
L = lambda c: F.col(c).cast("long").alias(c)
MARKERS = list(dict.fromkeys(C.tree_markers()))
PRIMES = [7919, 104729, 1299709, 15485863, 32452843, 49979687, 67867967, 86028121, 104395301, 122949823, 141650939, 160481183, 179424673, 198491317, 217645177, 236887691]


def marker_cells(v):
    return v.part.select(F.col("p_partkey").alias("cell_id"), *[((F.col("p_partkey") * PRIMES[i]) % 101 / 101).alias(m) for i, m in enumerate(MARKERS)])


def tree_sql(cut) -> str:
    nodes = {n: (name, yes, no) for n, name, yes, no in C.MARKER_TREE}
    walk = lambda n: f"'{nodes[n][0]}'" if nodes[n][1] is None else f"CASE WHEN CAST((p_partkey * {PRIMES[MARKERS.index(nodes[n][0])]}) % 101 / 101e0 AS FLOAT) > CAST({cut(n)} AS DOUBLE) THEN {walk(nodes[n][1])} ELSE {walk(nodes[n][2])} END"
    return walk(0)


@book.query("c1_marker_tree_classify", f"SELECT p_partkey AS cell_id, {tree_sql(lambda n: 0.3)} AS cell_type FROM part")
def _(v):
    return C.classify(marker_cells(v)).select("cell_id", "cell_type")


SETS = [{f"t_{n}": 0.1 * ((n + s) % 7 + 1) for n in range(30)} for s in range(6)]
TYPES = sorted(name for _, name, yes, _ in C.MARKER_TREE if yes is None)


@book.query(
    "c2_tree_ensemble_vote",
    "WITH t AS (" + " UNION ALL ".join(f"SELECT p_partkey AS cell_id, {tree_sql(lambda n, s=s: s[f't_{n}'])} AS label FROM part" for s in SETS) + ") SELECT cell_id, " + ", ".join(f"""count(*) FILTER (WHERE label = '{t}') AS "{t}" """ for t in TYPES) + " FROM t GROUP BY cell_id",
)
def _(v):
    return C.ensemble_votes(marker_cells(v), SETS)


@book.query("a19_vote_matrix", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
def _(v):
    return C.vote_matrix(v.orders.select("o_custkey", F.col("o_orderstatus").alias("label")), "o_custkey")


@book.query(
    "a39_tree_quality",
    """WITH c AS (SELECT cell_id, m1, m2, m3, CASE WHEN m1 > 0.3 THEN CASE WHEN m2 > 0.3 THEN 3 ELSE 4 END ELSE 2 END AS leaf FROM markers),
       d AS (SELECT a.leaf AS leaf, avg(sqrt(power(a.m1 - b.m1, 2) + power(a.m2 - b.m2, 2) + power(a.m3 - b.m3, 2))) AS d FROM c a JOIN c b ON a.leaf = b.leaf AND a.cell_id < b.cell_id GROUP BY a.leaf)
       SELECT round(count(*) / 3, 5) AS coverage, round(avg(1 - d / sqrt(3)), 5) AS purity FROM d""",
)
def _(v):
    leaf = F.when(F.col("m1") > 0.3, F.when(F.col("m2") > 0.3, 3).otherwise(4)).otherwise(2)
    cells = v.markers.withColumns({"leaf": leaf, "one": F.lit(1)})
    return C.tree_quality(cells, ["one"], ["m1", "m2", "m3"], 3, F.lit(0.0)).select(R("coverage"), R("purity"))


@book.query("c3_threshold_search")
def _(v):
    return C.threshold_search(marker_cells(v), 10, 30).select(L("tree"), L("trial"), R("score", 6))


@book.query("a31_pca_project")
def _(v):
    return ml.to_rgb(ml.pca_project(v.descriptors, 3)).select("image", "id", F.transform("projection", lambda x: F.round(x, 4)).alias("projection"), "rgb")


@book.query("a32_kmeans_label")
def _(v):
    return ml.kmeans_labels(v.descriptors, [4, 8]).select("image", "id", "kmeans_4", "kmeans_8")


@book.query("a33_knn_graph_communities")
def _(v):
    rows = ml.standardized(v.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("features")))
    reduced = ml.pca_project(rows, 16).select("id", F.col("projection").alias("features"))
    told = None
    for k in (5, 10):  # fewer neighbours make more and smaller communities
        one = ml.propagated_labels(ml.knn_graph(reduced, k)).select("node", "label", F.lit(k).alias("neighbours"))
        told = one if told is None else told.unionByName(one)
    return told


@book.query("a45_ssim")
def _(v):
    met = Q.image_pairs(v.pixels.withColumn("v", F.col("v") / 255))
    return ml.ssim(met, 32, 32).select("image_id", R("loss"))


@book.query("r12_batch_embed", "SELECT image_id, y AS ty, CAST(0 AS BIGINT) AS tx, round(avg(v), 7) AS mean FROM pixels WHERE channel = 0 AND y % 4 <> 1 GROUP BY 1, 2")
def _(v):
    tiles = v.pixels.where("channel = 0").groupBy("image_id", F.col("y").alias("ty"), F.lit(0).cast("long").alias("tx")).agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("s")).select("image_id", "ty", "tx", F.transform("s", lambda p: p["v"]).alias("data"))
    model = lambda f: f[["image_id", "ty", "tx"]].assign(mean=[round(float(sum(d) / len(d)), 7) for d in f["data"]])
    return ml.batch_embed(tiles, model, "image_id long, ty long, tx long, mean double", tiles.where("ty % 4 = 1"))


@book.query(
    "k18_patch_assignment_join",
    """WITH p AS (SELECT image_id, c_custkey AS id, c_mktsegment AS label, CAST(round_even((c_custkey * 7 % 60) * 0.5e0 + 1, 0) AS BIGINT) AS cx, CAST(round_even((c_custkey * 11 % 60) * 0.5e0 + 1, 0) AS BIGINT) AS cy FROM visitors)
       SELECT p.image_id AS image_id, id, label, channel, round(avg(v), 5) AS mean FROM p JOIN pixels q ON p.image_id = q.image_id AND abs(q.x - cx) <= 2 AND abs(q.y - cy) <= 2 GROUP BY 1, 2, 3, 4""",
)
def _(v):
    at = v.visitors.select("image_id", F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), (F.col("c_custkey") * 7 % 60).alias("x"), (F.col("c_custkey") * 11 % 60).alias("y"))
    matrix = at.select("image_id").distinct().withColumns({k: F.lit(x) for k, x in zip("abcdef", (0.5, 0.0, 1.0, 0.0, 0.5, 1.0))})
    moved = P.transform_points(at, matrix, ("image_id",))
    return K.patch_mean(moved, v.pixels, 2, 32, 32).join(at.select("image_id", "id", "label"), ["image_id", "id"]).select("image_id", "id", "label", "channel", R("mean"))


@book.query("f1_detector_plugin", DESCRIPTOR_MATCHES)
def _(v):
    side = lambda n: v.descriptors.where(F.col("image") == n).select(F.lit(0).cast("long").alias("pair"), "id", "features")
    return plugins.detect("descriptors", side(0), side(1), threshold=0.1).select("pair", "i", L("j"), R("score"))


@book.query("f2_deform_plugin", "SELECT grp, layer, kpt_id, round(x + 2 * y + 1, 4) AS x, round(y - 3, 4) AS y FROM points")
def _(v):
    m = v.manifest.select("grp", "layer").withColumns({k: F.lit(x) for k, x in zip("abcdef", (1.0, 2.0, 1.0, 0.0, 1.0, -3.0))})
    return plugins.deform("affine", v.points, m).select("grp", "layer", "kpt_id", R("x", 4), R("y", 4))


@book.query("f3_loss_plugin", "SELECT a.image_id AS image_id, round(0.5 * avg(abs(a.v - b.v)) + 2 * avg(power(a.v - b.v, 2)) - corr(a.v, b.v), 4) AS loss FROM pixels a JOIN pixels b ON b.image_id = a.image_id + 1 AND a.channel = b.channel AND a.y = b.y AND a.x = b.x GROUP BY 1")
def _(v):
    return plugins.weighted_loss(Q.image_pairs(v.pixels), {"l1": 0.5, "l2": 2.0, "ncc": 1.0}).select("image_id", R("loss", 4))


