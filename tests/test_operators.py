"""Operators without SQL, and what SQL does not show: round trips, brute force, plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import classify, fitting, matching, ml, points, raster, regions, spatial
from stratum.sources import tables
from stratum.sources.views import Views


@pytest.fixture(scope="module")
def v(spark, sf_dir):
    return Views(spark, sf_dir)


def cloud(spark, n, seed, offset=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(0, offset + i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(n)], "grp int, id int, x double, y double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_knn_equals_brute_force(spark):
    a, b = cloud(spark, 60, 1), cloud(spark, 90, 2)
    found = {}
    for r in spatial.knn_join(a, b, 4).collect():
        found.setdefault(r.id_a, []).append((r.distance, r.id_b))
    right = [(r.id, r.x, r.y) for r in b.collect()]
    for r in a.collect():
        want = sorted((math.hypot(r.x - x, r.y - y), i) for i, x, y in right)[:4]
        assert [i for _, i in sorted(found[r.id])] == [i for _, i in want]


def test_knn_of_far_and_sparse_points(spark):
    schema = "grp int, id int, x double, y double"
    right = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(10)], schema)
    left = spark.createDataFrame([(0, 1, 500.0, 0.0), (0, 2, -3e6, 4e6), (0, 3, 4.0, 1.0), (0, 4, None, 1.0), (0, 5, float("nan"), 1.0), (9, 6, 1.0, 1.0)], schema)
    found = {}
    for r in spatial.knn_join(left, right, 2).orderBy("id_a", "rank").collect():
        found.setdefault(r.id_a, []).append(r.id_b)
    assert found == {1: [9, 8], 2: [0, 1], 3: [4, 3]}


def test_knn_with_fewer_points_than_k_and_empty_side(spark):
    a, b = cloud(spark, 5, 1), cloud(spark, 2, 2)
    assert spatial.knn_join(a, b, 4).count() == 10
    assert spatial.radius_join(a, b.where("false"), 50.0).count() == 0


def test_spatial_joins_never_compare_all_pairs(spark):
    a, b = cloud(spark, 60, 1), cloud(spark, 90, 2)
    for df in (spatial.radius_join(a, b, 5.0), spatial.knn_within(a, b, 2, 5.0)):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_affine_round_trip_and_parameters(spark, v):
    m = points.params_to_matrix(v.transforms)
    back = points.transform_points(points.transform_points(v.points, m.where("step = 0")), points.invert_matrix(m.where("step = 0")))
    met = back.alias("a").join(v.points.alias("b"), ["grp", "layer", "kpt_id"]).select(F.max(F.abs(F.col("a.x") - F.col("b.x")) + F.abs(F.col("a.y") - F.col("b.y"))).alias("d")).first()
    assert met.d < 1e-6
    again = points.params_to_matrix(points.matrix_to_params(m, ["grp", "layer", "step"])).alias("p").join(m.alias("m"), ["grp", "layer", "step"])
    assert again.select(F.max(sum(F.abs(F.col(f"p.{c}") - F.col(f"m.{c}")) for c in "abcdef")).alias("d")).first().d < 1e-6


def test_normal_and_pixel_matrices_undo_each_other(v):
    m = points.params_to_matrix(v.transforms).withColumns({"width": F.lit(640.0), "height": F.lit(480.0)})
    back = points.to_normal_matrix(points.to_pixel_matrix(m)).alias("p").join(m.alias("m"), ["grp", "layer", "step"])
    assert back.select(F.max(sum(F.abs(F.col(f"p.{c}") - F.col(f"m.{c}")) for c in "abcdef")).alias("d")).first().d < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_cumulative_orientation_is_the_matrix_product(spark, seed):
    rng = random.Random(seed)
    rows = [(0, i, 45.0 * rng.randrange(8), rng.randrange(2), rng.randrange(2)) for i in range(12)]
    found = {r.layer: r for r in matching.cumulative_orientation(spark.createDataFrame(rows, "grp int, layer int, angle double, flip_x int, flip_y int")).collect()}

    def matrix(angle, fx, fy):
        t = math.radians(angle)
        return np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) @ np.diag([-1 if fx else 1, -1 if fy else 1])

    total = np.eye(2)
    for _, layer, angle, fx, fy in rows:
        total = total @ matrix(angle, fx, fy)
        r = found[layer]
        assert np.allclose(total, matrix(r.angle, r.flip_x, r.flip_y), atol=1e-9)


def test_greedy_assignment_equals_one_by_one(spark):
    rng = random.Random(3)
    rows = [(0, f, m, rng.random()) for f in range(25) for m in rng.sample(range(20), 6)]
    taken, want = set(), {}
    for f in range(25):
        free = sorted((s, m) for _, ff, m, s in rows if ff == f and m not in taken)
        if free:
            want[f] = free[0][1]
            taken.add(free[0][1])
    found = {r.f: r.m for r in matching.greedy_assign(spark.createDataFrame(rows, "grp int, f int, m int, score double")).collect()}
    assert found == want


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    root = list(range(200))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    found = {r.node: r.comp for r in regions.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert found and all(find(n) == c for n, c in found.items())
    assert set(found) == {n for e in edges if e[0] != e[1] for n in e}


def test_grid_sample_of_the_identity_is_the_image(spark, v):
    zero = v.field.withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0)})
    out = raster.warp_displacement(v.pixels, zero, 32, 32).alias("a").join(v.pixels.alias("b"), ["image_id", "channel", "y", "x"])
    row = out.agg(F.count("*").alias("n"), F.max(F.abs(F.col("a.v") - F.col("b.v"))).alias("d")).first()
    assert row.n == v.pixels.count() and row.d < 1e-9


def test_displacement_fit_finds_a_local_shift(spark):
    rows = [(0, i, 8.0 * (i % 50), 8.0 * (i // 50), 8.0 * (i % 50) - (5 if i % 50 > 25 else 0), 8.0 * (i // 50)) for i in range(2500)]
    pairs = spark.createDataFrame(rows, "grp int, kpt_id int, xf double, yf double, xm double, ym double")
    cells = {(r.i, r.j): r.dx for r in fitting.displacement_fit(pairs, ["grp"], 400, 8).collect()}
    left = np.mean([cells[i, 2] for i in range(8)])
    right = np.mean([cells[i, 4] for i in range(8)])
    assert right - left > 0.5


def test_stale_tree_keys_are_ignored(spark):
    row = {m: 0.0 for m in classify.tree_markers()} | {"cell_id": 1, "ITGAX": 0.9, "HLA-DRA": 0.9}
    df = spark.createDataFrame([row])
    assert classify.classify(df, {22: 0.99}).first().cell_type == "Dendritic Cell"
    assert classify.classify(df, {21: 0.95}).first().cell_type == "Undefined"


def test_leaf_distances_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(70, 2))
    df = spark.createDataFrame([(int(i % 2), int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "leaf int, cell_id int, p double, q double")
    for r in classify.leaf_distances(df, ["leaf"], ["p", "q"], block=8).collect():
        own = x[r.leaf :: 2]
        d = [np.linalg.norm(own[i] - own[j]) for i in range(len(own)) for j in range(i)]
        assert r.n == len(own) and abs(r.mean_distance - np.mean(d)) < 1e-9


def test_sources(spark, tmp_path, v):
    assert tables.read_landmarks(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "m.csv").write_text(",project,group,sample,group_idx,type\n0,p,g,s0,0,HE\n1,p,g,s1,1,P1\n")
    assert [tuple(r) for r in tables.select_group(tables.read_manifest(spark, str(tmp_path / "m.csv")), "p", "g").orderBy("layer").collect()] == [("p", "g", "s0", 0, "HE"), ("p", "g", "s1", 1, "P1")]
    levels = v.pixels.withColumn("level", F.lit(0))
    tables.write_raster(levels, str(tmp_path / "r"))
    scan = tables.read_raster(spark, str(tmp_path / "r"), 0, 0, [1])
    assert scan.count() == 1024 and "PartitionFilters" in plan(scan)
    with pytest.raises(ValueError):
        tables.layer_lookup(v.points, v.manifest.where("layer < 2"), required=True)


def test_knn_graph_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([c + 0.3 * rng.normal(size=(40, 16)) for c in centres])  # 20 cells of 8 probes
    rows = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in enumerate(x)], "id long, features array<double>")
    found = {(r.src, r.dst) for r in ml.knn_graph(rows, 5).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-score, axis=1)[:, :5]) for j in row}
    assert len(found) == len(want) and len(found & want) / len(want) >= 0.9
    few = {(r.src, r.dst) for r in ml.knn_graph(rows.where("id < 200"), 5).collect()}  # no more cells than probes: exact
    assert few == {(i, int(j)) for i, row in enumerate(np.argsort(-score[:200, :200], axis=1)[:, :5]) for j in row}


def test_region_signal_says_why_a_shape_has_none(spark):
    pixels = spark.createDataFrame([(0, 0, y, x, float(x)) for y in range(10) for x in range(10)], "grp long, channel long, y long, x long, v double")
    box = lambda i, a, b, c, d: (0, i, [(a, b), (c, b), (c, d), (a, d)])
    shapes = spark.createDataFrame([box(1, 0.0, 0.0, 40.0, 40.0), box(2, 500.0, 0.0, 540.0, 40.0), box(3, 0.0, 0.0, 5.0, 5.0), box(4, 6.0, 6.0, 30.0, 14.0)], "grp long, shape_id long, ring array<struct<x:double,y:double>>")
    rows = {r.shape_id: r for r in regions.region_signal(pixels, shapes, 10.0, 10, 10).collect()}
    assert rows[1].mean == 1.5 and rows[1].reason is None and rows[1].area is None
    assert [rows[i].reason for i in (2, 3, 4)] == ["outside", "small", "empty"]
    alone = regions.region_signal(pixels, shapes.where("shape_id = 1"), 10.0, 10, 10).first()
    assert alone.area == 1600.0


def test_points_on_an_edge_intersect_but_are_not_within(spark):
    shapes = spark.createDataFrame([(0, 7, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])], "grp int, shape_id int, ring array<struct<x:double,y:double>>")
    at = spark.createDataFrame([(0, 1, 5.0, 5.0), (0, 2, 10.0, 5.0), (0, 3, 0.0, 0.0), (0, 4, 10.5, 5.0)], "grp int, id int, x double, y double")
    ids = lambda predicate: {r.id for r in spatial.point_in_polygon(at, shapes, 4.0, predicate=predicate).collect()}
    assert ids("within") == {1} and ids("intersects") == {1, 2, 3}
    with pytest.raises(ValueError):
        ids("near")


def test_simplified_rings(spark):
    ring = [(0.0, 0.0), (5.0, 0.1), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    shapes = spark.createDataFrame([(0, 7, ring), (0, 8, [(0.0, 0.0), (0.1, 0.0), (0.0, 0.1)])], "grp int, shape_id int, ring array<struct<x:double,y:double>>")
    found = {r.shape_id: [tuple(p) for p in r.ring] for r in spatial.simplified(shapes, 0.5).collect()}
    assert found[7] == [ring[0], *ring[2:]] and len(found[8]) == 3


def test_holes_and_largest_foreground(spark):
    art = ["#####...", "#...#...", "#.#.#..#", "#...#...", "#####..."]
    mask = spark.createDataFrame([(0, y, x, int(c == "#")) for y, line in enumerate(art) for x, c in enumerate(line)], "image_id long, y long, x long, v int")
    holes = {(r.y, r.x) for r in regions.inner_holes(mask, 5, 8).collect()}
    assert holes == {(y, x) for y in (1, 2, 3) for x in (1, 2, 3)} - {(2, 2)}
    kept = {(r.y, r.x) for r in regions.keep_largest_foreground(mask.withColumn("v", 1 - F.col("v"))).where("v = 0").collect()}
    assert kept == {(y, x) for y, line in enumerate(art) for x, c in enumerate(line) if c == "#"} - {(2, 2), (2, 7)}


def test_large_canvas_is_dealt_out_in_tiles(spark):
    one = spark.createDataFrame([(0, 0)], "image_id long, channel long")
    big = raster.canvas(one, 600, 300)
    assert big.count() == 180_000 and big.select("ty", "tx").distinct().count() == 180_000
    assert big.rdd.getNumPartitions() > 1


def test_shapes_test_points_in_bounded_groups(spark, monkeypatch):
    """Bands and polygons against all pairs, with portions of a few points, repeated corners and many shapes in one place."""
    from stratum.operators import spatial

    monkeypatch.setattr(spatial, "PAIRS", 40)
    rng = np.random.default_rng(3)
    hexagon = [(4.0, 0.0), (2.0, 3.0), (-2.0, 3.0), (-4.0, 0.0), (-2.0, -3.0), (-2.0, -3.0), (2.0, -3.0)]  # a corner stands twice
    rings = {i: [(x + float(cx), y + float(cy)) for x, y in hexagon] for i, (cx, cy) in enumerate(rng.uniform(0, 12, (9, 2)))}
    at = {i: (float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 15, (200, 2)))}
    points = spark.createDataFrame([(1, i, x, y, "l") for i, (x, y) in at.items()], "grp long, id long, x double, y double, label string")
    shapes = spark.createDataFrame([(1, i, [{"x": x, "y": y} for x, y in r]) for i, r in rings.items()], "grp long, shape_id long, ring array<struct<x: double, y: double>>")
    told = {(p, s): spatial.side_tests(np.array([at[p][0]]), np.array([at[p][1]]), np.array([c for k, c in enumerate(rings[s]) if k != 5])) for p in at for s in rings}
    inside = {k: bool(v[0][0]) for k, v in told.items()}
    edge = {k: float(v[1][0]) for k, v in told.items()}
    for predicate in ("within", "intersects"):
        got = {r.id: r.shape_id for r in spatial.point_in_polygon(points, shapes, 5.0, predicate=predicate).collect()}
        assert got == {p: max(s for s in rings if inside[p, s]) for p in at if any(inside[p, s] for s in rings)}
    got = {(r.id, r.shape_id, r.band): r.edge_distance for r in spatial.ring_join(points, shapes, 1.0, 5.0).collect()}
    want = {(p, s, "inner" if inside[p, s] else "outer"): d for (p, s), d in edge.items() if d <= 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    last = spatial.shape_tests(points, shapes, 5.0, ("grp",), 1.0, spatial.bands_of(1.0), last=True).groupBy("id", "test").agg(F.max("shape_id").alias("s"), F.count("*").alias("n")).collect()
    assert {(r.id, r.test): r.s for r in last} == {(p, b): max(s for q, s, c in want if (q, c) == (p, b)) for p, _, b in want} and all(r.n == 1 for r in last)


def test_joins_within_a_radius_and_of_boxes_make_no_row_per_candidate(spark):
    from stratum.operators import spatial

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    a = spark.createDataFrame([(1, i, float(i % 20), float(i // 20)) for i in range(400)], "grp long, id long, x double, y double")
    near = spatial.knn_within(a, a, 3, 4.0, other=True)
    assert "FlatMapCoGroupsInArrow" in plan(near)  # the nearest are chosen inside groups
    assert near.where("distance > 4 or rank > 3 or id_a = id_b").count() == 0 and near.count() == 1200
    boxes = a.select("grp", F.col("id").alias("box_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 1.5).alias("x1"), (F.col("y") + 1.5).alias("y1"))
    pairs = spatial.box_iou(boxes, 0.7)
    assert "Aggregate" not in plan(pairs)  # no pair stands twice, so none is shuffled
    assert pairs.count() == pairs.select("i", "j").distinct().count() == 2 * 20 * 19 + 2 * 19 * 19


def test_equal_cells_count_once_with_their_number(spark, monkeypatch):
    """Leaf distances and threshold search see each distinct row of markers once, however often it stands."""
    rows = [(i, 1, float(i % 3), float(i % 5) / 7) for i in range(90)]
    df = spark.createDataFrame(rows, "cell_id long, leaf int, p double, q double")
    assert classify.counted(df, ["p", "q"], ["leaf"]).count() == 15
    got = classify.leaf_distances(df, ["leaf"], ["p", "q"], block=4).collect()
    brute = [math.dist(a[2:], b[2:]) for i, a in enumerate(rows) for b in rows[:i]]
    assert [r.n for r in got] == [90] and got[0].mean_distance == pytest.approx(sum(brute) / len(brute), abs=1e-12)
    cells = spark.createDataFrame([(i, *[(i % 4 * (j + 3)) % 7 / 7 for j in range(len(set(classify.tree_markers())))]) for i in range(200)], ["cell_id", *dict.fromkeys(classify.tree_markers())])
    told, whole = [], classify.leaf_distances
    monkeypatch.setattr(classify, "leaf_distances", lambda df, *rest: told.append(df.count()) or whole(df, *rest))
    assert classify.threshold_search(cells, 2, 2).count() == 2 and told == [4 * 2 * 2]  # 4 different rows in each trial


def test_zscore_does_not_fall_below_a_whole_value(spark):
    """A layer that is the reference itself keeps its values, whatever the last digits of the sums."""
    rows = [(im, 0, y, x, float((7 * x + 13 * y) % 251)) for im in (0, 1) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "image_id long, channel long, y long, x long, v double")
    assert {(r.y, r.x): r.v for r in raster.zscore(df, 0).where("image_id = 1").collect()} == {(y, x): v for im, _, y, x, v in rows if im}


def test_a_centre_on_the_edge_belongs_to_one_of_two_regions(spark):
    """As in the SQL of k10: a centre counts where the ray to the right crosses an odd number of sides."""
    from stratum.operators import regions

    pixels = spark.createDataFrame([(0, 0, y, x, float(10 * y + x)) for y in range(8) for x in range(8)], "grp long, channel long, y long, x long, v double")
    box = lambda x0, x1: [{"x": x0, "y": 1.0}, {"x": x1, "y": 1.0}, {"x": x1, "y": 4.0}, {"x": x0, "y": 4.0}]
    shapes = spark.createDataFrame([(0, 1, box(0.0, 2.5)), (0, 2, box(2.5, 5.0))], "grp long, shape_id long, ring array<struct<x: double, y: double>>")
    means = {r.shape_id: r.mean for r in regions.region_signal(pixels, shapes, 1.0, 8, 8).collect()}
    assert means == {1: 20.5, 2: 23.0}  # the column x = 2 belongs to the right one


def test_descriptors_are_summed_whole(spark):
    """The four corners of a point meet as rows of whole descriptors, not a row per component."""
    cells = spark.createDataFrame([(0, y, x, [float(y + 1), float(x + 2), 3.0]) for y in range(3) for x in range(3)], "image_id long, y long, x long, features array<float>")
    at = spark.createDataFrame([(0, 7, 7.5, 7.5)], "image_id long, id long, x double, y double")
    found = raster.descriptor_sample(at, cells, 4)
    assert "posexplode" not in plan(found)
    want = [2.5, 3.5, 3.0]  # the mean of the cells at y and x of 1 and 2
    assert found.collect()[0].features == pytest.approx([w / math.dist(want, [0, 0, 0]) for w in want], abs=1e-12)


def test_cells_meet_once_and_their_pairs_are_not_shuffled(spark):
    rng = random.Random(6)
    spot = lambda n, at: [(g, at + i, rng.uniform(0, 30), rng.uniform(0, 30)) for g in range(2) for i in range(n)]
    ddl = "grp long, id long, x double, y double"
    fixed, moving, keys = spot(40, 0), spot(50, 100), spot(14, 500)[:17]  # the second group has three keypoints only
    kpts = spark.createDataFrame([(g, i, x, y, x + 1.0, y - 2.0) for g, i, x, y in keys], "grp long, id long, xf double, yf double, xm double, ym double")

    def nearest(cells, dx, dy):
        out = {}
        for g, i, x, y in cells:
            own = sorted((math.hypot(x - p - dx, y - q - dy), j, x - p - dx, y - q - dy) for h, j, p, q in keys if h == g)
            out[g, i] = {j: (a, b) for _, j, a, b in own[:5]}
        return out

    want = {}
    for (g, f), a in nearest(fixed, 0, 0).items():
        for (h, m), b in nearest(moving, 1.0, -2.0).items():
            both = a.keys() & b.keys()
            if g == h and len(both) >= 3:
                want[g, f, m] = (len(both), sum(abs(a[j][0] - b[j][0]) + abs(a[j][1] - b[j][1]) for j in both) / 2 / len(both))
    met = matching.cell_match_candidates(spark.createDataFrame(fixed, ddl), spark.createDataFrame(moving, ddl), kpts)
    rows = met.collect()
    got = {(r.grp, r.f, r.m): (r.shared, r.score) for r in rows}
    assert len(got) == len(rows) and got.keys() == want.keys() and {g for g, _, _ in got} == {0, 1}
    assert all(got[p][0] == want[p][0] and got[p][1] == pytest.approx(want[p][1], abs=1e-9) for p in want)
    assert "Exchange" not in plan(met).split("SortMergeJoin")[0] and "Aggregate" not in plan(met).split("SortMergeJoin")[0].replace("AdaptiveSparkPlan", "")


def test_cells_with_equal_lists_meet_once(spark):
    """A hundred cells whose nearest keypoints are the same are a few rows until their pairs are made."""
    rng = random.Random(11)
    kpts = [(0, 10 * p + i, 100.0 * p + rng.random(), rng.random()) for p in range(3) for i in range(5)]
    cells = lambda shift: [(0, i + shift, 100.0 * (i % 3) + rng.uniform(-20, 20), rng.uniform(5, 20)) for i in range(300)]
    fixed, moving = cells(0), cells(1000)
    ddl = "grp long, id long, x double, y double"
    marks = spark.createDataFrame([(*r, r[2] + 0.5, r[3] - 0.25) for r in kpts], "grp long, id long, xf double, yf double, xm double, ym double")
    sides = spark.createDataFrame(fixed, ddl), spark.createDataFrame(moving, ddl)
    assert matching._lists_met(*sides, marks, 5, 3, ["grp"]).count() == 3 * 2 * 2  # portions of 64 and 36 cells
    rows = {(r.f, r.m): r for r in matching.cell_match_candidates(*sides, marks).collect()}
    assert rows.keys() == {(i, j + 1000) for i in range(300) for j in range(300) if i % 3 == j % 3}
    for (f, m), r in list(rows.items())[::997]:
        (_, _, xf, yf), (_, _, xm, ym) = fixed[f], moving[m - 1000]
        own = [(x, y) for _, i, x, y in kpts if i // 10 == f % 3]
        want = sum((abs((xf - x) - (xm - x - 0.5)) + abs((yf - y) - (ym - y + 0.25))) / 2 for x, y in own) / 5
        assert r.shared == 5 and r.score == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("inclusive", [True, False])
def test_radius_join_shuffles_no_row_per_bucket(spark, monkeypatch, inclusive):
    """Pairs as by brute force (on borders of squares, below zero, in full blocks); a left point goes to 2.25 squares, not 9 buckets."""
    rng = random.Random(12)
    spot = lambda n, at: [(g, at + i, 5.0 * rng.randint(-20, 20), 5.0 * rng.randint(-20, 20)) if i % 3 else (g, at + i, rng.uniform(-100, 100), rng.uniform(-100, 100)) for g in range(2) for i in range(n)]
    left, right = spot(300, 0), spot(200, 1000) + [(0, 2000 + i, 4.0, 4.0 + i / 100) for i in range(40)]
    ddl = "grp long, id long, x double, y double"
    odd = [(0, 3000, math.nan, 1.0), (0, 3001, math.inf, 1.0), (0, 3002, None, 1.0)]
    sent, whole = [], spatial.spread_out
    monkeypatch.setattr(spatial, "HELD", 16, raising=False)
    monkeypatch.setattr(spatial, "spread_out", lambda df, *by, **how: sent.append(df.count()) or whole(df, *by, **how))
    met = spatial.radius_join(spark.createDataFrame(left + odd, ddl), spark.createDataFrame(right + odd, ddl), 10.0, inclusive=inclusive)
    shuffles = plan(met).count("Exchange hashpartitioning")
    near = lambda d: d <= 10.0 if inclusive else d < 10.0
    want = {(g, i, j): d for g, i, x, y in left for h, j, p, q in right if g == h and near(d := math.sqrt((x - p) ** 2 + (y - q) ** 2))}
    rows = met.collect()
    assert {(r.grp, r.id_a, r.id_b): r.distance for r in rows} == want and len(rows) == len(want)
    assert max(sent) < 2.6 * len(left) and shuffles == 2


def test_radius_join_of_equal_places(spark):
    a = spark.createDataFrame([(0, 1, 2.5, 3.0), (0, 2, -1.0, 0.0)], "grp long, id long, x double, y double")
    assert [(r.id_a, r.id_b) for r in spatial.radius_join(a, a, 0.0, inclusive=True).orderBy("id_a").collect()] == [(1, 1), (2, 2)]
