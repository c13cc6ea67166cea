"""The quadtree search for nearest neighbours against brute force, and its work at other densities."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import nearest as N

ROWS = "grp long, id long, x double, y double"


def table(spark, rows):
    return spark.createDataFrame([(g, i, float(x), float(y)) for g, i, x, y in rows], ROWS)


def brute(left, right, k, other=False):
    out = {}
    for g, i, x, y in left:
        own = [(float(np.sqrt((x - p) ** 2 + (y - q) ** 2)), j) for h, j, p, q in right if h == g and not (other and i == j)]
        out.update({(g, i, rank + 1): pair for rank, pair in enumerate(sorted(own)[:k])})
    return out


def found(df):
    return {(r.grp, r.id_a, r.rank): (r.distance, r.id_b) for r in df.collect()}


def equal(got, want):
    return got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def clouds(seed, n):
    """Uniform points, a dense cluster with a far outlier, and a group with few points."""
    rng = random.Random(seed)
    rows = [(1, i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)]
    rows += [(2, 1000 + i, 5 + rng.gauss(0, 1e-3), 7 + rng.gauss(0, 1e-3)) for i in range(n)] + [(2, 5000 + seed, -400.0, 900.0)]
    return rows + [(3, 9000 + i, i, i) for i in range(seed % 3 + 1)]


@pytest.mark.parametrize(("most", "k"), [(512, 5), (8, 3)])
def test_against_brute_force(spark, most, k):
    left, right = clouds(1, 120), clouds(2, 150)
    assert equal(found(N.knn_join(table(spark, left), table(spark, right), k, most=most)), brute(left, right, k))
    assert equal(found(N.knn_join(table(spark, left), table(spark, left), k, other=True, most=most)), brute(left, left, k, True))


def test_many_points_in_one_place(spark):
    rng = random.Random(4)
    right = [(1, i, 3.0, 3.0) for i in rng.sample(range(500), 120)] + [(1, 600 + i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(60)]
    left = [(1, i, 3.0, 3.0) for i in range(90)] + [(1, 700 + i, rng.uniform(0, 9), rng.uniform(0, 9)) for i in range(40)]
    assert equal(found(N.knn_join(table(spark, left), table(spark, right), 4, most=16)), brute(left, right, 4))
    assert equal(found(N.knn_join(table(spark, right), table(spark, right), 4, other=True, most=16)), brute(right, right, 4, True))


def test_odd_points(spark):
    right = [(1, i, float(i), 0.0) for i in range(5)] + [(1, 7, float("nan"), 0.0), (1, 8, float("inf"), 0.0)]
    left = table(spark, [(1, 1, 4.4, 0.0), (1, 2, float("nan"), 1.0), (4, 3, 0.0, 0.0)]).unionByName(spark.createDataFrame([(1, 4, None, 2.0)], ROWS))
    assert found(N.knn_join(left, table(spark, right), 2)).keys() == {(1, 1, 1), (1, 1, 2)}
    assert N.knn_join(left, table(spark, right).where("false"), 2).count() == 0
    assert N.knn_join(left.where("false"), table(spark, right), 2).count() == 0
    one = table(spark, [(1, 1, 2.0, 2.0)])
    assert found(N.knn_join(one, one, 3)) == {(1, 1, 1): (0.0, 1)} and N.knn_join(one, one, 3, other=True).count() == 0


def read_per_point(spark, n):
    """Right points that a left point is compared with, on average."""
    rng = np.random.default_rng(3)
    points = [(1, i, x, y) for i, (x, y) in enumerate(rng.uniform(0, 1000, (n, 2)).tolist())]
    both = table(spark, points).withColumn("is_right", F.lit(True)).unionByName(table(spark, points).withColumn("is_right", F.lit(False)))
    _, nodes = N.quadtree(both, ["grp"], 64)
    pairs = N._found_leaves(nodes, ["grp"], 5)
    sizes = nodes.where("leaf").select("grp", "level", "cx", "cy", "nr")
    return pairs.join(sizes, ["grp", "level", "cx", "cy"]).agg(F.sum(F.col("n") * F.col("nr"))).first()[0] / n


def test_work_per_point_does_not_follow_density(spark):
    thin, dense = read_per_point(spark, 2000), read_per_point(spark, 20_000)
    assert dense < 1.6 * thin and dense < 1500


def test_landmarks_on_a_thousand_by_thousand_grid(spark):
    grid = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).cast("long").alias("grp"), "id", (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"))
    rng = np.random.default_rng(9)
    marks = rng.uniform(0, 999, (10_000, 2))
    got = N.knn_join(table(spark, [(1, i, x, y) for i, (x, y) in enumerate(marks.tolist())]), grid, 1).collect()
    assert len(got) == 10_000
    for r in got:
        x, y = np.rint(marks[r.id_a])
        assert r.id_b == int(y) * 1000 + int(x)


def test_tables_of_squares_are_not_sent_through_the_driver(spark, monkeypatch):
    """Joins with tables that grow with the points are merges, though their files look small."""
    plans, whole = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or whole(df))
    points = spark.range(3000).selectExpr("id % 5 AS grp", "id", "CAST(id * 37 % 101 AS DOUBLE) AS x", "CAST(id * 53 % 103 AS DOUBLE) AS y")
    found = N.knn_join(points, points, 2, most=64)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    met = [p for p in plans if "level" in p and "Join" in p]
    assert met and not any("BroadcastHashJoin" in p for p in met)
    assert found.count() == 6000


def places(seed, n, spots):
    """Points in a few dense places of whole and broken coordinates, far apart."""
    rng = random.Random(seed)
    at = [(rng.randrange(200), rng.randrange(200)) for _ in range(spots)]
    rows = [(1, i, *(a + rng.choice((rng.random(), 0.5, 0.25)) for a in rng.choice(at))) for i in range(n)]
    return rows + [(2, 9000 + i, i % 4, i // 4) for i in range(40)]


def test_a_leaf_sends_only_points_that_can_be_near(spark, monkeypatch):
    right = places(1, 900, 3)
    rng = random.Random(2)
    left = [(1, i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(150)] + [(2, 150 + i, i % 3 + 0.5, i % 5) for i in range(30)]
    sent, whole = [], N._sent_points
    monkeypatch.setattr(N, "SERVED", 3)
    monkeypatch.setattr(N, "_sent_points", lambda *a: sent.append(whole(*a).count()) or whole(*a))
    assert equal(found(N.knn_join(table(spark, left), table(spark, right), 3, most=32)), brute(left, right, 3))
    assert sent[0] < 0.4 * read_in_all(spark, left, right, 4, 32)
    assert equal(found(N.knn_join(table(spark, right), table(spark, right), 3, other=True, most=32)), brute(right, right, 3, True))


def read_in_all(spark, left, right, need, most):
    side = lambda rows, flag: table(spark, rows).withColumn("is_right", F.lit(flag))
    _, nodes = N.quadtree(side(left, False).unionByName(side(right, True)), ["grp"], most)
    sizes = nodes.where("leaf").select("grp", "level", "cx", "cy", "nr")
    return N._found_leaves(nodes, ["grp"], need).join(sizes, ["grp", "level", "cx", "cy"]).agg(F.sum("nr")).first()[0]


def test_points_that_others_beat_in_the_whole_box():
    rng = np.random.default_rng(8)
    for need in (1, 2, 6):
        for _ in range(60):
            x, y = np.round(rng.normal(0, 1, (2, 90)), rng.integers(0, 4))
            x0, y0 = rng.uniform(-4, 4, 2)
            x1, y1 = x0 + rng.uniform(0, 3) * rng.integers(0, 2), y0 + rng.uniform(0, 3)
            kept = N.near_somewhere(x, y, x0, x1, y0, y1, need)
            bx, by = np.append(rng.uniform(x0, x1, 80), [x0, x1]), np.append(rng.uniform(y0, y1, 80), [y1, y0])
            d = np.hypot(bx[:, None] - x, by[:, None] - y)
            limit = np.sort(d, axis=1)[:, need - 1 : need]
            assert not (d[:, ~kept] <= limit).any()  # a tie may be the one that counts
    assert N.near_somewhere(*np.array([np.arange(90.0), np.zeros(90)]), -2.0, -1.0, 0.0, 1.0, 3).sum() == 3


def test_points_that_cannot_count_are_not_counted(spark, monkeypatch):
    """Of points in one place only the lowest ids are counted, and nothing of groups without both sides."""
    rng = random.Random(6)
    right = [(1, i, 3.0, 3.0) for i in rng.sample(range(500), 120)] + [(1, 600 + i, i / 7, i % 5) for i in range(30)] + [(5, 800 + i, i, i) for i in range(60)]
    left = [(1, i, 2.5, rng.uniform(0, 6)) for i in range(20)] + [(6, 900 + i, i, i) for i in range(50)]
    seen, whole = [], N.quadtree

    def counted(points, keys, most):
        told = whole(points, keys, most)
        seen.append((points.where("is_right and grp = 1").count(), {r.grp for r in told[1].select("grp").distinct().collect()}))
        return told

    monkeypatch.setattr(N, "quadtree", counted)
    assert equal(found(N.knn_join(table(spark, left), table(spark, right), 4, most=16)), brute(left, right, 4))
    assert seen == [(34, {1})]


def test_many_boxes_at_once():
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(0, 1, (2, 400)), 2)
    low = rng.uniform(-5, 5, (700, 2))
    high = low + rng.uniform(0, 2, (700, 2))
    for need in (1, 5):
        kept = N.near_somewhere(x, y, low[:, 0], high[:, 0], low[:, 1], high[:, 1], need)
        each = [N.near_somewhere(x, y, a, b, c, d, need) for a, b, c, d in zip(low[:, 0], high[:, 0], low[:, 1], high[:, 1])]
        assert (kept == np.stack(each)).all() and kept.mean() < 0.4
