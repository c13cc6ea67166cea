"""Raster levels and their sink; tables put below each other."""

import numpy as np
from pyspark.sql import functions as F

from stratum.sources import tables as S


def image(spark, h=50, w=83):
    a = np.random.default_rng(0).integers(0, 256, (h, w)).astype(float)
    rows = [(i, 0, y, x, float(v) + i) for i in (1, 2) for (y, x), v in np.ndenumerate(a)]
    return a, spark.createDataFrame(rows, "image_id long, channel long, y long, x long, v double")


def test_levels_are_block_means(spark):
    a, pixels = image(spark)
    got = {}
    for r in S.downsampled(pixels, 50, 83, (1, 4, 8, 40)).collect():
        got.setdefault((r.image_id, r.level), {})[r.y, r.x] = r.v
    for f in (1, 4, 8, 40):
        h, w = 50 // f, 83 // f
        want = a[: h * f, : w * f].reshape(h, f, w, f).mean(axis=(1, 3))
        for i in (1, 2):
            assert got[i, f].keys() == set(np.ndindex(h, w))
            assert all(abs(v - want[k] - i) < 1e-9 for k, v in got[i, f].items())


def test_writing_again_replaces_an_image_only(spark, tmp_path):
    _, pixels = image(spark)
    levels, folder = S.downsampled(pixels, 50, 83, (1, 4)), str(tmp_path / "raster")
    S.write_raster(levels, folder)
    before = S.read_raster(spark, folder).count()
    for _ in range(2):
        S.write_raster(levels.where("image_id = 2 and level = 4").withColumn("v", F.lit(7.0)), folder)
    assert S.read_raster(spark, folder).count() == before
    assert {r.v for r in S.read_raster(spark, folder, 2, 4).collect()} == {7.0}
    assert 7.0 not in {r.v for r in S.read_raster(spark, folder, 1, 4).collect()}
    plan = S.read_raster(spark, folder, 2, 4)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "image_id" in filters and "level" in filters


def test_names_that_come_again(spark):
    rows = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, v int")
    got = S.concat_tables({"b": rows("x", "y"), "a": rows("x", "x", None)}, "label", "name").collect()
    assert sorted((r.label, r.v, r.name) for r in got if r.name is not None) == [("a", 0, "x"), ("a", 1, "x-1"), ("b", 0, "x-2"), ("b", 1, "y")]
