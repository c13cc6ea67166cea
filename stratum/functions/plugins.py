"""Plugins by name: keypoint detectors, deformation models, losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fitting, matching, points, raster

DETECTORS: dict[str, Callable] = {}
DEFORMATIONS: dict[str, Callable] = {}
LOSSES: dict[str, Callable[[], Column]] = {}


def detector(name: str):
    """Registers a function (image table a, image table b, keys) -> match rows."""
    return lambda f: DETECTORS.setdefault(name, f)


def deformation(name: str):
    """Registers a function (points, parameter table, keys) -> moved points."""
    return lambda f: DEFORMATIONS.setdefault(name, f)


def loss(name: str):
    """Registers a function () -> aggregate Column over pairs of values a, b."""
    return lambda f: LOSSES.setdefault(name, f)


@detector("descriptors")
def _descriptors(a: DataFrame, b: DataFrame, keys, threshold: float = 0.0) -> DataFrame:
    return matching.descriptor_matches(a, b, threshold, keys)


def user_detector(match: Callable, schema: str) -> Callable:
    """A detector from a function of two pandas frames, run per image pair."""
    return lambda a, b, keys, **_: a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(match, schema)


@deformation("affine")
def _affine(rows: DataFrame, params: DataFrame, keys, **_) -> DataFrame:
    return points.transform_points(rows, params, keys)


@deformation("cells")
def _cells(rows: DataFrame, params: DataFrame, keys, size: float, grid: int) -> DataFrame:
    return fitting.apply_cells(rows, params, list(keys), size, grid)


@deformation("bspline")
def _bspline(rows: DataFrame, params: DataFrame, keys, spacing: float, height: int, width: int) -> DataFrame:
    field = raster.bspline_field(params, spacing, height, width)
    met = rows.withColumns({"_y": F.floor("y"), "_x": F.floor("x")}).join(field.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "dx", "dy"), ["image_id", "_y", "_x"], "left")
    return met.withColumns({"x": F.col("x") + F.coalesce("dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("dy", F.lit(0.0))}).select(*rows.columns)


loss("l1")(lambda: F.avg(F.abs(F.col("a") - F.col("b"))))
loss("l2")(lambda: F.avg((F.col("a") - F.col("b")) ** 2))
loss("ncc")(lambda: F.when((F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0), F.lit(1.0)).otherwise(-F.corr("a", "b")))
loss("cosine")(lambda: 1 - F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") ** 2) * F.sum(F.col("b") ** 2)))


def _named(registry: dict, name: str):
    if name not in registry:
        raise ValueError(f"unknown plugin {name!r}; known: {sorted(registry)}")
    return registry[name]


def detect(name: str, a: DataFrame, b: DataFrame, keys=("pair",), **options) -> DataFrame:
    return _named(DETECTORS, name)(a, b, keys, **options)


def deform(name: str, rows: DataFrame, params: DataFrame, keys=("grp", "layer"), **options) -> DataFrame:
    return _named(DEFORMATIONS, name)(rows, params, keys, **options)


def weighted_loss(met: DataFrame, weights: dict[str, float], key: str = "image_id") -> DataFrame:
    """The weighted sum of named losses, in one aggregation."""
    total = None
    for name, w in weights.items():
        part = w * _named(LOSSES, name)()
        total = part if total is None else total + part
    return met.groupBy(key).agg(total.alias("loss"))
