"""Least-squares fits by moment sums, displacement bins and cells: one aggregation for any number of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affine_fit(pairs: DataFrame, keys: list[str], width: float, height: float, inverse: bool = False) -> DataFrame:
    """Least-squares 2 x 3 map from normalised moving to fixed points (or the other way): a, b, c, d, e, f per key.

    Moments are centred (covariances), which keeps them well conditioned; the normal equations of two unknowns are
    solved in columns. Null where the points lie on a line."""
    n = {c: F.col(c) / (width / 2 if c[0] == "x" else height / 2) - 1 for c in ("xf", "yf", "xm", "ym")}
    src, dst = (("xf", "yf"), ("xm", "ym")) if inverse else (("xm", "ym"), ("xf", "yf"))
    p = pairs.select(*keys, *[n[c].alias(a) for c, a in zip((*src, *dst), ("u", "v", "p", "q"))])
    m = p.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in "uvpq"], *[F.covar_pop(i, j).alias(f"{i}{j}") for i, j in ("uu", "uv", "vv", "up", "vp", "uq", "vq")], F.count("*").alias("n"))
    det = F.col("uu") * F.col("vv") - F.col("uv") ** 2
    ok = F.when(F.abs(det) > 1e-15, det)
    m = m.withColumns({"a": (F.col("up") * F.col("vv") - F.col("vp") * F.col("uv")) / ok, "b": (F.col("vp") * F.col("uu") - F.col("up") * F.col("uv")) / ok, "d": (F.col("uq") * F.col("vv") - F.col("vq") * F.col("uv")) / ok, "e": (F.col("vq") * F.col("uu") - F.col("uq") * F.col("uv")) / ok})
    return m.withColumns({"c": F.col("m_p") - F.col("a") * F.col("m_u") - F.col("b") * F.col("m_v"), "f": F.col("m_q") - F.col("d") * F.col("m_u") - F.col("e") * F.col("m_v")}).select(*keys, "a", "b", "c", "d", "e", "f", "n")


def rotation_fit(pairs: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """The fitted map's angle in degrees."""
    return affine_fit(pairs, keys, width, height).select(*keys, F.degrees(F.atan2("d", "a")).alias("angle"))


def displacement_bins(pairs: DataFrame, keys: list[str], size: float, grid: int) -> DataFrame:
    """Mean displacement (fixed - moving) and count in grid x grid half-open bins of the fixed point; empty bins are 0."""
    step = size / grid
    inside = (F.col("xf") >= 0) & (F.col("xf") < size) & (F.col("yf") >= 0) & (F.col("yf") < size)
    found = pairs.where(inside).groupBy(*keys, F.floor(F.col("yf") / step).alias("i"), F.floor(F.col("xf") / step).alias("j")).agg(F.avg(F.col("xf") - F.col("xm")).alias("dx"), F.avg(F.col("yf") - F.col("ym")).alias("dy"), F.count("*").alias("n"))
    line = F.sequence(F.lit(0), F.lit(grid - 1)).cast("array<bigint>")
    dense = pairs.select(*keys).distinct().withColumn("i", F.explode(line)).withColumn("j", F.explode(line))
    return dense.join(found, [*keys, "i", "j"], "left").na.fill(0, ["dx", "dy", "n"])


def displacement_fit(pairs: DataFrame, keys: list[str], size: float, grid: int, sigma: float = 1.0) -> DataFrame:
    """Displacement cells left over after the affine fit: residuals per bin, weighted by counts and smoothed with a 3 x 3
    Gaussian. Cells without points nearby are 0."""
    from .points import move_by_fit

    rest = displacement_bins(move_by_fit(pairs, affine_fit(pairs, keys, size, size), keys, size, size), keys, size, grid)
    import math

    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(math.exp(-(a * a + b * b) / (2 * sigma * sigma))).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spread = rest.where("n > 0").withColumn("o", offsets).select(*keys, (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), "dx", "dy", (F.col("n") * F.col("o.w")).alias("w"))
    smooth = spread.groupBy(*keys, "i", "j").agg((F.sum(F.col("w") * F.col("dx")) / F.sum("w")).alias("dx"), (F.sum(F.col("w") * F.col("dy")) / F.sum("w")).alias("dy"))
    return rest.select(*keys, "i", "j", "n").join(smooth, [*keys, "i", "j"], "left").na.fill(0.0, ["dx", "dy"])


def apply_cells(points: DataFrame, cells: DataFrame, keys: list[str], size: float, grid: int) -> DataFrame:
    """Moves points by the displacement of their cell; points outside the grid stay."""
    step = size / grid
    placed = points.withColumns({"i": F.floor(F.col("y") / step), "j": F.floor(F.col("x") / step)})
    moved = placed.join(cells.select(*keys, "i", "j", "dx", "dy"), [*keys, "i", "j"], "left")
    return moved.withColumns({"x": F.col("x") + F.coalesce("dx", F.lit(0.0)), "y": F.col("y") + F.coalesce("dy", F.lit(0.0))}).select(*points.columns)


def inverse_grid_lookup(points: DataFrame, field: DataFrame, width: int, height: int, keys=("image_id",)) -> DataFrame:
    """Source of each target point: the field of its whole cell, (g + 1) / 2 of the size; (-1, -1) outside. field: keys,
    i (row), j (column), gx, gy."""
    cell = points.withColumns({"i": F.when(F.col("y") >= 0, F.floor("y")), "j": F.when(F.col("x") >= 0, F.floor("x"))})
    met = cell.join(field.select(*keys, "i", "j", "gx", "gy"), [*keys, "i", "j"], "left")
    return met.withColumns({"x": F.coalesce((F.col("gx") + 1) / 2 * width, F.lit(-1.0)), "y": F.coalesce((F.col("gy") + 1) / 2 * height, F.lit(-1.0))}).select(*points.columns)


def warp_by_grid(landmarks: DataFrame, field: DataFrame, height: int, width: int, keys=("image_id",)) -> DataFrame:
    """For a landmark in [0, 1] the centre of the cell whose sampling position is nearest to 2 p - 1; ties: lowest flat
    index. landmarks: keys, id, x, y; field: keys, i, j, gx, gy."""
    from .nearest import knn_join

    wanted = landmarks.withColumns({"x": 2 * F.col("x") - 1, "y": 2 * F.col("y") - 1})
    flat = field.select(*keys, (F.col("i") * width + F.col("j")).alias("id"), F.col("gx").alias("x"), F.col("gy").alias("y"))
    near = knn_join(wanted, flat, 1, keys)
    return near.select(*keys, F.col("id_a").alias("id"), ((F.col("id_b") % width + 0.5) / width).alias("x"), ((F.floor(F.col("id_b") / width) + 0.5) / height).alias("y"))


def knn_mean_lookup(queries: DataFrame, moving: DataFrame, fixed: DataFrame, k: int, keys=("grp",)) -> DataFrame:
    """Mean position of the k nearest moving points, and of the fixed points with the same ids."""
    from .nearest import knn_join

    near = knn_join(queries, moving, k, keys)
    met = near.join(fixed.select(*keys, F.col("id").alias("id_b"), F.col("x").alias("fx"), F.col("y").alias("fy")), [*keys, "id_b"], "left")
    return met.groupBy(*keys, F.col("id_a").alias("id")).agg(F.avg("xb").alias("mx"), F.avg("yb").alias("my"), F.coalesce(F.avg("fx"), F.lit(0.0)).alias("fx"), F.coalesce(F.avg("fy"), F.lit(0.0)).alias("fy"))
