"""Per-row geometry of points: scaling, padding, flips, affine chains. All are projections after joins with small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def points_scale(points: DataFrame, sizes: DataFrame, keys=("grp", "layer"), inverse: bool = False) -> DataFrame:
    """Pixels to [0, 1] by image width and height, or back. sizes: keys, width, height."""
    joined = points.join(sizes.select(*keys, "width", "height"), list(keys))
    by = (lambda c, s: F.col(c) * F.col(s)) if inverse else (lambda c, s: F.col(c) / F.col(s))
    return joined.withColumns({"x": by("x", "width"), "y": by("y", "height")}).drop("width", "height")


def pad_plan(sizes: DataFrame, group: str = "grp", max_size: int | None = None) -> DataFrame:
    """Target size, shrink ratio, new size and the four pads of every image of a group.

    The target is the group's largest height and width, or max_size squared. An image larger than the target is shrunk
    by the larger of its two ratios. Pads are halves, rounded down; what remains goes right and down.
    """
    own = W.partitionBy(group)
    target_h = F.lit(max_size) if max_size else F.max("height").over(own)
    target_w = F.lit(max_size) if max_size else F.max("width").over(own)
    ratio = F.greatest(F.col("height") / F.col("target_h"), F.col("width") / F.col("target_w"), F.lit(1.0))
    new = lambda c: F.least(F.floor(F.col(c) / F.col("ratio")), F.col(c))
    half = lambda t, n: F.floor((F.col(t) - F.col(n)) / 2)
    return (
        sizes.withColumns({"target_h": target_h, "target_w": target_w})
        .withColumn("ratio", ratio)
        .withColumns({"new_h": new("height"), "new_w": new("width")})
        .withColumns({"pad_left": half("target_w", "new_w"), "pad_up": half("target_h", "new_h")})
        .withColumns({"pad_right": F.col("target_w") - F.col("new_w") - F.col("pad_left"), "pad_down": F.col("target_h") - F.col("new_h") - F.col("pad_up")})
        .withColumn("mean_ratio", F.avg("ratio").over(own))
    )


def points_pad(points: DataFrame, plan: DataFrame, keys=("grp", "layer"), inverse: bool = False, far_side: bool = True) -> DataFrame:
    """Pixels to padded pixels: divided by the shrink ratio, then shifted; inverse undoes it.

    far_side adds the right and down pads going forward, as high-definition images are padded; the inverse always
    subtracts left and up. Without far_side both ways use left and up and undo each other exactly.
    """
    joined = points.join(plan.select(*keys, "ratio", "pad_left", "pad_right", "pad_up", "pad_down"), list(keys))
    side_x, side_y = ("pad_right", "pad_down") if far_side and not inverse else ("pad_left", "pad_up")
    if inverse:
        new = {"x": (F.col("x") - F.col(side_x)) * F.col("ratio"), "y": (F.col("y") - F.col(side_y)) * F.col("ratio")}
    else:
        new = {"x": F.col("x") / F.col("ratio") + F.col(side_x), "y": F.col("y") / F.col("ratio") + F.col(side_y)}
    return joined.withColumns(new).select(*points.columns)


def points_flip(points: DataFrame, sizes: DataFrame, flip_x: str | bool, flip_y: str | bool, keys=("grp", "layer")) -> DataFrame:
    """x to width - x and y to height - y where the flags (columns or constants) say so."""
    flag = lambda f: F.col(f).cast("boolean") if isinstance(f, str) else F.lit(f)
    joined = points.join(sizes.select(*keys, "width", "height"), list(keys))
    return joined.withColumns({"x": F.when(flag(flip_x), F.col("width") - F.col("x")).otherwise(F.col("x")), "y": F.when(flag(flip_y), F.col("height") - F.col("y")).otherwise(F.col("y"))}).drop("width", "height")


def params_to_matrix(transforms: DataFrame) -> DataFrame:
    """Adds a, b, c, d, e, f: the matrix translation * flip * rotation * scale with scales exp(-sx), exp(-sy)."""
    cos, sin = F.cos("theta"), F.sin("theta")
    sx, sy = F.exp(-F.col("sx")), F.exp(-F.col("sy"))
    return transforms.withColumns({"a": F.col("fx") * cos * sx, "b": -F.col("fx") * sin * sy, "c": F.col("tx"), "d": F.col("fy") * sin * sx, "e": F.col("fy") * cos * sy, "f": F.col("ty")})


def invert_matrix(matrices: DataFrame) -> DataFrame:
    """Replaces a..f by the inverse map's."""
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    ia, ib, id_, ie = F.col("e") / det, -F.col("b") / det, -F.col("d") / det, F.col("a") / det
    return matrices.withColumns({"a": ia, "b": ib, "d": id_, "e": ie, "c": -(ia * F.col("c") + ib * F.col("f")), "f": -(id_ * F.col("c") + ie * F.col("f"))})


def to_pixel_matrix(matrices: DataFrame) -> DataFrame:
    """Normalised ([-1, 1]) matrix to pixel matrix; needs width and height."""
    w, h = F.col("width"), F.col("height")
    return matrices.withColumns({"b": F.col("b") * w / h, "c": (F.col("c") - F.col("a") - F.col("b") + 1) * w / 2, "d": F.col("d") * h / w, "f": (F.col("f") - F.col("d") - F.col("e") + 1) * h / 2})


def to_normal_matrix(matrices: DataFrame) -> DataFrame:
    """Pixel matrix to normalised matrix; needs width and height."""
    w, h = F.col("width"), F.col("height")
    b, d = F.col("b") * h / w, F.col("d") * w / h
    return matrices.withColumns({"b": b, "c": F.col("c") * 2 / w + F.col("a") + b - 1, "d": d, "f": F.col("f") * 2 / h + d + F.col("e") - 1})


def matrix_to_params(matrices: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters of a matrix: of four sign pairs the first with the least rebuild error; both signs -1 become half a turn."""
    signs = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("fx"), F.lit(float(y)).alias("fy"), F.lit(i).alias("ord")) for i, (x, y) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))]))
    tried = matrices.select(*keys, "a", "b", "c", "d", "e", "f", signs.alias("g"))
    theta = F.atan2(F.col("g.fy") * F.col("d"), F.col("g.fx") * F.col("a"))
    both = (F.col("g.fx") < 0) & (F.col("g.fy") < 0)
    turned = F.radians(F.pmod(F.degrees(theta) + 180, F.lit(360.0)) - 180)
    tried = tried.withColumns({"theta": F.when(both, turned).otherwise(theta), "kx": F.sqrt(F.col("a") ** 2 + F.col("d") ** 2), "ky": F.sqrt(F.col("b") ** 2 + F.col("e") ** 2), "px": F.when(both, 1.0).otherwise(F.col("g.fx")), "py": F.when(both, 1.0).otherwise(F.col("g.fy"))})
    err = F.abs(F.col("a") - F.col("px") * F.cos("theta") * F.col("kx")) + F.abs(F.col("b") + F.col("px") * F.sin("theta") * F.col("ky")) + F.abs(F.col("d") - F.col("py") * F.sin("theta") * F.col("kx")) + F.abs(F.col("e") - F.col("py") * F.cos("theta") * F.col("ky"))
    best = tried.withColumn("err", F.round(err, 9)).groupBy(*keys).agg(F.min_by(F.struct("theta", F.col("c").alias("tx"), F.col("f").alias("ty"), (-F.log("kx")).alias("sx"), (-F.log("ky")).alias("sy"), F.col("px").alias("fx"), F.col("py").alias("fy")), F.struct("err", "g.ord")).alias("p"))
    return best.select(*keys, "p.*")


def transform_points(points: DataFrame, matrices: DataFrame, keys=("grp", "layer")) -> DataFrame:
    """Applies each key's matrix a..f; points without one are dropped."""
    joined = points.join(matrices.select(*keys, "a", "b", "c", "d", "e", "f"), list(keys))
    return joined.withColumns({"x": F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c"), "y": F.col("d") * F.col("x") + F.col("e") * F.col("y") + F.col("f")}).select(*points.columns)


def compose_steps(matrices: DataFrame, keys=("grp", "layer")) -> DataFrame:
    """One matrix per key from its steps, applied in order of step; folded before any point is joined."""
    first = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0))])

    def then(m: Column, n: Column) -> Column:  # n after m
        rows = {"a": n["a"] * m["a"] + n["b"] * m["d"], "b": n["a"] * m["b"] + n["b"] * m["e"], "c": n["a"] * m["c"] + n["b"] * m["f"] + n["c"], "d": n["d"] * m["a"] + n["e"] * m["d"], "e": n["d"] * m["b"] + n["e"] * m["e"], "f": n["d"] * m["c"] + n["e"] * m["f"] + n["f"]}
        return F.struct(*[v.alias(k) for k, v in rows.items()])

    steps = matrices.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "a", "b", "c", "d", "e", "f"))).alias("steps"))  # a few steps per layer
    return steps.select(*keys, F.aggregate("steps", first, then).alias("m")).select(*keys, "m.*")


def pixel_chain(transforms: DataFrame, plan: DataFrame, keys=("grp", "layer")) -> DataFrame:
    """One pixel matrix per layer from its normalised steps, in the padded frame."""
    steps = params_to_matrix(transforms).join(plan.select(*keys, F.col("target_w").alias("width"), F.col("target_h").alias("height")), list(keys))
    return compose_steps(to_pixel_matrix(steps), keys)


def source_matrix(plan: DataFrame, transforms: DataFrame, zoom: float = 1.0, keys=("grp", "layer")) -> DataFrame:
    """a..f from aligned to raw coordinates: the way of ``landmarks_to_raw`` as one matrix per key, for warping images."""
    met = invert_matrix(pixel_chain(transforms, plan, keys)).join(plan.select(*keys, "ratio", "pad_left", "pad_up"), list(keys))
    scaled = {k: F.col("ratio") * F.col(k) for k in "abde"}
    return met.withColumns(scaled | {"c": zoom * F.col("ratio") * (F.col("c") - F.col("pad_left")), "f": zoom * F.col("ratio") * (F.col("f") - F.col("pad_up"))}).select(*keys, *"abcdef")


def landmarks_to_aligned(points: DataFrame, plan: DataFrame, transforms: DataFrame, zoom: float = 1.0, keys=("grp", "layer")) -> DataFrame:
    """Raw landmarks to aligned coordinates: zoom, pad, then all steps of the layer in one matrix, and back to the zoom."""
    scaled = points.withColumns({"x": F.col("x") / zoom, "y": F.col("y") / zoom})
    moved = transform_points(points_pad(scaled, plan, keys, far_side=False), pixel_chain(transforms, plan, keys), keys)
    return moved.withColumns({"x": F.col("x") * zoom, "y": F.col("y") * zoom})


def landmarks_to_raw(points: DataFrame, plan: DataFrame, transforms: DataFrame, zoom: float = 1.0, keys=("grp", "layer")) -> DataFrame:
    """The way back from aligned coordinates."""
    scaled = points.withColumns({"x": F.col("x") / zoom, "y": F.col("y") / zoom})
    moved = points_pad(transform_points(scaled, invert_matrix(pixel_chain(transforms, plan, keys)), keys), plan, keys, inverse=True)
    return moved.withColumns({"x": F.col("x") * zoom, "y": F.col("y") * zoom})


def crop_points(pairs: DataFrame, region: tuple[float, float, float, float], size: float, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Pairs with both ends strictly inside a fractional region (x0, x1, y0, y1; a negative upper bound is open), moved to
    its origin. The fixed end is scaled by scale[0] and the moving end by scale[1]."""
    x0, x1, y0, y1 = region
    inside = F.lit(True)
    for x, y in (("xf", "yf"), ("xm", "ym")):
        inside &= (F.col(x) > x0 * size) & (F.col(y) > y0 * size)
        inside &= F.lit(True) if x1 < 0 else F.col(x) < x1 * size
        inside &= F.lit(True) if y1 < 0 else F.col(y) < y1 * size
    return pairs.where(inside).withColumns({"xf": (F.col("xf") - x0 * size) * scale[0], "yf": (F.col("yf") - y0 * size) * scale[0], "xm": (F.col("xm") - x0 * size) * scale[1], "ym": (F.col("ym") - y0 * size) * scale[1]})


def crop_window(pixels: DataFrame, fractions: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Pixels of a fractional window (y0, y1, x0, x1), moved to its origin; bounds are cut to whole pixels."""
    y0, y1, x0, x1 = (int(f * s) for f, s in zip(fractions, (height, height, width, width)))
    return pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def scale_translate_rings(shapes: DataFrame, scale: float, dx: float, dy: float) -> DataFrame:
    """Rings scaled about the origin, then moved."""
    return shapes.withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] * scale + dx).alias("x"), (p["y"] * scale + dy).alias("y"))))


def border_filter(points: DataFrame, border: int, width: int, height: int) -> DataFrame:
    """Points at least border away from the left and upper edge, and less than size - border."""
    return points.where((F.col("x") >= border) & (F.col("x") < width - border) & (F.col("y") >= border) & (F.col("y") < height - border))


def enumerate_candidates(pairs: DataFrame, n_angles: int = 8, scales=(1, 2, 4, 8)) -> DataFrame:
    """The search space of each pair: flips, scales, angles, with an ordinal in search order."""
    step = 360 // n_angles
    angles = list(range(0, 360, step))
    space = [F.struct(F.lit(i).alias("ord"), F.lit(fx).alias("flip_x"), F.lit(fy).alias("flip_y"), F.lit(s).alias("scale"), F.lit(a).alias("angle")) for i, (fx, fy, s, a) in enumerate((fx, fy, s, a) for fx in (0, 1) for fy in (0, 1) for s in scales for a in angles)]
    return pairs.withColumn("c", F.explode(F.array(*space))).select(*pairs.columns, "c.*")


def orient_points(points: DataFrame, orientation: DataFrame, size: float, keys=("grp", "layer")) -> DataFrame:
    """Flip in the original frame, then turn by -angle (degrees) about the centre. orientation: keys, angle, flip_x, flip_y."""
    joined = points.join(orientation.select(*keys, "angle", "flip_x", "flip_y"), list(keys))
    half = size / 2
    px = F.when(F.col("flip_x") == 1, size - F.col("x")).otherwise(F.col("x")) - half
    py = F.when(F.col("flip_y") == 1, size - F.col("y")).otherwise(F.col("y")) - half
    cos, sin = F.cos(F.radians(-F.col("angle"))), F.sin(F.radians(-F.col("angle")))
    return joined.withColumns({"x": cos * px - sin * py + half, "y": sin * px + cos * py + half}).select(*points.columns)


def normalize_keypoints(points: DataFrame, keys=("grp", "layer"), size: tuple[float, float] | None = None, variant: int = 1) -> DataFrame:
    """Centred on size / 2 and divided by max(size) / 2 (variant 1), or by 0.7 max(size) (variant 2). Without a size it is
    one more than the points' extent."""
    own = W.partitionBy(*keys)
    w = F.lit(float(size[0])) if size else 1 + F.max("x").over(own) - F.min("x").over(own)
    h = F.lit(float(size[1])) if size else 1 + F.max("y").over(own) - F.min("y").over(own)
    by = F.greatest("_w", "_h") * (0.5 if variant == 1 else 0.7)
    return points.withColumns({"_w": w, "_h": h}).withColumns({"x": (F.col("x") - F.col("_w") / 2) / by, "y": (F.col("y") - F.col("_h") / 2) / by}).drop("_w", "_h")


def move_by_fit(pairs: DataFrame, fits: DataFrame, keys: list[str], width: float, height: float, one_less: bool = False) -> DataFrame:
    """Moving points under the fitted normalised matrix, in pixels; one_less keeps a known offset of one pixel."""
    joined = pairs.join(fits.select(*keys, "a", "b", "c", "d", "e", "f"), keys)
    u, v = F.col("xm") / (width / 2) - 1, F.col("ym") / (height / 2) - 1
    less = 1 if one_less else 0
    return joined.withColumns({"xm": (F.col("a") * u + F.col("b") * v + F.col("c") + 1) * (width / 2) - less, "ym": (F.col("d") * u + F.col("e") * v + F.col("f") + 1) * (height / 2) - less}).select(*pairs.columns)
