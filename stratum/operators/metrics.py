"""Registration errors, image similarity and field smoothness as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_distance() -> Column:
    return F.sqrt((F.col("xf") - F.col("xm")) ** 2 + (F.col("yf") - F.col("ym")) ** 2)


def tre(pairs: DataFrame) -> DataFrame:
    """Euclidean distance of paired landmarks."""
    return pairs.withColumn("tre", pair_distance())


def rtre(pairs: DataFrame, diagonal: float, keys=("grp", "layer_f")) -> DataFrame:
    """Distances by the image diagonal: mean, median and largest per pair of layers."""
    v = pair_distance() / diagonal
    return pairs.groupBy(*keys).agg(F.avg(v).alias("mean_rtre"), F.percentile(v, F.lit(0.5)).alias("median_rtre"), F.max(v).alias("max_rtre"), F.count("*").alias("n"))


def fiducials_from_pairs(pairs: DataFrame, n: int = -1, keys=("grp", "layer_f"), drop_last: bool = False) -> DataFrame:
    """The first n points of each pair as y1, x1, y2, x2; -1 takes all (drop_last: all but the last)."""
    own = W.partitionBy(*keys)
    ranked = pairs.withColumns({"fid": F.row_number().over(own.orderBy("kpt_id")), "_n": F.count("*").over(own)})
    kept = ranked.where(F.col("fid") <= n) if n >= 0 else ranked.where("fid < _n") if drop_last else ranked
    return kept.select(*keys, "fid", F.col("yf").alias("y1"), F.col("xf").alias("x1"), F.col("ym").alias("y2"), F.col("xm").alias("x2"))


def pairwise_tre_global(points: DataFrame, key: str = "grp") -> DataFrame:
    """Distance of each point to itself on the next layer."""
    own = W.partitionBy(key, "kpt_id").orderBy("layer")
    nxt = points.withColumns({"_x": F.lead("x").over(own), "_y": F.lead("y").over(own), "_l": F.lead("layer").over(own)})
    return nxt.where("_l = layer + 1").select(key, "layer", "kpt_id", F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2).alias("tre"))


def pairwise_tre(pairs: DataFrame, pixel: float = 1.0, more_points: bool = False, key: str = "grp") -> DataFrame:
    """Distance inside each row of a pair of layers, in units of pixel; more_points leaves each group's last pair out."""
    told = pairs.select(key, "layer_f", "kpt_id", (pair_distance() * pixel).alias("tre"))
    if not more_points:
        return told
    last = pairs.groupBy(key).agg(F.max("layer_f").alias("_last"))
    return told.join(last, key).where(F.col("layer_f") < F.col("_last")).drop("_last")


def accumulated_tre(pairs: DataFrame, key: str = "grp") -> DataFrame:
    """Mean error vector per pair of layers (NaN left out), its running sum over pairs, and the sum's norm."""
    ok = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    mean = pairs.groupBy(key, "layer_f").agg(F.avg(ok(F.col("xm") - F.col("xf"))).alias("dx"), F.avg(ok(F.col("ym") - F.col("yf"))).alias("dy"))
    own = W.partitionBy(key).orderBy("layer_f").rowsBetween(W.unboundedPreceding, 0)
    return mean.withColumns({"sx": F.sum("dx").over(own), "sy": F.sum("dy").over(own)}).select(key, "layer_f", F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2).alias("atre"))


def linearfit_tre(points: DataFrame, z_scale: float, key: str = "grp") -> DataFrame:
    """Distance of each point to the line through its positions over depth; null with fewer than two layers."""
    z = F.col("layer") * z_scale
    fits = points.groupBy(key, "kpt_id").agg(F.regr_slope("x", z).alias("kx"), F.regr_slope("y", z).alias("ky"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(z).alias("mz"))
    d = F.sqrt((F.col("x") - F.col("mx") - F.col("kx") * (z - F.col("mz"))) ** 2 + (F.col("y") - F.col("my") - F.col("ky") * (z - F.col("mz"))) ** 2)
    return points.join(fits, [key, "kpt_id"]).select(key, "layer", "kpt_id", d.alias("fit_tre"))


def registration_report(fiducials: DataFrame, pixel: float = 0.46, thickness: float = 5.0, key: str = "grp") -> DataFrame:
    """Mean, largest and population deviation of pairwise and accumulated errors, in micrometres.

    The kind of fiducials decides on the errors. Pairwise ones (a row has xf, yf, xm, ym) give the mean distance per pair
    of layers, and its running sum as accumulated error; global ones (a row has x, y: the same points on every layer)
    give all distances to the next layer, and the distances to lines fitted over depth."""
    tell = lambda df, c, name: df.groupBy(key).agg(F.avg(c).alias(f"mean_{name}"), F.max(c).alias(f"max_{name}"), F.stddev_pop(c).alias(f"std_{name}"))
    if "xf" not in fiducials.columns:
        um = fiducials.withColumns({c: F.col(c) * pixel for c in "xy"})
        return tell(pairwise_tre_global(um, key), "tre", "pairwise").join(tell(linearfit_tre(um, thickness, key), "fit_tre", "accumulated"), key)
    um = fiducials.withColumns({c: F.col(c) * pixel for c in ("xf", "yf", "xm", "ym")})
    per_pair = um.groupBy(key, "layer_f").agg(F.avg(pair_distance()).alias("v"))
    return tell(per_pair, "v", "pairwise").join(tell(accumulated_tre(um, key), "atre", "accumulated"), key)


def keypoint_l1(pairs: DataFrame, alpha: float = 0.0, key: str = "grp") -> DataFrame:
    """Mean over (layer, distance) of the lists' mean L1; plus alpha times the mean norm of the lists' mean error vector."""
    dx, dy = F.col("xf") - F.col("xm"), F.col("yf") - F.col("ym")
    lists = pairs.groupBy(key, "layer_f", "zdist").agg(F.avg((F.abs(dx) + F.abs(dy)) / 2).alias("l1"), F.avg(dx).alias("ex"), F.avg(dy).alias("ey"))
    return lists.groupBy(key).agg((F.avg("l1") + alpha * F.avg(F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2))).alias("loss"))


def keypoint_l1_weighted(pairs: DataFrame, lamb: float = 0.1, attr: str = "attr", key: str = "grp") -> DataFrame:
    """Mean of attr times the L1 of both coordinates, plus lamb times what attr lacks of 1 on average."""
    l1 = (F.abs(F.col("xf") - F.col("xm")) + F.abs(F.col("yf") - F.col("ym"))) / 2
    return pairs.groupBy(key).agg((F.avg(F.col(attr) * l1) + lamb * (1 - F.avg(attr))).alias("loss"))


def image_pairs(pixels: DataFrame, lag: int = 1) -> DataFrame:
    """Pixels of image i with those of image i + lag: image_id, channel, y, x, a, b."""
    b = pixels.select((F.col("image_id") - lag).alias("image_id"), "channel", "y", "x", F.col("v").alias("b"))
    return pixels.withColumnRenamed("v", "a").join(b, ["image_id", "channel", "y", "x"])


def image_similarity(met: DataFrame) -> DataFrame:
    """Per image pair: negative global NCC (population deviations, 1 where undefined), cosine loss, dice loss, L1, L2.
    One aggregation of sums."""
    a, b = F.col("a"), F.col("b")
    ncc = F.covar_pop("a", "b") / (F.stddev_pop("a") * F.stddev_pop("b"))
    undefined = (F.stddev_pop("a") == 0) | (F.stddev_pop("b") == 0)
    return met.groupBy("image_id").agg(
        F.when(undefined, F.lit(1.0)).otherwise(-ncc).alias("ncc_loss"),
        (1 - F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("cosine_loss"),
        (1 - (2 * F.sum(a * b / 65025) + 1) / (F.sum(a / 255) + F.sum(b / 255) + 1)).alias("dice_loss"),
        F.avg(F.abs(a - b)).alias("l1"),
        F.avg((a - b) ** 2).alias("l2"),
    )


def multi_lag_loss(pixels: DataFrame, max_lag: int, n_layers: int | None = None) -> DataFrame:
    """L1 of all pairs up to max_lag, summed and divided by the number of layers (counted unless given)."""
    n_layers = n_layers or pixels.select("image_id").distinct().count() or 1
    shifted = pixels.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))).select((F.col("image_id") - F.col("lag")).alias("image_id"), "lag", "channel", "y", "x", F.col("v").alias("b"))
    met = pixels.join(shifted, ["image_id", "channel", "y", "x"])
    per_pair = met.groupBy("lag", "image_id").agg(F.avg(F.abs(F.col("v") - F.col("b"))).alias("l1"))
    return per_pair.agg((F.sum("l1") / n_layers).alias("loss"))


def field_smoothness(field: DataFrame, size: int) -> DataFrame:
    """Relative diffusion and gradient loss of displacement fields: forward differences along both axes. field: image_id,
    i (row), j (column), gx, gy."""
    down, right = W.partitionBy("image_id", "j").orderBy("i"), W.partitionBy("image_id", "i").orderBy("j")
    d = field.withColumns({f"{a}_{g}": F.lead(g).over(w) - F.col(g) for a, w in (("i", down), ("j", right)) for g in ("gx", "gy")})
    mean = lambda a: (F.avg((F.col(f"{a}_gx") * size) ** 2) + F.avg((F.col(f"{a}_gy") * size) ** 2)) / 2
    std = [F.stddev_samp(f"{a}_{g}") for a in "ij" for g in ("gx", "gy")]
    return d.groupBy("image_id").agg(((mean("i") + mean("j")) / 2).alias("diffusion"), ((std[0] + std[1] + std[2] + std[3]) / 4).alias("gradient_loss"))


def stage_quality(pairs_by_stage: DataFrame, stages: list[str], key: str = "grp") -> DataFrame:
    """Keypoint L1 per adjacent pair, one column per stage."""
    v = (F.abs(F.col("xf") - F.col("xm")) + F.abs(F.col("yf") - F.col("ym"))) / 2
    return pairs_by_stage.withColumn("v", v).groupBy(key, "layer_f").pivot("stage", stages).agg(F.avg("v"))
