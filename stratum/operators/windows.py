"""Functions over ordered series: medians, runs, batches, local maxima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sliding_median(signal: DataFrame, window: int, key: str = "series") -> DataFrame:
    """Centred median with window // 2 values on each side, cut at the ends."""
    half = window // 2
    return signal.withColumn("med", F.percentile("v", F.lit(0.5)).over(W.partitionBy(key).orderBy("idx").rowsBetween(-half, half)))


def detrend_median(signal: DataFrame, window: int, key: str = "series") -> DataFrame:
    return sliding_median(signal, window, key).withColumn("residual", F.col("v") - F.col("med"))


def strongest_run(signal: DataFrame, threshold: float, least: int, key: str = "series") -> DataFrame:
    """Of the runs above threshold with least values or more, the one with the highest mean (first on ties); a series
    without one gives its whole extent."""
    up = signal.where(F.col("v") > threshold).withColumn("_i", F.col("idx") - F.row_number().over(W.partitionBy(key).orderBy("idx")))
    runs = up.groupBy(key, "_i").agg(F.min("idx").alias("s"), F.max("idx").alias("e"), F.avg("v").alias("m"), F.count("*").alias("n")).where(F.col("n") >= least)
    best = runs.groupBy(key).agg(F.max_by(F.struct("s", "e"), F.struct(F.round("m", 9), -F.col("s"))).alias("r"))
    whole = signal.groupBy(key).agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    return whole.join(best, key, "left").select(key, F.coalesce("r.s", "a").alias("run_start"), F.coalesce("r.e", "b").alias("run_end"))


def overlapping_batches(signal: DataFrame, batch: int, overlap: int, key: str = "series") -> DataFrame:
    """Batches of batch layers that step batch - overlap; the number is int((N - overlap) // (batch - overlap + 0.1) + 1)."""
    step = batch - overlap
    counts = signal.groupBy(key).agg((F.max("idx") + 1).alias("_n"))
    last = F.floor((F.col("_n") - overlap) / (step + 0.1))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - batch + 1) / step))
    upto = F.least(F.floor(F.col("idx") / step), last)
    joined = signal.join(counts, key).where(first <= upto)
    return joined.withColumn("batch", F.explode(F.sequence(first.cast("long"), upto.cast("long")))).drop("_n")


def keypoint_nms(scores: DataFrame, radius: int, rounds: int = 2, key: str = "image_id") -> DataFrame:
    """Local maxima of a dense score raster in (2 radius + 1)-wide windows, with suppress-and-retry rounds; others are 0."""

    def pooled(df, value, out):
        along = lambda a, b: W.partitionBy(key, a).orderBy(b).rowsBetween(-radius, radius)
        return df.withColumn("_p", F.max(value).over(along("y", "x"))).withColumn(out, F.max("_p").over(along("x", "y"))).drop("_p")

    df = pooled(scores, F.col("v"), "_m").withColumn("_max", F.col("v") == F.col("_m"))
    for _ in range(rounds):
        df = pooled(df, F.col("_max").cast("int"), "_near").withColumn("_s", F.when(F.col("_near") > 0, 0.0).otherwise(F.col("v")))
        df = pooled(df, F.col("_s"), "_m").withColumn("_max", F.col("_max") | ((F.col("_s") == F.col("_m")) & (F.col("_near") == 0)))
    return df.withColumn("nms", F.when(F.col("_max"), F.col("v")).otherwise(0.0)).select(*scores.columns, "nms")
