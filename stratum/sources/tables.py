"""Scans and sinks: manifests, landmarks, panels, feature tables, rasters, and stores of spatial elements."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MANIFEST = "_idx string, project string, grp string, sample string, layer int, type string"
PAIRED = "anon_id string, ihc_x double, ihc_y double, he_x double, he_y double, mpp_ihc_10X double, mpp_he_10X double"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV: index, project, group, sample, group_idx, type."""
    return spark.read.schema(MANIFEST).option("header", True).option("enforceSchema", True).csv(path).drop("_idx")


def select_group(manifest: DataFrame, project: str, group) -> DataFrame:
    return manifest.where((F.col("project") == project) & (F.col("grp") == group))


def layer_lookup(rows: DataFrame, manifest: DataFrame, keys=("grp", "layer"), required: bool = False) -> DataFrame:
    """Adds sample and type to layer-keyed rows; the first manifest row of a layer counts. required: raise on a layer
    that the manifest lacks."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("sample"))
    known = manifest.withColumn("_r", first).where("_r = 1").select(*keys, "sample", "type")
    if required and not rows.select(*keys).distinct().join(known, list(keys), "left_anti").isEmpty():
        raise ValueError("a layer is missing from the manifest")
    return rows.join(known, list(keys))


def manifest_from_paths(files: DataFrame, project: str, kind: str) -> DataFrame:
    """Manifest of a file listing (path): group is the folder, sample the base name, layer the rank of the path."""
    named = files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("grp"), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("sample"))
    return named.select(F.lit(project).alias("project"), "grp", "sample", (F.row_number().over(W.partitionBy("grp").orderBy("path")) - 1).cast("long").alias("layer"), F.lit(kind).alias("type"))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """Landmark CSV (index, X, Y); a missing file gives no rows."""
    schema = "kpt_id long, x double, y double"
    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except Exception as error:  # Spark reports a missing path as an analysis error
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def paired_landmarks(raw: DataFrame) -> DataFrame:
    """Annotations of both stains in pixels; rows with a null are dropped."""
    return raw.dropna("any").withColumns({"ihc_x": F.col("ihc_x") / F.col("mpp_ihc_10X"), "ihc_y": F.col("ihc_y") / F.col("mpp_ihc_10X"), "he_x": F.col("he_x") / F.col("mpp_he_10X"), "he_y": F.col("he_y") / F.col("mpp_he_10X")})


def fiducials_long(by_annotator: dict[str, DataFrame]) -> DataFrame:
    """Wide rows (layer, c1..c8 = y1, x1, ..) of several annotators as layer, annotator, kpt, x, y."""
    parts = [df.select("layer", F.lit(name).alias("annotator"), F.expr("stack(4, " + ", ".join(f"{k}L, c{2 * k}, c{2 * k - 1}" for k in range(1, 5)) + ") as (kpt, x, y)")) for name, df in by_annotator.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def marker_panel(panels: DataFrame) -> DataFrame:
    """genes (map of panel to names) and order_label (channels) as panel, gene, channel."""
    long = panels.select(F.explode("genes").alias("panel", "names"), "order_label").select("panel", "order_label", F.posexplode("names").alias("pos", "gene"))
    return long.select("panel", "gene", F.col("order_label")[F.col("pos")].cast("long").alias("channel"))


def cluster_names(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds name by (grp, cluster) from JSON {group: {cluster: name}}; clusters without one get null."""
    parsed = texts.select(F.explode(F.from_json("json", "map<string,map<string,string>>")).alias("grp", "m")).select("grp", F.explode("m").alias("cluster", "name"))
    return rows.join(parsed, ["grp", "cluster"], "left")


def feature_table(raw: DataFrame) -> DataFrame:
    """Patch features: cell_{i}, x = coords[1], y = coords[0], features; spatial keeps the raw order."""
    return raw.select(F.concat(F.lit("cell_"), F.col("id").cast("string")).alias("cell"), F.col("coords")[1].alias("x"), F.col("coords")[0].alias("y"), F.col("coords").alias("spatial"), "features")


def downsampled(pixels: DataFrame, height: int, width: int, factors: tuple[int, ...] = (1, 4, 8, 40)) -> DataFrame:
    """Means of factor x factor blocks for every factor (column level), floor(size / factor) blocks a side. Sums are rolled
    up from the largest factor before that divides the next one, so pixels are read once per chain of factors."""
    keys, sums, out = ["image_id", "channel", "y", "x"], {}, []
    for f in sorted(factors):
        below = max((g for g in sums if f % g == 0), default=1)
        source = sums.get(below, pixels.select(*keys, F.col("v").alias("s"), F.lit(1).cast("long").alias("n")))
        whole = source.where((F.col("y") < height // f * (f // below)) & (F.col("x") < width // f * (f // below)))
        block = lambda c: F.floor(F.col(c) / (f // below)).alias(c)  # noqa: B023, E731
        sums[f] = whole if f == below else whole.groupBy("image_id", "channel", block("y"), block("x")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        out.append(sums[f].select(*keys, (F.col("s") / F.col("n")).alias("v"), F.lit(f).alias("level")))
    return functools.reduce(DataFrame.unionByName, out)


def write_raster(pixels: DataFrame, folder: str) -> None:
    """A raster with all its levels, partitioned so that reads of one image and level touch only their files. Writing an
    image and level again replaces just those; an image's rows go to several files where they are many."""
    ordered = pixels.repartition("image_id", "level", F.floor(F.col("y") / 4096), F.floor(F.col("x") / 4096)).sortWithinPartitions("image_id", "level", "channel", "y", "x")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("image_id", "level").parquet(folder)


def read_raster(spark: SparkSession, folder: str, image_id: int | None = None, level: int | None = None, channels: list[int] | None = None) -> DataFrame:
    """The rows of an image, a level and channels, or of all."""
    rows = spark.read.parquet(folder)
    for name, value in (("image_id", image_id), ("level", level)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return rows.where(F.col("channel").isin(channels)) if channels else rows


def gray_to_rgb(pixels: DataFrame) -> DataFrame:
    """A single channel repeated to three."""
    return pixels.drop("channel").withColumn("channel", F.explode(F.array(*[F.lit(c).cast("long") for c in range(3)])))


def write_elements(elements: dict[str, DataFrame], folder: str, overwrite: bool = False) -> DataFrame:
    """One Parquet dataset per element of a group, and their catalogue; existing elements stay unless overwrite is set."""
    spark = next(iter(elements.values())).sparkSession
    for name, df in elements.items():
        df.write.mode("overwrite" if overwrite else "ignore").parquet(f"{folder}/{name}")
    return spark.createDataFrame([(n, f"{folder}/{n}") for n in sorted(elements)], "element string, path string")


def concat_tables(tables: dict[str, DataFrame], label: str, name: str | None = None) -> DataFrame:
    """Tables one below the other with a label column; columns are those that all have. Values of the column ``name`` that
    come again, in the order of the labels, get -1, -2 and so on."""
    first = next(iter(tables.values())).columns
    shared = [c for c in first if all(c in df.columns for df in tables.values())]
    both = functools.reduce(DataFrame.unionByName, [df.select(*shared, F.lit(own).alias(label)) for own, df in tables.items()])
    if name is None:
        return both
    again = F.row_number().over(W.partitionBy(name).orderBy(label, *[c for c in shared if c != name])) - 1
    return both.withColumn(name, F.when((again == 0) | F.col(name).isNull(), F.col(name)).otherwise(F.concat_ws("-", F.col(name), again.cast("string"))))


def merge_elements(into: DataFrame, other: DataFrame, key: str = "element") -> DataFrame:
    """Elements of other overwrite those of the same name."""
    return into.join(other.select(key), key, "left_anti").unionByName(other, allowMissingColumns=True)


def append_keypoints(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Sparse and dense pairs for neighbours, dense ones only beyond; duplicates stay."""
    return sparse.where("zdist = 1").withColumn("origin", F.lit("sparse")).unionByName(dense.withColumn("origin", F.lit("dense")))
