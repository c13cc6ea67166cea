"""Rule-based cell typing: the fixed marker tree, ensembles of thresholds, votes, tree quality, threshold search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import spread_out

#: Node, marker or leaf name, node if positive, node if not (leaves have neither).
MARKER_TREE = (
    (0, "PANK1", 1, 2),
    (1, "Cancer cell", None, None),
    (2, "CD68", 3, 6),
    (3, "CD163", 4, 5),
    (4, "CD163+ Mac", None, None),
    (5, "CD163- Mac", None, None),
    (6, "CD3E", 7, 14),
    (7, "CD8A", 8, 9),
    (8, "Tc", None, None),
    (9, "CD4", 10, 13),
    (10, "FOXP3", 11, 12),
    (11, "Treg", None, None),
    (12, "Th", None, None),
    (13, "DNT", None, None),
    (14, "MS4A1", 15, 16),
    (15, "B Cell", None, None),
    (16, "MPO", 17, 18),
    (17, "Neu", None, None),
    (18, "NCAM1", 19, 20),
    (19, "NK", None, None),
    (20, "ITGAX", 21, 23),
    (21, "HLA-DRA", 22, 23),
    (22, "Dendritic Cell", None, None),
    (23, "PECAM1", 24, 25),
    (24, "Endothelial", None, None),
    (25, "TPSAB1", 26, 27),
    (26, "Mast cell", None, None),
    (27, "ACTA2", 28, 29),
    (28, "Fibroblast", None, None),
    (29, "Undefined", None, None),
)
THRESHOLD = 0.3


def tree_markers(tree=MARKER_TREE) -> list[str]:
    return [name for _, name, yes, _ in tree if yes is not None]


def tree_column(threshold, leaf, tree=MARKER_TREE) -> Column:
    """A nested case expression that walks the tree; threshold(node) and leaf(node, name) give Columns. Values compare as
    32-bit floats. Catalyst compiles it, so a row costs a few comparisons."""
    nodes = {n: (name, yes, no) for n, name, yes, no in tree}

    def walk(n: int) -> Column:
        name, yes, no = nodes[n]
        if yes is None:
            return leaf(n, name)
        return F.when(F.col(f"`{name}`").cast("float").cast("double") > threshold(n), walk(yes)).otherwise(walk(no))

    return walk(tree[0][0])


def classify(cells: DataFrame, thresholds: dict[int, float] | None = None, tree=MARKER_TREE) -> DataFrame:
    """Adds cell_type and leaf. Thresholds of nodes that are leaves in the tree are ignored."""
    given = thresholds or {}
    cut = lambda n: F.lit(float(given.get(n, THRESHOLD)))
    return cells.withColumns({"cell_type": F.coalesce(tree_column(cut, lambda n, name: F.lit(name), tree), F.lit("Unknown")), "leaf": tree_column(cut, lambda n, name: F.lit(n), tree)})


def ensemble_votes(cells: DataFrame, parameter_sets: list[dict[str, float]], ident: str = "cell_id", tree=MARKER_TREE) -> DataFrame:
    """Cell types under every set of thresholds ({"t_0": .., ..}), counted: one row per cell, a column per type.

    The few sets ride along as an array literal, so no join is needed; columns are the tree's leaves, so no pass over
    the data is needed to find them."""
    names = [f"t_{n}" for n, _, yes, _ in tree if yes is not None]
    sets = F.array(*[F.struct(*[F.lit(float(p.get(k, THRESHOLD))).alias(k) for k in names]) for p in parameter_sets])
    voted = cells.withColumn("_p", F.explode(sets)).withColumn("_type", tree_column(lambda n: F.col(f"_p.t_{n}"), lambda n, name: F.lit(name), tree))
    types = sorted(name for _, name, yes, _ in tree if yes is None)
    return vote_matrix(voted.select(ident, F.col("_type").alias("label")), ident, types)


def vote_matrix(votes: DataFrame, ident: str, labels: list[str] | None = None) -> DataFrame:
    """Predictions (ident, label) as counts per label, missing ones 0."""
    grouped = votes.groupBy(ident).pivot("label", labels) if labels else votes.groupBy(ident).pivot("label")
    return grouped.count().na.fill(0)


def counted(cells: DataFrame, markers: list[str], keys: list[str] = ()) -> DataFrame:
    """Equal rows of keys and markers once, with their number (cells). A table that has that column keeps it as it is."""
    if "cells" in cells.columns:
        return cells
    return cells.groupBy(*keys, *[f"`{m}`" for m in markers]).agg(F.count("*").alias("cells"))


def leaf_distances(cells: DataFrame, keys: list[str], markers: list[str], block: int = 256) -> DataFrame:
    """Mean pairwise distance and number of cells per keys. Equal cells count as one with a weight; these are cut into
    blocks, pairs of blocks meet, and only a sum leaves each pair, so no row per pair of cells is made."""
    once = counted(cells, markers, keys)
    size = once.groupBy(*keys).agg(F.sum("cells").alias("n"), F.count("*").alias("_rows"))
    placed = once.join(size, keys).withColumn("_blocks", F.ceil(F.col("_rows") / block)).withColumn("_b", F.pmod(F.xxhash64(*[f"`{m}`" for m in markers]), F.col("_blocks")))
    packed = placed.groupBy(*keys, "n", "_blocks", "_b").agg(F.flatten(F.collect_list(F.array(*[F.col(f"`{m}`").cast("double") for m in markers], F.col("cells").cast("double")))).alias("v"))
    left = packed.withColumn("_o", F.explode(F.sequence("_b", F.col("_blocks") - 1)))
    right = packed.select(*keys, F.col("_b").alias("_o"), F.col("v").alias("w"))
    width = len(markers) + 1

    @F.pandas_udf("double")
    def total(v: pd.Series, w: pd.Series, same: pd.Series) -> pd.Series:
        out = []
        for a, b, s in zip(v, w, same):
            x, y = np.reshape(a, (-1, width)).T.copy(), np.reshape(b, (-1, width)).T.copy()
            square = np.zeros((x.shape[1], y.shape[1]))
            for p, q in zip(x[:-1], y[:-1]):  # marker by marker, so that a block pair stays in the cache
                step = np.subtract.outer(p, q)
                step *= step
                square += step
            d = x[-1] @ np.sqrt(square, out=square) @ y[-1]
            out.append(d / 2 if s else d)
        return pd.Series(out)

    right, left = (spread_out(side, *keys, "_o") for side in (right, left))
    sums = left.join(right, [*keys, "_o"]).select(*keys, "n", total("v", "w", F.col("_b") == F.col("_o")).alias("d"))
    return sums.groupBy(*keys, "n").agg(F.sum("d").alias("d")).select(*keys, "n", F.when(F.col("n") > 1, F.col("d") / (F.col("n") * (F.col("n") - 1) / 2)).alias("mean_distance"))


def tree_quality(cells: DataFrame, keys: list[str], markers: list[str], n_leaves: int, penalty: Column, weight_cov: float = 0.5, weight_purity: float = 0.5, alpha: float = 0.1) -> DataFrame:
    """Coverage, purity and score per keys; cells: keys, leaf, markers (and cells, if a row stands for several). penalty: mean squared distance of the
    thresholds from where they began, a Column of keys."""
    leaves = leaf_distances(cells, [*keys, "leaf"], markers).withColumn("p", F.coalesce(1 - F.col("mean_distance") / len(markers) ** 0.5, F.lit(1.0)))
    told = leaves.groupBy(*keys).agg((F.count("*") / n_leaves).alias("coverage"), F.avg("p").alias("purity"))
    return told.withColumn("penalty", penalty).withColumn("score", weight_cov * F.col("coverage") + weight_purity * F.col("purity") - alpha * F.col("penalty"))


def threshold_search(cells: DataFrame, n_trees: int, n_trials: int, seed: int = 0, tree=MARKER_TREE) -> DataFrame:
    """Random trials per tree; the best score keeps its thresholds. All trials are judged in one job."""
    inner = [n for n, _, yes, _ in tree if yes is not None]
    rng = np.random.default_rng(seed)
    trials = [(t, k, {n: float(x) for n, x in zip(inner, rng.uniform(0, 1, len(inner)))}) for t in range(n_trees) for k in range(n_trials)]
    rows = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(k).alias("trial"), F.lit(float(np.mean([(v - THRESHOLD) ** 2 for v in p.values()]))).alias("penalty"), *[F.lit(v).alias(f"t_{n}") for n, v in p.items()]) for t, k, p in trials])
    markers = list(dict.fromkeys(tree_markers(tree)))
    tried = counted(cells, markers).withColumn("_p", F.explode(rows))  # equal cells take the same way in every trial
    tried = tried.withColumn("leaf", tree_column(lambda n: F.col(f"_p.t_{n}"), lambda n, name: F.lit(n), tree))
    judged = tree_quality(tried.select("cells", F.col("_p.tree").alias("tree"), F.col("_p.trial").alias("trial"), F.col("_p.penalty").alias("spent"), "leaf", *[F.col(f"`{m}`") for m in markers]), ["tree", "trial", "spent"], markers, sum(yes is None for _, _, yes, _ in tree), F.col("spent"))
    best = judged.groupBy("tree").agg(F.max_by(F.struct("trial", "score"), F.struct("score", -F.col("trial"))).alias("b"))
    return best.select("tree", "b.trial", "b.score")
