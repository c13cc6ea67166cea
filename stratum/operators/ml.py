"""Embeddings: projection, k-means, communities of a nearest-neighbour graph, user models over tiles, SSIM."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored


def pca_project(rows: DataFrame, k: int, features: str = "features", fit_on=None) -> DataFrame:
    """Centred top-k components as projection; each component's sign makes its largest loading positive. fit_on: a Column
    that says which rows fit (unmasked ones); the mean is theirs too."""
    import numpy as np
    from pyspark.ml.linalg import DenseMatrix
    from pyspark.ml.stat import Summarizer

    vectors = rows.withColumn("_v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    fitted = vectors.where(fit_on) if fit_on is not None else vectors
    mean = fitted.select(Summarizer.mean(F.col("_v"))).first()[0].toArray()  # one vector
    pc: DenseMatrix = PCA(k=k, inputCol="_v", outputCol="_o").fit(fitted).pc
    m = pc.toArray()
    m = m * np.sign(m[np.abs(m).argmax(axis=0), range(k)])
    parts = []
    values = vector_to_array("_v")
    for c in range(k):
        load = F.array(*[F.lit(float(x)) for x in m[:, c]])
        parts.append(F.aggregate(F.zip_with(values, load, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) - float(mean @ m[:, c]))
    return vectors.withColumn("projection", F.array(*parts)).drop("_v")


def to_rgb(projected: DataFrame) -> DataFrame:
    """Projection cut to -5..5 as whole numbers 0..255."""
    return projected.withColumn("rgb", F.transform("projection", lambda v: F.floor((F.least(F.greatest(v, F.lit(-5.0)), F.lit(5.0)) + 5) * 25.5).cast("int")))


def kmeans_labels(rows: DataFrame, ks: list[int], features: str = "features", seed: int = 0) -> DataFrame:
    """One label column kmeans_{k} per k, as strings."""
    df = rows.withColumn("_v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    for k in ks:
        df = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=f"kmeans_{k}", maxIter=20).fit(df).transform(df).withColumn(f"kmeans_{k}", F.col(f"kmeans_{k}").cast("string"))
    return df.drop("_v")


def standardized(rows: DataFrame, features: str = "features") -> DataFrame:
    """Each feature less its mean, by its deviation (0 stays 0)."""
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True)
    vectors = rows.withColumn("_v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))
    return scaler.fit(vectors).transform(vectors).withColumn(features, vector_to_array("_s")).drop("_v", "_s")


def propagated_labels(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Label propagation over an undirected graph (src, dst): each node takes its neighbours' most common label (smallest
    on ties), counting its own. It ends when no label changes, or after ``rounds`` rounds, as two labels can change places
    for ever; rounds are stored."""
    both = stored(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        seen = both.join(labels, both["dst"] == labels["node"]).select(F.col("src").alias("node"), "label").unionByName(labels.select("node", "label"))
        counts = seen.groupBy("node", "label").agg(F.count("*").alias("n"))
        new = stored(counts.groupBy("node").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
        settled = new.join(labels.withColumnRenamed("label", "_old"), "node").where("label <> _old").isEmpty()
        labels = new
        if settled:
            break
    return labels


def _arcs(edges: DataFrame) -> DataFrame:
    """Both directions of an undirected graph: a, b, w. A loop's weight counts twice; repeated edges add up."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    one = edges.where("src is not null and dst is not null").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(w).alias("w"))
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # a loop gives two rows of one arc
    return one.select(F.explode(ways).alias("e"), "w").groupBy("e.a", "e.b").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Weight inside communities less resolution times what chance would put there, as a share of all weight. edges: src,
    dst and maybe w; labels: node, label."""
    arcs = _arcs(edges)
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    met = arcs.join(of("a"), "a").join(of("b"), "b").groupBy("la").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("i"))
    inside, squares, weight = met.agg(F.sum("i"), F.sum(F.col("t") ** 2), F.sum("t")).first()
    return inside / weight - resolution * squares / weight**2 if weight else 0.0


def graph_communities(edges: DataFrame, resolution: float = 1.0, tolerance: float = 0.005) -> DataFrame:
    """Communities of an undirected graph (src, dst, maybe w) by modularity: node, label (the smallest node in it). A
    higher resolution makes more and smaller ones.

    Nodes move to the neighbouring community of most gain; settled communities become the nodes of the next, smaller
    graph, until no node gains by a move. In a round, half of the communities are left and the other half entered, so that
    no node moves towards one that leaves; if modularity does not rise all the same, the round is taken back, and only
    moves that share no community are made, whose gains add up. So it rises in every round that stays. A level also ends
    when a round raises it by less than tolerance, and the last level is the one that raises it by less; at tolerance 0
    no move gains at the end. Every round is stored."""
    arcs = stored(_arcs(edges))
    whole = stored(arcs.select(F.col("a").alias("node")).distinct().withColumn("at", F.col("node")))
    while True:
        labels, gain = _settled(arcs, resolution, tolerance)
        pieces = labels.agg(F.count("*"), F.countDistinct("label")).first()
        if pieces[0] == pieces[1]:
            break
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        whole = stored(whole.join(of("at"), "at").select("node", F.col("lat").alias("at")))
        arcs = stored(arcs.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")))
        if gain < tolerance:
            break
    least = whole.groupBy("at").agg(F.min("node").alias("label"))
    return whole.join(least, "at").select("node", "label")


def _settled(arcs: DataFrame, resolution: float, tolerance: float) -> tuple[DataFrame, float]:
    """Labels (node, k, label) of one level's nodes when no move gains, or only little, and what modularity rose by."""
    labels = stored(arcs.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("loop")).withColumn("label", F.col("node")))
    weight, loops, alone = labels.agg(F.sum("k"), F.sum("loop"), F.sum(F.when(F.col("k") == F.col("loop"), F.col("k") ** 2).otherwise(0.0))).first()
    if not weight:
        return labels, 0.0
    between = arcs.where("a <> b")
    moved = lambda rows, moves: stored(rows.join(moves.select("node", "to"), "node", "left").select("node", "k", F.coalesce("to", "label").alias("label")))
    before, first, quality, sure, turn = None, None, None, True, 0
    while True:
        turn += 1
        totals = labels.groupBy("label").agg(F.sum("k").alias("t"))
        ends = labels.select(F.col("node").alias("b"), "label")
        links = between.join(ends, "b").groupBy(F.col("a").alias("node"), F.col("label").alias("to")).agg(F.sum("w").alias("w"))
        own = labels.select("node", "k", "label").join(totals.withColumnRenamed("t", "own_t"), "label")
        met = links.join(own, "node").join(totals.select(F.col("label").alias("to"), "t"), "to")
        share = F.col("k") * (resolution / weight)
        here = F.max(F.when(F.col("to") == F.col("label"), F.col("w")).otherwise(0.0)).alias("inside")
        side = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
        away = lambda when: F.max(F.when(when, F.struct((F.col("w") - share * F.col("t")).alias("gain"), (-F.col("to")).alias("o"))))
        other = F.col("to") != F.col("label")
        best = met.groupBy("node", "label", "k", "own_t").agg(away(other).alias("m"), away(other & (side("label") == 0) & (side("to") == 1)).alias("c"), here)
        home = F.col("inside") - share * (F.col("own_t") - F.col("k"))
        tried = stored(best.select("node", F.col("label").alias("from"), (F.col("k") * F.col("own_t")).alias("square"), "inside", (-F.col("m.o")).alias("to"), (F.col("m.gain") - home).alias("gain"), F.when(F.col("c.gain") - home > 1e-9, -F.col("c.o")).alias("crossing")))
        inside, squares, some, crossing = tried.agg(F.sum("inside"), F.sum("square"), F.count_if(F.col("gain") > 1e-9), F.count("crossing")).first()
        last, quality = quality, ((inside or 0.0) + loops) / weight - resolution * ((squares or 0.0) + alone) / weight**2
        first = quality if first is None else first
        if not sure and quality <= last:
            labels, sure, quality = moved(before[0], _apart(before[1])), True, last
            continue
        little = last is not None and quality - last < max(tolerance, 1e-12)
        if not some or little and (sure or tolerance > 0):
            return labels, quality - first
        tried = tried.where("gain > 1e-9")
        before, sure = (labels, tried), little or not crossing
        labels = moved(labels, _apart(tried) if sure else tried.where("crossing is not null").select("node", F.col("crossing").alias("to")))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves that are the best one (lowest node on ties) of both the community they leave and the one they enter."""
    sides = moves.select("node", "to", "gain", F.explode(F.array("from", "to")).alias("c"))
    best = sides.groupBy("c").agg(F.max(F.struct("gain", (-F.col("node")).alias("o"), "to")).alias("m"))
    return best.groupBy((-F.col("m.o")).alias("node"), F.col("m.to").alias("to")).count().where("count = 2").select("node", "to")


def knn_graph(rows: DataFrame, k: int, features: str = "features", probes: int = 8, seed: int = 0) -> DataFrame:
    """Edges from each row to its k most similar others (cosine); rows: id, features.

    Rows are clustered into about half the square root of their number of cells; a row is compared, in blocks, with the
    rows of the ``probes`` cells whose centres are nearest to it. With so few rows that there are no more cells than
    probes the graph is exact; else tests hold its recall."""
    from .matching import nearest_descriptors

    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = rows.select("id", F.transform(features, lambda v: v.cast("double") / norm).alias("features")).withColumn("_v", array_to_vector("features"))
    cells = max(1, round(rows.count() ** 0.5 / 2))
    model = KMeans(k=cells, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(unit) if cells > 1 else None
    held = stored((model.transform(unit) if model else unit.withColumn("cell", F.lit(0))).select("id", "features", "cell"))
    if cells <= probes:
        asked = held.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    else:
        asked = nearest_cells(held, model.clusterCenters(), probes).select("id", "features", F.explode("cells").alias("cell"))
    return nearest_descriptors(asked, held, k, ("cell",)).select(F.col("i").alias("src"), F.col("j").alias("dst"))


def nearest_cells(rows: DataFrame, centres: list, probes: int) -> DataFrame:
    """Rows (id, features) with the numbers of the probes nearest centres. The centres, half the square root of the number
    of rows, are broadcast and meet a batch of rows in one product."""
    import numpy as np

    shared = rows.sparkSession.sparkContext.broadcast(np.array(centres))

    def near(frames):
        c = shared.value
        for pdf in frames:
            if len(pdf):
                far = (c * c).sum(axis=1) - 2 * np.stack(pdf["features"].to_list()) @ c.T
                yield pdf.assign(cells=list(np.argsort(far, axis=1, kind="stable")[:, :probes]))

    return rows.select("id", "features").mapInPandas(near, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>, cells array<int>")


def batch_embed(tiles: DataFrame, model: Callable, schema: str, finished: DataFrame | None = None, keys=("image_id", "ty", "tx")) -> DataFrame:
    """A user model (pandas frame in, pandas frame out) over tiles, leaving out finished ones."""
    todo = tiles.join(finished.select(*keys), list(keys), "left_anti") if finished is not None else tiles
    return todo.mapInPandas(lambda frames: (model(f) for f in frames), schema)


def ssim(met: DataFrame, height: int, width: int, size: int = 11, sigma: float = 1.5, peak: float = 1.0, tile: int = 256) -> DataFrame:
    """1 - SSIM per image pair: Gaussian windows that lie wholly inside. met: image_id, channel, y, x, a, b. Each pixel goes
    to the tiles whose windows reach it, NumPy smooths a tile's five products at once, and only sums per tile leave it.
    Missing pixels count 0 in windows and have no value of their own; repeated ones add up."""
    keys, half, c1, c2 = ["image_id", "channel"], size // 2, (0.01 * peak) ** 2, (0.03 * peak) ** 2
    near = lambda c: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - half) / tile), F.lit(0)), F.floor((F.col(c) + half) / tile)))
    inside = met.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).dropna(subset=keys)
    sent = inside.select(*keys, near("y").alias("ty"), "y", "x", *[F.col(c).cast("double").alias(c) for c in "ab"]).withColumn("tx", near("x"))
    image = met.select("image_id").schema[0].dataType.simpleString()

    def compute(group: pa.Table) -> pa.Table:
        y0, x0 = (group.column(c)[0].as_py() * tile for c in ("ty", "tx"))
        h, w = min(tile, height - y0), min(tile, width - x0)  # not above 0: a tile beyond the edge
        if h < 1 or w < 1:
            return pa.table({"image_id": group.column("image_id").slice(0, 0), "total": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        y, x = group.column("y").to_numpy() - y0 + half, group.column("x").to_numpy() - x0 + half
        known = [group.column(c).is_valid().to_numpy() for c in "ab"]
        a, b = (np.where(k, group.column(c).to_numpy(), 0.0) for c, k in zip("ab", known))

        def smooth(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
            full = np.zeros((h + 2 * half, w + 2 * half))
            np.add.at(full, (y, x), values)
            down = sum(k * full[i : i + h] for i, k in enumerate(weights))
            return sum(k * down[:, i : i + w] for i, k in enumerate(weights))

        with np.errstate(invalid="ignore", over="ignore"):
            ma, mb, aa, bb, ab = (smooth(v, kernel) for v in (a, b, a * a, b * b, a * b))
            value = (2 * ma * mb + c1) * (2 * (ab - ma * mb) + c2) / ((ma**2 + mb**2 + c1) * (aa - ma**2 + bb - mb**2 + c2))
        own = np.zeros((h + 2 * half, w + 2 * half), bool)
        own[y, x] = True
        own = own[half : half + h, half : half + w]
        rows, columns = np.arange(y0, y0 + h), np.arange(x0, x0 + w)
        own &= ((rows >= half) & (rows < height - half))[:, None] & ((columns >= half) & (columns < width - half))[None]
        found = own.copy()
        for k in (*known, known[0] & known[1]):
            if not k.all():  # a window without a known product has no value
                found &= smooth(k.astype(float), np.ones(len(kernel))) > 0
        told = 1 if own.any() else 0
        return pa.table({"image_id": group.column("image_id").slice(0, told), "total": pa.array([value[found].sum()] * told, pa.float64()), "n": pa.array([found.sum()] * told, pa.int64())})

    kernel = np.array([math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(size)])
    kernel = kernel / kernel.sum()
    sums = sent.groupBy(*keys, "ty", "tx").applyInArrow(compute, f"image_id {image}, total double, n long")
    return sums.groupBy("image_id").agg((1 - F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("loss"))
