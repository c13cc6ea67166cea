"""Quality rules: base limits, then robust multivariate outliers per language and source. DataFrame functions only.

Every text gives counts and a vector of transformed statistics (FEATURES). Documents that pass the base limits are
judged per (lang, source) by a minimum-covariance-determinant estimate. There are three deterministic starts: medians
with quartile ranges, mean and covariance of all rows, and medians with the covariance of tanh-scaled rows. A C-step
chooses the share ``H`` with the least distance, whose mean and covariance give new distances. Each start takes
``FIRST_STEPS`` C-steps; the one with the least determinant goes on, and a C-step is kept only where it lowers the
determinant, until no group's log determinant falls by more than ``TOLERANCE``. Documents whose squared Mahalanobis
distance, brought to the chi-square scale, is above ``CUTOFF`` are rejected.

Estimates (a few hundred bytes a group) are broadcast while there are at most ``BROADCAST_GROUPS`` groups, so that a
group with a third of all rows is spread over all tasks; beyond it Spark joins by key and splits what is skewed.

A floor is added to each variance, because statistics that are zero nearly everywhere have no spread of their own.
Groups with fewer than ``MIN_GROUP`` documents are pooled by language, and then all together; if even that pool is
smaller, the base limits alone decide. Statistics and distances are rounded before percentiles are taken, so that exact
percentiles keep a bounded number of values per group and the verdict does not depend on partitions.

Words are runs of ``[^\\x20\\x09-\\x0D]``. n_repeat_words compares five-word windows by 64-bit hashes.

Defined cases: null text has no words and fails the base limits; null lang or source is a group of its own; repeated
rows are answered one by one; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE, NON_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
WINDOW = 5
H, FIRST_STEPS, TOLERANCE, MIN_GROUP, BROADCAST_GROUPS = 0.75, 2, 1e-4, 40, 20_000
#: Name, floor of the standard deviation.
FEATURES = (("f_word", 0.08), ("f_symbol", 0.15), ("f_dup", 0.08), ("f_repeat", 0.05), ("f_shout", 0.12))
#: Chi-square with five degrees of freedom: its 0.75 quantile, and the cutoff (tail below one in ten million).
CHI_H, CUTOFF = 6.626, 45.0


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that stand twice or more, the first included."""
    n = F.size(hashes)
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        marked = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(s, j)["i"]))
        return F.array_sort(F.array_compact(marked))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["total"] + p + WINDOW - F.greatest(p, acc["end"])).alias("total"))
    covered = F.transform(F.array(ranked), lambda s: F.aggregate(positions(s), start, step, lambda acc: acc["total"]))[0]
    return F.when((n < 2) | (F.size(F.array_distinct(hashes)) == n), F.lit(0)).otherwise(covered)


def statistics(docs: DataFrame) -> DataFrame:
    """Counts per document row, from whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE))
    word_hashes = F.transform("words", lambda w: F.xxhash64(w))
    windows = F.when(F.size("hashes") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), words.alias("words"), lines.alias("lines"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"), F.regexp_count(text, F.lit("[A-Z!]")).alias("n_shout"))
        .withColumn("hashes", word_hashes)
        .withColumn("windows", windows)
        .select(
            "doc_id", "lang", "source",
            F.size("words").cast("long").alias("n_words"),
            F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
            F.col("n_symbols").cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
            F.col("n_shout").cast("long").alias("n_shout"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def with_features(stats: DataFrame) -> DataFrame:
    """Transformed statistics; small counts are drawn towards ordinary values, so short texts do not stand out."""
    n = F.col("n_words").cast("double")
    values = {
        "f_word": F.log((F.col("word_chars") + 50) / (n + 10)),
        "f_symbol": F.log1p(10 * F.col("n_symbols") / (n + 20)),
        "f_dup": F.col("n_dup_lines") / (F.col("n_lines") + 4.0),
        "f_repeat": F.col("n_repeat_words") / (n + 20),
        "f_shout": F.log1p(F.col("n_shout") / (n + 20)),
    }
    return stats.withColumns({k: F.round(v, 3) for k, v in values.items()})


def _pooled(stats: DataFrame) -> DataFrame:
    """Adds lang_key and source_key: the group whose estimate judges a row; null lang_key if none is large enough."""
    sizes = stats.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < MIN_GROUP)
    by_lang = small.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    rest = by_lang.where(F.col("lang_n") < MIN_GROUP).agg(F.sum("lang_n").alias("rest_n"))
    keyed = (
        sizes.join(by_lang, "lang", "left").join(rest, how="left")
        .select("lang", "source", F.when(F.col("n") >= MIN_GROUP, F.struct(F.concat(F.lit("="), "lang").alias("l"), F.concat(F.lit("="), "source").alias("s"))).when(F.col("lang_n") >= MIN_GROUP, F.struct(F.concat(F.lit("="), "lang").alias("l"), F.lit("*").alias("s"))).when(F.col("rest_n") >= MIN_GROUP, F.struct(F.lit("*").alias("l"), F.lit("*").alias("s"))).alias("k"))
        .select("lang", "source", F.col("k.l").alias("lang_key"), F.col("k.s").alias("source_key"))
    )
    keyed = stored(keyed)
    return stats.join(_checked(keyed), ["lang", "source"], "left")


def _checked(groups: DataFrame) -> DataFrame:
    """A table with a row or a few per group, to be broadcast if it is small."""
    return F.broadcast(groups) if groups.count() <= 3 * BROADCAST_GROUPS else groups


_NAMES = [name for name, _ in FEATURES]
_PAIRS = [(i, j) for i in range(len(_NAMES)) for j in range(i + 1)]
KEYS = ["lang_key", "source_key"]


def _log_distance(d2: Column) -> Column:
    return F.round(F.log(d2 + 1e-6), 2)


def _factored(estimate: DataFrame, *keys: str) -> DataFrame:
    """keys, log_det, means and the inverse Cholesky factor, from means and covariances (to which floors are added)."""
    for i, j in _PAIRS:  # covariance = L L'
        known = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"cov_{i}_{j}") + (FEATURES[i][1] ** 2 if i == j else 0.0))
        estimate = estimate.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(known, F.lit(1e-9))) if i == j else known / F.col(f"l_{j}_{j}"))
    for j in range(len(_NAMES)):  # inverse of L, by forward substitution
        for i in range(j, len(_NAMES)):
            known = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"inv_{k}_{j}"), range(j, i), F.lit(1.0 if i == j else 0.0))
            estimate = estimate.withColumn(f"inv_{i}_{j}", known / F.col(f"l_{i}_{i}"))
    log_det = reduce(lambda a, b: a + b, [2 * F.log(f"l_{i}_{i}") for i in range(len(_NAMES))])
    return estimate.select(*keys, log_det.alias("log_det"), *[f"mean_{i}" for i in range(len(_NAMES))], *[f"inv_{i}_{j}" for i, j in _PAIRS])


def _moments(columns: list[str]) -> list[Column]:
    return [F.avg(n).alias(f"mean_{i}") for i, n in enumerate(columns)] + [F.covar_pop(columns[i], columns[j]).alias(f"cov_{i}_{j}") for i, j in _PAIRS]


def _starts(rows: DataFrame) -> DataFrame:
    """The first estimates of each group: start 0, 1 and 2."""
    q = rows.groupBy(*KEYS).agg(*[F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n in _NAMES])
    spread = [F.sqrt(F.pow((F.col(n)[2] - F.col(n)[0]) / 1.349, 2) + floor * floor) for n, floor in FEATURES]
    middles = stored(q.select(*KEYS, *[F.col(n)[1].alias(f"mid_{i}") for i, n in enumerate(_NAMES)], *[s.alias(f"spread_{i}") for i, s in enumerate(spread)]))
    quartiles = middles.select(*KEYS, F.lit(0).alias("start"), *[F.col(f"mid_{i}").alias(f"mean_{i}") for i in range(len(_NAMES))], *[(F.pow(f"spread_{i}", 2) - FEATURES[i][1] ** 2 if i == j else F.lit(0.0)).alias(f"cov_{i}_{j}") for i, j in _PAIRS])
    plain = rows.groupBy(*KEYS).agg(*_moments(_NAMES)).withColumn("start", F.lit(1))
    shrunk = rows.join(_checked(middles), KEYS).withColumns({f"t_{i}": F.tanh((F.col(n) - F.col(f"mid_{i}")) / F.col(f"spread_{i}")) for i, n in enumerate(_NAMES)})
    scatter = shrunk.groupBy(*KEYS).agg(*_moments([f"t_{i}" for i in range(len(_NAMES))])).drop(*[f"mean_{i}" for i in range(len(_NAMES))])
    tanh = scatter.join(middles, KEYS).select(*KEYS, F.lit(2).alias("start"), *[F.col(f"mid_{i}").alias(f"mean_{i}") for i in range(len(_NAMES))], *[(F.col(f"cov_{i}_{j}") * F.col(f"spread_{i}") * F.col(f"spread_{j}")).alias(f"cov_{i}_{j}") for i, j in _PAIRS])
    return _factored(quartiles.unionByName(plain).unionByName(tanh), *KEYS, "start")


def _with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with d2, once per estimate of their group; the estimate's start, if there is one, stays."""
    joined = rows.join(_checked(estimate), KEYS, how)
    parts = [reduce(lambda a, b: a + b, [F.col(f"inv_{i}_{j}") * (F.col(_NAMES[j]) - F.col(f"mean_{j}")) for j in range(i + 1)]) for i in range(len(_NAMES))]
    return joined.withColumn("d2", reduce(lambda a, b: a + b, [p * p for p in parts])).select(*rows.columns, *(["start"] if "start" in estimate.columns else []), "d2")


def _c_step(rows: DataFrame, estimate: DataFrame, h: float) -> DataFrame:
    """New estimates from the share h of each group with the least distance."""
    near, keys = _with_distance(rows, estimate), [*KEYS, "start"]
    limit = stored(near.groupBy(*keys).agg(F.percentile(_log_distance(F.col("d2")), F.lit(h)).alias("limit")))
    chosen = near.join(_checked(limit), keys).where(_log_distance(F.col("d2")) <= F.col("limit"))
    return _factored(chosen.groupBy(*keys).agg(*_moments(_NAMES)), *keys)


def _least(estimates: DataFrame) -> DataFrame:
    """Per group the estimate with the least determinant."""
    rest = [c for c in estimates.columns if c not in KEYS]
    return estimates.groupBy(*KEYS).agg(F.min(F.struct("log_det", *[c for c in rest if c != "log_det"])).alias("e")).select(*KEYS, *[F.col(f"e.{c}").alias(c) for c in rest])


def minimum_determinant(rows: DataFrame, h: float = H) -> DataFrame:
    """The estimate of each group. rows: lang_key, source_key and the features."""
    estimate = stored(_starts(rows))
    for _ in range(FIRST_STEPS):
        estimate = stored(_c_step(rows, estimate, h))
    estimate = stored(_least(estimate))
    while True:  # ends: each round lowers a determinant that the floors bound from below
        lower = stored(_least(estimate.unionByName(_c_step(rows, estimate, h))))
        before = estimate.select(*KEYS, F.col("log_det").alias("before"))
        settled = lower.join(before, KEYS).where(F.col("before") - F.col("log_det") > TOLERANCE).isEmpty()
        estimate = lower
        if settled:
            return estimate.drop("start")


def outlier_rules(docs: DataFrame, h: float = H, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document row: counts, base verdict, distance and the final verdict."""
    stats = _pooled(stored(with_features(statistics(docs))))
    rows = stats.where("not base_failed and lang_key is not null").select(*KEYS, *_NAMES)
    estimate = minimum_determinant(rows, h)
    scale = _with_distance(rows, estimate).groupBy(*KEYS).agg(F.least(F.lit(1.0), CHI_H / F.exp(F.percentile(_log_distance(F.col("d2")), F.lit(h)))).alias("scale"))
    judged = _with_distance(stats, stored(estimate.join(scale, KEYS).transform(_scaled)), "left")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("d2") <= cutoff, F.lit(True)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"))


def _scaled(estimate: DataFrame) -> DataFrame:
    """The estimate whose distances are on the chi-square scale."""
    factor = F.sqrt("scale")
    return estimate.select("lang_key", "source_key", *[f"mean_{i}" for i in range(len(_NAMES))], *[(F.col(f"inv_{i}_{j}") * factor).alias(f"inv_{i}_{j}") for i in range(len(_NAMES)) for j in range(i + 1)])
