"""Communities by modularity: planted groups, the measure against all pairs, and settled, stable labels."""

import random
from collections import defaultdict

from stratum.operators import ml


def brute(edges, labels, resolution=1.0):
    degree, weight = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        weight[a, b] += w
        weight[b, a] += w
        degree[a] += w
        degree[b] += w
    total = sum(degree.values())
    return sum(weight[a, b] - resolution * degree[a] * degree[b] / total for a in degree for b in degree if labels[a] == labels[b]) / total


def planted(groups=6, size=12, inside=0.7, across=0.03, seed=1):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else across)]


def found(spark, edges, resolution=1.0):
    return {r.node: r.label for r in ml.graph_communities(spark.createDataFrame(edges, "src long, dst long, w double"), resolution, 0.0).collect()}


def test_planted_communities_are_found_and_stable(spark):
    edges = planted()
    labels = found(spark, edges)
    assert labels == {i: i // 12 * 12 for i in range(72)}
    random.Random(5).shuffle(edges)
    assert found(spark, [(b, a, w) for a, b, w in edges]) == labels


def test_modularity_equals_all_pairs_and_no_move_gains(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(1, 4))) for _ in range(60)]  # loops and repeats too
    for resolution in (0.6, 1.5):
        labels = found(spark, edges, resolution)
        told = spark.createDataFrame(list(labels.items()), "node long, label long")
        score = brute(edges, labels, resolution)
        assert abs(ml.modularity(spark.createDataFrame(edges, "src long, dst long, w double"), told, resolution) - score) < 1e-9
        assert score > brute(edges, {n: n for n in labels}, resolution)
        assert all(min(n for n in labels if labels[n] == c) == c for c in labels.values())
        groups = sorted(set(labels.values()))
        for c in groups:  # no two whole communities gain by merging
            for d in groups:
                assert brute(edges, {n: c if g == d else g for n, g in labels.items()}, resolution) <= score + 1e-9


def test_resolution_splits_a_ring_of_cliques(spark):
    cliques = [(5 * c + i, 5 * c + j, 1.0) for c in range(8) for i in range(5) for j in range(i)]
    ring = [(5 * c, 5 * ((c + 1) % 8) + 1, 1.0) for c in range(8)]
    fine, coarse = found(spark, cliques + ring, 1.0), found(spark, cliques + ring, 0.1)
    assert len(set(fine.values())) == 8 and all(fine[5 * c] == fine[5 * c + 4] for c in range(8))
    assert len(set(coarse.values())) < 8


def test_no_edges_and_nulls(spark):
    assert ml.graph_communities(spark.createDataFrame([(None, 1)], "src long, dst long")).isEmpty()
    assert found(spark, [(3, 3, 2.0)]) == {3: 3}
