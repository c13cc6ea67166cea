import hashlib
import math

import numpy as np
import pytest

from stratum.llm import vector_codes as vc

ROWS = "vec_id long, embedding array<float>, label int, q string, of string, code int, known int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, e, label, "q", "o", 1, 2) for i, e, label in rows], ROWS)


def brute(rows, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in np.array(e, np.float32).tolist()], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(q) for _, q, _ in kept), default=0) // 8)
    kept = [(i, q + [0] * (8 * width - len(q)), label) for i, q, label in kept]
    cut = lambda q: [q[m * width : (m + 1) * width] for m in range(8)]
    books = [[cut(q)[m] for _, q, _ in kept[:16]] for m in range(8)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for m in range(8):
            own = {}
            for _, q, _ in kept:
                own.setdefault(near(cut(q)[m], books[m])[1], []).append(cut(q)[m])
            books[m] = [[sum(c) // len(own[i]) for c in zip(*own[i])] if i in own and width else e for i, e in enumerate(books[m])]
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = [(i, [near(p, books[m]) for m, p in enumerate(cut(q))], label) for i, q, label in kept]
    errors = {}
    for _, f, label in found:
        errors[label] = errors.get(label, 0) + sum(d for d, _ in f)
    return sorted(((i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[label], sha) for i, f, label in found), key=str)


def got(spark, rows, **kw):
    return sorted((tuple(r) for r in vc.code_digests(vectors_of(spark, rows), **kw).collect()), key=str)


@pytest.mark.parametrize("dim", [8, 24, 19])
def test_codes_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    middles = rng.normal(size=(9, dim))
    rows = [(int(i), (middles[rng.integers(9)] + rng.normal(size=dim) * 0.2).astype(np.float32).tolist(), rng.choice([None, 1, 2])) for i in rng.permutation(200)]
    rows = [(i, e, None if label is None else int(label)) for i, e, label in rows]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows, rounds=0) == brute(rows, 0)


def test_defined_cases(spark):
    one = [0.5, -0.25, 1.0, 0.0, -1.5, 0.1, -0.1, 2.0]
    bad = [(50, None, 1), (51, [None, *one[1:]], 1), (52, [float("nan"), *one[1:]], 1), (53, [float("inf"), *one[1:]], None), (54, [float("-inf"), *one[1:]], None)]
    assert got(spark, []) == [] and got(spark, bad) == []
    assert got(spark, [*bad, (3, one, None)]) == brute([(3, one, None)])
    ties = [(7, one, 1), (7, one, 1), (None, one[::-1], None), (None, one, None), (2, one[:3], 2), (1, [], 2)] + [(100 + i, one, 5) for i in range(30)]
    assert got(spark, ties) == brute(ties)
    assert got(spark, [(1, [], 2), (2, [], 2)]) == brute([(1, [], 2), (2, [], 2)])
    huge = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)]
    assert [r[2] for r in got(spark, huge)] == [0, 0]


def test_bounds_lose_no_entry_and_prune():
    rng = np.random.default_rng(3)
    middles = rng.integers(-9000, 9000, size=(16, 8))
    parts = middles[rng.integers(16, size=3000)] + rng.integers(-300, 300, size=(3000, 8))
    parts[:50] = middles[0]
    entries = np.concatenate([middles[:8], middles[:8]])  # every entry twice: ties
    pivots = middles[:4]
    search = vc.PivotSearch(entries, pivots)
    index, best = search.nearest(parts, np.sqrt(vc.squared(parts[:, None], pivots[None]).astype(float)))
    every = vc.squared(parts[:, None], entries[None])
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert (search.bounds(np.sqrt(vc.squared(parts[:, None], pivots[None]).astype(float))) <= every).all()
    assert search.evaluations < 0.5 * every.size


def test_a_code_gives_its_vector_back(spark):
    rows = [(i, [float((i * k) % 7) for k in range(16)], 1) for i in range(40)]
    codes, books = vc.product_codes(vectors_of(spark, rows))
    integers = {r.vec_id: np.array(r.q) for r in vc.integer_vectors(vectors_of(spark, rows)).collect()}
    for r in codes.collect():
        assert ((integers[r.vec_id] - vc.decoded(r.code, books)) ** 2).sum() == r.error
