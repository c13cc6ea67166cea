import random

import numpy as np
import pytest

from stratum.llm import near_duplicates as nd
from stratum.llm import queries
from stratum.llm.common import word_list
from stratum.operators.regions import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, comp long, bands string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, "b") for i, t in texts], DOCS)


def grams(text):
    words = word_list((text or "").encode())
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def brute(texts):
    """(doc_id, class_id, set_id, n_links, n_class_links) of every row with an id."""
    rows = [(i, grams(t)) for i, t in texts if i is not None]
    sets, ids = {}, {}
    for i, g in rows:
        if g:
            sets.setdefault(g, []).append(i)
    rep = {g: min(own) for g, own in sets.items()}
    keys = list(sets)
    linked = {g: [h for h in keys if h is not g and len(g & h) >= 0.8 * len(g | h) - 1e-9] for g in keys}
    root = {r: r for r in rep.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for g in keys:
        for h in linked[g]:
            a, b = sorted((find(rep[g]), find(rep[h])))
            root[b] = a
    out = []
    for i, g in rows:
        if not g:
            out.append((i, i, i, 0, 0))
        else:
            out.append((i, find(rep[g]), rep[g], len(sets[g]) - 1 + sum(len(sets[h]) for h in linked[g]), len(linked[g])))
    return sorted(out), ids


def made(seed, n_groups=12, size=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for g in range(n_groups):
        base = rng.choices(vocabulary, k=rng.choice((6, 40, 120, 300)))
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper() + "!")
    return list(enumerate(texts, 100 * seed))


ODD = [(1, None), (2, ""), (None, "an id that is null"), (3, "same text"), (3, "same text"), (4, "x " * 40_000 + "end"), (5, "x " * 40_000 + "end"), (6, " !!! "), (7, "Same, TEXT"), (8, "a different text with one id"), (8, "of two rows under one id")]


def test_band_plan_reaches_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (0.9, 0.999)):
        bands, rows = nd.band_plan(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


@pytest.mark.parametrize("blocks", [(512, 150_000), (3, 400)])
def test_join_equals_brute_force(spark, blocks):
    texts = [*made(1), *ODD]
    found = sorted(map(tuple, nd.jaccard_join(docs_of(spark, texts), block_classes=blocks[0], block_grams=blocks[1]).collect()))
    want, _ = brute([t for t in texts if t[0] != 8])
    assert [r for r in found if r[0] != 8] == want
    assert len([r for r in found if r[0] == 8]) == 2
    assert any(r[4] for r in want) and any(r[3] > r[4] for r in want)


def test_query_equals_brute_force(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_ngram_jaccard_join(spark, sf_dir).collect())) == brute(texts)[0]


def test_keep_one(spark):
    texts = [*made(2), *ODD]
    docs = docs_of(spark, texts)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    want = sorted({c for _, c, *_ in brute(texts)[0]} | {-1})
    assert got == want


def test_empty_table(spark):
    assert nd.jaccard_join(docs_of(spark, [])).count() == 0
    assert nd.keep_one(docs_of(spark, [])).count() == 0


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "src long, dst long")
    found = {r.node: r.comp for r in connected_components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_word_codes_depend_on_the_word_alone():
    codes = nd._word_codes([b"ab", b"c", b"ab", b"abc", b"ba"])
    assert codes[0] == codes[2] and len(np.unique(codes)) == 4
