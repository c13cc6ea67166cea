import hashlib
import random

import numpy as np
import pytest

from stratum.llm import queries
from stratum.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, lang string, source string, n_chars long, did long, fp long, h long, spans string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3, "s") for i, t in texts], DOCS)


def brute(texts, length):
    seen = {}
    data = [(i, (t or "").encode()) for i, t in texts]
    for _, b in data:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    out = []
    for i, b in data:
        covered = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                covered[p : p + length] = True
        runs = int((np.diff(np.concatenate(([0], covered.astype(int)))) == 1).sum())
        out.append((i, len(b), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(b, dtype=np.uint8)[~covered].tobytes()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 40))) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 20))) for _ in range(3)]
        if rng.random() < 0.7:
            parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append((i, " ".join(parts)))
    texts += [(100, "na " * 80), (101, "x" * 90), (102, "x" * 41), (103, "ab" * 30 + "c" + "ab" * 30)]
    return texts


ODD = [(1000, None), (1001, ""), (None, "null id but a long enough text that stands twice in all"), (1002, "null id but a long enough text that stands twice in all"), (1003, "repeated row " * 5), (1003, "repeated row " * 5), (1004, "unlike all others, " + "0123456789" * 3)]


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("width", [16, 30])
def test_removal_equals_brute_force(spark, hot, width):
    texts = [*made(width + hot), *ODD]
    found = sd.dedup_digests(docs_of(spark, texts), length=40, width=width, hot_rows=hot)
    want = brute(texts, 40)
    rows = sorted(map(tuple, found.collect()), key=str)
    assert [r[:5] for r in rows] == want
    assert all(r[5] == r[1] - r[2] and r[6] == (r[2] > 0) for r in rows)
    kept = sd.dedup_texts(docs_of(spark, texts), length=40, width=width, hot_rows=hot).collect()
    assert sorted((str(r.doc_id), hashlib.sha256(r.kept).hexdigest()) for r in kept) == sorted((str(r[0]), r[4]) for r in want)
    assert 0 < sum(r[2] > 0 for r in want) < len(want)


def test_whole_query_equals_brute_force(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r)[:5] for r in queries.op9_suffix_dedup(spark, sf_dir).collect()), key=str) == brute(texts, 400)


def test_empty_table_and_bad_parameters(spark):
    assert sd.dedup_digests(docs_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sd.dedup_digests(docs_of(spark, []), length=40, width=40)


def test_anchors_follow_the_string_alone():
    rng = np.random.default_rng(0)
    own = rng.integers(0, 4, 400, dtype=np.uint8)
    a = np.concatenate((rng.integers(0, 4, 77, dtype=np.uint8), own, rng.integers(0, 4, 50, dtype=np.uint8)))
    x, y = sd.string_anchors(own, 60, 24), sd.string_anchors(a, 60, 24)
    assert (x == y[77 : 77 + len(x)] - 77).all()


def test_chunks_do_not_change_anchors(monkeypatch):
    data = np.random.default_rng(1).integers(0, 3, 5000, dtype=np.uint8)
    whole = sd.string_anchors(data, 60, 24)
    monkeypatch.setattr(sd, "CHUNK", 333)
    assert (sd.string_anchors(data, 60, 24) == whole).all()


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_merging_shards_gives_the_sorted_order_with_common_prefixes(shards):
    rng = random.Random(shards)
    strings = ["".join(rng.choices("ab", k=rng.randint(0, 30))).encode() for _ in range(400)]
    bucket, shard = np.array([rng.randrange(4) for _ in strings]), np.array([rng.randrange(shards) for _ in strings])
    rank, shared = np.empty(400, dtype=np.int32), np.empty(400, dtype=np.int32)
    for k in range(shards):
        own = np.flatnonzero(shard == k)
        rank[own], shared[own] = sd.shard_order(bucket[own], [strings[i] for i in own], 30)
    order, common = sd.merge_interleave(bucket, shard, rank, shared, strings, 30)
    rows = [(bucket[i], strings[i].ljust(32, b"\0")) for i in order]
    assert rows == sorted(rows)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        same = next((j for j, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert common[k] == (same if bucket[order[k - 1]] == bucket[order[k]] else -1)
