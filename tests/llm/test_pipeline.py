"""The pipeline's stages, each on what its predecessor kept."""

import math
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tokens import check_packing

from stratum.llm import decontaminate, near_duplicates, quality, secrets
from stratum.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(i)))
        docs, before = spark.read.parquet(str(tmp_path / str(i))), docs
        seen[name] = (before, docs)
        if i < 4:
            assert docs.columns == columns
    labels = quality.graded(table(spark, sf_dir, "labels"))
    grade = lambda df, g: df.join(labels.where(F.col("grade") == g), F.col("doc_id") == F.col("label_id")).count()
    before, after = seen["quality classifier"]
    assert grade(after, 2) >= 0.98 * grade(before, 2) and grade(after, 0) == 0
    before, after = seen["n-gram Jaccard join"]
    assert 0 < after.count() < before.count()
    assert after.select("text").distinct().count() == after.count()
    before, after = seen["benchmark decontamination"]
    bench = table(spark, sf_dir, "benchmark")
    assert decontaminate.contamination(before, bench).where("contaminated").count() > 0
    assert decontaminate.contamination(after, bench).where("contaminated").count() == 0
    clean = decontaminate.contamination(before, bench).where("not contaminated").select("doc_id")
    assert before.join(clean, "doc_id").exceptAll(after.select(before.join(clean, "doc_id").columns)).count() == 0
    before, after = seen["secret scans"]
    assert after.count() == before.count() and after.where("text like '%<SECRET>%'").count() > 0
    before, after = seen["best-fit packing"]
    assert after.select("doc_id").distinct().count() == before.count()


def test_run_gives_the_last_stages_rows(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert "sequence_id" in out.columns and out.count() > 0


def plainly_kept(model, text):
    """The classifier's verdict from the formula alone."""
    words = (text or "").encode().split()
    if not words:
        return False
    counts = Counter()
    for w in words:
        counts.update(x for x in quality.word_features(w) if x)
    counts[quality._hash(b"repeat", quality.BITS)] += sum(a == b for a, b in zip(words, words[1:]))
    score = sum(float(model.weights[k]) * math.sqrt(n / len(words)) for k, n in counts.items())
    return 1 - 1 / (1 + math.exp(-(model.thresholds[quality.SELECT_GRADE - 1] - score))) >= quality.KEEP_AT


def plain_groups(rows):
    """doc_id -> smallest doc_id of its group of near duplicates, by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = WORD.findall(lower(text))
        k = min(near_duplicates.NGRAM, len(w))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= near_duplicates.THRESHOLD * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def plain_windows(text):
    words = WORD.findall(lower(text))
    k = min(10, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def plainly_cut(text, windows):
    """The text without benchmark passages; None if the document goes."""
    words = WORD.findall(lower(text))
    hit = np.zeros(len(words), dtype=bool)
    for k in {len(w) for w in windows}:
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit[i : i + k] = True
    if not hit.any():
        return text
    return None if hit.mean() > 0.5 else decontaminate.cut_words(text, hit)


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    passage = " ".join(WORD.findall(table(spark, sf_dir, "benchmark").where("length(text) > 80").first().text)[:10])
    kept_text = docs.orderBy(F.length("text").desc()).first().text
    odd = [(900_001, None), (900_002, ""), (900_003, f"{kept_text} {passage}"), (900_004, kept_text), (900_005, f"{passage} and more"), (900_006, kept_text + " token = abcdefghijkl0123456789")]
    extra = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], docs.schema)
    docs, labels = docs.unionByName(extra), table(spark, sf_dir, "labels")
    docs.write.parquet(str(tmp_path / "in"))
    docs, stages = spark.read.parquet(str(tmp_path / "in")), dict(corpus_pipeline.STAGES)

    def run(name, docs):
        stages[name](spark, docs, sf_dir).write.parquet(str(tmp_path / name.replace(" ", "_")))
        out = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        return out, {r.doc_id: r.text for r in out.collect()} if "text" in out.columns else None

    before = {r.doc_id: r.text for r in docs.collect()}
    model = quality.train(docs, labels)
    docs, after = run("quality classifier", docs)
    assert after == {i: t for i, t in before.items() if (plainly_kept(model, t) if model else bool((t or "").split()))}
    groups = plain_groups(list(after.items()))
    docs, unique = run("n-gram Jaccard join", docs)
    assert unique == {i: t for i, t in after.items() if groups[i] == i} and len(unique) < len(after)
    windows = {w for r in table(spark, sf_dir, "benchmark").collect() for w in plain_windows(r.text)}
    cut = {i: plainly_cut(t, windows) for i, t in unique.items()}
    docs, clean = run("benchmark decontamination", docs)
    assert clean == {i: t for i, t in cut.items() if t is not None}
    secret_model = secrets.train(docs)
    docs, safe = run("secret scans", docs)
    assert safe == {i: secrets.redact(t, secrets.find_spans(t.encode(), secret_model)) for i, t in clean.items()}
    check_packing(stages["best-fit packing"](spark, docs, sf_dir).collect(), list(safe.items()))


def test_stages_on_empty_tables_and_clashing_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0).withColumns({"spans": F.lit("x"), "_loser": F.lit(1), "rid": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        docs = out if name != "best-fit packing" else docs


@pytest.mark.parametrize("broadcast_chars", [0, 1 << 20])
def test_removal_with_clashing_columns(spark, broadcast_chars):
    """Both ways of finding hits, on documents whose columns have the names that the operator might use."""
    passage = " ".join(f"bench{i}" for i in range(12))
    rows = [(1, f"before {passage} after some more words that stay here and there in the text as it was before it came"), (2, passage), (3, "clean"), (4, None), (None, "clean too")]
    names = ("key", "spans", "spans_", "row", "_hit_key", "_hit_spans", "_row_key", "item", "h", "k", "i")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    benchmark = spark.createDataFrame([(7, passage, "x", 1)], "item_id long, text string, key string, h int")
    out = decontaminate.remove_contaminated(docs, benchmark, broadcast_chars=broadcast_chars)
    assert out.columns == docs.columns
    found = {r.doc_id: r for r in out.collect()}
    assert set(found) == {1, 3, 4, None} and "bench" not in found[1].text and found[1].text.split()[:2] == ["before", "after"]
    assert all(found[3][n] == n for n in names)
