"""Decontamination, licenses and secrets against brute force, and their odd inputs."""

import hashlib
import random
import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import decontaminate, licenses, queries, secrets
from stratum.llm.common import word_list

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, data string, spans string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "w", "d", "s") for i, t in texts], DOCS)


ODD = [(1, None), (2, ""), (None, "null id Aa bb"), (3, "same text here"), (3, "same text here"), (4, "x " * 60_000), (5, "  \n\t !!! "), (6, "Ünï çödé 東京 words")]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_equal_the_pattern(text):
    assert [w.decode() for w in word_list(text.encode("utf-8", "surrogatepass") if not any(0xD800 <= ord(c) < 0xE000 for c in text) else b"")] == ([] if any(0xD800 <= ord(c) < 0xE000 for c in text) else WORD.findall(lower(text)))


def brute_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        words = WORD.findall(lower(text))
        hit, found = set(), set()
        for item, body in items:
            own = WORD.findall(lower(body))
            k = min(10, len(own))
            grams = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
            for i in range(len(words) - k + 1) if grams else ():
                if tuple(words[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found.add("" if item is None else str(item))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_contamination(docs, items)
    assert any(r[-1] for r in want)
    assert sorted(map(tuple, queries.op7_decontamination(spark, sf_dir).collect()), key=str) == want


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_CHARS, 0])
def test_contamination_of_odd_rows_both_ways(spark, bound):
    texts = [*ODD[:5], *ODD[6:], (7, "say the Quick brown! fox"), (8, " ".join(f"w{i}" for i in range(30))), (8, "alpha one two")]
    items = [(1, "quick brown fox"), (1, "quick brown fox"), (None, "one two"), (2, None), (3, "..."), (4, " ".join(f"W{i}" for i in range(5, 18))), (11, " ".join(f"w{i}" for i in range(9, 20)))]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    found = decontaminate.contamination(docs_of(spark, texts), bench, broadcast_chars=bound)
    assert sorted(map(tuple, found.collect()), key=str) == brute_contamination(texts, items)
    assert decontaminate.contamination(docs_of(spark, []), bench, broadcast_chars=bound).count() == 0
    assert not decontaminate.contamination(docs_of(spark, texts), bench.where("false"), broadcast_chars=bound).where("contaminated").count()


def test_removal_keeps_clean_rows_and_cuts_passages(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [(1, "Clean, as it is.\n"), (2, f"{'before it '*15}({item}) after, it"), (3, item), (4, None)]
    kept = {r.doc_id: r for r in decontaminate.remove_contaminated(docs_of(spark, texts), bench).collect()}
    assert set(kept) == {1, 2, 4}
    assert kept[1].text == texts[0][1] and kept[4].text is None
    assert "w5" not in kept[2].text and kept[2].text.startswith("before it") and kept[2].n_chars == len(kept[2].text)
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs_of(spark, texts), bench, mode="document").collect()} == {1, 4}


@pytest.mark.parametrize("mode", ["span", "document"])
def test_removal_is_the_same_both_ways(spark, mode):
    passage = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(1, passage), (2, "short one"), (None, "quick brown fox")], "item_id long, text string")
    long = f"{'before it '*40}({passage}) after, it"
    texts = [*ODD, (20, long), (20, "clean row of an id with a hit row"), (None, f"{long} Quick, brown fox!"), (21, passage), (22, "short one"), (23, f"{passage} {passage} and a few"), (24, long), (24, long)]
    ways = [sorted(map(tuple, decontaminate.remove_contaminated(docs_of(spark, texts), bench, mode=mode, broadcast_chars=b).collect()), key=str) for b in (decontaminate.BROADCAST_CHARS, 0)]
    assert ways[0] == ways[1]
    ids = [r[0] for r in ways[1]]
    assert (ids.count(20), ids.count(None), ids.count(24)) == ((2, 2, 2) if mode == "span" else (1, 1, 0))
    assert not {21, 22, 23} & set(ids)


def brute_license(text):
    words = WORD.findall(lower(text))
    places, base, found = [], set(), {}
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    lines = [x for x in (WORD.findall(lower(line)) for line in (text or "").split("\n")) if x]
    blocks = [set(x) for x in lines] + [set(w for x in lines[i : i + licenses.BLOCK_LINES] for w in x) for i in range(len(lines))]
    for label, templates in licenses.TEMPLATES.items():
        for t in templates:
            own = set(WORD.findall(lower(t)))
            for b in blocks:
                if len(own & b) / len(own) >= licenses.THRESHOLD - 1e-9:
                    found[label] = max(found.get(label, 0), len(own & b) / len(own))
    score = max([*found.values(), 1.0 if base else 0.0])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), score


def test_license_scan_equals_brute_force(spark, sf_dir):
    rng = random.Random(5)
    whole = [t for texts in licenses.TEMPLATES.values() for t in texts]
    made = []
    for i in range(120):
        words = rng.choice(whole).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "MIT"])
        if rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), "\n")
        made.append((i, "first line\n" + " ".join(words) + "\nlast line"))
    texts = [*ODD, *made, (900, "Under the MIT license; under the mit LICENSE. apache license version 2")]
    found = sorted(map(tuple, licenses.license_scan(docs_of(spark, texts)).collect()), key=str)
    assert found == sorted(((i, *brute_license(t)) for i, t in texts), key=str)
    assert len({r[6] for r in found}) > 4
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op8_license_scan(spark, sf_dir).collect())) == sorted((i, *brute_license(t)) for i, t in real)


def test_notices_wrapped_over_many_lines_are_found():
    index = licenses.TemplateIndex({})
    rng = random.Random(3)
    for label, templates in licenses.TEMPLATES.items():
        for t in templates:
            own = WORD.findall(lower(t))
            length = int(len(own) / licenses.THRESHOLD + 1e-9)
            for width in (1, 20, 40):
                wrapped = textwrap.fill(t, width, break_long_words=False)
                assert label in index.scan(f"Some words before.\n# {wrapped}\nand some behind".encode())[5].split(",")
                assert index.scan(wrapped.encode())[6] == 1.0
            for _ in range(30):
                words = [w for w in own for w in ([w] if rng.random() < 0.85 else [w, "other"] if rng.random() < 0.5 else [])]
                words = ["before"] * 5 + words + rng.choices(own, k=3)
                most = max(len(set(words[i : i + length]) & set(own)) for i in range(len(words)))
                found = index.match_stretches([w.encode() for w in words], {w.encode() for w in words}).get(label, 0.0)
                assert most < licenses.THRESHOLD * len(set(own)) - 1e-9 or found >= most / len(set(own))
                assert len(templates) > 1 or found == (most / len(set(own)) if most >= licenses.THRESHOLD * len(set(own)) - 1e-9 else 0.0)


KINDS = (
    ("assign", re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def brute_base(text):
    spans = [(m.start(), i, m.end(), kind) for i, (kind, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Token", "api_key", "SECRET", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789ab", "é", "ſecret", "-", ".", "\n", "x"]), max_size=16))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    assert [f"{k}:{s}:{e}" for s, e, k in secrets.find_spans(text.encode(), None)] == brute_base(text)


def test_secret_scan(spark, sf_dir):
    rng = random.Random(9)
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = secrets.train(plain)
    keys = ["".join(rng.choices(secrets.ALPHABET[:62], k=40)) for _ in range(100)]
    assert sum(model.score(k.encode()) > model.threshold for k in keys) >= 95
    assert not any(model.score(w) > model.threshold for w in (b"compute_running_average_of_values", b"InternationalizationSupport", b"src/operators/spatial.txt"))
    texts = [*ODD, (70, f"é key {keys[0]} end"), (71, "password = 'abcdefghijkl1234'"), (71, "password = 'abcdefghijkl1234'")]
    rows = secrets.secret_scan(docs_of(spark, texts), model).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[70].spans == f"markov:6:{6 + 40}" and by_id[1].spans == "" and by_id[71].n_assign == 1
    found = {r.doc_id: r for r in queries.op6_secret_scan(spark, sf_dir).collect()}
    for r in plain.collect():
        base = brute_base(r.text)
        got = found[r.doc_id]
        assert got.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in got.spans.split(",") if x and not x.startswith("markov")] == base
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
    assert secrets.secret_scan(docs_of(spark, []), model).count() == 0


def test_keys_within_longer_runs_are_found(spark, sf_dir):
    rng = random.Random(4)
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = secrets.train(plain)
    befores = ("srv/app/config/production/", "long_setting_name=", "0123456789abcdef-", "https.example.com/some/longer/path/of/words/")
    found = 0
    for i in range(200):
        key, before = "".join(rng.choices(secrets.ALPHABET[:62], k=40)), befores[i % 4]
        spans = [x for x in secrets.find_spans(f"see {before}{key}/tail/of/ordinary/names here".encode(), model) if x[2] == "markov"]
        found += any(s <= 4 + len(before) and e >= 4 + len(before) + 40 for s, e, _ in spans)
    assert found >= 190
    words = secrets.ordinary_samples(sorted(set().union(*(secrets.words_of((r.text or "").encode()) for r in plain.collect()))), seed=8)
    flagged = sum(any(x[2] == "markov" for x in secrets.find_spans(w.encode(), model)) for w in words)
    assert flagged <= 0.005 * len(words)
    odd = "".join(rng.choices(secrets.ALPHABET[:52], k=40))
    thresholds = [secrets.RandomnessModel(secrets.random_samples(), [*([odd] if extra else ["ordinary"]), *words]).threshold for extra in (False, True)]
    assert abs(thresholds[1] - thresholds[0]) < 0.02


def test_redaction(spark):
    texts = [(1, "keep this"), (2, "a token: abcdefghijkl0123456789abcdef0123456789abcdef b"), (3, None)]
    out = {r.doc_id: r for r in secrets.redact_secrets(docs_of(spark, texts), secrets.RandomnessModel(secrets.random_samples(400), ["ordinary", "words"] * 20)).collect()}
    assert out[1].text == "keep this" and out[3].text is None
    assert out[2].text == "a <SECRET> b" and out[2].n_chars == len("a <SECRET> b")


def test_secret_model_of_labelled_samples(spark):
    rows = [(x, True) for x in secrets.random_samples(800)] + [(w, False) for w in secrets.ordinary_samples([b"compute", b"running", b"average", b"values", b"source", b"table"])] + [(None, True), ("nobody says", None)]
    samples = spark.createDataFrame(rows, "sample string, is_random boolean")
    model = secrets.train(docs_of(spark, []), samples=samples)
    assert sum(model.score(x.encode()) > model.threshold for x in secrets.random_samples(200, seed=99)) >= 190
    assert not model.stretches(b"compute_running_average_values")
    told = [w for w, random in rows if random is False]
    assert not any(model.stretches(w.encode()) for w in told)
    fresh = secrets.ordinary_samples([b"compute", b"running", b"average", b"values", b"source", b"table"], seed=31)
    assert not any(model.stretches(w.encode()) for w in fresh)


def test_best_ratio_shows_the_method(spark):
    key = secrets.random_samples(1, seed=5)[0]
    model = secrets.RandomnessModel(secrets.random_samples(800), secrets.ordinary_samples([b"compute", b"running", b"average", b"values"] * 4))
    rows = {r.doc_id: r for r in secrets.secret_scan(docs_of(spark, [(1, f"see {key} there"), (2, "see compute_running_average_values there"), (3, "short"), (4, None)]), model).collect()}
    assert rows[1].n_markov == 1 and rows[1].best_ratio > model.threshold
    assert rows[2].n_markov == 0 and rows[2].best_ratio <= model.threshold
    assert rows[3].best_ratio is None and rows[4].best_ratio is None
