"""Token files and packing."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stratum.llm import packing, queries, token_file, tokens
from stratum.llm.common import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, length long, rank long"
ODD = [(5, "b text"), (1, None), (2, ""), (None, "null id"), (3, "same"), (3, "same"), (4, "very long  text " * 20_000), (6, "tab\t and\n newline \n end "), (7, "<|endoftext|>")]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, 3) for i, t in texts], DOCS)


def ids_of(name, text, end):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "lower")])
def test_columns_equal_the_whole_encoder(monkeypatch, name, kind):
    enc, plain = tokens.ColumnEncoder(tokens.tokenizer_path(name), cache_entries=64), Tokenizer.from_file(tokens.tokenizer_path(name))
    assert enc.kind == kind
    rng = random.Random(1)
    made = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 50))) for chars in ("abzS'sT \n\t.,1½éñ|<>&Ĳß東\xa0\u2003\x1d_", "aB é.,'\n!") for _ in range(1500)]
    special = ["x <|endoftext|> y", "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|"]
    texts = [t for _, t in ODD] + made + special
    monkeypatch.setattr(tokens, "SLICE_BYTES", 4000)
    found, at = [], 0
    for n, ids, bounds in enc.encode(pa.array(texts)):
        found += [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert len(found) - at == n
        at += n
    for text, ids in zip(texts, found, strict=True):
        assert ids == plain.encode(text or "", add_special_tokens=False).ids, text
    assert enc.one("x <|endoftext|> y") == plain.encode("x <|endoftext|> y", add_special_tokens=False).ids and plain.token_to_id("<|endoftext|>") in enc.one("<|endoftext|>")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.sampled_from([8, 8, 5, 3, 16]))
def test_codes_round_trip_and_random_access(ids, bits):
    data = token_file.encode_codes(np.array(ids, dtype=np.uint32), bits if bits != 16 else 8)
    reader = token_file.CodeReader(data)
    assert reader.decode().tolist() == ids and len(reader) == len(ids)
    for i in range(0, len(ids), 37):
        assert reader[i] == ids[i]
    with pytest.raises(IndexError):
        reader[len(ids)]


def test_token_file_of_odd_rows(spark):
    folder = shared_folder(spark)
    token_file.write_token_file(docs_of(spark, ODD), folder, partitions=3, segment_tokens=50)
    found = sorted(map(tuple, token_file.read_token_file(spark, folder).collect()), key=lambda r: r[1])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))  # texts with the same id are equal here
    start = 0
    for row, (doc_id, text) in zip(found, order, strict=True):
        ids = ids_of("byte_bpe_50k.json", text, 2)
        assert row == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    empty = shared_folder(spark)
    token_file.write_token_file(docs_of(spark, []), empty)
    assert token_file.read_token_file(spark, empty).count() == 0


def test_token_query(spark, sf_dir):
    found = {r.doc_id: r for r in queries.op4_token_file(spark, sf_dir).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of("byte_bpe_50k.json", r.text, 2)
        got = found[r.doc_id]
        assert (got.start, got.n_tokens, got.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def check_packing(rows, texts, capacity=2048):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = {}
    for doc_id, text in texts:
        want.setdefault(doc_id, []).append(ids_of("word_bpe_49k.json", text, 0))
    assert set(by_doc) == set(want)
    for doc_id, ids in want.items():
        pieces = sorted((i, at, len(x[at : at + capacity]), crc(x[at : at + capacity])) for x in ids for i, at in enumerate(range(0, len(x), capacity)))
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows) / capacity


def test_packing_of_odd_rows(spark):
    check_packing(packing.pack(docs_of(spark, ODD)).collect(), ODD)
    assert packing.pack(docs_of(spark, [])).count() == 0
    placed = {(r.sequence_id, r.offset): r for r in packing.pack(docs_of(spark, ODD), with_ids=True).collect()}
    for r in packing.packed_sequences(docs_of(spark, ODD)).collect():
        at, ids = 0, bytes(r.ids)
        assert len(ids) == 4 * r.n_tokens == 4 * sum(r.lengths)
        for doc_id, length in zip(r.doc_ids, r.lengths):
            assert placed[r.sequence_id, at].length == length
            assert zlib.crc32(ids[4 * at : 4 * (at + length)]) in {p.ids_crc32 for p in placed.values() if p.doc_id == doc_id and p.length == length}
            at += length


def test_packing_query(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    used, least = check_packing(queries.op10_best_fit_packing(spark, sf_dir).collect(), texts)
    assert used <= 1.03 * least + 2


def test_linear_groups_are_of_equal_cardinality():
    groups = packing.linear_groups({100: 7, 90: 1, 80: 12, 70: 5}, 5)
    sizes = [sum(n for _, n in g) for g in groups]
    assert sum(sizes) == 25 and max(sizes) - min(sizes) <= 1
    flat = [length for g in groups for length, _ in g]
    assert flat == sorted(flat, reverse=True)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 60), min_size=1, max_size=40))
def test_plans_place_every_piece_once(counts):
    recipes = packing.plan_recipes(counts, capacity=100, groups=10)
    seen = {}
    for n, items in recipes:
        assert sum(items) <= 100 and n > 0
        for length in items:
            seen[length] = seen.get(length, 0) + n
    assert seen == counts
    plain = sum(n for n, _ in packing.best_fit(dict(counts), [], 100))
    assert sum(n for n, _ in recipes) <= (1.0 if len(counts) <= 10 else 1.25) * plain + 3


def test_configurations_meet_the_demand():
    columns = packing.solve_configurations([60, 40, 30], [30, 40, 50], 100)
    for i, d in enumerate((30, 40, 50)):
        assert abs(sum(c[i] * x for c, x in columns) - d) < 1e-6
    assert sum(x for _, x in columns) < 30 + 5 + 15 + 1


def test_linear_grouping_carries_the_packing():
    """Most large pieces leave through configurations, and no more than 0.5 % of the sequences are wasted."""
    rng = np.random.default_rng(3)
    lengths = np.clip(np.concatenate((rng.lognormal(5.5, 1.0, 12_000), rng.normal(1100, 350, 6_000))).astype(int), 2, 2048)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    recipes, left = packing.configured(counts)
    large = sum(n for k, n in counts.items() if 4 * k > 2048 and k < 2048)
    assert sum(n for k, n in left.items() if 4 * k > 2048) <= 0.15 * large
    sequences = sum(n for n, _ in packing.plan_recipes(counts))
    assert sequences <= 1.002 * int(lengths.sum()) / 2048 + 1


def test_exchanges_gather_room():
    recipes = [(3, (60, 35)), (2, (55, 40)), (1, (65, 30)), (4, (100,))]
    found = packing.gathered(recipes, 100)
    seen = {}
    for n, items in found:
        assert sum(items) <= 100
        for length in items:
            seen[length] = seen.get(length, 0) + n
    assert seen == {60: 3, 35: 3, 55: 2, 40: 2, 65: 1, 30: 1, 100: 4}
    assert sum(n for n, _ in found) == 10 and sum(n for n, i in found if sum(i) == 100) >= 6
    again = packing.repacked(found, 100)
    assert sum(n for n, _ in again) <= 10


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 0), ("sf0.1", 3)])
def test_sequences_on_the_given_tables(spark, sf, most):
    """The bound on sf0.01 (442), and at most three sequences above it on sf0.1 (4,539)."""
    cut = packing.pieces(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    used = sum(n for n, _ in packing.plan_recipes(counts))
    assert used <= -(-sum(k * n for k, n in counts.items()) // 2048) + most
