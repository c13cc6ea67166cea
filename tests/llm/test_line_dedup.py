import hashlib
import random

from stratum.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, row string, gone string, h1 long, did long, fp string, place string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "r", "g", 3, 4, "f", "p") for i, t in rows], DOCS)


def key_of(line):
    return line.strip(SPACE).translate({65 + i: 97 + i for i in range(26)})


def brute(rows, least_chars=40, least_docs=5):
    smallest = -(2**63)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= least_chars:
                holders.setdefault(key_of(line), set()).add(smallest if i is None else i)
    keeper = {k: max(ids) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key_of(x), smallest if i is None else i) == (smallest if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digested(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=str)


def found(spark, rows, *args):
    return sorted(map(tuple, line_dedup.line_digests(docs_of(spark, rows), *args).collect()), key=str)


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choices(["Über", "Alpha", "beta", "GAMMA", "é", "delta"], k=n)) for n in (3, 8, 9, 10, 12, 15, 15, 20)]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", "  "]) + rng.choice([str.lower, str.upper, str])(rng.choice(pool)) + rng.choice(["", "\t", "\r"]) if rng.random() < 0.5 else f"own {i} " * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(lines)))
    assert found(spark, rows) == digested(brute(rows))
    assert found(spark, rows, 5, 2) == digested(brute(rows, 5, 2))


def test_defined_cases(spark):
    common = "a line that stands in very many documents of this table"
    rows = [(1, None), (2, ""), (3, common), (3, common), (3, "x\n" + common + "\n\n"), (None, common), (None, common), (None, None), (7, common + "\n" + common + "\nend"), (8, "\n" + common), (9, f"top\n{common.upper()} \n{common}")]
    assert found(spark, rows) == digested(brute(rows))
    assert {r[0]: r[3] for r in brute(rows)}[3] == "x\n\n"
    assert found(spark, []) == []


def test_a_document_of_repeats_counts_once(spark):
    line = "forty code points or more are needed in a line"
    rows = [(1, "\n".join([line] * 5000)), (2, line), (3, line), (4, line)]
    assert [r[2] for r in found(spark, rows)] == [0, 0, 0, 0]
    assert found(spark, [*rows, (5, line)]) == digested(brute([*rows, (5, line)]))


def test_other_columns_stay(spark):
    line = "forty code points or more are needed in a line"
    got = line_dedup.drop_repeated_lines(docs_of(spark, [(i, f"{i}\n{line}") for i in range(6)] + [(9, None)]))
    assert got.columns == docs_of(spark, []).columns
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].text for i in range(6)] == ["0", "1", "2", "3", "4", f"5\n{line}"] and rows[9].text is None
    assert rows[0].gone == "g" and rows[0].did == 4


def test_no_python_workers(spark):
    plan = line_dedup.line_digests(docs_of(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
