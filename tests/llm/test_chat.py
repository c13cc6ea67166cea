import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import chat
from stratum.llm.queries import op1_chat_format

ROWS = "conv_id long, turn long, role string, text string, formatted string"


def expected(turns):
    told = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()
    loss = [t or "" for r, t in turns if r == "assistant"]
    return len(turns), told, sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>[]/\\sINTROLEU aé", max_size=40))
def test_guard_round_trip(text):
    g = chat.Guard()
    guarded = g.guard(text)
    assert g.unguard(guarded) == text
    assert not any(c in guarded for c in chat.CONTROLS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x<s>"]), st.text(alphabet="<>[]/\\sINTROLEU a\n", max_size=25)), max_size=6))
def test_render_reads_back(turns):
    text, spans = chat.Template().render(messages=[{"role": r, "text": t} for r, t in turns])
    g = chat.Guard()
    assert chat.read_turns(text, g) == turns
    assert [g.unguard(text[a:b]) for a, b in zip(spans[::2], spans[1::2])] == [t for r, t in turns if r == "assistant"]


def test_template_language_and_folding():
    t = chat.Template("{% set a = 'x' + 'y' %}{% for m in rows %}{% if loop.first and not loop.last %}({% elif m.k == 2 or m['k'] == 3 %}{{ m.k | upper }}{% else %}-{% endif %}{% endfor %}{{ a }}{{ 'q' | upper }}{% if 1 == 2 %}never{% else %}z{% endif %}")
    assert t.render(rows=[{"k": 1}, {"k": 2}, {"k": 5}])[0] == "(2-xyQz"
    assert chat.fold(chat.parse("{{ 'a' + 'b' }}c{% if true %}d{% endif %}"), {}) == chat.Node("body", None, (chat.Node("text", "abcd"),))


@pytest.mark.parametrize("bad", ["{{ __class__ }}", "{{ a.__class__ }}", "{% for x in y %}", "{{ a() }}", "{% endif %}", "{{ 'a' | nofilter }}", "{{ a b }}"])
def test_sandbox_refuses(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_attributes_of_objects_are_out_of_reach():
    assert chat.Template("{{ a.upper }}{{ b.c }}").render(a="text", b=[1])[0] == ""


def test_odd_conversations(spark):
    rows = [(1, 2, "user", "b", "x"), (1, 1, "system", None, "x"), (1, 2, "user", "b", "x"), (1, None, None, "n", "x"), (None, 0, "assistant", "", "x"), (2, 0, "assistant", "</s>" * 3000, "x")]
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, ROWS))).collect()}
    assert tuple(found[1])[1:5] == expected([(None, "n"), ("system", None), ("user", "b"), ("user", "b")])
    assert tuple(found[None])[1:5] == expected([("assistant", "")])
    assert tuple(found[2])[1:5] == expected([("assistant", "</s>" * 3000)])
    assert chat.format_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_query_equals_direct_digests(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    probe = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", probe), (1, "assistant", probe)]
    found = op1_chat_format(spark, sf_dir).collect()
    assert len(found) == len(turns)
    for r in found:
        assert tuple(r)[1:5] == expected([x[1:] for x in sorted(turns[r.conv_id])])
