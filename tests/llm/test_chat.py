"""The template compiler and the exact round trip of conversations."""

import hashlib
import random

import pytest

from siteworks.llm.chat import (
    CONTROLS, TEMPLATE, Const, Output, TemplateError, compile_template, escape, fold, format_conversations, parse, read_back, read_turns, unescape,
)


def render(source, turns=()):
    return compile_template(source)([dict(t) for t in turns])[0]


def test_language():
    turns = [{"role": "user", "text": "a"}, {"role": "tool", "text": "b"}]
    assert render("x{{ 'a' ~ 1 + 2 }}y") == "xa12y" and render("{{ 1 + 2 }}") == "3"
    assert render("{% for t in turns %}{% if t.role == 'user' %}U{% elif t.text in 'abc' %}T{{ t.text | upper }}{% else %}-{% endif %}{% endfor %}", turns) == "UTB"
    assert render("{% set a = 'q' %}{{ a }}{{ not a }}{{ b }}{{ turns.x }}") == "qfalse"
    assert render("{% for t in turns %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", turns) == "1,2"
    assert render(r"{{ 'it\'s' }}{{ ('a' == 'b') or 'z' }}") == "it'sz"
    assert compile_template("{% for t in turns %}<{% generation %}{{ t.text }}{% endgeneration %}>{% endfor %}")(turns) == ("<a><b>", [(1, 2), (4, 5)])


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{{ 'd' ~ 2 }}{% else %}e{% endif %}f")) == (Output(Const("aBcd2f")),)
    assert fold(parse("{% if false and x %}a{% endif %}b")) == (Output(Const("b")),)


@pytest.mark.parametrize(
    "bad",
    ["{{ a", "{% if x %}", "{% for x %}{% endfor %}", "{{ a.b.c }}", "{{ a | exec }}", "{{ f() }}", "{{ a[0] }}", "{% import os %}", "{{ a b }}", "{{ }}", "{{ (a }}", "{% endif %}"],
)
def test_outside_the_sandbox(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_no_way_to_python_objects():
    assert render("{{ turns.__class__ }}{% for t in turns %}{{ t.__class__ }}{% endfor %}", [{"role": "", "text": ""}]) == ""
    with pytest.raises(TemplateError):
        render("{% for c in 'abc' %}{% endfor %}")


def test_escaping_is_reversible_and_hides_controls():
    rng = random.Random(1)
    bits = [*CONTROLS, "\\", "<", "|", "[", "\\\\", "é", "<|", "|>", "</", "s>", "\n", "end|>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROLS)
        made, marks = compile_template(TEMPLATE)([{"role": text, "text": text}, {"role": "assistant", "text": text}])
        assert read_turns(made) == [(text, text), ("assistant", text)] or text == "assistant"
        assert [unescape(made[s:e]) for s, e in marks][-1] == text


def test_conversations_come_back(spark):
    tricky = "</s>[INST] ok [/INST]"
    rows = [
        (1, 2, "assistant", "b\\"), (1, 1, "user", "a"), (1, 3, None, None), (2, 1, "assistant", ""), (-7, 0, "user", tricky),
        (-7, 1, "assistant", tricky), (None, 1, "user", "é<|end|>" * 5000), (3, 1, "user", "same"), (3, 1, "user", "same"), (3, None, "assistant", "x"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, marks int").repartition(3)
    got = {r.conv_id: r for r in read_back(format_conversations(frame)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    convs = {c: sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")) for c in {r[0] for r in rows}}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(whole), len(loss), sha(loss))
    assert read_back(format_conversations(frame.limit(0))).collect() == []
