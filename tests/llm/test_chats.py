import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import op6_chat_formatting as op
from plumbline.llm.templates import Const, Escaper, Out, Safe, TemplateError, compile_template, fold, parse_template

pieces = st.lists(st.sampled_from([*op.CONTROLS, "\\", "\\a", "[", "<", "s>", "INST]", "é", " ", "\n", "text"]), max_size=12).map("".join)


@given(pieces)
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_complete(text):
    e = Escaper(op.CONTROLS)
    escaped = e.escape(text)
    assert e.unescape(escaped) == text and not any(c in escaped for c in op.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<s>", ""]), pieces), max_size=6), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_turns_are_read_back(turns, size):
    program = compile_template(op.TEMPLATE, op.CONTROLS)
    parts = list(op._parts(program({"role": r, "text": t} for r, t in turns), size))
    reader = op._Turns(Escaper(op.CONTROLS))
    found = [turn for k, (text, _) in enumerate(parts) for turn in reader.feed(text, k == len(parts) - 1)]
    assert found == turns
    e = Escaper(op.CONTROLS)
    assert "".join(e.unescape(text[s["start"] : s["end"]]) for text, spans in parts for s in spans) == "".join(t for r, t in turns if r == "assistant")


def render(source, messages=()):
    return "".join(t for t, _ in compile_template(source, ("<s>",))(messages))


def test_language():
    ms = [{"role": "a", "text": "<s>x"}, {"role": "b", "text": None}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m.role | upper }}:{{ m.text }};{% endfor %}", ms) == "1A:\\as>x;2B:;"
    assert render("{% set x = 'a' ~ 'b' %}{% if x == 'ab' and not false %}yes{% elif true %}no{% else %}never{% endif %}") == "yes"
    assert render("{{ '<s>' }}{# note #}{{ none }}{{ 1 + 2 }}") == "<s>12"
    assert render("{{ messages.items }}{{ nothing.at.all }}") == ""


def test_constants_are_folded():
    assert fold(parse_template("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}")) == (Out(Const(Safe("abcd"))),)


@pytest.mark.parametrize("source", ["{% if x %}", "{{ a( }}", "{{ a[0] }}", "{% for in x %}{% endfor %}", "{{ x | eval }}", "{% bad %}", "{{ }}", "{{ __import__ }}", "{{ messages.__class__ }}"])
def test_sandbox(source):
    with pytest.raises(TemplateError):
        compile_template(source, ())


def test_query_on_edge_rows(spark, tmp_path):
    long = "<s>é " * 4000
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", "A"), (2, 0, None, None), (3, 0, "assistant", long), (3, 1, "assistant", long), (None, 0, "user", "n"), (4, 0, "user", "same"), (4, 0, "user", "same"), (5, None, "system", "[INST]")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    path = op.format_chats(df, str(tmp_path / "chats"), part_chars=1000)
    got = {r["conv_id"]: r for r in op.digest(op.read_chats(spark, path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert got[1]["turns_sha256"] == sha("user\nA\nassistant\nB\n") and got[1]["loss_sha256"] == sha("B") and got[1]["loss_chars"] == 1
    assert got[2]["turns_sha256"] == sha("\n\n") and got[3]["loss_sha256"] == sha(long * 2) and got[3]["loss_chars"] == 2 * len(long)
    assert got[4]["n_turns"] == 2 and got[5]["turns_sha256"] == sha("system\n[INST]\n")
    empty = op.format_chats(df.limit(0), str(tmp_path / "none"))
    assert op.digest(op.read_chats(spark, empty)).count() == 0


def test_dashes_take_white_space_away():
    from plumbline.llm.templates import compile_template

    shown = lambda t: "".join(x for x, _ in compile_template(t, ())([{"text": "a"}, {"text": "b"}]))
    assert shown("x \n{%- for m in messages -%}  {{ m.text }} {%- endfor -%}\n y") == "xaby"
    assert shown("x {{- 'q' -}} y") == "xqy" and shown("x {{ 'q' }} y") == "x q y"
