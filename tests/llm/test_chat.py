from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafclock.llm import chat
from leafclock.llm.chat import CONTROLS, Escaper, Format, Reader
from leafclock.llm.chat_template import Const, For, Program, TemplateError, Text, fold, parse

SCHEMA = "conv_id long, turn long, role string, text string, piece string, spans int, n_turns string"
ESCAPER = Escaper(CONTROLS)
LOOKALIKE = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "]", "s>", "INST]", "é", " ", "\n", "/"]), max_size=12).map("".join)


def digest(text):
    return sha256(text.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append(((turn is not None, turn or 0), (role is not None, role or ""), text or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r[1], t) for _, r, t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "x") for r in rows], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(LOOKALIKE)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    got = ESCAPER.escape(text)
    assert ESCAPER.unescape(got) == text
    assert not any(c in got for c in CONTROLS)
    assert any(c[1:] in text for c in CONTROLS) or got == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "user\n"]), LOOKALIKE), max_size=6))
def test_formats_and_reads_back(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    program = Format().program()
    whole, spans = program.render(messages)
    reader, got, learned, at = Reader(), [], [], 0
    for text, own in program.pieces(iter(messages)):
        assert whole.startswith(text, at)
        got += reader.feed(text)
        learned += [ESCAPER.unescape(text[a:b]) for a, b in own]
        assert [(a + at, b + at) for a, b in own] == spans[len(learned) - len(own):len(learned)]
        at += len(text)
    reader.close()
    assert at == len(whole) and got == turns and learned == [t for r, t in turns if r == "assistant"]


def test_table(spark):
    x = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", x), (1, 1, "assistant", x), (2, 3, "assistant", ""), (2, 2, "user", None), (2, 1, "system", "s[ROLE]"),
            (3, None, None, "no role"), (None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "é" * 300_000),
            (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "assistant", "b"), (4, 0, "assistant", "a")]
    rows += [(9, t, ("user", "assistant")[t % 2], f"turn {t} [/TURN]") for t in range(3000)]
    got = chat.digests(frame(spark, rows).repartition(4)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    pieces = chat.formatted(frame(spark, rows)).collect()
    for r in got:
        text = "".join(p.text for p in sorted((p for p in pieces if p.conv_id == r.conv_id), key=lambda p: p.piece))
        assert len(text) == r.formatted_chars and digest(text) == r.formatted_sha256
    assert max(len(p.spans) for p in pieces if p.conv_id == 9) == 1


def test_planted_and_empty(spark):
    assert chat.digests(frame(spark, [])).collect() == []
    (got,) = chat.digests(chat.with_planted(frame(spark, []))).collect()
    assert (got.conv_id, got.n_turns, got.loss_chars) == (-7, 2, 21)


@pytest.mark.parametrize("source, want", [
    ("{{ 1 + 2 * 3 }}{{ '-' ~ none ~ true }}", "7-true"),
    ("a {%- if x is defined %}{{ x }}{% elif y %}{{ y.z[0] }}{% else %}no{% endif -%} b", "aqb"),
    ("{% for v in list %}{{ loop.index }}{{ v | upper }}{{ '' if loop.last else ',' }}{% else %}none{% endfor %}", "1A,2B"),
    ("{% for v in absent %}x{% else %}none{% endfor %}{# {{ no }} #}", "none"),
    ("{% set k = list | length %}{{ k == 2 and 'two' or 'other' }}{{ not k }}{{ -k }}{{ 'a' not in list }}", "twofalse-2false"),
    ("{{ y['z'] | join('+') }}{{ missing.of.it | default('d') }}{{ \"%}\" }}{{ 'it\\'s' }}", "q+rd%}it's"),
])
def test_language(source, want):
    context = {"y": {"z": ["q", "r"]}, "list": ["a", "b"]}
    assert Program(source).render([], **context)[0] == want


def test_constant_parts_are_folded():
    tree = fold(parse("a{{ 'b' ~ (1 + 1) }}{% if 1 > 2 %}no{% elif true %}c{% else %}{{ x }}{% endif %}{{ '  d ' | trim }}"))
    assert tree == (Text("ab2cd"),)
    assert fold(parse("{% for x in [] if false %}{% endfor %}".replace("[] if false", "'' if false else none"))) == ()
    loop = fold(parse("{% for m in messages %}{{ 'x' | upper }}{{ '' }}y{% endfor %}"))
    assert isinstance(loop[0], For) and loop[0].body == (Text("Xy"),)
    assert not isinstance(fold(parse("{{ 1 / 0 if x else 2 }}"))[0], Const)
    assert Program("{{ 1 / 0 if x else 2 }}").render([])[0] == "2"


@pytest.mark.parametrize("source", [
    "{{ f() }}", "{{ x.upper() }}", "{{ x | eval }}", "{{ x", "{% for a in b %}", "{% endif %}", "{{ 'a' * 9 }}{{ x }}",
    "{% include 'x' %}", "{{ a b }}", "{% if x %}{% endfor %}", "{{ x['a' }}"])
def test_sandbox_and_errors(source):
    with pytest.raises(TemplateError):
        Program(source).render([], x="a")


def test_no_attributes():
    assert Program("{{ x.__class__ }}{{ messages.append }}{{ x['__class__'] }}").render([], x="a")[0] == ""


def test_masks_and_streaming():
    assert Program("a{% generation %}b{% generation %}c{% endgeneration %}{% endgeneration %}d").render([]) == ("abcd", [(1, 3)])
    whole = Program("{% for m in messages %}{{ m.t }}{% endfor %}{{ messages | length }}")
    assert not whole.streams and list(whole.pieces(iter([{"t": 1}, {"t": 2}]))) == [("122", [])]
    one = Program("<{% for m in messages %}{{ loop.previtem.t }}{{ m.t }}{{ loop.nextitem.t }}{% if loop.last %}!{% endif %}{% endfor %}>")
    assert one.streams and [p for p, _ in one.pieces(iter([{"t": 1}, {"t": 2}]))] == ["<12", "12!>"]
    assert [p for p, _ in one.pieces([])] == ["<>"]
