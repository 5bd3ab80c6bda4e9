"""A template compiler for chat formats.

A template is text with ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``; a dash inside a
tag strips the white space on that side. Statements: ``for x in list`` (with ``loop``), ``if`` / ``elif``
/ ``else``, ``set name = expression``, and ``generation``, whose output is what a model learns to write.
Expressions: literals, names, ``.name`` and ``[key]``, arithmetic, ``~`` to join as text, comparisons,
``in``, ``and`` / ``or`` / ``not``, ``a if c else b``, ``is [not] defined`` and filters after ``|``.

The language is a sandbox: there are no calls, names are those of the context, members are looked up in
mappings and lists only, filters are a fixed set with those that the caller gives, and the only loops
run over lists that exist. A template is parsed to a syntax tree, whose constant parts are folded (what does
not depend on the context is computed once, branches that cannot be taken go, neighbouring texts join), and the
tree becomes nested Python closures. Nothing is passed to ``eval``.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import regex


class TemplateError(ValueError):
    """The template is not of the language, or asks for what the sandbox does not give."""


class Undefined:
    """What a name or member that does not exist stands for: empty text, false."""

    def __bool__(self):
        return False

    def __str__(self):
        return ""

    def __eq__(self, other):
        return isinstance(other, Undefined)

    def __hash__(self):
        return 0


UNDEFINED = Undefined()


# Syntax tree.


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Member:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """A pure function of its operands: operators and filters."""

    fn: Callable
    args: tuple


@dataclass(frozen=True)
class Choice:
    """``a if c else b``; also ``and`` and ``or``, whose result is one of the operands."""

    kind: str
    args: tuple


@dataclass(frozen=True)
class Defined:
    of: Any


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class Set:
    name: str
    of: Any


@dataclass(frozen=True)
class If:
    """(condition, body) in turn; the condition of ``else`` is a true constant."""

    branches: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple
    otherwise: tuple = ()


@dataclass(frozen=True)
class Generation:
    body: tuple


# Values.


def shown(value: Any) -> str:
    """As text: true and false in lower case, nothing for null."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def member(of: Any, key: Any) -> Any:
    """A value of a mapping or an item of a list or text; never an attribute."""
    if isinstance(of, Mapping):
        return of.get(key, UNDEFINED)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else UNDEFINED
    return UNDEFINED


def _add(a, b):
    return a + b


def _times(a, b):
    if any(isinstance(x, (str, list, tuple)) for x in (a, b)):
        raise TemplateError("only numbers are multiplied")
    return a * b


def _contains(a, b):
    return shown(a) in b if isinstance(b, str) else a in b


FILTERS: dict[str, Callable] = {
    "trim": lambda v: shown(v).strip(),
    "upper": lambda v: shown(v).upper(),
    "lower": lambda v: shown(v).lower(),
    "capitalize": lambda v: shown(v).capitalize(),
    "string": shown,
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, Mapping)) else 0,
    "first": lambda v: member(v, 0),
    "last": lambda v: member(v, -1),
    "default": lambda v, other="": other if isinstance(v, Undefined) or v is None else v,
    "replace": lambda v, old, new: shown(v).replace(shown(old), shown(new)),
    "join": lambda v, between="": shown(between).join(map(shown, v or ())),
}

COMPARE = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": _contains, "not in": lambda a, b: not _contains(a, b),
}
SUMS = {"+": _add, "-": operator.sub, "~": lambda a, b: shown(a) + shown(b)}
PRODUCTS = {"*": _times, "/": operator.truediv, "//": operator.floordiv, "%": operator.mod}

_TAG = regex.compile(r"\{\{-?|\{%-?|\{#")
_TOKEN = regex.compile(
    r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<sign>==|!=|<=|>=|//|[-+*/%~<>()\[\].,|=:]))", regex.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "if", "else", "is"}
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Parses one tag's inside by recursive descent, the loosest operator first."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        i, source = 0, source.rstrip()
        while i < len(source):
            m = _TOKEN.match(source, i)
            if not m:
                raise TemplateError(f"cannot read {source[i:i + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            i = m.end()

    def peek(self, *wanted: str) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return text if kind in ("name", "sign") and text in wanted else None

    def accept(self, *wanted: str) -> str | None:
        found = self.peek(*wanted)
        self.at += found is not None
        return found

    def expect(self, wanted: str) -> None:
        if not self.accept(wanted):
            raise TemplateError(f"{wanted!r} expected at {self.tokens[self.at:self.at + 3]}")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or text in _WORDS or text in _LITERALS:
            raise TemplateError(f"a name expected, not {text!r}")
        self.at += 1
        return text

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        value = self.choice()
        self.end()
        return value

    def choice(self):
        value = self.either()
        if self.accept("if"):
            condition = self.either()
            other = self.choice() if self.accept("else") else Const("")
            return Choice("if", (condition, value, other))
        return value

    def either(self):
        value = self.both()
        while self.accept("or"):
            value = Choice("or", (value, self.both()))
        return value

    def both(self):
        value = self.negation()
        while self.accept("and"):
            value = Choice("and", (value, self.negation()))
        return value

    def negation(self):
        return Apply(operator.not_, (self.negation(),)) if self.accept("not") else self.comparison()

    def comparison(self):
        value = self.sum()
        while True:
            if self.accept("is"):
                absent = self.accept("not")
                self.expect("defined")
                value = Defined(value)
                value = Apply(operator.not_, (value,)) if absent else value
            elif self.peek("not") and self.tokens[self.at + 1:self.at + 2] == [("name", "in")]:
                self.at += 2
                value = Apply(COMPARE["not in"], (value, self.sum()))
            elif sign := self.accept("==", "!=", "<=", ">=", "<", ">", "in"):
                value = Apply(COMPARE[sign], (value, self.sum()))
            else:
                return value

    def sum(self):
        value = self.product()
        while sign := self.accept(*SUMS):
            value = Apply(SUMS[sign], (value, self.product()))
        return value

    def product(self):
        value = self.sign()
        while sign := self.accept(*PRODUCTS):
            value = Apply(PRODUCTS[sign], (value, self.sign()))
        return value

    def sign(self):
        return Apply(operator.neg, (self.sign(),)) if self.accept("-") else self.postfix()

    def postfix(self):
        value = self.atom()
        while True:
            if self.accept("."):
                value = Member(value, Const(self.name()))
            elif self.accept("["):
                value = Member(value, self.choice())
                self.expect("]")
            elif self.accept("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                more = self.arguments() if self.accept("(") else ()
                value = Apply(self.filters[name], (value, *more))
            elif self.peek("("):
                raise TemplateError("nothing can be called")
            else:
                return value

    def arguments(self) -> tuple:
        out = []
        while not self.accept(")"):
            if out:
                self.expect(",")
            out.append(self.choice())
        return tuple(out)

    def atom(self):
        if self.accept("("):
            value = self.choice()
            self.expect(")")
            return value
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind == "number":
            self.at += 1
            return Const(float(text) if "." in text else int(text))
        if kind == "text":
            self.at += 1
            return Const(regex.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=regex.DOTALL))
        if text in _LITERALS and kind == "name":
            self.at += 1
            return Const(_LITERALS[text])
        return Name(self.name())


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """("text" | "output" | "statement", content) in turn."""
    at, strip = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at:m.start()] if m else source[at:]
        text = text.lstrip() if strip else text
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            yield "text", text
        if not m:
            return
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = _closing(source, m.end(), close)
        inside, at = source[m.end():end], end + 2
        strip = close != "#}" and inside.endswith("-")
        if close != "#}":
            yield "output" if close == "}}" else "statement", inside[:-1] if strip else inside


def _closing(source: str, at: int, close: str) -> int:
    """Where the tag ends; quoted texts are passed over."""
    quote = None
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = None if c == quote else quote
        elif close != "#}" and c in "'\"":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    raise TemplateError(f"{close!r} is missing")


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The statements of a template."""
    pieces = list(_pieces(source))
    body, at = _body(pieces, 0, (), filters)
    if at < len(pieces):
        raise TemplateError(f"unexpected {pieces[at][1].strip()!r}")
    return body


def _body(pieces: list, at: int, ends: tuple[str, ...], filters) -> tuple[tuple, int]:
    """Statements up to one of ``ends``, and the place of that."""
    out = []
    while at < len(pieces):
        kind, inside = pieces[at]
        at += 1
        if kind == "text":
            out.append(Text(inside))
            continue
        e = _Expression(inside, filters)
        if kind == "output":
            out.append(Output(e.whole()))
            continue
        word = e.name() if not e.peek("if", "else") else e.accept("if", "else")
        if word in ends:
            return tuple(out), at - 1
        if word == "set":
            name = e.name()
            e.expect("=")
            out.append(Set(name, e.whole()))
        elif word == "if":
            branches, condition = [], e.whole()
            while condition is not None:
                inner, at = _body(pieces, at, ("elif", "else", "endif"), filters)
                branches.append((condition, inner))
                condition, at = _condition(pieces, at, filters)
            out.append(If(tuple(branches)))
        elif word == "for":
            name = e.name()
            e.expect("in")
            over, other = e.whole(), ()
            inner, at = _body(pieces, at, ("else", "endfor"), filters)
            if pieces[at][1].strip() == "else":
                other, at = _body(pieces, at + 1, ("endfor",), filters)
            out.append(For(name, over, inner, other))
            at += 1
        elif word == "generation":
            e.end()
            inner, at = _body(pieces, at, ("endgeneration",), filters)
            out.append(Generation(inner))
            at += 1
        else:
            raise TemplateError(f"no statement {word!r} here")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(out), at


def _condition(pieces: list, at: int, filters) -> tuple[Any, int]:
    """The condition of the branch that begins here, or None at the end."""
    e = _Expression(pieces[at][1], filters)
    if e.accept("else"):
        e.end()
        return Const(True), at + 1
    if e.name() == "endif":
        return None, at + 1
    return e.whole(), at + 1


# Constant folding.


def fold(node):
    """The node with everything computed that does not depend on the context."""
    if isinstance(node, tuple):
        return _joined(x for n in node for x in _fold_statement(n))
    if isinstance(node, Member):
        node = Member(fold(node.of), fold(node.key))
        return Const(member(node.of.value, node.key.value)) if _const(node.of, node.key) else node
    if isinstance(node, Apply):
        node = Apply(node.fn, tuple(map(fold, node.args)))
        if not _const(*node.args):
            return node
        try:
            return Const(node.fn(*(a.value for a in node.args)))
        except (TypeError, ArithmeticError, ValueError):
            return node  # fails when, and only if, it is reached
    if isinstance(node, Choice):
        first, *rest = map(fold, node.args)
        if not _const(first):
            return Choice(node.kind, (first, *rest))
        if node.kind == "if":
            return rest[0] if first.value else rest[1]
        return rest[0] if bool(first.value) == (node.kind == "and") else first
    if isinstance(node, Defined):
        of = fold(node.of)
        return Const(not isinstance(of.value, Undefined)) if _const(of) else Defined(of)
    return node


def _const(*nodes) -> bool:
    return all(isinstance(n, Const) for n in nodes)


def _fold_statement(node) -> Iterator:
    if isinstance(node, Output):
        of = fold(node.of)
        yield Text(shown(of.value)) if _const(of) else Output(of)
    elif isinstance(node, Set):
        yield replace(node, of=fold(node.of))
    elif isinstance(node, If):
        branches = []
        for condition, body in node.branches:
            condition = fold(condition)
            if _const(condition) and not condition.value:
                continue
            branches.append((condition, fold(body)))
            if _const(condition):
                break
        if branches and _const(branches[0][0]):
            yield from branches[0][1]
        elif branches:
            yield If(tuple(branches))
    elif isinstance(node, For):
        over = fold(node.over)
        if _const(over) and not over.value:
            yield from fold(node.otherwise)
        else:
            yield For(node.name, over, fold(node.body), fold(node.otherwise))
    elif isinstance(node, Generation):
        yield Generation(fold(node.body))
    else:
        yield node


def _joined(nodes: Iterable) -> tuple:
    out: list = []
    for n in nodes:
        if isinstance(n, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + n.value)
        elif not (isinstance(n, Text) and not n.value):
            out.append(n)
    return tuple(out)


# Closures.


@dataclass
class Sink:
    """Collects output and the spans (in characters) that are marked as generated."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    marking: bool = False

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """What came since the last call; spans count from there."""
        out = "".join(self.parts), self.spans
        self.parts, self.size, self.spans = [], 0, []
        return out


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name, UNDEFINED)
    if isinstance(node, Member):
        of, key = _value(node.of), _value(node.key)
        return lambda env: member(of(env), key(env))
    if isinstance(node, Defined):
        of = _value(node.of)
        return lambda env: not isinstance(of(env), Undefined)
    args = [_value(a) for a in node.args]
    if isinstance(node, Choice):
        if node.kind == "if":
            condition, yes, no = args
            return lambda env: yes(env) if condition(env) else no(env)
        a, b = args
        return (lambda env: a(env) and b(env)) if node.kind == "and" else (lambda env: a(env) or b(env))
    fn = node.fn
    if len(args) == 1:
        only = args[0]
        return lambda env: fn(only(env))
    if len(args) == 2:
        a, b = args
        return lambda env: fn(a(env), b(env))
    return lambda env: fn(*(a(env) for a in args))


def _steps(items: Iterable) -> Iterator[tuple[Any, dict]]:
    """Each item with its ``loop``, one item ahead so that the last is known."""
    held, i = [], 0
    previous = UNDEFINED
    for item in items:
        held.append(item)
        if len(held) == 2:
            yield held[0], {"index0": i, "index": i + 1, "first": not i, "last": False, "previtem": previous, "nextitem": item}
            previous, i = held.pop(0), i + 1
    if held:
        yield held[0], {"index0": i, "index": i + 1, "first": not i, "last": True, "previtem": previous, "nextitem": UNDEFINED}


def _statements(body: tuple) -> Callable[[dict, Sink], None]:
    steps = [_statement(n) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(env, sink):
        for step in steps:
            step(env, sink)

    return run


def _statement(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, Text):
        text = node.value
        return lambda env, sink: sink.write(text)
    if isinstance(node, Output):
        of = _value(node.of)
        return lambda env, sink: sink.write(shown(of(env)))
    if isinstance(node, Set):
        name, of = node.name, _value(node.of)
        return lambda env, sink: env.__setitem__(name, of(env))
    if isinstance(node, If):
        branches = [(_value(c), _statements(b)) for c, b in node.branches]

        def choose(env, sink):
            for condition, body in branches:
                if condition(env):
                    return body(env, sink)

        return choose
    if isinstance(node, Generation):
        body = _statements(node.body)

        def mark(env, sink):
            if sink.marking:
                return body(env, sink)
            start, sink.marking = sink.size, True
            body(env, sink)
            sink.marking = False
            sink.spans.append((start, sink.size))

        return mark
    name, over, body, other = node.name, _value(node.over), _statements(node.body), _statements(node.otherwise)

    def repeat(env, sink):
        items = over(env)
        if isinstance(items, Undefined) or items is None:
            items = ()
        if not isinstance(items, (list, tuple, Mapping)):
            raise TemplateError("only lists are looped over")
        for item, loop in _steps(items):
            body({**env, name: item, "loop": loop}, sink)
        if not items:
            other(env, sink)

    return repeat


def _uses(node, name: str) -> bool:
    """Whether a tree mentions the name."""
    if isinstance(node, Name):
        return node.name == name
    if isinstance(node, tuple):
        return any(_uses(n, name) for n in node)
    return any(_uses(v, name) for v in vars(node).values()) if hasattr(node, "__dataclass_fields__") else False


class Program:
    """A compiled template: ``render`` gives the text and the marked spans."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.tree = fold(parse(source, {**FILTERS, **(filters or {})}))
        self.run = _statements(self.tree)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For) and n.over == Name("messages")]
        self.loop = None
        if len(loops) == 1:
            i, n = loops[0], self.tree[loops[0]]
            before, after = self.tree[:i], self.tree[i + 1:]
            if not any(_uses(b, "messages") for b in (before, n.body, n.otherwise, after)):
                self.loop = n.name, _statements(before), _statements(n.body), _statements(n.otherwise), _statements(after)

    @property
    def streams(self) -> bool:
        """Whether messages can go through one by one: the template loops over them once and no more."""
        return self.loop is not None

    def render(self, messages: list[dict], **context) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        self.run({**context, "messages": messages}, sink)
        return sink.take()

    def pieces(self, messages: Iterable[dict], **context) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """What ``render`` gives, in pieces that follow one another; spans count from a piece's start.

        If the template streams there is one piece for each message, the last with what
        follows; messages are taken one ahead. Else there is a single piece.
        """
        if self.loop is None:
            yield self.render(list(messages), **context)
            return
        name, before, body, otherwise, after = self.loop
        env, sink = dict(context), Sink()
        before(env, sink)
        some = False
        for item, loop in _steps(messages):
            body({**env, name: item, "loop": loop}, sink)
            some = True
            if not loop["last"]:
                yield sink.take()
        if not some:
            otherwise(env, sink)
        after(env, sink)
        yield sink.take()
