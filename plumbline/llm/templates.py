"""A small template compiler for chat formats.

The language has text, `{{ expression }}`, `{% if %} {% elif %} {% else %} {% endif %}`, `{% for x in y %}
{% endfor %}`, `{% set x = expression %}` and `{% generation %} {% endgeneration %}`, which marks what a model has to
produce; `{%-`, `-%}`, `{{-` and `-}}` take away the white space beside them. Expressions know strings, integers, names, `a.b` (a key of a mapping), `+` and `~` (joining), `==`, `!=`,
`in`, `not`, `and`, `or`, brackets, and the filters trim, upper and lower. There are no calls, no Python attributes
and no indexing, so a template can reach nothing but the values it is given.

compile_template() parses the source into a syntax tree, folds what is constant (joined literals, comparisons of
literals, branches that are never or always taken, neighbouring texts) and turns the tree into nested closures. A
rendering is a generator of (text, generated) and reads its messages one by one, so a conversation of any length needs
the memory of one message.

Text that comes from values is escaped as it meets text of the template: each control string in it loses its first
character to a code, and the backslash that starts such codes is doubled. unescape() reverses this exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

Segment = tuple[str, bool]


class TemplateError(ValueError):
    pass


class Safe(str):
    """Text of the template, which is not escaped."""

    __slots__ = ()


class Escaper:
    """Makes control strings in values harmless, reversibly."""

    def __init__(self, controls: Iterable[str]):
        self.controls = tuple(controls)
        if any(not c or "\\" in c for c in self.controls):
            raise TemplateError("control strings are not empty and have no backslash")
        firsts = sorted({c[0] for c in self.controls})
        self.codes = {c: chr(ord("a") + i) for i, c in enumerate(firsts)}
        self.firsts = {v: k for k, v in self.codes.items()} | {"\\": "\\"}
        starts = "|".join(re.escape(c) for c in sorted(self.controls, key=len, reverse=True))
        self.pattern = re.compile(rf"\\|(?=(?:{starts}))." if starts else r"\\", re.S)

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: "\\\\" if m[0] == "\\" else "\\" + self.codes[m[0]], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", lambda m: self.firsts[m[1]], text, flags=re.S) if "\\" in text else text


# The syntax tree.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    kind: str  # join, ==, !=, in, and, or, not, or a filter's name
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


#: A dash inside a tag's bracket takes the white space on that side away.
_TAGS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_LEX = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z][A-Za-z0-9_]*)|(?P<op>==|!=|[+~().|]))")
_FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over the words of one expression."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at : at + 20]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] != "string" and self.words[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def whole(self) -> object:
        found = self.either()
        if self.at != len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return found

    def either(self) -> object:
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self) -> object:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> object:
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        left = self.joined()
        for kind in ("==", "!=", "in"):
            if self.take(kind):
                return Op(kind, (left, self.joined()))
        return left

    def joined(self) -> object:
        left = self.filtered()
        while self.take("+", "~"):
            left = Op("join", (left, self.filtered()))
        return left

    def filtered(self) -> object:
        left = self.atom()
        while self.take("|"):
            kind, name = self.words[self.at] if self.at < len(self.words) else ("", "")
            if kind != "name" or name not in _FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            left = Op(name, (left,))
        return left

    def atom(self) -> object:
        if self.take("("):
            found = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is open")
            return found
        if self.at >= len(self.words):
            raise TemplateError("an expression is missing")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "string":
            return Const(Safe(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), word[1:-1], flags=re.S)))
        if kind == "int":
            return Const(int(word))
        if kind != "name":
            raise TemplateError(f"unexpected {word!r}")
        found: object = {"true": Const(True), "false": Const(False), "none": Const(None)}.get(word, Name(word))
        while self.take("."):
            kind, word = self.words[self.at] if self.at < len(self.words) else ("", "")
            if kind != "name":
                raise TemplateError("a key is missing")
            self.at += 1
            found = Key(found, word)
        return found


@dataclass
class _Parser:
    """Statements, nested by their end tags."""

    source: str
    items: list[tuple[str, str]] = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        last, trim = 0, False
        for m in _TAGS.finditer(self.source):
            text = self.source[last : m.start()]
            text = text.lstrip() if trim else text
            self.items.append(("text", text.rstrip() if m[1] or m[4] else text))
            if m[2] is not None:
                self.items.append(("out", m[2]))
            elif m[5] is not None:
                self.items.append(("tag", m[5].strip()))
            last, trim = m.end(), bool(m[3] or m[6])
        self.items.append(("text", self.source[last:].lstrip() if trim else self.source[last:]))

    def body(self, *ends: str) -> tuple[tuple, str]:
        """Statements up to one of the end tags, and that tag."""
        found: list = []
        while self.at < len(self.items):
            kind, value = self.items[self.at]
            self.at += 1
            word = value.split(None, 1)[0] if kind == "tag" and value else ""
            rest = value[len(word) :].strip()
            if kind == "text":
                if value:
                    found.append(Out(Const(Safe(value))))
            elif kind == "out":
                found.append(Out(_Expression(value).whole()))
            elif word in ends:
                return tuple(found), value
            elif word == "set":
                name, _, value = rest.partition("=")
                if not name.strip().isidentifier():
                    raise TemplateError(f"cannot set {name.strip()!r}")
                found.append(Set(name.strip(), _Expression(value).whole()))
            elif word == "if":
                found.append(self.branches(rest))
            elif word == "for":
                name, sep, over = rest.partition(" in ")
                if not sep or not name.strip().isidentifier():
                    raise TemplateError(f"cannot loop over {rest!r}")
                inner, _ = self.body("endfor")
                found.append(For(name.strip(), _Expression(over).whole(), inner))
            elif word == "generation":
                found.append(Generation(self.body("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected tag {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return tuple(found), ""

    def branches(self, condition: str) -> If:
        found = []
        test: object = _Expression(condition).whole()
        while True:
            inner, end = self.body("elif", "else", "endif")
            found.append((test, inner))
            word, _, rest = end.partition(" ")
            if word == "endif":
                return If(tuple(found))
            test = _Expression(rest).whole() if word == "elif" else Const(True)


def parse_template(source: str) -> tuple:
    return _Parser(source).body()[0]


# Constant folding.


def _fold_value(x: object) -> object:
    if isinstance(x, Key):
        return Key(_fold_value(x.of), x.name)
    if not isinstance(x, Op):
        return x
    args = tuple(_fold_value(a) for a in x.args)
    if x.kind in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (x.kind == "and") else args[0]
    if all(isinstance(a, Const) for a in args) and not (x.kind == "join" and not all(isinstance(a.value, (Safe, int)) for a in args)):
        return Const(_value(Op(x.kind, args), Escaper(()))({}))
    return Op(x.kind, args)


def fold(body: tuple) -> tuple:
    """The same statements with everything computed that no value can change."""
    found: list = []

    def add(s: object) -> None:
        last = found[-1] if found else None
        if isinstance(s, Out) and isinstance(s.value, Const) and isinstance(last, Out) and isinstance(last.value, Const):
            found[-1] = Out(Const(Safe(_shown(last.value.value) + _shown(s.value.value))))
        else:
            found.append(s)

    for s in body:
        if isinstance(s, Out):
            s = Out(_fold_value(s.value))
        elif isinstance(s, Set):
            s = Set(s.name, _fold_value(s.value))
        elif isinstance(s, For):
            s = For(s.name, _fold_value(s.over), fold(s.body))
        elif isinstance(s, Generation):
            s = Generation(fold(s.body))
        elif isinstance(s, If):
            kept = []
            for test, inner in s.branches:
                test = _fold_value(test)
                if isinstance(test, Const) and not test.value:
                    continue
                kept.append((test, fold(inner)))
                if isinstance(test, Const):
                    break
            if not kept:
                continue
            if isinstance(kept[0][0], Const):
                for inner in kept[0][1]:
                    add(inner)
                continue
            s = If(tuple(kept))
        add(s)
    return tuple(found)


# Closures.


def _shown(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else "true" if value is True else "false" if value is False else str(value)


def _value(x: object, escaper: Escaper) -> Callable[[dict], object]:
    if isinstance(x, Const):
        return lambda env, v=x.value: v
    if isinstance(x, Name):
        return lambda env, n=x.name: env.get(n)
    if isinstance(x, Key):
        of, name = _value(x.of, escaper), x.name

        def key(env: dict) -> object:
            found = of(env)
            return found.get(name) if isinstance(found, dict) else None

        return key
    args = [_value(a, escaper) for a in x.args]
    one, two = args[0], args[-1]
    if x.kind == "join":

        def join(env: dict) -> object:
            parts = [one(env), two(env)]
            return Safe("".join(p if isinstance(p, Safe) else escaper.escape(_shown(p)) for p in parts))

        return join
    if x.kind == "in":
        return lambda env: _shown(one(env)) in _shown(two(env))
    if x.kind in _FILTERS:

        def filtered(env: dict, f: Callable = _FILTERS[x.kind]) -> object:
            found = one(env)
            return Safe(f(found)) if isinstance(found, Safe) else f(_shown(found))

        return filtered
    return {
        "==": lambda env: one(env) == two(env),
        "!=": lambda env: one(env) != two(env),
        "and": lambda env: one(env) and two(env),
        "or": lambda env: one(env) or two(env),
        "not": lambda env: not one(env),
    }[x.kind]


Run = Callable[[dict, bool], Iterator[Segment]]


def _statement(s: object, escaper: Escaper) -> Run:
    if isinstance(s, Out):
        if isinstance(s.value, Const):
            text = _shown(s.value.value)

            def constant(env: dict, marked: bool) -> Iterator[Segment]:
                yield text, marked

            return constant
        value = _value(s.value, escaper)

        def out(env: dict, marked: bool) -> Iterator[Segment]:
            found = value(env)
            yield (found if isinstance(found, Safe) else escaper.escape(_shown(found))), marked

        return out
    if isinstance(s, Set):
        value = _value(s.value, escaper)

        def put(env: dict, marked: bool) -> Iterator[Segment]:
            env[s.name] = value(env)
            yield from ()

        return put
    if isinstance(s, Generation):
        inner = _body(s.body, escaper)
        return lambda env, marked: inner(env, True)
    if isinstance(s, If):
        branches = [(_value(t, escaper), _body(b, escaper)) for t, b in s.branches]

        def choose(env: dict, marked: bool) -> Iterator[Segment]:
            for test, inner in branches:
                if test(env):
                    yield from inner(env, marked)
                    return

        return choose
    over, inner = _value(s.over, escaper), _body(s.body, escaper)

    def loop(env: dict, marked: bool) -> Iterator[Segment]:
        for i, item in enumerate(over(env) or ()):
            env |= {s.name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0}}
            yield from inner(env, marked)

    return loop


def _body(body: tuple, escaper: Escaper) -> Run:
    runs = [_statement(s, escaper) for s in body]
    if len(runs) == 1:
        return runs[0]

    def run(env: dict, marked: bool) -> Iterator[Segment]:
        for r in runs:
            yield from r(env, marked)

    return run


def compile_template(source: str, controls: Iterable[str]) -> Callable[[Iterable[dict]], Iterator[Segment]]:
    """A function from messages (mappings) to segments (text, whether a model has to produce it)."""
    run = _body(fold(parse_template(source)), Escaper(controls))
    return lambda messages: run({"messages": messages}, False)
