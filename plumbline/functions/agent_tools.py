"""The tools that a page offers to agents: registered by a script, or declared by a form.

scan() reads a page's scripts as tokens (strings, templates, comments, brackets), so that bodies with brackets, quotes and
comments of any depth keep the fields that follow them. TOOL_FUNCTION is the table function for lateral joins; detected()
the same as an array in the row, which the page model uses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# Fixed values of the agents' interface.
ANNOTATIONS = ("readOnlyHint", "untrustedContentHint", "consequentialHint")
DATA_SCRIPTS = ("application/ld+json", "application/json", "text/template", "importmap", "speculationrules")
CONTROLS = ("input", "select", "textarea", "button")
NAME = re.compile(r"[A-Za-z0-9_.-]{1,128}")
NOTHING = ("null", "undefined")

TOOL = StructType(
    [
        StructField("name", StringType()),
        StructField("registration", StringType()),
        StructField("description", StringType()),
        StructField("description_missing", BooleanType()),
        StructField("input_schema", BooleanType()),
        StructField("semantic_annotation", BooleanType()),
        StructField("structured_response", BooleanType()),
    ]
)

_TOKEN = re.compile(
    r"""(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>(?P<quote>["'`])(?:\\.|(?!(?P=quote)).)*(?:(?P=quote)|\\?\Z))
    |(?P<word>[\w$]+)|(?P<open>[{\[(])|(?P<close>[}\])])|(?P<other>.)""",
    re.S | re.X,
)
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def _tokens(script: str) -> list[tuple[str, str]]:
    """(kind, text) without gaps."""
    return [(m.lastgroup if m.lastgroup != "quote" else "string", m[0]) for m in _TOKEN.finditer(script) if m.lastgroup != "gap"]


def _closing(tokens: list[tuple[str, str]]) -> dict[int, int]:
    """The place of the bracket that closes each one that is closed. A bracket of another kind between them does not count."""
    pairs, stacks = {}, {"}": [], "]": [], ")": []}
    closer = {"{": "}", "[": "]", "(": ")"}
    for at, (kind, text) in enumerate(tokens):
        if kind == "open":
            stacks[closer[text]].append(at)
        elif kind == "close" and stacks[text]:
            pairs[stacks[text].pop()] = at
    return pairs


def _fields(tokens: list[tuple[str, str]], pairs: dict[int, int], start: int) -> dict[str, tuple[int, int]]:
    """Key and value (from, to) of an object's own fields, up to what is not `key: value`."""
    found, at, end = {}, start + 1, pairs[start]
    while at < end:
        kind, text = tokens[at]
        if text == ",":
            at += 1
            continue
        key = text if kind == "word" else static(tokens, at, at + 1) if kind == "string" and text[0] != "`" else None
        if key is None or at + 1 >= end or tokens[at + 1][1] != ":":
            break
        first = at = at + 2
        while at < end and tokens[at][1] != ",":
            at = pairs.get(at, at) + 1
        if at == first:
            break
        found[key] = (first, min(at, end))
    return found


def static(tokens: list[tuple[str, str]], first: int, end: int) -> str | None:
    """The text of a value that is one string without placeholders."""
    kind, text = tokens[first]
    if end != first + 1 or kind != "string" or len(text) < 2 or text[-1] != text[0] or (text[0] == "`" and "${" in text):
        return None
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


def _said(text: str | None) -> tuple[str | None, bool]:
    text = (text or "").strip()
    return text or None, not text


def registered(script: str) -> Iterator[tuple]:
    """The tools of a script: registerTool({...}), as a function or a method."""
    tokens = _tokens(script)
    pairs, at = _closing(tokens), 0
    while at + 2 < len(tokens):
        own = tokens[at] == ("word", "registerTool") and tokens[at + 1][1] == "(" and tokens[at + 2][1] == "{" and at + 2 in pairs
        if not own:
            at += 1
            continue
        fields = _fields(tokens, pairs, at + 2)
        at = pairs[at + 2] + 1

        def given(key: str, of: dict[str, tuple[int, int]]) -> bool:
            return key in of and not (of[key][1] == of[key][0] + 1 and tokens[of[key][0]][1] in NOTHING)

        name = static(tokens, *fields["name"]) if "name" in fields else None
        if name is None or not NAME.fullmatch(name):
            continue
        text = static(tokens, *fields["description"]) if "description" in fields else None
        described = _said(text) if text is not None or not given("description", fields) else (None, False)
        marks = fields.get("annotations", (0, 0))
        hints = _fields(tokens, pairs, marks[0]) if marks[1] and tokens[marks[0]][1] == "{" and marks[0] in pairs else {}
        yield name, "imperative", *described, given("inputSchema", fields), any(given(h, hints) for h in ANNOTATIONS), given("execute", fields) or given("outputSchema", fields)


class _Page(HTMLParser):
    """Scripts, and forms with the names of their controls, outside of templates."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.scripts: list[str] = []
        self.forms: list[dict] = []
        self.controls: list[tuple[int | None, str | None]] = []  # (the form around it, the form that it names)
        self.templates, self.form, self.script = 0, None, None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag == "template":
            self.templates += 1
        elif tag == "script" and not self.templates and own.get("type", "").strip().lower() not in DATA_SCRIPTS:
            self.script = []
        elif tag == "form" and not self.templates:
            self.form = len(self.forms)
            self.forms.append(own)
        elif tag in CONTROLS and not self.templates and own.get("name", "").strip():
            self.controls.append((self.form, own.get("form", "").strip() or None))

    def handle_endtag(self, tag: str) -> None:
        if tag == "template":
            self.templates = max(0, self.templates - 1)
        elif tag == "form":
            self.form = None
        elif tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)

    def declared(self) -> Iterator[tuple]:
        """The tools that forms declare."""
        for k, form in enumerate(self.forms):
            name, own = form.get("toolname", "").strip(), form.get("id", "").strip() or None
            if name and len(name) <= 128:
                named = any((around == k and other in (None, own)) or (own and other == own) for around, other in self.controls)
                yield name, "declarative", *_said(form.get("tooldescription")), named, False, False


def scan(html: str | None) -> list[tuple]:
    """The tools of a page, the first of each registration and name: those of scripts, then those of forms."""
    if not html or ("registerTool" not in html and "toolname" not in html.lower()):
        return []
    page = _Page()
    page.feed(html)
    page.close()
    if page.script:
        page.scripts.append("".join(page.script))
    first: dict[tuple, tuple] = {}
    for tool in (*(t for s in page.scripts for t in registered(s)), *page.declared()):
        first.setdefault(tool[1::-1], tool)
    return list(first.values())


class ToolFunction:
    def eval(self, html: str) -> Iterator[tuple]:
        yield from scan(html)


#: Table function (Arrow in both directions): a row for each tool of a page.
TOOL_FUNCTION = F.udtf(ToolFunction, returnType=TOOL, useArrow=True)


def offered(pages: DataFrame) -> DataFrame:
    """A row for each tool of pages (html and others): the other columns and the tool's; by lateral join."""
    rest = [c for c in pages.columns if c != "html"]
    some = pages.filter(F.col("html").contains("registerTool") | F.lower("html").contains("toolname"))
    return some.lateralJoin(TOOL_FUNCTION(F.col("html").outer())).select(*[F.col(f"`{c}`") for c in rest], *TOOL.fieldNames())


def detected(html: Column) -> Column:
    """The tools of a page as an array; only pages that may have some are sent to Python."""
    some = html.contains("registerTool") | F.lower(html).contains("toolname")
    return F.udf(scan, ArrayType(TOOL), useArrow=True)(F.when(some, html))
