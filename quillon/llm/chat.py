"""Chat formatting: a compiler from a small sandboxed template language to closures.

A template is text with ``{{ expression }}`` and the statements ``{% for x in
xs %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set x = e %}`` and ``{%
generation %}``; each block has its ``end...``. Expressions have strings,
numbers, true, false and none, names, ``x.key`` and ``x[0]`` on plain data,
``~`` and ``+`` (joining), ``== != < >``, ``in``, ``and or not`` and filters
``x | name``. There are no calls, and attributes of Python objects cannot be
reached. The source is parsed into a tree, constant parts are folded, and the
tree becomes nested closures that append to an output. What stands within
``generation`` is recorded as spans of the output: the loss mask.

Texts may hold control strings. The filters ``escape`` and ``escape_line`` put
a backslash between ``<`` and ``|`` and double backslashes (and write line ends
as backslash n), which :func:`unescape` takes back.

Conversations: turns in order of turn (nulls first), then role and text; null
texts and roles are empty. Rows without conversation id form one conversation.
Repeated rows are turns of their own. Empty table: no rows. Extra columns are
ignored. A conversation's turns are read one after the other from a sorted
partition, so only its output is held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded

#: Turns between control strings; what the assistant says is learned.
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '<|im_start|>' ~ (m.role | escape_line) ~ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}"
    "{% endfor %}"
)
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


class TemplateError(ValueError):
    """The template cannot be parsed, or reaches for what it may not."""


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_str(x)), "escape_line": lambda x: escape_line(_str(x)), "trim": lambda x: _str(x).strip(),
    "upper": lambda x: _str(x).upper(), "lower": lambda x: _str(x).lower(), "length": len,
}


def _str(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


# --- parsing -----------------------------------------------------------------
_INSIDE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?"""
PIECE = re.compile(rf"\{{\{{(?P<l>-?)(?P<out>{_INSIDE})(?P<r>-?)\}}\}}|\{{%(?P<ll>-?)(?P<tag>{_INSIDE})(?P<rr>-?)%\}}|\{{#(?P<lll>-?).*?(?P<rrr>-?)#\}}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[~+|.\[\]()<>=]))")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 12]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m[1][1:-1], flags=re.S)))
        elif m[2] is not None:
            out.append(("const", int(m[2])))
        else:
            out.append(("name", m[3]) if m[3] else ("op", m[4]))
    return out


class _Expression:
    """Parses tokens by precedence into trees of tuples."""

    CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}

    def __init__(self, tokens: list):
        self.tokens, self.at = tokens, 0

    def peek(self, *values) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "const" and self.tokens[self.at][1] in values

    def take(self, *values) -> Any:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def whole(self) -> tuple:
        out = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _left(self, below: Callable, ops: tuple) -> tuple:
        out = below()
        while op := self.take(*ops):
            out = (op, out, below())
        return out

    def either(self) -> tuple:
        return self._left(lambda: self._left(self.negated, ("and",)), ("or",))

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self._left(lambda: self._left(self.filtered, ("~", "+")), ("==", "!=", "<", ">", "<=", ">=", "in"))

    def filtered(self) -> tuple:
        out = self.reached()
        while self.take("|"):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else None
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            out = ("filter", name, out)
        return out

    def reached(self) -> tuple:
        if self.take("("):
            out = self.either()
            self.need(")")
        elif self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        else:
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "const":
                out = ("const", value)
            elif kind == "name":
                out = ("const", self.CONSTANTS[value]) if value in self.CONSTANTS else ("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name" or value.startswith("_"):
                    raise TemplateError(f"no key {value!r}")
                self.at += 1
                out = ("get", out, ("const", value))
            else:
                out = ("get", out, self.either())
                self.need("]")
        return out


def _no_piece(text: str) -> None:
    if m := re.search(r"\{[{%]", text):
        raise TemplateError(f"a piece has no end: {text[m.start():m.start() + 12]!r}")


def parse(source: str) -> list[tuple]:
    """The syntax tree: a list of ("text", s), ("out", e), ("for", name, e,
    body), ("if", [(test, body), ...]), ("set", name, e), ("generation", body).
    A minus inside a piece's braces trims white space on that side; strings may hold
    braces."""
    root: list = []
    open_blocks: list[tuple[str, list]] = [("", root)]
    at = 0
    bare = False  # whether the piece before trims what follows it
    for m in PIECE.finditer(source):
        text = source[at:m.start()]
        _no_piece(text)
        text = text.lstrip() if bare else text
        text = text.rstrip() if m["l"] or m["ll"] or m["lll"] else text
        if text:
            open_blocks[-1][1].append(("text", text))
        at, bare = m.end(), bool(m["r"] or m["rr"] or m["rrr"])
        if m["out"] is not None:
            open_blocks[-1][1].append(("out", _Expression(_lex(m["out"])).whole()))
        elif m["tag"] is not None:
            tokens = _lex(m["tag"])
            word = tokens[0][1] if tokens else ""
            rest = tokens[1:]
            if word == "for":
                if len(rest) < 3 or rest[0][0] != "name" or rest[1] != ("name", "in"):
                    raise TemplateError("for x in xs expected")
                node = ("for", rest[0][1], _Expression(rest[2:]).whole(), [])
                open_blocks[-1][1].append(node)
                open_blocks.append(("for", node[3]))
            elif word == "if":
                node = ("if", [(_Expression(rest).whole(), [])])
                open_blocks[-1][1].append(node)
                open_blocks.append(("if", node[1][0][1]))
            elif word in ("elif", "else") and open_blocks[-1][0] == "if":
                open_blocks.pop()
                node = open_blocks[-1][1][-1]
                node[1].append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
                open_blocks.append(("if", node[1][-1][1]))
            elif word == "set" and len(rest) > 2 and rest[1] == ("op", "="):
                open_blocks[-1][1].append(("set", rest[0][1], _Expression(rest[2:]).whole()))
            elif word == "generation":
                node = ("generation", [])
                open_blocks[-1][1].append(node)
                open_blocks.append(("generation", node[1]))
            elif isinstance(word, str) and word.startswith("end") and open_blocks[-1][0] == word[3:] != "":
                open_blocks.pop()
            else:
                raise TemplateError(f"unexpected {m[0]!r}")
    if len(open_blocks) > 1:
        raise TemplateError(f"{open_blocks[-1][0]} has no end")
    _no_piece(source[at:])
    if last := source[at:].lstrip() if bare else source[at:]:
        root.append(("text", last))
    return root


# --- folding -----------------------------------------------------------------
JOINING = ("~", "+")


def _fold_expression(e: tuple) -> tuple:
    if e[0] in ("const", "name"):
        return e
    parts = tuple(_fold_expression(p) if isinstance(p, tuple) else p for p in e[1:])
    e = (e[0], *parts)
    if all(not isinstance(p, tuple) or p[0] == "const" for p in parts):
        try:
            return ("const", _closure(e)({}))
        except TypeError as fault:
            raise TemplateError(f"constants of {e[0]!r} do not fit: {fault}") from fault
    if e[0] == "~" and e[2][0] == "const" and e[1][0] == "~" and e[1][2][0] == "const":
        return ("~", e[1][1], ("const", _str(e[1][2][1]) + _str(e[2][1])))
    return e


def fold(body: list[tuple]) -> list[tuple]:
    """Constant expressions become text, joined parts separate output, tests
    that are known choose their branch, and neighbouring texts become one."""
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    def emit(e: tuple) -> None:
        if e[0] == "const":
            add(("text", _str(e[1])))
        elif e[0] == "~":
            emit(e[1])
            emit(e[2])
        else:
            add(("out", e))

    for node in body:
        if node[0] == "out":
            emit(_fold_expression(node[1]))
        elif node[0] == "for":
            add(("for", node[1], _fold_expression(node[2]), fold(node[3])))
        elif node[0] == "set":
            add(("set", node[1], _fold_expression(node[2])))
        elif node[0] == "generation":
            add(("generation", fold(node[1])))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = _fold_expression(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold(inner)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


# --- closures ----------------------------------------------------------------
def _reach(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return x[key] if -len(x) <= key < len(x) else None
    return None


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "~": lambda a, b: _str(a) + _str(b), "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _str(a) + _str(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: b is not None and a in b, "get": _reach,
}


def _closure(e: tuple) -> Callable[[dict], Any]:
    op = e[0]
    if op == "const":
        value = e[1]
        return lambda names: value
    if op == "name":
        name = e[1]
        return lambda names: names.get(name)
    if op == "not":
        inner = _closure(e[1])
        return lambda names: not inner(names)
    if op == "filter":
        apply, inner = FILTERS[e[1]], _closure(e[2])
        return lambda names: apply(inner(names))
    a, b = _closure(e[1]), _closure(e[2])
    if op == "and":
        return lambda names: a(names) and b(names)
    if op == "or":
        return lambda names: a(names) or b(names)
    act = BINARY[op]
    return lambda names: act(a(names), b(names))


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _compiled(body: list[tuple]) -> Callable[[dict, Output], None]:
    steps = [_step(node) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict, out: Output) -> None:
        for step in steps:
            step(names, out)

    return run


def _step(node: tuple) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda names, out: out.write(text)
    if kind == "out":
        value = _closure(node[1])
        return lambda names, out: out.write(_str(value(names)))
    if kind == "set":
        name, value = node[1], _closure(node[2])
        return lambda names, out: names.__setitem__(name, value(names))
    if kind == "generation":
        inner = _compiled(node[1])

        def generation(names: dict, out: Output) -> None:
            start = out.length
            inner(names, out)
            if out.length > start:
                out.spans.append((start, out.length))

        return generation
    if kind == "for":
        name, items, inner = node[1], _closure(node[2]), _compiled(node[3])

        def loop(names: dict, out: Output) -> None:
            scope, before = dict(names), None
            for i, x in enumerate(items(names) or ()):
                scope[name] = x
                scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "previous": before}
                inner(scope, out)
                before = x

        return loop
    branches = [(_closure(t), _compiled(b)) for t, b in node[1]]

    def choose(names: dict, out: Output) -> None:
        for test, inner in branches:
            if test(names):
                inner(names, out)
                return

    return choose


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that gives the output and the spans
    of generated text, in code points."""
    run = _compiled(fold(parse(source)))

    def render(**names) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render


# --- tables ------------------------------------------------------------------
def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (start, end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        key, turns, out = None, [], []

        def done() -> None:
            text, spans = render(messages=turns)
            out.append((key, text, [{"start": a, "end": b} for a, b in spans]))

        def frame() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["conv_id", "formatted", "spans"]).astype({"conv_id": "Int64"})

        for batch in batches:
            for c, role, text in zip(batch["conv_id"].astype("Int64"), batch["role"], batch["text"], strict=True):
                c = None if c is pd.NA else c
                if turns and c != key:
                    done()
                    turns = []
                key = c
                turns.append({"role": role or "", "text": text or ""})
            if len(out) >= 1000:
                yield frame()
                out.clear()
        if turns:
            done()
        yield frame()

    rows = bounded(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    return rows.select("conv_id", "role", "text").mapInPandas(run, "conv_id long, formatted string, spans array<struct<start:long,end:long>>")


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of an output of TEMPLATE."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(text)]
