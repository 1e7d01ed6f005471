"""Compiler for a sandboxed template language: source to syntax tree, constant folding, Python closures.

The language has ``{{ expression }}``, ``{% for x in list %}``, ``{% if %}`` /
``{% elif %}`` / ``{% else %}``, ``{% set x = expression %}``, ``{% generation %}``
and comments ``{# #}``; ``-`` inside a tag trims white space. Expressions have
literals, names, fields of mappings, items, comparison, ``in``, ``and``, ``or``,
``not``, ``+``, ``~`` and the filters of FILTERS. Nothing else can be reached:
there are no calls, no attributes of Python objects, and no imports.

A compiled template is a generator over (text, generated) chunks. Lists are
taken one item at a time, so a conversation of any length streams through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": str}

_TAG = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<do>.*?)-?%\}|\{#.*?#\}", re.S)
_WORD = re.compile(r"\s*(?:(?P<number>\d+)|(?P<string>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|.,()\[\]<>=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    pass


# Syntax tree. Every node has ``fold`` (the same node or a simpler one) and ``build`` (a closure).


@dataclass
class Const:
    value: Any

    def fold(self):
        return self

    def build(self, _filters):
        value = self.value
        return lambda scope: value


@dataclass
class Name:
    name: str

    def fold(self):
        return self

    def build(self, _filters):
        name = self.name
        return lambda scope: scope.get(name)


@dataclass
class Item:
    of: Any
    key: Any

    def fold(self):
        return Item(self.of.fold(), self.key.fold())

    def build(self, filters):
        of, key = self.of.build(filters), self.key.build(filters)

        def get(scope):
            held, k = of(scope), key(scope)
            if isinstance(held, dict):
                return held.get(k)
            if isinstance(held, (list, tuple, str)) and isinstance(k, int) and -len(held) <= k < len(held):
                return held[k]
            return None

        return get


@dataclass
class Filter:
    of: Any
    name: str

    def fold(self):
        of = self.of.fold()
        return Const(FILTERS[self.name](of.value)) if isinstance(of, Const) and self.name in FILTERS else Filter(of, self.name)

    def build(self, filters):
        if self.name not in filters:
            raise TemplateError(f"unknown filter {self.name}")
        of, run = self.of.build(filters), filters[self.name]
        return lambda scope: run(of(scope))


def _text(x: Any) -> str:
    return "" if x is None else str(x)


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
}


@dataclass
class Binary:
    op: str
    left: Any
    right: Any

    def fold(self):
        left, right = self.left.fold(), self.right.fold()
        if isinstance(left, Const) and isinstance(right, Const):
            return Const(_BINARY[self.op](left.value, right.value))
        return Binary(self.op, left, right)

    def build(self, filters):
        run, left, right = _BINARY[self.op], self.left.build(filters), self.right.build(filters)
        return lambda scope: run(left(scope), right(scope))


@dataclass
class Logic:
    """``and``, ``or`` (short-circuit) and ``not`` (one operand)."""

    op: str
    parts: list

    def fold(self):
        parts = [x.fold() for x in self.parts]
        if self.op == "not":
            return Const(not parts[0].value) if isinstance(parts[0], Const) else Logic("not", parts)
        stop = self.op == "or"
        while len(parts) > 1 and isinstance(parts[0], Const):
            if bool(parts[0].value) == stop:
                return parts[0]
            parts = parts[1:]
        return parts[0] if len(parts) == 1 else Logic(self.op, parts)

    def build(self, filters):
        parts = [x.build(filters) for x in self.parts]
        if self.op == "not":
            return lambda scope: not parts[0](scope)
        stop = self.op == "or"

        def run(scope):
            value = None
            for part in parts:
                value = part(scope)
                if bool(value) == stop:
                    break
            return value

        return run


@dataclass
class Out:
    of: Any

    def fold(self):
        of = self.of.fold()
        return Out(Const(_text(of.value))) if isinstance(of, Const) else Out(of)

    def build(self, filters):
        of = self.of.build(filters)

        def run(scope, generated):
            text = _text(of(scope))
            if text or generated:
                yield text, generated

        return run


@dataclass
class Set:
    name: str
    of: Any

    def fold(self):
        return Set(self.name, self.of.fold())

    def build(self, filters):
        name, of = self.name, self.of.build(filters)

        def run(scope, generated):
            scope[name] = of(scope)
            return iter(())

        return run


@dataclass
class Generation:
    body: Block

    def fold(self):
        return Generation(self.body.fold())

    def build(self, filters):
        body = self.body.build(filters)

        def run(scope, generated):
            yield "".join(text for text, _ in body(scope, True)), True

        return run


@dataclass
class If:
    cases: list  # (condition, block)

    def fold(self):
        cases = []
        for test, body in self.cases:
            test = test.fold()
            if isinstance(test, Const) and not test.value:
                continue
            cases.append((test, body.fold()))
            if isinstance(test, Const):
                break
        if not cases:
            return Block([])
        return cases[0][1] if isinstance(cases[0][0], Const) else If(cases)

    def build(self, filters):
        cases = [(test.build(filters), body.build(filters)) for test, body in self.cases]

        def run(scope, generated):
            for test, body in cases:
                if test(scope):
                    yield from body(scope, generated)
                    return

        return run


@dataclass
class For:
    name: str
    over: Any
    body: Block

    def fold(self):
        return For(self.name, self.over.fold(), self.body.fold())

    def build(self, filters):
        name, over, body = self.name, self.over.build(filters), self.body.build(filters)

        def run(scope, generated):
            loop = {"index0": -1}
            for item in over(scope) or ():
                k = loop["index0"] + 1
                loop = {"index0": k, "index": k + 1, "first": k == 0}
                yield from body({**scope, name: item, "loop": loop}, generated)

        return run


@dataclass
class Block:
    parts: list = field(default_factory=list)

    def fold(self):
        out: list = []
        for x in (p.fold() for p in self.parts):
            for y in x.parts if isinstance(x, Block) else [x]:
                both = isinstance(y, Out) and isinstance(y.of, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].of, Const)
                if both:
                    out[-1] = Out(Const(out[-1].of.value + y.of.value))
                else:
                    out.append(y)
        return Block(out)

    def build(self, filters):
        parts = [x.build(filters) for x in self.parts]

        def run(scope, generated):
            for part in parts:
                yield from part(scope, generated)

        return run


# Parsing


class _Words:
    """Words of one tag, with one word of look-ahead."""

    def __init__(self, source: str):
        self.words: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "string" else None

    def next(self, kind: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.words) or kind and self.words[self.at][0] != kind:
            raise TemplateError("the tag ends early" if self.at >= len(self.words) else f"unexpected {self.words[self.at][1]!r}")
        self.at += 1
        return self.words[self.at - 1]

    def take(self, *words: str) -> str | None:
        if self.peek() in words and self.peek() is not None:
            return self.next()[1]
        return None

    def need(self, word: str) -> None:
        if not self.take(word):
            raise TemplateError(f"{word!r} is missing")

    def done(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")


def _either(w: _Words):
    parts = [_both(w)]
    while w.take("or"):
        parts.append(_both(w))
    return parts[0] if len(parts) == 1 else Logic("or", parts)


def _both(w: _Words):
    parts = [_negated(w)]
    while w.take("and"):
        parts.append(_negated(w))
    return parts[0] if len(parts) == 1 else Logic("and", parts)


def _negated(w: _Words):
    return Logic("not", [_negated(w)]) if w.take("not") else _compared(w)


def _compared(w: _Words):
    left = _added(w)
    while op := w.take("==", "!=", "<", ">", "<=", ">=", "in"):
        left = Binary(op, left, _added(w))
    return left


def _added(w: _Words):
    left = _filtered(w)
    while op := w.take("+", "-", "~"):
        left = Binary(op, left, _filtered(w))
    return left


def _filtered(w: _Words):
    of = _value(w)
    while True:
        if w.take("."):
            of = Item(of, Const(w.next("name")[1]))
        elif w.take("["):
            of = Item(of, _either(w))
            w.need("]")
        elif w.take("|"):
            of = Filter(of, w.next("name")[1])
        else:
            return of


def _value(w: _Words):
    if w.take("("):
        inner = _either(w)
        w.need(")")
        return inner
    kind, word = w.next()
    if kind == "number":
        return Const(int(word))
    if kind == "string":
        return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
    if kind == "name":
        known = {"true": True, "false": False, "none": None}
        return Const(known[word]) if word in known else Name(word)
    raise TemplateError(f"unexpected {word!r}")


def _expression(source: str):
    w = _Words(source)
    out = _either(w)
    w.done()
    return out


def parse(source: str) -> Block:
    """Syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        pieces.append(("text", text.rstrip() if m[0][2] == "-" else text))
        if m["out"] is not None:
            pieces.append(("out", m["out"]))
        elif m["do"] is not None:
            pieces.append(("do", m["do"]))
        at, trim = m.end(), m[0][-3] == "-"
    pieces.append(("text", source[at:].lstrip() if trim else source[at:]))
    block, end = _block(iter(pieces), ())
    return block


def _block(pieces: Iterator[tuple[str, str]], ends: tuple[str, ...]) -> tuple[Block, str]:
    out = Block()
    for kind, body in pieces:
        if kind == "text":
            out.parts.append(Out(Const(body)))
        elif kind == "out":
            out.parts.append(Out(_expression(body)))
        else:
            word, _, rest = body.strip().partition(" ")
            if word in ends:
                return out, body.strip()
            out.parts.append(_statement(word, rest, pieces))
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return out, ""


def _statement(word: str, rest: str, pieces: Iterator[tuple[str, str]]):
    if word == "for":
        w = _Words(rest)
        name = w.next("name")[1]
        w.need("in")
        over = _either(w)
        w.done()
        return For(name, over, _block(pieces, ("endfor",))[0])
    if word == "generation":
        return Generation(_block(pieces, ("endgeneration",))[0])
    if word == "set":
        w = _Words(rest)
        name = w.next("name")[1]
        w.need("=")
        of = _either(w)
        w.done()
        return Set(name, of)
    if word == "if":
        cases, test = [], _expression(rest)
        while True:
            body, end = _block(pieces, ("elif", "else", "endif"))
            cases.append((test, body))
            if end == "endif":
                return If(cases)
            test = Const(True) if end == "else" else _expression(end.partition(" ")[2])
    raise TemplateError(f"unknown statement {word!r}")


def compile_template(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[[Iterable[dict]], Iterator[tuple[str, bool]]]:
    """A function from messages to (text, generated) chunks; each ``generation`` block gives one generated chunk."""
    run = parse(source).fold().build(FILTERS | (filters or {}))

    def render(messages: Iterable[dict], **names: Any) -> Iterator[tuple[str, bool]]:
        return run({**names, "messages": messages}, False)

    return render
