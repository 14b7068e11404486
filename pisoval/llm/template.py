"""Compiler of a sandboxed template language: text -> syntax tree -> folded tree -> Python closures.

{{ expression }} writes, {# #} comments, {% if/elif/else/endif %}, {% for x in y %}...{% endfor %} (with loop.index, index0, first, last),
{% set x = expression %} and {% generation %}...{% endgeneration %}, which marks what a model is trained on. A `-` inside a
delimiter strips the white space beside it. Expressions: strings, numbers, true, false, none, names, a.b and a['b'] (of mappings
only), + ~ == != < > <= >= in, not, and, or, `x if c else y`, `| filter`, `is defined`. Nothing reaches Python attributes or
calls; filters and names are what the caller gives. Rendering is lazy: a loop takes its items one by one.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from operator import eq, ge, gt, le, lt, ne

_DELIMITERS = re.compile(r"\{\{-?|\{%-?|\{#")
_LEXEME = re.compile(r"""\s*(?:(?P<s>"(?:\\.|[^"\\])*+"|'(?:\\.|[^'\\])*+')|(?P<n>\d+(?:\.\d+)?)|(?P<w>[A-Za-z_]\w*)|(?P<o>==|!=|<=|>=|[-+~<>()\[\].|,=]))""")
_ESCAPES = {"n": "\n", "t": "\t"}
_COMPARE: dict[str, Callable] = {"==": eq, "!=": ne, "<": lt, ">": gt, "<=": le, ">=": ge, "in": lambda a, b: a in b}
_WORDS = {"true": True, "false": False, "none": None}
Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


class Missing:
    """What an unknown name or key gives; it writes nothing and is false."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


MISSING = Missing()


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over one expression's lexemes; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.lexemes, self.at = _lex(source), 0

    def whole(self):
        node = self.choice()
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r}")
        return node

    def take(self, *values: str) -> str | None:
        if self.at < len(self.lexemes) and self.lexemes[self.at][0] != "s" and self.lexemes[self.at][1] in values:
            self.at += 1
            return self.lexemes[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at == len(self.lexemes) or self.lexemes[self.at][0] != "w":
            raise TemplateError("a name is expected")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def choice(self):
        node = self.either()
        if self.take("if"):
            test = self.either()
            return ("choose", test, node, self.choice() if self.take("else") else ("value", MISSING))
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        node = self.sum()
        while True:
            if op := self.take(*_COMPARE):
                node = ("compare", op, node, self.sum())
            elif self.take("is"):
                no = self.take("not")
                if self.name() != "defined":
                    raise TemplateError("only `is defined` is known")
                node = ("not", ("defined", node)) if no else ("defined", node)
            else:
                return node

    def sum(self):
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("join" if op == "~" else "add", node, self.filtered())
        return node

    def filtered(self):
        node = self.primary()
        while True:
            if self.take("."):
                node = ("item", node, ("value", self.name()))
            elif self.take("["):
                node = ("item", node, self.choice())
                self.need("]")
            elif self.take("|"):
                node = ("filter", self.name(), node)
            else:
                return node

    def primary(self):
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at == len(self.lexemes):
            raise TemplateError("an expression is expected")
        kind, value = self.lexemes[self.at]
        self.at += 1
        if kind == "s":
            return ("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "n":
            return ("value", float(value) if "." in value else int(value))
        if kind == "w":
            return ("value", _WORDS[value]) if value in _WORDS else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The template's syntax tree: a list of statements."""
    at, flat, strip = 0, [], False
    while at < len(source):
        m = _DELIMITERS.search(source, at)
        text = source[at:m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m and m[0].endswith("-"):
            text = text.rstrip()
        if text:
            flat.append(("text", text))
        if not m:
            break
        close = {"{{": "}}", "{%": "%}", "{#": "#}"}[m[0][:2]]
        end = source.find(close, m.end())
        if end < 0:
            raise TemplateError(f"{close} expected")
        inner = source[m.end():end]
        strip = close != "#}" and inner.endswith("-")
        at = end + 2
        if close == "}}":
            flat.append(("write", _Expression(inner.rstrip("-")).whole()))
        elif close == "%}":
            flat.append(("tag", inner.rstrip("-").strip()))
    body, rest = _block(flat, 0, ())
    if rest < len(flat):
        raise TemplateError(f"unexpected {flat[rest][1]!r}")
    return body


def _block(flat: list, at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    out = []
    while at < len(flat):
        kind, value = flat[at]
        if kind != "tag":
            out.append((kind, value))
            at += 1
            continue
        word, _, rest = value.partition(" ")
        if word in ends:
            return out, at
        if word == "if":
            cases, other, test = [], [], rest
            while True:
                body, at = _block(flat, at + 1, ("elif", "else", "endif"))
                word, _, rest = _tag(flat, at, "endif")
                cases.append((_Expression(test).whole(), body))
                if word == "else":
                    other, at = _block(flat, at + 1, ("endif",))
                    _tag(flat, at, "endif")
                if word != "elif":
                    break
                test = rest
            out.append(("if", cases, other))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"can't read {value!r}")
            body, at = _block(flat, at + 1, ("endfor",))
            _tag(flat, at, "endfor")
            out.append(("for", m[1], _Expression(m[2]).whole(), body))
        elif word == "set":
            name, _, expression = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"can't read {value!r}")
            out.append(("set", name.strip(), _Expression(expression).whole()))
        elif word == "generation":
            body, at = _block(flat, at + 1, ("endgeneration",))
            _tag(flat, at, "endgeneration")
            out.append(("generation", body))
        else:
            raise TemplateError(f"unknown tag {word!r}")
        at += 1
    return out, at


def _tag(flat: list, at: int, wanted: str) -> tuple[str, str, str]:
    if at >= len(flat):
        raise TemplateError(f"{wanted} expected")
    return flat[at][1].partition(" ")


def fold(node, filters: Mapping[str, Callable]):
    """The tree with constant expressions computed, branches that can't be taken left out and neighbouring texts joined."""
    if isinstance(node, list):
        out = []
        for one in node:
            one = fold(one, filters)
            for part in one if isinstance(one, list) else [one]:
                if part[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + part[1])
                elif part != ("text", ""):
                    out.append(part)
        return out
    kind = node[0]
    if kind == "write":
        inner = fold(node[1], filters)
        return ("text", _text(inner[1])) if inner[0] == "value" else ("write", inner)
    if kind == "if":
        cases, other = [], node[2]
        for test, body in node[1]:
            test = fold(test, filters)
            if test[0] == "value":
                if not test[1]:
                    continue
                other = body
                break
            cases.append((test, fold(body, filters)))
        return ("if", cases, fold(other, filters)) if cases else fold(other, filters)
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind in ("text", "value", "name"):
        return node
    parts = tuple(fold(p, filters) if isinstance(p, tuple) else p for p in node)
    inner = [p for p in parts[1:] if isinstance(p, tuple)]
    if kind != "defined" and inner and all(p[0] == "value" for p in inner):
        return ("value", _closure(parts, filters)({}))
    return parts


def _text(value) -> str:
    return "" if value is None else str(value)


def _closure(node, filters: Mapping[str, Callable]) -> Callable:
    """A function of the variables that computes the expression."""
    kind = node[0]
    if kind == "value":
        return lambda names, v=node[1]: v
    if kind == "name":
        return lambda names, n=node[1]: names.get(n, MISSING)
    if kind == "filter":
        if node[1] not in filters:
            raise TemplateError(f"unknown filter {node[1]!r}")
        f, inner = filters[node[1]], _closure(node[2], filters)
        return lambda names: f(inner(names))
    a, *more = [_closure(p, filters) for p in node[1:] if isinstance(p, tuple)]
    b, c = (more + [None, None])[:2]
    if kind == "item":
        def item(names):
            owner, key = a(names), b(names)
            return owner.get(key, MISSING) if isinstance(owner, Mapping) else MISSING
        return item
    if kind == "compare":
        op = _COMPARE[node[1]]
        return lambda names: op(a(names), b(names))
    return {"choose": lambda names: b(names) if a(names) else c(names), "or": lambda names: a(names) or b(names), "and": lambda names: a(names) and b(names),
            "not": lambda names: not a(names), "defined": lambda names: a(names) is not MISSING, "add": lambda names: a(names) + b(names),
            "join": lambda names: _text(a(names)) + _text(b(names))}[kind]


def _loop(items: Iterable) -> Iterator[tuple[object, dict]]:
    """Items with what `loop` tells about them; reads one item ahead."""
    items = iter(items)
    for i, (item, more) in enumerate(_ahead(items)):
        yield item, {"index": i + 1, "index0": i, "first": i == 0, "last": not more}


def _ahead(items: Iterator) -> Iterator[tuple[object, bool]]:
    none = object()
    now = next(items, none)
    while now is not none:
        following = next(items, none)
        yield now, following is not none
        now = following


def _render(body: list, filters: Mapping[str, Callable], trained: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A function of the variables that yields (text, whether it is under the generation mark)."""
    steps = [_step(s, filters, trained) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(names):
        for step in steps:
            yield from step(names)
    return run


def _step(node, filters, trained) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = ((node[1], trained),)
        return lambda names: piece
    if kind == "write":
        value = _closure(node[1], filters)
        return lambda names: ((_text(value(names)), trained),)
    if kind == "generation":
        return _render(node[1], filters, True)
    if kind == "set":
        value = _closure(node[2], filters)

        def assign(names):
            names[node[1]] = value(names)
            return ()
        return assign
    if kind == "if":
        cases = [(_closure(t, filters), _render(b, filters, trained)) for t, b in node[1]]
        other = _render(node[2], filters, trained)

        def branch(names):
            for test, body in cases:
                if test(names):
                    return body(names)
            return other(names)
        return branch
    items, body, name = _closure(node[2], filters), _render(node[3], filters, trained), node[1]

    def loop(names):
        got = items(names)
        if isinstance(got, (str, Mapping, Missing)) or not isinstance(got, Iterable):
            return
        inner = dict(names)
        for item, place in _loop(got):
            inner[name], inner["loop"] = item, place
            yield from body(inner)
    return loop


FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
                                "length": lambda x: len(x) if isinstance(x, (str, list, tuple, Mapping)) else 0}


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Mapping], Iterator[Piece]]:
    """Rendering function of a template: variables -> pieces of text with their generation mark."""
    known = {**FILTERS, **(filters or {})}
    run = _render(fold(parse(source), known), known)
    return lambda names: iter(run(dict(names)))
