"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set name = expression %}`` and ``{% generation %} ... {% endgeneration %}``,
which marks what a model is trained to produce.  Expressions have literals,
names, ``a.b`` and ``a['b']`` (keys of mappings only, so no Python attribute can
be reached), filters from a fixed set, arithmetic, comparison and logic.

The sandbox also bounds what a template can ask for: a text that an operator
makes (``MAX_TEXT``), whole numbers (64 bits) nesting (``MAX_DEPTH``) and an
expression's length (``MAX_TOKENS``); beyond
that, and for anything that is not in the language, it is a ``TemplateError``.

``compile_template`` parses to a syntax tree, folds constants and generates
closures.  Rendering is a stream of ``(text, is_generated)`` fragments, so a
conversation of any length needs memory for one message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

ESCAPABLE = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
NEWLINE = "<|nl|>"


def escape(text: str) -> str:
    """Control strings in a text lose their force: ``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on."""
    return ESCAPABLE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """As ``escape``, and line ends become a control string."""
    return escape(text).replace("\n", NEWLINE)


def unescape_line(text: str) -> str:
    return unescape(text.replace(NEWLINE, "\n"))


FILTERS: dict[str, Callable] = {"trim": lambda s: s.strip(), "upper": lambda s: s.upper(), "lower": lambda s: s.lower(),
                                "length": len, "string": str, "escape": escape, "escape_line": escape_line}


class TemplateError(ValueError):
    """The template can't be parsed, or asks for something the sandbox doesn't give."""


# Syntax tree: expressions are tuples (kind, ...), statements are the classes below.
@dataclass
class Text:
    text: str


@dataclass
class Out:
    expr: tuple


@dataclass
class If:
    branches: list  # (condition or None, body)


@dataclass
class For:
    name: str
    over: tuple
    body: list


@dataclass
class Set:
    name: str
    expr: tuple


@dataclass
class Generation:
    body: list


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKENS = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>|.()\[\]*%]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
            "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
MAX_TEXT, MAX_DEPTH, MAX_TOKENS = 1 << 27, 60, 400
_NAME = re.compile(r"[A-Za-z_]\w*")
_RESERVED = {"true", "false", "none", "not", "and", "or", "if", "else", "in"}


def _within(x):
    """A result of an operator, if the sandbox allows its size."""
    if isinstance(x, int) and not -(1 << 63) <= x < 1 << 63 or isinstance(x, str) and len(x) > MAX_TEXT:
        raise TemplateError("a result is too large")
    return x


def _times(a, b):
    """The product of two numbers, or a text repeated."""
    n, text = (a, b) if isinstance(b, str) else (b, a)
    if isinstance(text, str) and isinstance(n, int) and len(text) * n > MAX_TEXT:
        raise TemplateError("a result is too large")
    if not all(isinstance(x, (int, str)) for x in (a, b)):
        raise TemplateError("only numbers and texts can be multiplied")
    return _within(a * b)


def _rest(a, b):
    """The remainder of two numbers (for texts, ``%`` would be a formatting language of its own)."""
    if isinstance(a, str):
        raise TemplateError("only numbers have a remainder")
    return a % b


_ARITHMETIC = {"+": lambda a, b: _within(a + b), "-": lambda a, b: _within(a - b), "*": _times, "%": _rest,
               "~": lambda a, b: _within(_show(a) + _show(b))}


def _assigned(name: str) -> str:
    """A name that a statement may bind."""
    if not _NAME.fullmatch(name) or name in _RESERVED:
        raise TemplateError(f"not a name: {name!r}")
    return name


def _show(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, object]] = []
        at = 0
        while source[at:].strip():
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:].strip()!r}")
            number, string, name, mark = m.groups()
            if number:
                self.tokens.append(("const", int(number)))
            elif string:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("mark", mark))
            at = m.end()
        if len(self.tokens) > MAX_TOKENS:
            raise TemplateError("an expression is too long")
        self.at = self.depth = 0

    def take(self, *wanted: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", None)
        if kind in ("name", "mark") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def whole(self) -> tuple:
        e = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("an expression is nested too deeply")

    def choice(self) -> tuple:
        self.deeper()
        e = self.any_of()
        if self.take("if"):
            condition = self.any_of()
            self.need("else")
            e = ("if", condition, e, self.choice())
        self.depth -= 1
        return e

    def any_of(self) -> tuple:
        e = self.all_of()
        while self.take("or"):
            e = ("or", e, self.all_of())
        return e

    def all_of(self) -> tuple:
        e = self.negated()
        while self.take("and"):
            e = ("and", e, self.negated())
        return e

    def negated(self) -> tuple:
        if not self.take("not"):
            return self.compared()
        self.deeper()
        e = ("not", self.negated())
        self.depth -= 1
        return e

    def compared(self) -> tuple:
        e = self.joined()
        if op := self.take(*_COMPARE):
            return ("op", op, e, self.joined())
        if self.take("not"):
            self.need("in")
            return ("not", ("op", "in", e, self.joined()))
        return e

    def joined(self) -> tuple:
        e = self.sum()
        while self.take("~"):
            e = ("op", "~", e, self.sum())
        return e

    def sum(self) -> tuple:
        e = self.product()
        while op := self.take("+", "-"):
            e = ("op", op, e, self.product())
        return e

    def product(self) -> tuple:
        e = self.filtered()
        while op := self.take("*", "%"):
            e = ("op", op, e, self.filtered())
        return e

    def filtered(self) -> tuple:
        e = self.value()
        while True:
            if self.take("."):
                e = ("key", e, ("const", self.name()))
            elif self.take("["):
                e = ("key", e, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                e = ("filter", name, e)
            else:
                return e

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", None)
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def value(self) -> tuple:
        if self.take("("):
            e = self.choice()
            self.need(")")
            return e
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", None)
        if kind not in ("const", "name"):
            raise TemplateError("a value is missing")
        self.at += 1
        fixed = {"true": True, "false": False, "none": None}
        return ("const", value) if kind == "const" else ("const", fixed[value]) if value in fixed else ("name", value)


def parse(source: str) -> list:
    """The statements of a template."""
    parts = _PARTS.split(source)
    at = depth = 0

    def body(*ends: str) -> tuple[list, str, str]:
        nonlocal depth
        depth += 1
        if depth > MAX_DEPTH:
            raise TemplateError("statements are nested too deeply")
        found = inside(*ends)
        depth -= 1
        return found

    def inside(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{") and part.endswith("}}") and len(part) >= 4:
                out.append(Out(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%") and part.endswith("%}"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, word, rest
                if word == "for":
                    name, _, over = rest.partition(" in ")
                    inner, _, _ = body("endfor")
                    out.append(For(_assigned(name.strip()), _Expression(over).whole(), inner))
                elif word == "if":
                    branches, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end, rest = body("elif", "else", "endif")
                        branches.append((condition, inner))
                        if end == "endif":
                            break
                        condition = _Expression(rest).whole() if end == "elif" else None
                    out.append(If(branches))
                elif word == "set":
                    name, _, value = rest.partition("=")
                    out.append(Set(_assigned(name.strip()), _Expression(value).whole()))
                elif word == "generation":
                    out.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown statement {word!r}")
            elif part:
                out.append(Text(part))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return out, "", ""

    return body()[0]


def fold_expression(e: tuple) -> tuple:
    """The expression with every part that has only constants worked out."""
    if e[0] in ("const", "name"):
        return e
    e = tuple(fold_expression(x) if isinstance(x, tuple) else x for x in e)
    if e[0] == "if" and e[1][0] == "const":
        return e[2] if e[1][1] else e[3]
    if e[0] in ("and", "or") and e[1][0] == "const":
        return e[2] if bool(e[1][1]) == (e[0] == "and") else e[1]
    if all(x[0] == "const" for x in e if isinstance(x, tuple)):
        try:
            return ("const", _expression(e)({}))
        except TemplateError:
            raise
        except (TypeError, ValueError, ArithmeticError):
            return e  # the error belongs to the rendering
    return e


def fold(body: list) -> list:
    """Statements with constants worked out: dead branches go, neighbouring texts join."""
    out: list = []
    for s in body:
        if isinstance(s, Out):
            e = fold_expression(s.expr)
            s = Text(_show(e[1])) if e[0] == "const" else Out(e)
        elif isinstance(s, Set):
            s = Set(s.name, fold_expression(s.expr))
        elif isinstance(s, For):
            s = For(s.name, fold_expression(s.over), fold(s.body))
        elif isinstance(s, Generation):
            s = Generation(fold(s.body))
        elif isinstance(s, If):
            branches = []
            for condition, inner in s.branches:
                c = fold_expression(condition) if condition is not None else None
                if c is not None and c[0] == "const":
                    if not c[1]:
                        continue
                    c = None
                branches.append((c, fold(inner)))
                if c is None:
                    break
            if not branches:
                continue
            if branches[0][0] is None:
                out += branches[0][1]
                continue
            s = If(branches)
        out.append(s)
    joined: list = []
    for s in out:
        if isinstance(s, Text) and joined and isinstance(joined[-1], Text):
            joined[-1] = Text(joined[-1].text + s.text)
        elif not (isinstance(s, Text) and not s.text):
            joined.append(s)
    return joined


def _expression(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda scope: value
    if kind == "name":
        name = e[1]

        def named(scope):
            if name not in scope:
                raise TemplateError(f"{name!r} is not defined")
            return scope[name]
        return named
    if kind == "key":
        of, key = _expression(e[1]), _expression(e[2])

        def keyed(scope):
            value = of(scope)
            if not isinstance(value, Mapping):
                raise TemplateError("only mappings have keys")
            return value.get(key(scope))
        return keyed
    if kind == "filter":
        use, of = FILTERS[e[1]], _expression(e[2])
        return lambda scope: use(of(scope))
    if kind == "not":
        of = _expression(e[1])
        return lambda scope: not of(scope)
    if kind == "and":
        a, b = _expression(e[1]), _expression(e[2])
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        a, b = _expression(e[1]), _expression(e[2])
        return lambda scope: a(scope) or b(scope)
    if kind == "if":
        c, a, b = (_expression(x) for x in e[1:])
        return lambda scope: a(scope) if c(scope) else b(scope)
    use, a, b = (_COMPARE | _ARITHMETIC)[e[1]], _expression(e[2]), _expression(e[3])
    return lambda scope: use(a(scope), b(scope))


Fragments = Iterator[tuple[str, bool]]


def _statement(s) -> Callable[[dict, bool], Fragments]:
    if isinstance(s, Text):
        text = s.text

        def say(scope, on):
            yield text, on
        return say
    if isinstance(s, Out):
        of = _expression(s.expr)

        def show(scope, on):
            yield _show(of(scope)), on
        return show
    if isinstance(s, Set):
        name, of = s.name, _expression(s.expr)

        def put(scope, on):
            scope[name] = of(scope)
            return
            yield
        return put
    if isinstance(s, Generation):
        inner = _body(s.body)
        return lambda scope, on: inner(scope, True)
    if isinstance(s, If):
        branches = [(_expression(c) if c is not None else (lambda scope: True), _body(b)) for c, b in s.branches]

        def branch(scope, on):
            for condition, inner in branches:
                if condition(scope):
                    yield from inner(scope, on)
                    return
        return branch
    name, over, inner = s.name, _expression(s.over), _body(s.body)

    def loop(scope, on):
        rest = iter(over(scope))
        item = next(rest, rest)
        index = 0
        while item is not rest:
            following = next(rest, rest)  # one ahead, to know the last one
            scope[name] = item
            scope["loop"] = {"index0": index, "index": index + 1, "first": index == 0, "last": following is rest}
            yield from inner(scope, on)
            item, index = following, index + 1
    return loop


def _body(body: list) -> Callable[[dict, bool], Fragments]:
    steps = [_statement(s) for s in body]

    def run(scope, on):
        for step in steps:
            yield from step(scope, on)
    return run


class Template:
    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.run = _body(self.tree)

    def stream(self, messages: Iterable[Mapping], **names) -> Fragments:
        """Fragments of the rendered text and whether each is generated; messages are read as they are needed."""
        yield from self.run({**names, "messages": messages}, False)

    def render(self, messages: Iterable[Mapping], **names) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans (code points) of what is generated."""
        text, spans, at = [], [], 0
        for fragment, on in self.stream(messages, **names):
            if on and fragment:
                spans.append((at, at + len(fragment)))
            text.append(fragment)
            at += len(fragment)
        return "".join(text), spans


def compile_template(source: str) -> Template:
    return Template(source)
