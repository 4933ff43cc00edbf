"""A sandboxed chat template language: parsed, folded and compiled to closures.

    text {{ expression }} {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %} {% set x = e %} {% generation %} {% endgeneration %} {# note #}

``{%-`` and ``-%}`` (and with braces) strip white space beside them.  Expressions
have strings, integers, true, false, none, names, ``a.b`` and ``a['b']`` on mappings,
``loop.index``, ``loop.index0``, ``loop.first`` and ``loop.last``, ``+``, ``~``,
``%``, comparisons, ``in``, ``not``, ``and``, ``or``, ``a if c else b`` and filters.
There are no calls and no attributes of Python objects, so a template can only reach
what it is given.

A compiled template yields (piece, whether it was generated) pairs and reads the
sequence of a loop one item ahead, so a conversation of any length renders in the
memory of one message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

Scope = dict[str, Any]
Piece = tuple[str, bool]


class TemplateError(ValueError):
    pass


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else "true" if x is True else "false" if x is False else str(x)


def _plus(a: Any, b: Any) -> Any:
    return _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b


OPS: dict[str, Callable[..., Any]] = {
    "+": _plus,
    "~": lambda a, b: _text(a) + _text(b),
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) else _fail("% is for numbers"),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len}


def _fail(why: str) -> Any:
    raise TemplateError(why)


# Parsing

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(?:.*?)(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~%<>().\[\]|=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_BINDING = [{"or"}, {"and"}, {"==", "!=", "<", ">", "<=", ">=", "in"}, {"+", "~"}, {"%"}]


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            number, string, name, sign = m.groups()
            if number is not None:
                self.tokens.append(("const", int(number)))
            elif string is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)))
            else:
                self.tokens.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self) -> Any:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "const" else None

    def take(self, what: str | None = None) -> tuple[str, Any]:
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        if what is not None and (kind == "const" or value != what):
            raise TemplateError(f"{what!r} expected, not {value!r}")
        self.at += 1
        return kind, value

    def whole(self) -> Any:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} isn't expected")
        return tree

    def choice(self) -> Any:
        tree = self.level(0)
        if self.peek() == "if":
            self.take()
            test = self.level(0)
            self.take("else")
            tree = Op("if", (test, tree, self.choice()))
        return tree

    def level(self, k: int) -> Any:
        if k == len(_BINDING):
            return self.unary()
        tree = self.level(k + 1)
        while self.peek() in _BINDING[k]:
            _, name = self.take()
            tree = Op(name, (tree, self.level(k + 1)))
        return tree

    def unary(self) -> Any:
        if self.peek() == "not":
            self.take()
            return Op("not", (self.level(2),))
        tree = self.primary()
        while self.peek() in (".", "[", "|"):
            _, sign = self.take()
            if sign == ".":
                kind, name = self.take()
                tree = Get(tree, Const(name if kind == "name" else _fail("a name follows a dot")))
            elif sign == "[":
                tree = Get(tree, self.choice())
                self.take("]")
            else:
                _, name = self.take()
                tree = Filter(name, tree)
        return tree

    def primary(self) -> Any:
        kind, value = self.take()
        if kind == "const":
            return Const(value)
        if kind == "name":
            low = value.lower()
            return Const({"true": True, "false": False, "none": None}[low]) if low in ("true", "false", "none") else Name(value)
        if value == "(":
            tree = self.choice()
            self.take(")")
            return tree
        raise TemplateError(f"{value!r} isn't expected")


def parse(source: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    stack: list[list] = [["", None, [], []]]  # kind, head, finished branches, body
    at, strip = 0, False

    def text(piece: str, strip_left: bool, strip_right: bool) -> None:
        piece = piece.lstrip() if strip_left else piece
        piece = piece.rstrip() if strip_right else piece
        if piece:
            stack[-1][3].append(Emit(Const(piece)))

    def close(kind: str) -> list:
        top = stack.pop()
        if top[0] != kind or not stack:
            raise TemplateError(f"end{kind} without {kind}")
        return top

    for m in _TAG.finditer(source):
        marks = [x for x in (m[1], m[4], m[7]) if x is not None], [x for x in (m[3], m[6], m[8]) if x is not None]
        text(source[at : m.start()], strip, "-" in marks[0])
        at, strip = m.end(), "-" in marks[1]
        if m[2] is not None:
            stack[-1][3].append(Emit(_Expression(m[2]).whole()))
        elif m[5] is not None:
            word, _, rest = m[5].strip().partition(" ")
            if word == "if":
                stack.append(["if", _Expression(rest).whole(), [], []])
            elif word in ("elif", "else"):
                top = stack[-1]
                if top[0] != "if":
                    raise TemplateError(f"{word} without if")
                top[2].append((top[1], tuple(top[3])))
                top[1], top[3] = (Const(True) if word == "else" else _Expression(rest).whole()), []
            elif word == "endif":
                top = close("if")
                tree: tuple = ()
                for test, body in reversed([*top[2], (top[1], tuple(top[3]))]):
                    tree = (If(test, body, tree),)
                stack[-1][3].extend(tree)
            elif word == "for":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S) or _fail("for NAME in EXPRESSION")
                stack.append(["for", (found[1], _Expression(found[2]).whole()), [], []])
            elif word == "endfor":
                top = close("for")
                stack[-1][3].append(For(*top[1], tuple(top[3])))
            elif word == "set":
                found = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", rest.strip(), re.S) or _fail("set NAME = EXPRESSION")
                stack[-1][3].append(Set(found[1], _Expression(found[2]).whole()))
            elif word == "generation":
                stack.append(["generation", None, [], []])
            elif word == "endgeneration":
                top = close("generation")
                stack[-1][3].append(Generation(tuple(top[3])))
            else:
                raise TemplateError(f"no such statement: {word!r}")
    text(source[at:], strip, False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][3])


# Constant folding


def fold(tree: Any, filters: Mapping[str, Callable] = FILTERS) -> Any:
    """The same tree with what is known now computed: expressions of constants,
    branches never or always taken, and neighbouring texts.

    A test is folded first, and a branch never taken isn't looked at.  What can't be
    computed stays, and fails where it is rendered.
    """
    if isinstance(tree, tuple):
        out: list = []
        for x in tree:
            x = fold(x, filters)
            if isinstance(x, If) and isinstance(x.test, Const):
                more = x.then if x.test.value else x.otherwise
            else:
                more = (x,)
            for y in more:
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    y = Emit(Const(_text(y.value.value)))
                    if not y.value.value:
                        continue
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        y = Emit(Const(out.pop().value.value + y.value.value))
                out.append(y)
        return tuple(out)
    if isinstance(tree, Op):
        if tree.name in ("and", "or", "if"):
            test = fold(tree.args[0], filters)
            if isinstance(test, Const):
                if tree.name == "if":
                    return fold(tree.args[1 if test.value else 2], filters)
                return fold(tree.args[1], filters) if bool(test.value) == (tree.name == "and") else test
            return Op(tree.name, (test, *(fold(x, filters) for x in tree.args[1:])))
        args = tuple(fold(x, filters) for x in tree.args)
        return _now(Op(tree.name, args), OPS.get(tree.name), args)
    if isinstance(tree, Filter):
        of = fold(tree.of, filters)
        return _now(Filter(tree.name, of), filters.get(tree.name), (of,))
    if isinstance(tree, Get):
        return Get(fold(tree.of, filters), fold(tree.key, filters))
    if isinstance(tree, Emit):
        return Emit(fold(tree.value, filters))
    if isinstance(tree, Set):
        return Set(tree.name, fold(tree.value, filters))
    if isinstance(tree, If):
        test = fold(tree.test, filters)
        if isinstance(test, Const):
            return If(test, *((fold(tree.then, filters), ()) if test.value else ((), fold(tree.otherwise, filters))))
        return If(test, fold(tree.then, filters), fold(tree.otherwise, filters))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.over, filters), fold(tree.body, filters))
    if isinstance(tree, Generation):
        return Generation(fold(tree.body, filters))
    return tree


def _now(tree: Any, use: Callable | None, args: tuple) -> Any:
    """The value of an operation on constants, or the operation if there is none."""
    if use and all(isinstance(x, Const) for x in args):
        try:
            return Const(use(*(x.value for x in args)))
        except (TemplateError, ArithmeticError, TypeError):
            pass
    return tree


# Closures


def _safe(name: str, use: Callable[..., Any]) -> Callable[..., Any]:
    """An operation whose failures on values it isn't for are template errors."""

    def run(*args: Any) -> Any:
        try:
            return use(*args)
        except (ArithmeticError, TypeError) as why:
            raise TemplateError(f"{name}: {why}") from why

    return run


def _value(tree: Any, filters: Mapping[str, Callable]) -> Callable[[Scope], Any]:
    if isinstance(tree, Const):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):
        return lambda scope, n=tree.name: scope.get(n)
    if isinstance(tree, Get):
        of, key = _value(tree.of, filters), _value(tree.key, filters)

        def get(scope: Scope) -> Any:
            held, k = of(scope), key(scope)
            if isinstance(held, Mapping):
                return held.get(k)
            if isinstance(held, (list, tuple)) and isinstance(k, int):
                return held[k] if -len(held) <= k < len(held) else None
            raise TemplateError(f"{k!r} of what is no mapping")

        return get
    if isinstance(tree, Filter):
        use = _safe(tree.name, filters.get(tree.name) or _fail(f"no such filter: {tree.name!r}"))
        of = _value(tree.of, filters)
        return lambda scope: use(of(scope))
    args = [_value(x, filters) for x in tree.args]
    if tree.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if tree.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    if tree.name == "if":
        return lambda scope: args[1](scope) if args[0](scope) else args[2](scope)
    use = _safe(tree.name, OPS[tree.name])
    return (lambda scope: use(args[0](scope))) if len(args) == 1 else (lambda scope: use(args[0](scope), args[1](scope)))


def _body(trees: tuple, filters: Mapping[str, Callable], inside: bool) -> Callable[[Scope], Iterator[Piece]]:
    parts = [_statement(x, filters, inside) for x in trees]

    def run(scope: Scope) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope)

    return run


def _statement(tree: Any, filters: Mapping[str, Callable], inside: bool) -> Callable[[Scope], Iterator[Piece]]:
    if isinstance(tree, Emit):
        value = _value(tree.value, filters)
        return lambda scope: iter(((_text(value(scope)), inside),))
    if isinstance(tree, Generation):
        return _body(tree.body, filters, True)
    if isinstance(tree, If):
        test, then, otherwise = _value(tree.test, filters), _body(tree.then, filters, inside), _body(tree.otherwise, filters, inside)
        return lambda scope: then(scope) if test(scope) else otherwise(scope)
    value = _value(tree.value if isinstance(tree, Set) else tree.over, filters)
    if isinstance(tree, Set):

        def assign(scope: Scope) -> Iterator[Piece]:
            scope[tree.name] = value(scope)
            return iter(())

        return assign
    body = _body(tree.body, filters, inside)

    def loop(scope: Scope) -> Iterator[Piece]:
        items, k = iter(value(scope) or ()), 0
        item = next(items, loop)
        while item is not loop:
            following = next(items, loop)
            inner = {**scope, tree.name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": following is loop}}
            yield from body(inner)
            item, k = following, k + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[Piece]]:
    """A function of named values that yields (piece, generated) pairs."""
    known = {**FILTERS, **(filters or {})}
    run = _body(fold(parse(source), known), known, False)
    return lambda **values: run(dict(values))


def render(source: str, filters: Mapping[str, Callable] | None = None, **values: Iterable) -> str:
    return "".join(piece for piece, _ in compile_template(source, filters)(**values))
