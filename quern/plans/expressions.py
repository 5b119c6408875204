"""The expression language of APPLY, FILTER, SORTBY and reducers: text to a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quern.plans.schema import QueryError


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Invert:
    arg: object


Expr = Number | Text | Ref | Call | Binary | Invert

#: Operators by level, loosest first; all are left-associative.
_LEVELS = (("||",), ("&&",), ("<=", "<", "==", "!=", ">=", ">"), ("+", "-"), ("*", "/", "^"))
_NUMBER = re.compile(r"[+-]?(?:inf(?![A-Za-z0-9_])|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_NAME = re.compile(r"[A-Za-z0-9_]+")


class ExpressionParser:
    def __init__(self, text: str, params: dict[str, str] | None = None, depth: int = 1000, used: set[str] | None = None) -> None:
        self.text, self.at, self.params, self.depth, self.used = text, 0, params or {}, depth, used if used is not None else set()

    def parse(self) -> Expr:
        node = self._level(0, 0)
        self._skip()
        if self.at < len(self.text):
            raise QueryError(f"unexpected {self.text[self.at :]!r} in expression {self.text!r}")
        return node

    def _skip(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def _level(self, level: int, depth: int) -> Expr:
        if depth > self.depth:
            raise QueryError("the expression is nested too deeply")
        if level == len(_LEVELS):
            return self._primary(depth + 1)
        left = self._level(level + 1, depth)
        while True:
            self._skip()
            op = next((o for o in _LEVELS[level] if self.text.startswith(o, self.at)), None)
            if op is None:
                return left
            self.at += len(op)
            left = Binary(op, left, self._level(level + 1, depth))

    def _primary(self, depth: int) -> Expr:
        if depth > self.depth:
            raise QueryError("the expression is nested too deeply")
        self._skip()
        c = self.text[self.at : self.at + 1]
        if not c:
            raise QueryError(f"the expression {self.text!r} ends too early")
        if c == "(":
            self.at += 1
            node = self._level(0, depth)
            self._close(")")
            return node
        if c in "+-.0123456789":
            m = _NUMBER.match(self.text, self.at)
            if not m:
                raise QueryError(f"invalid number in {self.text!r}")
            self.at = m.end()
            return Number(float(m[0]))
        if c == "!":
            self.at += 1
            return Invert(self._primary(depth + 1))
        if c in "'\"":
            return self._quoted(c)
        m = _NAME.match(self.text, self.at + (c in "@$"))
        if not m:
            raise QueryError(f"unexpected {c!r} in expression {self.text!r}")
        self.at = m.end()
        if c == "@":
            return Ref(m[0])
        if c == "$":
            if m[0] not in self.params:
                raise QueryError(f"parameter ${m[0]} is missing")
            self.used.add(m[0])
            return Text(self.params[m[0]])
        self._close("(")
        args: list[Expr] = []
        self._skip()
        if self.text[self.at : self.at + 1] == ")":
            self.at += 1
            return Call(m[0], ())
        while True:
            args.append(self._level(0, depth))
            self._skip()
            if self.text[self.at : self.at + 1] != ",":
                break
            self.at += 1
        self._close(")")
        return Call(m[0], tuple(args))

    def _close(self, char: str) -> None:
        self._skip()
        if self.text[self.at : self.at + 1] != char:
            raise QueryError(f"expected {char!r} at position {self.at + 1} of {self.text!r}")
        self.at += 1

    def _quoted(self, quote: str) -> Text:
        out, at = "", self.at + 1
        while at < len(self.text) and self.text[at] != quote:
            if self.text[at] == "\\":
                at += 1
            out += self.text[at : at + 1]
            at += 1
        if at >= len(self.text):
            raise QueryError("a quote is not closed")
        self.at = at + 1
        return Text(out)


def parse_expression(text: str, params: dict[str, str] | None = None, depth: int = 1000, used: set[str] | None = None) -> Expr:
    return ExpressionParser(text, params, depth, used).parse()
