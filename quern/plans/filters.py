"""The filter language: a query string becomes a tree of predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quern.functions.text import fold_word
from quern.plans.schema import NUMERIC, TAG, TEXT, IndexSchema, QueryError, Settings


@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class NumericRange:
    field: str
    low: float
    high: float
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class Tags:
    field: str
    exact: tuple[str, ...]
    prefixes: tuple[str, ...]


@dataclass(frozen=True)
class Word:
    """how: term, exact, prefix, suffix or fuzzy; fields: the text fields that it may stand in."""

    text: str
    how: str
    fields: tuple[str, ...]
    distance: int = 0


@dataclass(frozen=True)
class And:
    children: tuple
    slop: int | None = None
    inorder: bool = False


@dataclass(frozen=True)
class Or:
    children: tuple


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class Knn:
    k: int
    field: str
    vector: str
    score: str
    ef_runtime: int | None = None


Node = MatchAll | NumericRange | Tags | Word | And | Or | Not

_SPACE = " \t\n\r\x0b\x0c"
_NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\d.])")
_RESERVED = "{}[]:;$"


def split_query(query: str) -> tuple[str, str | None]:
    """The filter and, if there is one, what stands behind `=>`; a quoted or braced `=>` does not split."""
    at = quoted = braced = 0
    while at < len(query):
        c = query[at]
        if c == "\\":
            at += 1
        elif c == '"':
            quoted ^= 1
        elif c in "{}" and not quoted:
            braced = c == "{"
        elif query.startswith("=>", at) and not quoted and not braced:
            return query[:at], query[at + 2 :]
        at += 1
    return query, None


def parse_knn(text: str, schema: IndexSchema, params: dict[str, str], used: set[str]) -> Knn:
    """`[KNN k @field $vector [EF_RUNTIME n] [AS name]]`, with $names taken from params; the vector's stays a name."""
    body = re.fullmatch(r"\s*\[\s*(.*?)\s*\]\s*", text, re.DOTALL)
    words = body[1].split() if body else []
    if len(words) < 4 or words[0].upper() != "KNN" or not words[2].startswith("@") or not words[3].startswith("$"):
        raise QueryError("expected [KNN k @field $vector ...]")

    def value(word: str) -> str:
        if not word.startswith("$"):
            return word
        if word[1:] not in params:
            raise QueryError(f"parameter {word} is missing")
        used.add(word[1:])
        return params[word[1:]]

    name, ef, rest = None, None, words[4:]
    while rest:
        option, rest = rest[0].upper(), rest[1:]
        if not rest or option not in ("AS", "EF_RUNTIME"):
            raise QueryError(f"unexpected {option} in KNN")
        if option == "AS":
            name = value(rest[0])
        else:
            ef = _count(value(rest[0]), "EF_RUNTIME")
        rest = rest[1:]
    field = schema.field(words[2][1:])
    if field is None or field.kind != "VECTOR":
        raise QueryError(f"{words[2]} is no vector field")
    used.add(words[3][1:])
    return Knn(_count(value(words[1]), "k"), field.alias, words[3][1:], name or field.score_name, ef)


def _count(text: str, what: str) -> int:
    if not str(text).strip().isdigit() or int(text) < 1:
        raise QueryError(f"{what} must be a positive count")
    return int(text)


class FilterParser:
    """Recursive descent over the query string."""

    def __init__(self, text: str, schema: IndexSchema, settings: Settings, verbatim: bool = False, slop: int | None = None, inorder: bool = False) -> None:
        if len(text.encode()) > settings.query_bytes:
            raise QueryError("the query string is too long")
        self.text, self.at, self.schema, self.settings = text, 0, schema, settings
        self.verbatim, self.slop, self.inorder = verbatim, slop, inorder
        self.nodes, self.any = 0, False
        self.breaks = set(schema.punctuation) | {chr(c) for c in (*range(33), 127)}

    def parse(self) -> Node:
        if re.fullmatch(r"\s*(?:\*|\(\s*\*\s*\))\s*", self.text):
            return MatchAll()
        node = self._either(0)
        if self.at < len(self.text):
            raise QueryError(f"unexpected {self.text[self.at]!r} at position {self.at + 1}")
        if node is None:
            raise QueryError("invalid query syntax")
        return node

    # -- characters

    def _peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def _skip(self) -> None:
        while self._peek() and self._peek() in _SPACE:
            self.at += 1

    def _take(self, char: str) -> bool:
        self._skip()
        if self._peek() != char or not char:
            return False
        self.at += 1
        return True

    def _count_node(self) -> None:
        self.nodes += 1
        if self.nodes > self.settings.query_terms:
            raise QueryError("the query string has too many terms")

    # -- grammar

    def _either(self, depth: int) -> Node | None:
        """Alternatives of a level: what stands between bars, each a conjunction."""
        if depth >= self.settings.query_depth:
            raise QueryError("the query string is nested too deeply")
        groups: list[list[Node]] = [[]]
        while True:
            self._skip()
            if not self._peek() or self._peek() == ")":
                break
            if self._take("|"):
                if not groups[-1]:
                    raise QueryError("missing OR term")
                groups.append([])
                continue
            negated = self._take("-")
            if negated and self._take("|"):
                raise QueryError(f"unexpected '|' at position {self.at}")
            node = self._one(depth)
            if node is not None:
                self._count_node()
                groups[-1].append(Not(node) if negated else node)
        if not groups[-1]:
            if len(groups) > 1:
                raise QueryError("missing OR term")
            return None
        ands = [g[0] if len(g) == 1 else And(tuple(g), self.slop, self.inorder) for g in groups]
        return ands[0] if len(ands) == 1 else Or(tuple(ands))

    def _one(self, depth: int) -> Node | None:
        if self._take("("):
            node = self._either(depth + 1)
            if not self._take(")"):
                raise QueryError(f"expected ')' at position {self.at + 1}")
            if node is None:
                raise QueryError(f"empty brackets at position {self.at}")
            return node
        alias = None
        if self._peek() == "@":
            m = re.compile(r"@([A-Za-z0-9_]+)\s*:\s*").match(self.text, self.at)
            if not m:
                raise QueryError(f"expected a field name and ':' at position {self.at + 1}")
            alias, self.at = m[1], m.end()
            if self._take("["):
                self.any = True
                return self._range(alias)
            if self._take("{"):
                self.any = True
                return self._tags(alias)
        return self._text(alias)

    def _range(self, alias: str) -> NumericRange:
        field = self.schema.field(alias)
        if field is None or field.kind != NUMERIC:
            raise QueryError(f"{alias} is not indexed as a numeric field")
        low_open, low = self._take("("), self._bound()
        if self._peek() not in (" ", ","):
            self._skip()
            if self._peek() != ",":
                raise QueryError(f"expected space or ',' at position {self.at + 1}")
        self.at += 1
        high_open, high = self._take("("), self._bound()
        if not self._take("]"):
            raise QueryError(f"expected ']' at position {self.at + 1}")
        if low > high or low == high and (low_open or high_open):
            raise QueryError("the numeric range is empty")
        return NumericRange(alias, low, high, low_open, high_open)

    def _bound(self) -> float:
        self._skip()
        for name, value in (("-inf", float("-inf")), ("+inf", float("inf")), ("inf", float("inf"))):
            if self.text.startswith(name, self.at):
                self.at += len(name)
                return value
        m = _NUMBER.match(self.text, self.at)
        if not m:
            raise QueryError(f"invalid number at position {self.at + 1}")
        self.at = m.end()
        return float(m[0])

    def _tags(self, alias: str) -> Tags:
        field = self.schema.field(alias)
        if field is None or field.kind != TAG:
            raise QueryError(f"{alias} is not indexed as a tag field")
        raw, parts = "", []
        while True:
            c = self._peek()
            if not c:
                raise QueryError("a tag list is not closed")
            self.at += 1
            if c == "\\" and self._peek():
                raw += c + self._peek()
                self.at += 1
            elif c in "|}":
                parts.append(raw)
                raw = ""
                if c == "}":
                    break
            else:
                raw += c
        exact, prefixes = [], []
        for part in parts:
            tag = part.strip(_SPACE)
            if not tag:
                continue
            starred = tag.endswith("*") and not re.search(r"(?<!\\)(?:\\\\)*\\\*$", tag)
            if starred:
                if tag.endswith("**"):
                    raise QueryError(f"tag {tag!r} ends with several *")
                if len(tag) <= self.settings.tag_min_prefix:
                    raise QueryError(f"tag {tag!r} is too short for a prefix")
            body = re.sub(r"\\(.)", r"\1", tag[:-1] if starred else tag, flags=re.DOTALL)
            if not field.case_sensitive:
                body = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in body)
            (prefixes if starred else exact).append(body)
        if not exact and not prefixes:
            raise QueryError("a tag list is empty")
        return Tags(alias, tuple(dict.fromkeys(exact)), tuple(dict.fromkeys(prefixes)))

    # -- text

    def _text_fields(self, alias: str | None, suffix: bool) -> tuple[str, ...]:
        if alias is not None:
            field = self.schema.field(alias)
            if field is None or field.kind != TEXT:
                raise QueryError(f"{alias} is no text field")
            if suffix and not field.suffix:
                raise QueryError(f"{alias} does not support suffix search")
            return (alias,)
        found = tuple(f.alias for f in self.schema.of_kind(TEXT) if f.suffix or not suffix)
        if not found:
            raise QueryError("no field supports suffix search" if suffix else "the index has no text field")
        return found

    def _text(self, alias: str | None) -> Node | None:
        """A quoted phrase, or the next word; None where only stop words or punctuation are left before the next bracket or end."""
        self._text_fields(alias, False)
        if self._peek() == '"':
            return self._phrase(alias)
        while self._peek():
            before = self.at
            if self._peek() == '"':
                return self._phrase(alias)
            word, stop = self._word(alias)
            if word is not None:
                self.any = True
                return word
            if stop:
                break
            if self.at == before:
                self.at += 1  # punctuation
        if not self.any:
            raise QueryError("invalid query syntax")
        return None

    def _phrase(self, alias: str | None) -> Node | None:
        self.at += 1
        words, now = [], ""
        while self._peek() and self._peek() != '"':
            got = self._char()
            if got is None or got == "":
                words.append(now)
                now = ""
                if got == "":
                    self.at += 1
            else:
                now += got
        self.at += 1  # the closing quote, or past the end
        self.at = min(self.at, len(self.text))
        found = [Word(fold_word(w), "exact", self._text_fields(alias, False)) for w in [*words, now] if w]
        if not found:
            if not self.any:
                raise QueryError("invalid query syntax")
            return None
        self.any = True
        if len(found) == 1:
            return found[0]
        if not self.schema.offsets:
            raise QueryError("the index keeps no offsets for phrases")
        self.nodes += len(found)
        return And(tuple(found), 0, True)

    def _char(self) -> str | None:
        """The next character of a word, unescaped and consumed; None after a backslash that ends the word; '' at punctuation."""
        c = self._peek()
        if c == "\\":
            self.at += 1
            after = self._peek()
            if not after:
                raise QueryError("a backslash ends the query")
            if after == "\\" or after in self.breaks or "\\" not in self.breaks:
                self.at += 1
                return after
            return None
        if c in self.breaks:
            return ""
        self.at += 1
        return c

    def _word(self, alias: str | None) -> tuple[Word | None, bool]:
        """(the word, or None for a stop word or nothing, whether a bracket, bar, field or minus follows)."""
        body, before, behind, star_before, star_behind, stop = "", 0, 0, False, False, False
        while c := self._peek():
            if c == "\\":
                got = self._char()
                if got is None:
                    break
                body += got
                continue
            if c in ")|(@" or c == "-" and not body:
                stop = True
                break
            if c in _RESERVED:
                raise QueryError(f"unexpected {c!r} at position {self.at + 1}")
            if c == '"':
                break
            if c == "%":
                if not body:
                    while self._peek() == "%" and before <= self.settings.fuzzy_max_distance:
                        before += 1
                        self.at += 1
                    continue
                while behind < before and self._peek() == "%":
                    behind += 1
                    self.at += 1
                break
            if c == "*":
                self.at += 1
                if not body and not star_before:
                    star_before = True
                    continue
                star_behind = True
                break
            if c in self.breaks:
                break
            body += c
            self.at += 1
        text = fold_word(body)
        if before:
            if behind != before or before > self.settings.fuzzy_max_distance or not text:
                raise QueryError("invalid fuzzy '%' markers")
            return Word(text, "fuzzy", self._text_fields(alias, False), before), stop
        if star_before or star_behind:
            if not text:
                raise QueryError("invalid wildcard '*' markers")
            if star_before and star_behind:
                raise QueryError("infix search is not supported")
            return Word(text, "suffix" if star_before else "prefix", self._text_fields(alias, star_before)), stop
        if not text or text in self.schema.stop_words:
            return None, stop
        return Word(text, "exact" if self.verbatim else "term", self._text_fields(alias, False)), stop
