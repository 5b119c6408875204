"""Command tokens to options: the textual front of search and aggregate."""

from __future__ import annotations

import shlex

from quern.operators.aggregate import Apply, Filter, GroupBy, Limit, Load, Reduce, SortBy, Stage
from quern.operators.search import SearchOptions
from quern.plans.schema import QueryError

#: Options that steer a cluster or the reply's form; accepted and without effect here.
_NO_EFFECT = ("LOCALONLY", "ALLSHARDS", "SOMESHARDS", "CONSISTENT", "INCONSISTENT", "ADDSCORES")


def split_command(command: str | list) -> list:
    """Tokens of a command line (quoted as in a shell), or a list as it is; vectors stay bytes or sequences."""
    return shlex.split(command) if isinstance(command, str) else list(command)


class Tokens:
    def __init__(self, tokens: list) -> None:
        self.tokens, self.at = tokens, 0

    def more(self) -> bool:
        return self.at < len(self.tokens)

    def take(self) -> str:
        if not self.more():
            raise QueryError("the command ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def count(self) -> int:
        text = str(self.take())
        if not text.isdigit():
            raise QueryError(f"{text!r} is not a count")
        return int(text)

    def has(self, *words: str) -> str | None:
        """The next token in upper case, taken, if it is one of words."""
        if self.more() and isinstance(self.tokens[self.at], str) and self.tokens[self.at].upper() in words:
            return self.take().upper()
        return None

    def params(self) -> dict:
        n = self.count()
        if n % 2:
            raise QueryError("PARAMS takes pairs")
        out: dict = {}
        for _ in range(n // 2):
            name = self.take()
            if not name.replace("_", "").isalnum():
                raise QueryError(f"parameter name {name!r} has an invalid character")
            if name in out:
                raise QueryError(f"parameter {name} is given twice")
            out[name] = self.take()
        return out

    def common(self, options: dict) -> bool:
        """Takes an option that both commands have."""
        word = self.has("PARAMS", "VERBATIM", "INORDER", "SLOP", "DIALECT", "TIMEOUT", *_NO_EFFECT)
        if word is None:
            return False
        if word == "PARAMS":
            options["params"] = self.params()
        elif word in ("VERBATIM", "INORDER"):
            options[word.lower()] = True
        elif word == "SLOP":
            options["slop"] = self.count()
        elif word == "DIALECT":
            if not 2 <= self.count() <= 4:
                raise QueryError("DIALECT must be 2, 3 or 4")
        elif word == "TIMEOUT":
            options["timeout"] = self.count()
            if options["timeout"] > 60_000:
                raise QueryError("TIMEOUT is at most 60000")
        return True


def parse_search(tokens: list) -> tuple[str, str, SearchOptions]:
    """(index, query, options)."""
    t, options = Tokens(tokens), {}
    index, query = t.take(), t.take()
    while t.more():
        if t.common(options):
            continue
        word = t.has("NOCONTENT", "RETURN", "LIMIT", "SORTBY", "WITHSORTKEYS")
        if word is None:
            raise QueryError(f"unexpected {t.take()!r}")
        if word == "NOCONTENT":
            options["nocontent"] = True
        elif word == "WITHSORTKEYS":
            options["with_sort_keys"] = True
        elif word == "LIMIT":
            options["limit"] = (t.count(), t.count())
        elif word == "SORTBY":
            name = t.take().removeprefix("@")
            options["sortby"] = (name, t.has("ASC", "DESC") != "DESC")
        else:
            end, names = t.count() + t.at, []
            while t.at < end:
                name = t.take().removeprefix("@")
                names.append((name, t.take() if t.at < end and t.has("AS") else name))
            options["returns"] = tuple(names)
    return index, query, SearchOptions(**options)


def _reduce(t: Tokens) -> Reduce:
    function, n = t.take(), t.count()
    if function.upper() == "FIRST_VALUE":
        if n not in (1, 3, 4):
            raise QueryError("FIRST_VALUE takes 1, 3 or 4 arguments")
        args, by = (t.take(),), None
        if n > 1:
            if not t.has("BY"):
                raise QueryError("FIRST_VALUE: expected BY")
            by = (t.take(), True)
            if n == 4:
                way = t.has("ASC", "DESC")
                if way is None:
                    raise QueryError("FIRST_VALUE: expected ASC or DESC")
                by = (by[0], way == "ASC")
        return Reduce(function, args, t.take() if t.has("AS") else None, by, n == 4)
    args = tuple(t.take() for _ in range(n))
    return Reduce(function, args, t.take() if t.has("AS") else None)


def parse_aggregate(tokens: list) -> tuple[str, str, SearchOptions, tuple[Stage, ...]]:
    """(index, query, options, stages in the order given)."""
    t, options, stages = Tokens(tokens), {}, []
    index, query = t.take(), t.take()
    while t.more():
        if t.common(options):
            continue
        word = t.has("LOAD", "APPLY", "FILTER", "GROUPBY", "LIMIT", "SORTBY")
        if word is None:
            raise QueryError(f"unexpected {t.take()!r}")
        if word == "LOAD":
            if t.has("*"):
                stages.append(Load(None))
            else:
                names = tuple(t.take().removeprefix("@") for _ in range(t.count()))
                if "" in names:
                    raise QueryError("an empty argument in LOAD")
                stages.append(Load(names))
        elif word == "APPLY":
            expr = t.take()
            if not t.has("AS"):
                raise QueryError("APPLY needs AS")
            stages.append(Apply(expr, t.take()))
        elif word == "FILTER":
            stages.append(Filter(t.take()))
        elif word == "LIMIT":
            stages.append(Limit(t.count(), t.count()))
        elif word == "SORTBY":
            end, keys = t.count() + t.at, []
            while t.at < end:
                expr = t.take()
                keys.append((expr, t.has("ASC", "DESC") != "DESC"))
            stages.append(SortBy(tuple(keys), t.count() if t.has("MAX") else None))
        else:
            fields = []
            for _ in range(t.count()):
                name = t.take()
                if not name.startswith("@"):
                    raise QueryError("a GROUPBY field starts with @")
                fields.append(name[1:])
            if not fields:
                raise QueryError("GROUPBY needs a field")
            reducers = []
            while t.has("REDUCE"):
                reducers.append(_reduce(t))
            stages.append(GroupBy(tuple(fields), tuple(reducers)))
    return index, query, SearchOptions(**options), tuple(stages)
