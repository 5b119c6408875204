"""Scalar functions by name: each builds a column; users may register their own."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.values import ARR, BOOL, NUM, STR, Val, as_number, as_text
from quern.plans.schema import QueryError, Settings

#: Seconds beyond which no calendar date is made of a timestamp.
_FAR = 2.5e11
_FAILED_PARSE = -2209075200.0


@dataclass(frozen=True)
class Function:
    least: int
    most: int
    build: Callable[..., Val]


FUNCTIONS: dict[str, Function] = {}


def register(name: str, least: int, most: int | None = None) -> Callable:
    """Adds a function of (settings, *values) -> value to the table."""

    def add(build: Callable[..., Val]) -> Callable[..., Val]:
        FUNCTIONS[name] = Function(least, least if most is None else most, build)
        return build

    return add


def call(name: str, args: list[Val], settings: Settings) -> Val:
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name!r}")
    f = FUNCTIONS[name]
    if not f.least <= len(args) <= f.most:
        raise QueryError(f"{name} takes {f.least} to {f.most} arguments, not {len(args)}")
    return f.build(settings, *args)


def _numeric(name: str, f: Callable[[Column], Column]) -> None:
    def one(settings: Settings, v: Val) -> Column:
        x = as_number(v)
        if v.kind == STR and settings.since(1, 2, 1):
            x = F.when(v.col.isNotNull(), F.coalesce(x, F.lit(float("nan"))))
        return f(x)

    @register(name, 1)
    def build(settings: Settings, v: Val) -> Val:
        if v.kind == ARR:
            return Val(F.transform(v.col, lambda x: one(settings, Val(x, v.item))), ARR, NUM)
        return Val(one(settings, v), NUM)


def _rounded(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when((F.abs(x) < 2.0**53), f(x).cast("double")).otherwise(x)


def _logarithm(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(F.isnan(x) | (x < 0), F.lit(float("nan"))).when(x == 0, F.lit(float("-inf"))).when(x == float("inf"), x).otherwise(f(x))


for _name, _f in {
    "abs": F.abs, "exp": F.exp, "sqrt": F.sqrt, "ceil": _rounded(F.ceil), "floor": _rounded(F.floor), "log": _logarithm(F.ln), "log2": _logarithm(F.log2),
}.items():
    _numeric(_name, _f)


@register("exists", 1)
def _exists(settings: Settings, v: Val) -> Val:
    return Val(v.col.isNotNull(), BOOL)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _cased(name: str, old: str, new: str) -> None:
    def one(settings: Settings, v: Val) -> Column:
        if v.kind != STR and settings.since(1, 2, 1):
            return F.lit(None).cast("string")
        return F.translate(as_text(v), old, new)

    @register(name, 1)
    def build(settings: Settings, v: Val) -> Val:
        if v.kind == ARR:
            return Val(F.transform(v.col, lambda x: one(settings, Val(x, v.item))), ARR, STR)
        return Val(one(settings, v), STR)


_cased("lower", _UPPER, _LOWER)
_cased("upper", _LOWER, _UPPER)


@register("strlen", 1)
def _strlen(settings: Settings, v: Val) -> Val:
    if v.kind == ARR:
        return Val(F.transform(v.col, lambda x: F.octet_length(as_text(Val(x, v.item))).cast("double")), ARR, NUM)
    return Val(F.octet_length(as_text(v)).cast("double"), NUM)


def _over_two(f: Callable[[Column, Column], Column], kind: str) -> Callable[..., Val]:
    """f over texts; arrays element by element."""

    def build(settings: Settings, a: Val, b: Val) -> Val:
        if a.kind == ARR and b.kind == ARR:
            return Val(F.when(F.size(a.col) == F.size(b.col), F.zip_with(a.col, b.col, lambda x, y: f(as_text(Val(x, a.item)), as_text(Val(y, b.item))))), ARR, kind)
        if a.kind == ARR:
            return Val(F.transform(a.col, lambda x: f(as_text(Val(x, a.item)), as_text(b))), ARR, kind)
        if b.kind == ARR:
            return Val(F.transform(b.col, lambda y: f(as_text(a), as_text(Val(y, b.item)))), ARR, kind)
        return Val(f(as_text(a), as_text(b)), kind)

    return build


def _occurrences(text: Column, part: Column) -> Column:
    gone = F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))
    return F.when(part == "", F.octet_length(text) + 1).otherwise(F.try_divide(gone, F.octet_length(part))).cast("double")


FUNCTIONS["startswith"] = Function(2, 2, _over_two(F.startswith, BOOL))
FUNCTIONS["contains"] = Function(2, 2, _over_two(_occurrences, NUM))


@register("substr", 3)
def _substr(settings: Settings, v: Val, offset: Val, length: Val) -> Val:
    if ARR in (v.kind, offset.kind, length.kind):
        return Val(F.lit(None).cast("string"), STR)
    text = as_text(v)
    raw, size = text.cast("binary"), F.octet_length(text).cast("bigint")
    off, n = as_number(offset).try_cast("bigint"), as_number(length).try_cast("bigint")
    start = F.when(off >= 0, off).otherwise(off + size)
    count = F.when(n >= 0, F.least(n, size)).otherwise(size - start + n)
    part = F.substring(raw, (start + 1).cast("int"), F.greatest(count, F.lit(0)).cast("int")).cast("string")
    found = F.when((start > size) | (start < 0) | (n == 0) | (count <= 0), F.lit("")).otherwise(part)
    return Val(F.when(text.isNotNull() & off.isNotNull() & n.isNotNull(), found), STR)


@register("concat", 0, 50)
def _concat(settings: Settings, *values: Val) -> Val:
    return Val(F.concat(*map(as_text, values)) if values else F.lit(""), STR)


# -- time: numbers of seconds since 1970, in UTC


def _finite(v: Val, settings: Settings) -> Column:
    x = as_number(v)
    good = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(good & (x >= 0) if settings.since(1, 2, 1) else good, x)


def _moment(x: Column) -> Column:
    return F.timestamp_seconds(F.when(F.abs(x) < _FAR, x).cast("bigint"))


def _calendar(name: str, part: Callable[[Column], Column]) -> None:
    @register(name, 1)
    def build(settings: Settings, v: Val) -> Val:
        return Val(part(_moment(_finite(v, settings))).cast("double"), NUM)


_calendar("dayofmonth", F.dayofmonth)
_calendar("dayofyear", lambda t: F.dayofyear(t) - 1)
_calendar("monthofyear", lambda t: F.month(t) - 1)
_calendar("year", F.year)


@register("dayofweek", 1)
def _dayofweek(settings: Settings, v: Val) -> Val:
    return Val(F.pmod(F.floor(_finite(v, settings) / 86400.0) + 4, F.lit(7)).cast("double"), NUM)


def _period(name: str, seconds: float) -> None:
    @register(name, 1)
    def build(settings: Settings, v: Val) -> Val:
        return Val(F.floor(_finite(v, settings) / seconds).cast("double") * seconds, NUM)


_period("minute", 60.0)
_period("hour", 3600.0)
_period("day", 86400.0)


@register("month", 1)
def _month(settings: Settings, v: Val) -> Val:
    first = F.unix_timestamp(F.date_trunc("month", _moment(_finite(v, settings)))).cast("double")
    return Val(first if settings.since(1, 2, 1) else first - 86400.0, NUM)


#: What strftime's codes are in date_format's letters.
_CODES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}
_PLAIN_CODES = {"%": "%", "n": "\n", "t": "\t", "Z": "GMT", "z": "+0000"}


def _format(x: Column, pattern: str) -> Column:
    t, out = _moment(x), []
    for code, text in re.findall(r"%(.)|([^%]+|%$)", pattern, re.DOTALL):
        if text:
            out.append(F.lit(text))
        elif code in _CODES:
            out.append(F.date_format(t, _CODES[code]))
        elif code in _PLAIN_CODES:
            out.append(F.lit(_PLAIN_CODES[code]))
        elif code == "e":
            out.append(F.lpad(F.dayofmonth(t).cast("string"), 2, " "))
        elif code == "s":
            out.append(F.unix_timestamp(t).cast("string"))
        else:
            return _format_anyhow(x, F.lit(pattern))
    return F.concat(*out)


def _format_anyhow(x: Column, pattern: Column) -> Column:
    """For codes without a built-in counterpart, and patterns that differ by row."""

    @F.pandas_udf("string")
    def formatted(seconds: pd.Series, patterns: pd.Series) -> pd.Series:
        def one(s: float, p: str | None) -> str | None:
            return None if p is None or s is None or s != s or abs(s) > _FAR else time.strftime(p, time.gmtime(int(s)))

        return pd.Series([one(s, p) for s, p in zip(seconds, patterns, strict=True)], dtype=object)

    return formatted(x, pattern)


@register("timefmt", 1, 2)
def _timefmt(settings: Settings, v: Val, pattern: Val | None = None) -> Val:
    x = as_number(v)
    x = F.when(F.abs(x) != float("inf"), x)
    if pattern is None:
        return Val(F.when(x.isNotNull(), _format(x, "%FT%TZ")), STR)
    empty = F.lit(None).cast("string") if settings.since(1, 2, 1) else F.lit("")
    if isinstance(pattern.literal, str):
        return Val(F.when(x.isNotNull(), _format(x, pattern.literal) if pattern.literal else empty), STR)
    text = as_text(pattern)
    return Val(F.when(x.isNotNull() & text.isNotNull(), F.when(text == "", empty).otherwise(_format_anyhow(x, text))), STR)


_PARTS = {"Y": r"([+-]?\d{1,4})", "m": r"(1[0-2]|0?[1-9])", "d": r"(3[01]|[12]\d|0?[1-9])", "e": r"(3[01]|[12]\d|0?[1-9])", "H": r"(2[0-3]|[01]?\d)", "M": r"([0-5]?\d)", "S": r"(6[01]|[0-5]?\d)", "y": r"(\d{1,2})", "j": r"(36[0-6]|3[0-5]\d|[0-2]?\d{1,2})"}
_WHOLE = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y"}


@register("parsetime", 1, 2)
def _parsetime(settings: Settings, v: Val, pattern: Val | None = None) -> Val:
    """Seconds of the date and time that a text begins with; parts that the pattern lacks are as in an empty C date (day 0 of January 1900)."""
    wanted = "%FT%TZ" if pattern is None else pattern.literal
    if not isinstance(wanted, str):
        raise QueryError("parsetime needs a literal format")
    for code, parts in _WHOLE.items():
        wanted = wanted.replace("%" + code, parts)
    regex, codes = "^", []
    for code, text in re.findall(r"%(.)|([^%]+|%$)", wanted, re.DOTALL):
        if text:
            regex += "".join(r"\s*" if c.isspace() else re.escape(c) for c in text)
        elif code == "%":
            regex += "%"
        elif code in "nt":
            regex += r"\s*"
        elif code in _PARTS:
            regex += r"\s*" + _PARTS[code]
            codes.append(code)
        else:
            raise QueryError(f"parsetime does not read %{code}")
    text = as_text(v)
    got = {c: F.regexp_extract(text, regex, i + 1).try_cast("int") for i, c in enumerate(codes)}
    zero = F.lit(0)
    short = got.get("y")
    year = got.get("Y", F.when(short < 69, short + 2000).otherwise(short + 1900) if short is not None else F.lit(1900))
    day = got.get("d", got.get("e", zero))
    start = F.unix_date(F.make_date(year, got.get("m", F.lit(1)), F.lit(1)))
    days = start + day - 1 if "j" not in got or "m" in got else F.unix_date(F.make_date(year, F.lit(1), F.lit(1))) + got["j"] - 1
    seconds = days.cast("double") * 86400.0 + got.get("H", zero) * 3600.0 + got.get("M", zero) * 60.0 + got.get("S", zero)
    failed = F.lit(None).cast("double") if settings.since(1, 2, 1) else F.lit(_FAILED_PARSE)
    return Val(F.when(text.rlike(regex), seconds).when(text.isNotNull(), failed), NUM)
