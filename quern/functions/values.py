"""Typed values of expressions: a column and what it holds, and how the kinds turn into each other.

Nil is SQL's null. A kind is known when the query is compiled; no value is dispatched on per row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.plans.schema import Settings

NUM, STR, BOOL, ARR = "num", "str", "bool", "arr"
#: Text that a number is read from whole: as C's strtod reads it, but for hexadecimal forms.
STRTOD = r"^[ \t\n\x0b\f\r]*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)$"


@dataclass(frozen=True)
class Val:
    """A column of a kind; item is the kind of an array's elements."""

    col: Column
    kind: str
    item: str = STR
    literal: str | float | None = None


def nil(kind: str = NUM) -> Val:
    return Val(F.lit(None).cast({NUM: "double", STR: "string", BOOL: "boolean", ARR: "array<string>"}[kind]), kind)


def as_number(v: Val) -> Column:
    """A double, or null: also for text that is no number or NaN; empty text is 0."""
    if v.kind == NUM:
        return v.col
    if v.kind == BOOL:
        return v.col.cast("double")
    if v.kind == STR:
        return F.when(v.col == "", F.lit(0.0)).when(v.col.rlike(STRTOD), F.trim(v.col).try_cast("double"))
    return F.lit(None).cast("double")


def as_text(v: Val) -> Column:
    if v.kind == STR:
        return v.col
    if v.kind == BOOL:
        return F.when(v.col, F.lit("1")).when(~v.col, F.lit("0"))
    if v.kind == NUM:
        return number_text(v.col)
    return F.lit(None).cast("string")


def number_text(x: Column) -> Column:
    """The shortest text that reads back as x, in plain or scientific form, whichever is shorter (plain if equal)."""
    raw = F.abs(x).cast("string")
    mantissa, power = F.split_part(raw, F.lit("E"), F.lit(1)), F.split_part(raw, F.lit("E"), F.lit(2))
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    run = F.concat(whole, part)
    bare = F.regexp_replace(run, "^0+", "")
    digits = F.regexp_replace(bare, "0+$", "")
    exponent = F.length(whole) - 1 - (F.length(run) - F.length(bare)) + F.when(power == "", F.lit(0)).otherwise(power.try_cast("int"))
    n = F.length(digits)
    plain = (
        F.when(exponent >= n - 1, F.rpad(digits, exponent + 1, F.lit("0")))
        .when(exponent >= 0, F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
    )
    size = F.abs(exponent).cast("string")
    scientific = F.concat(
        F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size),
    )
    sign = F.when((x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-"))), F.lit("-")).otherwise(F.lit(""))
    shorter = F.when(F.length(scientific) < F.length(plain), scientific).otherwise(plain)
    text = F.when(F.isnan(x), F.lit("nan")).when(F.abs(x) == float("inf"), F.concat(sign, F.lit("inf"))).when(x == 0, F.concat(sign, F.lit("0"))).otherwise(F.concat(sign, shorter))
    return F.when(x.isNotNull(), text)


def truthy(v: Val, settings: Settings) -> Column:
    if v.kind == BOOL:
        test = v.col
    elif v.kind == NUM:
        test = F.isnan(v.col) | (v.col != 0)
    elif v.kind == STR:
        test = v.col != "" if settings.since(1, 2, 1) else F.lit(False)
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


def order_of(a: Val, b: Val) -> Column:
    """-1, 0 or 1; null where the two are not ordered (one is Nil or NaN, or one alone is an array). Nil equals Nil."""
    if ARR in (a.kind, b.kind):
        if a.kind != b.kind:
            found = F.lit(None).cast("int")
        else:
            same = a if a.item == b.item else Val(F.transform(a.col, lambda x: as_text(Val(x, a.item))), ARR)
            other = b if a.item == b.item else Val(F.transform(b.col, lambda x: as_text(Val(x, b.item))), ARR)
            found = F.when(same.col < other.col, -1).when(same.col > other.col, 1).when(same.col == other.col, 0)
    elif a.kind == STR and b.kind == STR:
        found = _ranked(a.col, b.col)
    elif STR in (a.kind, b.kind):
        x, y = as_number(a), as_number(b)
        found = F.when(x.isNotNull() & y.isNotNull(), _ranked_numbers(x, y)).otherwise(_ranked(as_text(a), as_text(b)))
    else:
        found = _ranked_numbers(as_number(a), as_number(b))
    return F.when(a.col.isNull() & b.col.isNull(), F.lit(0)).when(a.col.isNotNull() & b.col.isNotNull(), found)


def _ranked(x: Column, y: Column) -> Column:
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def _ranked_numbers(x: Column, y: Column) -> Column:
    return F.when(~F.isnan(x) & ~F.isnan(y), _ranked(x, y))


#: Whether each comparison holds, by the order; what is not ordered counts as equal for these, as unequal for none.
COMPARISONS: dict[str, Callable[[Column], Column]] = {
    "==": lambda o: F.coalesce(o == 0, F.lit(True)),
    "!=": lambda o: F.coalesce(o != 0, F.lit(False)),
    "<": lambda o: F.coalesce(o < 0, F.lit(False)),
    "<=": lambda o: F.coalesce(o <= 0, F.lit(True)),
    ">": lambda o: F.coalesce(o > 0, F.lit(False)),
    ">=": lambda o: F.coalesce(o >= 0, F.lit(True)),
}


def divide(x: Column, y: Column) -> Column:
    """x / y; NaN for any division by zero."""
    return F.when(y == 0, F.when(x.isNotNull(), F.lit(float("nan")))).otherwise(F.try_divide(x, y))


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda x, y: x + y,
    "-": lambda x, y: x - y,
    "*": lambda x, y: x * y,
    "/": divide,
    "^": F.pow,
}


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """Over numbers; an array with a number element by element, two arrays of one length likewise, else Nil."""
    f = ARITHMETIC[op]
    if a.kind == ARR and b.kind == ARR:
        both = F.zip_with(a.col, b.col, lambda x, y: f(as_number(Val(x, a.item)), as_number(Val(y, b.item))))
        return Val(F.when(F.size(a.col) == F.size(b.col), both), ARR, NUM)
    if a.kind == ARR:
        return Val(F.transform(a.col, lambda x: f(as_number(Val(x, a.item)), as_number(b))), ARR, NUM)
    if b.kind == ARR:
        return Val(F.transform(b.col, lambda y: f(as_number(a), as_number(Val(y, b.item)))), ARR, NUM)
    return Val(f(as_number(a), as_number(b)), NUM)


# -- arrays as values, for functions that users register


def is_array(v: Val) -> Val:
    return Val(F.lit(v.kind == ARR), BOOL)


def array_length(v: Val) -> Val:
    """How many elements an array has; Nil for what is none."""
    return Val(F.size(v.col).cast("double"), NUM) if v.kind == ARR else nil(NUM)


def array_element(v: Val, index: Val) -> Val:
    """The element at a place from 0 on; Nil where there is none, where the place is no whole number, and for what is no array."""
    if v.kind != ARR:
        return nil(STR)
    at = as_number(index)
    return Val(F.get(v.col, F.when((at >= 0) & (at == F.floor(at)) & (at < F.size(v.col)), at).cast("int")), v.item)


def flattened(v: Val, depth: Val) -> Val:
    """The array itself, as its elements are no arrays in turn; Nil for what is none or where the depth is no whole number."""
    if v.kind != ARR:
        return nil(ARR)
    levels = as_number(depth)
    return Val(F.when(levels == F.floor(levels), v.col), ARR, v.item)
