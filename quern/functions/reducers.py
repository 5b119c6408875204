"""Reducers by name: each builds an aggregate column; users may register their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.values import ARR, BOOL, NUM, Val, as_number
from quern.plans.schema import QueryError

#: (arguments, the rows' order) -> value
Builder = Callable[[list[Val], Column], Val]


@dataclass(frozen=True)
class Reducer:
    """A ranked reducer is built over a row for each distinct number of its first argument; its order is a struct of the
    group's rows `upto` that number and of `all` that have one."""

    least: int
    most: int
    build: Builder
    ranked: bool = False


def _count(args: list[Val], order: Column) -> Val:
    return Val(F.count(F.lit(1)).cast("double"), NUM)


def _count_distinct(args: list[Val], order: Column) -> Val:
    return Val(F.count_distinct(args[0].col).cast("double"), NUM)


def _sum(args: list[Val], order: Column) -> Val:
    return Val(F.coalesce(F.sum(as_number(args[0])), F.lit(0.0)), NUM)


def _avg(args: list[Val], order: Column) -> Val:
    return Val(F.coalesce(F.avg(as_number(args[0])), F.lit(0.0)), NUM)


def _stddev(args: list[Val], order: Column) -> Val:
    x = as_number(args[0])
    return Val(F.when(F.count(x) > 1, F.stddev_samp(x)).otherwise(F.lit(0.0)), NUM)


def _extreme(f: Callable[[Column], Column]) -> Builder:
    return lambda args, order: Val(f(args[0].col), args[0].kind, args[0].item)


def _to_list(args: list[Val], order: Column) -> Val:
    """Distinct values in ascending order, Nil left out; arrays are taken apart once."""
    v = args[0]
    if v.kind == ARR:
        return Val(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(v.col)), lambda x: x.isNotNull()))), ARR, v.item)
    return Val(F.array_sort(F.collect_set(v.col)), ARR, v.kind)


def _first_value(args: list[Val], order: Column) -> Val:
    """The first row's value, Nil too; with a second argument that of the row with the least."""
    value = F.struct(args[0].col.alias("v"))
    if len(args) == 1:
        return Val(F.min_by(value, order)["v"], args[0].kind, args[0].item)
    by = args[1].col
    return Val(F.min_by(value, F.when(by.isNotNull(), F.struct(by.alias("b"), order.alias("o"))))["v"], args[0].kind, args[0].item)


def first_value_descending(value: Val, by: Val, order: Column) -> Val:
    """The value of the row with the greatest `by`, the first of equal ones: those of the greatest are ordered by a second, nested minimum."""
    # rows of a group are compared through one struct: the greatest `by`, then the least order; a negated number keeps one pass
    if by.kind in (NUM, BOOL):
        key = -as_number(by)
        return Val(F.min_by(F.struct(value.col.alias("v")), F.when(key.isNotNull(), F.struct(key.alias("b"), order.alias("o"))))["v"], value.kind, value.item)
    # texts have no negative: the bytes' complement in hexadecimal, closed by a character above its digits, orders them downwards
    mirrored = F.concat(F.translate(F.hex(by.col.cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
    return Val(F.min_by(F.struct(value.col.alias("v")), F.when(by.col.isNotNull(), F.struct(mirrored.alias("b"), order.alias("o"))))["v"], value.kind, value.item)


def _quantile(args: list[Val], rank: Column) -> Val:
    """The least number that has the share of the group's numbers up to it; in decimals, as a product of doubles can pass a whole rank."""
    try:
        share = float(args[1].literal)
    except (TypeError, ValueError):
        raise QueryError("QUANTILE needs a literal share") from None
    if not 0 <= share <= 1:
        raise QueryError("QUANTILE needs a share from 0 to 1")
    least = rank["all"].cast("decimal(19,0)") * F.lit(Decimal(repr(share)).quantize(Decimal("1e-17")))
    return Val(F.min(F.when(rank["upto"] >= least, as_number(args[0]))), NUM)


REDUCERS: dict[str, Reducer] = {
    "COUNT": Reducer(0, 0, _count),
    "COUNT_DISTINCT": Reducer(1, 1, _count_distinct),
    "SUM": Reducer(1, 1, _sum),
    "AVG": Reducer(1, 1, _avg),
    "MIN": Reducer(1, 1, _extreme(F.min)),
    "MAX": Reducer(1, 1, _extreme(F.max)),
    "STDDEV": Reducer(1, 1, _stddev),
    "TOLIST": Reducer(1, 1, _to_list),
    "FIRST_VALUE": Reducer(1, 4, _first_value),
    # beyond what is asked for; exact, though an estimate would do by the first one's name
    "COUNT_DISTINCTISH": Reducer(1, 1, _count_distinct),
    "QUANTILE": Reducer(2, 2, _quantile, ranked=True),
}


def reducer(name: str, n_args: int) -> Reducer:
    found = REDUCERS.get(name.upper())
    if found is None:
        raise QueryError(f"unknown reducer {name!r}")
    if not found.least <= n_args <= found.most:
        raise QueryError(f"{name} does not take {n_args} arguments")
    return found


__all__ = ["REDUCERS", "Reducer", "first_value_descending", "reducer"]
