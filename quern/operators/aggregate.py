"""The aggregate command: a search, then stages that each map a table to a table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.reducers import first_value_descending, reducer
from quern.functions.scalars import call
from quern.functions.values import ARITHMETIC, ARR, BOOL, COMPARISONS, NUM, STR, Val, arithmetic, as_number, order_of, truthy
from quern.operators.search import SearchOptions, check_params, find
from quern.plans.expressions import Binary, Call, Expr, Invert, Number, Ref, Text, parse_expression
from quern.plans.schema import KEY, NUMERIC, VECTOR, IndexSchema, QueryError, Settings
from quern.sources.prepare import raw_value


@dataclass(frozen=True)
class Load:
    """fields; None is LOAD *."""

    fields: tuple[str, ...] | None


@dataclass(frozen=True)
class Apply:
    expr: str
    name: str


@dataclass(frozen=True)
class Filter:
    expr: str


@dataclass(frozen=True)
class Limit:
    offset: int
    number: int


@dataclass(frozen=True)
class SortBy:
    """(expression, ascending) pairs; most: rows that stay, None for the default."""

    keys: tuple[tuple[str, bool], ...]
    most: int | None = None


@dataclass(frozen=True)
class Reduce:
    """args: expressions; for FIRST_VALUE also (by, ascending)."""

    function: str
    args: tuple[str, ...] = ()
    name: str | None = None
    by: tuple[str, bool] | None = None
    ascending_given: bool = False


@dataclass(frozen=True)
class GroupBy:
    fields: tuple[str, ...]
    reducers: tuple[Reduce, ...] = ()


Stage = Load | Apply | Filter | Limit | SortBy | GroupBy


@dataclass(frozen=True)
class Records:
    """A table between two stages: what each name holds, which names are shown, and the rows' order."""

    rows: DataFrame
    names: dict[str, Val]
    shown: tuple[str, ...]
    order: tuple[Column, ...]
    settings: Settings
    params: dict = field(default_factory=dict)
    used: set = field(default_factory=set)
    unloaded: frozenset = frozenset()

    def value(self, text: str) -> Val:
        return self._value(parse_expression(text, self.params, self.settings.query_depth, self.used))

    def ref(self, name: str) -> Val:
        if name not in self.names:
            raise QueryError(f"unknown field @{name}")
        v = self.names[name]
        return Val(F.lit(None).cast("string"), v.kind) if name in self.unloaded else v

    def _value(self, e: Expr) -> Val:
        if isinstance(e, Number):
            return Val(F.lit(e.value), NUM, literal=e.value)
        if isinstance(e, Text):
            return Val(F.lit(e.value), STR, literal=e.value)
        if isinstance(e, Ref):
            return self.ref(e.name)
        if isinstance(e, Invert):
            return Val(~truthy(self._value(e.arg), self.settings), BOOL)
        if isinstance(e, Call):
            return call(e.name, [self._value(a) for a in e.args], self.settings)
        assert isinstance(e, Binary)
        left, right = self._value(e.left), self._value(e.right)
        if e.op in ARITHMETIC:
            return arithmetic(e.op, left, right)
        if e.op in COMPARISONS:
            return Val(COMPARISONS[e.op](order_of(left, right)), BOOL)
        a, b = truthy(left, self.settings), truthy(right, self.settings)
        return Val(a & b if e.op == "&&" else a | b, BOOL)

    def ordered(self) -> DataFrame:
        return self.rows.orderBy(*self.order)

    def result(self) -> DataFrame:
        shown = self.shown or ((KEY,) if KEY in self.names else ())
        return self.rows.select(*(self.names[n].col.alias(n) for n in shown))


def start(source: DataFrame, schema: IndexSchema, query: str, settings: Settings, options: SearchOptions, key: str = KEY, loads: Load | None = None) -> Records:
    """The search's hits as records. Every schema field can be read, a vector excepted; with strict_load those alone that LOAD names."""
    used: set[str] = set()
    hits = find(source, schema, query, settings, options, key, used)
    names = {KEY: Val(F.col(KEY), STR)}
    columns = [F.col(KEY)]

    def add(name: str, column: Column, kind: str) -> None:
        columns.append(column.alias(f"f:{name}"))
        names[name] = Val(F.col(f"`f:{name}`"), kind)

    for f in schema.fields:
        if f.kind == NUMERIC:
            add(f.alias, F.col(f"`{f.column}`"), NUM)
        elif f.kind != VECTOR:
            add(f.alias, raw_value(hits.rows, schema, f)[0].cast("string"), STR)
    if hits.score:
        add(hits.score, F.col(f"`{hits.score}`"), NUM)
    shown: tuple[str, ...] = ()
    if loads is not None and loads.fields is None:
        own = [c for c in source.columns if c not in (key, KEY) and c not in names and not dict(source.dtypes)[c].startswith(("array", "map", "struct", "binary"))]
        for c in own:
            add(c, F.col(f"`{c}`").cast("string"), STR)
        shown = tuple(n for n in names if n != KEY)
    elif loads is not None:
        for name in loads.fields:
            f = schema.field(name) or next((x for x in schema.fields if x.identifier == name), None)
            if f is not None and f.kind == VECTOR:
                raise QueryError(f"vector field {name} cannot be loaded")
            if f is not None and name not in names:
                names[name] = names[f.alias]
            if name not in names:
                raise QueryError(f"unknown field {name} in LOAD")
        shown = loads.fields
    unloaded = frozenset(f.alias for f in schema.fields if f.alias not in shown) if settings.strict_load else frozenset()
    order = (F.col(f"`f:{hits.score}`"), F.col(KEY)) if hits.score else (F.col(KEY),)
    return Records(hits.rows.select(*columns), names, shown, order, settings, options.params, used, unloaded)


def apply(r: Records, stage: Stage) -> Records:
    if isinstance(stage, Load):
        return r
    if isinstance(stage, Apply):
        v, at = r.value(stage.expr), f"v:{stage.name}:{len(r.rows.columns)}"
        held = Val(F.col(f"`{at}`"), v.kind, v.item)
        shown = r.shown if stage.name in r.shown else (*r.shown, stage.name)
        return replace(r, rows=r.rows.withColumn(at, v.col), names=r.names | {stage.name: held}, shown=shown, unloaded=r.unloaded - {stage.name})
    if isinstance(stage, Filter):
        return replace(r, rows=r.rows.where(truthy(r.value(stage.expr), r.settings)))
    if isinstance(stage, Limit):
        rows = r.ordered()
        if stage.offset:
            rows = rows.offset(stage.offset)
        return replace(r, rows=rows.limit(stage.number))
    if isinstance(stage, SortBy):
        return _sort(r, stage)
    return _group(r, stage)


def _sort(r: Records, stage: SortBy) -> Records:
    keys = []
    for text, ascending in stage.keys:
        v = r.value(text)
        # what compares with nothing (Nil, NaN) comes last, in the order that it had
        c = F.when(~F.isnan(v.col), v.col) if v.kind == NUM else v.col
        keys.append(c.asc_nulls_last() if ascending else c.desc_nulls_last())
    r = replace(r, order=(*keys, *r.order))
    return replace(r, rows=r.ordered().limit(r.settings.sort_max if stage.most is None else stage.most))


def _group(r: Records, stage: GroupBy) -> Records:
    if not stage.fields:
        raise QueryError("GROUPBY needs a field")
    groups = {name: r.ref(name) for name in stage.fields}
    keys = [v.col.alias(f"g:{name}") for name, v in groups.items()]
    names = {name: Val(F.col(f"`g:{name}`"), v.kind, v.item) for name, v in groups.items()}
    rows_order = F.struct(*(F.struct(c.isNull().alias("n"), c.alias("c")) for c in _plain(r)))
    built: list[Column] = []
    ranked: dict[str, tuple[Val, list[Column]]] = {}
    for n, red in enumerate(stage.reducers):
        values = [r.value(a) for a in red.args]
        if red.by is None and reducer(red.function, len(values)).ranked:
            number = Val(F.col("number"), NUM)
            v = reducer(red.function, len(values)).build([number, *values[1:]], F.col("rank"))
            ranked.setdefault(red.args[0], (values[0], []))[1].append(v.col.alias(f"r:{n}"))
            names[red.name or default_name(red, r.settings)] = Val(F.col(f"`r:{n}`"), v.kind, v.item)
            continue
        if red.by is not None:
            by = r.value(red.by[0])
            v = reducer(red.function, 3).build([*values, by], rows_order) if red.by[1] else first_value_descending(values[0], by, rows_order)
        else:
            v = reducer(red.function, len(values)).build(values, rows_order)
        name = red.name or default_name(red, r.settings)
        built.append(v.col.alias(f"r:{n}"))
        names[name] = Val(F.col(f"`r:{n}`"), v.kind, v.item)
    tables = [_ranks(r.rows, keys, v).groupBy(*(F.col(f"`g:{g}`") for g in groups)).agg(*of) for v, of in ranked.values()]
    if built or not tables:
        tables.insert(0, r.rows.groupBy(*keys).agg(*built) if built else r.rows.select(*keys).distinct())
    rows = tables[0]
    for more in tables[1:]:
        rows = _beside(rows, more, tuple(groups))
    order = tuple(F.col(f"`g:{name}`").asc_nulls_last() for name in groups)
    return Records(rows, names, tuple(names), order, r.settings, r.params, r.used)


def _ranks(rows: DataFrame, keys: list[Column], v: Val) -> DataFrame:
    """Each group's distinct numbers, with the rows up to each and all that have one; Nil stands first, for groups without numbers.
    Rows are counted by number before a group comes together, and sorted with spills, so that no task holds a group in memory."""
    counted = rows.select(*keys, as_number(v).alias("number"))
    groups = [F.col(f"`{c}`") for c in counted.columns[:-1]]
    counted = counted.groupBy(*groups, "number").agg(F.count("number").alias("n"))
    group = Window.partitionBy(*groups)
    upto = F.sum("n").over(group.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counted.select(*groups, "number", F.struct(upto.alias("upto"), F.sum("n").over(group).alias("all")).alias("rank"))


def _beside(rows: DataFrame, more: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Two tables of the same groups as one; Nil is a group too."""
    more = more.withColumnsRenamed({f"g:{g}": f"j:{g}" for g in groups})
    same = [F.col(f"`g:{g}`").eqNullSafe(F.col(f"`j:{g}`")) for g in groups]
    return rows.join(more, same).drop(*(f"j:{g}" for g in groups))


def _plain(r: Records) -> list[Column]:
    """The rows' order as plain columns, for what compares rows within a group."""
    return [r.names[KEY].col] if KEY in r.names else [v.col for v in r.names.values() if v.kind != ARR]


def default_name(red: Reduce, settings: Settings) -> str:
    """How a reducer without AS is named."""
    args = list(red.args)
    if red.by is not None:
        args.append(red.by[0])
        if red.ascending_given:
            args.append("ASC" if red.by[1] else "DESC")
        return f"{red.function.upper()}({','.join(args)})"
    if settings.since(1, 3, 0):
        return ("__generated_alias" + red.function + ",".join(a.removeprefix("@") for a in args)).lower()
    return f"{red.function.upper()}({','.join(args)})"


def aggregate(source: DataFrame, schema: IndexSchema, query: str, settings: Settings, options: SearchOptions, stages: tuple[Stage, ...], key: str = KEY) -> DataFrame:
    loads = [s for s in stages if isinstance(s, Load)]
    load = None
    if loads:
        load = Load(None) if any(s.fields is None for s in loads) else Load(tuple(f for s in loads for f in s.fields))
    r = start(source, schema, query, settings, options, key, load)
    for stage in stages:
        r = apply(r, stage)
    check_params(options.params, r.used)
    # the rows of a sorted table keep their order only if nothing follows; a last sort is cheap after a limit
    return r.result() if not isinstance(stages[-1] if stages else None, (SortBy, Limit)) else replace(r, rows=r.ordered()).result()
