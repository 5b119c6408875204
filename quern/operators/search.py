"""The search command: filter, nearest neighbours, projection, sort and page."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.filtering import FilterCompiler
from quern.operators.knn import nearest, query_vector
from quern.plans.filters import FilterParser, MatchAll, parse_knn, split_query
from quern.plans.schema import KEY, NUMERIC, VECTOR, IndexSchema, QueryError, Settings
from quern.sources.prepare import DOCUMENT, prepare, raw_value


@dataclass(frozen=True)
class SearchOptions:
    """returns: (field, name) pairs, or None for all content; limit: (offset, number), or None for all rows,
    which then are in no order unless one is asked for; timeout: milliseconds that Engine.rows() waits (0: for ever).
    """

    returns: tuple[tuple[str, str], ...] | None = None
    nocontent: bool = False
    sortby: tuple[str, bool] | None = None
    with_sort_keys: bool = False
    limit: tuple[int, int] | None = (0, 10)
    verbatim: bool = False
    inorder: bool = False
    slop: int | None = None
    params: dict = field(default_factory=dict)
    timeout: int = 50_000


@dataclass(frozen=True)
class Hits:
    """Rows that match, prepared columns and all; score: the distance's column; order: the rows' own order."""

    rows: DataFrame
    score: str | None
    order: tuple[Column, ...]
    k: int | None = None


def check_params(params: dict, used: set[str]) -> None:
    if unused := set(params) - used:
        raise QueryError(f"unused parameters: {', '.join(sorted(unused))}")


def find(source: DataFrame, schema: IndexSchema, query: str, settings: Settings, options: SearchOptions, key: str = KEY, used: set[str] | None = None) -> Hits:
    """What matches query; used gets the names of the parameters that it takes."""
    used = set() if used is None else used
    text, neighbours = split_query(query)
    if neighbours is not None and not text.strip():
        raise QueryError("a filter or * must stand before =>")
    node = FilterParser(text, schema, settings, options.verbatim, options.slop, options.inorder).parse()
    rows = prepare(source, schema, settings, key)
    if not isinstance(node, MatchAll):
        compiler = FilterCompiler(schema, settings, rows)
        matches, hint = compiler.column(node), compiler.hint(node)
        rows = compiler.rows.where(matches if hint is None else hint & matches)
    if neighbours is None:
        return Hits(rows, None, (F.col(KEY),))
    knn = parse_knn(neighbours, schema, options.params, used)
    if knn.vector not in options.params:
        raise QueryError(f"parameter ${knn.vector} is missing")
    column = schema.field(knn.field)
    vector = query_vector(options.params[knn.vector], column.dim)
    return Hits(nearest(rows, column, vector, knn.k, settings, knn.score), knn.score, (F.col(f"`{knn.score}`"), F.col(KEY)), knn.k)


def _content(source: DataFrame, key: str) -> list[str]:
    return [c for c in source.columns if c not in (key, KEY)]


def search(source: DataFrame, schema: IndexSchema, query: str, settings: Settings, options: SearchOptions, key: str = KEY) -> DataFrame:
    """Rows (__key, distance, fields ...) of the page asked for, in order."""
    used: set[str] = set()
    hits = find(source, schema, query, settings, options, key, used)
    check_params(options.params, used)
    rows, order = hits.rows, list(hits.order)
    sort_key = None
    if options.sortby:
        name, ascending = options.sortby
        if hits.score == name:
            if not ascending:
                raise QueryError("a distance is sorted in ascending order only")
            sort_key = F.col(f"`{name}`")
        else:
            sort_key = sort_column(rows, schema, name)
        order = [sort_key.asc_nulls_last() if ascending else sort_key.desc_nulls_last(), F.col(KEY)]
    columns = [F.col(KEY)]
    if options.with_sort_keys and sort_key is not None:
        columns.append(F.concat(F.lit("#"), sort_key.cast("string")).alias("__sortkey"))
    if not options.nocontent and options.returns != ():
        columns += _fields(source, rows, schema, hits, options, key)
    if options.limit is None:
        return (rows if sort_key is None else rows.orderBy(*order)).select(*columns)
    offset, number = options.limit
    if hits.k is not None and offset >= hits.k:
        number = 0
    page = rows.orderBy(*order)
    if offset:
        page = page.offset(offset)
    return page.limit(number).select(*columns)


def sort_column(rows: DataFrame, schema: IndexSchema, name: str) -> Column:
    """What SORTBY compares: the number of a numeric field (0 where it is no number), else the text; null where there is none."""
    f = schema.field(name) or next((x for x in schema.fields if x.identifier == name), None)
    if f is None:
        if name not in rows.columns:
            raise QueryError(f"no field {name!r} to sort by")
        return F.col(f"`{name}`").cast("string")
    if f.kind == VECTOR:
        raise QueryError("a vector cannot be sorted by")
    value, _ = raw_value(rows, schema, f)
    if f.kind == NUMERIC:
        return F.when(value.isNotNull(), F.coalesce(F.col(f"`{f.column}`"), F.lit(0.0)))
    return value.cast("string")


def _fields(source: DataFrame, rows: DataFrame, schema: IndexSchema, hits: Hits, options: SearchOptions, key: str) -> list[Column]:
    if options.returns is None:
        score = [F.col(f"`{hits.score}`")] if hits.score else []
        content = [DOCUMENT] if schema.on == "JSON" and DOCUMENT in source.columns else _content(source, key)
        return score + [F.col(f"`{c}`") for c in content if c != hits.score]
    out = []
    for name, alias in options.returns:
        f = schema.field(name) or next((x for x in schema.fields if x.identifier == name), None)
        if name in (hits.score, KEY):
            out.append(F.col(f"`{name}`").alias(alias))
        elif f is not None:
            out.append(raw_value(rows, schema, f)[0].alias(alias))
        elif schema.on == "JSON" and name.startswith(DOCUMENT):
            out.append(F.get_json_object(F.col(f"`{DOCUMENT}`"), name).alias(alias))
        elif name in rows.columns:
            out.append(F.col(f"`{name}`").alias(alias))  # a field that no document has is left out
    return out


def total(source: DataFrame, schema: IndexSchema, query: str, settings: Settings, options: SearchOptions, key: str = KEY) -> int:
    """How many rows match (of nearest neighbours: at most k), whatever the page."""
    return find(source, schema, query, settings, options, key).rows.count()
