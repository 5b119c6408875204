"""A search and aggregation engine over DataFrames: typed indexes, a filter language, nearest neighbours, and aggregation pipelines."""

from quern.engine import Engine, Index
from quern.operators.aggregate import Apply, Filter, GroupBy, Limit, Load, Reduce, SortBy
from quern.operators.search import SearchOptions
from quern.plans.schema import KEY, NUMERIC, TAG, TEXT, VECTOR, Field, IndexSchema, QueryError, Settings

__all__ = ["KEY", "NUMERIC", "TAG", "TEXT", "VECTOR", "Apply", "Engine", "Field", "Filter", "GroupBy", "Index", "IndexSchema", "Limit", "Load", "QueryError", "Reduce", "SearchOptions", "Settings", "SortBy"]
