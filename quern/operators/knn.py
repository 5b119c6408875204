"""Nearest neighbours of one vector: exact distances in built-in functions, top k by a partial sort."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.schema import KEY, Field, QueryError, Settings

#: Up to this width the sums are written out, so that they are compiled; beyond it they are folded.
UNROLL = 256


def query_vector(value: bytes | str | Sequence[float], dim: int) -> list[float]:
    """A query vector from a blob of little-endian floats, a bracketed list or numbers; rounded to 32 bits."""
    if isinstance(value, bytes):
        if len(value) != 4 * dim:
            raise QueryError(f"the query vector has {len(value)} bytes, not {4 * dim}")
        return list(struct.unpack(f"<{dim}f", value))
    numbers = [float(x) for x in value.strip().strip("[]").split(",")] if isinstance(value, str) else [float(x) for x in value]
    if len(numbers) != dim:
        raise QueryError(f"the query vector has {len(numbers)} components, not {dim}")
    return [struct.unpack("<f", struct.pack("<f", x))[0] for x in numbers]


def _summed(vector: Column, query: list[float], term) -> Column:
    if len(query) <= UNROLL:
        return reduce(add, (term(F.get(vector, i).cast("double"), F.lit(q)) for i, q in enumerate(query)))
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, query)), lambda x, q: term(x.cast("double"), q)), F.lit(0.0), lambda a, x: a + x)


def distance(vector: Column, query: list[float], metric: str, l2_sqrt: bool = False) -> Column:
    """L2: the sum of squared differences (or its root); IP: 1 - dot product; COSINE: 1 - cosine, 1 for a zero vector."""
    if metric == "L2":
        squared = _summed(vector, query, lambda x, q: (x - q) * (x - q))
        return F.sqrt(squared) if l2_sqrt else squared
    dot = _summed(vector, query, lambda x, q: x * q)
    if metric == "IP":
        return 1.0 - dot
    own = _summed(vector, query, lambda x, q: x * x)
    size = sum(q * q for q in query) ** 0.5
    norms = F.sqrt(own) * F.lit(size)
    return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - F.try_divide(dot, norms))


def nearest(rows: DataFrame, field: Field, query: list[float], k: int, settings: Settings, score: str) -> DataFrame:
    """The k rows nearest to query (ties by key) with their distance as `score`; rows without the vector take no part."""
    if not 1 <= k <= settings.max_knn:
        raise QueryError(f"k must be between 1 and {settings.max_knn}")
    vector = F.col(f"`{field.column}`")
    return rows.where(vector.isNotNull()).withColumn(score, distance(vector, query, field.metric, settings.l2_sqrt)).orderBy(F.col(f"`{score}`").asc(), KEY).limit(k)
