"""Tables as keyed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.schema import KEY


def keyed(df: DataFrame, prefix: str, *columns: str, separator: str = ":") -> DataFrame:
    """df with a document key: the prefix and the given columns."""
    parts: list[Column] = [F.col(c).cast("string") for c in columns]
    return df.withColumn(KEY, F.concat(F.lit(prefix), F.concat_ws(separator, *parts)))


def read_parquet(spark: SparkSession, path: str, prefix: str, *columns: str) -> DataFrame:
    return keyed(spark.read.parquet(path), prefix, *columns)


def unexpired(df: DataFrame, column: str = "expire_at") -> DataFrame:
    """df without the documents whose time (seconds, a null is never) has passed."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.unix_timestamp()))
