"""Snapshots of indexes: documents as Parquet, the definition beside them, both through Spark's own writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quern.plans.schema import IndexSchema


def save_snapshot(source: DataFrame, schema: IndexSchema, key: str, path: str) -> None:
    source.write.mode("overwrite").parquet(f"{path}/documents")
    row = (json.dumps({"schema": schema.to_json(), "key": key}),)
    source.sparkSession.createDataFrame([row], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/definition")


def load_snapshot(spark: SparkSession, path: str) -> tuple[IndexSchema, DataFrame, str]:
    raw = json.loads(spark.read.text(f"{path}/definition").first()[0])
    return IndexSchema.from_json(raw["schema"]), spark.read.parquet(f"{path}/documents"), raw["key"]
