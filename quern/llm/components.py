"""Connected components of a graph that no one machine need hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import drop_path, few_files, scratch_path


def _written(df: DataFrame, rows: int) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "links")
    few_files(df, rows).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _with_least(edges: DataFrame) -> DataFrame:
    """(hi, lo, least): each link with the least of `hi` and all that its links reach.

    The joined side has one row for each node, so that the other can be split where a node has very many links.
    """
    least = edges.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("least"))
    return edges.join(least, "hi")


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: each upper node has one link, and no lower node is an upper one."""
    if not edges.groupBy("hi").count().where("count > 1").isEmpty():
        return False
    return edges.select("lo").distinct().join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi").isEmpty()


def connected_components(links: DataFrame, rows: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected graph of bigint links; root is its component's least node.

    Alternating large-star and small-star steps: each round writes its links, `rows` of them at
    most or so, to the shared folder, until they are stars: the rounds grow with the logarithm of the
    nodes (squared, at the very worst), and always come to an end. Nulls and loops link nothing; no links give no rows.
    """
    spark = links.sparkSession
    pairs = links.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, path = _written(pairs, rows)
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        # large star: what lies above a node joins the least node near it
        large = _with_least(both).where("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        # small star: what lies below a node, and the node, join the least of them
        near = _with_least(large)
        small = near.select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")), F.struct("hi", F.col("least").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        new, new_path = _written(small, rows)
        drop_path(spark, path)
        edges, path = new, new_path
        if _settled(edges):
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
