"""Jump consistent hashing of documents to shards, in Spark SQL expressions only.

The law is `key`: a row's shard depends on its id and the number of shards alone, and one
more shard takes rows into itself only. No ring table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialize

#: The multiplier of the 64-bit generator of jump consistent hashing, in 32-bit halves.
MULTIPLIER = 2862933555777941757
LOW32 = (1 << 32) - 1
#: Numbering blocks of a shard; each is numbered in a task of its own.
BLOCKS = 1024


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULTIPLIER + 1 modulo 2^64, in products below 2^48 as ANSI arithmetic raises on overflow."""
    m_hi, m_lo = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & LOW32)

    def low_product(x: Column, y: Column) -> Column:
        upper = F.shiftrightunsigned(x, 16) * y
        return (x.bitwiseAND(0xFFFF) * y + F.shiftleft(upper.bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW32)

    first = lo.bitwiseAND(0xFFFF) * m_lo + F.lit(1)
    second = F.shiftrightunsigned(lo, 16) * m_lo
    sum_low = first + F.shiftleft(second.bitwiseAND(0xFFFF), 16)
    carry = F.shiftrightunsigned(sum_low, 32) + F.shiftrightunsigned(second, 16)
    new_hi = (carry + low_product(hi, m_lo) + low_product(lo, m_hi)).bitwiseAND(LOW32)
    return new_hi, sum_low.bitwiseAND(LOW32)


def jump_shards(key: Column, *counts: int) -> list[Column]:
    """The shard of a bigint key for each shard count; one walk serves them all, as they share its jumps."""
    hi, lo = F.shiftrightunsigned(key, 32), key.bitwiseAND(LOW32)
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("bigint").alias("jump"), *(F.lit(0).cast("bigint").alias(f"b{n}") for n in counts))

    def step(state: Column, _: Column) -> Column:
        new_hi, new_lo = _next_state(state["hi"], state["lo"])
        jump = F.floor((state["jump"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(new_hi, 1) + 1).cast("double")))
        landed = (F.when(state["jump"] < n, state["jump"]).otherwise(state[f"b{n}"]).alias(f"b{n}") for n in counts)
        return F.struct(new_hi.alias("hi"), new_lo.alias("lo"), jump.alias("jump"), *landed)

    # each jump moves on by one at least, so that after max(counts) of them the last landing below each count is known
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(max(counts))), start, step)
    return [walk[f"b{n}"].cast("int") for n in counts]


def narrow_rows(docs: DataFrame, n_shards: int, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """Ids, sizes, checksums, shards and numbering blocks: all that is needed of the documents, in one pass without a shuffle."""
    text, key = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint"))
    shard, grown = jump_shards(F.col("__key"), n_shards, n_shards + 1)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        key.alias("__key"),
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("__block"),
    ).select("*", shard.alias("shard"), grown.alias("grown_shard"))


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """Shard, grown shard (with one shard more) and a gapless slot within the shard for every row.

    Slots: the narrow rows are dealt to `blocks` by a hash of id and place in the table (so that rows that are alike
    part, however many there are) and written once to the shared folder, at once; a table of at most n_shards * blocks
    counts (broadcast: its size is bounded by the parameters) gives each block its first slot, and each block is
    numbered by id. No task sees a whole shard, and documents are read once.

    A null id is the key 0; a null or empty text has the size 1; a very long one is hashed whole; repeated rows get
    slots of their own; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = materialize(narrow_rows(docs, n_shards, id_col, text_col, blocks), "shards")
    sizes = rows.groupBy("shard", "__block").agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.selectExpr("shard", "__block", "sum(__n) OVER (PARTITION BY shard ORDER BY __block) - __n AS __first")
    numbered = rows.selectExpr("*", "row_number() OVER (PARTITION BY shard, __block ORDER BY __key, text_crc32, size) - 1 AS __at")
    return numbered.join(F.broadcast(first), ["shard", "__block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__at")).cast("bigint").alias("slot"), "grown_shard"
    )
