"""SimHash near-duplicate detection with pivot distance tables.

Two fingerprints within three bits agree in one of four blocks of bits, so each fingerprint
goes to four buckets, and every link lies in some bucket. Within a bucket a table of Hamming
distances to many reference fingerprints (pivots) is computed. In the order of the first
pivot's distances a fingerprint is paired with those alone that follow within the radius; a
pair whose distances to some other pivot differ by more is discarded (the triangle
inequality), and what is left is verified. A bucket with too many fingerprints is split into
smaller ones in the same way, by further bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import fresh, lookup_join, materialize
from quern.llm.components import connected_components

RADIUS, SHINGLE, SEED = 3, 3, 42
N_PIVOTS = 24
#: A bucket with more distinct fingerprints is split by further bits, unless its key leaves so few of them free.
BUCKET_ROWS, FREE_BITS = 1024, 8
#: (blocks that agree, blocks) of the free bits at each splitting, the last one ever after: with three differing bits one of four blocks agrees, and three of six do.
DEALS = ((1, 4), (1, 4), (3, 6))


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z alone change, ASCII white space alone splits
    if not words:
        return 0
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    elif width == 3:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b"%b %b %b" % x, seed) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[lo : lo + 65536], ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, columns: list[str], text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """The columns of docs, and the fingerprint of the whole text as a (signed) bigint."""
    rows = docs.select(*(f"`{c}`" for c in columns), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(columns))
            marks = np.array([fingerprint(texts[i].as_py()) for i in range(b.num_rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks.view(np.int64))], names=[*columns, out_col])

    return rows.mapInArrow(run, docs.select(*(f"`{c}`" for c in columns)).schema.add(out_col, T.LongType()))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_masks(mask: int, deal: tuple[int, int]) -> list[int]:
    """The masks that add some of the blocks of bits that `mask` leaves free, for every choice of so many blocks."""
    some, n = deal
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // n for i in range(n + 1)]
    blocks = [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return [mask | sum(c) for c in combinations(blocks, some)]


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(1, n + 1)], np.uint64)


def bucket_links(bucket: np.ndarray, marks: np.ndarray, radius: int, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the distinct fingerprints of each bucket; bucket holds numbers in ascending order.

    The links found within a bucket are replaced by those of its members to the least of
    their component, so that there are fewer than members.
    """
    n = len(marks)
    table = np.bitwise_count(marks[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], bucket))
    bucket, marks, table = bucket[order], marks[order], table[order]
    first = table[:, 0]
    left, right = [], []
    at, step = np.arange(n), 1
    while True:
        at = at[at + step < n]
        # in the order of the first coordinate: who has no partner so far behind has none further behind
        at = at[(bucket[at] == bucket[at + step]) & (first[at + step] - first[at] <= radius)]
        if not len(at):
            break
        near = at
        for p in range(1, len(refs)):  # coordinate by coordinate: a pair goes at the first that differs too much
            near = near[np.abs(table[near, p] - table[near + step, p]) <= radius]
            if not len(near):
                break
        if len(near):
            near = near[np.bitwise_count(marks[near] ^ marks[near + step]) <= radius]
            left.append(near)
            right.append(near + step)
        step += 1
    if not left:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
    moved = np.flatnonzero(label != np.arange(n))
    return marks[moved], marks[label[moved]]


def _links_in_buckets(keyed: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    """(a, b) from (mask, key, fingerprint) rows, none of whose buckets is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs, rest = pivots(n_pivots), None

        def linked(rows: tuple) -> pa.RecordBatch:
            mask, key, marks = rows
            new = np.concatenate([[False], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            a, b = bucket_links(np.cumsum(new), marks.view(np.uint64), radius, refs)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            rows = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            rows = rows if rest is None else tuple(np.concatenate(x) for x in zip(rest, rows, strict=True))
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            if cut:
                yield linked(tuple(x[:cut] for x in rows))
            rest = tuple(x[cut:] for x in rows)
        if rest is not None and len(rest[0]):
            yield linked(rest)

    return keyed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fingerprint").select("mask", "key", "fingerprint").mapInArrow(run, "a bigint, b bigint")


def _dealt(rows: DataFrame, deal: tuple[int, int]) -> DataFrame:
    """(mask, key, fingerprint): (mask, fingerprint) rows dealt to the finer buckets of their masks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finer: dict[int, np.ndarray] = {}
        for b in batches:
            masks, marks = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for m in np.unique(masks).tolist():
                if m not in finer:
                    finer[m] = np.array([_signed(x) for x in block_masks(m & (1 << 64) - 1, deal)], np.int64)
                held = marks[masks == m]
                for x in finer[m]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), x)), pa.array(held & x), pa.array(held)], names=["mask", "key", "fingerprint"])

    return rows.select("mask", "fingerprint").mapInArrow(run, "mask bigint, key bigint, fingerprint bigint")


def near_links(marks: DataFrame, radius: int = RADIUS, n_pivots: int = N_PIVOTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect just what fingerprints within the radius connect; marks has one row for each distinct fingerprint.

    Runs a job for each round of splitting at once.
    """
    if radius > 3:
        raise ValueError("blocks agree as DEALS says only up to 3 differing bits")
    masks = F.array(*(F.lit(_signed(m)).cast("bigint") for m in block_masks(0, DEALS[0])))
    keyed = marks.select("fingerprint", F.explode(masks).alias("mask")).select("mask", F.col("fingerprint").bitwiseAND(F.col("mask")).alias("key"), "fingerprint")
    found, n = None, 1
    while True:
        sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("__n")).where((F.col("__n") > bucket_rows) & (F.bit_count("mask") < 64 - FREE_BITS))
        if sizes.isEmpty():
            part = _links_in_buckets(keyed, radius, n_pivots)
            return part if found is None else found.unionByName(part)
        # what large buckets hold is dealt anew by the bits that their keys leave free, of which some are fewer each time
        names = materialize(sizes.groupBy(F.xxhash64("mask", "key").alias("__bucket")).agg(F.sum("__n").alias("__n")), "buckets")
        named = keyed.withColumn("__bucket", F.xxhash64("mask", "key"))
        held = lookup_join(named, names, "__bucket", "__n", keyed.count())
        small = named.join(names.select("__bucket"), "__bucket", "left_anti")
        part = _links_in_buckets(small.select("mask", "key", "fingerprint"), radius, n_pivots)
        found = part if found is None else found.unionByName(part)
        keyed = materialize(_dealt(held, DEALS[min(n, len(DEALS) - 1)]), "keyed")
        n += 1


def component_table(marks: DataFrame, rows: int, **how) -> DataFrame:
    """(fingerprint, __n, component_id) for each distinct fingerprint of the `rows` rows of marks (doc_id, fingerprint); component_id is the least doc_id reachable."""
    distinct = materialize(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("__n")), "fingerprints", rows)
    roots = connected_components(near_links(distinct, **how), rows)
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "__n", "least_id", "root")
    linked = rooted.where("root IS NOT NULL")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = linked.drop("least_id").join(least, "root").select("fingerprint", "__n", "component_id")
    return materialize(rooted.where("root IS NULL").select("fingerprint", "__n", F.col("least_id").alias("component_id")).unionByName(found), "components", rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach, itself included) of every row.

    Texts without words, null and empty ones included, have the fingerprint zero and link like
    any other; very long ones are hashed whole. Null ids are carried and are no component's
    least id unless it has no other. Repeated rows are each returned; other columns are
    ignored, whatever their names; an empty table gives no rows. All but the last join runs at once.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marks = materialize(with_fingerprints(rows, ["doc_id"]), "marks")
    n = marks.count()
    joined = lookup_join(marks, component_table(marks, n, **how), "fingerprint", "__n", n)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, of each near-duplicate component the row with the least id alone; all columns stay, whatever their names.

    Of several rows with that id (repeated rows, or null ids alone) the one with the least
    hash of its columns stays, one of equal rows. Null, empty and very long texts are as in
    near_duplicates; an empty table stays empty. The rows are written with a number each, so
    that the last join is on numbers that no two rows share, and no copies ever meet.
    """
    columns = docs.columns
    every = [F.col(f"`{c}`") for c in columns]
    # maps, which have no hash, go as text
    hashable = [F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(every, docs.dtypes, strict=True)]
    row = fresh(docs, "__row")
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    narrow = stored.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(*hashable).alias("__hash"), F.col(row).alias("__row"), F.col(text_col).alias("text"))
    marks = materialize(with_fingerprints(narrow, ["doc_id", "__hash", "__row"]), "marks")
    n = marks.count()
    joined = lookup_join(marks, component_table(marks, n, **how), "fingerprint", "__n", n)
    # one row for each component, by a partial minimum; a null id comes after all others
    best = joined.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("__own")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__hash", "__row")).alias("b"))
    return stored.join(best.select(F.col("b.__row").alias(row)), row, "left_semi").select(*every)
