"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every vector is put into one leaf of each tree. A
query walks all trees at once through one priority queue, nearest splitting planes first,
until the leaves that it took hold enough vectors; what is in them is ranked exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import lookup_join, materialize

K, EVERY = 5, 50
#: The sample that the trees are fitted on, at most: vectors, and numbers in them; trees; sample vectors in a leaf, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS, N_TREES, LEAF = 65_536, 1 << 23, 16, 48
#: A query takes leaves until they hold this many vectors (with those in several trees counted again), or this share of all if that is more.
#: Vectors spread evenly over all directions, as the test tables' are, need such a share for a recall of 0.9; a share of 0 suits clustered ones.
SEARCH_ROWS, SEARCH_SHARE = 4_000, 0.45
#: Vectors of a leaf in one block; a leaf with more is split into blocks, to all of which its queries go.
BLOCK_ROWS = 8_192
#: Numbers in the vectors that one task holds.
TASK_NUMBERS = 1 << 22


class Forest:
    """Random-projection trees in arrays: a node is a plane with two children, or (child < 0) leaf number -1 - child."""

    def __init__(self, sample: np.ndarray, n_trees: int, leaf: int, seed: int = 0) -> None:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        self.planes: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_rows: list[int] = []
        self.roots = [self._grow(unit, np.arange(len(unit)), leaf, rng) for _ in range(n_trees)]
        self.normals = np.array(self.planes).reshape(len(self.planes), sample.shape[1])
        self.sides = np.array(self.children, np.int64).reshape(-1, 2)
        self.rows = np.array(self.leaf_rows, np.int64)
        self.sampled = len(sample)
        del self.planes, self.children, self.leaf_rows

    def _leaf(self, n: int) -> int:
        self.leaf_rows.append(n)
        return -len(self.leaf_rows)

    def _grow(self, unit: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) <= leaf:
            return self._leaf(len(rows))
        for _ in range(8):
            a, b = unit[rng.choice(rows, 2, replace=False)]
            normal = a - b
            if (size := np.linalg.norm(normal)) < 1e-9:
                continue
            right = unit[rows] @ (normal / size) > 0
            if 0.05 * len(rows) < right.sum() < 0.95 * len(rows):
                at = len(self.planes)
                self.planes.append(normal / size)
                self.children.append([0, 0])
                self.children[at] = [self._grow(unit, rows[~right], leaf, rng), self._grow(unit, rows[right], leaf, rng)]
                return at
        return self._leaf(len(rows))

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree: (rows, trees)."""
        out = np.empty((len(vectors), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                right = (vectors[inner] * self.normals[node]).sum(axis=1) > 0
                at[inner] = self.sides[node, right.astype(int)]
            out[:, t] = -1 - at
        return out

    def search(self, vector: np.ndarray, least_rows: float) -> list[int]:
        """Leaves from all trees, best first, until they hold least_rows rows of the sample."""
        margins = self.normals @ (vector / np.linalg.norm(vector)) if len(self.normals) else self.normals
        queue = [(-np.inf, root) for root in self.roots]
        heapq.heapify(queue)
        out, held = [], 0.0
        while queue and held < least_rows:
            near, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                held += self.rows[-1 - node]
                continue
            m = float(margins[node])
            heapq.heappush(queue, (max(near, -m), int(self.sides[node, 1])))
            heapq.heappush(queue, (max(near, m), int(self.sides[node, 0])))
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors in double precision, each scaled by the power of two that makes its largest component about 1: cosines stay what they are, to the last bit, and no square overflows or vanishes."""
    found = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.ldexp(found, -np.frexp(np.abs(found).max(axis=1, initial=0.0))[1][:, None])


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of query with each row, in double precision; equal rows give equal results, wherever they stand."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def vector_classes(vectors: DataFrame, keep: int) -> DataFrame:
    """(embedding, cid, n, ids): one row for each distinct vector; cid its least vec_id, n its rows, ids the `keep` least ones.

    The least ids are found within shares of a class first, so that no task gets a class of copies whole.
    """
    salted = vectors.withColumn("__salt", F.pmod(F.xxhash64("vec_id"), F.lit(32)))
    few = salted.withColumn("__r", F.row_number().over(W.partitionBy("embedding", "__salt").orderBy("vec_id"))).where(F.col("__r") <= keep)
    fewest = few.withColumn("__r", F.row_number().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("__r") <= keep)
    ids = fewest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sizes = vectors.groupBy("embedding").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(sizes, "embedding").select("embedding", F.col("ids")[0].alias("cid"), "n", "ids")


class Layout:
    """Which task holds a block of a leaf: neighbouring leaves go together, as many as make TASK_NUMBERS."""

    def __init__(self, forest: Forest, total: int, width: int) -> None:
        self.blocks = 1 + int(total / forest.sampled * forest.rows.max()) // BLOCK_ROWS
        ends = np.cumsum(forest.rows)
        self.n = 1 + total * len(forest.roots) * width // TASK_NUMBERS
        self.begins, self.rows, self.all = ends - forest.rows, forest.rows, max(1, int(ends[-1]))

    def task(self, leaf: np.ndarray, block: np.ndarray) -> np.ndarray:
        return ((self.begins[leaf] + self.rows[leaf] * block // self.blocks) * self.n // self.all).astype(np.int32)


def _ranked(task: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """(qid, cid, score, ids): for each query of a task the k nearest of the vectors in its cells; vectors come first, cell by cell."""
    held: list[pa.RecordBatch] = []
    unit = None
    for b in task:
        asks = b.column(0).to_numpy(zero_copy_only=False)
        n = int(np.count_nonzero(~asks))
        if n:
            held.append(b.slice(0, n).select([1, 2, 3, 4]))
        if n == b.num_rows:
            continue
        if not held:
            return
        if unit is None:
            table = pa.Table.from_batches(held).combine_chunks()
            cell, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
            vectors, copies = _matrix(table.column(2).chunk(0), width), table.column(3).chunk(0)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            _, first, number = np.unique(ids, return_index=True, return_inverse=True)
        queries, qids = _matrix(b.column(3).slice(n), width), b.column(2).slice(n).to_numpy()
        picked, qid, scores = [], [], []
        for i, (query, q, cells) in enumerate(zip(queries, qids.tolist(), b.column(5).slice(n), strict=True)):
            cells = cells.values.to_numpy()
            lows, highs = np.searchsorted(cell, cells), np.searchsorted(cell, cells, side="right")
            met = np.zeros(len(first), bool)  # a vector counts once, in however many trees
            for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True):
                met[number[lo:hi]] = True
            at = first[met]
            at = at[ids[at] != q]
            if not len(at):
                continue
            rough = unit[at] @ (query / np.linalg.norm(query))
            if len(at) > k:
                at = at[rough >= np.partition(rough, len(at) - k)[len(at) - k] - 1e-9]
            score = cosines(query, vectors[at])
            best = np.lexsort((ids[at], -score))[:k]
            picked.append(at[best])
            qid.append(np.full(len(best), q))
            scores.append(score[best])
        if picked:
            at = np.concatenate(picked)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qid)), pa.array(ids[at]), pa.array(np.concatenate(scores)), copies.take(pa.array(at))], names=["qid", "cid", "score", "ids"])


def nearest_neighbours(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
    sample_rows: int = SAMPLE_ROWS, n_trees: int = N_TREES, leaf: int = LEAF, search_rows: int = SEARCH_ROWS, search_share: float = SEARCH_SHARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine that the search finds, for each row whose id is divisible by `every`.

    Every row but the query's own is a candidate; ties go to the smaller id. Equal vectors are
    searched as one and ranked each. Rows with a null id or vector, an empty or zero vector, or a
    null or non-finite component take no part; vectors of another length are searched among
    their own, length by length; repeated rows count once; other columns are ignored, whatever
    their names. A table without valid rows gives none. All but the last joins runs at once.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~bad & F.exists("embedding", lambda x: x != 0)).distinct()
    rows = materialize(rows, "vectors")
    out = None
    for r in rows.groupBy(F.size("embedding").alias("w")).count().orderBy("w").collect():  # a row for each length of vectors
        some = _search(rows.where(F.size("embedding") == r.w), r.w, k, every, sample_rows, n_trees, leaf, search_rows, search_share)
        out = some if out is None else out.unionByName(some)
    return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if out is None else out


def _search(rows: DataFrame, width: int, k: int, every: int, sample_rows: int, n_trees: int, leaf: int, search_rows: int, search_share: float) -> DataFrame:
    classes = materialize(vector_classes(rows, k + 1), "classes")
    total = classes.count()
    drawn = classes.select("embedding", F.xxhash64("embedding", "cid").alias("h"), "cid").orderBy("h", "cid").limit(max(1, min(sample_rows, SAMPLE_NUMBERS // width))).select("embedding").toArrow()
    forest = Forest(_matrix(drawn.column(0).combine_chunks(), width), n_trees, leaf)
    layout = Layout(forest, total, width)
    shared = rows.sparkSession.sparkContext.broadcast((forest, layout))  # bounded by the sample's rows and numbers, n_trees and leaf
    least_rows = max(search_rows, search_share * total) * forest.sampled / total

    names = ["task", "is_query", "cell", "id", "embedding", "ids", "cells"]
    schema = "task int, is_query boolean, cell bigint, id bigint, embedding array<double>, ids array<bigint>, cells array<bigint>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, layout = shared.value
        for b in batches:
            where, block = forest.leaves_of(_matrix(b.column(0), width)), b.column(3).to_numpy()
            for t in range(where.shape[1]):
                cells = pa.nulls(b.num_rows, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(layout.task(where[:, t], block)), pa.array(np.zeros(b.num_rows, bool)), pa.array(where[:, t] * layout.blocks + block), b.column(1), b.column(0), b.column(2), cells], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query goes once to each task that holds some of its cells, with the list of them."""
        forest, layout = shared.value
        for b in batches:
            vectors = _matrix(b.column(0), width)
            for lo in range(0, len(vectors), 64):
                row, tasks, starts, listed = [], [], [0], []
                for i, v in enumerate(vectors[lo : lo + 64]):
                    leaves = np.repeat(np.array(forest.search(v, least_rows), np.int64), layout.blocks)
                    block = np.tile(np.arange(layout.blocks), len(leaves) // layout.blocks)
                    task = layout.task(leaves, block)
                    order = np.argsort(task, kind="stable")
                    cuts = np.flatnonzero(np.diff(task[order], prepend=-1))
                    row += [lo + i] * len(cuts)
                    tasks.append(task[order][cuts])
                    starts += (starts[-1] + np.append(cuts[1:], len(order))).tolist()
                    listed.append((leaves * layout.blocks + block)[order])
                part, n = b.take(pa.array(row, pa.int64())), len(row)
                cells = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(listed)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tasks)), pa.array(np.ones(n, bool)), pa.array(np.zeros(n, np.int64)), part.column(1), part.column(0), part.column(2), cells], names=names)

    indexed = classes.select("embedding", "cid", "ids", F.pmod(F.xxhash64("cid"), F.lit(layout.blocks)).cast("int").alias("block")).mapInArrow(index, schema)
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = classes.join(queries.select("embedding").distinct(), "embedding", "left_semi").select("embedding", "cid", F.array().cast("array<bigint>").alias("ids")).mapInArrow(ask, schema)
    cells = indexed.unionByName(asked).repartitionById(layout.n, F.col("task")).sortWithinPartitions("is_query", "cell", "id").select("is_query", "cell", "id", "embedding", "ids", "cells")
    near = cells.mapInArrow(lambda batches: _ranked(batches, width, k), "qid bigint, cid bigint, score double, ids array<bigint>")
    # one row for each query vector: its k best classes, the same in however many trees they were met
    first = near.groupBy("qid", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    best = first.withColumn("__r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "cid"))).where(F.col("__r") <= k)
    lists = best.groupBy("qid").agg(F.collect_list(F.struct("score", "ids")).alias("found"))

    def own_score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _matrix(b.column(0), width)
            score = np.array([cosines(v, v[None, :])[0] for v in vectors], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], names=[*b.schema.names, "own"])

    asked_rows = queries.groupBy("embedding").agg(F.count(F.lit(1)).alias("__m"))
    labels = classes.join(asked_rows, "embedding").mapInArrow(own_score, "embedding array<double>, cid bigint, n bigint, ids array<bigint>, `__m` bigint, own double")
    labels = materialize(labels.join(lists, labels["cid"] == lists["qid"], "left").select("embedding", "__m", F.concat(F.array(F.struct(F.col("own").alias("score"), "ids")), F.coalesce("found", F.array())).alias("found")), "lists")
    answered = lookup_join(queries, labels, "embedding", "__m", queries.count())
    flat = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("s"), i.alias("id")))))
    top = F.slice(F.array_sort(F.filter(flat, lambda x: x["id"] != F.col("vec_id"))), 1, k)
    exploded = answered.select(F.col("vec_id").alias("query_id"), F.posexplode(top).alias("p", "x"))
    return exploded.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
