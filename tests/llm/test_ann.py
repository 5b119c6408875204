import math

import numpy as np
import pytest

from quern.llm import ann


def brute(rows, every, k):
    """rows: distinct (id, vector) that count."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            a = np.array(v, float)
            near = sorted((-float(ann.cosines(a, np.array([w], float))[0]), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want, got = brute(rows, 50, 5), answers(ann.nearest_neighbours(df))
    assert set(got) == set(want)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) / (5 * len(want)) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, found in got.items():
        for i, s in found:
            assert s == pytest.approx(float(vectors[q] @ vectors[i] / math.sqrt((vectors[q] @ vectors[q]) * (vectors[i] @ vectors[i]))), abs=1e-12)


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    hot = [1.0, 0.0, 0.0]
    rows = [(i, hot) for i in range(0, 400)] + [(i, rng.normal(size=3).tolist()) for i in range(400, 460)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    bad = [(1000, None), (1050, [0.0, 0.0, 0.0]), (1100, [1.0, float("nan"), 0.0]), (1150, [1.0, None, 0.0]), (1200, [float("inf"), 0.0, 0.0]), (1250, [1.0, 1.0]), (None, hot)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + rows[:30] + bad], "vec_id bigint, embedding array<float>, rank int, score string")
    got = answers(ann.nearest_neighbours(df, leaf=8))
    assert got == brute(rows, 50, 5)


def test_doubles(spark):
    """Components far outside the range of 32 bits, and of their squares, count."""
    rows = [(0, [1e-60, 2e-60]), (1, [1e300, 0.0]), (2, [1.0, 1.0]), (50, [3e-200, -1e-200]), (3, [0.1, 0.2]), (4, [-1e305, -2e305])]
    got = answers(ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    assert [i for i, _ in got[0]] == [3, 2, 1, 50, 4] and [i for i, _ in got[50]] == [1, 2, 0, 3, 4]
    assert got[0][0][1] == pytest.approx(1.0, abs=1e-15) and got[0][2][1] == pytest.approx(1 / math.sqrt(5)) and got[0][4][1] == pytest.approx(-1.0)


def test_lengths(spark):
    """Vectors of each length are searched among their own."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3 + (i % 10 == 0) + (i % 50 == 0)).tolist()) for i in range(300)]
    got = answers(ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), leaf=8))
    assert got == brute(rows, 50, 5) and len(got) == 6


def test_recall_on_clusters(spark):
    """Clustered vectors need a small share: recall with 400 rows of 8,000, in 16 trees."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(200, 32))
    vectors = centres[rng.integers(0, 200, 8000)] + 0.25 * rng.normal(size=(8000, 32))
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id bigint, embedding array<double>")
    got = answers(ann.nearest_neighbours(df, search_rows=1600, search_share=0.0))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 8000, 50):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argsort(-near)[:5].tolist()) & {i for i, _ in got[q]})
    assert hits / (5 * 160) >= 0.9


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 4.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = answers(ann.nearest_neighbours(two))
    assert [i for i, _ in got[0]] == [50, 3] and [i for i, _ in got[50]] == [0, 3]
    assert ann.nearest_neighbours(two.limit(0)).count() == 0
    assert ann.nearest_neighbours(two.where("vec_id = 0")).count() == 0


def test_blocks(spark, monkeypatch):
    """A leaf in many blocks, and many tasks, give what one of each gives."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    whole = answers(ann.nearest_neighbours(df, search_share=2.0))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 5)
    monkeypatch.setattr(ann, "TASK_NUMBERS", 20_000)
    assert answers(ann.nearest_neighbours(df, search_share=2.0)) == whole
