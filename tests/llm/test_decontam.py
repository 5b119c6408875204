import os
import random
import subprocess
import sys
import time
import tracemalloc

import numpy as np
import pytest

from quern.llm import decontam

BENCH = "/root/testdata/sf0.001/benchmark.parquet"


def substring_edits(pattern, text):
    """Least edits of pattern against any substring, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        new = [i + 1]
        for j, t in enumerate(text):
            new.append(min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(items, text):
    raw = decontam.normal(text)
    return {i for i, t in items for w in decontam.windows_of(i, decontam.normal(t)) if substring_edits(w.text, raw) <= w.edits}


@pytest.fixture(scope="module")
def items(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(BENCH).collect()]


def test_gram_codes():
    raw = bytes(np.random.default_rng(0).integers(97, 100, 300, dtype=np.uint8))
    codes = decontam.gram_codes(raw)
    assert len(codes) == len(raw) - decontam.Q + 1
    by_text = {}
    for i, c in enumerate(codes.tolist()):
        assert by_text.setdefault(raw[i : i + decontam.Q], c) == c
    assert len(set(by_text.values())) == len(by_text)
    assert len(decontam.gram_codes(b"short")) == 0


@pytest.mark.parametrize("seed", range(3))
def test_edited_passages(items, seed):
    """Windows with edits up to the budget and one beyond it: the same answer as aligning everything."""
    rng, few = random.Random(seed), items[:6]
    index = decontam.BenchmarkIndex(few)
    for _ in range(25):
        i, t = rng.choice(few)
        w = rng.choice(decontam.windows_of(i, decontam.normal(t)))
        chars = list(w.text.decode("utf-8", "ignore"))
        for _ in range(rng.randint(0, w.edits + 1)):
            at, kind = rng.randrange(len(chars)), rng.randrange(3)
            chars[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("qxz")]
        text = "vw " * rng.randrange(30) + "".join(chars) + " vw" * rng.randrange(30)
        assert {m[0] for m in index.matches(text)} == brute(few, text)


def test_alignment():
    rng = random.Random(1)
    for _ in range(300):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(5, 20)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
        edits, end = decontam.least_edits(p, t)
        assert edits == substring_edits(p, t) == min(substring_edits(p, t[max(0, end - 2 * len(p)) : end]), len(p)) and 0 <= end <= len(t)


def test_table(odd, none, documents, items, spark):
    bench = spark.read.parquet(BENCH)
    texts = {r.doc_id: r.text for r in documents.collect()}
    index = decontam.BenchmarkIndex(items)
    pairs = {(d, m[0]): m for d, t in texts.items() for m in index.matches(t)}
    assert {(d, i) for d, t in texts.items() for i, b in items if b in t} <= set(pairs)
    # one block, several with one table, several tables
    for how in ({}, {"block_bytes": 5000}, {"block_bytes": 4000, "table_bytes": 4000}):
        got = {r.doc_id: r for r in decontam.contaminated(documents, bench, **how).collect()}
        assert set(got) == {d for d, _ in pairs}
        for d, r in got.items():
            mine = [m for (x, _), m in pairs.items() if x == d]
            assert r.n_items == len(mine) and r.n_windows == sum(m[1] for m in mine)
            edits, item, start, end = min((m[2], m[0], m[3], m[4]) for m in mine)
            assert (r.edits, r.item_id, r.start, r.end) == (edits, item, start, end)
            assert decontam.normal(texts[d])[start:end]
        sides = {r.item_id: r.n_docs for r in decontam.contaminating(documents, bench, **how).collect()}
        assert sides == {i: sum(x == i for _, x in pairs) for _, i in pairs}
        clean = decontam.drop_contaminated(documents, bench, **how)
        assert {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in pairs} and clean.columns == documents.columns
    assert decontam.contaminated(odd, bench).count() == 0 and decontam.drop_contaminated(odd, bench).count() == odd.count()
    assert decontam.contaminated(none, bench).count() == 0 and decontam.drop_contaminated(none, bench, block_bytes=5000).count() == 0
    empty = spark.createDataFrame([(1, None), (None, "x"), (2, ""), (3, "tiny")], "item_id bigint, text string")
    assert decontam.contaminated(odd, empty).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0
    # repeated rows are each returned, whatever their ids
    first = documents.where(documents.doc_id == min(d for d, _ in pairs))
    again = first.unionByName(first).selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "text AS item_id")
    assert [r.doc_id for r in decontam.contaminated(again, bench, block_bytes=5000).collect()] == [None, None]


def test_repetitive_texts(monkeypatch):
    """A text and items of one syllable meet in a huge number of places: bounded memory and time, and the same windows."""
    items = [(k, "la " * (300 + k)) for k in range(20)] + [(50, "do re mi fa " * 20)]
    index = decontam.BenchmarkIndex(items)
    tracemalloc.start()
    began = time.process_time()
    got = index.matches("la " * 8000 + "do re mi fa " * 9)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20 and time.process_time() - began < 20
    tracemalloc.stop()
    assert {m[0] for m in got} == {*range(20), 50}
    # in stretches, and in ranges of the block, no window is lost
    text = "xy " * 100 + "la " * 150 + "do re mi fa " * 11 + "la so " * 40
    want = index.matches(text)
    for pairs in (3000, 50):
        monkeypatch.setattr(decontam, "PAIRS", pairs)
        assert [m[:3] for m in index.matches(text)] == [m[:3] for m in want]


def test_memory_of_a_block(tmp_path):
    """8 MB of benchmark: indexes of two blocks, each under 200 MB, made under 1 GB."""
    code = """
import random, resource, sys
from quern.llm import decontam
rng = random.Random(0)
words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(50000)]
for _ in range(2):
    items = [(i, " ".join(rng.choices(words, k=160))) for i in range(4200)]
    size = sum(len(t) for _, t in items)
    index = decontam.BenchmarkIndex(items)
    assert size > decontam.BLOCK_BYTES, size
    assert index.nbytes() < 200 << 20, index.nbytes()
    assert index.matches("zz " + items[7][1][300:600])[0][0] == 7
assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 1 << 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=300)


def test_short_and_partial(spark):
    items = [(1, "Only a short question here?"), (2, "w" * 30 + " " + " ".join(f"word{i}" for i in range(60)))]
    index = decontam.BenchmarkIndex(items)
    assert [m[0] for m in index.matches("zz only a SHORT question, here zz")] == [1]
    half = items[1][1][120:300]
    assert [m[0] for m in index.matches("begin " + half + " end")] == [2]
    assert index.matches("only a brief question here") == []


def test_passages_at_every_offset(items):
    """13 words from every word on, 108 characters from every character on: each is found, as its item."""
    few = [x for x in items if len(x[1]) > 200][:5] + [(1000, "x" * 5 + "".join(chr(0x4E00 + i * 37 % 5000) for i in range(120))), (1001, " ".join("".join(random.Random(i).choices("abcdefgh", k=25)) for i in range(20)))]
    index = decontam.BenchmarkIndex(few)
    for item, text in few:
        raw = decontam.normal(text)
        words = raw.decode().split()
        for i in range(len(words) - 12):
            assert item in {m[0] for m in index.matches("zq vj " + " ".join(words[i : i + 13]) + " kx wq")}, (item, i)
        for i in range(len(raw) - 107):
            part = raw[i : i + 108].decode("utf-8", "ignore")
            if part.encode() == raw[i : i + 108]:  # no character is cut
                assert item in {m[0] for m in index.matches("zq " + part + " kx")}, (item, i)


def test_edited_passage_off_the_grid(items):
    """13 words with one wrong letter, which lie across two windows of the grid."""
    item, text = next(x for x in items if len(x[1]) > 200)
    words = decontam.normal(text).decode().split()
    part = " ".join(words[8:21])
    at = len(part) // 2
    assert item in {m[0] for m in decontam.BenchmarkIndex([(item, text)]).matches("zq " + part[:at] + "~" + part[at + 1 :] + " kx")}


def test_items_shorter_than_a_gram():
    index = decontam.BenchmarkIndex([(1, "Blue whale?"), (2, ""), (3, "--")])
    assert index.matches("The blue, WHALE swims") == [(1, 1, 0, 4, 14)]
    assert index.matches("the blue whales swim") == [] and index.matches("") == []
