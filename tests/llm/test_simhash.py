"""Near-duplicates against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from quern.llm import components, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def check(docs, **how):
    rows = docs.select("doc_id", "text").collect()
    marks = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(marks)
    want = []
    for r, m, c in zip(rows, marks, roots, strict=True):
        ids = [x.doc_id for x, d in zip(rows, roots, strict=True) if d == c and x.doc_id is not None]
        want.append((r.doc_id, f"{m:016x}", min(ids, default=None)))
    assert sorted(map(tuple, simhash.near_duplicates(docs, **how).collect()), key=str) == sorted(want, key=str)


def test_documents(odd, documents):
    check(odd)
    check(documents.limit(120))


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one_of_each(none).count() == 0


@pytest.mark.parametrize("bucket_rows", [1024, 4])
def test_links(spark, bucket_rows):
    """Chains and balls of close fingerprints; small buckets are split anew, and no link is lost."""
    rng = random.Random(bucket_rows)
    marks = {0, 2**64 - 1}
    for _ in range(12):
        m = rng.getrandbits(64)
        for _ in range(40):
            marks.add(m)
            m ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    ball = rng.getrandbits(64)
    marks |= {ball ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(10)}
    marks = sorted(marks)
    df = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fingerprint bigint")
    links = simhash.near_links(df, bucket_rows=bucket_rows)
    roots = {r.node: r.root for r in components.connected_components(links, len(marks)).collect()}
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    want = brute_components(marks)
    groups = {}
    for s, c in zip(signed, want, strict=True):
        groups.setdefault(c, set()).add(s)
    for members in groups.values():
        if len(members) > 1:
            assert {roots[m] for m in members} == {min(members)}
        else:
            assert not members & set(roots)


def test_pivots_lose_nothing():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    refs = simhash.pivots()
    d = lambda x: np.bitwise_count(x[:, None] ^ refs).astype(int)
    assert (np.abs(d(a) - d(b)).max(axis=1) <= 2).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), len(edges)).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 2000: 2000, 2001: 2000}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint"), 0).count() == 0


def test_one_of_each(odd, odd_rows):
    out = simhash.keep_one_of_each(odd)
    assert out.columns == odd.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    # 3 stands for both rows of 5; 1 for the texts without words; the null id with words is alone
    assert ids == sorted([3, 1, None, 7, 8, 9, 10, -4], key=str)
    again = odd.unionByName(odd)
    assert sorted((r.doc_id for r in simhash.keep_one_of_each(again).collect()), key=str) == ids


def test_hot_copies(spark):
    """A hundred thousand rows alike in every column: one stays, and none of the steps brings rows together by what they hold."""
    hot = spark.range(100_000).selectExpr("7L AS doc_id", "'the same few words in every one of them' AS text", "'x' AS source")
    rest = spark.range(300).selectExpr("id + 100 AS doc_id", "concat_ws(' ', transform(sequence(0, 60), i -> sha2(concat(id, ':', i), 256))) AS text", "'y' AS source")
    out = simhash.keep_one_of_each(hot.unionByName(rest))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "__hash" not in plan.split("SortMergeJoin")[0]
    assert sorted(r.doc_id for r in out.collect()) == [7, *range(100, 400)]


@pytest.mark.parametrize("radius_bits", [0, 1, 2, 3])
def test_blocks_agree(radius_bits):
    """Whatever bits differ, fingerprints within the radius meet in some bucket of every deal."""
    rng = random.Random(radius_bits)
    for deal in simhash.DEALS:
        for _ in range(200):
            mask = 0 if rng.random() < 0.5 else rng.choice(simhash.block_masks(0, simhash.DEALS[0]))
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample([k for k in range(64) if not mask >> k & 1], radius_bits))
            assert any((a ^ b) & m == 0 for m in simhash.block_masks(mask, deal))


def test_bucket_links_are_those_of_all_pairs():
    """Several buckets of close fingerprints: the links connect what all pairs within the radius connect, and pivots discard pairs."""
    rng = random.Random(8)
    marks, bucket = [], []
    for n in range(6):
        for _ in range(5):
            m = rng.getrandbits(64)
            for _ in range(8):
                marks.append(m)
                bucket.append(n)
                m ^= sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5)))
    a, b = simhash.bucket_links(np.array(bucket), np.array(marks, np.uint64), 3, simhash.pivots())
    roots = {m: m for m in marks}

    def find(m):
        while roots[m] != m:
            m = roots[m]
        return m

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        roots[find(x)] = find(y)
    for n in range(6):
        mine = [m for m, k in zip(marks, bucket, strict=True) if k == n]
        want = brute_components(mine)
        for i in range(len(mine)):
            for j in range(i):
                assert (want[i] == want[j]) == (find(mine[i]) == find(mine[j]))
