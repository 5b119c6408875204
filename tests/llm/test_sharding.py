import zlib

from quern.llm import sharding


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def check(docs, n=8):
    rows = docs.select("doc_id", "text").collect()
    out = sharding.shard_documents(docs, n, blocks=7).collect()
    assert sorted((str(r.doc_id), zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 1) for r in rows) == sorted((str(r.doc_id), r.text_crc32, r.size) for r in out)
    for r in out:
        assert r.shard == jump(r.doc_id or 0, n) and r.grown_shard == jump(r.doc_id or 0, n + 1) and r.grown_shard in (r.shard, n) and r.law == "key"
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_shards(odd, none, documents, spark):
    check(odd)
    check(documents)
    check(documents, 13)
    assert sharding.shard_documents(none).count() == 0
    check(spark.createDataFrame([(i, "t") for i in (0, -1, 2**63 - 1, -(2**63), 2**32, -(2**33) + 5)], "doc_id bigint, text string"))


def test_native(documents):
    for df in (sharding.narrow_rows(documents, 8, "doc_id", "text", 1024), sharding.shard_documents(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_equal_rows_are_spread(spark):
    """Rows alike in id and text share a shard, but no numbering block."""
    hot = spark.range(20_000).selectExpr("7L AS doc_id", "'the same' AS text")
    sizes = [r["count"] for r in sharding.narrow_rows(hot, 8, "doc_id", "text", 64).groupBy("shard", "__block").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 600
    out = sharding.shard_documents(hot).agg({"slot": "max", "shard": "max"}).first()
    assert sorted(out.asDict().values()) == sorted([19_999, jump(7, 8)])
    assert sharding.shard_documents(hot).select("slot").distinct().count() == 20_000


def test_even(spark):
    counts = [r["count"] for r in sharding.shard_documents(spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) < 1.1 * min(counts)
