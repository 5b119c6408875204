"""BPE and the token store against the tokenizers library."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from quern.llm import bpe, token_store  # noqa: E402


@pytest.fixture(scope="module")
def word():
    return bpe.codec(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def byte():
    return token_store.encoder(token_store.tokenizer_path())


def same(word, text):
    ids = word.library.encode(text, add_special_tokens=False).ids
    assert word.encode(text) == ids
    decoded = word.library.decode(ids, skip_special_tokens=False)
    assert word.decode(ids) == decoded and word.decode_written(word.encode_written(text)) == decoded


def same_bytes(byte, text):
    assert byte.encode(text) == np.array(byte.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdeinorst .,'!?\n1AÉé", max_size=120))
def test_any_text(word, byte, text):
    same(word, text)
    same_bytes(byte, text)


def test_joined_tokens(word):
    rng, names = random.Random(4), sorted(word.model.vocab)
    for _ in range(1500):
        same(word, "".join(rng.choice(names).replace("</w>", "") for _ in range(3)))


@pytest.mark.parametrize("text", ["", " ", "\n", "a\n\nb", " \n a", "a  b", "'s't", "<|endoftext|>x<|startoftext|>", "ΟΔΟΣ", "İ", "aaaa" * 5000, "é", "\x1c \x85\xa0"])
def test_corners(word, byte, text):
    same(word, text)
    same_bytes(byte, text)


def test_small_caches(word, byte, monkeypatch, documents):
    texts = [r.text for r in documents.limit(60).collect()]
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 30)
    monkeypatch.setattr(token_store, "CACHE_PIECES", 100)
    for t in texts:
        same(word, t)
    assert byte.encode_many(texts) == [np.array(byte.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_digests(word, odd, odd_rows, none):
    got = sorted(map(tuple, bpe.encode_digests(odd).collect()), key=str)
    want = []
    for i, t, *_ in odd_rows:
        ids = word.library.encode(t or "", add_special_tokens=False).ids
        text = word.library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(none).count() == 0


def test_round_trip(word, documents):
    rows = bpe.decode_ids(bpe.encode_ids(documents.limit(30))).collect()
    for r in rows:
        assert r.decoded == word.library.decode(r.token_ids, skip_special_tokens=False)


def test_store(byte, odd, odd_rows, none, spark, tmp_path):
    folder = str(tmp_path / "tokens")
    token_store.write_tokens(odd, folder, partitions=3)
    got = token_store.token_digests(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, *_ in odd_rows), key=lambda i: (i is not None, i or 0))
    at = 0
    left = [(i, t) for i, t, *_ in odd_rows]
    for r in got:
        assert r.start == at
        at += r.n_tokens
        match = next(x for x in left if x[0] == r.doc_id and zlib.crc32(byte.encode(x[1]) + (2).to_bytes(4, "little")) == r.ids_crc32)
        left.remove(match)
    assert not left
    files = token_store.read_tokens(spark, folder).where("doc_id = 9")
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,9)]" in plan and files.count() == 1
    assert token_store.store_and_read(none).count() == 0


def stripe_footers(spark, path):
    """(streams as (kind, column), encodings by column) of each stripe, read by the ORC library."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(path)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getCompressionKind().toString() == "ZSTD" and reader.getRowIndexStride() == token_store.ROWS_PER_INDEX
    rows = reader.rows()
    for stripe in reader.getStripes():
        footer = rows.readStripeFooter(stripe)
        yield {(x.getKind().toString(), x.getColumn()) for x in footer.getStreamsList()}, [x.getKind().toString() for x in footer.getColumnsList()]


def test_files_have_indexes(spark, documents, tmp_path):
    """Row indexes in every column, a Bloom filter on doc_id alone, run-length encoding of the second kind."""
    folder = str(tmp_path / "tokens")
    token_store.write_tokens(documents, folder, partitions=2)
    files = sorted((tmp_path / "tokens").glob("*.orc"))
    assert len(files) == 2
    from pyarrow import orc

    rows = [orc.ORCFile(str(p)).read() for p in files]
    ids = [i for t in rows for i in t.column("doc_id").to_pylist()]
    assert ids == sorted(ids) and len(ids) == documents.count()
    # columns: 0 the row, 1 doc_id, 2 part, 3 at, 4 n_tokens, 5 ids, 6 their elements
    for p in files:
        for streams, encodings in stripe_footers(spark, p):
            assert {c for kind, c in streams if kind == "ROW_INDEX"} == set(range(7))
            assert {c for kind, c in streams if kind.startswith("BLOOM_FILTER")} == {1}
            assert encodings[1:] == ["DIRECT_V2"] * 6


def test_equal_rows_are_spread(spark, tmp_path):
    """A hot id, all rows of it alike, does not go to one part."""
    rows = spark.range(20_000).selectExpr("7L AS doc_id", "'the same' AS text").union(spark.range(2000).selectExpr("id + 100 AS doc_id", "concat('text ', id) AS text"))
    folder = str(tmp_path / "tokens")
    token_store.write_tokens(rows, folder, partitions=8)
    sizes = [r["count"] for r in token_store.read_tokens(spark, folder).groupBy("part").count().collect()]
    assert sum(sizes) == 22_000 and max(sizes) < 5000
    starts = [(r.start, r.n_tokens) for r in token_store.token_digests(spark, folder).orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
def test_parts(spark, n):
    """Ranges ascend, and one id that many bounds equal (or null) is spread over their ranges."""
    from pyspark.sql import functions as F

    rng = random.Random(n)
    bounds = sorted(rng.choice([rng.randint(-50, 50), 7, -(1 << 63)]) for _ in range(n))
    ids = [*range(-60, 60), *[7] * 60, *[None] * 60]
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "i bigint, k bigint")
    key = F.coalesce("i", F.lit(-(1 << 63)))
    rows = df.select("i", token_store.part_of(key, F.xxhash64("k"), bounds).alias("p")).collect()
    for r in rows:
        v = -(1 << 63) if r.i is None else r.i
        assert sum(b < v for b in bounds) <= r.p <= sum(b <= v for b in bounds)
    if n == 40:
        assert len({r.p for r in rows if r.i == 7}) > 5 and len({r.p for r in rows if r.i is None}) > 5
