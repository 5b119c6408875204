"""Documents with every oddity that operators must bear."""

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, shard int, fingerprint string, ids array<int>, __h1 bigint, held_out string"

ROWS = [
    (5, "The quick brown fox jumps over the lazy dog. Released under the MIT License.", "en", "a"),
    (5, "The quick brown fox jumps over the lazy dog. Released under the MIT License.", "en", "a"),  # a repeated row
    (3, "The quick brown fox jumps over the lazy dog. Released under the MIT License.", "en", "b"),  # a copy
    (1, None, "en", "a"),
    (2, "", "de", "a"),
    (None, "a text without an id  \t two", "fr", None),
    (None, None, None, None),
    (7, "word " * 40_000, "en", "a"),
    (8, "x" * 200_000, None, "a"),
    (9, '12 !! -- 34 password = "hunter2hunter2hunter2"', "en", "a"),
    (10, "Ünïcödé ΣΊΣΥΦΟΣ 日本語 🎉 <|endoftext|> İstanbul\x00\x1c é", "xx", "a"),
    (-4, "das ist ein kurzer deutscher text", "de", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, la, s, None if t is None else len(t), 0.5, 1, "f", [1], 3, "no") for i, t, la, s in ROWS]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def odd_rows():
    return ROWS


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
