"""Filter language and search over small corpora with known answers."""

import pandas as pd
import pytest

from quern import KEY, NUMERIC, TAG, TEXT, VECTOR, Engine, Field, IndexSchema, QueryError, Settings

CORPUS = [
    ("1", "alpha beta gamma delta epsilon", ""),
    ("2", "alpha word beta word gamma", ""),
    ("3", "gamma beta alpha", ""),
    ("4", "word4 word5 blah alpha word word word beta", "blah blah word6"),
    ("5", "alpha word word word beta word word word gamma", ""),
    ("7", "word10 word11 word12 gamma delta", "word10 word11 word12 blah"),
    ("8", "word1 gamma word beta word word word alpha", "blah word2 word3"),
]


@pytest.fixture(scope="module")
def near(spark):
    engine = Engine(spark)
    schema = IndexSchema("near", (Field("content", TEXT, stem=False, suffix=True), Field("title", TEXT, stem=False)))
    engine.create(schema, spark.createDataFrame(CORPUS, f"{KEY} string, content string, title string"))
    return engine


def keys(engine, index, query, **options):
    return [r[KEY] for r in engine.search(index, query, nocontent=True, limit=(0, 100), **options).collect()]


@pytest.mark.parametrize(
    ("query", "options", "found"),
    [
        ('@content:"alpha beta"', {}, "1"),
        ('@content:"alpha gamma"', {}, ""),
        ("@content:beta @content:alpha", {"slop": 0, "inorder": True}, "3"),
        ("gamma beta alpha", {"slop": 0}, "1 3"),
        ("alpha beta gamma", {"slop": 1, "inorder": True}, "1"),
        ("alpha beta gamma", {"slop": 2, "inorder": True}, "1 2"),
        ("alpha beta gamma", {"slop": 5, "inorder": True}, "1 2"),
        ("alpha beta gamma", {"slop": 6, "inorder": True}, "1 2 5"),
        ("alpha beta gamma", {"slop": 1}, "1 3"),
        ("alpha beta gamma", {"slop": 3}, "1 2 3"),
        ("alpha beta gamma", {"inorder": True}, "1 2 5"),
        ("alpha beta gamma", {}, "1 2 3 5 8"),
        ("word10 @content:word11 @title:word12", {"inorder": True}, ""),
        ("word10 @title:word11 word12", {"inorder": True}, "7"),
        ("alph*", {}, "1 2 3 4 5 8"),
        ("@content:*silon", {}, "1"),
        ("%alpa%", {}, "1 2 3 4 5 8"),
        ("%%aplah%%", {}, "1 2 3 4 5 7 8"),
        ("-alpha", {}, "7"),
        ("epsilon | word6", {}, "1 4"),
        ("(epsilon | word6) -delta", {}, "4"),
        ("*", {}, "1 2 3 4 5 7 8"),
    ],
)
def test_text_queries(near, query, options, found):
    assert keys(near, "near", query, **options) == found.split()


@pytest.mark.parametrize("query", ["", "-|", "you%", "%you%%", "%%you%", "*a*", "@title:*word", "()", "a |", "| a", "(a", "a)", "a{", "@nofield:a", "the", "foo\\", "@content:{x}", "@content:[1 2]"])
def test_refused(near, query):
    with pytest.raises(QueryError):
        keys(near, "near", query)


@pytest.fixture(scope="module")
def typed(spark):
    rows = [
        ("hash:0", "1", "a,B , a", [1.0, 0.0, 0.0]),
        ("hash:1", "-inf", "b", [0.0, 2.0, 0.0]),
        ("hash:2", " 2.5 ", "C|d", [0.0, 0.0, 0.0]),
        ("hash:3", "nan", ",", None),
        ("hash:4", None, None, [1.0, 1.0]),
        ("other:5", "1", "a", [1.0, 1.0, 1.0]),
    ]
    source = spark.createDataFrame(rows, f"{KEY} string, n string, t string, v array<float>")
    fields = (Field("n", NUMERIC), Field("t", TAG), Field("v", VECTOR, dim=3))
    engine = Engine(spark)
    engine.create(IndexSchema("t", fields, prefixes=("hash:", "hash:1")), source)
    engine.create(IndexSchema("cos", (Field("v", VECTOR, dim=3, metric="COSINE"),)), source)
    engine.create(IndexSchema("ip", (Field("v", VECTOR, dim=3, metric="IP"),)), source)
    strict = Engine(spark, Settings(emulate=(1, 3, 0)))
    strict.create(IndexSchema("t", fields), source)
    return engine, strict


@pytest.mark.parametrize(
    ("query", "found"),
    [
        ("@n:[1 2.5]", "0 2"), ("@n:[(1 2.5]", "2"), ("@n:[1,(2.5]", "0"), ("@n:[-inf inf]", "0 1 2"), ("@n:[-inf +inf]", "0 1 2"), ("-@n:[1 1]", "1 2 3 4"),
        ("@t:{a}", "0"), ("@t:{A|b}", "0 1"), ("@t:{c\\|*}", "2"), ("@t:{c\\|d}", "2"), ("@t:{zz}", ""), ("@t:{b} | @n:[2 3]", "0 1 2"), ("@n:[0 3] -@t:{b}", "2"),
    ],
)
def test_numbers_and_tags(typed, query, found):
    assert [k[-1] for k in keys(typed[0], "t", query)] == found.split()


@pytest.mark.parametrize("query", ["@n:[2 1]", "@n:[1 (1]", "@n:[1-2 2]", "@n:[+1 2]", "@n:[1 INF]", "@t:{a*}", "@t:{abc**}", "@t:{}", "@t:{a"])
def test_refused_ranges_and_tags(typed, query):
    with pytest.raises(QueryError):
        keys(typed[0], "t", query)


def test_bad_fields_drop_the_document_from_1_3_0(typed):
    assert keys(typed[1], "t", "*") == ["hash:0", "hash:1", "hash:2", "other:5"]


def test_knn(typed):
    engine = typed[0]
    got = engine.search("t", "*=>[KNN 2 @v $q AS d]", params={"q": [1.0, 0.0, 0.0]}).collect()
    assert [(r[KEY], r.d) for r in got] == [("hash:0", 0.0), ("hash:2", 1.0)]
    got = engine.search("t", "@n:[-inf inf]=>[KNN $k @v $q]", params={"q": [0.0, 1.0, 0.0], "k": "9"}, returns=(("__v_score", "s"),)).collect()
    assert [(r[KEY], r.s) for r in got] == [("hash:1", 1.0), ("hash:2", 1.0), ("hash:0", 2.0)]
    cos = {r[KEY]: round(r["__v_score"], 6) for r in engine.search("cos", "*=>[KNN 9 @v $q]", params={"q": [2.0, 0.0, 0.0]}).collect()}
    assert cos == {"hash:0": 0.0, "hash:1": 1.0, "hash:2": 1.0, "other:5": round(1 - 3**-0.5, 6)}
    ip = {r[KEY]: r["__v_score"] for r in engine.search("ip", "*=>[KNN 9 @v $q]", params={"q": [2.0, 1.0, 0.0]}).collect()}
    assert ip == {"hash:0": -1.0, "hash:1": -1.0, "hash:2": 1.0, "other:5": -2.0}
    for bad in ({"q": [1.0]}, {}, {"q": [1.0, 0.0, 0.0], "unused": "1"}):
        with pytest.raises(QueryError):
            engine.search("t", "*=>[KNN 2 @v $q]", params=bad).collect()


def test_sort_and_page(typed):
    engine = typed[0]
    got = engine.search("t", "*", sortby=("n", False), with_sort_keys=True, limit=(0, 9), returns=(("n", "x"),)).collect()
    assert [r[KEY][-1] for r in got] == ["2", "0", "3", "1", "4"] and got[0]["__sortkey"] == "#2.5" and got[4]["__sortkey"] is None
    assert [r[KEY][-1] for r in engine.search("t", "*", sortby=("n", True), limit=(1, 2)).collect()] == ["3", "0"]
    assert engine.search("t", "*", limit=(0, 0)).count() == 0 and engine.total("t", "*") == 5
    assert engine.search("t", "*=>[KNN 2 @v $q]", params={"q": [1.0, 0.0, 0.0]}, limit=(2, 5)).count() == 0


def test_stems(spark):
    words = ["happy people", "happiness", "happi", "happier", "running daily", "run", "runs", "runner", "Running every day improves health"]
    engine = Engine(spark)
    rows = spark.createDataFrame([(str(i), w) for i, w in enumerate(words)], f"{KEY} string, t string")
    engine.create(IndexSchema("s", (Field("t", TEXT),)), rows)
    engine.create(IndexSchema("plain", (Field("t", TEXT, stem=False),)), rows)
    for word in ("happy", "happiness", "happi"):
        assert keys(engine, "s", word) == ["0", "1", "2"]
    assert keys(engine, "s", "run") == ["4", "5", "6", "8"] and keys(engine, "plain", "run") == ["5"]
    assert keys(engine, "s", "run", verbatim=True) == ["5"] and keys(engine, "s", '"run"') == ["5"]
    assert keys(engine, "s", "run health", slop=3) == ["8"] and keys(engine, "s", "run health", slop=2) == []
    assert keys(engine, "s", '"running every"') == ["8"]


def test_any_order():
    """Against every order and every choice of places."""
    import itertools
    import random

    from quern.functions.text import any_order

    rng = random.Random(6)
    for _ in range(400):
        n, slop = rng.randint(2, 5), rng.randint(0, 5)
        parts = [sorted({(s, s + rng.choice((0, 0, 1, 2))) for s in rng.sample(range(14), rng.randint(1, 3))}) for _ in range(n)]
        want = {}
        for chosen in itertools.product(*parts):
            row = sorted(chosen)
            if all(b[0] > a[1] for a, b in itertools.pairwise(row)) and row[-1][0] - row[0][0] <= slop + n - 1:
                want[row[0][0]] = min(want.get(row[0][0], 99), row[-1][1])
        assert any_order(parts, slop) == sorted(want.items())


@pytest.mark.parametrize(
    ("query", "slop", "found"),
    [
        ("alpha beta gamma delta epsilon", 0, "1"), ("epsilon delta gamma beta alpha", 0, "1"), ("alph* beta gamm* delta epsilon", 0, "1"), ("epsilon alph* alpha beta gamma delta", 3, ""),
        ("wor* word alpha beta gamma", 0, "2"), ("wor* word alpha beta gamma", 2, "2 8"), ("wor* word word* alpha beta gamma", 4, "5 8"), ("word word alpha beta gamma", 0, "2"), ("blah word4 word5 alpha word beta", 1, ""), ("blah word4 word5 alpha word beta", 2, "4"),
    ],
)
def test_slop_of_many_words(near, query, slop, found):
    """Five words and more, repeated and overlapping ones too: every order, no place twice."""
    assert keys(near, "near", "@content:" + query.replace(" ", " @content:"), slop=slop) == found.split()


def test_whole_numbers(spark):
    engine = Engine(spark)
    rows = [(str(i), n, float(n)) for i, n in enumerate((-3, 0, 2, 5, 2**31 - 1))] + [("5", None, float("nan")), ("6", 7, float("inf"))]
    engine.create(IndexSchema("w", (Field("n", NUMERIC), Field("d", NUMERIC))), spark.createDataFrame(rows, f"{KEY} string, n bigint, d double"))
    for query, found in (
        ("@n:[1.5 5.5]", "2 3"), ("@n:[(2 (5]", ""), ("@n:[2 5]", "2 3"), ("@n:[-inf inf]", "0 1 2 3 4 6"), ("@n:[(-2.5 (2]", "1"), ("-@n:[0 10]", "0 4 5"), ("@n:[-1e300 1e300]", "0 1 2 3 4 6"), ("@n:[1e18 1e19]", ""),
        ("@d:[-inf inf]", "0 1 2 3 4 6"), ("@d:[3 inf]", "3 4 6"), ("@d:[3 (inf]", "3 4"), ("-@d:[0 10]", "0 4 5 6"), ("-(-@d:[0 10])", "1 2 3"), ("@n:[0 2] | -@d:[-inf inf]", "1 2 5"),
    ):
        assert keys(engine, "w", query) == found.split(), query


def test_tokens(spark):
    engine = Engine(spark)
    texts = ["Hello, World! foo_bar", "a\\,b and\\cat", "naïve STRASSE Straße", "the is of", "x" * 50_000 + " end" + "\\," * 20_000, None, ""]
    engine.create(IndexSchema("k", (Field("t", TEXT, stem=False),)), spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], f"{KEY} string, t string"))
    tokens = {r[KEY]: r["__text_t"] for r in engine.prepared("k").collect()}
    assert tokens["0"] == ["hello", "world", "foo_bar"] and tokens["1"] == ["a,b", "cat"] and tokens["2"] == ["naïve", "strasse", "strasse"]
    assert tokens["3"] == [] and tokens["4"][1] == "end" + "," * 20_000 and tokens["5"] is None and tokens["6"] == []
    assert keys(engine, "k", "a\\,b") == ["1"] and keys(engine, "k", '"foo_bar"') == ["0"]


def test_json_documents(spark):
    rows = [("j:1", '{"n": 3, "tags": "x,y", "o": {"t": "deep words"}}'), ("j:2", '{"n": "7", "tags": ""}')]
    engine = Engine(spark)
    schema = IndexSchema("j", (Field("n", NUMERIC, "$.n"), Field("tags", TAG, "$.tags"), Field("t", TEXT, "$.o.t")), on="JSON")
    engine.create(schema, spark.createDataFrame(rows, f"{KEY} string, `$` string"))
    assert keys(engine, "j", "@n:[3 9]") == ["j:1", "j:2"] and keys(engine, "j", "@tags:{y}") == ["j:1"] and keys(engine, "j", "words") == ["j:1"]
    got = engine.search("j", "@n:[7 7]").collect()[0]
    assert got["$"].startswith("{")
    assert engine.search("j", "*", returns=(("$.o.t", "x"),)).collect()[0].x == "deep words"


def test_commands_and_admin(spark, tmp_path):
    engine = Engine(spark)
    rows = spark.createDataFrame([("a:1", "5", "red"), ("a:2", "6", "blue"), ("b:1", "5", "red")], f"{KEY} string, n string, c string")
    engine.execute("FT.CREATE i ON HASH PREFIX 1 a: SCHEMA n NUMERIC SORTABLE c AS colour TAG SEPARATOR ;", rows)
    with pytest.raises(QueryError):
        engine.execute("FT.CREATE i SCHEMA n NUMERIC", rows)
    assert [r.name for r in engine.execute("FT._LIST").collect()] == ["i"]
    assert [r[KEY] for r in engine.execute('FT.SEARCH i "@colour:{red}" RETURN 1 n DIALECT 2').collect()] == ["a:1"]
    info = engine.execute("FT.INFO i LOCAL").collect()[0]
    assert (info.num_docs, info.num_records, info.n_docs, info.colour_tags) == (2, 4, 2, 2)
    assert (info.state, info.backfill_in_progress, info.backfill_complete_percent, info.prefixes, info.language, info.hash_indexing_failures) == ("ready", 0, 1.0, ["a:"], "english", 0)
    assert [(a.identifier, a.attribute, a.type, a.details) for a in info.attributes] == [("n", "n", "NUMERIC", ""), ("c", "colour", "TAG", "SEPARATOR ;")]
    engine.execute("FT.CREATE t STOPWORDS 1 of MINSTEMSIZE 5 SCHEMA c TEXT NOSTEM n NUMERIC", rows.withColumn("n", rows.c))
    text = engine.info("t").collect()[0]
    assert (text.stop_words, text.min_stem_size, text.with_offsets, text.hash_indexing_failures) == (["of"], 5, 1, 3) and text.punctuation.startswith(",.")
    engine.save("i", str(tmp_path / "snap"))
    engine.execute("FT.DROPINDEX i")
    with pytest.raises(QueryError):
        engine.search("i", "*")
    assert engine.load(str(tmp_path / "snap")).name == "i" and keys(engine, "i", "*") == ["a:1", "a:2"]
    for bad in ("FT.CREATE x SCHEMA", "FT.CREATE x FILTER f SCHEMA n NUMERIC", "FT.CREATE x SCHEMA t TEXT WEIGHT 2", "FT.CREATE x SCHEMA n NUMERIC n NUMERIC", "FT.CREATE x SCHEMA v VECTOR FLAT 2 DIM 3"):
        with pytest.raises(QueryError):
            engine.execute(bad, rows)


def test_time_out(spark):
    """Commands are stopped when their time is over; others, and other jobs, are not."""
    from pyspark.sql import functions as F

    engine = Engine(spark)
    engine.create(IndexSchema("quick", (Field("n", NUMERIC),)), spark.createDataFrame([("a", 1)], f"{KEY} string, n int"))
    assert [r[KEY] for r in engine.rows("FT.SEARCH quick @n:[1,1] TIMEOUT 60000")] == ["a"]
    assert engine.rows("FT.SEARCH quick @n:[1,1] TIMEOUT 0") == engine.rows("FT.SEARCH quick @n:[1,1]")

    @F.pandas_udf("double")
    def slow(x: pd.Series) -> pd.Series:
        import time

        time.sleep(30)
        return x

    engine.create(IndexSchema("slow", (Field("n", NUMERIC),)), spark.range(4).select(F.col("id").cast("string").alias(KEY), slow(F.col("id").cast("double")).alias("n")))
    with pytest.raises(QueryError, match="longer than 300 ms"):
        engine.rows("FT.SEARCH slow @n:[1,2] TIMEOUT 300")
    with pytest.raises(QueryError):
        engine.rows("FT.SEARCH quick * TIMEOUT 60001")


def test_array_values(spark):
    from quern.functions.values import ARR, NUM, STR, Val, array_element, array_length, flattened, is_array
    from pyspark.sql import functions as F

    a, n = Val(F.array(F.lit("x"), F.lit("y")), ARR), lambda x: Val(F.lit(x), NUM)
    cases = [array_length(a), array_element(a, n(1.0)), array_element(a, n(2.0)), array_element(a, n(-1.0)), array_element(a, n(0.5)), is_array(a), is_array(n(1.0)), array_length(n(1.0)), flattened(a, n(0.0)), flattened(n(1.0), n(1.0)), array_element(Val(F.lit("s"), STR), n(0.0))]
    assert list(spark.range(1).select(*(v.col.alias(f"c{i}") for i, v in enumerate(cases))).first()) == [2.0, "y", None, None, None, True, False, None, ["x", "y"], None, None]


def test_binary_vectors(spark):
    import struct

    values = [(0.0, 1.5, -2.25), (1e-40, 3.4e38, -0.0)]
    rows = [(str(i), bytearray(struct.pack("<3f", *v))) for i, v in enumerate(values)] + [("2", bytearray(b"123"))]
    engine = Engine(spark)
    engine.create(IndexSchema("b", (Field("v", VECTOR, dim=3),)), spark.createDataFrame(rows, f"{KEY} string, v binary"))
    got = {r[KEY]: r["__vector_v"] for r in engine.prepared("b").collect()}
    for i, v in enumerate(values):
        assert struct.pack("<3f", *got[str(i)]) == struct.pack("<3f", *v) or got[str(i)] == pytest.approx(v)
    assert got["2"] is None
