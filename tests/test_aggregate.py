"""Expressions, functions, stages and reducers."""

import math

import pytest

from quern import KEY, NUMERIC, TAG, TEXT, VECTOR, Apply, Engine, Field, Filter, GroupBy, IndexSchema, Limit, Load, QueryError, Reduce, Settings, SortBy

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def one(spark):
    """An index of one document, to evaluate expressions over."""
    rows = spark.createDataFrame([("k", "7", "abc", None, None)], f"{KEY} string, n string, s string, gone string, lost string")
    fields = (Field("n", NUMERIC), Field("s", TAG), Field("gone", NUMERIC), Field("lost", TAG))

    def make(settings=None):
        e = Engine(spark, settings)
        e.create(IndexSchema("i", fields), rows)
        return e

    return make(), make(Settings(emulate=(1, 2, 1)))


def value(engine, expr, **params):
    return engine.aggregate("i", "*", Apply(expr, "r"), params=params).first().r


def same(got, want):
    if isinstance(want, float) and math.isnan(want):
        return isinstance(got, float) and math.isnan(got)
    if isinstance(want, float) and isinstance(got, float) and not math.isinf(want):
        return got == pytest.approx(want)
    return got == want


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("2*-2^4", 256.0), ("2/-2^4", 1.0), ("0*0^0", 1.0), ("1<=2<=3", True), ("1==2==3", False), ("0/0<0", False), ("0/0<=0", True), ("0/0==1", True), ("0/0!=1", False), ("1--1-1", 1.0),
        ("1+2*3", 7.0), ("(1+2)*3", 9.0), ("1/0", NAN), ("+inf", INF), ("-inf", -INF), ("1e3 + .5", 1000.5), ("!0", True), ("!1", False), ("!@gone", True), ("!'a'", True),
        ("'1'+1", 2.0), ("''+1", 1.0), ("'a'+1", None), ("@n+1", 8.0), ("@gone+1", None), ("@gone==@lost", True), ("@gone==1", True), ("@gone<1", False), ("@gone!=1", False), ("'10'<'9'", True), ("'10'<9", False), ("'a'<9", False),
        ("1 && 0", False), ("1 || 0", True), ("'x' && 1", False), ("0/0 && 1", True),
        ("substr('abc',-1,2)", "c"), ("substr('abc',3,1)", ""), ("substr('abc',2,10)", "c"), ("substr('abc',1,-1)", "b"), ("substr('abc',4,1)", ""), ("substr('abc',0,0)", ""), ("substr('abc','x',1)", None), ("substr(@lost,0,1)", None),
        ("contains('abc','')", 4.0), ("contains('abcabc','abc')", 2.0), ("contains('aaa','aa')", 1.0), ("concat()", ""), ("concat('a',1,1.5)", "a11.5"), ("concat('a',@lost)", None), ("exists(@gone)", False), ("exists(@n)", True),
        ("lower('ÀBC')", "Àbc"), ("upper('éa')", "éA"), ("lower(12)", "12"), ("strlen('é')", 2.0), ("strlen(100000)", 5.0), ("startswith('abc','ab')", True), ("startswith(@lost,'a')", None),
        ("abs(-3)", 3.0), ("ceil(1.2)", 2.0), ("floor(-1.2)", -2.0), ("floor(+inf)", INF), ("log(0)", -INF), ("log(-1)", NAN), ("log2(8)", 3.0), ("exp(0)", 1.0), ("sqrt(-1)", NAN), ("abs('x')", None), ("sqrt(@gone)", None),
        ("concat(100000)", "1e+05"), ("concat(120000)", "120000"), ("concat(0.001)", "0.001"), ("concat(0.0001)", "1e-04"), ("concat(1e300)", "1e+300"), ("concat(-2.5)", "-2.5"), ("concat(0)", "0"), ("concat(0/0)", "nan"), ("concat(-inf)", "-inf"), ("concat(1==1)", "1"), ("concat(1234567.5)", "1234567.5"), ("concat(12000000)", "1.2e+07"),
        ("dayofweek(0)", 4.0), ("dayofmonth(86400)", 2.0), ("dayofyear(86400)", 1.0), ("monthofyear(0)", 0.0), ("year(0)", 1970.0), ("year(-1)", 1969.0), ("minute(119)", 60.0), ("hour(7201)", 7200.0), ("day(100000)", 86400.0), ("month(5000000)", 5011200.0 - 31 * 86400 + 0 * 1.0 - 86400 + 28 * 86400 - 28 * 86400 + 31 * 86400 - 2332800.0),
        ("timefmt(0)", "1970-01-01T00:00:00Z"), ("timefmt(0,'')", ""), ("timefmt(0,'%d %b %y%% %e')", "01 Jan 70%  1"), ("timefmt(0,'%U')", "00"), ("parsetime('1970-01-02','%Y-%m-%d')", 86400.0), ("parsetime('x','%Y')", -2209075200.0), ("parsetime('1970-01-01T00:01:00Z')", 60.0), ("year(+inf)", None),
    ],
)
def test_expressions(one, expr, want):
    if expr.startswith("month(5"):
        want = 2678400.0 - 86400  # the last day before February's first
    assert same(value(one[0], expr), want)


@pytest.mark.parametrize(
    ("expr", "want"),
    [("'x' && 1", True), ("abs('x')", NAN), ("abs(@gone)", None), ("lower(12)", None), ("month(5000000)", 2678400.0), ("year(-1)", None), ("timefmt(0,'')", None), ("parsetime('x','%Y')", None), ("hour(-5)", None), ("timefmt(-1)", "1969-12-31T23:59:59Z")],
)
def test_newer_releases(one, expr, want):
    assert same(value(one[1], expr), want)


def test_parameters(one):
    assert value(one[0], "$one+1", one="1") == 2.0
    for bad in ("$two+1", "@xx", "exists(@xx)", "", "!", "!()", "1 +", "nofn(1)", "abs()", "abs(1,2)", "(1", "'a", "1 % 2", "inf", "5 5"):
        with pytest.raises(QueryError):
            value(one[0], bad)
    with pytest.raises(QueryError):
        one[0].aggregate("i", "*", Apply("1", "r"), params={"unused": "1"})


@pytest.fixture(scope="module")
def shop(spark):
    rows = spark.range(1, 1001).selectExpr(f"format_string('p:%04d', id) AS {KEY}", "cast(id as string) AS price", "cast((id - 1) % 100 + 1 as string) AS rating", "if(id % 2 = 1, 'electronics', 'books') AS category", "cast(null as string) AS nothing", "array(1f, 2f) AS v", "concat('word', id % 3) AS t")
    e = Engine(spark)
    e.create(IndexSchema("s", (Field("price", NUMERIC), Field("rating", NUMERIC), Field("category", TAG), Field("nothing", NUMERIC), Field("v", VECTOR, dim=2), Field("t", TEXT))), rows)
    return e


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(shop):
    price = Load(("price",))
    assert [r.price for r in shop.aggregate("s", "*", price, SortBy((("@price", False),)), Limit(0, 3)).collect()] == [1000.0, 999.0, 998.0]
    assert [r.price for r in shop.aggregate("s", "*", price, SortBy((("@price", False),), 5)).collect()] == [1000.0, 999.0, 998.0, 997.0, 996.0]
    assert shop.aggregate("s", "*", price, SortBy((("@price", True),))).count() == 10
    assert table(shop.aggregate("s", "@price:[1 1000]", price, Filter("@price > 998"))) == [(1000.0,), (999.0,)]
    by = GroupBy(("category",), (Reduce("COUNT", (), "n"),))
    assert table(shop.aggregate("s", "*", by)) == [("books", 500.0), ("electronics", 500.0)]

    def reduced(query, r):
        return dict(table(shop.aggregate("s", query, GroupBy(("category",), (r,)))))

    assert reduced("@price:[1 10]", Reduce("SUM", ("@price",))) == {"electronics": 25.0, "books": 30.0}
    assert reduced("@price:[1 4]", Reduce("AVG", ("@price",))) == {"electronics": 2.0, "books": 3.0}
    assert reduced("*", Reduce("MIN", ("@price",))) == {"electronics": 1.0, "books": 2.0} and reduced("*", Reduce("MAX", ("@price",))) == {"electronics": 999.0, "books": 1000.0}
    assert reduced("*", Reduce("COUNT_DISTINCT", ("@rating",))) == {"electronics": 50.0, "books": 50.0}
    assert reduced("@price:[1 8]", Reduce("STDDEV", ("@price",)))["books"] == pytest.approx(2.581989) and reduced("@price:[1 1]", Reduce("STDDEV", ("@price",))) == {"electronics": 0.0}
    assert reduced("*", Reduce("SUM", ("@nothing",))) == {"electronics": 0.0, "books": 0.0} and reduced("*", Reduce("MIN", ("@nothing",))) == {"electronics": None, "books": None}
    assert reduced("@price:[1 6]", Reduce("TOLIST", ("@rating",))) == {"electronics": [1.0, 3.0, 5.0], "books": [2.0, 4.0, 6.0]}
    assert reduced("*", Reduce("FIRST_VALUE", ("@price",))) == {"electronics": 1.0, "books": 2.0}
    assert reduced("*", Reduce("FIRST_VALUE", ("@price",), None, ("@rating", False))) == {"electronics": 99.0, "books": 100.0}
    assert reduced("*", Reduce("FIRST_VALUE", ("@price",), None, ("@t", False))) == {"electronics": 5.0, "books": 2.0}
    assert reduced("*", Reduce("FIRST_VALUE", ("@price",), None, ("@nothing", True))) == {"electronics": None, "books": None}


def test_names_and_arrays(shop):
    df = shop.aggregate("s", "*", GroupBy(("category",), (Reduce("count_distinct", ("@rating",)), Reduce("FIRST_VALUE", ("@price",), None, ("@rating", False), True))))
    assert df.columns == ["category", "COUNT_DISTINCT(@rating)", "FIRST_VALUE(@price,@rating,DESC)"]
    lists = GroupBy(("category",), (Reduce("TOLIST", ("@rating",), "r"),))
    got = dict(table(shop.aggregate("s", "@price:[1 4]", lists, Apply("@r * 2", "d"), Apply("@d + @r", "e"), Apply("substr(@r,0,1)", "f")).select("category", "e")))
    assert got == {"electronics": [3.0, 9.0], "books": [6.0, 12.0]}
    assert table(shop.aggregate("s", "@price:[1 4]", lists, Apply("upper(@r)", "u")).select("u")) == [(["1", "3"],), (["2", "4"],)]
    again = shop.aggregate("s", "@price:[1 6]", GroupBy(("category", "t"), (Reduce("TOLIST", ("@price",), "p"),)), GroupBy(("category",), (Reduce("TOLIST", ("@p",), "all"),)))
    assert dict(table(again)) == {"electronics": [1.0, 3.0, 5.0], "books": [2.0, 4.0, 6.0]}


def test_nil_groups_and_refusals(shop, spark):
    assert table(shop.aggregate("s", "*", GroupBy(("nothing",), (Reduce("COUNT", (), "n"),)))) == [(None, 1000.0)]
    for bad in (Load(("v",)), Load(("missing",)), GroupBy(()), GroupBy(("missing",)), GroupBy(("category",), (Reduce("NOPE", ()),)), GroupBy(("category",), (Reduce("SUM", ()),)), Apply("@v", "x")):
        with pytest.raises(QueryError):
            shop.aggregate("s", "*", bad)
    with pytest.raises(QueryError):
        shop.aggregate("s", "*", GroupBy(("category",)), Apply("@price", "x"))
    assert shop.aggregate("s", "*", GroupBy(("category",))).count() == 2
    assert shop.aggregate("s", "*=>[KNN 3 @v $q AS d]", GroupBy(("d",), (Reduce("COUNT", (), "n"),)), params={"q": [1.0, 2.0]}).collect() == [(0.0, 3.0)]


def test_commands(shop):
    line = "FT.AGGREGATE s '@price:[1 100]' LOAD 2 @price category APPLY '@price * $f' AS x FILTER '@x > 100' GROUPBY 1 @category REDUCE COUNT 0 AS n REDUCE FIRST_VALUE 4 @price BY @price DESC AS top SORTBY 2 @n DESC MAX 5 LIMIT 0 10 PARAMS 2 f 2 DIALECT 3"
    assert table(shop.execute(line)) == [("books", 25.0, 100.0), ("electronics", 25.0, 99.0)]
    for bad in ("FT.AGGREGATE s * GROUPBY 1 category", "FT.AGGREGATE s * APPLY 1", "FT.AGGREGATE s * NOPE", "FT.AGGREGATE s * GROUPBY 1 @category REDUCE FIRST_VALUE 2 @price BY", "FT.SEARCH s * LIMIT 0", "FT.NOPE"):
        with pytest.raises(QueryError):
            shop.execute(bad)


def test_strict_load(spark, shop):
    found = shop.index("s")
    e = Engine(spark, Settings(strict_load=True))
    e.create(found.schema, found.source)
    assert e.aggregate("s", "@price:[1 1]", Load(("rating",)), Apply("@price", "p"), Apply("@rating", "r")).first().asDict() == {"rating": 1.0, "p": None, "r": 1.0}


def test_stream_of_changes(spark, tmp_path):
    from quern.streaming.upsert import UpsertTable

    batches = [[("a", 1, False, "x"), ("b", 1, False, "y")], [("a", 3, False, "z"), ("b", 2, True, None), ("c", 1, False, "w")], [("a", 2, False, "late")]]
    schema = f"{KEY} string, __seq long, __deleted boolean, v string"
    table_ = UpsertTable(spark, str(tmp_path / "docs"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = table_.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "ckpt"))
        query.awaitTermination()
        assert table_.versions() == list(range(n + 1))
    assert table(table_.documents()) == [("a", "z"), ("c", "w")]
    table_.apply(spark.createDataFrame(batches[2], schema), 2)  # run again: the same version
    assert table(table_.documents()) == [("a", "z"), ("c", "w")]
    table_.vacuum()
    assert table_.versions() == [1, 2]
    e = Engine(spark)
    e.create(IndexSchema("d", (Field("v", TAG),)), table_.documents())
    assert [r[KEY] for r in e.search("d", "@v:{z}").collect()] == ["a"]


def test_upsert_touches_few_buckets(spark, tmp_path):
    """A batch rewrites the buckets of its keys alone; deletion marks go with compact(); an empty batch changes nothing."""
    import os

    from quern.streaming.upsert import UpsertTable

    schema = f"{KEY} string, __seq long, __deleted boolean, v string"
    t = UpsertTable(spark, str(tmp_path / "t"), buckets=16)
    assert t.documents() is None
    t.apply(spark.range(400).selectExpr(f"cast(id as string) {KEY}", "1L __seq", "false __deleted", "'old' v"), 0)
    t.apply(spark.createDataFrame([("7", 2, False, "new"), ("8", 2, True, None), ("900", 2, False, "new")], schema), 1)
    assert len(os.listdir(tmp_path / "t/data/v=0")) >= 16 and sum(x.startswith("__bucket=") for x in os.listdir(tmp_path / "t/data/v=1")) <= 3
    t.apply(spark.createDataFrame([], schema), 2)
    assert sorted(set(t.index(2).values())) == [0, 1] and t.documents().count() == 400 and t.state().count() == 401
    assert {r[KEY] for r in t.documents().where("v = 'new'").collect()} == {"7", "900"}
    t.compact(3, 3)
    assert t.state().count() == t.documents().count() == 400
    t.vacuum()
    assert t.versions() == [2, 3] and t.documents().count() == 400
    t.apply(spark.createDataFrame([("7", 9, True, None)], schema), 4)
    t.vacuum()
    assert t.versions() == [3, 4] and sorted(x for x in os.listdir(tmp_path / "t/data") if x.startswith("v=")) == ["v=3", "v=4"]
    assert t.documents().count() == 399
    gone = UpsertTable(spark, str(tmp_path / "gone"))
    gone.apply(spark.createDataFrame([("7", 9, True, None)], schema), 0)
    gone.compact(1, 10)
    assert gone.documents() is None


def test_user_functions(one):
    from pyspark.sql import functions as F

    from quern.functions.scalars import FUNCTIONS, register
    from quern.functions.values import NUM, Val, as_number

    @register("twice", 1)
    def twice(settings, v):
        return Val(as_number(v) * F.lit(2.0), NUM)

    try:
        assert value(one[0], "twice(@n)") == 14.0
    finally:
        del FUNCTIONS["twice"]


def test_quantiles_and_distinct_counts_are_exact(spark):
    """Numbers of which each is its own rank, so that a rank beside the right one shows; Nil is left out, NaN is greatest, groups may be Nil."""
    n = 50_000
    rows = spark.range(1, n + 1, numPartitions=7).selectExpr(f"id AS {KEY}", "if(id % 2 = 0, 'even', null) AS g", f"cast(pmod(id * 7919, {n}) + 1 AS double) AS x", "if(id % 2 = 0, null, 1.0) AS y")
    e = Engine(spark)
    e.create(IndexSchema("i", (Field("g", TAG), Field("x", NUMERIC), Field("y", NUMERIC))), rows.withColumn(KEY, rows[KEY].cast("string")))

    def reduced(*reducers):
        return {r[0]: tuple(r)[1:] for r in e.aggregate("i", "*", Apply("@y / (@x - 2)", "z"), GroupBy(("g",), reducers)).collect()}

    shares = ("0", "0.00002", "0.07", "0.5", "0.70001", "0.99999", "1")
    got = reduced(*(Reduce("QUANTILE", ("@x", s), s) for s in shares), Reduce("COUNT_DISTINCTISH", ("@x",), "d"))
    ranks = (1, 1, 1750, 12_500, 17_501, 25_000, 25_000)
    assert got == {"even": (*(2.0 * r - 1 for r in ranks), 25_000.0), None: (*(2.0 * r for r in ranks), 25_000.0)}
    between = reduced(Reduce("COUNT", (), "n"), Reduce("QUANTILE", ("@y", "0.5"), "q"), Reduce("MAX", ("@x",), "m"), Reduce("QUANTILE", ("@x", "1"), "p"))
    assert between == {"even": (25_000.0, None, 49_999.0, 49_999.0), None: (25_000.0, 1.0, 50_000.0, 50_000.0)}
    last = reduced(Reduce("QUANTILE", ("@z", "1")), Reduce("QUANTILE", ("@z", "0.99996")))
    assert math.isnan(last[None][0]) and last[None][1] == 0.5 and last["even"] == (None, None)
    for share in ("@x", "1.1", "-1", "'a'"):
        with pytest.raises(QueryError):
            reduced(Reduce("QUANTILE", ("@x", share)))
