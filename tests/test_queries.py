"""Every query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from quern.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df, want = QUERIES[name](spark, D), db.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    """What each scan is given to test."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return [line.split("PushedFilters: [")[1].split("], ReadSchema")[0] for line in plan(df).split("\n") if "PushedFilters: [" in line]


@pytest.mark.parametrize(
    ("name", "filters"),
    [
        ("num_range", ["GreaterThanOrEqual(o_totalprice,100000.0)", "LessThanOrEqual(o_totalprice,200000.0)"]),
        ("num_exclusive", ["GreaterThan(o_totalprice,100000.0)", "LessThan(o_totalprice,200000.0)"]),
        ("num_inf", ["GreaterThan(o_totalprice,250000.0)"]),
        ("num_minus_inf", ["LessThanOrEqual(o_totalprice,5000.0)"]),
        ("bool_and", ["GreaterThanOrEqual(o_totalprice,100000.0)", "StringContains(o_orderstatus,o)", "StringContains(o_orderstatus,O)"]),
        ("bool_or", ["GreaterThan(o_totalprice,290000.0)", "StringContains(o_orderstatus,P)"]),
        ("bool_precedence", ["LessThanOrEqual(o_totalprice,100000.0)", "GreaterThanOrEqual(o_totalprice,200000.0)", "StringContains(o_orderstatus,F)"]),
        ("tag_exact", ["StringContains(o_orderstatus,F)"]),
        ("tag_case", ["StringContains(p_type,SMALL)", "StringContains(p_type,ECONOMY)"]),
        ("search_limit_offset", ["StringContains(o_orderstatus,O)"]),
        ("agg_group_multi", ["GreaterThanOrEqual(value,0.0)", "LessThanOrEqual(value,50.0)"]),
        ("agg_apply_chain", ["GreaterThanOrEqual(l_quantity,45.0)"]),
        ("knn_k_gt_n", ["GreaterThanOrEqual(vec_id,0)", "LessThanOrEqual(vec_id,30)"]),
        ("knn_hybrid", ["GreaterThanOrEqual(label,2)", "LessThanOrEqual(label,5)"]),
    ],
)
def test_pushed_filters(spark, name, filters):
    """Ranges and tags reach the scan, by the column's name."""
    found = " ".join(pushed(QUERIES[name](spark, D)))
    assert all(f in found for f in filters), found


def test_stored_keys_are_pruned_by_prefix(spark, tmp_path):
    from quern import KEY, NUMERIC, Engine, Field, IndexSchema

    spark.range(100).selectExpr(f"concat(if(id < 50, 'a:', 'b:'), id) AS {KEY}", "id AS n").write.parquet(f"{tmp_path}/t")
    e = Engine(spark)
    e.create(IndexSchema("i", (Field("n", NUMERIC),), prefixes=("a:",)), spark.read.parquet(f"{tmp_path}/t"))
    df = e.search("i", "@n:[10 60]", limit=None, nocontent=True)
    assert f"StringStartsWith({KEY},a:)" in pushed(df)[0] and df.count() == 40


def test_plans(spark):
    """Columns are pruned, a page is one top-k; nothing leaves the JVM but words for stems and edit distances; no job runs before the result is asked for."""
    p = plan(QUERIES["num_range"](spark, D))
    assert "o_orderpriority" not in p.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan(QUERIES["search_sort_desc"](spark, D))
    assert not any("Python" in plan(QUERIES[n](spark, D)) for n in ("text_phrase", "agg_two_groupbys", "text_slop", "text_slop_five", "text_prefix", "text_suffix"))
    assert "CartesianProduct" not in plan(QUERIES["knn_hybrid"](spark, D))
    spark.sparkContext.setJobGroup("lazy", "")
    for n in ("text_fuzzy_wide", "text_stem", "text_prefix"):
        QUERIES[n](spark, f"{D}")
    # a job each to read the table's schema
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) <= 3
    spark.sparkContext.setJobGroup("", "")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["text_prefix", "text_fuzzy"])
def test_no_cap_on_words(spark, tmp_path, name):
    """Each document holds a word of its own, over 200 in all."""
    more = "abcdefghijklmnopqrstuvwxyz0123456789"
    if name == "text_prefix":
        words = sorted({"license" + x + y for x in more for y in "abcdefg"})
    else:
        words = sorted({"licence"[:at] + x + "licence"[at:] for x in more for at in range(8)})
    spark.createDataFrame([(i, w, "en", "a", len(w)) for i, w in enumerate(words)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(words) > 200
    assert {r.key for r in QUERIES[name](spark, str(tmp_path)).collect()} == {f"doc:{i}" for i in range(len(words))}


def test_quantile_and_distinct_are_exact(spark, tmp_path):
    """More line numbers than an estimate counts right: six copies, each with line numbers of its own."""
    con = duckdb.connect()
    con.sql(f"copy (select * replace (cast(l_linenumber + 7 * copies.i as integer) as l_linenumber) from '{D}/lineitem.parquet', range(6) copies(i)) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = [(r.l_returnflag, r.q, r.d) for r in QUERIES["agg_quantile"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(ORACLES["agg_quantile"]).fetchall()) and {d for _, _, d in got} == {42.0}
