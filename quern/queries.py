"""The engine's queries by name, over the test tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.operators.aggregate import Apply, Filter, GroupBy, Limit, Load, Reduce, SortBy, Stage
from quern.plans.schema import KEY, NUMERIC, STOP_WORDS, TAG, TEXT, VECTOR, Field, IndexSchema, Settings
from quern.sources.tables import keyed

#: The indexes by name: table, key prefix and columns, definition, further columns.
INDEXES: dict[str, tuple[str, str, tuple[str, ...], tuple[Field, ...]]] = {
    "orders": ("orders", "order:", ("o_orderkey",), (Field("o_orderkey", NUMERIC), Field("o_totalprice", NUMERIC), Field("o_orderstatus", TAG), Field("o_orderpriority", TAG), Field("o_custkey", NUMERIC), Field("day", NUMERIC))),
    "lineitem": ("lineitem", "", ("l_orderkey", "l_linenumber"), (*(Field(f"l_{n}", NUMERIC) for n in ("orderkey", "linenumber", "quantity", "extendedprice", "discount", "tax")), Field("l_returnflag", TAG), Field("l_linestatus", TAG), Field("flags", TAG), Field("shipped", NUMERIC))),
    "events": ("events", "event:", ("event_id",), (Field("event_id", NUMERIC), Field("value", NUMERIC), Field("event_type", TAG), Field("at", NUMERIC), Field("user_id", NUMERIC))),
    "part": ("part", "part:", ("p_partkey",), (Field("p_name", TEXT, suffix=True, stem=False), Field("p_brand", TAG), Field("p_type", TAG, case_sensitive=True), Field("p_size", NUMERIC), Field("p_retailprice", NUMERIC), Field("p_partkey", NUMERIC))),
    "docs": ("documents", "doc:", ("doc_id",), (Field("text", TEXT, stem=False, suffix=True), Field("lang", TAG), Field("source", TAG), Field("n_chars", NUMERIC), Field("doc_id", NUMERIC))),
    "stems": ("documents", "doc:", ("doc_id",), (Field("text", TEXT), Field("lang", TAG))),
    **{f"vec_{m.lower()}": ("embeddings", "vec:", ("vec_id",), (Field("embedding", VECTOR, dim=64, metric=m), Field("label", NUMERIC), Field("vec_id", NUMERIC))) for m in ("L2", "IP", "COSINE")},
    "json_events": ("events", "event:", ("event_id",), (Field("k", NUMERIC, "$.k"), Field("event_id", NUMERIC))),
}


def source(spark: SparkSession, sf_dir: str, index: str) -> DataFrame:
    table, prefix, columns, _ = INDEXES[index]
    df = keyed(spark.read.parquet(f"{sf_dir}/{table}.parquet"), prefix, *columns)
    if index == "orders":
        df = df.withColumn("day", F.unix_timestamp("o_orderdate"))
    elif index == "lineitem":
        df = df.withColumn("flags", F.concat_ws(",", "l_returnflag", "l_linestatus")).withColumn("shipped", F.unix_timestamp("l_shipdate"))
    elif index == "events":
        df = df.withColumn("at", F.unix_timestamp("ts"))
    elif index == "json_events":
        df = df.withColumn("$", F.col("props"))
    return df


def engine(spark: SparkSession, sf_dir: str, index: str, settings: Settings | None = None, prefixes: tuple[str, ...] = ()) -> Engine:
    e = Engine(spark, settings)
    e.create(IndexSchema(index, INDEXES[index][3], "JSON" if index.startswith("json") else "HASH", prefixes), source(spark, sf_dir, index))
    return e


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def add_search(name: str, index: str, query: str, sql: str | None, columns: dict[str, str] | None = None, settings: Settings | None = None, prefixes: tuple[str, ...] = (), **options) -> None:
    """A search whose whole result is returned (key alone, or the named fields); a LIMIT stands only where paging is the feature."""
    options.setdefault("limit", None)
    if columns is None:
        options.setdefault("nocontent", True)
    else:
        options["returns"] = tuple(columns.items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, index, settings, prefixes).search(index, query, **options).withColumnRenamed(KEY, "key")

    add(name, run, sql)


def add_aggregate(name: str, index: str, query: str, stages: list[Stage], sql: str | None, rounded: tuple[str, ...] = (), digits: int = 4, settings: Settings | None = None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, index, settings).aggregate(index, query, *stages, **options)
        return df.withColumns({c: F.round(F.col(c), digits) for c in rounded}) if rounded else df

    add(name, run, sql)


ORDER = "'order:' || o_orderkey AS key"
PART = "'part:' || p_partkey AS key"
DOC = "'doc:' || doc_id AS key"
LINE = "l_orderkey || ':' || l_linenumber AS key"
LINE_KEY = "l_orderkey || ':' || l_linenumber AS __key"

# -- predicates

for _name, _query, _where in (
    ("num_range", "@o_totalprice:[100000 200000]", "o_totalprice BETWEEN 100000 AND 200000"),
    ("num_exclusive", "@o_totalprice:[(100000 (200000]", "o_totalprice > 100000 AND o_totalprice < 200000"),
    ("num_inf", "@o_totalprice:[(250000 inf]", "o_totalprice > 250000"),
    ("num_minus_inf", "@o_totalprice:[-inf 5e3]", "o_totalprice <= 5000"),
    ("match_all", "*", "true"),
    ("tag_exact", "@o_orderstatus:{F}", "o_orderstatus = 'F'"),
    ("tag_multi", "@o_orderpriority:{1-urgent|2-HIGH}", "lower(o_orderpriority) IN ('1-urgent', '2-high')"),
    ("tag_prefix", "@o_orderpriority:{4-n*}", "lower(o_orderpriority) LIKE '4-n%'"),
    ("bool_and", "@o_orderstatus:{O} @o_totalprice:[100000 150000]", "o_orderstatus = 'O' AND o_totalprice BETWEEN 100000 AND 150000"),
    ("bool_or", "@o_orderstatus:{P} | @o_totalprice:[(290000 +inf]", "o_orderstatus = 'P' OR o_totalprice > 290000"),
    ("bool_not", "-@o_orderstatus:{F|O}", "NOT coalesce(o_orderstatus IN ('F', 'O'), false)"),
    ("bool_nested", "(@o_orderstatus:{F} | -(@o_totalprice:[0 200000])) -@o_orderpriority:{1-URGENT}", "(o_orderstatus = 'F' OR NOT o_totalprice BETWEEN 0 AND 200000) AND o_orderpriority <> '1-URGENT'"),
    ("bool_precedence", "@o_orderstatus:{P} @o_totalprice:[0 100000] | @o_orderstatus:{F} @o_totalprice:[200000 inf]", "(o_orderstatus = 'P' AND o_totalprice BETWEEN 0 AND 100000) OR (o_orderstatus = 'F' AND o_totalprice >= 200000)"),
):
    add_search(_name, "orders", _query, f"SELECT {ORDER} FROM orders WHERE {_where}")
add_search("tag_case", "part", "@p_type:{SMALL*|ECONOMY*}", f"SELECT {PART} FROM part WHERE p_type LIKE 'SMALL%' OR p_type LIKE 'ECONOMY%'")
add_search("tag_multivalue", "lineitem", "@flags:{r} @flags:{f|o}", f"SELECT {LINE} FROM lineitem WHERE list_contains(string_split(lower(l_returnflag || ',' || l_linestatus), ','), 'r') AND (list_contains(string_split(lower(l_returnflag || ',' || l_linestatus), ','), 'f') OR list_contains(string_split(lower(l_returnflag || ',' || l_linestatus), ','), 'o'))")
add_search("prefix_filter", "orders", "*", f"SELECT {ORDER} FROM orders WHERE ('order:' || o_orderkey) LIKE 'order:1%'", prefixes=("order:1",))
add_search("json_path", "json_events", "@k:[10 20]", "SELECT 'event:' || event_id AS key, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20", {"$.k": "k"})

# -- projection, order, pages

add_search("search_return_alias", "orders", "@o_totalprice:[300000 inf]", f"SELECT {ORDER}, o_totalprice AS price, o_orderstatus AS o_orderstatus FROM orders WHERE o_totalprice >= 300000", {"o_totalprice": "price", "o_orderstatus": "o_orderstatus"})
add_search("search_sort_asc", "orders", "@o_orderstatus:{F}", f"SELECT {ORDER}, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, key LIMIT 25", {"o_totalprice": "price"}, sortby=("o_totalprice", True), limit=(0, 25))
add_search("search_sort_desc", "orders", "@o_totalprice:[100000 200000] @o_orderstatus:{F}", f"SELECT {ORDER}, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000 ORDER BY o_totalprice DESC, key LIMIT 10", {"o_totalprice": "price"}, sortby=("o_totalprice", False), limit=(0, 10))
add_search("search_sort_text", "part", "*", f"SELECT {PART}, p_brand AS b FROM part ORDER BY p_brand DESC, key LIMIT 40", {"p_brand": "b"}, sortby=("p_brand", False), limit=(0, 40))
add_search("search_limit_offset", "orders", "@o_orderstatus:{O}", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'O' ORDER BY key LIMIT 30 OFFSET 20", limit=(20, 30))
add_search("search_nocontent", "orders", "@o_orderstatus:{P}", f"SELECT {ORDER} FROM orders WHERE o_orderstatus = 'P'")
add_search("search_sortkeys", "orders", "*", f"SELECT {ORDER}, '#' || o_orderpriority AS __sortkey FROM orders ORDER BY o_orderpriority, key LIMIT 15", sortby=("o_orderpriority", True), with_sort_keys=True, limit=(0, 15))

# -- text

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[\\x00-\\x20\\x7f,.<>{{}}\\[\\]\"'':;!@#$%^&*()\\-+=~/\\\\|?]+'), lambda w: w <> '')"
_PART_WORDS, _DOC_WORDS = _WORDS.format("p_name"), _WORDS.format("text")
#: DuckDB folds the case of letters as Spark does in these texts; ß alone is folded further.
_DOC_WORDS = _WORDS.format("replace(text, 'ß', 'ss')")
add_search("text_term", "docs", "@text:idiot", f"SELECT {DOC} FROM documents WHERE list_contains({_DOC_WORDS}, 'idiot')")
add_search("text_term_part", "part", "@p_name:widget -@p_name:red", f"SELECT {PART} FROM part WHERE list_contains({_PART_WORDS}, 'widget') AND NOT list_contains({_PART_WORDS}, 'red')")
add_search("text_prefix", "docs", "license*", f"SELECT {DOC} FROM documents WHERE len(list_filter({_DOC_WORDS}, lambda w: starts_with(w, 'license'))) > 0")
add_search("text_prefix_uncapped", "docs", "@text:er*", f"SELECT {DOC} FROM documents WHERE len(list_filter({_DOC_WORDS}, lambda w: starts_with(w, 'er'))) > 0")
#: The capped form: of the words that begin so, the first 200 by their spelling count.
add_search("text_prefix_capped", "docs", "@text:e*", f"WITH d AS (SELECT doc_id, {_DOC_WORDS} AS words FROM documents), w AS (SELECT DISTINCT w FROM (SELECT unnest(words) AS w FROM d) WHERE starts_with(w, 'e') ORDER BY w LIMIT 200) SELECT {DOC} FROM d WHERE list_has_any(words, (SELECT list(w) FROM w))", settings=Settings(max_term_expansions=200))
add_search("text_suffix", "docs", "@text:*heit", f"SELECT {DOC} FROM documents WHERE len(list_filter({_DOC_WORDS}, lambda w: ends_with(w, 'heit'))) > 0")
add_search("text_phrase", "docs", '"MIT License"', f"SELECT {DOC} FROM documents WHERE contains(' ' || array_to_string({_DOC_WORDS}, ' ') || ' ', ' mit license ')")
add_search("text_and_or_not", "docs", "(license | token) -@text:mit @lang:{en|fr}", f"SELECT {DOC} FROM documents WHERE (list_contains({_DOC_WORDS}, 'license') OR list_contains({_DOC_WORDS}, 'token')) AND NOT list_contains({_DOC_WORDS}, 'mit') AND lang IN ('en', 'fr')")
add_search("text_unfielded", "docs", "pathetic", f"SELECT {DOC} FROM documents WHERE list_contains({_DOC_WORDS}, 'pathetic')")
add_search("text_fuzzy", "docs", "%licence%", f"SELECT {DOC} FROM documents WHERE len(list_filter({_DOC_WORDS}, lambda w: abs(strlen(w) - 7) <= 1 AND damerau_levenshtein(w, 'licence') <= 1)) > 0")


def _two_edits(word: str) -> str:
    """SQL for at most two insertions, deletions, changes or swaps of neighbours, no part edited twice: two edits without a swap, or a swap and one edit elsewhere, or two swaps."""
    swapped = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    twice = {w[:k] + w[k + 1] + w[k] + w[k + 2 :] for i in range(len(word) - 1) for w in [word[:i] + word[i + 1] + word[i] + word[i + 2 :]] for k in range(len(word) - 1) if abs(i - k) > 1}
    tests = ["levenshtein(w, '" + word + "') <= 2", "w IN (" + ", ".join(f"'{x}'" for x in sorted(swapped | twice)) + ")"]
    for i in range(len(word) - 1):
        for at in range(max(0, i - 1), i + 2):
            tests.append(f"(substr(w, {at + 1}, 2) = '{word[i + 1]}{word[i]}' AND levenshtein(substr(w, 1, {at}), '{word[:i]}') + levenshtein(substr(w, {at + 3}), '{word[i + 2 :]}') <= 1)")
    return f"abs(strlen(w) - {len(word)}) <= 2 AND (" + " OR ".join(tests) + ")"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
#: So many words are so near that a usual cap would cut them.
add_search("text_fuzzy_wide", "docs", "%%than%%", f"WITH d AS (SELECT doc_id, {_DOC_WORDS} AS words FROM documents), v AS (SELECT list(w) AS near FROM (SELECT DISTINCT unnest(words) AS w FROM d) WHERE w NOT IN ({_STOP}) AND {_two_edits('than')}) SELECT {DOC} FROM d, v WHERE list_has_any(words, near)")
add_search("text_inorder", "docs", "released mit license", f"SELECT {DOC} FROM documents WHERE regexp_matches(' ' || array_to_string({_DOC_WORDS}, ' ') || ' ', ' released (.* )?mit (.* )?license ')", inorder=True)
add_search("text_slop", "docs", "released license", f"SELECT {DOC} FROM documents WHERE regexp_matches(' ' || array_to_string(list_filter({_DOC_WORDS}, lambda w: w NOT IN ('a','is','the','an','and','are','as','at','be','but','by','for','if','in','into','it','no','not','of','on','or','such','that','their','then','there','these','they','this','to','was','will','with')), ' ') || ' ', ' (released ([^ ]+ ){{0,2}}license|license ([^ ]+ ){{0,2}}released) ')".replace("{{", "{").replace("}}", "}"), slop=2)
_FIVE = "['from', 'th', 're', 'er', 'nd']"
#: Five words in any order, with 40 others at most among them.
add_search("text_slop_five", "docs", "from th re er nd", f"WITH d AS (SELECT doc_id, list_filter({_DOC_WORDS}, lambda w: w NOT IN ({_STOP})) AS ws FROM documents) SELECT {DOC} FROM d WHERE list_has_all(ws, {_FIVE}) AND len(list_filter(range(1, len(ws) + 1), lambda i: list_has_all(ws[i:i + 44], {_FIVE}))) > 0", slop=40)
#: The words that have its stem.
add_search("text_stem", "stems", "licensing", f"SELECT {DOC} FROM documents WHERE list_has_any({_DOC_WORDS}, ['licens', 'license', 'licensed', 'licensee', 'licenser', 'licenses', 'licensing', 'licensable', 'licensement'])")

# -- vectors: the query is the vector of vec_id 0


def _knn(name: str, metric: str, query: str, distance: str, where: str, k: int, **more) -> None:
    index = f"vec_{metric.lower()}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, index)
        first = source(spark, sf_dir, index).where("vec_id = 0").select("embedding").first()[0]
        hits = e.search(index, query, params={"q": list(first)}, limit=(0, 10_000), returns=(("__embedding_score", "score"), ("label", "label")))
        return hits.select(F.col(KEY).alias("key"), F.round("score", 5).alias("score"), "label")

    add(name, run, f"WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT 'vec:' || vec_id AS key, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE {where}) SELECT key, round({distance}, 5) AS score, label FROM d, q ORDER BY {distance}, key LIMIT {k}")


_knn("knn_l2", "L2", "*=>[KNN 20 @embedding $q]", "list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "true", 20)
_knn("knn_ip", "IP", "*=>[KNN 20 @embedding $q]", "(1 - list_dot_product(e, q))", "true", 20)
_knn("knn_cosine", "COSINE", "*=>[KNN 20 @embedding $q]", "(1 - list_cosine_similarity(e, q))", "true", 20)
_knn("knn_hybrid", "L2", "@label:[2 5]=>[KNN 15 @embedding $q EF_RUNTIME 50]", "list_sum(list_transform(list_zip(e, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "label BETWEEN 2 AND 5", 15)
_knn("knn_k_gt_n", "COSINE", "@vec_id:[0 30]=>[KNN 10000 @embedding $q]", "(1 - list_cosine_similarity(e, q))", "vec_id BETWEEN 0 AND 30", 10000)


def _knn_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = source(spark, sf_dir, "vec_l2").where("vec_id = 0").select("embedding").first()[0]
    df = engine(spark, sf_dir, "vec_l2").aggregate("vec_l2", "*=>[KNN 50 @embedding $q AS d]", GroupBy(("label",), (Reduce("COUNT", (), "n"), Reduce("MIN", ("@d",), "nearest"))), params={"q": list(first)})
    return df.withColumn("nearest", F.round("nearest", 5))


add("knn_agg", _knn_agg, "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), d AS (SELECT label, vec_id, list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM embeddings, q ORDER BY d, 'vec:' || vec_id LIMIT 50) SELECT CAST(label AS DOUBLE) AS label, CAST(count(*) AS DOUBLE) AS n, round(min(d), 5) AS nearest FROM d GROUP BY label")

# -- reducers

_BY_FLAG = "FROM lineitem GROUP BY l_returnflag, l_linestatus"
for _name, _reduce, _sql, _rounded in (
    ("agg_count", Reduce("COUNT", (), "r"), "CAST(count(*) AS DOUBLE)", ()),
    ("agg_sum", Reduce("SUM", ("@l_extendedprice",), "r"), "round(sum(l_extendedprice), 2)", ("r",)),
    ("agg_avg", Reduce("AVG", ("@l_discount",), "r"), "round(avg(l_discount), 4)", ("r",)),
    ("agg_min", Reduce("MIN", ("@l_quantity",), "r"), "min(l_quantity)", ()),
    ("agg_max", Reduce("MAX", ("@l_tax",), "r"), "max(l_tax)", ()),
    ("agg_stddev", Reduce("STDDEV", ("@l_quantity",), "r"), "round(coalesce(stddev_samp(l_quantity), 0), 4)", ("r",)),
    ("agg_count_distinct", Reduce("COUNT_DISTINCT", ("@l_orderkey",), "r"), "CAST(count(DISTINCT l_orderkey) AS DOUBLE)", ()),
    ("agg_tolist", Reduce("TOLIST", ("@l_linenumber",), "r"), "list_sort(list(DISTINCT CAST(l_linenumber AS DOUBLE)))", ()),
    ("agg_first_value_by_asc", Reduce("FIRST_VALUE", ("@l_orderkey",), "r", ("@l_extendedprice", True)), "CAST(arg_min(l_orderkey, (l_extendedprice, l_orderkey || ':' || l_linenumber)) AS DOUBLE)", ()),
    ("agg_first_value_by_desc", Reduce("FIRST_VALUE", ("@l_orderkey",), "r", ("@l_extendedprice", False)), "CAST(arg_min(l_orderkey, (-l_extendedprice, l_orderkey || ':' || l_linenumber)) AS DOUBLE)", ()),
):
    if _name == "agg_sum":  # to the cent: sums differ in their last digits by the order of addition

        def _run(spark: SparkSession, sf_dir: str, r: Reduce = _reduce) -> DataFrame:
            return engine(spark, sf_dir, "lineitem").aggregate("lineitem", "*", GroupBy(("l_returnflag", "l_linestatus"), (r,))).withColumn("r", F.round("r", 2))

        add(_name, _run, f"SELECT l_returnflag, l_linestatus, {_sql} AS r {_BY_FLAG}")
        continue
    add_aggregate(_name, "lineitem", "*", [GroupBy(("l_returnflag", "l_linestatus"), (_reduce,))], f"SELECT l_returnflag, l_linestatus, {_sql} AS r {_BY_FLAG}", _rounded)
add_aggregate("agg_group_multi", "events", "@value:[0 50]", [GroupBy(("event_type", "user_id"), (Reduce("COUNT", (), "n"), Reduce("MAX", ("@value",), "m")))], "SELECT event_type, CAST(user_id AS DOUBLE) AS user_id, CAST(count(*) AS DOUBLE) AS n, max(value) AS m FROM events WHERE value BETWEEN 0 AND 50 GROUP BY event_type, user_id")
add_aggregate("agg_first_value", "orders", "*", [GroupBy(("o_orderstatus",), (Reduce("FIRST_VALUE", ("@o_totalprice",), "r"),))], "SELECT o_orderstatus, arg_min(o_totalprice, 'order:' || o_orderkey) AS r FROM orders GROUP BY o_orderstatus")
add_aggregate("agg_group_none", "orders", "*", [GroupBy(("o_orderstatus", "o_orderpriority"))], "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
add_aggregate("agg_sort_default_max", "orders", "*", [Load(("o_orderkey", "o_totalprice")), SortBy((("@o_totalprice", False),))], "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, 'order:' || o_orderkey LIMIT 10")
add_aggregate("agg_sort_max", "orders", "@o_orderstatus:{F}", [Load(("__key", "o_custkey")), SortBy((("@o_custkey", True), ("@o_totalprice", False)), 25)], "SELECT 'order:' || o_orderkey AS __key, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_totalprice DESC, __key LIMIT 25")
add_aggregate("agg_filter", "orders", "*", [Load(("__key",)), Filter("@o_totalprice > 200000 && @o_orderstatus == 'F'")], "SELECT 'order:' || o_orderkey AS __key FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'", settings=Settings())
add_aggregate("agg_apply_chain", "lineitem", "@l_quantity:[45 inf]", [Load(("__key",)), Apply("@l_extendedprice * (1 - @l_discount)", "net"), Apply("@net * (1 + @l_tax)", "gross"), Filter("@gross > 50000")], f"SELECT {LINE_KEY}, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS gross FROM lineitem WHERE l_quantity >= 45 AND l_extendedprice * (1 - l_discount) * (1 + l_tax) > 50000", ("net", "gross"), 6)
add_aggregate("agg_two_groupbys", "orders", "*", [GroupBy(("o_custkey", "o_orderstatus"), (Reduce("COUNT", (), "n"),)), GroupBy(("o_orderstatus",), (Reduce("MAX", ("@n",), "most"), Reduce("COUNT", (), "customers")))], "SELECT o_orderstatus, CAST(max(n) AS DOUBLE) AS most, CAST(count(*) AS DOUBLE) AS customers FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
add_aggregate("agg_limit", "orders", "@o_orderstatus:{P}", [Load(("__key",)), Limit(5, 20)], "SELECT 'order:' || o_orderkey AS __key FROM orders WHERE o_orderstatus = 'P' ORDER BY __key LIMIT 20 OFFSET 5")
add_aggregate("agg_load_all", "orders", "@o_totalprice:[300000 inf]", [Load(None)], "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderstatus, o_orderpriority, CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(epoch(o_orderdate) AS DOUBLE) AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders WHERE o_totalprice >= 300000")
add_aggregate("agg_default_names", "events", "*", [GroupBy(("event_type",), (Reduce("COUNT"), Reduce("COUNT_DISTINCT", ("@user_id",))))], 'SELECT event_type, CAST(count(*) AS DOUBLE) AS "COUNT()", CAST(count(DISTINCT user_id) AS DOUBLE) AS "COUNT_DISTINCT(@user_id)" FROM events GROUP BY event_type')
add_aggregate("agg_quantile", "lineitem", "*", [GroupBy(("l_returnflag",), (Reduce("QUANTILE", ("@l_quantity", "0.5"), "q"), Reduce("COUNT_DISTINCTISH", ("@l_linenumber",), "d")))], "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS q, CAST(count(DISTINCT l_linenumber) AS DOUBLE) AS d FROM lineitem GROUP BY l_returnflag")

# -- scalar functions and operators, each over a whole table

_EPOCH = "CAST(epoch(date_trunc('second', ts)) AS DOUBLE)"
for _name, _expr, _sql in (
    ("fn_abs", "abs(@value - 50)", "abs(value - 50)"), ("fn_ceil", "ceil(@value)", "ceil(value)"), ("fn_floor", "floor(@value)", "floor(value)"),
    ("fn_exp", "exp(@value / 100)", "exp(value / 100)"), ("fn_log", "log(@value + 1)", "ln(value + 1)"), ("fn_log2", "log2(@value + 1)", "log2(value + 1)"), ("fn_sqrt", "sqrt(@value)", "sqrt(value)"),
    ("fn_exists", "exists(@value)", "value IS NOT NULL"), ("fn_lower", "lower(upper(@event_type))", "lower(event_type)"), ("fn_upper", "upper(@event_type)", "upper(event_type)"),
    ("fn_strlen", "strlen(@event_type)", "CAST(strlen(event_type) AS DOUBLE)"), ("fn_startswith", "startswith(@event_type, 'p')", "starts_with(event_type, 'p')"),
    ("fn_contains", "contains(@event_type, 'c')", "CAST(strlen(event_type) - strlen(replace(event_type, 'c', '')) AS DOUBLE)"), ("fn_substr", "substr(@event_type, 1, 3)", "substr(event_type, 2, 3)"),
    ("fn_substr_negative", "substr(@event_type, -3, 2)", "substr(event_type, strlen(event_type) - 2, 2)"), ("fn_concat", "concat(@event_type, '-', @user_id)", "event_type || '-' || user_id"),
    ("fn_dayofweek", "dayofweek(@at)", "CAST(dayofweek(ts) AS DOUBLE)"), ("fn_dayofmonth", "dayofmonth(@at)", "CAST(day(ts) AS DOUBLE)"), ("fn_dayofyear", "dayofyear(@at)", "CAST(dayofyear(ts) - 1 AS DOUBLE)"),
    ("fn_monthofyear", "monthofyear(@at)", "CAST(month(ts) - 1 AS DOUBLE)"), ("fn_year", "year(@at)", "CAST(year(ts) AS DOUBLE)"), ("fn_minute", "minute(@at)", f"floor({_EPOCH} / 60) * 60"),
    ("fn_hour", "hour(@at)", f"floor({_EPOCH} / 3600) * 3600"), ("fn_day", "day(@at)", f"floor({_EPOCH} / 86400) * 86400"), ("fn_month", "month(@at)", "CAST(epoch(date_trunc('month', ts)) AS DOUBLE) - 86400"),
    ("fn_timefmt", "timefmt(@at, '%Y/%m/%d %H:%M:%S day %j')", "strftime(ts, '%Y/%m/%d %H:%M:%S day %j')"), ("fn_parsetime", "parsetime(timefmt(@at), '%Y-%m-%dT%H:%M:%SZ')", _EPOCH),
    ("op_add", "@value + @user_id", "value + user_id"), ("op_subtract", "@value - 10", "value - 10"), ("op_multiply", "@value * 2.5", "value * 2.5"), ("op_divide", "@value / 4", "value / 4"),
    ("op_divide_zero", "!(@value / 0 < 1)", "true"), ("op_power", "@value ^ 2", "pow(value, 2)"), ("op_precedence", "1 + 2 * 3 ^ 2 - @value", "37 - value"), ("op_less", "@value < 50", "value < 50"),
    ("op_less_equal", "@value <= @user_id", "value <= user_id"), ("op_equal", "@event_type == 'click'", "event_type = 'click'"), ("op_not_equal", "@event_type != 'click'", "event_type <> 'click'"),
    ("op_greater", "@value > 50", "value > 50"), ("op_greater_equal", "@value >= 50", "value >= 50"), ("op_and", "@value > 20 && @value < 40", "value > 20 AND value < 40"), ("op_or", "@value < 20 || @value > 80", "value < 20 OR value > 80"),
    ("op_not", "!(@value > 50)", "NOT value > 50"), ("op_param", "@value + $add", "value + 7"),
):
    _float = _name in ("fn_abs", "fn_exp", "fn_log", "fn_log2", "fn_sqrt", "op_add", "op_subtract", "op_multiply", "op_divide", "op_power", "op_precedence", "op_param")
    add_aggregate(
        _name, "events", "*", [Load(("event_id",)), Apply(_expr, "r")],
        f"SELECT CAST(event_id AS DOUBLE) AS event_id, {f'round({_sql}, 4)' if _float else _sql} AS r FROM events", ("r",) if _float else (), **({"params": {"add": "7"}} if _name == "op_param" else {}),
    )
for _name, _unit in (("hour", "hour"), ("day", "day")):
    add_aggregate(f"time_bucket_{_name}", "events", "*", [Apply(f"{_unit}(@at)", "bucket"), GroupBy(("bucket",), (Reduce("COUNT", (), "n"), Reduce("SUM", ("@value",), "total")))], f"SELECT CAST(epoch(date_trunc('{_unit}', ts)) AS DOUBLE) AS bucket, CAST(count(*) AS DOUBLE) AS n, round(sum(value), 4) AS total FROM events GROUP BY bucket", ("total",))
add_aggregate("time_bucket_month", "orders", "*", [Apply("month(@day)", "bucket"), GroupBy(("bucket",), (Reduce("COUNT", (), "n"),))], "SELECT CAST(epoch(date_trunc('month', o_orderdate)) AS DOUBLE) AS bucket, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY bucket", settings=Settings(emulate=(1, 2, 1)))

# -- administration and ingestion


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "part").info("part").select("num_docs", "num_records", "num_words", "num_terms", "p_name_docs", "p_brand_tags")


add("index_info", _info, f"SELECT count(*) AS num_docs, count(*) * 6 AS num_records, CAST(sum(len({_PART_WORDS})) AS BIGINT) AS num_words, (SELECT count(DISTINCT w) FROM (SELECT unnest({_PART_WORDS}) AS w FROM part)) AS num_terms, count(p_name) AS p_name_docs, count(p_brand) AS p_brand_tags FROM part")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of users that the events, as a log of changes, leave: the last event of each user, gone if it is a logout."""
    from quern.streaming.upsert import live, merge

    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = log.select(F.col("user_id").cast("string").alias(KEY), F.struct("ts", "event_id").alias("__seq"), (F.col("event_id") % 7 == 0).alias("__deleted"), "event_id", "event_type", "value")
    early, late = changes.where(F.col("value") < 50), changes.where(F.col("value") >= 50)
    e = Engine(spark)
    e.create(IndexSchema("users", (Field("value", NUMERIC), Field("event_type", TAG), Field("event_id", NUMERIC))), live(merge(merge(None, early), late)))
    return e.search("users", "*", limit=None, returns=(("event_id", "event_id"), ("value", "value"))).withColumnRenamed(KEY, "key")


add("stream_upsert", _upsert, "SELECT key, event_id, value FROM (SELECT CAST(user_id AS VARCHAR) AS key, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_id % 7 <> 0")
