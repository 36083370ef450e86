"""Queries of every area over the driver's tables, each with SQL of the same meaning where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, jsonpath
from .operators import keyspace as ks
from .operators import logs, sketches
from .operators.aggregate import Pipeline, aggregate
from .operators.search import hybrid, matching, scores, search, search_command, tag_values
from .plans.schema import GEO, NUMERIC, TAG, TEXT, VECTOR, Field, Index
from .sources.tables import changes, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = Index("orders", "o_orderkey", (Field("status", TAG, "o_orderstatus"), Field("priority", TAG, "o_orderpriority"), Field("price", NUMERIC, "o_totalprice"), Field("cust", NUMERIC, "o_custkey"), Field("at", NUMERIC, "epoch")))
LINES = Index("lines", "line_key", (Field("order", NUMERIC, "l_orderkey"), Field("part", NUMERIC, "l_partkey"), Field("supp", NUMERIC, "l_suppkey"), Field("qty", NUMERIC, "l_quantity"), Field("price", NUMERIC, "l_extendedprice"), Field("discount", NUMERIC, "l_discount"), Field("tax", NUMERIC, "l_tax"), Field("flag", TAG, "l_returnflag"), Field("status", TAG, "l_linestatus")))
CUSTOMERS = Index("customers", "c_custkey", (Field("custkey", NUMERIC, "c_custkey"), Field("name", TEXT, "c_name"), Field("nation", NUMERIC, "c_nationkey"), Field("balance", NUMERIC, "c_acctbal"), Field("segment", TAG, "c_mktsegment"), Field("place", GEO, "place")), language=None)
NATIONS = Index("nations", "n_nationkey", (Field("nationkey", NUMERIC, "n_nationkey"), Field("name", TAG, "n_name"), Field("region", NUMERIC, "n_regionkey")))
REGIONS = Index("regions", "r_regionkey", (Field("regionkey", NUMERIC, "r_regionkey"), Field("name", TAG, "r_name")))
PARTS = Index("parts", "p_partkey", (Field("type", TAG, "p_type", separator=" "), Field("brand", TAG, "p_brand"), Field("size", NUMERIC, "p_size"), Field("price", NUMERIC, "p_retailprice"), Field("name", TEXT, "p_name")), language=None)
DOCS = Index("docs", "doc_id", (Field("text", TEXT), Field("lang", TAG), Field("source", TAG), Field("chars", NUMERIC, "n_chars")), language=None)
STEMMED = replace(DOCS, name="stemmed", language="english")
EVENTS = Index("events", "event_id", (Field("type", TAG, "event_type"), Field("user", NUMERIC, "user_id"), Field("value", NUMERIC, "value"), Field("k", NUMERIC, "$.k")), document="props")
VECTORS = Index("vectors", "vec_id", (Field("v", VECTOR, "embedding", metric="L2", dim=64), Field("label", TAG)))
PLACE = "concat(((c_custkey*37)%360-180)::VARCHAR, ',', ((c_custkey*17)%170-85)::VARCHAR)"


class Frames(Mapping):
    """Indexed tables by name; each is opened when it is asked for."""

    def __init__(self, spark: SparkSession, sf: str):
        t = lambda n: table(spark, sf, n)
        place = lambda: F.concat((F.col("c_custkey") * 37 % 360 - 180).cast("string"), F.lit(","), (F.col("c_custkey") * 17 % 170 - 85).cast("string"))
        self.made = {
            "orders": (lambda: t("orders").withColumn("epoch", F.unix_timestamp("o_orderdate").cast("double")), ORDERS),
            "lines": (lambda: t("lineitem").withColumn("line_key", F.concat_ws("-", "l_orderkey", "l_linenumber")), LINES),
            "customers": (lambda: t("customer").withColumn("place", place()), CUSTOMERS),
            "nations": (lambda: t("nation"), NATIONS),
            "regions": (lambda: t("region"), REGIONS),
            "parts": (lambda: t("part"), PARTS),
            "docs": (lambda: t("documents"), DOCS),
            "stemmed": (lambda: t("documents"), STEMMED),
            "events": (lambda: t("events"), EVENTS),
            "vectors": (lambda: t("embeddings").withColumn("label", F.col("label").cast("string")), VECTORS),
        }

    def __getitem__(self, name: str) -> tuple[DataFrame, Index]:
        make, index = self.made[name]
        return make(), index

    def __iter__(self):
        return iter(self.made)

    def __len__(self) -> int:
        return len(self.made)


def frames(spark: SparkSession, sf: str) -> Frames:
    return Frames(spark, sf)


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def command(name: str, text_: str, sql: str, rounded: tuple[str, ...] = (), digits: int = 2) -> None:
    """A query that is an aggregation command."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = aggregate(text_, frames(spark, sf))
        return df.withColumns({c: F.round(c, digits) for c in rounded})

    run.__name__ = name
    query(sql)(run)


# --- aggregation pipeline

command(
    "agg_flagship",
    "orders '@price:[1000 50000] @status:{O|F}' GROUPBY 1 @priority REDUCE COUNT 0 AS n REDUCE SUM 1 @price AS total SORTBY 2 @n DESC LIMIT 0 5",
    "SELECT lower(o_orderpriority) AS priority, count(*)::DOUBLE AS n, round(sum(o_totalprice),2) AS total FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderstatus IN ('O','F') GROUP BY 1 ORDER BY n DESC LIMIT 5".replace("lower(o_orderpriority)", "o_orderpriority"),
    ("total",),
)
command(
    "agg_reducers",
    "lines * GROUPBY 2 @flag @status REDUCE COUNT 0 AS n REDUCE COUNT_DISTINCT 1 @supp AS supps REDUCE SUM 1 @qty AS qty REDUCE AVG 1 @discount AS disc REDUCE MIN 1 @price AS low REDUCE MAX 1 @price AS high",
    "SELECT l_returnflag AS flag, l_linestatus AS status, count(*)::DOUBLE AS n, count(DISTINCT l_suppkey)::DOUBLE AS supps, round(sum(l_quantity),2) AS qty, round(avg(l_discount),6) AS disc, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1,2",
    ("qty", "disc"),
    6,
)
command("agg_global", "lines * GROUPBY 0 REDUCE COUNT 0 AS n REDUCE MAX 1 @qty AS most", "SELECT count(*)::DOUBLE AS n, max(l_quantity) AS most FROM lineitem")
command("agg_global_empty", "lines '@qty:[1000000 2000000]' GROUPBY 0 REDUCE COUNT 0 AS n", "SELECT 1.0::DOUBLE AS n WHERE false")
command("agg_chained", "lines * GROUPBY 1 @order REDUCE SUM 1 @qty AS qty GROUPBY 0 REDUCE MAX 1 @qty AS most REDUCE AVG 1 @qty AS mean", "SELECT max(qty) AS most, round(avg(qty),4) AS mean FROM (SELECT sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey)", ("mean",), 4)
command("agg_count_distinct_null", "lines * APPLY '@qty / (@qty > 25)' AS half GROUPBY 1 @flag REDUCE COUNT_DISTINCT 1 @half AS n", "SELECT l_returnflag AS flag, (count(DISTINCT CASE WHEN l_quantity>25 THEN l_quantity END) + max(CASE WHEN l_quantity>25 THEN 0 ELSE 1 END))::DOUBLE AS n FROM lineitem GROUP BY 1")
command("agg_apply_filter_having", "lines * APPLY '@price * (1 - @discount)' AS net FILTER '@net > 20000' GROUPBY 1 @supp REDUCE SUM 1 @net AS total REDUCE COUNT 0 AS n FILTER '@n >= 3' APPLY 'floor(@total / @n)' AS mean", "SELECT l_suppkey::DOUBLE AS supp, round(sum(net),2) AS total, count(*)::DOUBLE AS n, floor(sum(net)/count(*)) AS mean FROM (SELECT l_suppkey, l_extendedprice*(1-l_discount) AS net FROM lineitem) WHERE net>20000 GROUP BY 1 HAVING count(*)>=3", ("total",))
command("agg_sort_max", "lines * LOAD 1 @order SORTBY 4 @price DESC @order ASC MAX 25", "SELECT l_orderkey::DOUBLE AS \"order\", l_extendedprice AS price FROM lineitem ORDER BY price DESC, 1 LIMIT 25")
command("agg_sort_nulls_last", "orders * APPLY '@price / (@price > 150000)' AS big SORTBY 2 @big DESC GROUPBY 1 @big REDUCE COUNT 0 AS n SORTBY 2 @big ASC LIMIT 0 7", "SELECT CASE WHEN o_totalprice>150000 THEN o_totalprice END AS big, count(*)::DOUBLE AS n FROM orders GROUP BY 1 ORDER BY big ASC NULLS LAST LIMIT 7")
command("agg_time_bucket", "orders * APPLY 'floor(@at / 2592000) * 2592000' AS bucket GROUPBY 1 @bucket REDUCE COUNT 0 AS n", "SELECT floor(epoch(o_orderdate)/2592000)*2592000 AS bucket, count(*)::DOUBLE AS n FROM orders GROUP BY 1")

# --- scalar functions

_EXPRESSIONS = {
    "fn_math": ("lines", ["order", "qty"], {"a": "sqrt(@qty) + log(@qty) + log2(@qty) + log10(@qty) + exp(0 - @qty / 50)", "b": "abs(-@qty) ^ 2 ^ 0.5", "c": "(0 - @qty) % 7", "d": "ceil(@qty / 3) - floor(@qty / 3)"}, "SELECT l_orderkey::DOUBLE AS \"order\", l_quantity AS qty, round(sqrt(l_quantity)+ln(l_quantity)+log2(l_quantity)+log10(l_quantity)+exp(-l_quantity/50),6) AS a, round(pow(l_quantity, pow(2,0.5)),6) AS b, -fmod(l_quantity,7)+0.0 AS c, ceil(l_quantity/3)-floor(l_quantity/3) AS d FROM lineitem".replace("fmod(l_quantity,7)", "(l_quantity % 7)")),
    "fn_compare": ("lines", ["order", "qty"], {"a": "@qty >= 25 && @flag == 'R'", "b": "@flag == 1", "c": "@flag != 1", "d": "!(@qty < 10) || @status == 'O'", "e": "exists(@qty / 0)"}, "SELECT l_orderkey::DOUBLE AS \"order\", l_quantity AS qty, (l_quantity>=25 AND l_returnflag='R')::INT::DOUBLE AS a, 0.0::DOUBLE AS b, 1.0::DOUBLE AS c, (NOT (l_quantity<10) OR l_linestatus='O')::INT::DOUBLE AS d, 0.0::DOUBLE AS e FROM lineitem"),
    "fn_strings": ("parts", ["brand"], {"a": "upper(substr(@name, 1, 5))", "b": "strlen(@name)", "c": "contains(@type, 'BRASS')", "d": "startswith(@brand, 'Brand')", "e": "split(@type, ' ')", "f": "format('%s=%d%%', @brand, @size)", "g": "to_number('12.5') + 1"}, "SELECT p_brand AS brand, upper(substr(p_name,2,5)) AS a, strlen(p_name)::DOUBLE AS b, contains(p_type,'BRASS')::INT::DOUBLE AS c, starts_with(p_brand,'Brand')::INT::DOUBLE AS d, replace(p_type,' ',',') AS e, p_brand||'='||p_size||'%' AS f, 13.5::DOUBLE AS g FROM part"),
    "fn_dates": ("orders", ["price"], {"y": "year(@at)", "m": "month(@at)", "d": "day(@at)", "w": "dayofweek(@at)", "j": "dayofyear(@at)", "h": "hour(@at)", "t": "timefmt(@at, '%Y/%m/%d')", "p": "parsetime(timefmt(@at, '%Y/%m/%d'), '%Y/%m/%d')"}, "SELECT o_totalprice AS price, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d, dayofweek(o_orderdate)::DOUBLE AS w, dayofyear(o_orderdate)::DOUBLE AS j, hour(o_orderdate)::DOUBLE AS h, strftime(o_orderdate,'%Y/%m/%d') AS t, epoch(date_trunc('day',o_orderdate))::DOUBLE AS p FROM orders"),
    "fn_geodistance": ("customers", ["custkey"], {"km": "geodistance(@place_text, '2.35,48.85')"}, f"SELECT c_custkey::DOUBLE AS custkey, round(2*6371*asin(sqrt(pow(sin(radians(48.85-lat)/2),2)+cos(radians(lat))*cos(radians(48.85))*pow(sin(radians(2.35-lon)/2),2))),4) AS km FROM (SELECT c_custkey, split_part(p,',',1)::DOUBLE AS lon, split_part(p,',',2)::DOUBLE AS lat FROM (SELECT c_custkey, {PLACE} AS p FROM customer))"),
}


def _expressions(name: str, source: str, load: list[str], exprs: dict[str, str], sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, index = frames(spark, sf)[source]
        if source == "customers":
            index = index.altered(Field("place_text", TAG, "place"))
        pipe = Pipeline.over(df, index).load(*load)
        for alias, e in exprs.items():
            pipe = pipe.apply(e, alias)
        out = pipe.frame()
        return out.withColumns({c: F.round(c, 6 if source != "customers" else 4) for c in ("a", "b", "km") if dict(out.dtypes).get(c) == "double"})

    run.__name__ = name
    query(sql)(run)


for _name, _spec in _EXPRESSIONS.items():
    _expressions(_name, *_spec)

# --- joins

command("join_load_from_2way", "customers '@balance:[0 inf]' LOAD_FROM nations AS n 1 n.nationkey=customers.nation GROUPBY 1 @n.name REDUCE COUNT 0 AS cnt REDUCE SUM 1 @customers.balance AS total", "SELECT n_name AS n_name, count(*)::DOUBLE AS cnt, round(sum(c_acctbal),2) AS total FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_acctbal>=0 GROUP BY 1", ("total",))
command("join_load_from_4way", "regions * LOAD_FROM nations AS n 1 n.region=regions.regionkey LOAD_FROM customers AS c 1 c.nation=n.nationkey QUERY '@segment:{BUILDING}' LOAD_FROM orders AS o 1 o.cust=c.custkey QUERY '@status:{F}' GROUPBY 1 @regions.name REDUCE COUNT 0 AS cnt REDUCE SUM 1 @o.price AS total SORTBY 2 @total DESC", "SELECT r_name AS regions_name, count(*)::DOUBLE AS cnt, round(sum(o_totalprice),2) AS total FROM region JOIN nation ON n_regionkey=r_regionkey JOIN customer ON c_nationkey=n_nationkey JOIN orders ON o_custkey=c_custkey WHERE c_mktsegment='BUILDING' AND o_orderstatus='F' GROUP BY 1", ("total",))
command("join_post_sort_limit", "orders '@price:[100000 inf]' LOAD_FROM customers AS c 1 c.custkey=orders.cust LOAD 2 @orders.price @c.name SORTBY 4 @orders.price DESC @c.name ASC LIMIT 3 10", "SELECT o_totalprice AS orders_price, c_name AS c_name FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_totalprice>=100000 ORDER BY 1 DESC, 2 LIMIT 10 OFFSET 3")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey=b.n_regionkey")
def join_self(spark, sf):
    df, index = frames(spark, sf)["nations"]
    return Pipeline.over(df, index, alias="a").join(Pipeline.over(df, index, alias="b"), [("a.region", "b.region")]).load("a.name", "b.name").frame()


@query("SELECT n_name AS n_name, r_name AS r_name FROM nation, region")
def join_no_condition(spark, sf):
    f = frames(spark, sf)
    return Pipeline.over(*f["nations"], alias="n").join(Pipeline.over(*f["regions"], alias="r"), []).load("n.name", "r.name").frame()


@query("SELECT count(*)::DOUBLE AS n FROM nation WHERE false HAVING count(*)>0")
def join_type_strict(spark, sf):
    f = frames(spark, sf)
    return Pipeline.over(*f["nations"], alias="n").join(Pipeline.over(*f["regions"], alias="r"), [("n.name", "r.regionkey")]).group([], [("COUNT", None, "n")]).frame()


# --- search predicates


def found(name: str, source: str, text_: str, key: str, where: str, from_: str, params: dict | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, index = frames(spark, sf)[source]
        return matching(df, index, text_, params).select(F.col(key))

    run.__name__ = name
    query(f"SELECT {key} FROM {from_} WHERE {where}")(run)


_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[\\t\\n\\r\\x0b\\f,.<>{}\\[\\]\"'':;!@#$%^&*()\\-+=~?/|` ]+'), lambda x: x <> '')"
_STOP = "['a','is','the','an','and','are','as','at','be','but','by','for','if','in','into','it','no','not','of','on','or','such','that','their','then','there','these','they','this','to','was','will','with']"
_DOCS = f"(SELECT *, list_filter({_TOKENS}, lambda x: NOT list_contains({_STOP}, x)) AS toks FROM documents)"
found("q_numeric_range", "orders", "@price:[50000 (100000]", "o_orderkey", "o_totalprice>=50000 AND o_totalprice<100000", "orders")
found("q_range_inf", "orders", "@price:[(200000 inf] | @price:[-inf 5000]", "o_orderkey", "o_totalprice>200000 OR o_totalprice<=5000", "orders")
found("q_tags", "orders", "@status:{O|P} -@priority:{1-URGENT}", "o_orderkey", "o_orderstatus IN ('O','P') AND o_orderpriority<>'1-URGENT'", "orders")
found("q_tag_affixes", "parts", "@type:{PROM*|*ASS|*LISH*}", "p_partkey", "len(list_filter(string_split(lower(p_type),' '), lambda x: starts_with(x,'prom') OR ends_with(x,'ass') OR contains(x,'lish')))>0", "part")
found("q_tag_glob", "parts", "@type:{w'st?n*'|w'*b?ass'}", "p_partkey", "len(list_filter(string_split(lower(p_type),' '), lambda x: regexp_full_match(x,'st.n.*|.*b.ass')))>0", "part")
found("q_boolean", "customers", "(@segment:{BUILDING|MACHINERY} @balance:[0 5000]) | (@nation:[3 5] -@balance:[-inf 0])", "c_custkey", "(c_mktsegment IN ('BUILDING','MACHINERY') AND c_acctbal BETWEEN 0 AND 5000) OR (c_nationkey BETWEEN 3 AND 5 AND NOT c_acctbal<=0)", "customer")
found("q_exists_params", "customers", "@balance:* @nation:[$a $b]", "c_custkey", "c_acctbal IS NOT NULL AND c_nationkey BETWEEN 7 AND 9", "customer", {"a": 7, "b": 9})
found("q_geo_radius", "customers", "@place:[2.35 48.85 1500 km]", "c_custkey", "2*6372797.560856*asin(sqrt(pow(sin(radians(48.85-lat)/2),2)+cos(radians(lat))*cos(radians(48.85))*pow(sin(radians(2.35-lon)/2),2)))<=1500000", "(SELECT *, ((c_custkey*37)%360-180)::DOUBLE AS lon, ((c_custkey*17)%170-85)::DOUBLE AS lat FROM customer)")
found("q_term", "docs", "@text:erthe | license", "doc_id", "list_contains(toks,'erthe') OR list_contains(toks,'license')", _DOCS)
found("q_and_not", "docs", "license -apache @lang:{en}", "doc_id", "list_contains(toks,'license') AND NOT list_contains(toks,'apache') AND lower(lang)='en'", _DOCS)
found("q_prefix_suffix_infix", "docs", "licen* | *icense | *nces*", "doc_id", "len(list_filter(toks, lambda x: starts_with(x,'licen') OR ends_with(x,'icense') OR contains(x,'nces')))>0", _DOCS)
found("q_wildcard", "docs", "w'lic?nse*'", "doc_id", "len(list_filter(toks, lambda x: regexp_full_match(x,'lic.nse.*')))>0", _DOCS)
found("q_phrase", "docs", '"under the mit license"', "doc_id", "contains(' '||array_to_string(toks,' ')||' ', ' under mit license ')", _DOCS)
found("q_phrase_slop", "docs", '"licensed apache version"~2', "doc_id", "regexp_matches(' '||array_to_string(toks,' ')||' ', ' licensed ([^ ]+ ){0,2}apache ([^ ]+ ){0,2}version ')", _DOCS)
found("q_stopword_drop", "docs", "the license", "doc_id", "list_contains(toks,'license')", _DOCS)
found("q_optional", "docs", "license ~apache", "doc_id", "list_contains(toks,'license')", _DOCS)
#: The forms that English has of a verb, in place of a stem.
_FORMS = "len(list_filter(toks, lambda x: regexp_full_match(x,'{}(e|es|ed|er|ers|ing|ings|able)?')))>0"
found("q_stem", "stemmed", "@text:licensing", "doc_id", _FORMS.format("licens"), _DOCS)
found("q_stem_and_not", "stemmed", "released -license", "doc_id", _FORMS.format("releas") + " AND NOT " + _FORMS.format("licens"), _DOCS)
found("q_json_path", "events", "@k:[10 20] @type:{click|view}", "event_id", "json_extract(props,'$.k')::DOUBLE BETWEEN 10 AND 20 AND event_type IN ('click','view')", "events")
found("q_match_all", "orders", "*", "o_orderkey", "true", "orders")


@query("SELECT c_custkey::VARCHAR AS \"__key\", c_name AS who, c_acctbal AS balance FROM customer WHERE c_mktsegment='BUILDING' AND c_acctbal BETWEEN 0 AND 9000 ORDER BY balance DESC, 1 LIMIT 20 OFFSET 5")
def search_return_sort_filter(spark, sf):
    df, index = frames(spark, sf)["customers"]
    return search(df, index, "@segment:{BUILDING}", returns={"name": "who", "balance": "balance"}, filters={"balance": (0, 9000)}, sort=("balance", True), offset=5, limit=20)


def searching(name: str, text_: str, sql: str, rounded: str | None = None) -> None:
    """A query that is a search command."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = search_command(text_, frames(spark, sf))
        return df.withColumn(rounded, F.round(rounded, 6)) if rounded else df

    run.__name__ = name
    query(sql)(run)


searching("ft_search_return_sort", "customers '@segment:{BUILDING}' RETURN 4 name AS who balance SORTBY balance DESC FILTER balance 0 9000 LIMIT 5 20", "SELECT c_custkey::VARCHAR AS \"__key\", c_name AS who, c_acctbal AS balance FROM customer WHERE c_mktsegment='BUILDING' AND c_acctbal BETWEEN 0 AND 9000 ORDER BY balance DESC, 1 LIMIT 20 OFFSET 5")
searching("ft_search_nocontent_params", "customers '@nation:[$a $b]' NOCONTENT PARAMS 4 a 3 b 5 SORTBY name LIMIT 0 15 DIALECT 2", "SELECT c_custkey::VARCHAR AS \"__key\" FROM customer WHERE c_nationkey BETWEEN 3 AND 5 ORDER BY c_name, 1 LIMIT 15")
searching("ft_search_sort_keys", "customers * RETURN 1 nation SORTBY name WITHSORTKEYS LIMIT 2 12", "SELECT c_custkey::VARCHAR AS \"__key\", c_nationkey::DOUBLE AS nation, '$'||c_name AS \"__sortkey\" FROM customer ORDER BY c_name, 1 LIMIT 12 OFFSET 2")
searching("ft_search_open_filter", "customers * NOCONTENT FILTER nation (3 7 FILTER balance -inf (0 LIMIT 0 1000000", "SELECT c_custkey::VARCHAR AS \"__key\" FROM customer WHERE c_nationkey>3 AND c_nationkey<=7 AND c_acctbal<0")


@query("SELECT DISTINCT unnest(string_split(lower(p_type),' ')) AS tag FROM part")
def search_tag_values(spark, sf):
    return tag_values(*frames(spark, sf)["parts"], "type")


# --- scores

_BM25 = f"""WITH d AS {_DOCS[:-1]}), t AS (SELECT doc_id, len(toks)::DOUBLE AS len, unnest(['license','mit','apache']) AS term, unnest([len(list_filter(toks, lambda x: x='license')), len(list_filter(toks, lambda x: x='mit')), len(list_filter(toks, lambda x: x='apache'))])::DOUBLE AS tf FROM d),
h AS (SELECT * FROM t WHERE tf>0), df AS (SELECT term, count(*)::DOUBLE AS df FROM h GROUP BY 1), s AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, avg(len(toks))::DOUBLE AS mean FROM d WHERE len(toks)>0)"""
_BM25_ONE = "ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len/mean))"


def _scored(name: str, scorer: str, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return scores(*frames(spark, sf)["docs"], "license | mit | apache", scorer).select(F.col("__key").alias("doc"), F.round("__score", 6).alias("score"))

    run.__name__ = name
    query(_BM25 + sql)(run)


_SUM = " SELECT doc_id::VARCHAR AS doc, {} AS score FROM h JOIN df USING (term), s GROUP BY 1"
_scored("score_bm25", "BM25STD", _SUM.format(f"round(sum({_BM25_ONE}),6)"))
_scored("score_bm25_tanh", "BM25STD.TANH", _SUM.format(f"round(tanh(sum({_BM25_ONE})/4),6)"))
_scored("score_bm25_norm", "BM25STD.NORM", f", z AS (SELECT doc_id::VARCHAR AS doc, sum({_BM25_ONE}) AS score FROM h JOIN df USING (term), s GROUP BY 1) SELECT doc, round(score/max(score) OVER (),6) AS score FROM z")
_scored("score_tfidf", "TFIDF", _SUM.format("round(sum(ln(n/df)*tf),6)"))
_scored("score_tfidf_docnorm", "TFIDF.DOCNORM", _SUM.format("round(sum(ln(n/df)*tf/len),6)"))



@query(None)
def score_bm25_stem(spark, sf):
    """Stems count in terms and lengths; without SQL, compared with brute force in the tests."""
    return scores(*frames(spark, sf)["stemmed"], "licenses | permission").select(F.col("__key").alias("doc"), F.round("__score", 6).alias("score"))


# --- vectors

_V = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id=0)"
_DISTANCE = {"L2": "list_distance(embedding::DOUBLE[], q)", "IP": "1-list_inner_product(embedding::DOUBLE[], q)", "COSINE": "1-list_cosine_similarity(embedding::DOUBLE[], q)"}


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """One row: the vector of id 0."""
    return list(table(spark, sf, "embeddings").filter("vec_id = 0").first().embedding)


def _metric(index: Index, metric: str) -> Index:
    return Index(index.name, index.key, tuple(Field(f.name, f.kind, f.source, metric=metric, dim=f.dim) for f in index.fields))


def _nearest(name: str, metric: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, index = frames(spark, sf)["vectors"]
        out = search(df, _metric(index, metric), "*=>[KNN 10 @v $q AS d]", params={"q": query_vector(spark, sf)}, returns=[])
        return out.select(F.col("__key").alias("id"), F.round("d", 5).alias("d"))

    run.__name__ = name
    query(f"SELECT vec_id::VARCHAR AS id, round({_DISTANCE[metric]},5)+0.0 AS d FROM embeddings, {_V} ORDER BY {_DISTANCE[metric]}, id LIMIT 10")(run)


for _m in _DISTANCE:
    _nearest(f"knn_{_m.lower()}", _m)


@query(f"SELECT vec_id::VARCHAR AS id FROM (SELECT vec_id, label, {_DISTANCE['L2']} AS d FROM embeddings, {_V}) WHERE label IN (1,2,3) ORDER BY d, id LIMIT 5")
def knn_filtered(spark, sf):
    df, index = frames(spark, sf)["vectors"]
    return search(df, index, "@label:{1|2|3}=>[KNN 5 @v $q]", params={"q": query_vector(spark, sf)}, returns=[]).select(F.col("__key").alias("id"))


@query(f"SELECT vec_id FROM embeddings, {_V} WHERE {_DISTANCE['COSINE']} <= 0.8")
def vector_range(spark, sf):
    df, index = frames(spark, sf)["vectors"]
    return matching(df, _metric(index, "COSINE"), "@v:[VECTOR_RANGE 0.8 $q]", {"q": query_vector(spark, sf)}).select("vec_id")


HYBRID = Index("hybrid", "doc_id", (Field("text", TEXT), Field("v", VECTOR, "embedding", dim=64)), language=None)
_HYBRID = f"""{_BM25}, x AS (SELECT doc_id::VARCHAR AS k, sum({_BM25_ONE}) AS score FROM h JOIN df USING (term), s WHERE term='license' GROUP BY 1),
near AS (SELECT vec_id::VARCHAR AS k, {_DISTANCE["L2"]} AS dist FROM embeddings, {_V} WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY dist, k LIMIT 20),
sim AS (SELECT k, 1/(1+dist*dist) AS similarity FROM near)"""
_RRF = f"""{_HYBRID}, a AS (SELECT k, row_number() OVER (ORDER BY score DESC, k) AS r FROM x QUALIFY r<=20), b AS (SELECT k, row_number() OVER (ORDER BY similarity DESC, k) AS q FROM sim),
u AS (SELECT coalesce(a.k,b.k) AS id, coalesce(1/(60.0::DOUBLE+r),0)+coalesce(1/(60.0::DOUBLE+q),0) AS score FROM a FULL JOIN b ON a.k=b.k) SELECT id, round(score,6) AS score FROM u ORDER BY u.score DESC, id LIMIT 10"""
_LINEAR = f"""{_HYBRID}, u AS (SELECT coalesce(x.k,sim.k) AS id, 0.7::DOUBLE*coalesce(score,0)+0.3::DOUBLE*coalesce(similarity,0) AS score FROM x FULL JOIN sim ON x.k=sim.k) SELECT id, round(score,6) AS score FROM u ORDER BY u.score DESC, id LIMIT 10"""


def _hybrid_docs(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")


@query(_RRF)
def hybrid_rrf(spark, sf):
    return hybrid(_hybrid_docs(spark, sf), HYBRID, "license", "v", query_vector(spark, sf), k=20).select(F.col("__key").alias("id"), F.round("__score", 6).alias("score"))


@query(_LINEAR)
def hybrid_linear(spark, sf):
    return hybrid(_hybrid_docs(spark, sf), HYBRID, "license", "v", query_vector(spark, sf), k=20, combine="LINEAR", alpha=0.7, beta=0.3).select(F.col("__key").alias("id"), F.round("__score", 6).alias("score"))


searching("ft_search_with_scores", "docs license NOCONTENT WITHSCORES LIMIT 0 20", f"{_HYBRID} SELECT k AS \"__key\", round(score,6) AS \"__score\" FROM x ORDER BY x.score DESC, k LIMIT 20", "__score")


# --- sorted sets, sets, lists, hashes, strings


def zset(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("member"), F.col("o_totalprice").alias("score"))


def sets(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("member")).distinct()


def scores_by_priority(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.col("o_custkey").cast("string").alias("member")).agg(F.count("o_orderkey").cast("double").alias("score"))


def turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("elem"))


_Z = "(SELECT o_custkey::VARCHAR AS key, o_orderkey::VARCHAR AS member, o_totalprice AS score FROM orders)"
_ZR = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member)-1 AS r, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC)-1 AS rr FROM {_Z})"
_S = "(SELECT DISTINCT event_type AS key, user_id::VARCHAR AS member FROM events)"
_P = "(SELECT o_orderpriority AS key, o_custkey::VARCHAR AS member, count(*)::DOUBLE AS score FROM orders GROUP BY 1,2)"
_L = "(SELECT conv_id::VARCHAR AS key, turn AS pos, role AS elem, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(f"SELECT key, member, r AS rank FROM {_ZR}")
def win_zrank(spark, sf):
    return ks.ranked(zset(spark, sf)).select("key", "member", "rank")


@query(f"SELECT key, member, rr AS rank FROM {_ZR}")
def win_zrevrank(spark, sf):
    return ks.ranked(zset(spark, sf), reverse=True).select("key", "member", "rank")


@query(f"SELECT key, member, score FROM {_ZR} WHERE rr<=1")
def zset_range_by_rank(spark, sf):
    return ks.range_by_rank(zset(spark, sf), -2, -1).select("key", "member", "score")


@query(f"SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS q FROM {_Z} WHERE score>50000 AND score<=150000) WHERE q BETWEEN 2 AND 3")
def zset_range_by_score(spark, sf):
    return ks.range_by_score(zset(spark, sf), 50000, 150000, low_open=True, offset=1, count=2)


@query(f"SELECT key, member FROM {_Z} WHERE member>='2' AND member<'5'")
def zset_range_by_lex(spark, sf):
    return ks.range_by_lex(zset(spark, sf), "2", "5", high_open=True).select("key", "member")


@query(f"SELECT key, member FROM {_ZR} WHERE r<2")
def zset_pop_min(spark, sf):
    return ks.pop(zset(spark, sf), 2)[0].select("key", "member")


@query(f"SELECT member, sum(score*CASE key WHEN '1-URGENT' THEN 2 ELSE 1 END) AS score FROM {_P} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1")
def zset_union(spark, sf):
    return ks.combine(scores_by_priority(spark, sf), ["1-URGENT", "2-HIGH"], weights=[2, 1])


@query(f"SELECT member, max(score) AS score FROM {_P} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1 HAVING count(*)=2")
def zset_inter(spark, sf):
    return ks.combine(scores_by_priority(spark, sf), ["1-URGENT", "2-HIGH"], how="inter", aggregate="MAX")


@query(f"SELECT member, score FROM {_P} WHERE key='1-URGENT' AND member NOT IN (SELECT member FROM {_P} WHERE key='2-HIGH')")
def zset_diff(spark, sf):
    return ks.combine(scores_by_priority(spark, sf), ["1-URGENT", "2-HIGH"], how="diff")


@query(f"SELECT key, count(*) AS n FROM {_Z} WHERE score BETWEEN 100000 AND 200000 GROUP BY 1")
def zset_count(spark, sf):
    return ks.card(ks.range_by_score(zset(spark, sf), 100000, 200000))


@query(f"SELECT DISTINCT member FROM {_S} WHERE key IN ('click','purchase')")
def set_union(spark, sf):
    return ks.union(sets(spark, sf), ["click", "purchase"])


@query(f"SELECT member FROM {_S} WHERE key IN ('click','purchase') GROUP BY 1 HAVING count(*)=2")
def set_inter(spark, sf):
    return ks.inter(sets(spark, sf), ["click", "purchase"])


@query(f"SELECT member FROM {_S} WHERE key='click' AND member NOT IN (SELECT member FROM {_S} WHERE key='purchase')")
def set_diff(spark, sf):
    return ks.diff(sets(spark, sf), ["click", "purchase"])


@query(f"SELECT key, count(*) AS n FROM {_S} GROUP BY 1")
def set_card(spark, sf):
    return ks.card(sets(spark, sf))


@query(f"SELECT key, pos, elem FROM {_L} WHERE i>=1 AND i<=n-2")
def list_range(spark, sf):
    return ks.list_range(turns(spark, sf), 1, -2)


@query(f"SELECT key, elem FROM {_L} WHERE i=n-1")
def list_index(spark, sf):
    return ks.list_index(turns(spark, sf), -1)


@query(f"SELECT key, i AS index FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS q FROM {_L} WHERE elem='user') WHERE q=2")
def list_positions(spark, sf):
    return ks.list_positions(turns(spark, sf), "user", rank=2).withColumn("index", F.col("index").cast("long"))


@query(f"SELECT key, pos, elem FROM (SELECT *, row_number() OVER (PARTITION BY key, elem ORDER BY pos DESC) AS q FROM {_L}) WHERE NOT (elem='user' AND q<=1)")
def list_remove(spark, sf):
    return ks.list_remove(turns(spark, sf), "user", -1)


@query(f"SELECT key, pos, elem FROM {_L} WHERE i<n-1")
def list_pop_tail(spark, sf):
    return ks.list_pop(turns(spark, sf), 1, right=True)[1]


@query("SELECT user_id::VARCHAR AS key, event_type AS field, count(*) AS value FROM events GROUP BY 1,2")
def hash_counters(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field"), F.lit(1).alias("delta"))
    empty = e.select("key", "field", F.col("delta").cast("string").alias("value")).limit(0)
    return ks.increment(empty, e, on=("key", "field"))


@query("SELECT key, ver, value, lag(value) OVER (PARTITION BY key ORDER BY ver) AS previous FROM (SELECT user_id AS key, event_id AS ver, event_type AS value FROM events)")
def string_getset(spark, sf):
    return ks.previous(table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("ver"), F.col("event_type").alias("value")))


@query("SELECT i AS ordinal, k AS key, c_name AS value FROM (VALUES (0,'7'),(1,'nope'),(2,'3')) t(i,k) LEFT JOIN customer ON c_custkey::VARCHAR=k")
def string_mget(spark, sf):
    asked = spark.createDataFrame([(0, "7"), (1, "nope"), (2, "3")], "ordinal int, key string")
    return ks.multi_get(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value")), asked).select("ordinal", "key", "value")


@query("SELECT c_custkey AS key, substr(c_name, 10, greatest(length(c_name)-10,0)) AS part, strlen(c_name)::INT AS n FROM customer")
def string_getrange(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), ks.get_range(F.col("c_name"), 9, -2).alias("part"), F.octet_length("c_name").alias("n"))


@query("SELECT n_nationkey::VARCHAR AS elem, n_name AS value FROM nation ORDER BY n_regionkey DESC, 1 LIMIT 8")
def sort_by_get(spark, sf):
    n = table(spark, sf, "nation")
    elems = n.select(F.col("n_nationkey").cast("string").alias("elem"))
    return ks.sort(elems, by=elems.join(n, F.col("elem") == F.col("n_nationkey").cast("string")).select("elem", F.col("n_regionkey").cast("string").alias("weight")), get=n.select(F.col("n_nationkey").cast("string").alias("elem"), F.col("n_name").alias("value")), descending=True, limit=8)


@query("SELECT c_name AS key FROM customer WHERE c_name > 'Customer#000000010' AND regexp_full_match(c_name,'Customer#.*[05]') ORDER BY 1 LIMIT 25")
def key_scan(spark, sf):
    return ks.scan(table(spark, sf, "customer").select(F.col("c_name").alias("key")), match="Customer#*[05]", after="Customer#000000010", count=25)


@query("SELECT event_id AS key, CASE WHEN event_id%3=0 THEN -1 ELSE (floor(epoch(ts))-epoch(TIMESTAMP '2020-01-01'))::BIGINT END AS ttl FROM events WHERE event_id%3=0 OR ts>TIMESTAMP '2020-01-01'")
def key_ttl(spark, sf):
    now = F.lit("2020-01-01").cast("timestamp")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 3 != 0, F.date_trunc("second", "ts").cast("timestamp")).alias("expire_at"))
    return ks.ttl(ks.live(rows, now), now)


@query("SELECT c_custkey AS key, CASE WHEN c_custkey%10=0 THEN 'DEL' ELSE 'SET' END AS op, CASE WHEN c_custkey%10<>0 THEN upper(c_name) END AS value FROM customer WHERE c_custkey%10=0 OR upper(c_name)<>c_name")
def journal_changes(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return changes(old, old.filter("key % 10 <> 0").withColumn("value", F.upper("value")), ["key"], "value")


# --- JSON, geo, bitmaps, sketches


@query("SELECT event_id, json_extract_string(props,'$.k') AS k FROM events")
def json_get(spark, sf):
    return table(spark, sf, "events").select("event_id", jsonpath.get_one(F.col("props"), "$.k").alias("k"))


@query("SELECT event_id, (json_extract(props,'$.k')::BIGINT+5) AS k FROM events")
def json_numincrby(spark, sf):
    edited = jsonpath.edit(F.col("props"), "$.k", lambda x: x + 5)
    return table(spark, sf, "events").select("event_id", edited.alias("doc")).select("event_id", F.get_json_object("doc", "$.k").cast("long").alias("k"))


@query("SELECT event_id, 'integer' AS kind FROM events")
def json_type(spark, sf):
    return table(spark, sf, "events").select("event_id", jsonpath.type_of(F.get_json_object("props", "$.k")).alias("kind"))


@query("SELECT l_orderkey AS k, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def json_path_max(spark, sf):
    return _most(table(spark, sf, "lineitem"))


def _most(lines):
    docs = lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_quantity").alias("q"))).alias("lines"))).alias("doc"))
    return docs.select("k", F.get_json_object(jsonpath.get(F.col("doc"), "max($..q)"), "$").cast("double").alias("most"))


_GEO = "(SELECT c_custkey, ((c_custkey*37)%360-180)::DOUBLE AS lon, ((c_custkey*17)%170-85)::DOUBLE AS lat FROM customer)"


def _points(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", geo.lonlat((F.col("c_custkey") * 37 % 360 - 180).cast("double"), (F.col("c_custkey") * 17 % 170 - 85).cast("double")).alias("p"))


@query(f"SELECT c_custkey, round(2*6372797.560856*asin(sqrt(pow(sin(radians(48.85-lat)/2),2)+cos(radians(lat))*cos(radians(48.85))*pow(sin(radians(2.35-lon)/2),2)))/1000,3) AS km FROM {_GEO} ORDER BY 2, 1 LIMIT 10")
def geo_search(spark, sf):
    d = geo.haversine(F.col("p"), geo.lonlat(2.35, 48.85)) / 1000
    return _points(spark, sf).select("c_custkey", F.round(d, 3).alias("km")).orderBy("km", "c_custkey").limit(10)


@query(f"SELECT c_custkey, round(lon,4) AS lon, round(lat,4) AS lat FROM {_GEO}")
def geo_position(spark, sf):
    return _there_and_back(_points(spark, sf))


def _there_and_back(points):
    back = geo.position(geo.geohash52(F.col("p")))
    return points.select("c_custkey", back.alias("q")).select("c_custkey", (F.round("q.lon", 4) + 0.0).alias("lon"), (F.round("q.lat", 4) + 0.0).alias("lat"))


def _bits_of(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.datediff("ts", F.lit("2020-01-01").cast("date")).cast("long").alias("bit")).distinct()


_BITS = "(SELECT DISTINCT user_id AS key, date_diff('day', DATE '2020-01-01', ts::DATE) AS bit FROM events)"


@query(f"SELECT key, count(*) AS n FROM {_BITS} GROUP BY 1")
def bit_count(spark, sf):
    return sketches.bit_count(_bits_of(spark, sf), low=-(1 << 40))


@query(f"SELECT key, min(bit) AS pos FROM {_BITS} GROUP BY 1")
def bit_position(spark, sf):
    return sketches.bit_position(_bits_of(spark, sf))


@query(f"SELECT bit FROM {_BITS} WHERE key IN (1,2,3) GROUP BY 1 HAVING count(*)%2=1")
def bit_xor(spark, sf):
    return sketches.bit_operation(_bits_of(spark, sf), [1, 2, 3], "XOR")


@query("SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, item LIMIT 15")
def topk_exact(spark, sf):
    return sketches.top_k(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item")), "item", 15)


@query("SELECT l_returnflag AS flag, count(DISTINCT l_partkey) > 0 AS some, true AS near FROM lineitem GROUP BY 1")
def hll_distinct(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_partkey")
    est = sketches.hll_count(sketches.hll(rows, ["flag"], "l_partkey"))
    true = rows.groupBy("flag").agg(F.count_distinct("l_partkey").alias("n"))
    return est.join(true, "flag").select("flag", (F.col("estimate") > 0).alias("some"), (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("near"))


@query("SELECT count(DISTINCT l_partkey) AS items, 0::BIGINT AS below, true AS near FROM lineitem")
def cms_estimates(spark, sf):
    """No estimate is below its count, and hardly any above the sketch's error (a share exp(-depth) may be)."""
    items = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"))
    counts = items.groupBy("item").agg(F.count("item").alias("n"))
    total = F.broadcast(counts.agg(F.sum("n").alias("total")))  # one row
    both = sketches.cms_query(sketches.cms(items, "item"), counts, "item").join(counts, "item").crossJoin(total)
    over = F.col("estimate") > F.col("n") + F.ceil(F.col("total") * math.e / 2000)
    return both.agg(F.count("item").alias("items"), F.count_if(F.col("estimate") < F.col("n")).alias("below"), (F.count_if(over) <= 0.01 * F.count("item")).alias("near"))


@query("SELECT count(DISTINCT l_partkey) AS held, 0::BIGINT AS missed, true AS few FROM lineitem")
def bloom_members(spark, sf):
    """Asked for what was added and for as many items that were not: none of the first is missed, few of the others held."""
    added = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item")).distinct()
    capacity = added.count()
    asked = added.unionByName(added.select((F.col("item") + (1 << 40)).alias("item")))
    maybe = sketches.bloom_query(sketches.bloom(added, "item", capacity), asked, "item", capacity).withColumn("there", F.col("item") < (1 << 40))
    return maybe.agg(F.count_if("there").alias("held"), F.count_if(F.expr("there and not maybe")).alias("missed"), (F.count_if(F.expr("maybe and not there")) <= 0.02 * F.count_if(F.expr("not there")) + 3).alias("few"))


@query("SELECT l_suppkey AS item, count(*)-1 AS n FROM lineitem GROUP BY 1")
def cuckoo_delete_one(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item"))
    left = sketches.cuckoo_delete(sketches.cuckoo(rows, "item"), rows.distinct(), "item")
    return sketches.cuckoo_count(left, rows, "item")


# --- logs


def log(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("key"), "ts", "event_id", "user_id")
    return logs.append_auto(e, key="key", at="ts", tie="event_id")


_LOG = "(SELECT event_type AS key, event_id, (epoch_us(ts)//1000) AS ms, row_number() OVER (PARTITION BY event_type, (epoch_us(ts)//1000) ORDER BY ts, event_id)-1 AS seq FROM events)"


@query(f"SELECT key, event_id, ms||'-'||seq AS id FROM {_LOG}")
def log_append(spark, sf):
    return log(spark, sf).select("key", "event_id", logs.entry_id().alias("id"))


@query(f"SELECT key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS q FROM {_LOG}) WHERE q<=5")
def log_range(spark, sf):
    return logs.log_range(log(spark, sf), count=5).select("key", "event_id")


@query(f"SELECT key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS q FROM {_LOG}) WHERE q<=100")
def log_trim(spark, sf):
    return logs.trim(log(spark, sf), most=100).select("key", "event_id")


@query(f"SELECT key, count(*) AS length, min(ms) AS first_ms, max(ms) AS last_ms FROM {_LOG} GROUP BY 1")
def log_info(spark, sf):
    return logs.info(log(spark, sf)).select("key", "length", F.col("first.ms").alias("first_ms"), F.col("last.ms").alias("last_ms"))


@query(f"SELECT key, count(*) AS n FROM (SELECT *, median(ms) OVER (PARTITION BY key) AS m FROM {_LOG}) WHERE ms > floor(m) GROUP BY 1")
def log_group_pending(spark, sf):
    e = log(spark, sf)
    last = e.groupBy("key").agg(F.floor(F.percentile("ms", 0.5)).alias("last_ms")).withColumn("last_seq", F.lit(1 << 40))
    pending = logs.deliver(e, last, consumers=["a", "b"], group="g", now=F.lit("2024-01-01").cast("timestamp"))
    return logs.pending_summary(pending).groupBy("key").agg(F.sum("n").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts)/1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
r AS (SELECT key, i, t, t+17280.0::DOUBLE AS tat, false AS held, floor((51840.0::DOUBLE-17280)/17280)::BIGINT AS rest FROM e WHERE i=1
UNION ALL SELECT key, i, t, CASE WHEN late THEN old ELSE new END, late, floor((51840.0::DOUBLE-((CASE WHEN late THEN base ELSE new END)-t))/17280)::BIGINT
FROM (SELECT *, t<new-51840 AS late FROM (SELECT *, base+17280 AS new FROM (SELECT e.key, e.i, e.t, r.tat AS old, greatest(r.tat, e.t) AS base FROM r JOIN e ON e.key=r.key AND e.i=r.i+1))))
SELECT key, t AS "at", 1.0::DOUBLE AS quantity, held AS limited, rest AS remaining FROM r""")
def rate_limit(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return logs.throttle(e.select("key", (F.col("us") / 1e6).alias("at"), F.lit(1.0).alias("quantity")), burst=2, count=5, period=86400.0)


