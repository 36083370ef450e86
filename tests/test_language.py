"""Parsers, expression semantics, text analysis, JSON paths and key-space writes."""

import datetime as dt
import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import expr, jsonpath, text
from quillon.functions.values import NUM, STR, Value
from quillon.operators import keyspace as ks
from quillon.operators import logs, sketches
from quillon.operators.aggregate import aggregate
from quillon.operators.search import admit, matching, search
from quillon.plans.schema import GEO, NUMERIC, TAG, TEXT, Field, Index
from quillon.plans.search import parse
from quillon.streaming import logs as streams

KINDS = {"n": NUM, "m": NUM, "s": STR, "t": STR}


def evaluated(spark, rows, expressions):
    df = spark.createDataFrame(rows, "n double, m double, s string, t string")
    out = df.select(*(expr.compile_text(e, lambda f: Value(F.col(f), KINDS[f])).col.alias(f"c{k}") for k, e in enumerate(expressions)))
    return [tuple(r) for r in out.collect()]


def plain(tree, row):
    """The expression language on Python values."""
    kind = tree[0]
    if kind in ("num", "str"):
        return tree[1]
    if kind == "field":
        return row[tree[1]]
    true = lambda x: x is not None and x != 0 and x != "" and x == x
    if kind == "not":
        return float(not true(plain(tree[1], row)))
    if kind == "neg":
        x = plain(tree[1], row)
        return -x if isinstance(x, float) else None
    a, b = plain(tree[1], row), plain(tree[2], row)
    if kind == "&&":
        return float(true(a) and true(b))
    if kind == "||":
        return float(true(a) or true(b))
    if kind in ("==", "!=", "<", "<=", ">", ">="):
        if a is None and b is None:
            return float(kind in ("==", "<=", ">="))
        if type(a) is not type(b):
            return float(kind == "!=")
        return float({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[kind])
    if not isinstance(a, float) or not isinstance(b, float):
        return None
    if kind in "/%" and b == 0:
        return None
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b)}[kind]()


LEAVES = st.sampled_from(["@n", "@m", "@s", "@t", "1", "0", "2.5", "'a'", "''", "'b'"])
TREES = st.recursive(LEAVES, lambda x: st.one_of(st.tuples(x, st.sampled_from("+ - * / % == != < <= > >= && ||".split()), x).map(lambda p: f"({p[0]} {p[1]} {p[2]})"), x.map(lambda p: f"(-{p})"), x.map(lambda p: f"(!{p})")), max_leaves=6)
ROWS = [(1.0, 2.0, "a", "b"), (0.0, -3.5, "", "a"), (None, 7.0, None, "b"), (2.5, None, "1", None), (None, None, None, None)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES, min_size=12, max_size=12))
def test_random_expressions(spark, expressions):
    got = evaluated(spark, ROWS, expressions)
    for row, out in zip(ROWS, got, strict=True):
        for e, x in zip(expressions, out, strict=True):
            want = plain(expr.parse(e), dict(zip("nmst", row, strict=True)))
            assert x == want or (x is not None and want is not None and math.isclose(float(x), float(want), abs_tol=1e-9)), (e, row, x, want)


def test_functions(spark):
    cases = {
        "upper('aé')": "Aé",
        "substr('hello', 1, 3)": "ell",
        "substr('hello', 9, 3)": "",
        "strlen('é')": 2.0,
        "format('%s-%d-%%', 'x', 3)": "x-3-%",
        "split('a b,c', ' ')": "a,b,c",
        "to_str(1.5)": "1.5",
        "to_str(1234567)": "1.23457e+06",
        "nonsense(1)": None,
        "log(0)": -math.inf,
        "2 ^ 3 ^ 2": 512.0,
        "-7 % 3": -1.0,
        "1 / 0": None,
        "'1' == 1": 0.0,
        "dayofweek(0)": 4.0,
        "timefmt(0)": "1970-01-01T00:00:00",
        "parsetime('1970-01-02', '%Y-%m-%d')": 86400.0,
        "exists(@n)": 1.0,
        "contains('abc', 'b') + startswith('abc', 'b')": 1.0,
    }
    got = evaluated(spark, ROWS[:1], list(cases))[0]
    assert dict(zip(cases, got, strict=True)) == cases


def test_parse_errors():
    for bad in ("(a", "@f:[1 2", '@f:{a', "a | | b", ""):
        with pytest.raises(ValueError):
            parse(bad)
    assert parse("a b | c").where.kind == "or"
    assert parse("*=>[KNN 3 @v $q AS d]", {"q": [1.0]}).nearest.alias == "d"
    assert parse("*suf").where.value == ("suffix", "suf") and parse("*in*").where.value == ("infix", "in")


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, title string, tag string, n string, place string")


INDEX = Index("i", "id", (Field("title", TEXT), Field("tag", TAG), Field("n", NUMERIC), Field("place", GEO)))
ROWS5 = [
    ("1", "The quick brown fox", "a,B", "1", "2.0,48.0"),
    ("2", "quick lazy dog_house", "b", "2.5", None),
    ("3", None, None, None, None),
    ("4", "brown\\-bear", "c", "nope", "0,0"),
    ("5", "quick red brown", "c d", "inf", "0,0"),
    ("6", "quick red brown", "c d", "9", "200,0"),
    ("7", "quick very red brown", "C D", "9", "10,10"),
]


def keys(df):
    return sorted(r[0] for r in df.select("__key").collect())


def test_admission_and_predicates(spark):
    df = docs(spark, ROWS5)
    assert keys(admit(df, INDEX)) == ["1", "2", "3", "7"]
    for q, want in {
        "*": "1237",
        "quick": "127",
        "-quick": "3",
        "quick -lazy": "17",
        "@tag:{b}": "12",
        "@tag:{c d}": "7",
        "@n:[(1 9]": "27",
        "@title:*": "127",
        '"quick brown"': "1",
        '"quick brown"~2': "17",
        "dog_house": "2",
        "brow*": "17",
        "@place:[2 48 10 km]": "1",
        "the": "",
        "~lazy": "1237",
        "(quick lazy) | @n:[9 9]": "27",
    }.items():
        assert keys(matching(df, INDEX, q)) == list(want), q


def test_sort_puts_missing_last(spark):
    df = docs(spark, ROWS5)
    for way in (True, False):
        assert [r[0] for r in search(df, INDEX, "*", sort=("n", way), returns=[]).collect()][-1] == "3"


def test_synonyms_and_empty(spark):
    index = Index("i", "id", INDEX.fields, synonyms=(frozenset({"quick", "fast"}),))
    assert keys(matching(docs(spark, ROWS5), index, "fast")) == ["1", "2", "7"]
    assert keys(matching(docs(spark, ROWS5).limit(0), index, "fast")) == []


def test_aggregate_nulls(spark):
    df = docs(spark, ROWS5)
    r = aggregate("i * GROUPBY 0 REDUCE COUNT 0 AS c REDUCE COUNT_DISTINCT 1 @n AS d REDUCE SUM 1 @n AS s REDUCE AVG 1 @n AS a", {"i": (df, INDEX)}).collect()
    assert [tuple(x) for x in r] == [(4.0, 4.0, 12.5, 12.5 / 3)]
    assert aggregate("i absent GROUPBY 0 REDUCE COUNT 0 AS c", {"i": (df, INDEX)}).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("Ab,c_d  É\\-f",), (None,), ("",)], "x string").select(text.tokens(F.col("x")))
    assert [r[0] for r in df.collect()] == [["ab", "c_d", "é-f"], [], []]
    assert text.words_of("Ab,c_d") == ["ab", "c_d"]


DOC = {"a": [1, 2, {"b": 3}], "c": {"b": 4.5, "d": [5, 6, 7]}, "e": True}


@pytest.mark.parametrize(
    ("path", "want"),
    [("$.a[0]", [1]), ("$.a[-1].b", [3]), ("$..b", [3, 4.5]), ("$.c.d[1:]", [6, 7]), ("$.c.d[:-1]", [5, 6]), ("$.c.*", [4.5, [5, 6, 7]]), ("$.zz", []), ("max($..b)", 4.5), ("avg($.c.d[*])", 6.0), ("c.b", [4.5]), ("$['e']", [True])],
)
def test_jsonpath(spark, path, want):
    df = spark.createDataFrame([(json.dumps(DOC),), ("no json",), (None,)], "d string")
    got = [r[0] for r in df.select(jsonpath.get(F.col("d"), path)).collect()]
    assert [json.loads(got[0]), *got[1:]] == [want, None, None]


def test_json_edits(spark):
    df = spark.createDataFrame([(json.dumps(DOC),)], "d string")

    def edited(path, f, **kw):
        return json.loads(df.select(jsonpath.edit(F.col("d"), path, f, **kw)).first()[0])

    assert edited("$.c.d[*]", lambda x: x * 2)["c"]["d"] == [10, 12, 14]
    assert edited("$.a[0:2]", lambda x: jsonpath.DELETE)["a"] == [{"b": 3}]
    assert edited("$.new", lambda x: "v", create=True)["new"] == "v"
    assert edited("$.e", lambda x: not x)["e"] is False
    patch = F.lit(json.dumps({"c": {"b": None, "x": 1}}))
    assert json.loads(df.select(jsonpath.merge_patch(F.col("d"), patch)).first()[0])["c"] == {"d": [5, 6, 7], "x": 1}


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_lists(spark):
    df = spark.createDataFrame([("k", i, e) for i, e in enumerate("abcab")], "key string, pos long, elem string")
    elems = lambda d: "".join(r[0] for r in d.orderBy("pos").select("elem").collect())
    assert elems(ks.list_range(df, -3, -2)) == "ca"
    assert elems(ks.list_remove(df, "a", 1)) == "bcab" and elems(ks.list_remove(df, "a")) == "bcb"
    assert elems(ks.list_insert(df, "b", "X")) == "aXbcab"
    new = spark.createDataFrame([("k", 0, "x"), ("k", 1, "y")], "key string, ordinal int, elem string")
    assert elems(ks.list_push(df, new, left=True)) == "yxabcab"
    assert table(ks.list_positions(df, "a", rank=-1), "index") == [(4 - 1,)]
    assert elems(ks.list_set(df, -1, "Z")) == "abcaZ"
    assert elems(ks.list_move(df, "k", "k")) == "babca"


def test_zadd_and_pop(spark):
    old = spark.createDataFrame([("z", "a", 1.0), ("z", "b", 5.0)], "key string, member string, score double")
    new = spark.createDataFrame([("z", "a", 3.0), ("z", "b", 2.0), ("z", "c", 4.0)], "key string, member string, score double")
    assert table(ks.zadd(old, new, only="GT"), "member", "score") == [("a", 3.0), ("b", 5.0), ("c", 4.0)]
    assert table(ks.zadd(old, new, only="NX"), "member", "score") == [("a", 1.0), ("b", 5.0), ("c", 4.0)]
    assert table(ks.zadd(old, new, only="XX"), "member", "score") == [("a", 3.0), ("b", 2.0)]
    assert table(ks.zadd(old, new, incr=True), "member", "score") == [("a", 4.0), ("b", 7.0), ("c", 4.0)]
    assert table(ks.pop(old, 1, most=True)[1], "member") == [("a",)]


def test_strings_and_keys(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "x")], "key string, value string")
    more = spark.createDataFrame([("a", "2"), ("c", "7")], "key string, delta string")
    assert table(ks.increment(df, more), "key", "value") == [("a", 7), ("b", None), ("c", 7)]
    assert table(ks.append(df, spark.createDataFrame([("a", "!"), ("d", "n")], "key string, value string")), "key", "value") == [("a", "5!"), ("b", "x"), ("d", "n")]
    assert table(ks.rename(df, "a", "b"), "key", "value") == [("b", "5")]
    assert table(ks.rename(df, "a", "b", if_absent=True), "key") == [("a",), ("b",)]
    assert table(ks.rename(df, "zz", "b"), "key") == [("a",), ("b",)]
    assert table(ks.copy(df, "a", "n"), "key") == [("a",), ("b",), ("n",)]
    assert table(ks.upsert(df, spark.createDataFrame([("a", "9"), ("q", "1")], "key string, value string"), only="NX"), "key", "value") == [("a", "5"), ("b", "x"), ("q", "1")]
    one = spark.createDataFrame([("hello",)], "x string")
    assert one.select(ks.get_range(F.col("x"), -3, -2), ks.set_range(F.col("x"), 7, "yo")).first() == ("ll", "hello\0\0yo")


def test_sketch_bounds(spark):
    df = spark.range(2000).select((F.col("id") % 500).cast("string").alias("x"))
    bloom = sketches.bloom(df, "x", 1000, 0.01)
    other = spark.range(10_000, 12_000).select(F.col("id").cast("string").alias("x"))
    assert sketches.bloom_query(bloom, df, "x", 1000, 0.01).filter("not maybe").count() == 0
    assert sketches.bloom_query(bloom, other, "x", 1000, 0.01).filter("maybe").count() < 60
    s = sketches.cms(df, "x", width=3000)
    assert sketches.cms_query(s, df.distinct(), "x", width=3000).filter("estimate < 4 or estimate > 8").count() == 0


def test_bits(spark):
    one = spark.createDataFrame([(-1, 120)], "v long, w long")
    got = one.select(sketches.bit_field(F.col("v"), 0, 8), sketches.bit_field(F.col("v"), 0, 8, signed=True), sketches.bit_add(F.col("w"), F.lit(10), 8), sketches.bit_add(F.col("w"), F.lit(10), 8, "SAT"), sketches.bit_add(F.col("w"), F.lit(10), 8, "FAIL")).first()
    assert tuple(got) == (255, -1, -126, 127, None)


def test_claim(spark):
    now = dt.datetime(2024, 1, 1, 1)
    pending = spark.createDataFrame([("k", "g", "a", 1, 0, dt.datetime(2024, 1, 1), 1), ("k", "g", "a", 2, 0, now, 1)], "key string, grp string, consumer string, ms long, seq long, delivered_at timestamp, deliveries long")
    out = logs.claim(pending, "b", F.lit(now), 1000)
    assert table(out, "ms", "consumer", "deliveries") == [(1, "b", 2), (2, "a", 1)]


def test_streaming(spark, tmp_path):
    rows = [("k", float(i), 1.0) for i in range(6)]
    spark.createDataFrame(rows, "key string, at double, quantity double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.tail(spark, str(tmp_path / "in"), "key string, at double, quantity double")
    q = streams.throttle(stream, burst=1, count=1, period=2.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = spark.createDataFrame(rows, "key string, at double, quantity double")
    assert table(spark.table("limited"), "at", "limited") == table(logs.throttle(batch, burst=1, count=1, period=2.0), "at", "limited")
    done = streams.consume(streams.subscribe(stream.withColumnRenamed("key", "channel"), "k*"), "group", str(tmp_path / "cp"), str(tmp_path / "out"))
    done.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_later_rows_replace_earlier_ones(spark):
    old = spark.createDataFrame([("a", "5"), ("b", "x")], "key string, value string")
    new = spark.createDataFrame([(0, "c", "x"), (1, "c", "y"), (2, "a", "9")], "ordinal int, key string, value string")
    assert table(ks.upsert(old, new), "key", "value") == [("a", "9"), ("b", "x"), ("c", "y")]
    assert table(ks.upsert(old, new, only="NX"), "key", "value") == [("a", "5"), ("b", "x"), ("c", "x")]
    scored = spark.createDataFrame([("k", "m", 2.0), ("k", "m", 3.0)], "key string, member string, score double")
    none = scored.limit(0)
    assert [table(ks.zadd(none, scored, only=o), "member", "score") for o in ("", "NX", "GT", "LT")] == [[("m", s)] for s in (3.0, 2.0, 3.0, 2.0)]
    assert table(ks.zadd(none, scored, incr=True), "member", "score") == [("m", 5.0)]


def test_copy_of_a_missing_key_changes_nothing(spark):
    df = spark.createDataFrame([("a", "5"), ("b", "x")], "key string, value string")
    assert table(ks.copy(df, "zz", "b", replace=True), "key", "value") == [("a", "5"), ("b", "x")]
    assert table(ks.copy(df, "a", "b", replace=True), "key", "value") == [("a", "5"), ("b", "5")]
    assert table(ks.copy(df, "a", "b"), "key", "value") == [("a", "5"), ("b", "x")]


def test_set_range_counts_bytes(spark):
    one = spark.createDataFrame([("éé",)], "x string")
    assert one.select(ks.set_range(F.col("x"), 2, "Z"), ks.set_range(F.col("x"), 2, "ab"), ks.set_range(F.col("x"), 5, "")).first() == ("éZ�", "éab", "éé")


def test_timefmt_has_all_directives(spark):
    import datetime

    from quillon.functions import expr

    times = (0.0, 1767225600.0, 1773532800.0, 951782399.0)
    df = spark.createDataFrame([(t,) for t in times], "ts double")
    for fmt in ("%e %s", "%G-W%V-%u %g", "%U %W %w %j %C %y", "%c|%q|%", "%k %l %I %p %P", "%D %R %r %h %n%t%%", "it's %A, %B %d"):
        got = df.select("ts", expr.compile_text(f'timefmt(@ts, "{fmt}")', lambda n: expr.number(F.col(n))).col.alias("x"))
        assert {r.ts: r.x for r in got.collect()} == {t: datetime.datetime.fromtimestamp(t, datetime.UTC).strftime(fmt) for t in times}, fmt
    number = lambda n: expr.number(F.col(n))
    assert df.select(expr.compile_text("nothing(@ts)", number).col, expr.compile_text("abs(@ts, 1)", number).col).first() == (None, None)


def test_negative_index_beyond_the_first(spark):
    one = spark.createDataFrame([('{"a":[1,2,3]}',)], "doc string")
    assert one.select(jsonpath.get(F.col("doc"), "$.a[-5]"), jsonpath.get(F.col("doc"), "$.a[-1]"), jsonpath.get(F.col("doc"), "$.a[3]")).first() == ("[1]", "[3]", "[]")


def test_json_lengths(spark):
    doc = '{"a":"héy","b":[1,"x",true,null,2.5],"o":{"p":1},"n":5,"t":"[1]"}'
    d = F.col("doc")
    one = spark.createDataFrame([(doc,), ("[1,2]",), (None,)], "doc string")
    got = one.select(jsonpath.length(d, "$.a"), jsonpath.length(d, "$.b"), jsonpath.length(d, "$.o"), jsonpath.length(d, "$.n"), jsonpath.length(d, "$.t"), jsonpath.length(d)).collect()
    assert [tuple(r) for r in got] == [(4, 5, 1, None, 3, 5), (None, None, None, None, None, 2), (None,) * 6]
    assert one.select(jsonpath.index_of(d, "$.b", '"x"'), jsonpath.index_of(d, "$.b", "2.5", -1), jsonpath.index_of(d, "$.b", "1", 1), jsonpath.index_of(d, "$.a", "1")).first() == (1, 4, -1, None)


def test_bit_not(spark):
    from quillon.operators import sketches

    bits = spark.createDataFrame([(1, 0), (1, 9), (2, 3)], "key int, bit long")
    assert table(sketches.bit_not(bits, 1), "bit") == [(b,) for b in range(16) if b not in (0, 9)]
    assert table(sketches.bit_not(bits, 7), "bit") == []


def test_search_command_options(spark):
    from quillon.operators.search import search_command

    df = spark.createDataFrame([("a", "one two", 1.0), ("b", "two", 2.5), ("c", None, None)], "id string, t string, n double")
    tables = {"x": (df, Index("x", "id", (Field("t", TEXT), Field("n", NUMERIC))))}
    run = lambda c: [tuple(r) for r in search_command(c, tables).collect()]
    assert run("x * SORTBY n DESC WITHSORTKEYS RETURN 3 t AS words") == [("b", "two", "#2.5"), ("a", "one two", "#1"), ("c", None, None)]
    assert run("x two NOCONTENT LIMIT 1 5") == [("b",)]
    assert run("x '@n:[$low 9]' NOCONTENT PARAMS 2 low 2 TIMEOUT 5") == [("b",)]
    assert run("x 'one | two' NOCONTENT FILTER n -inf (2.5") == [("a",)]
    for wrong in ("x", "x * LIMIT 1", "x * RETURN", "x * NOSUCH"):
        with pytest.raises((ValueError, IndexError)):
            run(wrong)
