"""Queries of key-space commands, one by one, over whole tables, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, jsonpath
from .operators import keyspace as ks
from .operators import logs, sketches
from .queries import ORACLES, QUERIES, log, query, scores_by_priority, turns, zset
from .sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

_C = "(SELECT c_custkey::VARCHAR AS key, c_name AS value FROM customer)"
_H = "(SELECT c_custkey::VARCHAR AS key, unnest(['name','segment','nation']) AS field, unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)"
_S = "(SELECT DISTINCT o_orderpriority AS key, o_custkey::VARCHAR AS member FROM orders)"
_P = "(SELECT o_orderpriority AS key, o_custkey::VARCHAR AS member, count(*)::DOUBLE AS score FROM orders GROUP BY 1,2)"
_Z = "(SELECT o_custkey::VARCHAR AS key, o_orderkey::VARCHAR AS member, o_totalprice AS score FROM orders)"
_ZR = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member)-1 AS r, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC)-1 AS rr FROM {_Z})"
_L = "(SELECT conv_id::VARCHAR AS key, turn AS pos, role AS elem, row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS last, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)"
_E = "(SELECT event_id::VARCHAR AS key, CASE WHEN event_id%3<>0 THEN date_trunc('second', ts) END AS expire_at, event_id FROM events)"
_ASKED = "(VALUES (0,'7'),(1,'nope'),(2,'3'),(3,'7')) t(i,k)"
URGENT, HIGH = "1-URGENT", "2-HIGH"


def strings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))


def numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_nationkey").cast("string").alias("value"))


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(x).cast("string").alias("value")) for f, x in (("name", "c_name"), ("segment", "c_mktsegment"), ("nation", "c_nationkey"))))
    return c.select(F.col("c_custkey").cast("string").alias("key"), F.explode(pairs).alias("x")).select("key", "x.*")


def sets(spark: SparkSession, sf: str) -> DataFrame:
    return scores_by_priority(spark, sf).select("key", "member")


def expiring(spark: SparkSession, sf: str) -> DataFrame:
    at = F.when(F.col("event_id") % 3 != 0, F.date_trunc("second", "ts").cast("timestamp"))
    return table(spark, sf, "events").select(F.col("event_id").cast("string").alias("key"), at.alias("expire_at"))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "7"), (1, "nope"), (2, "3"), (3, "7")], "ordinal int, key string")


def tens(df: DataFrame) -> DataFrame:
    return df.filter("cast(key as long) % 10 = 0")


# --- strings


@query(f"SELECT key, CASE WHEN key::BIGINT%10=0 THEN upper(value)||'!' ELSE value END AS value FROM {_C}")
def string_mset(spark, sf):
    c = strings(spark, sf)
    new = tens(c).select("key", F.upper("value").alias("value"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal"))
    return ks.upsert(c, new.withColumn("value", F.when(F.col("ordinal") == 1, F.concat("value", F.lit("!"))).otherwise(F.col("value"))))


@query(f"SELECT key, value FROM {_C} UNION ALL SELECT 'n'||key, value FROM {_C} WHERE key::BIGINT%10=0")
def string_setnx(spark, sf):
    c = strings(spark, sf)
    return ks.upsert(c, tens(c).withColumn("value", F.lit("old")).unionByName(tens(c).withColumn("key", F.concat(F.lit("n"), "key"))), only="NX")


@query(f"SELECT key, CASE WHEN key='3' THEN 'x' ELSE value END AS value FROM {_C}")
def string_set_xx(spark, sf):
    return ks.upsert(strings(spark, sf), spark.createDataFrame([("3", "x"), ("nope", "x")], "key string, value string"), only="XX")


@query(f"SELECT key, value FROM {_C} UNION ALL SELECT * FROM (VALUES ('n1','a'),('n2','b')) t")
def string_msetnx(spark, sf):
    c = strings(spark, sf)
    refused = ks.set_if_none(c, spark.createDataFrame([("n3", "a"), ("3", "b")], "key string, value string"))
    return ks.set_if_none(refused, spark.createDataFrame([("n1", "a"), ("n2", "b")], "key string, value string"))


@query(f"SELECT key, value||'-'||key AS value FROM {_C} UNION ALL SELECT 'nope', 'x'")
def string_append(spark, sf):
    c = strings(spark, sf)
    more = c.select("key", F.concat(F.lit("-"), "key").alias("value")).unionByName(spark.createDataFrame([("nope", "x")], "key string, value string"))
    return ks.append(c, more)


@query(f"SELECT key, key||value AS value FROM {_C}")
def string_prepend(spark, sf):
    c = strings(spark, sf)
    return ks.append(c, c.select("key", F.col("key").alias("value")), before=True)


@query("SELECT c_custkey::VARCHAR AS key, c_nationkey+7 AS value FROM customer UNION ALL SELECT 'nope', 3")
def string_incrby(spark, sf):
    n = numbers(spark, sf)
    deltas = n.select("key", F.explode(F.array(F.lit(3), F.lit(4))).alias("delta")).unionByName(spark.createDataFrame([("nope", 3)], "key string, delta int"))
    return ks.increment(n, deltas)


@query("SELECT c_custkey::VARCHAR AS key, c_nationkey-5 AS value FROM customer")
def string_decrby(spark, sf):
    n = numbers(spark, sf)
    return ks.increment(n, n.select("key", F.lit(-5).alias("delta")))


@query("SELECT c_custkey::VARCHAR AS key, c_nationkey+0.25::DOUBLE AS value FROM customer")
def string_incrbyfloat(spark, sf):
    n = numbers(spark, sf)
    return ks.increment(n, n.select("key", F.lit(0.25).alias("delta")), real=True).select("key", F.col("value").cast("double").alias("value"))


@query("SELECT c_custkey::VARCHAR AS key, NULL::DOUBLE AS value FROM customer")
def string_incr_no_number(spark, sf):
    c = strings(spark, sf)
    return ks.increment(c, c.select("key", F.lit(1).alias("delta"))).select("key", F.col("value").cast("double").alias("value"))


@query(f"SELECT key, strlen(value)::BIGINT AS n FROM {_C}")
def string_strlen(spark, sf):
    return strings(spark, sf).select("key", F.octet_length("value").cast("long").alias("n"))


@query(f"SELECT key, 'Hello'||substr(value, 6) AS value FROM {_C}")
def string_setrange(spark, sf):
    return strings(spark, sf).select("key", ks.set_range(F.col("value"), 0, "Hello").alias("value"))


@query(f"SELECT key, value, key::BIGINT%10=0 AS gone FROM {_C}")
def string_getdel(spark, sf):
    c = strings(spark, sf)
    got, left = ks.take(c, tens(c))
    return got.withColumn("gone", F.lit(True)).unionByName(left.withColumn("gone", F.lit(False)))


@query(f"SELECT key, CASE WHEN event_id%2=0 THEN TIMESTAMP '2030-01-01' ELSE expire_at END AS expire_at FROM {_E}")
def string_getex(spark, sf):
    e = expiring(spark, sf)
    return ks.get_and_expire(e, e.filter("cast(key as long) % 2 = 0"), F.lit("2030-01-01").cast("timestamp"))[1]


# --- keys


@query(f"SELECT count(*) AS n FROM {_ASKED} JOIN {_C} ON key=k")
def key_exists(spark, sf):
    return ks.exists(strings(spark, sf), asked(spark))


@query(f"SELECT count(*) AS n FROM {_ASKED} JOIN {_C} ON key=k")
def key_touch(spark, sf):
    return ks.touch(strings(spark, sf), asked(spark))


@query(f"SELECT key, value FROM {_C} WHERE key NOT IN ('7','3')")
def key_del(spark, sf):
    return ks.delete(strings(spark, sf), asked(spark))


@query(f"SELECT CASE key WHEN '3' THEN '7' ELSE key END AS key, value FROM {_C} WHERE key<>'7'")
def key_rename(spark, sf):
    return ks.rename(ks.rename(strings(spark, sf), "3", "7"), "nope", "5")


@query(f"SELECT CASE key WHEN '3' THEN 'n' ELSE key END AS key, value FROM {_C}")
def key_renamenx(spark, sf):
    return ks.rename(ks.rename(strings(spark, sf), "3", "7", if_absent=True), "3", "n", if_absent=True)


@query(f"SELECT key, CASE key WHEN '7' THEN (SELECT value FROM {_C} WHERE key='3') ELSE value END AS value FROM {_C} UNION ALL SELECT 'n', value FROM {_C} WHERE key='3'")
def key_copy(spark, sf):
    c = ks.copy(ks.copy(strings(spark, sf), "3", "7", replace=True), "3", "n")
    return ks.copy(ks.copy(c, "3", "5"), "nope", "5", replace=True)  # neither changes anything


@query(f"SELECT k AS key, CASE WHEN k='nope' THEN 'none' ELSE 'string' END AS type FROM {_ASKED} UNION ALL SELECT '1-URGENT', 'set'")
def key_type(spark, sf):
    keys = asked(spark).select("key").unionByName(spark.createDataFrame([(URGENT,)], "key string"))
    return ks.key_type({"string": strings(spark, sf), "set": sets(spark, sf)}, keys)


@query(f"SELECT count(*) AS n FROM {_C}")
def key_dbsize(spark, sf):
    return strings(spark, sf).agg(F.count_distinct("key").alias("n"))


@query(f"SELECT key FROM {_C} WHERE regexp_full_match(key, '[12].*7')")
def key_glob(spark, sf):
    return ks.scan(strings(spark, sf).select("key"), match="[12]*7")


_AT = "TIMESTAMP '2024-01-10'"


def _expire(name: str, only: str, cond: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = expiring(spark, sf)
        return ks.expire(e, e.filter("cast(key as long) % 2 = 0"), F.lit("2024-01-10").cast("timestamp"), only)

    run.__name__ = name
    query(f"SELECT key, CASE WHEN event_id%2=0 AND ({cond}) THEN {_AT} ELSE expire_at END AS expire_at FROM {_E}")(run)


for _name, _only, _cond in (("key_expire", "", "true"), ("key_expire_nx", "NX", "expire_at IS NULL"), ("key_expire_xx", "XX", "expire_at IS NOT NULL"), ("key_expire_gt", "GT", f"coalesce({_AT}>expire_at,false)"), ("key_expire_lt", "LT", f"expire_at IS NULL OR {_AT}<expire_at")):
    _expire(_name, _only, _cond)


@query(f"SELECT key, CASE WHEN event_id%2<>0 THEN expire_at END AS expire_at FROM {_E}")
def key_persist(spark, sf):
    e = expiring(spark, sf)
    return ks.persist(e, e.filter("cast(key as long) % 2 = 0"))


@query(f"SELECT k AS key, CASE WHEN key IS NULL THEN -2 WHEN expire_at IS NULL THEN -1 ELSE epoch(expire_at)::BIGINT END AS at FROM (VALUES ('1'),('3'),('nope')) t(k) LEFT JOIN {_E} ON key=k")
def key_expiretime(spark, sf):
    return ks.expire_time(expiring(spark, sf), spark.createDataFrame([("1",), ("3",), ("nope",)], "key string"))


@query(f"SELECT k AS key, CASE WHEN key IS NULL THEN -2 WHEN expire_at IS NULL THEN -1 ELSE epoch_ms(expire_at)-epoch_ms(TIMESTAMP '2020-01-01') END AS ttl FROM (VALUES ('1'),('3'),('nope')) t(k) LEFT JOIN {_E} ON key=k")
def key_pttl(spark, sf):
    return ks.ttl(expiring(spark, sf), F.lit("2020-01-01").cast("timestamp"), "ms", spark.createDataFrame([("1",), ("3",), ("nope",)], "key string"))


# --- hashes


@query(f"SELECT key, value FROM {_H} WHERE field='segment'")
def hash_get(spark, sf):
    return hashes(spark, sf).filter("field = 'segment'").select("key", "value")


@query(f"SELECT key, field, value FROM {_H} WHERE key='7'")
def hash_getall(spark, sf):
    return hashes(spark, sf).filter("key = '7'")


@query(f"SELECT i AS ordinal, k AS key, f AS field, value FROM (VALUES (0,'7','name'),(1,'7','nope'),(2,'3','nation')) t(i,k,f) LEFT JOIN {_H} h ON h.key=k AND h.field=f")
def hash_mget(spark, sf):
    want = spark.createDataFrame([(0, "7", "name"), (1, "7", "nope"), (2, "3", "nation")], "ordinal int, key string, field string")
    return ks.multi_get(hashes(spark, sf), want, ("key", "field")).select("ordinal", "key", "field", "value")


@query(f"SELECT key, field, CASE WHEN field='name' THEN lower(value) ELSE value END AS value FROM {_H} UNION ALL SELECT c_custkey::VARCHAR, 'new', 'x' FROM customer")
def hash_set(spark, sf):
    h = hashes(spark, sf)
    new = h.filter("field = 'name'").withColumn("value", F.lower("value"))
    return ks.upsert(h, new.unionByName(new.withColumns({"field": F.lit("new"), "value": F.lit("x")})), keys=("key", "field"))


@query(f"SELECT key, field, value FROM {_H} UNION ALL SELECT c_custkey::VARCHAR, 'new', 'x' FROM customer")
def hash_setnx(spark, sf):
    h = hashes(spark, sf)
    new = h.filter("field = 'name'").withColumn("value", F.lit("x"))
    return ks.upsert(h, new.unionByName(new.withColumn("field", F.lit("new"))), keys=("key", "field"), only="NX")


@query(f"SELECT key, field, value FROM {_H} WHERE field<>'nation' OR key::BIGINT%10<>0")
def hash_del(spark, sf):
    h = hashes(spark, sf)
    return ks.delete(h, tens(h).filter("field = 'nation'"), ("key", "field"))


@query(f"SELECT key, count(*) AS n FROM {_H} GROUP BY 1")
def hash_len(spark, sf):
    return ks.card(hashes(spark, sf))


@query(f"SELECT key, field FROM {_H}")
def hash_keys(spark, sf):
    return hashes(spark, sf).select("key", "field")


@query(f"SELECT key, value FROM {_H}")
def hash_vals(spark, sf):
    return hashes(spark, sf).select("key", "value")


@query(f"SELECT key, strlen(value)::BIGINT AS n FROM {_H} WHERE field='name'")
def hash_strlen(spark, sf):
    return hashes(spark, sf).filter("field = 'name'").select("key", F.octet_length("value").cast("long").alias("n"))


@query("SELECT c_custkey::VARCHAR AS key, 'nation' AS field, c_nationkey+2 AS value FROM customer UNION ALL SELECT 'nope', 'nation', 2")
def hash_incrby(spark, sf):
    h = hashes(spark, sf).filter("field = 'nation'")
    deltas = h.select("key", "field", F.lit(2).alias("delta")).unionByName(spark.createDataFrame([("nope", "nation", 2)], "key string, field string, delta int"))
    return ks.increment(h, deltas, on=("key", "field"))


@query(f"SELECT k AS key, f AS field, value IS NOT NULL AS there FROM (VALUES ('7','name'),('7','nope')) t(k,f) LEFT JOIN {_H} h ON h.key=k AND h.field=f")
def hash_exists(spark, sf):
    want = spark.createDataFrame([(0, "7", "name"), (1, "7", "nope")], "ordinal int, key string, field string")
    return ks.multi_get(hashes(spark, sf), want, ("key", "field")).select("key", "field", F.col("value").isNotNull().alias("there"))


@query(f"SELECT key, field, CASE WHEN field='nation' AND key::BIGINT%10=0 THEN {_AT} END AS expire_at FROM {_H}")
def hash_expire(spark, sf):
    h = hashes(spark, sf).withColumn("expire_at", F.lit(None).cast("timestamp"))
    return ks.expire_rows(h, tens(h).filter("field = 'nation'"), F.lit("2024-01-10").cast("timestamp"), ("key", "field")).select("key", "field", "expire_at")


@query(f"SELECT key, field FROM {_H} WHERE NOT (field='nation' AND key::BIGINT%10=0)")
def hash_after_expiry(spark, sf):
    h = hashes(spark, sf).withColumn("expire_at", F.lit(None).cast("timestamp"))
    marked = ks.expire_rows(h, tens(h).filter("field = 'nation'"), F.lit("2024-01-10").cast("timestamp"), ("key", "field"))
    return ks.live(marked, F.lit("2024-01-11").cast("timestamp")).select("key", "field")


# --- sets


@query(f"SELECT key, member FROM {_S} UNION ALL SELECT '1-URGENT', 'new'")
def set_add(spark, sf):
    new = spark.createDataFrame([(URGENT, "new"), (URGENT, "new")], "key string, member string")
    return ks.upsert(sets(spark, sf), new, keys=("key", "member"))


@query(f"SELECT key, member FROM {_S} WHERE NOT (key='1-URGENT' AND member::BIGINT%2=0)")
def set_rem(spark, sf):
    s = sets(spark, sf)
    return ks.delete(s, s.filter("key = '1-URGENT' and cast(member as long) % 2 = 0"), ("key", "member"))


@query(f"SELECT member FROM {_S} WHERE key='1-URGENT'")
def set_members(spark, sf):
    return sets(spark, sf).filter(F.col("key") == URGENT).select("member")


@query(f"SELECT i AS ordinal, m AS member, s.key IS NOT NULL AS there FROM (VALUES (0,'1'),(1,'nope'),(2,'4')) t(i,m) LEFT JOIN (SELECT * FROM {_S} WHERE key='1-URGENT') s ON s.member=m")
def set_mismember(spark, sf):
    want = spark.createDataFrame([(0, "1"), (1, "nope"), (2, "4")], "ordinal int, member string")
    return ks.multi_get(sets(spark, sf).filter(F.col("key") == URGENT), want, ("member",)).select("ordinal", "member", F.col("key").isNotNull().alias("there"))


@query(f"SELECT count(*) AS n FROM (SELECT member FROM {_S} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1 HAVING count(*)=2)")
def set_intercard(spark, sf):
    return ks.inter(sets(spark, sf), [URGENT, HIGH]).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT member FROM {_S} WHERE key='1-URGENT' AND member NOT IN (SELECT member FROM {_S} WHERE key='2-HIGH')")
def set_diff_of_priorities(spark, sf):
    return ks.diff(sets(spark, sf), [URGENT, HIGH])


_STORES = {
    "set_unionstore": (lambda s: ks.union(s, [URGENT, HIGH]), f"SELECT DISTINCT member FROM {_S} WHERE key IN ('1-URGENT','2-HIGH')"),
    "set_interstore": (lambda s: ks.inter(s, [URGENT, HIGH]), f"SELECT member FROM {_S} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1 HAVING count(*)=2"),
    "set_diffstore": (lambda s: ks.diff(s, [URGENT, HIGH]), f"SELECT member FROM {_S} WHERE key='1-URGENT' AND member NOT IN (SELECT member FROM {_S} WHERE key='2-HIGH')"),
}


def _stored(name: str, make, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = sets(spark, sf)
        return ks.store(s, "5-LOW", make(s))

    run.__name__ = name
    query(f"SELECT key, member FROM {_S} WHERE key<>'5-LOW' UNION ALL SELECT '5-LOW', member FROM ({sql})")(run)


for _name, (_make, _sql) in _STORES.items():
    _stored(_name, _make, _sql)


@query(f"SELECT DISTINCT CASE WHEN key='1-URGENT' AND member='1' THEN '2-HIGH' ELSE key END AS key, member FROM {_S}")
def set_move(spark, sf):
    return ks.move(ks.move(sets(spark, sf), URGENT, HIGH, "1"), URGENT, HIGH, "nope")


@query(f"SELECT key, least(count(*), 3) AS n, true AS own FROM {_S} GROUP BY 1")
def set_randmember(spark, sf):
    s = sets(spark, sf)
    drawn = ks.sample(s, 3, 11)
    return drawn.join(s.withColumn("own", F.lit(True)), ["key", "member"], "left").groupBy("key").agg(F.count_distinct("member").alias("n"), F.min(F.coalesce("own", F.lit(False))).alias("own"))


# --- sorted sets


def _zadd(name: str, only: str, score: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        z = scores_by_priority(spark, sf)
        even = z.filter("cast(member as long) % 2 = 0").withColumn("score", F.lit(2.0))
        return ks.zadd(z, even.unionByName(even.withColumn("key", F.lit("new"))).dropDuplicates(["key", "member"]), only=only)

    run.__name__ = name
    new = "" if only == "XX" else f" UNION ALL SELECT DISTINCT 'new', member, 2.0 FROM {_P} WHERE member::BIGINT%2=0"
    query(f"SELECT key, member, CASE WHEN member::BIGINT%2=0 THEN {score} ELSE score END AS score FROM {_P}{new}")(run)


for _name, _only, _score in (("zset_add", "", "2.0"), ("zset_add_nx", "NX", "score"), ("zset_add_gt", "GT", "greatest(score,2.0)"), ("zset_add_lt", "LT", "least(score,2.0)")):
    _zadd(_name, _only, _score)


@query(f"SELECT key, member, score+CASE WHEN key='1-URGENT' THEN 5 ELSE 0 END AS score FROM {_P}")
def zset_incrby(spark, sf):
    z = scores_by_priority(spark, sf)
    return ks.zadd(z, z.filter(F.col("key") == URGENT).withColumn("score", F.explode(F.array(F.lit(2.0), F.lit(3.0)))), incr=True)


@query(f"SELECT i AS ordinal, m AS member, score FROM (VALUES (0,'1'),(1,'nope'),(2,'4')) t(i,m) LEFT JOIN (SELECT * FROM {_P} WHERE key='1-URGENT') s ON s.member=m")
def zset_mscore(spark, sf):
    want = spark.createDataFrame([(0, "1"), (1, "nope"), (2, "4")], "ordinal int, member string")
    return ks.multi_get(scores_by_priority(spark, sf).filter(F.col("key") == URGENT), want, ("member",)).select("ordinal", "member", "score")


@query(f"SELECT key, member, score FROM {_P} WHERE NOT (key='1-URGENT' AND member='1')")
def zset_rem(spark, sf):
    return ks.delete(scores_by_priority(spark, sf), spark.createDataFrame([(URGENT, "1"), (URGENT, "nope")], "key string, member string"), ("key", "member"))


@query(f"SELECT key, member FROM {_ZR} WHERE NOT (r BETWEEN 1 AND 2)")
def zset_remrangebyrank(spark, sf):
    z = zset(spark, sf)
    return ks.remove_by(z, ks.range_by_rank(z, 1, 2)).select("key", "member")


@query(f"SELECT key, member FROM {_Z} WHERE NOT (score>50000 AND score<=150000)")
def zset_remrangebyscore(spark, sf):
    z = zset(spark, sf)
    return ks.remove_by(z, ks.range_by_score(z, 50000, 150000, low_open=True)).select("key", "member")


@query(f"SELECT key, member FROM {_Z} WHERE NOT (member>='2' AND member<'5')")
def zset_remrangebylex(spark, sf):
    z = zset(spark, sf)
    return ks.remove_by(z, ks.range_by_lex(z, "2", "5", high_open=True)).select("key", "member")


@query(f"SELECT key, count(*) AS n FROM {_Z} WHERE member>='2' AND member<'5' GROUP BY 1")
def zset_lexcount(spark, sf):
    return ks.card(ks.range_by_lex(zset(spark, sf), "2", "5", high_open=True))


@query(f"SELECT key, member, rr AS rank FROM {_ZR} WHERE rr<=1")
def zset_revrange(spark, sf):
    return ks.range_by_rank(zset(spark, sf), 0, 1, reverse=True).select("key", "member", "rank")


@query(f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS q FROM {_Z} WHERE score>=50000 AND score<150000) WHERE q<=2")
def zset_revrangebyscore(spark, sf):
    return ks.range_by_score(zset(spark, sf), 50000, 150000, high_open=True, reverse=True, count=2).select("key", "member")


@query(f"SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS q FROM {_Z} WHERE member>'2') WHERE q BETWEEN 2 AND 3")
def zset_revrangebylex(spark, sf):
    return ks.range_by_lex(zset(spark, sf), "2", None, low_open=True, reverse=True, offset=1, count=2).select("key", "member")


@query(f"SELECT key, member FROM {_ZR} WHERE rr<2")
def zset_pop_max(spark, sf):
    return ks.pop(zset(spark, sf), 2, most=True)[0].select("key", "member")


@query(f"SELECT count(*) AS n FROM (SELECT member FROM {_P} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1 HAVING count(*)=2)")
def zset_intercard(spark, sf):
    return ks.combine(scores_by_priority(spark, sf), [URGENT, HIGH], how="inter").agg(F.count(F.lit(1)).alias("n"))


_ZSTORES = {
    "zset_unionstore": (lambda z: ks.combine(z, [URGENT, HIGH], aggregate="MIN"), f"SELECT member, min(score) AS score FROM {_P} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1"),
    "zset_interstore": (lambda z: ks.combine(z, [URGENT, HIGH], how="inter"), f"SELECT member, sum(score) AS score FROM {_P} WHERE key IN ('1-URGENT','2-HIGH') GROUP BY 1 HAVING count(*)=2"),
    "zset_diffstore": (lambda z: ks.combine(z, [URGENT, HIGH], how="diff"), f"SELECT member, score FROM {_P} WHERE key='1-URGENT' AND member NOT IN (SELECT member FROM {_P} WHERE key='2-HIGH')"),
    "zset_rangestore": (lambda z: ks.range_by_rank(z.filter(F.col("key") == URGENT), 0, 4), f"SELECT member, score FROM {_P} WHERE key='1-URGENT' ORDER BY score, member LIMIT 5"),
}


def _zstored(name: str, make, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        z = scores_by_priority(spark, sf)
        return ks.store(z, "5-LOW", make(z))

    run.__name__ = name
    query(f"SELECT key, member, score FROM {_P} WHERE key<>'5-LOW' UNION ALL SELECT '5-LOW', member, score FROM ({sql})")(run)


for _name, (_make, _sql) in _ZSTORES.items():
    _zstored(_name, _make, _sql)


# --- lists


def _pushed(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select("key").distinct().select("key", F.posexplode(F.array(F.lit("a"), F.lit("b"))).alias("ordinal", "elem"))


@query(f"SELECT key, pos::BIGINT AS pos, elem FROM {_L} UNION ALL SELECT DISTINCT key, (last+o)::BIGINT, e FROM {_L}, (VALUES (1,'a'),(2,'b')) v(o,e)")
def list_rpush(spark, sf):
    return ks.list_push(turns(spark, sf), _pushed(spark, sf)).select("key", F.col("pos").cast("long").alias("pos"), "elem")


@query(f"SELECT key, pos::BIGINT AS pos, elem FROM {_L} UNION ALL SELECT DISTINCT key, (first-o)::BIGINT, e FROM {_L}, (VALUES (1,'a'),(2,'b')) v(o,e)")
def list_lpush(spark, sf):
    return ks.list_push(turns(spark, sf), _pushed(spark, sf), left=True).select("key", F.col("pos").cast("long").alias("pos"), "elem")


@query(f"SELECT key, pos::BIGINT AS pos, elem FROM {_L}")
def list_pushx_missing(spark, sf):
    new = spark.createDataFrame([("nope", 0, "x")], "key string, ordinal int, elem string")
    return ks.list_push(turns(spark, sf), new, if_exists=True).select("key", F.col("pos").cast("long").alias("pos"), "elem")


@query(f"SELECT key, elem FROM {_L} WHERE i<2")
def list_lpop(spark, sf):
    return ks.list_pop(turns(spark, sf), 2)[0].select("key", "elem")


@query(f"SELECT key, count(*) AS n FROM {_L} GROUP BY 1")
def list_len(spark, sf):
    return ks.card(turns(spark, sf))


@query(f"SELECT key, pos, CASE WHEN i=n-1 THEN 'x' ELSE elem END AS elem FROM {_L}")
def list_set(spark, sf):
    return ks.list_set(turns(spark, sf), -1, "x")


@query(f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY p)-1 AS pos, elem FROM (SELECT key, pos::DOUBLE AS p, elem FROM {_L} UNION ALL SELECT key, min(pos)-0.5, 'x' FROM {_L} WHERE elem='assistant' GROUP BY 1)")
def list_insert(spark, sf):
    return ks.list_insert(turns(spark, sf), "assistant", "x")


@query(f"SELECT key, pos, elem FROM {_L} WHERE i>=n-2")
def list_trim(spark, sf):
    return ks.list_range(turns(spark, sf), -2, -1)


@query(f"SELECT CASE WHEN key='0' AND i=n-1 THEN '1' ELSE key END AS key, elem FROM {_L}")
def list_rpoplpush(spark, sf):
    return ks.list_move(turns(spark, sf), "0", "1").select("key", "elem")


@query(f"SELECT key, elem FROM {_L} WHERE key='1'")
def list_first_nonempty(spark, sf):
    return ks.first_nonempty(turns(spark, sf), ["nope", "1", "0"]).select("key", "elem")


# --- JSON

_J = "(SELECT c_custkey::VARCHAR AS key, {'name': c_name, 'nation': {'id': c_nationkey, 'seg': c_mktsegment}, 'tags': [c_mktsegment, c_nationkey::VARCHAR, 'x']}::JSON AS doc FROM customer)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.struct(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("seg"))
    tags = F.array("c_mktsegment", F.col("c_nationkey").cast("string"), F.lit("x"))
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct(F.col("c_name").alias("name"), nation.alias("nation"), tags.alias("tags"))).alias("doc"))


@query(f"SELECT key, strlen(json_extract_string(doc,'$.name'))::BIGINT AS n FROM {_J}")
def json_strlen(spark, sf):
    return documents(spark, sf).select("key", jsonpath.length(F.col("doc"), "$.name").alias("n"))


@query(f"SELECT key, json_array_length(doc,'$.tags')::BIGINT AS n FROM {_J}")
def json_arrlen(spark, sf):
    return documents(spark, sf).select("key", jsonpath.length(F.col("doc"), "$.tags").alias("n"))


@query(f"SELECT key, len(json_keys(doc,'$.nation'))::BIGINT AS n, len(json_keys(doc))::BIGINT AS whole FROM {_J}")
def json_objlen(spark, sf):
    return documents(spark, sf).select("key", jsonpath.length(F.col("doc"), "$.nation").alias("n"), jsonpath.length(F.col("doc")).alias("whole"))


@query(f"SELECT key, unnest(json_keys(doc,'$.nation')) AS name FROM {_J}")
def json_objkeys(spark, sf):
    return documents(spark, sf).select("key", F.explode(jsonpath.keys(F.col("doc"), "$.nation")).alias("name"))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_mktsegment='BUILDING' THEN 0 ELSE -1 END::BIGINT AS at, 2::BIGINT AS x, -1::BIGINT AS before FROM customer")
def json_arrindex(spark, sf):
    d = F.col("doc")
    return documents(spark, sf).select("key", jsonpath.index_of(d, "$.tags", '"BUILDING"').alias("at"), jsonpath.index_of(d, "$.tags", '"x"', 1).alias("x"), jsonpath.index_of(d, "$.tags", '"x"', 0, 2).alias("before"))


@query(f"SELECT key, CASE WHEN key::BIGINT%10=0 THEN 'new' ELSE json_extract_string(doc,'$.name') END AS name FROM {_J}")
def json_mset(spark, sf):
    d = documents(spark, sf)
    both = ks.upsert(d, tens(d).withColumn("doc", F.lit('{"name":"new"}')))
    return both.select("key", jsonpath.get_one(F.col("doc"), "$.name").alias("name"))


@query(f"SELECT i AS ordinal, k AS key, json_extract_string(doc,'$.name') AS name FROM {_ASKED} LEFT JOIN {_J} ON key=k")
def json_mget(spark, sf):
    return ks.multi_get(documents(spark, sf), asked(spark)).select("ordinal", "key", jsonpath.get_one(F.col("doc"), "$.name").alias("name"))


@query(f"SELECT key, json_extract_string(doc,'$.name') AS name, NULL::VARCHAR AS gone FROM {_J}")
def json_del(spark, sf):
    left = jsonpath.edit(F.col("doc"), "$.nation.seg", lambda _: jsonpath.DELETE)
    return documents(spark, sf).select("key", left.alias("doc")).select("key", jsonpath.get_one(F.col("doc"), "$.name").alias("name"), jsonpath.get_one(F.col("doc"), "$.nation.seg").alias("gone"))


@query("SELECT c_custkey::VARCHAR AS key, c_nationkey::BIGINT AS id, 'y' AS seg, NULL::VARCHAR AS name FROM customer")
def json_merge(spark, sf):
    out = documents(spark, sf).select("key", jsonpath.merge_patch(F.col("doc"), F.lit('{"name":null,"nation":{"seg":"y"}}')).alias("doc"))
    one = lambda p: jsonpath.get_one(F.col("doc"), p)
    return out.select("key", one("$.nation.id").cast("long").alias("id"), one("$.nation.seg").alias("seg"), one("$.name").alias("name"))


@query("SELECT kind, count(*) AS n FROM (SELECT unnest(['string','object','integer','array']) AS kind FROM customer) GROUP BY 1")
def json_types(spark, sf):
    last = documents(spark, sf).select(F.explode(F.split(F.lit("name nation nation.id tags"), " ")).alias("p"), "doc")
    kinds = F.coalesce(*(F.when(F.col("p") == p, jsonpath.type_of(F.get_json_object(F.concat(F.lit("["), "doc", F.lit("]")), f"$[*].{p}"))) for p in ("name", "nation", "nation.id", "tags")))
    return last.select(kinds.alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- geo

_G = "(SELECT c_custkey AS member, ((c_custkey*37)%360-180)::DOUBLE AS lon, ((c_custkey*17)%170-85)::DOUBLE AS lat FROM customer)"
_KM = "2*6372.797560856*asin(sqrt(pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))"


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("member"), geo.lonlat((F.col("c_custkey") * 37 % 360 - 180).cast("double"), (F.col("c_custkey") * 17 % 170 - 85).cast("double")).alias("p"))


@query(f"SELECT a.member, round({_KM},3) AS km FROM {_G} a, {_G} b WHERE b.member=a.member+1")
def geo_dist(spark, sf):
    p = points(spark, sf)
    other = p.select((F.col("member") - 1).alias("member"), F.col("p").alias("q"))
    return p.join(other, "member").select("member", F.round(geo.haversine(F.col("p"), F.col("q")) / 1000, 3).alias("km"))


@query(f"SELECT b.member, round({_KM},3) AS km FROM {_G} a, {_G} b WHERE a.member=7 AND {_KM}<=3000")
def geo_radius_by_member(spark, sf):
    return geo.by_member(points(spark, sf), "member", 7, 3000, "km").select("member", F.round("distance", 3).alias("km"))


# --- bitmaps

_BITS = "(SELECT DISTINCT user_id AS key, date_diff('day', DATE '2024-01-01', ts::DATE) AS bit FROM events)"


def bits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("bit")).distinct()


for _op, _having in (("AND", "count(*)=2"), ("OR", "count(*)>0"), ("DIFF", "count(*)=1 AND max(key)=1"), ("ONE", "count(*)=1")):

    def _bitop(op: str, having: str) -> None:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return sketches.bit_operation(bits(spark, sf), [1, 2], op)

        run.__name__ = f"bit_{op.lower()}"
        query(f"SELECT bit FROM {_BITS} WHERE key IN (1,2) GROUP BY 1 HAVING {having}")(run)

    _bitop(_op, _having)


@query(f"SELECT i::BIGINT AS bit FROM range((SELECT (max(bit)//8+1)*8 FROM {_BITS} WHERE key=1)) t(i) WHERE i NOT IN (SELECT bit FROM {_BITS} WHERE key=1)")
def bit_not(spark, sf):
    return sketches.bit_not(bits(spark, sf), 1)


@query(f"SELECT key, count(*) AS n FROM {_BITS} WHERE bit BETWEEN 2 AND 9 GROUP BY 1")
def bit_count_range(spark, sf):
    return sketches.bit_count(bits(spark, sf), 2, 9)


# --- logs

_LOG = "(SELECT event_type AS key, event_id, (epoch_us(ts)//1000) AS ms, row_number() OVER (PARTITION BY event_type, (epoch_us(ts)//1000) ORDER BY ts, event_id)-1 AS seq FROM events)"


@query(f"SELECT key, count(*) AS n FROM {_LOG} GROUP BY 1")
def log_len(spark, sf):
    return ks.card(log(spark, sf))


@query(f"SELECT key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS q FROM {_LOG}) WHERE q<=5")
def log_revrange(spark, sf):
    return logs.log_range(log(spark, sf), count=5, reverse=True).select("key", "event_id")


_MS = "epoch_ms(TIMESTAMP '2024-01-10')"


@query(f"SELECT key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS q FROM {_LOG} WHERE ms>{_MS}) WHERE q<=7")
def log_read(spark, sf):
    e = log(spark, sf)
    last = e.select("key").distinct().select("key", F.unix_millis(F.lit("2024-01-10").cast("timestamp")).alias("last_ms"), F.lit(1 << 40).alias("last_seq"))
    return logs.log_read(e, last, 7).select("key", "event_id")


@query(f"SELECT key, event_id FROM {_LOG} WHERE ms>={_MS}")
def log_trim_minid(spark, sf):
    return logs.trim(log(spark, sf), least_ms=1704844800000).select("key", "event_id")


@query(f"SELECT key, event_id FROM {_LOG} WHERE event_id%10<>0")
def log_del(spark, sf):
    e = log(spark, sf)
    return ks.delete(e, e.filter("event_id % 10 = 0"), ("key", "ms", "seq")).select("key", "event_id")
