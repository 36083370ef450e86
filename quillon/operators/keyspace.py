"""Key spaces as tables: strings (key, value), lists (key, pos, elem), sets (key, member), hashes (key, field, value) and
sorted sets (key, member, score), each with an optional ``expire_at``. Writes return the new table."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import glob_pattern

# --- keys, scans and expiry


def live(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows that have not expired."""
    return df.filter(F.col("expire_at").isNull() | (F.col("expire_at") > (F.current_timestamp() if now is None else now)))


def expire(df: DataFrame, keys: DataFrame, at: Column, only: str = "") -> DataFrame:
    """Sets ``expire_at`` of ``keys``; ``only``: NX (has none), XX (has one), GT (later), LT (earlier, or has none)."""
    old = F.col("expire_at")
    cond = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": F.coalesce(at > old, F.lit(False)), "LT": old.isNull() | (at < old)}[only.upper()]
    marked = df.join(keys.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")
    return marked.withColumn("expire_at", F.when(F.col("__hit") & cond, at).otherwise(old)).drop("__hit")


def persist(df: DataFrame, keys: DataFrame) -> DataFrame:
    return expire(df, keys, F.lit(None).cast("timestamp"))


def ttl(df: DataFrame, now: Column, unit: str = "s", asked: DataFrame | None = None) -> DataFrame:
    """(key, ttl): time left, -1 without expiry; -2 for ``asked`` keys that are missing. HTTL and FIELDTTL by a key of both."""
    parts = F.unix_micros(F.col("expire_at")) - F.unix_micros(now)
    left = F.floor(parts / (1_000_000 if unit == "s" else 1000)).cast("long")
    found = df.select("key", F.coalesce(left, F.lit(-1).cast("long")).alias("ttl"))
    return found if asked is None else asked.select("key").join(found.distinct(), "key", "left").select("key", F.coalesce("ttl", F.lit(-2).cast("long")).alias("ttl"))


def scan(df: DataFrame, *, match: str = "*", after: str | None = None, count: int | None = None, key: str = "key") -> DataFrame:
    """A page of keys in order: those after ``after`` that match a glob."""
    out = df.filter(F.col(key).rlike(glob_pattern(match)))
    out = out.filter(F.col(key) > after) if after is not None else out
    return out.orderBy(key).limit(count) if count else out


def exists(df: DataFrame, asked: DataFrame) -> DataFrame:
    """How many of the asked keys exist; repeats count."""
    return asked.select("key").join(df.select("key").distinct(), "key", "left_semi").agg(F.count("key").alias("n"))


def delete(df: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """DEL, SREM, HDEL, ZREM, XDEL and acknowledgements: rows without those of ``keys``."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def rename(df: DataFrame, old: str, new: str, *, if_absent: bool = False) -> DataFrame:
    """Moves a key over another one; ``if_absent`` leaves all as it is where the other exists."""
    there = F.broadcast(df.filter(F.col("key").isin(old, new)).agg(F.max((F.col("key") == new).cast("int")).alias("has_new"), F.max((F.col("key") == old).cast("int")).alias("has_old")))  # one row
    go = (F.col("has_old") == 1) & ((F.col("has_new") == 0) if if_absent else F.lit(True)) & F.lit(old != new)
    moved = df.crossJoin(there).filter(~(F.coalesce(go, F.lit(False)) & (F.col("key") == new)))
    return moved.withColumn("key", F.when(F.coalesce(go, F.lit(False)) & (F.col("key") == old), F.lit(new)).otherwise(F.col("key"))).drop("has_new", "has_old")


def copy(df: DataFrame, old: str, new: str, *, replace: bool = False) -> DataFrame:
    """Puts a copy of ``old`` at ``new``; where ``old`` is missing, or ``new`` is there and not to be replaced, nothing changes."""
    there = F.broadcast(df.filter(F.col("key").isin(old, new)).agg(F.coalesce(F.max(F.col("key") == old), F.lit(False)).alias("__old"), F.coalesce(F.max(F.col("key") == new), F.lit(False)).alias("__new")))  # one row
    go = F.col("__old") & (F.lit(replace) | ~F.col("__new")) & F.lit(old != new)
    rows = df.crossJoin(there)
    kept = rows.filter(~(go & (F.col("key") == new)))
    return kept.unionByName(rows.filter(go & (F.col("key") == old)).withColumn("key", F.lit(new))).drop("__old", "__new")


def multi_get(df: DataFrame, asked: DataFrame, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """MGET, HMGET, ZMSCORE, SMISMEMBER, JSON.MGET: all of ``asked`` (with an ``ordinal``), in order, null for missing."""
    return asked.join(df, list(on), "left").orderBy("ordinal")


# --- strings


def _ordered(new: DataFrame) -> DataFrame:
    """``new`` with the ``ordinal`` of its rows: their own, or their order."""
    return new if "ordinal" in new.columns else new.withColumn("ordinal", F.monotonically_increasing_id())


def one_each(new: DataFrame, keys: list[str], *, first: bool = False) -> DataFrame:
    """The last row of each key by ``ordinal`` (the first, if so told), reduced in the tasks that read them."""
    rest = [c for c in new.columns if c not in (*keys, "ordinal")]
    pick = (F.min_by if first else F.max_by)(F.struct(F.lit(0).alias("__row"), *rest), "ordinal").alias("x")
    return _ordered(new).groupBy(*keys).agg(pick).select(*keys, *(F.col(f"x.{c}").alias(c) for c in rest))


def upsert(df: DataFrame, new: DataFrame, *, keys: tuple[str, ...] = ("key",), only: str = "") -> DataFrame:
    """SET, MSET, HSET, SADD, ZADD: later rows (by ``ordinal``, or in their order) replace earlier ones of the same keys;
    ``only``: NX new, of which the first stays, XX existing ones."""
    on = list(keys)
    new = one_each(new, on, first=only == "NX")
    if only == "NX":
        new = new.join(df.select(*on).distinct(), on, "left_anti")
    elif only == "XX":
        new = new.join(df.select(*on).distinct(), on, "left_semi")
    return df.join(new.select(*on), on, "left_anti").unionByName(new, allowMissingColumns=True)


def set_if_none(df: DataFrame, new: DataFrame) -> DataFrame:
    """MSETNX: all of ``new``, or nothing where one of its keys is there."""
    taken = F.broadcast(new.join(df.select("key").distinct(), "key", "left_semi").agg(F.count("key").alias("__taken")))  # one row
    rows = one_each(new, ["key"]).crossJoin(taken).filter("__taken = 0").drop("__taken")
    return df.unionByName(rows, allowMissingColumns=True)


def take(df: DataFrame, keys: DataFrame, on: tuple[str, ...] = ("key",)) -> tuple[DataFrame, DataFrame]:
    """GETDEL, HGETDEL: (rows of ``keys``, the rest)."""
    asked = keys.select(*on).distinct()
    return df.join(asked, list(on), "left_semi"), df.join(asked, list(on), "left_anti")


def get_and_expire(df: DataFrame, keys: DataFrame, at: Column | None) -> tuple[DataFrame, DataFrame]:
    """GETEX, GAT: (values of ``keys``, the table with their new expiry, none for null)."""
    return df.join(keys.select("key").distinct(), "key", "left_semi"), expire(df, keys, F.lit(None).cast("timestamp") if at is None else at)


def touch(df: DataFrame, asked: DataFrame) -> DataFrame:
    """TOUCH: how many of the asked keys there are."""
    return exists(df, asked)


def key_type(tables: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """TYPE: (key, type) by the table that has the key, ``none`` for others. ``tables``: type name to table."""
    found = functools.reduce(DataFrame.unionByName, (t.select("key", F.lit(name).alias("type")).distinct() for name, t in tables.items()))
    return asked.select("key").join(found, "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def expire_time(df: DataFrame, asked: DataFrame, unit: str = "s") -> DataFrame:
    """EXPIRETIME, PEXPIRETIME: (key, at) since the epoch; -1 without expiry, -2 for missing keys."""
    at = F.floor(F.unix_micros("expire_at") / (1_000_000 if unit == "s" else 1000)).cast("long")
    found = df.select("key", F.coalesce(at, F.lit(-1).cast("long")).alias("at")).distinct()
    return asked.select("key").join(found, "key", "left").select("key", F.coalesce("at", F.lit(-2).cast("long")).alias("at"))


def digest(text: Column) -> Column:
    """DIGEST: the value's 64-bit hash in hexadecimal."""
    return F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0")


def store(df: DataFrame, target: str, rows: DataFrame) -> DataFrame:
    """SUNIONSTORE, ZINTERSTORE, ZRANGESTORE, GEORADIUS ... STORE, SORT ... STORE: ``rows`` become all that ``target`` holds."""
    made = rows.withColumn("key", F.lit(target))
    return df.filter(F.col("key") != target).unionByName(made.select(*[c for c in df.columns if c in made.columns]), allowMissingColumns=True)


def append(df: DataFrame, more: DataFrame, *, before: bool = False) -> DataFrame:
    """(key, value): suffixes, or prefixes, are put to values; missing keys begin with them."""
    both = df.select("key", "value").join(more.select("key", F.col("value").alias("more")), "key", "full_outer")
    parts = [F.coalesce("value", F.lit("")), F.coalesce("more", F.lit(""))]
    return both.select("key", F.concat(*(parts[::-1] if before else parts)).alias("value"))


def increment(df: DataFrame, deltas: DataFrame, *, on: tuple[str, ...] = ("key",), real: bool = False) -> DataFrame:
    """INCRBY, HINCRBY, ZINCRBY and so on: sums of deltas, put to values; null where a value is no number or overflows."""
    kind = "double" if real else "long"
    sums = deltas.groupBy(*on).agg(F.sum(F.col("delta").cast(kind)).alias("delta"))
    both = df.select(*on, "value", F.lit(True).alias("__old")).join(sums, list(on), "full_outer")
    old = F.when(F.col("__old").isNull(), F.lit(0).cast(kind)).otherwise(F.col("value").try_cast(kind))
    return both.select(*on, F.try_add(old, F.coalesce("delta", F.lit(0).cast(kind))).alias("value"))


def get_range(text: Column, start: int, end: int) -> Column:
    """Bytes from ``start`` to ``end``, both included, negative from the end."""
    n = F.octet_length(text)
    a = F.greatest(F.lit(start) + (n if start < 0 else F.lit(0)), F.lit(0))
    b = F.least(F.lit(end) + (n if end < 0 else F.lit(0)), n - 1)
    return F.when(b >= a, F.substring(text.cast("binary"), a + 1, b - a + 1).cast("string")).otherwise("")


def set_range(text: Column, offset: int, part: str) -> Column:
    """Overwrites bytes from ``offset`` on, after zeros where the value is shorter. Bytes that are no whole character any more
    become the replacement character, as text has no others."""
    raw, own = F.coalesce(text.cast("binary"), F.lit(b"")), part.encode()
    if not own:
        return F.coalesce(text, F.lit(""))
    head = F.concat(F.substring(raw, 1, offset), F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(offset) - F.octet_length(raw), F.lit(0)))))
    return F.make_valid_utf8(F.concat(head, F.lit(own), F.substring(raw, offset + len(own) + 1, 1 << 30)).cast("string"))


def previous(df: DataFrame) -> DataFrame:
    """GETSET over a history (key, ver, value): each write with the value before it."""
    return df.withColumn("previous", F.lag("value").over(Window.partitionBy("key").orderBy("ver")))


# --- lists


def indexed(df: DataFrame) -> DataFrame:
    """Adds ``i`` (from 0) and ``n`` (length) to (key, pos, elem)."""
    return df.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1).withColumn("n", F.count("pos").over(Window.partitionBy("key")))


def _at(i: int) -> Column:
    return F.lit(i) if i >= 0 else F.col("n") + i


def list_range(df: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE and LTRIM: elements from ``start`` to ``stop``, both included, negative from the end."""
    return indexed(df).filter((F.col("i") >= _at(start)) & (F.col("i") <= _at(stop))).drop("i", "n")


def list_index(df: DataFrame, i: int) -> DataFrame:
    return indexed(df).filter(F.col("i") == _at(i)).select("key", "elem")


def list_set(df: DataFrame, i: int, elem: str) -> DataFrame:
    return indexed(df).withColumn("elem", F.when(F.col("i") == _at(i), F.lit(elem)).otherwise(F.col("elem"))).drop("i", "n")


def list_push(df: DataFrame, new: DataFrame, *, left: bool = False, if_exists: bool = False) -> DataFrame:
    """``new``: (key, ordinal, elem), pushed one after the other to the tail, or to the head."""
    ends = df.groupBy("key").agg((F.min if left else F.max)("pos").alias("end"))
    rows = new.join(ends, "key", "inner" if if_exists else "left")
    step = F.col("ordinal") + 1
    pos = F.coalesce("end", F.lit(0)) + (-step if left else step)
    return df.select("key", "pos", "elem").unionByName(rows.select("key", pos.cast("long").alias("pos"), "elem"))


def list_pop(df: DataFrame, count: int = 1, *, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """(taken, left over)."""
    order = Window.partitionBy("key").orderBy(F.desc("pos") if right else F.asc("pos"))
    ranked = df.withColumn("__r", F.row_number().over(order))
    return ranked.filter(F.col("__r") <= count).drop("__r"), ranked.filter(F.col("__r") > count).drop("__r")


def list_positions(df: DataFrame, elem: str, *, rank: int = 1, count: int | None = 1) -> DataFrame:
    """LPOS: indices of an element, from the ``rank``-th on, from the tail if that is negative."""
    order = Window.partitionBy("key").orderBy(F.desc("i") if rank < 0 else F.asc("i"))
    hits = indexed(df).filter(F.col("elem") == elem).withColumn("__r", F.row_number().over(order)).filter(F.col("__r") >= abs(rank))
    return (hits.filter(F.col("__r") < abs(rank) + count) if count else hits).select("key", F.col("i").alias("index"))


def list_remove(df: DataFrame, elem: str, count: int = 0) -> DataFrame:
    """LREM: the first ``count`` of an element, the last if negative, all if 0."""
    if count == 0:
        return df.filter(F.col("elem") != elem)
    order = Window.partitionBy("key", "elem").orderBy(F.desc("pos") if count < 0 else F.asc("pos"))
    return df.withColumn("__r", F.row_number().over(order)).filter((F.col("elem") != elem) | (F.col("__r") > abs(count))).drop("__r")


def list_insert(df: DataFrame, pivot: str, elem: str, *, before: bool = True) -> DataFrame:
    first = df.filter(F.col("elem") == pivot).groupBy("key").agg(F.min("pos").alias("p"))
    made = first.select("key", (F.col("p") + (-0.5 if before else 0.5)).alias("pos"), F.lit(elem).alias("elem"))
    both = df.select("key", F.col("pos").cast("double").alias("pos"), "elem").unionByName(made)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("pos")).cast("long") - 1)


def list_move(df: DataFrame, source: str, target: str, *, from_right: bool = True, to_left: bool = True) -> DataFrame:
    """RPOPLPUSH and LMOVE."""
    taken, left = list_pop(df.filter(F.col("key") == source), 1, right=from_right)
    rest = df.filter(F.col("key") != source).unionByName(left)
    return list_push(rest, taken.select(F.lit(target).alias("key"), F.lit(0).alias("ordinal"), "elem"), left=to_left)


def first_nonempty(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first of ``keys`` that has any: what LMPOP, ZMPOP and blocking pops take from."""
    order = functools.reduce(lambda c, k: c.when(F.col("key") == k[1], k[0]), enumerate(keys[1:], 1), F.when(F.col("key") == keys[0], 0))
    some = df.filter(F.col("key").isin(keys)).withColumn("__o", order)
    return some.join(F.broadcast(some.agg(F.min("__o").alias("__o"))), "__o").drop("__o")  # one row


# --- sets


def union(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.filter(F.col("key").isin(keys)).select("member").distinct()


def inter(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Members of all sets, by one aggregation whatever their number."""
    out = df.filter(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("n")).filter(F.col("n") == len(set(keys))).select("member")
    return out.limit(limit) if limit else out


def diff(df: DataFrame, keys: list[str]) -> DataFrame:
    first = df.filter(F.col("key") == keys[0]).select("member").distinct()
    return first.join(df.filter(F.col("key").isin(keys[1:])).select("member"), "member", "left_anti")


def move(df: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """SMOVE: a member leaves one set for another; nothing changes where it isn't there."""
    hit = df.filter((F.col("key") == source) & (F.col("member") == member)).withColumn("key", F.lit(target))
    rest = df.filter(~((F.col("key") == source) & (F.col("member") == member)))
    return rest.unionByName(hit.join(rest, ["key", "member"], "left_anti")) if source != target else df


def expire_rows(df: DataFrame, rows: DataFrame, at: Column, on: tuple[str, ...], only: str = "") -> DataFrame:
    """HEXPIRE, FIELDEXPIRE, SADDEX, HSETEX: expiry of fields or members, on the conditions of ``expire``."""
    whole = df.withColumn("__key", F.col("key")).withColumn("key", F.struct(*on))
    return expire(whole, rows.select(F.struct(*on).alias("key")), at, only).withColumn("key", F.col("__key")).drop("__key")


def card(df: DataFrame) -> DataFrame:
    """LLEN, SCARD, HLEN, ZCARD, XLEN: rows by key."""
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def sample(df: DataFrame, count: int, seed: int, *, on: str = "member") -> DataFrame:
    """SRANDMEMBER, SPOP, HRANDFIELD, ZRANDMEMBER, RANDOMKEY: as many distinct rows by key, in a seeded order; below 0,
    rows are drawn with repetition."""
    order = Window.partitionBy("key").orderBy(F.xxhash64(on, F.lit(seed)), on)
    ranked = df.withColumn("__r", F.row_number().over(order))
    if count >= 0:
        return ranked.filter(F.col("__r") <= count).drop("__r")
    sizes = df.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    draws = sizes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.lit(-count)), lambda i: (F.pmod(F.xxhash64("key", i, F.lit(seed)), F.col("__n")) + 1).cast("int"))).alias("__r"))
    return draws.join(ranked, ["key", "__r"]).drop("__r")


# --- sorted sets


def ranked(df: DataFrame, *, reverse: bool = False) -> DataFrame:
    """Adds ``rank`` from 0 and ``n``; order is by score, then member."""
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).cast("long")).withColumn("n", F.count("member").over(Window.partitionBy("key")))


def range_by_rank(df: DataFrame, start: int, stop: int, *, reverse: bool = False) -> DataFrame:
    return ranked(df, reverse=reverse).filter((F.col("rank") >= _at(start)) & (F.col("rank") <= _at(stop))).drop("n")


def _page(df: DataFrame, order: list[Column], offset: int, count: int | None) -> DataFrame:
    if not offset and count is None:
        return df
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    return r.filter((F.col("__r") > offset) & ((F.col("__r") <= offset + count) if count is not None else F.lit(True))).drop("__r")


def range_by_score(df: DataFrame, low: float, high: float, *, low_open: bool = False, high_open: bool = False, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    s = F.col("score")
    out = df.filter(((s > low) if low_open else (s >= low)) & ((s < high) if high_open else (s <= high)))
    return _page(out, [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")], offset, count)


def range_by_lex(df: DataFrame, low: str | None, high: str | None, *, low_open: bool = False, high_open: bool = False, reverse: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """Members between bounds, which are null for none."""
    m, cond = F.col("member"), F.lit(True)
    if low is not None:
        cond = cond & ((m > low) if low_open else (m >= low))
    if high is not None:
        cond = cond & ((m < high) if high_open else (m <= high))
    return _page(df.filter(cond), [F.desc("member") if reverse else F.asc("member")], offset, count)


def pop(df: DataFrame, count: int = 1, *, most: bool = False) -> tuple[DataFrame, DataFrame]:
    """(taken, left over): the lowest, or the highest."""
    r = ranked(df, reverse=most)
    return r.filter(F.col("rank") < count).drop("rank", "n"), r.filter(F.col("rank") >= count).drop("rank", "n")


def combine(df: DataFrame, keys: list[str], *, how: str = "union", weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """ZUNION, ZINTER and ZDIFF as (member, score): one partial and one final aggregation."""
    if how == "diff":
        first = df.filter(F.col("key") == keys[0]).select("member", "score")
        return first.join(df.filter(F.col("key").isin(keys[1:])).select("member"), "member", "left_anti")
    weight = functools.reduce(lambda c, kw: c.when(F.col("key") == kw[0], F.lit(float(kw[1]))), list(zip(keys, weights or [1.0] * len(keys), strict=True))[1:], F.when(F.col("key") == keys[0], F.lit(float((weights or [1.0])[0]))))
    x = F.col("score") * weight
    x = F.when(F.isnan(x), 0.0).otherwise(x)
    total = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}[aggregate.upper()](x)
    out = df.filter(F.col("key").isin(keys)).groupBy("member").agg(F.when(F.isnan(total), 0.0).otherwise(total).alias("score"), F.count_distinct("key").alias("__n"))
    return (out.filter(F.col("__n") == len(set(keys))) if how == "inter" else out).drop("__n")


def zadd(df: DataFrame, new: DataFrame, *, only: str = "", incr: bool = False) -> DataFrame:
    """``only``: NX (the first of new ones), XX, GT (raise only) or LT (lower only); ``incr`` adds scores up. Of repeated new
    members the last counts, the greatest with GT and the least with LT."""
    only = only.upper()
    rows = _ordered(new).groupBy("key", "member")
    score = F.sum("score") if incr else {"NX": F.min_by("score", "ordinal"), "GT": F.max("score"), "LT": F.min("score")}.get(only, F.max_by("score", "ordinal"))
    both = df.select("key", "member", "score").join(rows.agg(score.alias("new")), ["key", "member"], "full_outer")
    old, want = F.col("score"), F.col("new")
    want = F.coalesce(old, F.lit(0.0)) + want if incr else want
    keep = {"": want, "NX": F.coalesce(old, want), "XX": F.when(old.isNotNull(), F.coalesce(want, old)), "GT": F.greatest(old, want), "LT": F.least(old, want)}[only]
    return both.select("key", "member", F.coalesce(keep, old).alias("score")).filter("score is not null")


def remove_by(df: DataFrame, range_: DataFrame) -> DataFrame:
    """ZREMRANGEBYRANK, ZREMRANGEBYSCORE, ZREMRANGEBYLEX: all but what one of the ranges gives."""
    return df.join(range_.select("key", "member"), ["key", "member"], "left_anti")


# --- sorting with lookups


def sort(df: DataFrame, *, by: DataFrame | None = None, get: DataFrame | None = None, alpha: bool = False, descending: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """SORT: elements by number (or bytes), or by what ``by`` (elem, weight) has for them; ``get`` (elem, value) adds values.
    Elements without a weight sort as 0, or as the empty string."""
    out = df.join(by, "elem", "left") if by is not None else df.withColumn("weight", F.col("elem"))
    order = F.coalesce(F.col("weight").cast("string"), F.lit("")) if alpha else F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))
    out = out.join(get, "elem", "left") if get is not None else out
    out = out.withColumn("__w", order).orderBy(F.desc("__w") if descending else F.asc("__w"), "elem")
    out = out.offset(offset) if offset else out
    return (out.limit(limit) if limit is not None else out).drop("__w", "weight")
