"""Append logs (key, ms, seq, fields), consumer groups and their pending entries, in batch form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def entry_id(ms: str = "ms", seq: str = "seq") -> Column:
    return F.concat_ws("-", F.col(ms), F.col(seq))


def append_auto(df: DataFrame, *, key: str, at: str, tie: str) -> DataFrame:
    """XADD of a batch: ids ``ms-seq`` with the sequence counted within a key's millisecond."""
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    return df.withColumn("ms", ms).withColumn("seq", (F.row_number().over(Window.partitionBy(key, "ms").orderBy(at, tie)) - 1).cast("long"))


def log_range(df: DataFrame, low: tuple[int, int] | None = None, high: tuple[int, int] | None = None, *, count: int | None = None, reverse: bool = False, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """XRANGE and XREVRANGE: entries between ids, the first ``count`` of each key."""
    i = F.struct("ms", "seq")

    def lit(x: tuple[int, int]) -> Column:
        return F.struct(F.lit(x[0]).cast("long").alias("ms"), F.lit(x[1]).cast("long").alias("seq"))

    if low:
        df = df.filter((i > lit(low)) if low_open else (i >= lit(low)))
    if high:
        df = df.filter((i < lit(high)) if high_open else (i <= lit(high)))
    if count is None:
        return df
    order = [F.desc("ms"), F.desc("seq")] if reverse else [F.asc("ms"), F.asc("seq")]
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("__r") <= count).drop("__r")


def log_read(df: DataFrame, last: DataFrame, count: int | None = None) -> DataFrame:
    """XREAD: entries after each key's last id; ``last``: (key, last_ms, last_seq)."""
    new = df.join(last, "key").filter((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))).drop("last_ms", "last_seq")
    return log_range(new, count=count)


def trim(df: DataFrame, *, most: int | None = None, least_ms: int | None = None) -> DataFrame:
    """MAXLEN keeps the newest entries of a key, MINID those from a time on."""
    if least_ms is not None:
        return df.filter(F.col("ms") >= least_ms)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq")))).filter(F.col("__r") <= most).drop("__r")


def deliver(df: DataFrame, last: DataFrame, *, consumers: list[str], group: str, now: Column, count: int | None = None) -> DataFrame:
    """XREADGROUP of new entries: each goes to one consumer, in turn, and is pending until it is acknowledged."""
    new = log_read(df, last, count)
    turn = F.pmod(F.xxhash64("key", "ms", "seq"), F.lit(len(consumers))).cast("int")
    return new.select("key", F.lit(group).alias("grp"), F.get(F.array(*map(F.lit, consumers)), turn).alias("consumer"), "ms", "seq", now.alias("delivered_at"), F.lit(1).cast("long").alias("deliveries"))


def acknowledge(pending: DataFrame, acks: DataFrame) -> DataFrame:
    return pending.join(acks.select("key", "grp", "ms", "seq").distinct(), ["key", "grp", "ms", "seq"], "left_anti")


def claim(pending: DataFrame, consumer: str, now: Column, idle_ms: int, count: int | None = None) -> DataFrame:
    """XCLAIM and XAUTOCLAIM: entries that have been pending too long go to another consumer; the oldest ``count`` of a key."""
    idle = F.unix_millis(now) - F.unix_millis(F.col("delivered_at").cast("timestamp")) >= idle_ms
    marked = pending.withColumn("__idle", idle)
    if count is not None:
        r = F.row_number().over(Window.partitionBy("key", "grp", "__idle").orderBy("ms", "seq"))
        marked = marked.withColumn("__idle", F.col("__idle") & (r <= count))
    take = F.col("__idle")
    return marked.select(
        "key",
        "grp",
        F.when(take, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"),
        "ms",
        "seq",
        F.when(take, now).otherwise(F.col("delivered_at")).alias("delivered_at"),
        (F.col("deliveries") + take.cast("long")).alias("deliveries"),
    )


def pending_summary(pending: DataFrame) -> DataFrame:
    """XPENDING: entries by consumer with the least and the greatest id."""
    return pending.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ms", "seq")).alias("least"), F.max(F.struct("ms", "seq")).alias("most"))


def info(df: DataFrame) -> DataFrame:
    """XINFO STREAM: length, first and last id."""
    return df.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("ms", "seq")).alias("first"), F.max(F.struct("ms", "seq")).alias("last"))


def lag(df: DataFrame, last: DataFrame) -> DataFrame:
    """Entries that a group has not read yet."""
    return log_read(df, last).groupBy("key").agg(F.count(F.lit(1)).alias("lag"))


def throttle(df: DataFrame, *, burst: int, count: int, period: float) -> DataFrame:
    """The generic cell rate algorithm over (key, at: seconds, quantity): each row in its key's order is limited or not.

    Rows are sorted by key and time and pass by once; all that is held is the time up to which the present key is served.
    ``key`` may have any type."""
    interval = period / count
    limit = interval * (burst + 1)
    rows = df.select("key", F.col("at").cast("double").alias("at"), F.col("quantity").cast("double").alias("quantity"))

    def run(batches):
        key, tat = None, None
        for pdf in batches:
            limited, remaining = [], []
            for k, at, quantity in zip(pdf["key"], pdf["at"], pdf["quantity"], strict=True):
                if tat is None or k != key:
                    key, tat = k, -math.inf
                base = max(tat, at)
                new = base + interval * quantity
                over = at < new - limit
                limited.append(over)
                remaining.append(math.floor((limit - ((base if over else new) - at)) / interval))
                tat = tat if over else new
            yield pdf.assign(limited=limited, remaining=remaining)

    out = T.StructType([*rows.schema.fields, T.StructField("limited", T.BooleanType()), T.StructField("remaining", T.LongType())])
    return rows.repartition("key").sortWithinPartitions("key", "at", "quantity").mapInPandas(run, out)
