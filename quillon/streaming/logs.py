"""Structured Streaming: tailing logs, pattern channels, retention, exactly-once tables and stateful rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import glob_pattern


def tail(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Entries of a log as its files arrive (XREAD that waits)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def subscribe(df: DataFrame, pattern: str, channel: str = "channel") -> DataFrame:
    """Messages of the channels that a glob names."""
    return df.filter(F.col(channel).rlike(glob_pattern(pattern)))


def window_counts(df: DataFrame, *, at: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts by key and time window; windows close when data is ``late`` no more, and their state goes."""
    return df.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def consume(df: DataFrame, group: str, checkpoint: str, sink: str):
    """A consumer group: a named query whose checkpoint is its position. Batches are written under their number, so that
    one that is delivered again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return df.writeStream.queryName(group).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def throttle(df: DataFrame, *, burst: int, count: int, period: float) -> DataFrame:
    """The rate limiter over a stream (key, at, quantity): state is one number a key."""
    interval = period / count
    limit = interval * (burst + 1)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tat = state.get[0] if state.exists else float("-inf")
        for pdf in batches:
            pdf = pdf.sort_values("at")
            out = []
            for at, quantity in zip(pdf["at"], pdf["quantity"], strict=True):
                new = max(tat, at) + interval * quantity
                limited = at < new - limit
                tat = tat if limited else new
                out.append(limited)
            yield pd.DataFrame({"key": key[0], "at": pdf["at"], "limited": out})
        state.update((tat,))

    return df.groupBy("key").applyInPandasWithState(fold, "key string, at double, limited boolean", "tat double", "append", GroupStateTimeout.NoTimeout)
