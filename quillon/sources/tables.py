"""Sources and sinks: Parquet, ORC, CSV and JSON tables, whole snapshots, synthetic keys and command text."""

from __future__ import annotations

import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FORMATS = ("parquet", "orc", "csv", "json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """From any file system that Spark reaches. Text formats need a schema, so that no pass is spent on guessing one."""
    if fmt not in FORMATS or (fmt in ("csv", "json") and not schema):
        raise ValueError(f"{fmt} needs a schema, or isn't one of {FORMATS}")
    reader = spark.read.format(fmt).option("header", "true")
    return (reader.schema(schema) if schema else reader).load(path)


def snapshot(kinds: dict[str, DataFrame], path: str, codec: str = "zstd") -> None:
    """A table for each kind of value under one path."""
    for kind, df in kinds.items():
        df.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{kind}")


def restore(spark: SparkSession, path: str, kinds: list[str]) -> dict[str, DataFrame]:
    return {kind: spark.read.parquet(f"{path}/{kind}") for kind in kinds}


def populate(spark: SparkSession, count: int, prefix: str = "key", size: int = 16) -> DataFrame:
    """Synthetic strings (key, value)."""
    return spark.range(count).select(F.concat(F.lit(f"{prefix}:"), F.col("id")).alias("key"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, size).alias("value"))


def dump(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, blob): each row serialized."""
    return df.select(key, F.to_json(F.struct("*")).alias("blob"))


def load(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("blob", schema).alias("x")).select("x.*")


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A journal of what turns one table into another: (keys, op, value) with op SET or DEL."""
    both = old.select(*keys, F.col(value).alias("__old"), F.lit(True).alias("__was")).join(new.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__is")), keys, "full_outer")
    op = F.when(F.col("__is").isNull(), "DEL").when(F.col("__was").isNull() | ~F.col("__old").eqNullSafe(F.col("__new")), "SET")
    return both.select(*keys, op.alias("op"), F.col("__new").alias(value)).filter("op is not null")


def command(text: str) -> list[str]:
    """Words of a command line, quotes and escapes resolved."""
    return shlex.split(text)
