"""Sketches: HyperLogLog, count-min, top-k, Bloom and cuckoo filters, bitmaps. Mergeable state is one small value a key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- distinct counts


def hll(df: DataFrame, keys: list[str], item: str, precision: int = 14) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, precision).alias("sketch"))


def hll_merge(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def hll_count(df: DataFrame) -> DataFrame:
    return df.withColumn("estimate", F.hll_sketch_estimate("sketch"))


# --- frequencies


def cms_dims(error: float, probability: float) -> tuple[int, int]:
    """Width and depth for a relative error and the chance to exceed it."""
    return math.ceil(math.e / error), math.ceil(math.log(1 / probability))


def _cell(item: Column, row: int | Column, width: int) -> Column:
    return F.pmod(F.xxhash64(item, F.lit(row) if isinstance(row, int) else row), F.lit(width)).cast("int")


def cms(df: DataFrame, item: str, weight: str | None = None, *, width: int = 2000, depth: int = 7) -> DataFrame:
    """Counters as rows (row, cell, n), at most width x depth of them, summed in the tasks first."""
    w = F.col(weight) if weight else F.lit(1)
    cells = df.select(w.cast("long").alias("w"), F.posexplode(F.array(*(_cell(F.col(item), r, width) for r in range(depth)))).alias("row", "cell"))
    return cells.groupBy("row", "cell").agg(F.sum("w").alias("n"))


def cms_merge(*sketches: DataFrame, weights: list[int] | None = None) -> DataFrame:
    out = None
    for k, s in enumerate(sketches):
        s = s.select("row", "cell", (F.col("n") * (weights[k] if weights else 1)).alias("n"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("row", "cell").agg(F.sum("n").alias("n"))


def cms_query(sketch: DataFrame, items: DataFrame, item: str, *, width: int = 2000, depth: int = 7) -> DataFrame:
    """(item, estimate): the least counter of an item's cells, never below the true count."""
    asked = items.select(item, F.posexplode(F.array(*(_cell(F.col(item), r, width) for r in range(depth)))).alias("row", "cell"))
    return asked.join(sketch, ["row", "cell"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def top_k(df: DataFrame, item: str, k: int, weight: str | None = None) -> DataFrame:
    """Exact heavy hitters: (item, n), by count, then item."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(item).agg(n.cast("long").alias("n")).orderBy(F.desc("n"), F.asc(item)).limit(k)


def approximate_top_k(df: DataFrame, item: str, k: int, tracked: int = 10_000) -> DataFrame:
    """Heavy hitters from a bounded summary, for when there are too many items to count."""
    return df.agg(F.expr(f"approx_top_k({item}, {k}, {tracked})").alias("top")).select(F.explode("top").alias("x")).select("x.item", F.col("x.count").alias("n"))


# --- membership


def bloom_dims(capacity: int, error: float) -> tuple[int, int]:
    """Bits and hashes."""
    bits = math.ceil(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def _bits(item: Column, bits: int, hashes: int) -> Column:
    a, b = F.xxhash64(item), F.xxhash64(item, F.lit(1))
    return F.array(*(F.pmod(F.xxhash64(a, b, F.lit(k)), F.lit(bits)) for k in range(hashes)))


def _mask() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))


def bloom(df: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """A filter as rows (word, mask): 64 bits each, which merge by OR."""
    bits, hashes = bloom_dims(capacity, error)
    places = df.select(F.explode(_bits(F.col(item), bits, hashes)).alias("bit"))
    return places.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(_mask()).alias("mask"))


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def bloom_query(sketch: DataFrame, items: DataFrame, item: str, capacity: int, error: float = 0.01) -> DataFrame:
    """(item, maybe): whether an item may have been added; false is certain."""
    bits, hashes = bloom_dims(capacity, error)
    asked = items.select(item).distinct().select(item, F.explode(_bits(F.col(item), bits, hashes)).alias("bit")).withColumn("word", F.floor(F.col("bit") / 64).cast("long"))
    hit = F.coalesce(F.col("mask").bitwiseAND(_mask()) != 0, F.lit(False))
    return asked.join(sketch, "word", "left").groupBy(item).agg(F.min(hit).alias("maybe"))


def cuckoo(df: DataFrame, item: str) -> DataFrame:
    """A multiset of fingerprints (bucket, tag, n) that items can leave again."""
    return df.groupBy(*_print(F.col(item))).agg(F.count(F.lit(1)).alias("n"))


def _print(item: Column) -> list[Column]:
    h = F.xxhash64(item)
    return [F.shiftrightunsigned(h, 20).alias("bucket"), h.bitwiseAND(0xFFFF).alias("tag")]


def cuckoo_delete(sketch: DataFrame, items: DataFrame, item: str) -> DataFrame:
    gone = cuckoo(items, item).withColumnRenamed("n", "gone")
    left = F.col("n") - F.coalesce("gone", F.lit(0))
    return sketch.join(gone, ["bucket", "tag"], "left").withColumn("n", left).drop("gone").filter("n > 0")


def cuckoo_count(sketch: DataFrame, items: DataFrame, item: str) -> DataFrame:
    return items.select(item).distinct().select(item, *_print(F.col(item))).join(sketch, ["bucket", "tag"], "left").select(item, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# --- bitmaps: rows (key, bit) that are set


def bit_count(df: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    some = df.filter((F.col("bit") >= low) & ((F.col("bit") <= high) if high is not None else F.lit(True)))
    return some.groupBy("key").agg(F.count_distinct("bit").alias("n"))


def bit_position(df: DataFrame, bit: int = 1) -> DataFrame:
    """The first set bit, or the first that is clear."""
    if bit:
        return df.groupBy("key").agg(F.min("bit").alias("pos"))
    r = df.distinct().withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("bit")) - 1)
    return r.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("bit") != F.col("r"), F.col("r"))), F.max("bit") + 1).alias("pos"))


def bit_operation(df: DataFrame, keys: list[str], op: str) -> DataFrame:
    """AND, OR, XOR of bitmaps, or those of the first that the others lack (DIFF), as (bit)."""
    n = df.filter(F.col("key").isin(keys)).distinct().groupBy("bit").agg(F.count("key").alias("n"), F.max((F.col("key") == keys[0]).cast("int")).alias("first"))
    cond = {"AND": f"n = {len(keys)}", "OR": "n > 0", "XOR": "n % 2 = 1", "DIFF": "first = 1 and n = 1", "ONE": "n = 1"}[op.upper()]
    return n.filter(cond).select("bit")


def bit_not(df: DataFrame, key) -> DataFrame:
    """BITOP NOT: (bit) of those that a bitmap lacks, up to the end of its last byte."""
    own = df.filter(F.col("key") == key).select("bit").distinct()
    end = own.agg(((F.floor(F.max("bit") / 8) + 1) * 8).alias("end")).filter("end is not null")
    return end.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - 1)).alias("bit")).join(own, "bit", "left_anti")


def bit_field(value: Column, offset: int, bits: int, signed: bool = False) -> Column:
    """A field of a 64-bit word; offset 0 is the highest bit."""
    raw = F.shiftrightunsigned(F.shiftleft(value, offset), 64 - bits)
    return F.shiftright(F.shiftleft(value, offset), 64 - bits) if signed else raw


def bit_add(value: Column, delta: Column, bits: int, overflow: str = "WRAP") -> Column:
    """A signed field plus a delta: wrapped, saturated, or null on overflow."""
    top, total = 1 << (bits - 1), value + delta
    if overflow == "SAT":
        return F.greatest(F.least(total, F.lit(top - 1)), F.lit(-top))
    if overflow == "FAIL":
        return F.when(total.between(-top, top - 1), total)
    return F.pmod(total + top, F.lit(2 * top)) - top
