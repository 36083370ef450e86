"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only.

A sketch is the sorted array of the k least distinct hashes. The sketch of a union is the k least of both sketches, so that
parts merge in any order; resemblance, containment and the number of distinct shingles follow from sketches alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SHINGLE = 128, 5
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a bucket of ids in which a document finds its successor.
BUCKET = 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """A hash of each run of ``size`` words, in order; of all words where there are fewer; none without words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
        return F.when(n >= size, each).when(n > 0, F.array(F.xxhash64(h, n))).otherwise(F.array().cast("array<long>"))

    return let(hashes, runs)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(word_list(text), size))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """How many distinct shingles the sketched set has: exact below k, else from the k-th least hash."""
    share = (F.element_at(s, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles in all of both; 1 for two empty sets, exact for sets of less than k."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(let(merged(a, b, k), lambda m: F.size(F.array_intersect(F.array_intersect(m, a), b)) / F.size(m)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has, too; 1 where a is empty."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge_by(sketches: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each key, from those of its parts; the hashes are dealt out and counted in order, so that no group
    has to fit into one row before it is cut to k."""
    hashes = sketches.select(*keys, F.explode(column).alias("hash")).distinct()
    least = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).filter(F.col("rank") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(column))


def successors(ids: DataFrame, column: str, fan: int = 4096) -> DataFrame:
    """(column, next) of distinct integers: the next greater one, and after the greatest the least. Only about one in
    ``fan`` squared is looked at in one place."""
    high = F.floor(F.col(column) / fan).cast("long")
    near = ids.withColumn("high", high).withColumn("next", F.lead(column).over(Window.partitionBy("high").orderBy(column)))
    tops = ids.groupBy(high.alias("high")).agg(F.min(column).alias("least"))
    top = F.floor(F.col("high") / fan).cast("long")
    tops = tops.withColumn("top", top).withColumn("up", F.lead("least").over(Window.partitionBy("top").orderBy("high")))
    peaks = tops.groupBy("top").agg(F.min(F.struct("high", "least")).alias("x")).select("top", F.col("x.least").alias("least"))
    all_ = Window.orderBy("top")
    peaks = peaks.select("top", F.coalesce(F.lead("least").over(all_), F.first("least").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("over"))
    tops = tops.join(peaks, "top").select("high", F.coalesce("up", "over").alias("up"))
    return near.join(tops, "high").select(column, F.coalesce("next", "up").alias("next"))


def fingerprints(docs: DataFrame, *, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of texts, of their edits and of how alike they are.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document (ascending doc_id; after the last comes the first). Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hashes in hexadecimal), near_edited, near_next, distinct_shingles. Null is the empty text; empty
    and blank texts have an empty fingerprint, and two of those are fully alike. Of rows that repeat a doc_id, ordered by
    text, each is followed by the next; rows without one come last. Other columns are ignored. An empty table gives none.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.coalesce("doc_id", F.lit((1 << 63) - 1))  # null ids come last
    base = base.withColumn("bucket", F.floor(place / BUCKET).cast("long"))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_last(), "text")
    rows = base.withColumn("sketch", sketch(F.col("text"), k, size)).withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)})
    # the first text of each bucket: one a task and bucket is all that is shuffled, and only it is sketched, for this
    first = base.groupBy(F.col("bucket").alias("next")).agg(F.min_by("text", F.struct(place.alias("place"), "text")).alias("first_text")).withColumn("first_sketch", sketch(F.col("first_text"), k, size))
    after = successors(base.select("bucket").distinct(), "bucket").join(first, "next").drop("next")
    rows = rows.join(after, "bucket", "left")
    next_text = F.coalesce("next_text", "first_text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.left(F.col("text"), F.length("text") - half), F.left(next_text, half)).alias("edited"),
        "sketch",
        F.coalesce("next_sketch", "first_sketch").alias("next_sketch"),
    ).withColumn("edited_sketch", sketch(F.col("edited"), k, size))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_shingles"),
    )
