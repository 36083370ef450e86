"""The pipeline over ``documents``: language ID, near and exact dedup, mixing of sources, and encoding, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import langid, sentencepiece_scan
from quillon.llm.minhash import minhash_dedup
from quillon.llm.mixing import mix
from quillon.llm.suffix_array import suffix_dedup
from quillon.llm.tables import Scratch, inputs, numbered

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: For its declared language to be contradicted, how like another one a text must be, and how much more so (cosines).
LIKE, MORE = 0.5, 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts of no language (null, blank or letterless ones) and those whose language is not the one that they
    declare: another language's profile is as close as ``LIKE`` at least, which short scraps of text don't reach, and closer
    by ``MORE``, which languages that are much alike don't reach. Texts that declare none are judged by their letters alone, as are all where the corpus names no language."""
    docs = docs.select(COLUMNS)
    model = langid.learn(docs)
    if not model[0]:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = langid.predict_language(docs, model, extra=("text", "lang", "source", "n_chars"), declared="lang")
    contradicted = (F.col("score") >= LIKE) & (F.col("score") - F.col("declared_score") >= MORE)
    return found.filter((F.col("lang_pred") != "und") & ~F.coalesce(contradicted, F.lit(False))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates (five words, a similarity of 0.8) the row of the smallest id; of rows with
    equal ids, one. Rows are told apart by a number of their own, so that an id may stand for several texts."""
    rows = numbered(docs.select(COLUMNS), Scratch(spark, "near-rows"))
    kept = minhash_dedup(rows.select(F.col("row").alias("doc_id"), "text")).filter("kept").select(F.col("doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that an earlier row has, by id; rows of which nothing is left go."""
    rows = numbered(docs.select(COLUMNS), Scratch(spark, "string-rows"))
    kept = suffix_dedup(rows.select(F.col("row").alias("doc_id"), "text")).filter("n_removed < n_bytes").select(F.col("doc_id").alias("row"), F.col("kept").alias("text"))
    return rows.drop("text", "n_chars").join(kept, "row").withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix says: a row for each time that a document is taken. Where one is taken in
    part, in which a source's quota ends, its first words, joined by a space, are the last of its rows."""
    taken, _, _ = mix(docs.select(COLUMNS), F.array("source"), extra=("text", "lang", "source", "n_chars"))
    part = F.array_join(F.slice(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, F.col("part")), " ")
    times = taken.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    times = times.withColumn("part", F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int"))
    return times.withColumn("text", F.when(F.col("part") < F.col("size"), part).otherwise(F.col("text"))).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, or of each chunk of a giant one."""
    rows = sentencepiece_scan.encode(docs)
    return rows.select("doc_id", "key", "chunk", F.length("text").cast("long").alias("n_chars"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated strings", drop_repeated_strings),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]
#: No stage is plain SQL: see the brute-force versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs(spark, sf_dir).select(COLUMNS)
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, str(k))
    return docs
