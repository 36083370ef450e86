"""The queries of the subpackage's operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, ogg, sentencepiece_scan
from .fingerprints import fingerprints
from .licenses import scan_licenses
from .minhash import minhash_dedup
from .mixing import mix
from .quality import quality_scores
from .rlz import substring_dedup
from .suffix_array import suffix_dedup
from .tables import inputs


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(inputs(spark, sf_dir), digest=True)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(inputs(spark, sf_dir), shingle=4)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.held_out("doc_id", 3, 1)
    scores = quality_scores(inputs(spark, sf_dir), inputs(spark, sf_dir, "labels").filter(~out))
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(inputs(spark, sf_dir), digest=True)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(inputs(spark, sf_dir))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.summary(sentencepiece_scan.encode(inputs(spark, sf_dir)))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = inputs(spark, sf_dir), langid.held_out("doc_id", 5, 0)
    found = langid.predict_language(docs, langid.learn(docs.filter(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.describe(ogg.store(inputs(spark, sf_dir)))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, quota, sizes = mix(inputs(spark, sf_dir), F.array("source"), extra=("source",))
    known = spark.createDataFrame([(s, int(sizes[s]), float(quota[s])) for s in sizes], "source string, source_size long, target double")
    known = F.broadcast(known)  # a row for each source, as the driver has them
    return taken.join(known, taken["source"].eqNullSafe(known["source"]), "left").select("doc_id", "size", "source_size", "target", "taken")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(inputs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_suffix_array_dedup, op2_minhash_near_dedup, op3_quality_classifier, op4_substring_dedup, op5_document_fingerprints, op6_sentencepiece, op7_language_id, op8_ogg_media, op9_source_mix, op10_license_scan)
    }


def oracle_sql() -> dict[str, str]:
    return {}
