"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

All in DataFrame expressions. A window holds five consecutive shingles of five words, and the next begins five words on,
so that each shingle is in one window and windows overlap by four words. Templates are cut into windows at every word. A
template of 13 words or more holds, wherever it stands, a whole window of the text that equals one of its own. One of five
shingles or more that a text has four fifths of shares four shingles with the text's windows at least; at worst each is in
a window of its own and one in nine of both windows' shingles, so that 32 bands of one row miss all four with a chance of
about (8 / 9) ** 128 = 3e-7. Templates of fewer shingles are retrieved by their shingles themselves, and never missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import let, shingle_hashes

SHINGLE, SPAN, BANDS, PERCENT = 5, 5, 32, 80
_MASK = (1 << 64) - 1

#: Notices by which texts state their license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}


def seeds(bands: int = BANDS) -> list[int]:
    """The permutations: each hashes a shingle's hash anew, with a fixed random number."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(bands):
        x = (x * 6364136223846793005 + 1442695040888963407) & _MASK
        out.append((x ^ x >> 29) - (1 << 64) if (x ^ x >> 29) >> 63 else x ^ x >> 29)
    return out


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def window_bands(h: Column, step: int, bands: int = BANDS) -> Column:
    """The bands of all windows over shingle hashes, one after the other: the least hash under each permutation. The last
    window may be short. Under a xor in place of a hash, a few top bits would say which shingle is least."""
    # ``h`` must be a lambda's variable, so that no expression is evaluated for each window
    windows = F.floor((F.size(h) - 1) / step).cast("int") if step > 1 else F.greatest(F.size(h) - SPAN, F.lit(0))

    def of(i: Column) -> Column:
        return let(F.slice(h, i * step + 1, SPAN), lambda w: F.array(*(least(w, s) for s in seeds(bands))))

    def least(w: Column, seed: int) -> Column:
        return F.array_min(F.transform(w, lambda p: F.xxhash64(p, F.lit(seed))))

    return F.when(F.size(h) > 0, F.flatten(F.transform(F.sequence(F.lit(0), windows), of))).otherwise(F.array().cast("array<long>"))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, bands) of templates; those under five words are one shingle and found in equal texts only. A
    template of fewer than ``SPAN`` shingles has these for bands."""
    table = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    table = table.select("license", shingle_hashes(words(F.col("body")), SHINGLE).alias("h"))
    table = table.select("license", F.array_distinct("h").alias("shingles"), F.array_distinct(let(F.col("h"), lambda h: window_bands(h, 1))).alias("bands")).filter(F.size("shingles") > 0)
    return table.withColumn("bands", F.when(F.size("shingles") < SPAN, F.col("shingles")).otherwise(F.col("bands")))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, *, percent: int = PERCENT) -> DataFrame:
    """Templates that documents contain: doc_id, license, shared (template shingles that the text has), containment.

    A template matches where ``percent`` of its shingles of five words at least are in the text. Whole texts are scanned;
    null, empty and shorter texts hold none. Rows that repeat id and text give one result. Other columns are ignored. ``templates``
    is a parameter of some hundred entries at most and goes to all tasks.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates).collect()  # as many rows as templates
    by_band = spark.createDataFrame([(b, r.license, r.shingles) for r in table for b in r.bands], "band long, license string, shingles array<long>")
    bands, shingles = (constants(x for r in table for x in r[k]) for k in ("bands", "shingles"))

    def kept(h: Column) -> Column:
        own = F.array_intersect(h, shingles)
        return let(own, lambda own: F.struct(F.array_union(F.array_intersect(window_bands(h, SPAN), bands), F.array_intersect(own, bands)).alias("bands"), own.alias("own")))

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(shingle_hashes(words(F.col("text")), SHINGLE), kept).alias("found"))
    # only documents that share a band or a short template's shingle go on, with their template shingles alone
    found = found.select("doc_id", F.explode("found.bands").alias("band"), F.col("found.own").alias("own"))
    pairs = found.join(F.broadcast(by_band), "band").dropDuplicates(["doc_id", "license", "own"])
    pairs = pairs.select("doc_id", "license", F.size(F.array_intersect("shingles", "own")).cast("long").alias("shared"), F.size("shingles").alias("n"))
    return pairs.filter(F.col("shared") * 100 >= F.col("n") * percent).select("doc_id", "license", "shared", (F.col("shared") / F.col("n")).alias("containment"))


def constants(values) -> Column:
    """An array of distinct numbers that the optimiser folds to one literal."""
    text = ",".join(str(v) for v in sorted(set(values)))
    return F.split(F.lit(text), ",").cast("array<long>") if text else F.array().cast("array<long>")
