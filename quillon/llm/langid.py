"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters' vectors, each rotated by
its place; a document bundles (adds) its n-grams, a prototype bundles the documents of a language, and the language of a
document is that of the prototype with the greatest cosine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .hashing import mixed
from .tables import batch

DIM, GRAM = 512, 3
#: Documents of a language that its prototype bundles, about.
SAMPLE = 2000
#: Letters that are looked at in one go.
BLOCK = 1 << 18
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The random vector of each code point (0 stands for all that is no letter)."""
    at = np.arange(DIM // 64, dtype=np.uint64) + np.uint64(1)
    bits = mixed(codes.astype(np.uint64)[:, None] * np.uint64(1 << 20) + at)
    return np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of packed n-grams."""
    mask = np.int64((1 << 21) - 1)
    letters, inverse = np.unique(np.concatenate([(codes >> np.int64(21 * k)) & mask for k in range(GRAM)]), return_inverse=True)
    base = letter_vectors(letters)
    n = len(codes)
    out = np.ones((n, DIM), np.int8)
    for k in range(GRAM):
        out *= np.roll(base, k, axis=1)[inverse[k * n : (k + 1) * n]]
    return out


def packed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and packed n-gram over lower-case letters; each run of anything else counts as one 0, as do both ends."""
    joined = "\0".join(["", *(t.lower().replace("\0", " ") for t in texts), ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    ends = codes == 0
    row = np.cumsum(ends) - 1
    codes = np.where(letter_table()[codes], codes, 0)
    keep = (codes != 0) | ends
    keep[1:] |= codes[:-1] != 0
    # the marks at a row's end belong to both rows
    codes, row, ends = codes[keep], row[keep], ends[keep]
    packed = codes[:-2] | (codes[1:-1] << 21) | (codes[2:] << 42)
    mid = codes[1:-1] != 0  # an n-gram belongs to the row of its middle letter
    return row[1:-1][mid], packed[mid]


def profiles(texts: list[str]) -> np.ndarray:
    """The bundle of each text: one row of DIM numbers, all 0 without letters."""
    out = np.zeros((len(texts), DIM), np.float32)
    row, packed = packed_grams(texts)
    if not len(packed):
        return out
    grams_, inverse = np.unique(packed, return_inverse=True)
    step = max(1, (1 << 21) // max(1, len(texts)))
    key, count = np.unique(row * len(grams_) + inverse, return_counts=True)
    row, gram = key // len(grams_), key % len(grams_)
    for i in range(0, len(grams_), step):  # so many n-grams at a time that the counts stay small
        part = (gram >= i) & (gram < i + step)
        table = np.zeros((len(texts), min(step, len(grams_) - i)), np.float32)
        table[row[part], gram[part] - i] = count[part]
        out += table @ gram_vectors(grams_[i : i + step]).astype(np.float32)
    return out


def _groups(texts: list[str]):
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield i, j
            i, size = j, 0
        size += len(t)
    if texts:
        yield i, len(texts)


def bundled(texts: list[str]) -> np.ndarray:
    """The sum of the texts' normalised bundles."""
    total = np.zeros(DIM, np.float64)
    for i, j in _groups(texts):
        p = profiles(texts[i:j])
        norm = np.linalg.norm(p, axis=1, keepdims=True)
        total += (p / np.maximum(norm, 1e-9)).sum(0)
    return total


def _predicted(batches, model, schema: pa.Schema, declared: bool):
    names, prototypes = model.value
    for b in batches:
        texts = [t or "" for t in b.column(0).to_pylist()]
        for i, j in _groups(texts):
            p = profiles(texts[i:j])
            norm = np.linalg.norm(p, axis=1)
            if len(names):
                cosine = p @ prototypes.T / np.maximum(norm, 1e-9)[:, None]
                best = cosine.argmax(1)
                score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                lang = [names[k] if n else "und" for k, n in zip(best, norm, strict=True)]
            else:
                cosine, score, lang = np.zeros((j - i, 0)), np.zeros(j - i), ["und"] * (j - i)
            own = [b.column(k).slice(i, j - i) for k in range(1, b.num_columns)]
            told = [[float(cosine[k, names.index(x)]) if x in names else None for k, x in enumerate(own.pop(0).to_pylist())]] if declared else []
            yield batch(schema, *own, lang, np.where(norm > 0, score, 0.0).astype(np.float64), *told)


def learn(docs: DataFrame, *, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes (unit vectors), from rows with text and lang; about ``sample`` of each language,
    chosen by a hash of doc_id, are bundled."""
    docs = docs.filter("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    share = docs.groupBy("lang").agg((F.lit(float(sample)) / F.count("lang")).alias("share"))
    # a row for each language, as the model has; so only the sample is dealt by language, not every text
    chosen = docs.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = chosen.groupBy("lang").applyInPandas(lambda pdf: pd.DataFrame({"lang": pdf["lang"][:1], "bundle": [bundled(pdf.sort_values(["doc_id", "text"])["text"].tolist()).tolist()]}), "lang string, bundle array<double>").collect()
    rows.sort(key=lambda r: r.lang)
    table = np.array([r.bundle for r in rows], np.float32).reshape(-1, DIM)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return [r.lang for r in rows], table / np.maximum(norm, 1e-9)


def predict_language(docs: DataFrame, model: tuple[list[str], np.ndarray], *, extra: tuple[str, ...] = (), declared: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row, after its columns ``extra``: the language of the closest prototype and its
    cosine, cut to 0 to 1. Texts that are null or have no letter are ``und`` with score 0, as are all where nothing was
    learned. Whole texts count; ties go to the language that sorts first; rows that repeat are rows of their own; a null
    doc_id stays null. Of other columns, only ``extra`` come back. ``declared``: a column of languages, of which
    ``declared_score`` has the cosine (null where none was learned by that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    told = [F.col(declared).alias("__declared")] if declared else []
    rows = docs.select("text", *told, *extra, F.col("doc_id").cast("long").alias("doc_id"))
    new = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("declared_score", T.DoubleType())]
    out = T.StructType([*rows.schema.fields[1 + len(told) :], *(T.StructField(*x) for x in new[: 2 + len(told)])])
    schema, tells = to_arrow_schema(out), bool(told)
    return rows.mapInArrow(lambda it: _predicted(it, shared, schema, tells), out)


def held_out(column: str, parts: int, rest: int):
    """Whether crc32 of the id as text leaves ``rest`` modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts == rest
