"""Quality classifier: hashed word and character n-gram vectors, averaged per document, with a softmax on top.

The vectors and the output layer are learned together by stochastic gradient descent in numpy on a bounded sample. As the
score is linear in the average, scoring gathers one learned number per feature instead of a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BYTE, grams, mixed, word_hashes, words
from .tables import batch, spans, text_bytes

#: Labelled documents that training reads at most, buckets of features (words, then n-grams), vector length, epochs.
SAMPLE, BUCKETS, DIM, EPOCHS, RATE = 4000, 1 << 16, 16, 12, 0.5
GRAMS = (3, 4)
_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def features(data: np.ndarray, offsets: np.ndarray):
    """Row and bucket of each word, and of each n-gram of bytes within a row."""
    begin, end, rows = words(data, offsets)
    yield np.repeat(np.arange(len(offsets) - 1), np.diff(rows)), (word_hashes(data, begin, end) >> np.uint64(48)).astype(np.int32)
    values = BYTE[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for n in GRAMS:
        if len(values) >= n:
            inside = row[: len(row) - n + 1] == row[n - 1 :]
            yield row[: len(inside)][inside], ((mixed(grams(values, n))[inside] >> np.uint64(48)).astype(np.int32) + BUCKETS)


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """A weight for each feature and a bias; their average over a document is the log odds of label 1."""
    if len(set(labels)) < 2:
        return np.zeros(2 * BUCKETS, np.float32), 0.0 if not labels else (8.0 if labels[0] else -8.0)
    docs = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        ids = np.concatenate([b for _, b in features(raw, np.array([0, len(raw)]))])
        docs.append(tuple(x.astype(np.int32 if k == 0 else np.float32) for k, x in enumerate(np.unique(ids, return_counts=True))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 * BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = 0.5 / share
    steps = EPOCHS * len(docs)
    step = 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            ids, counts = docs[k]
            if not len(ids):
                continue
            counts = counts / counts.sum()
            mean = counts @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]] * rate
            back = p @ out
            out -= np.outer(p, mean)
            bias -= p
            # the rate of a vector makes up for its share in the average
            vectors[ids] -= np.outer(np.minimum(counts * len(ids), 10), back)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def _scored(batches, model):
    weights, bias = model.value
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in spans(np.diff(offsets), 1 << 20):
            total, count = np.zeros(j - i), np.zeros(j - i)
            for row, bucket in features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                total += np.bincount(row, weights[bucket], j - i)
                count += np.bincount(row, minlength=j - i)
            z = total / np.maximum(count, 1) + bias
            yield batch(_OUT, b.column(0).slice(i, j - i), 1 / (1 + np.exp(-np.clip(z, -50, 50))))


def quality_scores(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) for each row of ``docs``; score is the chance of label 1 and falls back on the bias for empty and
    null texts. ``labels`` has doc_id and quality; null labels are left out, and of repeated ones the greatest counts. At
    most ``sample`` labelled documents, chosen by a hash of their ids, train the model. Without labels of both kinds, all
    scores say the one kind, or 0.5. Other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("label"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # at most ``sample`` rows
    rows = docs.join(chosen, "doc_id").select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    model = spark.sparkContext.broadcast(train([r.text for r in rows], [int(r.label) for r in rows]))
    return docs.mapInArrow(lambda it: _scored(it, model), "doc_id long, score double")
