"""Distances of vectors, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """L2: the root of the squared differences; IP: 1 - dot product; COSINE: 1 - cosine, 0 for a zero vector."""
    double = lambda x: x.cast("double")
    if metric == "L2":
        return F.sqrt(_sum(a, b, lambda x, y: (double(x) - double(y)) * (double(x) - double(y))))
    dot = _sum(a, b, lambda x, y: double(x) * double(y))
    if metric == "IP":
        return F.lit(1.0) - dot
    if metric == "COSINE":
        norm = F.sqrt(_sum(a, a, lambda x, y: double(x) * double(y))) * F.sqrt(_sum(b, b, lambda x, y: double(x) * double(y)))
        return F.when(norm == 0, F.lit(0.0)).otherwise(F.lit(1.0) - dot / norm)
    raise ValueError(f"unknown metric {metric}")


def similarity(d: Column, metric: str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + d * d) if metric == "L2" else (F.lit(2.0) - d) / 2.0


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
