"""The aggregation pipeline: load, join, group, sort, apply, filter and limit in any order, over typed fields."""

from __future__ import annotations

import functools
import shlex
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import compile_text
from ..functions.values import NUM, STR, Value, clean, null, truthy
from ..plans.schema import NUMERIC, Index
from .search import matching, value


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def reducer(name: str, v: Value | None) -> Column:
    """COUNT, COUNT_DISTINCT (null counts once), SUM (0 over nothing), AVG, MIN, MAX; strings don't add up."""
    name = name.upper()
    if name == "COUNT":
        return F.count(F.lit(1)).cast("double")
    x = clean(v.col) if v.kind == NUM else v.col
    if name == "COUNT_DISTINCT":
        return (F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))).cast("double")
    numbers = _finite(v.col) if v.kind == NUM else F.lit(None).cast("double")
    if name == "SUM":
        return F.coalesce(F.sum(numbers), F.lit(0.0))
    if name == "AVG":
        return F.avg(numbers)
    if name in ("MIN", "MAX"):
        return (F.min if name == "MIN" else F.max)(x)
    raise ValueError(f"unknown reducer {name}")


class Pipeline:
    """Steps return a new pipeline; ``frame()`` is the DataFrame with the fields that are printed."""

    def __init__(self, df: DataFrame, kinds: dict[str, str], shown: tuple[str, ...] = ()):
        self.df, self.kinds, self.shown = df, kinds, shown

    @staticmethod
    def over(df: DataFrame, index: Index, query: str = "*", params: dict[str, Any] | None = None, alias: str | None = None) -> Pipeline:
        """All fields of the index, as their types have them, of documents that match."""
        found = matching(df, index, query, params)
        name = (lambda n: f"{alias}.{n}") if alias else (lambda n: n)
        kinds = {name(f.name): NUM if f.kind == NUMERIC else STR for f in index.fields}
        cols = [value(index, f).alias(name(f.name)) for f in index.fields]
        return Pipeline(found.select(F.col("__key").alias(name("__key")), *cols), kinds | {name("__key"): STR})

    def _value(self, name: str) -> Value:
        name = name.lstrip("@")
        return Value(F.col(f"`{name}`"), self.kinds[name]) if name in self.kinds else null()

    def load(self, *names: str, **renamed: str) -> Pipeline:
        df, kinds = self.df, dict(self.kinds)
        for alias, name in renamed.items():
            df, kinds[alias] = df.withColumn(alias, self._value(name).col), kinds[name.lstrip("@")]
        return Pipeline(df, kinds, tuple(dict.fromkeys((*self.shown, *(n.lstrip("@") for n in names), *renamed))))

    def join(self, other: Pipeline, on: list[tuple[str, str]]) -> Pipeline:
        """Inner join on equal fields of the same type; numbers never equal strings and nulls never join. No condition at
        all pairs every row with every other, as in the source language."""
        if not on:
            return Pipeline(self.df.crossJoin(other.df), self.kinds | other.kinds, self.shown)
        both = self.kinds | other.kinds
        conds = [(F.col(f"`{a}`") == F.col(f"`{b}`")) if both[a] == both[b] else F.lit(False) for a, b in ((x.lstrip("@"), y.lstrip("@")) for x, y in on)]
        return Pipeline(self.df.join(other.df, functools.reduce(lambda a, b: a & b, conds), "inner"), both, self.shown)

    def group(self, keys: list[str], reducers: list[tuple[str, str | None, str]]) -> Pipeline:
        """``reducers``: (function, field, alias). Without keys, all rows are a group, and no rows give none."""
        keys = [k.lstrip("@") for k in keys]
        by = [(clean(self._value(k).col) if self._value(k).kind == NUM else self._value(k).col).alias(k) for k in keys]
        aggs = [reducer(f, self._value(x) if x else None).alias(alias) for f, x, alias in reducers]
        if keys:
            out = self.df.groupBy(*by).agg(*(aggs or [F.count(F.lit(1)).alias("__n")])).drop(*([] if aggs else ["__n"]))
        else:
            out = self.df.agg(F.count(F.lit(1)).alias("__n"), *aggs).filter("__n > 0").drop("__n")
        kinds = {k: self._value(k).kind for k in keys} | {alias: self._value(x).kind if f.upper() in ("MIN", "MAX") else NUM for f, x, alias in reducers}
        return Pipeline(out, kinds, (*keys, *(r[2] for r in reducers)))

    def apply(self, expression: str, alias: str) -> Pipeline:
        v = compile_text(expression, self._value)
        return Pipeline(self.df.withColumn(alias, v.col), self.kinds | {alias: STR if v.kind == STR else NUM}, tuple(dict.fromkeys((*self.shown, alias))))

    def filter(self, expression: str) -> Pipeline:
        return Pipeline(self.df.filter(truthy(compile_text(expression, self._value))), self.kinds, self.shown)

    def sort(self, *keys: tuple[str, str] | str, most: int | None = None) -> Pipeline:
        """Nulls and NaN come last both ways; ties go by key while there is one."""
        order = []
        for k in keys:
            name, way = (k, "ASC") if isinstance(k, str) else k
            v = self._value(name)
            c = clean(v.col) if v.kind == NUM else v.col
            order.append(c.desc_nulls_last() if way.upper() == "DESC" else c.asc_nulls_last())
        order += [F.asc(f"`{k}`") for k in self.kinds if k.endswith("__key")]
        out = self.df.orderBy(*order)
        return Pipeline(out.limit(most) if most else out, self.kinds, tuple(dict.fromkeys((*self.shown, *((k if isinstance(k, str) else k[0]).lstrip("@") for k in keys)))))

    def limit(self, offset: int, count: int) -> Pipeline:
        return Pipeline((self.df.offset(offset) if offset else self.df).limit(count), self.kinds, self.shown)

    def frame(self) -> DataFrame:
        return self.df.select(*(F.col(f"`{n}`").alias(n.replace(".", "_")) for n in self.shown))


def aggregate(command: str, tables: dict[str, tuple[DataFrame, Index]], params: dict[str, Any] | None = None) -> DataFrame:
    """Runs ``index query clause...``, for instance ``orders * GROUPBY 1 @status REDUCE COUNT 0 AS n SORTBY 2 @n DESC``.

    Clauses: LOAD, LOAD_FROM, GROUPBY with REDUCE, SORTBY with MAX, APPLY, FILTER, LIMIT. ``tables``: what indexes are over.
    """
    words = shlex.split(command)
    at = 2

    def take(n: int = 1):
        nonlocal at
        got = words[at : at + n]
        if len(got) < n:
            raise ValueError(f"clause ends early in {command!r}")
        at += n
        return got if n > 1 else got[0]

    def named() -> str | None:
        nonlocal at
        if at < len(words) and words[at].upper() == "AS":
            at += 2
            return words[at - 1]
        return None

    joined = any(w.upper() == "LOAD_FROM" for w in words)
    name = words[0]
    pipe = Pipeline.over(*tables[name], words[1], params, alias=name if joined else None)
    while at < len(words):
        clause = take().upper()
        if clause == "LOAD":
            left = int(take())
            while left > 0:
                field = take()
                left -= 1
                alias = named() if left > 1 or (at < len(words) and words[at].upper() == "AS") else None
                left -= 2 * bool(alias)
                pipe = pipe.load(**{alias: field}) if alias else pipe.load(field)
        elif clause == "LOAD_FROM":
            other = take()
            alias = named() or other
            on = [tuple(take().split("=")) for _ in range(int(take()))]
            query = "*"
            if at < len(words) and words[at].upper() == "QUERY":
                _, query = take(2)
            right = Pipeline.over(*tables[other], query, params, alias=alias)
            on = [(a, b) if b.lstrip("@") in right.kinds else (b, a) for a, b in on]
            pipe = pipe.join(right, on)
        elif clause == "GROUPBY":
            n = int(take())
            keys = [take() for _ in range(n)]
            reducers = []
            while at < len(words) and words[at].upper() == "REDUCE":
                _, f, k = take(3)
                args = [take() for _ in range(int(k))]
                reducers.append((f, args[0] if args else None, named() or f"__generated_alias{f.lower()}{'_'.join(a.lstrip('@') for a in args)}"))
            pipe = pipe.group(keys, reducers)
        elif clause == "SORTBY":
            args = [take() for _ in range(int(take()))]
            keys = []
            for a in args:
                if a.upper() in ("ASC", "DESC"):
                    keys[-1] = (keys[-1][0], a)
                else:
                    keys.append((a, "ASC"))
            most = None
            if at < len(words) and words[at].upper() == "MAX":
                most = int(take(2)[1])
            pipe = pipe.sort(*keys, most=most)
        elif clause == "APPLY":
            expression = take()
            pipe = pipe.apply(expression, named() or expression)
        elif clause == "FILTER":
            pipe = pipe.filter(take())
        elif clause == "LIMIT":
            offset, count = map(int, take(2))
            pipe = pipe.limit(offset, count)
        else:
            raise ValueError(f"unknown clause {clause}")
    return pipe.frame()
