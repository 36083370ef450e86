"""Cells are null, a double or a string; comparisons and truth never yield null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NUM, STR, NIL = "num", "str", "nil"


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str


def number(x) -> Value:
    return Value(F.lit(float(x)) if isinstance(x, (int, float)) else x, NUM)


def string(x) -> Value:
    return Value(F.lit(x) if isinstance(x, str) else x, STR)


def null() -> Value:
    return Value(F.lit(None).cast("double"), NIL)


def flag(cond: Column) -> Value:
    """1 or 0, never null."""
    return Value(F.when(cond, F.lit(1.0)).otherwise(F.lit(0.0)), NUM)


def truthy(v: Value) -> Column:
    """False for null, 0, NaN and the empty string."""
    if v.kind == STR:
        return F.coalesce(v.col != "", F.lit(False))
    return F.coalesce((v.col != 0.0) & ~F.isnan(v.col), F.lit(False))


def compare(op: str, a: Value, b: Value) -> Column:
    """Of the same type: by value, with null equal to null. Of different types: unequal, and neither is less."""
    no = F.lit(False)
    if a.kind != b.kind:
        both = a.col.isNull() & b.col.isNull()
        return {"==": both, "<=": both, ">=": both, "!=": ~both}.get(op, no)
    equal = a.col.eqNullSafe(b.col)
    less, more = F.coalesce(a.col < b.col, no), F.coalesce(a.col > b.col, no)
    return {"==": equal, "!=": ~equal, "<": less, ">": more, "<=": less | equal, ">=": more | equal}[op]


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Null unless both are numbers; a divisor of 0 gives null."""
    if a.kind != NUM or b.kind != NUM:
        return null()
    x, y = a.col, b.col
    by = F.when(y != 0.0, y)
    return number({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / by, "%": lambda: x % by, "^": lambda: F.pow(x, y)}[op]())


def as_number(v: Value) -> Column:
    """Numbers as they are, strings if they hold one; for mathematics and dates, which accept both."""
    return v.col.try_cast("double") if v.kind == STR else v.col


def clean(c: Column) -> Column:
    """NaN becomes null, as grouping, counting and sorting see it."""
    return F.when(~F.isnan(c), c)


def number_text(c: Column) -> Column:
    """A number with six significant digits at most, without trailing zeros."""
    size = F.when(c == 0, 0).otherwise(F.floor(F.log10(F.abs(c)))).cast("int")
    digits = lambda x, n: F.regexp_replace(F.regexp_replace(F.round(x, n).cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    unit = F.pow(F.lit(10.0), F.lit(5) - size)
    fixed = digits(F.round(c * unit) / unit, 10)
    power = F.concat(F.when(size < 0, "e-").otherwise("e+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    scientific = F.concat(digits(c / F.pow(F.lit(10.0), size), 5), power)
    return F.when(F.isnan(c), "nan").when(c == 0, "0").when(size.between(-5, 5), fixed).otherwise(scientific)
