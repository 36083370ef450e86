"""The scalar expression language of APPLY and FILTER, compiled to columns.

Precedence, low to high: ``||``, ``&&``, ``!``, ``== !=``, ``< <= > >=``, ``+ -``, ``* / %``, ``^`` (right), unary ``-``.
Fields are ``@name``. A wrong type or an unknown function gives null, as does a wrong number of arguments.
"""

from __future__ import annotations

import inspect
import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import METRES, haversine, point
from .values import NUM, STR, Value, arithmetic, as_number, compare, flag, null, number, number_text, string, truthy

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|@(?P<field>[\w.\-]*\w)|(?P<name>[A-Za-z_]\w*)|(?P<op>\|\||&&|==|!=|<=|>=|[!<>+\-*/%^(),]))")
_BINARY = [("||",), ("&&",), ("!",), ("==", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%")]


@dataclass(frozen=True)
class Literal(Value):
    """A string of the query text itself."""

    text: str = ""


def tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while text[i:].strip():
        m = _TOKEN.match(text, i)
        if not m:
            raise ValueError(f"can't read expression at {text[i : i + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        i = m.end()
    return out


def parse(text: str) -> tuple:
    """A tree of ("num", x), ("str", s), ("field", f), ("call", name, args), ("not", x), ("neg", x), (operator, a, b)."""
    toks, at = tokens(text), 0

    def peek() -> tuple[str, str]:
        return toks[at] if at < len(toks) else ("end", "")

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal at
        t = peek()
        if t[0] == "end" or (value and t[1] != value):
            raise ValueError(f"expected {value or 'more'} in {text!r}")
        at += 1
        return t

    def level(k: int) -> tuple:
        if k == len(_BINARY):
            return power()
        if _BINARY[k] == ("!",):
            if peek() == ("op", "!"):
                take()
                return ("not", level(k))
            return level(k + 1)
        left = level(k + 1)
        while peek()[0] == "op" and peek()[1] in _BINARY[k]:
            left = (take()[1], left, level(k + 1))
        return left

    def power() -> tuple:
        left = unary()
        if peek() == ("op", "^"):
            take()
            return ("^", left, power())
        return left

    def unary() -> tuple:
        if peek() == ("op", "-"):
            take()
            return ("neg", unary())
        kind, value = take()
        if kind == "num":
            return ("num", float(value))
        if kind == "str":
            return ("str", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "field":
            return ("field", value)
        if kind == "name":
            take("(")
            args = []
            while peek()[1] != ")":
                args.append(level(0))
                if peek()[1] == ",":
                    take()
            take(")")
            return ("call", value.lower(), args)
        if value == "(":
            inner = level(0)
            take(")")
            return inner
        if value == "!":
            return ("not", unary())
        raise ValueError(f"unexpected {value!r} in {text!r}")

    tree = level(0)
    if at < len(toks):
        raise ValueError(f"unexpected {peek()[1]!r} in {text!r}")
    return tree


def _takes(function: Callable, n: int) -> bool:
    """Whether a function may be called with ``n`` arguments."""
    try:
        inspect.signature(function).bind(*range(n))
    except TypeError:
        return False
    return True


def compile_tree(tree: tuple, fields: Callable[[str], Value]) -> Value:
    kind = tree[0]
    if kind == "num":
        return number(tree[1])
    if kind == "str":
        return Literal(F.lit(tree[1]), STR, tree[1])
    if kind == "field":
        return fields(tree[1])
    if kind == "call":
        function = FUNCTIONS.get(tree[1])
        args = [compile_tree(a, fields) for a in tree[2]]
        return function(*args) if function and _takes(function, len(args)) else null()
    if kind == "not":
        return flag(~truthy(compile_tree(tree[1], fields)))
    if kind == "neg":
        v = compile_tree(tree[1], fields)
        return number(-v.col) if v.kind == NUM else null()
    a, b = (compile_tree(x, fields) for x in tree[1:])
    if kind == "&&":
        return flag(truthy(a) & truthy(b))
    if kind == "||":
        return flag(truthy(a) | truthy(b))
    if kind in ("==", "!=", "<", "<=", ">", ">="):
        return flag(compare(kind, a, b))
    return arithmetic(kind, a, b)


def compile_text(text: str, fields: Callable[[str], Value]) -> Value:
    return compile_tree(parse(text), fields)


def _text(f: Callable[..., Column]):
    return lambda *v: string(f(*(x.col for x in v))) if all(x.kind == STR for x in v) else null()


def _test(f: Callable[..., Column]):
    return lambda a, b: number(F.when(f(a.col, b.col), 1.0).when(~f(a.col, b.col), 0.0)) if a.kind == b.kind == STR else null()


def _math(f: Callable[[Column], Column]):
    return lambda v: number(f(as_number(v)).cast("double"))


def _date(f: Callable[[Column], Column]):
    return lambda v: number(f(F.timestamp_seconds(F.floor(as_number(v)))).cast("double"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _log(base: float | None):
    def log(c: Column) -> Column:
        of = F.log(c) if base is None else F.log2(c) if base == 2 else F.log10(c)
        return F.when(c > 0, of).when(c == 0, F.lit(-math.inf)).when(c < 0, F.lit(math.nan))

    return log


def _substr(s: Value, off: Value, n: Value) -> Value:
    if s.kind != STR:
        return null()
    start, length = F.greatest(as_number(off).cast("int"), F.lit(0)), F.greatest(as_number(n).cast("int"), F.lit(0))
    return string(F.decode(F.substring(F.encode(s.col, "UTF-8"), start + 1, length), "UTF-8"))


def _split(s: Value, sep: Value | None = None, strip: Value | None = None) -> Value:
    """Splits and joins with commas again: a separator (literal) becomes a comma, the strip characters go at the ends."""
    if s.kind != STR:
        return null()
    sep_col, strip_col = (F.lit(",") if sep is None else sep.col), (F.lit(" ") if strip is None else strip.col)
    parts = F.transform(F.split(s.col, F.concat(F.lit(r"\Q"), sep_col, F.lit(r"\E"))), lambda x: F.trim(x, strip_col))
    return string(F.when(sep_col == "", s.col).otherwise(F.array_join(parts, ",")))


def _format(fmt: Value, *args: Value) -> Value:
    """``fmt`` must be a literal: %s %d %f %% are filled in, others and those without an argument stay as they are."""
    if not isinstance(fmt, Literal):
        return null()
    out, rest, i = [], list(args), 0
    for m in re.finditer(r"%(.)", fmt.text):
        out.append(F.lit(fmt.text[i : m.start()]))
        i = m.end()
        if m[1] == "%":
            out.append(F.lit("%"))
        elif m[1] in "sdf" and rest:
            v = rest.pop(0)
            x = as_number(v)
            shown = {"s": v.col if v.kind == STR else number_text(x), "d": x.cast("long").cast("string"), "f": F.format_string("%.6f", x)}[m[1]]
            out.append(F.coalesce(shown, F.lit("")))
        else:
            out.append(F.lit(m[0]))
    return string(F.concat(*out, F.lit(fmt.text[i:])))


#: Directives of strftime in the C locale, and Spark's patterns for the same.
_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a",
    "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "h": "MMM", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm",
    "D": "MM/dd/yy", "x": "MM/dd/yy", "X": "HH:mm:ss", "r": "hh:mm:ss a",
}


def _pieces(fmt: str):
    """(directive, text) of a format: one of both is empty. A % that ends it stands for itself."""
    for directive, plain in re.findall(r"%(.)|([^%]+|%$)", fmt, re.S):
        yield ("", "%") if directive == "%" else (directive, plain)


def java_pattern(fmt: str) -> str | None:
    """The pattern that reads what ``fmt`` writes; None for a directive that none stands for."""
    out = []
    for directive, plain in _pieces(fmt):
        if directive and directive not in _PATTERNS:
            return None
        out.append(_PATTERNS[directive] if directive else "".join(f"'{p}'" if re.search(r"[A-Za-z]", p) else "''" if p == "'" else p for p in re.split(r"([A-Za-z]+|')", plain) if p))
    return "".join(out)


def _directive(t: Column, d: str) -> Column:
    """A moment as a directive of strftime shows it; unknown ones stay as they are."""
    if d in _PATTERNS:
        return F.date_format(t, _PATTERNS[d])
    monday, year = F.weekday(t), F.dayofyear(t)
    if d in "GgV":  # the year and week of ISO 8601: those of the week's Thursday
        thursday = F.date_add(F.to_date(t), 3 - monday)
        return {"G": F.year(thursday).cast("string"), "g": F.lpad((F.year(thursday) % 100).cast("string"), 2, "0"), "V": F.lpad(F.weekofyear(t).cast("string"), 2, "0")}[d]
    shown = {
        "s": lambda: F.unix_seconds(t).cast("string"),
        "e": lambda: F.lpad(F.dayofmonth(t).cast("string"), 2, " "),
        "k": lambda: F.lpad(F.hour(t).cast("string"), 2, " "),
        "l": lambda: F.lpad(((F.hour(t) + 11) % 12 + 1).cast("string"), 2, " "),
        "C": lambda: F.lpad(F.floor(F.year(t) / 100).cast("string"), 2, "0"),
        "u": lambda: (monday + 1).cast("string"),
        "w": lambda: (F.dayofweek(t) - 1).cast("string"),
        "U": lambda: F.lpad(F.floor((year + 6 - (F.dayofweek(t) - 1)) / 7).cast("string"), 2, "0"),
        "W": lambda: F.lpad(F.floor((year + 6 - monday) / 7).cast("string"), 2, "0"),
        "P": lambda: F.lower(F.date_format(t, "a")),
        "c": lambda: F.concat(F.date_format(t, "EEE MMM "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "), F.date_format(t, " HH:mm:ss yyyy")),
        "n": lambda: F.lit("\n"),
        "t": lambda: F.lit("\t"),
        "z": lambda: F.lit("+0000"),
        "Z": lambda: F.lit("GMT"),
    }
    return shown[d]() if d in shown else F.lit(f"%{d}")


def _timefmt(ts: Value, fmt: Value | None = None) -> Value:
    if fmt is not None and not isinstance(fmt, Literal):
        return null()
    t = F.timestamp_seconds(F.floor(as_number(ts)))
    return string(F.concat(F.when(t.isNotNull(), ""), *(_directive(t, d) if d else F.lit(plain) for d, plain in _pieces(fmt.text if fmt else "%Y-%m-%dT%H:%M:%S"))))


def _parsetime(s: Value, fmt: Value) -> Value:
    if s.kind != STR or not isinstance(fmt, Literal):
        return null()
    pattern = java_pattern(fmt.text)
    return null() if pattern is None else number(F.unix_timestamp(F.try_to_timestamp(s.col, F.lit(pattern))).cast("double"))


def _geodistance(a: Value, b: Value, unit: Value | None = None) -> Value:
    name = unit.text.lower() if isinstance(unit, Literal) else "km"
    if a.kind != STR or b.kind != STR or name not in METRES:
        return null()
    # fixed values: this function has a radius and a mile of its own
    metres = METRES | {"mi": 1609.344}
    return number(haversine(point(a.col), point(b.col), 6371000.0) / metres[name])


FUNCTIONS: dict[str, Callable[..., Value]] = {
    "lower": _text(lambda s: F.translate(s, _UPPER, _LOWER)),
    "upper": _text(lambda s: F.translate(s, _LOWER, _UPPER)),
    "substr": _substr,
    "format": _format,
    "split": _split,
    "matched_terms": lambda *_: string(""),
    "to_number": lambda v: number(as_number(v)),
    "to_str": lambda v: v if v.kind == STR else string(number_text(v.col)),
    "exists": lambda v: flag(v.col.isNotNull()),
    "startswith": _test(lambda a, b: a.startswith(b)),
    "contains": _test(lambda a, b: a.contains(b)),
    "strlen": lambda v: number(F.octet_length(v.col).cast("double")) if v.kind == STR else null(),
    "abs": _math(F.abs),
    "floor": _math(F.floor),
    "ceil": _math(F.ceil),
    "sqrt": _math(F.sqrt),
    "log": _math(_log(None)),
    "log2": _math(_log(2)),
    "log10": _math(_log(10)),
    "exp": _math(F.exp),
    "hour": _date(F.hour),
    "minute": _date(F.minute),
    "day": _date(F.dayofmonth),
    "dayofmonth": _date(F.dayofmonth),
    "month": _date(F.month),
    "monthofyear": _date(F.month),
    "year": _date(F.year),
    "dayofweek": _date(lambda t: F.dayofweek(t) - 1),
    "dayofyear": _date(F.dayofyear),
    "timefmt": _timefmt,
    "parsetime": _parsetime,
    "geodistance": _geodistance,
}


def register_function(name: str, f: Callable[..., Value]) -> None:
    """Makes ``f`` (of Values) callable in expressions, as a script's function would be."""
    FUNCTIONS[name.lower()] = f

