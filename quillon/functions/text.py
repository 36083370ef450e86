"""Text analysis: one tokenizer for documents and queries, and predicates on token arrays."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a word; the underscore and all beyond ASCII are part of words.
SEPARATORS = "\t\n\r\v\f,.<>{}[]\"':;!@#$%^&*()-+=~?/|` "
_CLASS = re.escape(SEPARATORS).replace("/", r"\/") + r"\\"
_WORD = rf"(?:\\.|[^{_CLASS}])+"


def tokens(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Lower-case words in order, without stopwords; a backslash makes the next character part of a word. Null has none."""
    low, drop = F.lower(text), sorted(stopwords)
    escaped = F.transform(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), lambda w: F.regexp_replace(w, r"\\(.)", "$1"))
    escaped = F.filter(escaped, lambda w: ~w.startswith(" "))  # such words are the index's own
    words = F.when(F.contains(low, F.lit("\\")), escaped).otherwise(F.split(low, f"[{re.escape(SEPARATORS)}]+"))
    wanted = F.filter(words, lambda w: (w != "") & ~w.isin(drop) if drop else w != "")
    return F.coalesce(wanted, F.array().cast("array<string>"))


def may_hold(text: Column, terms: Iterable[str]) -> Column:
    """False for a text that holds none of the words, without looking for words: none of its characters run like them."""
    low = F.lower(text)
    return functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(t)) for t in sorted(set(terms))), F.contains(text, F.lit("\\")))


def words_of(text: str) -> list[str]:
    """The same of a query's text."""
    return [re.sub(r"\\(.)", r"\1", m).lower() for m in re.findall(_WORD, text)]


def has_any(words: Column, terms: Iterable[str]) -> Column:
    terms = sorted(set(terms))
    if len(terms) == 1:
        return F.array_contains(words, terms[0])
    return F.arrays_overlap(words, F.array(*map(F.lit, terms)))


def has_affix(words: Column, kind: str, part: str) -> Column:
    """``kind``: prefix, suffix or infix."""
    test = {"prefix": lambda w: w.startswith(part), "suffix": lambda w: w.endswith(part), "infix": lambda w: w.contains(part)}[kind]
    return F.exists(words, test)


def glob_pattern(glob: str) -> str:
    """A glob (``*`` any run, ``?`` one character, ``[...]`` a class, backslash escapes) as a regular expression for the whole."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            body = glob[i + 1 : j]
            out.append("[" + ("^" if body[:1] == "^" else "") + re.sub(r"([\\\[&])", r"\\\1", body.lstrip("^")) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def has_glob(words: Column, glob: str) -> Column:
    return F.exists(words, lambda w: w.rlike(glob_pattern(glob)))


def has_phrase(words: Column, terms: list[str], slop: int = 0) -> Column:
    """Terms in order, with at most ``slop`` other words between each and the next. ``words`` are without stopwords."""
    if len(terms) == 1:
        return F.array_contains(words, terms[0])
    if slop == 0:
        return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")).contains(" " + " ".join(terms) + " ")

    def places(term: str) -> Column:
        return F.filter(F.transform(words, lambda w, i: F.when(w == term, i)), lambda i: i.isNotNull())

    def after(before: Column, term: str) -> Column:
        return F.filter(places(term), lambda p: F.exists(before, lambda q: (p > q) & (p - q <= slop + 1)))

    reached = places(terms[0])
    for term in terms[1:]:
        reached = after(reached, term)
    return F.size(reached) > 0


def tags(text: Column, separator: str = ",", case_sensitive: bool = False) -> Column:
    """The tags of a field: split, trimmed, lower-case unless told otherwise."""
    parts = F.filter(F.transform(F.split(text, re.escape(separator)), lambda t: F.trim(t)), lambda t: t != "")
    parts = parts if case_sensitive else F.transform(parts, lambda t: F.lower(t))
    return F.coalesce(parts, F.array().cast("array<string>"))
