"""Declared document indexes: fields with types and options over tables or JSON."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: The words that a text field leaves out by default.
STOPWORDS = frozenset("a is the an and are as at be but by for if in into it no not of on or such that their then there these they this to was will with".split())
TAG, TEXT, NUMERIC, GEO, VECTOR = "TAG", "TEXT", "NUMERIC", "GEO", "VECTOR"


@dataclass(frozen=True)
class Field:
    """``source``: column of the table, or a JSONPath (from ``$``) into its document column; the name itself by default."""

    name: str
    kind: str
    source: str | None = None
    separator: str = ","
    case_sensitive: bool = False
    weight: float = 1.0
    metric: str = "L2"
    dim: int | None = None
    noindex: bool = False
    multi: bool = False
    no_stem: bool = False


@dataclass(frozen=True)
class Index:
    name: str
    key: str
    fields: tuple[Field, ...]
    stopwords: frozenset[str] = STOPWORDS
    #: Groups of words of which each stands for all.
    synonyms: tuple[frozenset[str], ...] = ()
    prefix: str = ""
    document: str | None = None
    #: ``english`` texts are found by stems too, but for fields with ``no_stem``; None leaves stems out.
    language: str | None = "english"

    def __post_init__(self):
        if self.language not in (None, "english", "en", "eng"):
            raise ValueError(f"no stems of language {self.language}")

    def stemmed(self, f: Field) -> bool:
        return self.language is not None and not f.no_stem

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"no field {name} in index {self.name}")

    def altered(self, *more: Field) -> Index:
        return replace(self, fields=(*self.fields, *more))
