"""The search language: text to a tree of frozen nodes.

Precedence, low to high: ``|``, juxtaposition (and), ``-`` (not) and ``~`` (optional).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Node:
    kind: str  # all, and, or, not, optional, field, term, phrase, affix, glob, range, geo, tags, exists, within, weight, none
    parts: tuple = ()
    value: Any = None


@dataclass(frozen=True)
class Nearest:
    k: int
    field: str
    vector: Any
    alias: str


@dataclass(frozen=True)
class Query:
    where: Node
    nearest: Nearest | None = None


_TOKEN = re.compile(
    r"""\s*(?:(?P<arrow>=>)|(?P<field>@[\w.\-]*\w(?=\s*:))|(?P<param>\$\w+)|(?P<phrase>"(?:\\.|[^"\\])*"(?:~\d+)?)|(?P<glob>w'(?:\\.|[^'\\])*')
    |(?P<num>[+-]?(?:inf\b|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)(?![\w]))|(?P<op>[()\[\]{}|:~*-])|(?P<word>(?:\\.|[^\s()\[\]{}|:~*"@$'=\\-])(?:\\.|[^\s()\[\]{}|:*"@$'=\\])*)|(?P<comma>,)|(?P<quoted>'(?:\\.|[^'\\])*'))""",
    re.X | re.S,
)


class _Parser:
    def __init__(self, text: str, params: dict[str, Any]):
        self.text, self.params, self.at = text, params, 0

    def peek(self):
        while True:
            m = _TOKEN.match(self.text, self.at)
            if not m:
                if self.text[self.at :].strip():
                    raise ValueError(f"can't read query at {self.text[self.at : self.at + 20]!r}")
                return "end", "", self.at, self.at
            return m.lastgroup, m[m.lastgroup], m.end(), m.start(m.lastgroup)

    def take(self, value: str | None = None):
        kind, got, end, _ = self.peek()
        if kind == "end" or (value is not None and got != value):
            raise ValueError(f"expected {value or 'more'} at {self.at} of {self.text!r}, got {got!r}")
        self.at = end
        return kind, got

    def bound(self, value: str):
        if value not in (v := {f"${k}": x for k, x in self.params.items()}):
            raise ValueError(f"no parameter {value}")
        return v[value]

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek()[1] == "|":
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(q for p in parts for q in (p.parts if p.kind == "or" else (p,))))

    def both(self) -> Node:
        parts = []
        while self.peek()[0] not in ("end", "arrow") and self.peek()[1] not in (")", "|"):
            parts.append(self.one())
        if not parts:
            raise ValueError(f"empty part in {self.text!r}")
        return parts[0] if len(parts) == 1 else Node("and", tuple(q for p in parts for q in (p.parts if p.kind == "and" else (p,))))

    def one(self) -> Node:
        value = self.peek()[1]
        if value in ("-", "~"):
            self.take()
            return Node("not" if value == "-" else "optional", (self.one(),))
        node = self.primary()
        m = re.match(r"\s*=>\s*\{\s*\$weight\s*:\s*([\d.]+)\s*;?\s*\}", self.text[self.at :])
        if m:
            self.at += m.end()
            return Node("weight", (node,), float(m[1]))
        return node

    def primary(self) -> Node:
        kind, value = self.take()
        if value == "(":
            inner = self.either()
            self.take(")")
            return inner
        if kind == "field":
            self.take(":")
            return Node("field", (self.condition(),), value[1:])
        if value == "*":
            follows = self.peek()
            if follows[0] in ("word", "num") and follows[3] == self.at:  # *suffix or *infix*
                self.take()
                if self.text[self.at : self.at + 1] == "*":
                    self.take("*")
                    return Node("affix", (), ("infix", follows[1].lower()))
                return Node("affix", (), ("suffix", follows[1].lower()))
            return Node("all")
        if kind == "phrase":
            m = re.fullmatch(r'"(.*)"(?:~(\d+))?', value, re.S)
            return Node("phrase", (), (m[1], int(m[2] or 0)))
        if kind == "glob":
            return Node("glob", (), value[2:-1].lower())
        if kind == "param":
            return Node("term", (), str(self.bound(value)))
        if kind in ("word", "num"):
            if self.text[self.at : self.at + 1] == "*":
                self.take("*")
                return Node("affix", (), ("prefix", value.lower()))
            return Node("term", (), value)
        raise ValueError(f"unexpected {value!r} in {self.text!r}")

    def condition(self) -> Node:
        value = self.peek()[1]
        if value == "[":
            return self.bracket()
        if value == "{":
            return self.braces()
        if value == "*" and not re.match(r"\s*\*[\w]", self.text[self.at :]):
            self.take()
            return Node("exists")
        if value == "-":
            self.take()
            return Node("not", (self.condition(),))
        return self.primary()

    def bracket(self) -> Node:
        m = re.match(r"\s*\[([^\]]*)\]", self.text[self.at :])
        if not m:
            raise ValueError(f"open range in {self.text!r}")
        self.at += m.end()
        words = [w for w in re.split(r"[\s,]+", m[1].strip()) if w]
        if words and words[0].upper() == "VECTOR_RANGE":
            return Node("within", (), (float(self.scalar(words[1])), self.scalar(words[2])))
        if len(words) == 4:
            return Node("geo", (), (*(float(self.scalar(w)) for w in words[:3]), words[3].lower()))
        if len(words) != 2:
            raise ValueError(f"a range needs two bounds: {m[0]!r}")
        bounds = []
        for w in words:
            bounds += [float(str(self.scalar(w.lstrip("("))).replace("inf", "inf")), w.startswith("(")]
        if math.isnan(bounds[0]) or math.isnan(bounds[2]):
            raise ValueError("a bound is no number")
        return Node("range", (), tuple(bounds))

    def scalar(self, word: str):
        return self.bound(word) if word.startswith("$") else word

    def braces(self) -> Node:
        m = re.match(r"\s*\{((?:\\.|'[^']*'|\"[^\"]*\"|[^}\\])*)\}", self.text[self.at :])
        if not m:
            raise ValueError(f"open tags in {self.text!r}")
        self.at += m.end()
        out = []
        for part in re.split(r"(?<!\\)\|", m[1]):
            part = part.strip()
            if part.startswith("$"):
                out.append(("exact", str(self.bound(part))))
            elif part.startswith("w'"):
                out.append(("glob", part[2:-1]))
            elif part[:1] in "\"'" and part[-1:] == part[:1] and len(part) > 1:
                out.append(("exact", part[1:-1]))
            else:
                kind = {(True, True): "infix", (True, False): "suffix", (False, True): "prefix", (False, False): "exact"}[part.startswith("*"), part.endswith("*") and not part.endswith(r"\*")]
                out.append((kind, re.sub(r"\\(.)", r"\1", part.strip("*") if kind != "exact" else part)))
        return Node("tags", (), tuple(out))


def parse(text: str, params: dict[str, Any] | None = None) -> Query:
    """``params``: values of ``$name``. ``where=>[KNN k @field $vector AS alias]`` asks for nearest rows among ``where``."""
    params = params or {}
    m = re.search(r"=>\s*\[\s*KNN\s+(\S+)\s+@(\S+)\s+\$(\w+)((?:\s+\w+\s+\S+)*)\s*\]\s*$", text, re.I)
    nearest = None
    if m:
        more = dict(zip(*[iter(m[4].split())] * 2, strict=True))
        k = params[m[1][1:]] if m[1].startswith("$") else m[1]
        nearest = Nearest(int(k), m[2], params[m[3]], next((v for n, v in more.items() if n.upper() == "AS"), f"__{m[2]}_score"))
        text = text[: m.start()]
    p = _Parser(text, params)
    where = p.either()
    if p.peek()[0] != "end":
        raise ValueError(f"unexpected {p.peek()[1]!r} in {text!r}")
    return Query(where, nearest)
