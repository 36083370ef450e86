"""English stems by the published Snowball algorithm (its third version), and columns of them.

Words are stemmed in Arrow batches, a bounded stretch of words at a time whatever a batch or a row holds; only the
different words of a stretch become Python's, and a worker remembers a bounded number of words.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the algorithm: word lists, endings and what becomes of them.
_WHOLE = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_HEADS = ("arsen", "commun", "emerg", "gener", "inter", "later", "organ", "past", "univers")
_KEEP_ING = {"inn", "out", "cann", "herr", "earr", "even"}
_KEEP_EED = {"proc", "exc", "succ"}
_DOUBLE = re.compile(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$")
_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogist": "og",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_FOURTH = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
#: The same endings, longest first.
_PASTS, _SECONDS, _THIRDS, _FOURTHS = (tuple(sorted(e, key=len, reverse=True)) for e in (("eed", "eedly", "ed", "edly", "ing", "ingly"), _SECOND, _THIRD, _FOURTH))
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_SHORT = re.compile(rf"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER}|past)$")
_REGION = re.compile(rf"{_VOWEL}{_OTHER}")
_HAS_VOWEL, _CONSONANT_Y, _QUOTE = re.compile(_VOWEL), re.compile(rf"(^|{_VOWEL})y"), re.compile(r"'(s'?)?$")
#: Bounds of memory: words that are looked at together, and words that a worker remembers.
STRETCH, KEPT = 1 << 18, 1 << 17


def _after(word: str, start: int) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _ending(word: str, endings: tuple[str, ...]) -> str | None:
    """The first of the endings that the word has."""
    return next(e for e in endings if word.endswith(e)) if word.endswith(endings) else None


@functools.lru_cache(maxsize=KEPT)
def stem(word: str) -> str:
    """The stem of a lower-case English word; words of one or two letters are their own."""
    if len(word) <= 2:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word.removeprefix("'")
    if "y" in w:
        w = _CONSONANT_Y.sub(r"\1Y", w)
    head = next(h for h in _HEADS if w.startswith(h)) if w.startswith(_HEADS) else None
    r1 = len(head) if head else _after(w, 0)
    r2 = _after(w, r1)

    def short(part: str) -> bool:
        return _SHORT.search(part) is not None

    # plurals
    if "'" in w:
        w = _QUOTE.sub("", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        w = w[:-1]

    # past and progressive forms
    end = _ending(w, _PASTS)
    if end in ("eed", "eedly"):
        if w[: -len(end)] not in _KEEP_EED and len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and _HAS_VOWEL.search(base := w[: -len(end)]):
        if end == "ing" and re.fullmatch(rf"{_OTHER}y", base):
            w = base[0] + "ie"
        elif end != "ing" or base not in _KEEP_ING:
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _DOUBLE.search(w):
                w = w if re.fullmatch("[aeo]..", w) else w[:-1]
            elif len(w) <= r1 and short(w):
                w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    # compound endings, in the first region
    end = _ending(w, _SECONDS)
    if end and len(w) - len(end) >= r1:
        base = w[: -len(end)]
        if end == "li":
            w = base if base[-1:] in tuple("cdeghkmnrt") else w
        elif end != "ogi" or base.endswith("l"):
            w = base + _SECOND[end]
    end = _ending(w, _THIRDS)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + _THIRD[end]

    # simple endings, in the second region
    end = _ending(w, _FOURTHS)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e"):
        if len(w) > r2 or (len(w) > r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def common(part: str) -> str:
    """How every word begins whose stem begins with a part: an ending takes two letters of a stem along, at most."""
    return part[: max(1, len(part) - 2)]


def _starts(rows: pa.ListArray) -> np.ndarray:
    """Where the words of each row begin among all, and their number."""
    return np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)])


def _stretches(rows: pa.ListArray) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(place of the first word, different words, which of these each word is) of bounded stretches, across rows."""
    words = rows.flatten()
    for at in range(0, len(words), STRETCH):
        some = words.slice(at, STRETCH).dictionary_encode()
        yield at, some.dictionary.to_pylist(), some.indices.to_numpy()


def _stemmed(rows: pa.ListArray) -> pa.ListArray:
    parts = [pa.array(map(stem, kinds), pa.string()).take(pa.array(which)) for _, kinds, which in _stretches(rows)]
    return pa.ListArray.from_arrays(pa.array(_starts(rows), pa.int32()), pa.concat_arrays(parts or [pa.array([], pa.string())]), mask=rows.is_null())


def _tallied(rows: pa.ListArray, terms: list[str]) -> pa.ListArray:
    starts = _starts(rows)
    out = np.zeros((len(rows), 1 + len(terms)), np.int32)
    for at, kinds, which in _stretches(rows):
        found = [s if (s := stem(w)) != w else None for w in kinds]
        for k, hit in enumerate([[s is not None for s in found], *([s == t for s in found] for t in terms)]):
            places = at + np.flatnonzero(np.array(hit)[which])
            if len(places):
                of = np.searchsorted(starts, places, side="right") - 1
                out[of[0] : of[-1] + 1, k] += np.bincount(of - of[0]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32()), pa.array(out.ravel()))


def _phrases(rows: pa.ListArray, terms: list[str], slop: int) -> list[bool]:
    starts = _starts(rows)
    places: list[list[np.ndarray]] = [[] for _ in terms]
    for at, kinds, which in _stretches(rows):
        found = [stem(w) for w in kinds]
        for t, some in zip(terms, places, strict=True):
            some.append(at + np.flatnonzero(np.array([t in both for both in zip(kinds, found, strict=True)])[which]))
    out = np.zeros(len(rows), bool)
    reached, *others = (np.concatenate([*some, np.zeros(0, np.int64)]).astype(np.int64) for some in places)
    of = lambda p: np.searchsorted(starts, p, side="right") - 1
    for later in others:
        before = np.searchsorted(reached, later) - 1  # the nearest one ahead
        later, near = later[before >= 0], reached[before[before >= 0]]
        reached = later[(later - near <= slop + 1) & (of(later) == of(near))]
    out[of(reached)] = True
    return out.tolist()


def stems(words: Column) -> Column:
    """The stem of each word; null of null."""

    @F.arrow_udf("array<string>")
    def stems_(rows: pa.Array) -> pa.Array:
        return _stemmed(rows)

    return stems_(words)


def tally(words: Column, terms: list[str]) -> Column:
    """How many words have another stem, and of these stems how many are each term; 0 of null."""

    @F.arrow_udf("array<int>")
    def tally_(rows: pa.Array) -> pa.Array:
        return _tallied(rows, terms)

    return tally_(words)


def has_phrase(words: Column, terms: list[str], slop: int = 0) -> Column:
    """Terms in order, with at most ``slop`` other words between each and the next; a word stands for its stem too."""

    @F.arrow_udf("boolean")
    def has_phrase_(rows: pa.Array) -> pa.Array:
        return pa.array(_phrases(rows, terms, slop), pa.bool_())

    return has_phrase_(words)
