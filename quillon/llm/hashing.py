"""Vectorised hashing of bytes, words and windows, and the anchors by which equal windows meet."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random odd value for each byte.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive values, by doubling; shorter by width - 1."""
    done, powers, step = None, values, 1
    start = 0
    while True:
        if width & step:
            if done is None:
                done = powers
            else:
                done = done[: len(done) - step] * _MUL[20 + start] + powers[start : start + len(done) - step]
                done ^= done >> np.uint64(32)
            start += step
        if start == width:
            return done
        level = step.bit_length()
        powers = powers[:-step] * _MUL[level] + powers[step:]
        powers ^= powers >> np.uint64(31)
        step *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        s = min(have, width - have)
        x = np.minimum(x[:-s], x[s:])
        have += s
    return x


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: begin and end in ``data``, and the first word's index of each row (n + 1)."""
    inside = ~SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = (inside[0], inside[-1]) if len(data) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    cut = cut[inside[cut] & inside[cut - 1]]
    begin = np.flatnonzero(edge[:-1] & inside) if len(data) else np.zeros(0, np.int64)
    end = np.flatnonzero(edge[1:] & inside) + 1 if len(data) else np.zeros(0, np.int64)
    if len(cut):  # rows that touch without a space are apart all the same
        cut = np.unique(cut)
        begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    return begin, end, np.searchsorted(begin, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each word; begin and end as by ``words``."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _MUL[60])


@dataclass
class Anchors:
    """Runs of consecutive window starts that share an anchor. Each window of a row belongs to just one run."""

    anchor: np.ndarray  # hash of the anchor, which is equal in equal windows
    content: np.ndarray  # hash of all that the run's windows cover
    row: np.ndarray
    start: np.ndarray  # of the first window, within the row
    count: np.ndarray  # of windows


def anchors(values: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    """``values`` holds a hash of each unit, ``offsets`` cuts it into rows; windows have ``window`` units.

    A window's anchor is its leftmost gram of least hash, so that it depends on the window alone: equal windows have
    equal anchors at equal places, wherever they stand.
    """
    lengths = np.diff(offsets)
    fit = np.flatnonzero(lengths >= window)
    if not len(fit):
        e = np.zeros(0, np.int64)
        return Anchors(e.astype(np.uint64), e.astype(np.uint64), e, e, e)
    hashes = grams(values, gram)
    key = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min(key, window - gram + 1)
    # starts of whole windows, row by row
    n = lengths[fit] - window + 1
    first = np.cumsum(n) - n
    starts = np.arange(int(n.sum())) + np.repeat(offsets[fit] - first, n)
    at = (least[starts] & _LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[first] = True
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(at)))
    begin, place = starts[lead], at[lead]
    end = begin + count - 1 + window
    content = (place - begin).astype(np.uint64) * _MUL[50] + count.astype(np.uint64) * _MUL[51]
    for j in range(0, 2 * window - gram, gram):  # grams side by side, and the last that fits
        content = content * _MUL[52] + hashes[np.minimum(begin + j, end - gram)]
        content ^= content >> np.uint64(29)
    row = np.repeat(fit, n)[lead]
    return Anchors(mixed(hashes[place]), mixed(content), row, begin - offsets[row], count)
