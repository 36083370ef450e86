"""Plain versions of operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def suffix_dedup(rows, window=100):
    first, out = {}, {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(texts):
        for s in range(len(texts[i]) - window + 1):
            first.setdefault(texts[i][s : s + window], (i, s))
    for i, t in texts.items():
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if first[t[s : s + window]] != (i, s):
                gone[s : s + window] = [True] * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(rows, window=50):
    first, out = {}, {}
    texts = {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(texts):
        for s in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][s : s + window]), i)
    for i, t in texts.items():
        gone = [False] * len(t)
        for s in range(len(t) - window + 1):
            if first[tuple(t[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = " ".join(w for w, g in zip(t, gone, strict=True) if not g)
        out[i] = (len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_dedup(rows, size=4, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
