"""Exact removal of repeated byte strings, by suffix arrays from induced sorting.

Every window of 100 bytes is routed, with others that could equal it, to a shard (``repeats``). A shard's suffix array
is built by induced sorting: suffixes are classified as smaller or larger than their successors, the leftmost-smaller
substrings are sorted (recursively where their names repeat) and the array is induced from them in linear time.
Permuted common prefixes of suffix neighbours then tell which windows are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .tables import Scratch, batch, spans, text_bytes

WINDOW, GRAM = 100, 32
#: Bytes of text in a shard, and runs of windows with one anchor beyond which its windows are dealt by their content.
SHARD, HOT = 1 << 18, 4096


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last, a unique least symbol, is."""
    n = len(s)
    less = np.zeros(n, np.int8)
    less[:-1] = np.sign(s[1:].astype(np.int32) - s[:-1].astype(np.int32))
    less[-1] = 1
    # a run of equal symbols has the type of its end
    at = np.where(less != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return less[at] > 0


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Suffix array from sorted (or, to sort their substrings, bucketed) leftmost-smaller suffixes, bucket by bucket."""
    sigma, n = len(heads) - 1, len(s)
    sa = np.full(n, -1, np.int32)
    ptr = heads[:-1].copy()
    order = np.argsort(s[seeds], kind="stable")
    seeds = seeds[order]
    seed_at = np.searchsorted(s[seeds], np.arange(sigma + 1))
    used = np.flatnonzero(np.diff(heads))

    def place(from_: np.ndarray, want: bool, step: int) -> None:
        j = from_[from_ > 0] - 1
        j = j[small[j] == want]
        if not len(j):
            return
        c = s[j]
        if len(j) == 1:
            k = c[0]
            sa[ptr[k] if step > 0 else ptr[k] - 1] = j[0]
            ptr[k] += step
            return
        o = np.argsort(c, kind="stable")
        c, j = c[o], j[o]
        counts = np.bincount(c, minlength=sigma)
        rank = np.arange(len(c)) - (np.cumsum(counts) - counts)[c]
        sa[ptr[c] + rank if step > 0 else ptr[c] - 1 - rank] = j
        ptr[:] += step * counts

    for c in used:  # larger suffixes, left to right
        done = heads[c]
        while done < ptr[c]:
            part, done = sa[done : ptr[c]], ptr[c]
            place(part, False, 1)
        if seed_at[c] < seed_at[c + 1]:
            place(seeds[seed_at[c] : seed_at[c + 1]], False, 1)
    large_end = ptr.copy()
    ptr = heads[1:].copy()
    for c in used[::-1]:  # smaller suffixes, right to left
        done = heads[c + 1]
        while done > ptr[c]:
            part, done = sa[ptr[c] : done][::-1], ptr[c]
            place(part, True, -1)
        if large_end[c] > heads[c]:
            place(sa[heads[c] : large_end[c]][::-1], True, -1)
    sa[0] = n - 1  # the least symbol precedes nothing, so that nothing induces it
    return sa


def _swept(out: np.ndarray, s: np.ndarray, type_: np.ndarray, want: bool, ptr: np.ndarray) -> None:
    """One pass of induction over ``out``, in place: the predecessor of each suffix in turn, if of the wanted type, takes the
    next place of its bucket (``ptr``). A stretch is placed at once as long as nothing lands before its end, and -1 stands for
    places still empty. Where stretches are short (runs of one symbol), suffix by suffix."""
    n, at, step = len(out), 0, 256
    while at < n:
        part = out[at : at + step]
        place = np.flatnonzero(part > 0)
        j = part[place] - 1
        fits = type_[j] == want
        place, j = place[fits] + at, j[fits]
        end = min(at + step, n)
        if len(j):
            c = s[j]
            least = np.minimum.accumulate(ptr[c])  # the first place that is filled by then
            late = np.flatnonzero(place[1:] > least[:-1])
            if len(late):
                j, c = j[: late[0] + 1], c[: late[0] + 1]
            end = min(end, int(least[len(j) - 1]))
            o = np.argsort(c, kind="stable")
            c, j = c[o], j[o]
            lead = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            size = np.diff(np.append(lead, len(c)))
            out[ptr[c] + np.arange(len(c)) - np.repeat(lead, size)] = j
            ptr[c[lead]] += size
        if end - at < 24:
            stop = min(n, end + 512)
            while end < stop:
                j = out[end] - 1
                if j >= 0 and type_[j] == want:
                    c = s[j]
                    out[ptr[c]] = j
                    ptr[c] += 1
                end += 1
        step = min(max(2 * (end - at), 64), 1 << 16)
        at = end


def _induce_few(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The same for large alphabets, whose buckets hold a few suffixes each: in stretches that may span many buckets."""
    n = len(s)
    sa = np.full(n, -1, np.int64)
    o = np.argsort(s[seeds], kind="stable")
    c = s[seeds][o]
    lead = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(lead, len(c)))
    sa[heads[c.astype(np.int64) + 1] - np.repeat(size, size) + np.arange(len(c)) - np.repeat(lead, size)] = seeds[o]
    ptr = heads[:-1].copy()
    _swept(sa, s, small, False, ptr)
    # only the larger suffixes stay, at the front of their buckets
    keep = np.zeros(n + 1, np.int64)
    np.add.at(keep, heads[:-1], 1)
    np.add.at(keep, ptr, -1)
    sa[np.cumsum(keep[:n]) == 0] = -1
    _swept(sa[::-1], s, small, True, n - heads[1:])  # from the back, so that places count from there
    sa[0] = n - 1  # the least symbol precedes nothing, so that nothing induces it
    return sa.astype(np.int32)


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Of integers below ``sigma``; the last must be 0, and the only 0."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int32)
    s = s.astype(np.int32 if sigma > 65535 else np.uint16 if sigma > 256 else np.uint8, copy=False)
    small = _types(s)
    heads = np.zeros(sigma + 1, np.int64)
    np.cumsum(np.bincount(s, minlength=sigma), out=heads[1:])
    leftmost = np.zeros(n, bool)
    leftmost[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(leftmost)
    induce = _induce if n > 64 * np.count_nonzero(np.diff(heads)) else _induce_few
    if len(lms) > 1:
        by_substring = induce(s, small, lms, heads)
        by_substring = by_substring[leftmost[by_substring]]
        names, high = _names(s, lms, by_substring)
        if high < len(lms):
            lms = lms[suffix_array(names, high)]
        else:
            sorted_ = np.empty(len(lms), np.int64)
            sorted_[names] = lms
            lms = sorted_
    return induce(s, small, lms, heads)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names leftmost-smaller substrings by rank: in text order, and how many differ."""
    end = np.append(lms[1:], len(s) - 1)
    length = np.zeros(len(s), np.int32)
    length[lms] = end - lms + 1
    p, q = ordered[:-1], ordered[1:]
    same = length[p] == length[q]
    live = np.flatnonzero(same)
    for j in range(int(length.max())):
        live = live[length[p[live]] > j]
        if not len(live):
            break
        differ = s[p[live] + j] != s[q[live] + j]
        same[live[differ]] = False
        live = live[~differ]
    rank = np.zeros(len(ordered), np.int64)
    np.cumsum(~same, out=rank[1:])
    name = np.empty(len(s), np.int64)
    name[ordered] = rank
    return name[lms], int(rank[-1]) + 1


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By text position: how many symbols, up to ``most``, a suffix shares with its predecessor in the array. ``s`` holds
    unsigned integers of 8, 16 or 32 bits, of which 64 bits at a time are compared."""
    bits, step = 8 * s.itemsize, 8 // s.itemsize
    out = np.zeros(len(s), np.int32)
    live, before = sa[1:].astype(np.int64), sa[:-1].astype(np.int64)
    text = np.concatenate([s, np.zeros(most + 2 * step, s.dtype)])
    wide = np.ndarray(len(s) + most + step, np.uint64, buffer=text, strides=(s.itemsize,))  # several symbols from each place
    room = len(s) - np.maximum(live, before)
    for j in range(0, most, step):
        differ = wide[live + j] ^ wide[before + j]
        last = differ != 0
        low = differ[last]
        low &= ~low + np.uint64(1)
        out[live[last]] = j + np.log2(low.astype(np.float64)).astype(np.int32) // bits
        live, before = live[~last], before[~last]
        out[live] = j + step
        if not len(live):
            break
    capped = np.empty(len(s), np.int64)
    capped[sa[1:]], capped[sa[0]] = room, 0
    return np.minimum(np.minimum(out, capped), most).astype(np.int32)


def repeated_windows(pieces: list[bytes], counts: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (piece, start) that also begin in a piece of a lower order, or further left in the same.

    Each piece holds ``counts`` windows; suffixes with fewer than ``window`` bytes before the piece's end hold none.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    # separators become 1, bytes their rank from 2 on, and one 0 ends the text
    separator = begin[1:] - 1
    present = np.flatnonzero(np.bincount(raw, minlength=256))
    code = np.zeros(256, np.uint8 if len(present) < 254 else np.uint16)
    code[present] = np.arange(len(present)) + 2
    s = code[raw]
    s[separator] = 1
    s[-1] = 0
    sa = suffix_array(s, len(present) + 2)
    shared = permuted_common_prefixes(s, sa, window)
    lead = shared[sa] < window
    group = np.cumsum(lead)
    several = ~lead  # only suffixes with an equal neighbour go on
    several[:-1] |= ~lead[1:]
    sa, group = sa[several], group[several]
    piece_of = np.searchsorted(begin, sa, "right") - 1
    whole = sa - begin[piece_of] < counts[piece_of]
    sa, group, piece_of = sa[whole], group[whole], piece_of[whole]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    o = np.lexsort((sa - begin[piece_of], order[piece_of], group))
    sa, group = sa[o], group[o]
    again = np.zeros(len(sa), bool)
    again[1:] = group[1:] == group[:-1]
    at = np.sort(sa[again])
    piece = np.searchsorted(begin, at, "right") - 1
    return piece, at - begin[piece]


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of a shard as runs: ids of windows' rows, first start, count."""
    pdf = pdf.drop_duplicates(["doc_id", "start"]).sort_values(["doc_id", "start"], ignore_index=True)  # rows may repeat
    piece, place = repeated_windows(list(pdf["text"]), pdf["n"].to_numpy(), np.arange(len(pdf)), WINDOW)
    return repeats.runs(pdf["doc_id"].to_numpy(), pdf["start"].to_numpy(), piece, place)


def _remaining(batches, schema: pa.Schema):
    for b in batches:
        ids = b.column(0)
        data, offsets = text_bytes(b.column(1))
        locs = b.column(2)
        out = ([], [], [], [])
        for i in range(b.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            gone = repeats.covered(locs[i].values.to_numpy() if locs[i].is_valid else None, len(text), WINDOW)
            kept = text[~gone] if gone is not None else text
            out[0].append(len(text))
            out[1].append(len(text) - len(kept))
            out[2].append(0 if gone is None else int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
            out[3].append(hashlib.sha256(kept.tobytes()).hexdigest() if schema.names[-1] == "kept_sha256" else kept.tobytes().decode("utf-8", "ignore"))
        yield batch(schema, ids, *out)


def suffix_dedup(docs: DataFrame, *, digest: bool = False, hot: int = HOT, shard_bytes: int = SHARD) -> DataFrame:
    """Removes every byte of ``text`` that a 100-byte string covers which also starts earlier.

    Earlier is in a document of a smaller ``doc_id`` or further left in the same; matches never cross documents. Returns
    doc_id, n_bytes, n_removed, n_spans and the remaining text (``kept``, with partial characters at a cut left out) or,
    with ``digest``, the SHA-256 of the remaining bytes. Null and empty texts have 0 bytes and nothing removed. Equal rows
    (id and text) count as one document, and each gets its result. Other columns are ignored. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "suffix-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan = repeats.Plan(docs, scratch, kind="bytes", window=WINDOW, gram=GRAM, within=True, hot=hot)
    gone = plan.resolve(_shard, shard_units=shard_bytes)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256" if digest else "kept", pa.string())])
    return plan.joined(gone).mapInArrow(lambda it: _remaining(it, schema), f"doc_id long, n_bytes long, n_removed long, n_spans long, {schema.names[-1]} string")
