"""Exact removal of repeated word passages, by relative Lempel-Ziv parsing.

Passages that could be equal meet in reference blocks (``repeats``). A block is indexed by a suffix array over its words, so
that the longest match of each place with any earlier document is known. Each document is factored greedily: a factor is
the longest match from its first word on. Factors of at least a window are duplicate spans. The windows that straddle a
factor's end are looked up one by one, so that none is missed because the parse followed another reference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .hashing import words
from .suffix_array import permuted_common_prefixes, suffix_array
from .tables import Scratch, batch, text_bytes

WINDOW, GRAM = 50, 16
#: Words of text in a block, and runs of windows with one anchor beyond which its windows are dealt by their content.
BLOCK, HOT = 1 << 16, 4096


def longest_earlier(shared: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """By rank: the longest match with a suffix of a smaller ``doc``, if of ``least`` symbols, else 0.

    In either direction the nearest suffix of a smaller document has it. Links lead past suffixes of later documents, several
    at a time, and the least common prefix on the way is the match; ways on which it is too short end."""
    out = np.zeros(len(doc), np.int64)
    for back in (False, True):
        d = doc[::-1] if back else doc
        match = (np.append(shared[1:], 0)[::-1] if back else shared).copy()
        link = np.arange(len(d)) - 1
        live = np.flatnonzero((match >= least) & (link >= 0))
        while len(live := live[(match[live] >= least) & (link[live] >= 0)]):
            live = live[d[link[live]] >= d[live]]
            via = link[live]
            match[live], link[live] = np.minimum(match[live], match[via]), link[via]
        match[(match < least) | (link < 0)] = 0
        out = np.maximum(out, match[::-1] if back else match)
    return out


def factored(texts: list[bytes], counts: np.ndarray, docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (piece, start) of pieces, sorted by document, that a piece of an earlier document holds as well."""
    parts = [t.split() for t in texts]  # at the six ASCII spaces
    lengths = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(lengths + 1) - lengths - 1
    codes, names = pd.factorize(np.array([w for p in parts for w in (*p, b"")][:-1], dtype=object))
    # words from 2 on, 1 between pieces and one 0 at the end
    s = np.append(codes + 2, 0).astype(np.uint16 if len(names) < 65534 else np.uint32)
    s[begin[1:] - 1] = 1
    sa = suffix_array(s, len(names) + 2)
    piece_of = np.searchsorted(begin, sa, "right") - 1
    left = begin[piece_of] + lengths[piece_of] - sa  # words up to the piece's end, which no factor passes
    longest = np.empty(len(s), np.int64)
    shared = permuted_common_prefixes(s, sa, int(lengths.max(initial=0)))[sa]
    longest[sa] = np.minimum(longest_earlier(shared, docs[piece_of], window), left)
    pieces, places = [], []
    at = np.flatnonzero(longest >= window)
    piece = np.searchsorted(begin, at, "right") - 1
    k = 0
    while k < len(at):  # a factor, then the first place after the windows that it holds
        j = piece[k]
        place = int(at[k] - begin[j])
        n = min(int(longest[at[k]]) - window + 1, int(counts[j]) - place)
        if n > 0:
            pieces.append(np.full(n, j))
            places.append(np.arange(place, place + n))
        k = int(np.searchsorted(at, at[k] + max(n, 1)))
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(pieces), np.concatenate(places)


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "start"], ignore_index=True)
    piece, place = factored(list(pdf["text"]), pdf["n"].to_numpy(), pdf["doc_id"].to_numpy(), WINDOW)
    return repeats.runs(pdf["doc_id"].to_numpy(), pdf["start"].to_numpy(), piece, place)


def _remaining(batches, schema: pa.Schema, digest: bool):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        locs = b.column(2)
        out: tuple[list, ...] = ([], [], [], [])
        for i in range(b.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            begin, end, _ = words(text, np.array([0, len(text)]))
            gone = repeats.covered(locs[i].values.to_numpy() if locs[i].is_valid else None, len(begin), WINDOW)
            raw = text.tobytes()
            kept = [raw[x:y] for x, y in (zip(begin.tolist(), end.tolist(), strict=True) if gone is None else zip(begin[~gone].tolist(), end[~gone].tolist(), strict=True))]
            joined = b" ".join(kept)
            out[0].append(len(begin))
            out[1].append(len(begin) - len(kept))
            out[2].append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        yield batch(schema, b.column(0), *out[:3])


def substring_dedup(docs: DataFrame, *, digest: bool = False, hot: int = HOT, block_words: int = BLOCK) -> DataFrame:
    """Removes every word that a window of 50 words covers which also starts in a document of a smaller ``doc_id``.

    Words are runs of other characters than the six ASCII spaces. Returns doc_id, n_words, n_removed and the remaining words
    joined by one space (``kept``) or, with ``digest``, their SHA-256. Null, empty and blank texts have no words. Repeats
    within one document stay. Equal rows (id and text) count as one document, and each gets its result. Other columns are
    ignored. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    plan = repeats.Plan(docs, Scratch(docs.sparkSession, "rlz"), kind="words", window=WINDOW, gram=GRAM, within=False, hot=hot)
    gone = plan.resolve(_block, shard_units=block_words)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest else "kept", pa.string())])
    return plan.joined(gone).mapInArrow(lambda it: _remaining(it, schema, digest), f"doc_id long, n_words long, n_removed long, {schema.names[-1]} string")
