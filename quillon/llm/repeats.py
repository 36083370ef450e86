"""Windows of units (bytes or words) that occur again: how equal windows of a whole corpus are brought together.

1. Each window belongs to the anchor that its content fixes (``hashing.anchors``); consecutive windows of one anchor make
   a run. A run is known by its anchor's hash and its content's hash, together 128 bits.
2. Runs are counted, with partial sums in the tasks that read them, so that a group of copies moves as a few rows.
3. Runs of equal content are settled at once: all but the first hold repeats only. Where an anchor has runs of different
   content, their first occurrences may share some windows; only these go, as text, to shards by anchor, where an index
   over the shard settles them window by window.
4. An anchor with very many different runs (a common line in changing surroundings) has its windows dealt by their own
   content instead, which no such line can make hot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import BYTE, anchors, grams, word_hashes, words
from .tables import Scratch, batch, spans, text_bytes

BLOCK = 1 << 20
_RUN = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
_MARK = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("loc", pa.int64())])


def pack(start, count, again=0):
    """Where a run stands, in one integer: first window's start, windows, and whether its document holds it further left."""
    return (start << 9) | (count << 1) | again


def runs(doc_ids: np.ndarray, starts: np.ndarray, piece: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Windows (piece, place), in order, as packed runs of their documents."""
    new = np.ones(len(piece), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
    lead = np.flatnonzero(new)
    count = np.diff(np.append(lead, len(piece)))
    return pd.DataFrame({"doc_id": doc_ids[piece[lead]], "loc": pack(starts[piece[lead]] + place[lead], count)})


def covered(locs: np.ndarray | None, length: int, window: int) -> np.ndarray | None:
    """Which units of a document the windows of its packed runs cover; None for no run."""
    if locs is None or not len(locs) or not length:
        return None
    start, count = locs >> 9, (locs >> 1) & 255
    change = np.bincount(start, minlength=length + 1) - np.bincount(np.minimum(start + count - 1 + window, length), minlength=length + 1)
    return np.cumsum(change[:length]) > 0


def units(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each unit, and where rows begin."""
    if kind == "bytes":
        return BYTE[data], offsets
    begin, end, rows = words(data, offsets)
    return word_hashes(data, begin, end), rows


def _blocks(batches, kind: str, window: int, gram: int):
    """(ids, anchors) by block of about ``BLOCK`` bytes."""
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(b.column(1))
        for i, j in spans(np.diff(offsets), BLOCK):
            values, rows = units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kind)
            found = anchors(values, rows, window, gram)
            if len(found.anchor):
                yield ids[i:j][found.row], found


def _counted(batches, kind: str, window: int, gram: int, held: int = 1 << 20):
    """Runs by anchor and content with the least document and the count, summed within the task as far as memory allows."""

    def summed(parts):
        a, c, d, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.lexsort((d, c, a))
        a, c, d, n = a[o], c[o], d[o], n[o]
        lead = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        return a[lead], c[lead], d[lead], np.add.reduceat(n, lead)

    def given(out):
        for i in range(0, len(out[0]), 1 << 16):
            yield batch(_RUN, *(x[i : i + (1 << 16)] for x in out))

    parts, size = [], 0
    for ids, found in _blocks(batches, kind, window, gram):
        parts.append((found.anchor.view(np.int64), found.content.view(np.int64), ids, np.ones(len(ids), np.int64)))
        size += len(ids)
        if size > held:
            out = summed(parts)
            parts, size = ([out], len(out[0])) if len(out[0]) < held // 2 else ([], 0)
            if not parts:
                yield from given(out)
    if parts:
        yield from given(summed(parts))


def _marked(batches, kind: str, window: int, gram: int):
    """Each run with its document and place."""
    for ids, found in _blocks(batches, kind, window, gram):
        again = np.zeros(len(ids), np.int64)
        o = np.lexsort((found.start, found.content, found.anchor, found.row))
        again[o[1:]] = (found.row[o[1:]] == found.row[o[:-1]]) & (found.anchor[o[1:]] == found.anchor[o[:-1]]) & (found.content[o[1:]] == found.content[o[:-1]])
        yield batch(_MARK, found.anchor.view(np.int64), found.content.view(np.int64), ids, pack(found.start, found.count, again))


def _pieces(batches, kind: str, window: int, hot: int, schema: pa.Schema):
    """The text of runs to settle; each window by itself, as a hash, where the anchor is hot."""
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        out: list[list] = [[] for _ in schema]
        size = 0
        for i, doc_id in enumerate(b.column(0).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            whole, begin, end = None, None, None
            if kind != "bytes":
                begin, end, _ = words(text, np.array([0, len(text)]))
            for x in b.column(2)[i].as_py():
                start, n = x["loc"] >> 9, (x["loc"] >> 1) & 255
                if x["kinds"] <= hot:
                    last = start + n - 2 + window
                    own = text[start : last + 1] if kind == "bytes" else text[begin[start] : end[last]]
                    for c, v in zip(out, (x["anchor"], 0, doc_id, start, n, own.tobytes()), strict=True):
                        c.append(v)
                else:
                    if whole is None:
                        whole = grams(units(text, np.array([0, len(text)]), kind)[0], window).view(np.int64)
                    for s in range(start, start + n):
                        for c, v in zip(out, (x["anchor"], int(whole[s]), doc_id, s, 0, None), strict=True):
                            c.append(v)
                size += n + window
            if size > 1 << 21:
                yield batch(schema, *out)
                out, size = [[] for _ in schema], 0
        if out[0]:
            yield batch(schema, *out)


class Plan:
    def __init__(self, docs: DataFrame, scratch: Scratch, *, kind: str, window: int, gram: int, within: bool, hot: int):
        """``within``: windows further left in the same document count as earlier, too."""
        self.docs, self.scratch, self.kind, self.window, self.gram, self.within, self.hot = docs, scratch, kind, window, gram, within, hot

    def marks(self) -> DataFrame:
        """(doc_id, loc) of runs that are repeats as a whole; with anchor and kinds, of runs to settle."""
        kind, window, gram = self.kind, self.window, self.gram
        groups = (
            self.docs.mapInArrow(lambda it: _counted(it, kind, window, gram), "anchor long, content long, first long, n long")
            .repartition("anchor")
            .groupBy("anchor", "content")
            .agg(F.min("first").alias("first"), F.sum("n").alias("n"))
            .withColumn("kinds", F.count("content").over(Window.partitionBy("anchor")))
            .filter("n > 1 or kinds > 1")
            .select("anchor", "content", "first", "kinds")
        )
        groups = self.scratch.keep(groups, "groups")
        every = self.docs.mapInArrow(lambda it: _marked(it, kind, window, gram), "anchor long, content long, doc_id long, loc long")
        gone = F.col("doc_id") > F.col("first")
        if self.within:
            gone = gone | (F.col("loc").bitwiseAND(1) == 1)
        out = (
            every.join(groups, ["anchor", "content"])
            .withColumn("gone", gone)
            .filter("gone or kinds > 1")
            .select("doc_id", "loc", F.when(~F.col("gone"), F.col("anchor")).alias("anchor"), F.when(~F.col("gone"), F.col("kinds")).alias("kinds"))
        )
        out = self.scratch.keep(out, "marks")
        self.scratch.drop("groups")
        return out

    def resolve(self, shard: Callable[[pd.DataFrame], pd.DataFrame], shard_units: int) -> DataFrame:
        """(doc_id, loc) of all runs whose windows all occur earlier. ``shard``: settles the runs of some anchors."""
        kind, window, hot = self.kind, self.window, self.hot
        marks = self.marks()
        open_ = marks.filter("anchor is not null")
        total = open_.agg(F.sum(F.shiftright("loc", 1).bitwiseAND(255) + (window - 1))).first()[0] or 0
        shards = max(1, -(-int(total) // shard_units))
        schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])
        pieces = (
            self.docs.join(open_.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "loc", "kinds")).alias("open")), "doc_id")
            .select("doc_id", "text", "open")
            .mapInArrow(lambda it: _pieces(it, kind, window, hot, schema), "anchor long, content long, doc_id long, start long, n long, text binary")
        )
        pieces = self.scratch.keep(pieces, "pieces")
        cold = pieces.filter("n > 0").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(lambda pdf: shard(pdf), "doc_id long, loc long")
        # windows by themselves: all but the first go, which is taken out without dealing them by what they share
        alone = pieces.filter("n = 0")
        place = ["doc_id", "start"] if self.within else ["doc_id"]
        first = alone.groupBy("anchor", "content").agg(F.min(F.struct(*place)).alias("first")).select("anchor", "content", "first.*")
        warm = alone.join(first, ["anchor", "content", *place], "left_anti").select("doc_id", pack_column(F.col("start")).alias("loc"))
        gone = self.scratch.keep(marks.filter("anchor is null").select("doc_id", "loc").unionByName(cold).unionByName(warm), "gone")
        self.scratch.drop("marks", "pieces")
        return gone

    def joined(self, gone: DataFrame) -> DataFrame:
        """Documents, each with its packed runs (null for none)."""
        return self.docs.join(gone.groupBy("doc_id").agg(F.collect_list("loc").alias("locs")), "doc_id", "left").select("doc_id", "text", "locs")


def pack_column(start):
    return F.shiftleft(start, 9) + 2
