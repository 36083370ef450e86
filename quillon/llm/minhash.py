"""Near-duplicate documents by one-permutation MinHash with optimal densification, banded buckets and star-shaped edges.

Each document's shingle hashes fall into bins by one permutation; a bin's sketch is its least hash, and an empty bin
borrows from a bin that a hash of its own number picks. Bands of bins name buckets. Documents of equal shingle sets are one
class, of which only the representative goes on. In a bucket only edges between a centre, the member that shares most
buckets with most others, and the other members are candidates; every candidate is confirmed on the full sets. Two members
that their centre doesn't link may be linked all the same. They meet by what makes them differ from the centre, in an exact
filter (``differing``): a link must share so much of both differences that hardly any other pair comes up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import LOWER, grams, mixed, word_hashes, words
from .tables import Scratch, batch, spans, text_bytes

#: At a likeness of 0.8, 64 bands of 6 rows miss a pair with a chance of 4e-9.
BANDS, ROWS = 64, 6
#: Tasks that share the members of a centre, at most.
SALTS = 64
#: Tries of an empty bin before it takes the best of all full bins.
TRIES = 24
_NONE = np.uint64(2**64 - 1)
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, in order. Texts of fewer words are one shingle; texts of none have none."""
    data = LOWER[data]
    begin, end, rows = words(data, offsets)
    values = word_hashes(data, begin, end)
    n = np.diff(rows)
    row, hashes = [], []
    for k in range(1, size + 1):  # k < size: the whole of a short text
        own = np.flatnonzero(n == k) if k < size else np.flatnonzero(n >= k)
        if not len(own):
            continue
        g = grams(values, k)
        count = n[own] - k + 1
        at = np.arange(int(count.sum())) + np.repeat(rows[own] - (np.cumsum(count) - count), count)
        row.append(np.repeat(own, count))
        hashes.append(mixed(g[at] + np.uint64(k)))
    if not row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, hashes = np.concatenate(row), np.concatenate(hashes)
    o = np.lexsort((hashes, row))
    row, hashes = row[o], hashes[o]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def densified(table: np.ndarray) -> np.ndarray:
    """Fills empty bins (rows without any full bin stay empty)."""
    rows, bins = table.shape
    full = table != _NONE
    out = table.copy()
    r, b = np.nonzero(~full & full.any(1)[:, None])
    for k in range(TRIES):
        if not len(r):
            return out
        pick = (mixed(b.astype(np.uint64) * np.uint64(977) + np.uint64(k * 1_000_003 + 1)) % np.uint64(bins)).astype(np.int64)
        hit = full[r, pick]
        out[r[hit], b[hit]] = table[r[hit], pick[hit]]
        r, b = r[~hit], b[~hit]
    for row in np.unique(r):  # few full bins: each empty one takes that of the least hash of both numbers
        own, have = b[r == row], np.flatnonzero(full[row])
        pick = have[np.argmin(mixed(own[:, None].astype(np.uint64) * np.uint64(bins) + have.astype(np.uint64)), 1)]
        out[row, own] = table[row, pick]
    return out


def band_hashes(row: np.ndarray, hashes: np.ndarray, rows: int, bands: int = BANDS, per_band: int = ROWS) -> np.ndarray:
    bins = bands * per_band
    table = np.full((rows, bins), _NONE)
    np.minimum.at(table, (row, ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)), mixed(hashes))
    table = densified(table).reshape(rows, bands, per_band)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (rows, bands)).copy()
    for k in range(per_band):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + table[:, :, k])
    return out


def _sketched(batches, size: int, bands: int, per_band: int):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in spans(np.diff(offsets), 1 << 19):
            row, hashes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            n = np.bincount(row, minlength=j - i)
            keys = []
            for salt in (1, 2):
                total = np.append(np.uint64(0), np.cumsum(mixed(hashes + np.uint64(salt << 40)), dtype=np.uint64))
                end = np.cumsum(n)
                keys.append((total[end] - total[end - n]).view(np.int64))
            table = band_hashes(row, hashes, j - i, bands, per_band).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, bands, 0))).astype(np.int32)), pa.array(table[n > 0].ravel()))
            yield batch(_SKETCH, b.column(0).slice(i, j - i), n, *keys, lists)


def _sets(batches, size: int):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for i, j in spans(np.diff(offsets), 1 << 20):
            row, hashes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=j - i))).astype(np.int32)
            yield batch(_SETS, b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64))))


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of undirected links (a, b): each node takes its neighbours' least label and that label's own
    label, until nothing changes. Labels and links stay distributed; each round is a written table."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    both = scratch.keep(both, f"{name}-links")
    labels = scratch.keep(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("jump"))
        new = labels.join(near, "node").select("node", F.least("near", "component").alias("near"), F.col("component").alias("was")).join(jump, "near")
        new = scratch.keep(new.select("node", F.least("near", "jump").alias("component"), "was"), f"{name}-{step + 1}")
        changed = new.filter("component <> was").limit(1).count()
        scratch.drop(f"{name}-{step}")
        labels, step = new.select("node", "component"), step + 1
        if not changed:
            scratch.drop(f"{name}-links")
            return labels


def side_by_side(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b and more) with the sets of both, ``x`` and ``y``. Pairs of a frequent ``a`` are dealt over several
    tasks, each with a copy of its set: at most 1,000 documents have over a thousandth of the pairs, so their table is
    broadcast."""
    most = max(256, pairs.count() // 1000)
    heavy = F.broadcast(pairs.groupBy("a").agg(F.ceil(F.count("b") / most).cast("int").alias("parts")).filter("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")).join(heavy, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = pairs.join(heavy, "a", "left").withColumn("part", F.pmod(F.hash("b"), parts)).drop("parts")
    return dealt.join(left, ["a", "part"]).join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets link them."""
    common = F.size(F.array_intersect("x", "y"))
    return side_by_side(pairs.select("a", "b"), sets).filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")


def differing(members: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) around a common centre that may still link two components: all that a link could need, none that a
    count of differences excludes.

    ``members``: (a centre, b document, n and m their sizes). The difference of a document from its centre is the set D of
    shingles that only one of both has. For two documents, the shingles that only one has are those in only one D. A link
    allows ``r * (n + m)`` of these, r = (100 - percent) / (100 + percent), so that both D share at least
    ``(|D| + |E| - r * (n + m)) / 2``. A document that the centre doesn't link (an outsider) has a D too large for one
    that it does link to share little of it; hence the bound is positive for every pair with an outsider, and one of each
    pair is: documents that the centre links are one component. By it, with each D in one order, rare shingles first,
    linked documents share one of the first of each, and few enough stand before it. What edits put in is rare, what they
    leave is in no D at all, so that members of a large group of near copies meet hardly ever, other than by their text.
    """
    r = (100 - percent) / (100 + percent)
    label = lambda side, name: labels.select(F.col("node").alias(side), F.col("component").alias(name))
    known = members.join(label("b", "cb"), "b", "left").join(label("a", "ca"), "a", "left").filter("a <> b")
    known = known.select("a", "b", "n", "m", F.coalesce("cb", "b").alias("cb"), (F.coalesce("cb", "b") != F.coalesce("ca", "a")).alias("out"))
    known = scratch.keep(known, "known")
    # nothing is left to meet where all are linked with the centre, or one alone is not
    open_ = known.groupBy("a").agg(F.count(F.lit(1)).alias("members"), F.max("out").alias("some"), F.min("cb").alias("least"), F.max("cb").alias("most")).filter("some and members > 1 and least < most")
    each = side_by_side(known.join(open_.select("a"), "a", "left_semi"), sets)
    each = each.select("a", "b", F.col("m").alias("size"), "cb", "out", F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("d"))
    each = scratch.keep(each, "differences")
    # how far a group's outsiders and its members are beyond what a link allows, at least
    slack = F.size("d") - r * F.col("size")
    bounds = each.groupBy("a").agg(F.min(F.when(F.col("out"), slack)).alias("far"), F.min(slack).alias("near"))
    held = each.select("a", F.explode("d").alias("shingle"), "cb", "out").groupBy("a", "shingle").agg(F.count(F.lit(1)).alias("held"), F.min("cb").alias("least"), F.max("cb").alias("most"), F.max("out").alias("any"))
    # shingles that meet nothing keep their place in the order, as the first, but need not be told apart
    meets = held.filter("any and least < most").select("a", "shingle", "held")
    # a centre's members are dealt over several tasks, each with a copy of its bounds
    dealt = bounds.select("a", "far", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    rows = each.withColumn("part", F.pmod(F.hash("b"), F.lit(SALTS))).join(dealt, ["a", "part"])
    rows = rows.select("a", "b", "size", "cb", "out", "far", "near", F.size("d").alias("differ"), F.explode("d").alias("shingle"))
    rows = rows.join(meets, ["a", "shingle"], "left")
    order = Window.partitionBy("a", "b").orderBy(F.col("held").asc_nulls_first(), "shingle")
    rows = rows.withColumn("place", F.row_number().over(order)).filter("held is not null")
    first = lambda other: F.col("differ") + 1 - F.ceil((F.col("differ") - r * F.col("size") + F.col(other)) / 2 - 1e-6)
    rows = rows.withColumns({"asks": F.col("out") & (F.col("place") <= first("near")), "answers": F.col("place") <= first("far")}).filter("asks or answers")
    rows = scratch.keep(rows.select("a", "b", "size", "cb", "out", "differ", "shingle", "place", "asks", "answers"), "first")
    ask = rows.filter("asks").select("a", "shingle", F.col("b").alias("b2"), F.col("size").alias("size2"), F.col("cb").alias("cb2"), F.col("differ").alias("differ2"), F.col("place").alias("place2"))
    answer = rows.filter("answers")
    after = F.least(F.col("differ") - F.col("place"), F.col("differ2") - F.col("place2")) + 1
    fits = F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent
    enough = 2 * after >= F.col("differ") + F.col("differ2") - r * (F.col("size") + F.col("size2")) - 1e-6
    pairs = answer.join(ask, ["a", "shingle"]).filter((F.col("cb") != F.col("cb2")) & (~F.col("out") | (F.col("b2") < F.col("b"))) & fits & enough)
    out = scratch.keep(pairs.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b")).distinct(), "pairs")
    scratch.drop("known", "differences", "first")
    return out


def minhash_dedup(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Links documents whose shingle sets have ``100 * intersection >= percent * union`` and returns their components.

    Words are runs of other characters than the six ASCII spaces, with A-Z lower-cased; a text of fewer words than a shingle
    is one shingle. Returns doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept (whether that is the
    document itself). Null, empty and blank texts have no shingles and stand alone. Rows that repeat a doc_id are the same
    document. Other columns are ignored. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = scratch.keep(docs.mapInArrow(lambda it: _sketched(it, shingle, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "sketches")
    classes = scratch.keep(sketches.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")), "classes")
    every = classes.select("doc_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowds = every.groupBy("bucket").agg(F.count("n").alias("members")).filter("members > 1")
    shared = scratch.keep(every.join(crowds, "bucket"), "shared")
    # a document whose bins are its neighbours' too is a likely centre of all of them
    score = shared.groupBy("doc_id").agg(F.sum("members").alias("score"))
    buckets = scratch.keep(shared.join(score, "doc_id").select("bucket", "doc_id", "n", "score"), "buckets")
    sets = scratch.keep(docs.join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, shingle), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]), "sets")
    centres = buckets.groupBy("bucket").agg(F.max(F.struct("score", -F.col("doc_id"), "n")).alias("x")).select("bucket", (-F.col("x.col2")).alias("a"), F.col("x.n").alias("n"))
    members = scratch.keep(buckets.select("bucket", F.col("doc_id").alias("b"), F.col("n").alias("m")).join(centres, "bucket").select("a", "b", "n", "m").distinct(), "members")
    scratch.drop("shared", "buckets")
    stars = members.filter((F.col("a") != F.col("b")) & (F.least("n", "m") * 100 >= F.greatest("n", "m") * percent))
    labels = components(scratch.keep(confirmed(stars, sets, percent), "stars"), scratch, "first")
    more = confirmed(differing(members, labels, sets, scratch, percent), sets, percent)
    # the links found last are between components
    label = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    more = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(scratch.keep(more, "more"), scratch, "last").select(F.col("node").alias("was"), F.col("component").alias("now"))
    scratch.drop("sets", "members", "stars", "pairs", "more")
    named = classes.select("k1", "k2", "n_shingles", F.col("doc_id").alias("node")).join(labels, "node", "left").withColumn("was", F.coalesce("component", "node")).join(joined, "was", "left")
    named = named.select("k1", "k2", "n_shingles", F.coalesce("now", "was").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
