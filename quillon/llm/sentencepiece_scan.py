"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

Encoding finds the segmentation of greatest total score over the vocabulary (the unigram model's Viterbi path). A chunk of
a giant document is summed up by a transfer matrix: entry (i, j) is the best score from i characters into the chunk, which
a piece of the chunk before covers, to j characters into the next. Matrices combine associatively in the max-plus
algebra, so prefixes come from a parallel scan; the states at all boundaries follow, and each chunk is traced back by
itself. Where no piece can span a place (before a word, around characters in no piece) the path must have a boundary, so
that a matrix is the sum of a vector for the chunk's head, one for its tail, and the words between, found once each.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch, batch, spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 32768
SPACE = "▁"
#: Stands for a space mark that the text itself has; no valid text has a lone surrogate.
OWN = "\ud800"
NONE = -1e30
#: Characters of the words whose scores or ids a worker keeps.
CACHED = 3_000_000
#: Characters of short texts that are encoded at once.
RUN = 1 << 17
#: Words up to this length are segmented together, longer ones one by one.
SHORT = 64
#: What a character in no piece costs more than the worst piece (fixed value of the model type).
UNKNOWN_COST = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol buffer's fields."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[i : i + n]
            i += n


class Vocabulary:
    """Pieces and scores of a model file, as bytes so that the driver can send them to the tasks."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.score: dict[str, tuple[float, int]] = {}
        self.byte = [0] * 256
        self.unknown, self.raw = 0, {}
        for number, value in _fields(model):
            if number != 1:
                continue
            f = dict(_fields(value))
            text, kind, k = f[1].decode(), f.get(3, 1), len(self.pieces)
            self.pieces.append(text)
            if kind == 6:
                self.byte[int(text[3:5], 16)] = k
                self.raw[k] = bytes([int(text[3:5], 16)])
            elif kind == 2:
                self.unknown = k
                self.raw[k] = "⁇".encode()
            elif kind == 3:
                self.raw[k] = b""
            else:
                self.score[text] = (struct.unpack("<f", f[2])[0] if 2 in f else 0.0, k)
                self.raw[k] = text.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.score), default=1)
        self.unknown_score = min((s for s, _ in self.score.values()), default=0.0) - UNKNOWN_COST
        #: Every prefix of a piece: (score, id), or None where it is no piece itself.
        self.prefix: dict[str, tuple[float, int] | None] = dict.fromkeys(p[:k] for p in self.score for k in range(1, len(p)))
        self.prefix |= self.score
        spanned = {c for p in self.score if len(p) > 1 for c in p}
        marks_inside = any(SPACE in p.lstrip(SPACE) for p in self.score)
        # where words begin, if no piece goes on past one; characters that are in no longer piece are words of their own
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in spanned)
        self.words = re.compile((f"[{alone}]|" if alone else "") + (f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if not marks_inside else f"[^{alone}]+"), re.S)
        #: Words' scores and words' ids, as far as they are kept, and the characters of both.
        self.kept: tuple[dict[str, float], dict[str, bytes]] = {}, {}
        self.held = 0
        self.trie: tuple | None = None

    def forward(self, s: str, start: int, end: int) -> tuple[list[float], list[int]]:
        """Best score from ``start`` to each place up to ``end``, and where its last piece begins. Pieces begin before
        ``end``; they may go on to the end of ``s``. Of equal scores the longest last piece wins."""
        best, via = [NONE] * (len(s) + 1), [-1] * (len(s) + 1)
        best[start] = 0.0
        known, n = self.prefix, len(s)
        for i in range(start, end):
            b = best[i]
            if b <= NONE:
                continue
            j = i + 1
            hit = known.get(s[i:j], 0)
            if not hit and b + self.unknown_score > best[j]:
                best[j], via[j] = b + self.unknown_score, i
            while hit != 0:
                if hit is not None and b + hit[0] > best[j]:
                    best[j], via[j] = b + hit[0], i
                j += 1
                if j > n:
                    break
                hit = known.get(s[i:j], 0)
        return best, via

    def ids(self, s: str, via: list[int], start: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > start:
            i = via[end]
            hit = self.score.get(s[i:end])
            out.append([hit[1]] if hit else [self.byte[x] for x in (SPACE if s[i] == OWN else s[i]).encode()] if any(self.byte) else [self.unknown])
            end = i
        return [x for part in reversed(out) for x in part]

    def word(self, w: str) -> tuple[float, bytes]:
        best, via = self.forward(w, 0, len(w))
        return best[len(w)], np.array(self.ids(w, via, 0, len(w)), np.int32).tobytes()

    def tables(self) -> tuple:
        """The trie of the pieces as arrays: a code point's letter (from 1; 0 is in no piece), a letter's node below the
        root, steps as sorted numbers node * letters + letter and where they lead, and each node's score and id (-1: no
        piece); node 0 is none."""
        if self.trie is None:
            names = sorted(self.prefix, key=len)
            node = {p: k for k, p in enumerate(names, 1)}
            letter = {c: k for k, c in enumerate(sorted({c for p in names for c in p}), 1)}
            letters = np.zeros(0x110000, np.int32)
            letters[[ord(c) for c in letter]] = list(letter.values())
            root = np.zeros(len(letter) + 1, np.int64)
            root[[letter[p] for p in names if len(p) == 1]] = [node[p] for p in names if len(p) == 1]
            longer = [p for p in names if len(p) > 1]
            steps = np.array([node[p[:-1]] * len(root) + letter[p[-1]] for p in longer], np.int64)
            leads = np.array([node[p] for p in longer], np.int64)
            order = np.argsort(steps)
            hits = [(0.0, -1), *(self.prefix[p] or (0.0, -1) for p in names)]
            self.trie = letters, root, np.append(steps[order], 1 << 62), np.append(leads[order], 0), np.array([s for s, _ in hits]), np.array([k for _, k in hits], np.int64)
        return self.trie

    def segment(self, words: list[str]) -> tuple[list[float], list[bytes]]:
        """Scores and ids of words as ``word`` finds them, for all at once: the trie is walked from every place together,
        then pieces that begin k characters into their word are weighed together, for each k in turn."""
        letters, root, steps, leads, scores, pieces = self.tables()
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends, n, m = np.cumsum(sizes), len(codes), len(words)
        # a word of k characters has k + 1 places, and a character comes after the place of its index plus its word's
        depth = np.arange(n) - np.repeat(ends - sizes, sizes)
        left, place = np.repeat(sizes, sizes) - depth, np.arange(n) + np.repeat(np.arange(m), sizes)
        letter = letters[codes]
        at, node = np.arange(n), root[letter]
        unknown = pieces[node] < 0
        found = [(at, np.where(unknown, self.unknown_score, scores[node]), pieces[node])]
        while True:
            size = len(found) + 1
            go = np.flatnonzero((node > 0) & (left[at] >= size))
            if not len(go):
                break
            at = at[go]
            step = node[go] * len(root) + letter[at + size - 1]
            to = np.searchsorted(steps, step)
            go = np.flatnonzero(steps[to] == step)
            at, node = at[go], leads[to[go]]
            hit = np.flatnonzero(pieces[node] >= 0)
            found.append((at[hit], scores[node[hit]], pieces[node[hit]]))
        start, score, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        size = np.repeat(np.arange(1, len(found) + 1), [len(x[0]) for x in found])
        begun = depth[start].astype(np.uint16)
        order = np.argsort(begun, kind="stable")
        bounds = np.cumsum(np.bincount(begun))
        origin, score, piece, size = place[start[order]], score[order], piece[order], size[order]
        best, via = np.full(n + m, NONE), np.zeros(n + m, np.int64)
        first, last = ends - sizes + np.arange(m), ends + np.arange(m)
        best[first] = 0.0
        for i, j in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True):
            to = origin[i:j] + size[i:j]
            total = best[origin[i:j]] + score[i:j]
            better = np.flatnonzero(total > best[to])  # pieces from one place end at different ones
            best[to[better]], via[to[better]] = total[better], better + i
        begins, on = np.zeros(n + m, bool), np.zeros(n + m, bool)
        begins[first] = True
        back = last
        while len(back):
            on[back] = True
            back = origin[via[back]]
            back = back[~begins[back]]
        path = np.flatnonzero(on)
        ids, counts = piece[via[path]], np.ones(len(path), np.int64)
        # a character in no piece is given as its bytes, if the vocabulary has those
        bare = np.flatnonzero(ids < 0)
        ids[bare] = self.unknown
        word = np.searchsorted(last, path)
        if len(bare) and any(self.byte):
            lone = codes[path[bare] - word[bare] - 1]
            lone = np.where(lone == ord(OWN), ord(SPACE), lone).astype(np.uint32)
            counts[bare] = 1 + (lone > 0x7F) + (lone > 0x7FF) + (lone > 0xFFFF)
            inside = np.zeros(len(path), bool)
            inside[bare] = True
            ids = np.repeat(ids, counts)
            ids[np.repeat(inside, counts)] = np.array(self.byte)[np.frombuffer(lone.tobytes().decode("utf-32-le").encode(), np.uint8)]
        raw = ids.astype(np.int32).tobytes()
        cuts = (4 * np.cumsum(np.bincount(word, counts, m))).astype(np.int64).tolist()
        return best[last].tolist(), [raw[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]

    def known(self, words: list[str], what: int) -> list:
        """Each word's score (``what`` 0) or ids (1)."""
        kept = self.kept[what]
        new = set(words).difference(kept)
        if new:
            if self.held + sum(map(len, new)) > CACHED:
                for x in self.kept:
                    x.clear()
                self.held, new = 0, set(words)
            self.held += sum(map(len, new))
            together = [w for w in new if len(w) <= SHORT]
            if together:
                kept.update(zip(together, self.segment(together)[what], strict=True))
            if len(together) < len(new):
                kept.update((w, self.word(w)[what]) for w in new if len(w) > SHORT)
        return list(map(kept.__getitem__, words))

    def encode(self, s: str) -> bytes:
        """Ids (32 bits each) of a prepared text that begins and ends on a boundary."""
        return b"".join(self.known(self.words.findall(s), 1))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text."""
        words, cuts = [], [0]
        for s in texts:
            words += self.words.findall(s)
            cuts.append(len(words))
        ids = self.known(words, 1)
        return [b"".join(ids[i:j]) for i, j in zip(cuts, cuts[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the mark that encoding puts first goes."""
        raw = self.raw
        out = b"".join([raw[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    def cuts(self, s: str, end: int) -> tuple[int, int]:
        """The first and the last forced boundary within (0, end], or (-1, -1)."""
        found = [m.start() for m in self.words.finditer(s) if 0 < m.start() <= end]
        return (found[0], found[-1]) if found else (-1, -1)

    def transfer(self, body: str, ahead: str) -> np.ndarray:
        """The chunk's matrix; entries of states that no path has are NONE. ``ahead``: the characters after the chunk."""
        n, size, s = len(body), self.longest, body + ahead
        out = np.full((size, size), NONE)
        first, last = self.cuts(s, n)
        tail, _ = self.forward(s, max(last, 0), n)
        exits = np.array([tail[n + j] if n + j <= len(s) else NONE for j in range(size)])
        if first >= 0:
            middle = sum(self.known(self.words.findall(s[first:last]), 0))
            exits = np.where(exits > NONE, exits + middle, NONE)
            for i in range(min(size, first + 1)):
                head = self.forward(s[:first], i, first)[0][first]
                out[i] = np.where((exits > NONE) & (head > NONE), exits + head, NONE)
        else:
            for i in range(min(size, n)):
                tail, _ = self.forward(s, i, n)
                out[i] = [tail[n + j] if n + j <= len(s) else NONE for j in range(size)]
            if n < size:  # a piece that covers the whole chunk passes through
                for i in range(n, size):
                    out[i, i - n] = 0.0
        return out

    def trace(self, body: str, ahead: str, enter: int, leave: int) -> bytes:
        """The chunk's ids between two boundary states."""
        s, end = body + ahead, len(body) + leave
        if enter >= end:
            return b""
        first, last = self.cuts(s, len(body))
        if first < enter:
            _, via = self.forward(s, enter, len(body))
            return np.array(self.ids(s, via, enter, end), np.int32).tobytes()
        _, head = self.forward(s[:first], enter, first)
        _, tail = self.forward(s, last, len(body))
        return np.array(self.ids(s, head, enter, first), np.int32).tobytes() + self.encode(s[first:last]) + np.array(self.ids(s, tail, last, end), np.int32).tobytes()


_KEPT: dict[str, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The worker's vocabulary of a model, with the words that it has met in earlier tasks."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Vocabulary(model)
    return _KEPT[name]


def prepared(text: str | None) -> str:
    return (SPACE + text.replace(SPACE, OWN).replace(" ", SPACE)) if text else ""


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of stacks of matrices."""
    return np.maximum((a[..., :, :, None] + b[..., None, :, :]).max(-2), NONE)


def boundary_states(matrices: np.ndarray) -> list[int]:
    """The state at each boundary, from 0 before the first chunk to 0 after the last, by a scan over prefix products."""
    prefix, step = matrices.copy(), 1
    while step < len(prefix):
        for i in range(len(prefix) - 1, step - 1, -256):  # from the back, so that what is read is not yet changed
            at = np.arange(max(step, i - 255), i + 1)
            prefix[at] = combined(prefix[at - step], prefix[at])
        step *= 2
    states = [0]
    for k in range(len(matrices) - 1, 0, -1):
        states.append(int(np.argmax(prefix[k - 1][0] + matrices[k][:, states[-1]])))
    return [0, *states[::-1]]


_IDS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("key", pa.int64()), ("copy", pa.int64()), ("chunk", pa.int64()), ("ids", pa.binary()), ("enter", pa.int64()), ("past", pa.string())])
_CHUNKS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("chunk", pa.int64()), ("body", pa.string()), ("ahead", pa.string())])


def _chunked(batches, size: int, ahead: int):
    for b in batches:
        for doc_id, text, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out: list[list] = [[] for _ in _CHUNKS]
            at = list(range(0, len(text), size))
            for k, i in enumerate(at):
                for c, v in zip(out, (doc_id, key, k, text[i : i + size], text[i + size : i + size + ahead] + (" " if i + size >= len(text) else "")), strict=True):
                    c.append(v)
            yield batch(_CHUNKS, *out)


def _ready(chunk: int, body: str, ahead: str) -> tuple[str, str]:
    """A chunk as the vocabulary sees it. The blank that ends a document's last ``ahead`` is no part of it."""
    return prepared(body)[chunk > 0 :], prepared(ahead[:-1] if ahead.endswith(" ") and len(ahead) == 1 else ahead)[1:]


def encode(docs: DataFrame, model: str = MODEL, *, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, key, copy, chunk, ids, enter, past) with ids as 32-bit little-endian integers, for rows of ``docs``.

    Texts up to ``chunk`` characters are one row with their text; longer ones are a row for each chunk of as many
    characters; only the task that cuts it holds such a text whole. The chunks of one document are told from those of another of the same id
    by a hash of the text (``key``). Equal rows of giant documents are encoded once and returned as often as they occur,
    told apart by ``copy`` (from 1; 1 for all short texts, of which each row is one of its own). A chunk's ids begin after
    ``enter`` characters, which the chunk before covers, and end with ``past``, the first characters of the next. Null and
    empty texts have no ids. The vocabulary's scores are those of ``model``, a file that the driver reads. Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        data = f.read()
    shared = spark.sparkContext.broadcast(data)  # as large as the model file, whatever the input
    longest = Vocabulary(data).longest
    scratch = Scratch(spark, "sentencepiece")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.length("text") > chunk

    def small(batches):
        v = vocabulary(shared.value)
        for b in batches:
            out: list[list] = [[] for _ in _IDS]
            n = 0
            texts = b.column(1).to_pylist()
            for i, j in spans(np.array([len(x or "") for x in texts]), RUN):
                for doc_id, text, ids in zip(b.column(0)[i:j].to_pylist(), texts[i:j], v.encode_all([prepared(x) for x in texts[i:j]]), strict=True):
                    for c, x in zip(out, (doc_id, text, 0, 1, 0, ids, 0, ""), strict=True):
                        c.append(x)
                    n += len(ids)
                if n > 1 << 22:
                    yield batch(_IDS, *out)
                    out, n = [[] for _ in _IDS], 0
            yield batch(_IDS, *out)

    def transfers(batches):
        v = vocabulary(shared.value)
        for b in batches:
            for doc_id, key, k, body, ahead in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield batch(pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("chunk", pa.int64()), ("matrix", pa.binary())]), [doc_id], [key], [k], [v.transfer(*_ready(k, body, ahead)).astype(np.float64).tobytes()])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ignore_index=True)
        found = boundary_states(np.stack([np.frombuffer(x, np.float64).reshape(longest, longest) for x in pdf["matrix"]]))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "key": pdf["key"], "chunk": pdf["chunk"], "enter": found[:-1], "leave": found[1:]})

    def traced(batches):
        v = vocabulary(shared.value)
        for b in batches:
            for doc_id, key, copies, k, body, ahead, enter, leave in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield batch(_IDS, [doc_id], [body], [key], [copies], [k], [v.trace(*_ready(k, body, ahead), enter, leave)], [enter], [ahead[:leave]])

    schema = "doc_id long, text string, key long, copy long, chunk long, ids binary, enter long, past string"
    chunks = docs.filter(long_).select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(lambda it: _chunked(it, chunk, longest - 1), "doc_id long, key long, chunk long, body string, ahead string")
    chunks = scratch.keep(chunks.groupBy("doc_id", "key", "chunk").agg(F.first("body").alias("body"), F.first("ahead").alias("ahead"), F.count(F.lit(1)).alias("copies")), "chunks")
    matrices = chunks.select("doc_id", "key", "chunk", "body", "ahead").mapInArrow(transfers, "doc_id long, key long, chunk long, matrix binary")
    found = scratch.keep(matrices.groupBy("doc_id", "key").applyInPandas(states, "doc_id long, key long, chunk long, enter long, leave long"), "states")
    giant = chunks.join(found, ["doc_id", "key", "chunk"]).select("doc_id", "key", "copies", "chunk", "body", "ahead", "enter", "leave").mapInArrow(traced, schema)
    giant = giant.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copy")))  # traced once, given as often as it occurs
    return docs.filter(~long_ | F.col("text").isNull()).mapInArrow(small, schema).unionByName(giant)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, key, copy, chunk, decoded) of rows of ``encode``: a document's chunks, in order, make up its text. A piece that spans
    two chunks is in the one that it begins in, so that chunks may differ from the encoded ones by some characters."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("copy", pa.int64()), ("chunk", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        v = vocabulary(shared.value)
        for b in batches:
            out = []
            for k, ids in zip(b.column(3).to_pylist(), b.column(4), strict=True):
                text = v.decode(np.frombuffer(ids.as_buffer() or b"", np.int32)) if k == 0 else v.decode(np.append(v.score[SPACE][1], np.frombuffer(ids.as_buffer() or b"", np.int32)))
                out.append(text)
            yield batch(schema, b.column(0), b.column(1), b.column(2), b.column(3), out)

    return encoded.select("doc_id", "key", "copy", "chunk", "ids").mapInArrow(run, "doc_id long, key long, copy long, chunk long, decoded string")


def summary(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """One row for each row that was encoded: doc_id, n_chars, n_tokens, ids_sha256 (over the digests of its chunks), and
    exact: whether decoding gives back the encoded text, of which every character is compared in the chunk that covers it."""
    with open(model, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("copy", pa.int64()), ("chunk", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha", pa.string()), ("enter", pa.int64()), ("leave", pa.int64()), ("exact", pa.bool_())])

    def run(batches):
        v = vocabulary(shared.value)
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, text, key, copy, k, enter, past, ids in zip(*(b.column(c).to_pylist() for c in range(7)), b.column(7), strict=True):
                raw = ids.as_buffer().to_pybytes()
                own = np.frombuffer(raw, np.int32)
                text = text or ""
                back = v.decode(own if k == 0 else np.append(v.score[SPACE][1], own))
                exact = back == text[enter:] + past
                for c, x in zip(out, (doc_id, key, copy, k, len(text), len(own), hashlib.sha256(raw).hexdigest(), enter, len(past), exact), strict=True):
                    c.append(x)
            yield batch(schema, *out)

    rows = encoded.select("doc_id", "text", "key", "copy", "chunk", "enter", "past", "ids").mapInArrow(run, "doc_id long, key long, copy long, chunk long, n_chars long, n_tokens long, ids_sha string, enter long, leave long, exact boolean")
    rows = Scratch(encoded.sparkSession, "sentencepiece-summary").keep(rows, "rows")  # both sides below read it: digests, no texts
    one = rows.filter("key = 0").select("doc_id", "n_chars", "n_tokens", F.col("ids_sha").alias("ids_sha256"), "exact")
    # each chunk begins where the one before ends, the first at 0, and the last goes on to nowhere
    order = F.sort_array(F.collect_list(F.struct("chunk", "enter", "leave")))
    met = F.concat(F.array(F.lit(0).cast("long")), order.getField("leave")) == F.concat(order.getField("enter"), F.array(F.lit(0).cast("long")))
    many = rows.filter("key <> 0").groupBy("doc_id", "key", "copy").agg(F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids_sha"))), lambda x: x.ids_sha), "").alias("all"), (F.min("exact") & met).alias("exact"))
    return one.unionByName(many.select("doc_id", "n_chars", "n_tokens", F.sha2("all", 256).alias("ids_sha256"), "exact"))
