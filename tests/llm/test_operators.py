"""Operators against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import fingerprints, langid, licenses, minhash, mixing, ogg, quality, rlz, sentencepiece_scan, suffix_array

random.seed(5)
VOCABULARY = ["".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(400)]
PROSE = [" ".join(random.choices(VOCABULARY, k=k)) for k in (30, 60, 120, 400, 90, 55)]
EDGES = [
    (100, None, "en", "a"),
    (101, "", "en", None),
    (102, " \n\t", None, "b"),
    (103, "x" * 3000, "en", "b"),
    (104, "x y " * 300, "de", "null"),
    (105, "y x " * 200, "de", "b"),
    (106, "é" * 400 + "日本", "fr", "a"),
    (107, "one two three", "en", "a"),
    (108, "ONE two\tthree", "en", "a"),
    (109, "▁ odd\0 bytes", None, "c"),
]


@pytest.fixture(scope="module")
def rows():
    out = [(k, t, "en", "s") for k, t in enumerate(PROSE)]
    out += [(10 + k, PROSE[k % 6][: 50 * k] + PROSE[(k + 1) % 6][30:500] + PROSE[3], "en", "s") for k in range(5)]
    words = PROSE[2].split()
    for k in range(12):  # near copies of one text
        w = words[:]
        for _ in range(k % 4):
            w[random.randrange(len(w))] = f"z{random.randrange(6)}"
        out.append((30 + k, " ".join(w), "en", "s"))
    return out + EDGES


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("anchor", F.lit("clash")).withColumn("score", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *cols):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *cols).collect()}


def texts(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("kw", [{}, {"hot": 1}, {"shard_bytes": 5000}])
def test_suffix_dedup(docs, rows, kw):
    got = by_id(suffix_array.suffix_dedup(docs, digest=True, **kw), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.suffix_dedup(texts(rows))


def test_suffix_array():
    rng = np.random.default_rng(1)
    for t in range(80):
        s = np.append(rng.integers(1, 2 + t % 5, rng.integers(1, 200)), 0)
        sa = suffix_array.suffix_array(s, 7)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("kw", [{}, {"hot": 1}])
def test_substring_dedup(docs, rows, kw):
    assert by_id(rlz.substring_dedup(docs, digest=True, **kw), "n_words", "n_removed", "kept_sha256") == brute.substring_dedup(texts(rows))


@pytest.mark.parametrize("size", [4, 5])
def test_minhash(docs, rows, size):
    assert by_id(minhash.minhash_dedup(docs, shingle=size), "n_shingles", "component_id", "kept") == brute.near_dedup(texts(rows), size)


def test_repeated_rows(docs):
    twice = docs.union(docs)
    for run, cols in ((suffix_array.suffix_dedup, ["n_removed"]), (rlz.substring_dedup, ["n_removed"]), (minhash.minhash_dedup, ["component_id"])):
        got = run(twice).select("doc_id", *cols).collect()
        assert len(got) == 2 * docs.count() and {tuple(r) for r in got} == {tuple(r) for r in run(docs).select("doc_id", *cols).collect()}


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    outs = [suffix_array.suffix_dedup(empty), rlz.substring_dedup(empty), minhash.minhash_dedup(empty), quality.quality_scores(empty, labels), fingerprints.fingerprints(empty), sentencepiece_scan.summary(sentencepiece_scan.encode(empty)), langid.predict_language(empty, langid.learn(empty)), ogg.describe(ogg.store(empty)), mixing.mix(empty, F.array("source"))[0], licenses.scan_licenses(empty)]
    assert [df.count() for df in outs] == [0] * 10


def test_quality(spark, docs):
    good = [(1000 + k, " ".join(random.choices(VOCABULARY, k=40))) for k in range(60)]
    bad = [(2000 + k, "!!! ".join(random.choices(VOCABULARY, k=40)).upper()) for k in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, _ in good + bad if i % 3] + [(1, None)], "doc_id long, quality int")
    got = by_id(quality.quality_scores(df, labels), "score")
    assert all((s[0] >= 0.5) == (i < 2000) for i, s in got.items())
    assert all(0 <= s[0] <= 1 for s in by_id(quality.quality_scores(docs, labels), "score").values())
    assert set(by_id(quality.quality_scores(df, labels.limit(0)), "score").values()) == {(0.5,)}


def test_fingerprints(docs, rows):
    got = by_id(fingerprints.fingerprints(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next", "distinct_shingles")
    order = sorted(texts(rows))
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i][:2] == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := brute.WORD.findall(x)) else set() for x in (t, edited, nxt)]
        for near, other in ((got[i][3], sets[1]), (got[i][4], sets[2])):
            true = len(sets[0] & other) / len(sets[0] | other) if sets[0] | other else 1.0
            assert abs(near - true) <= (0.17 if len(sets[0] | other) > 128 else 1e-9)
        if len(sets[0]) < 128:
            assert got[i][5] == len(sets[0])


def test_sketches_merge(spark):
    df = spark.createDataFrame([("k", PROSE[3][:900]), ("k", PROSE[3][900:]), ("j", PROSE[0])], "key string, text string")
    parts = df.select("key", fingerprints.sketch(F.col("text")).alias("s"))
    merged = {r.key: r.s for r in fingerprints.merge_by(parts, ["key"], "s").collect()}
    own = [r.s for r in parts.filter("key = 'k'").collect()]
    assert merged["k"] == sorted(set(own[0]) | set(own[1]))[: fingerprints.K]
    pair = spark.createDataFrame([(own[0], merged["k"])], "a array<long>, b array<long>")
    assert pair.select(fingerprints.containment(F.col("a"), F.col("b"))).first()[0] > 0.9


def test_sentencepiece(docs, rows):
    for chunk in (64, 100_000):
        enc = sentencepiece_scan.encode(docs, chunk=chunk)
        got = sentencepiece_scan.summary(enc).collect()
        assert len(got) == len(rows) and all(r.exact for r in got)
        v = sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read())
        pieces = {}
        for r in sorted(enc.collect(), key=lambda r: (r.doc_id, r.chunk)):
            pieces[r.doc_id] = pieces.get(r.doc_id, b"") + r.ids
        score = lambda ids: sum(v.score[p][0] for k in ids if (p := v.pieces[k]) in v.score)
        for i, t in texts(rows):
            ids, whole = (np.frombuffer(x, np.int32) for x in (pieces[i], v.encode(sentencepiece_scan.prepared(t))))
            assert v.decode(ids) == (t or "") and score(ids) == score(whole)


def test_sentencepiece_repeated_rows(docs):
    """A row that occurs twice is encoded twice, at any length."""
    for chunk in (64, 100_000):
        once, twice = (sorted(tuple(r) for r in sentencepiece_scan.summary(sentencepiece_scan.encode(d, chunk=chunk)).collect()) for d in (docs, docs.union(docs)))
        assert twice == sorted(once + once)


def test_sentencepiece_exact_sees_every_character(spark):
    """One wrong piece of the right length, first or last in a chunk, is not exact."""
    docs = spark.createDataFrame([(1, PROSE[3])], "doc_id long, text string")
    enc = sentencepiece_scan.encode(docs, chunk=64)
    rows, v = enc.collect(), sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read())
    assert len(rows) > 5
    for at in (0, -1):
        changed = []
        for r in rows:
            ids = np.frombuffer(r.ids, np.int32).copy()
            if r.chunk == 2:  # another piece of as many characters
                piece = v.pieces[ids[at]]
                ids[at] = next(k for p, (_, k) in v.score.items() if len(p) == len(piece) and p != piece and (p[0] == sentencepiece_scan.SPACE) == (piece[0] == sentencepiece_scan.SPACE))
            changed.append((*(ids.tobytes() if n == "ids" else r[n] for n in enc.columns),))
        assert not sentencepiece_scan.summary(spark.createDataFrame(changed, enc.schema)).first().exact


def test_sentencepiece_against_library():
    """The library segments alike once its model says that it is a unigram model."""
    import sentencepiece

    data = open(sentencepiece_scan.MODEL, "rb").read()
    old = next(x for n, x in sentencepiece_scan._fields(data) if n == 2)
    assert b"\x18\x02" in old
    new = old.replace(b"\x18\x02", b"\x18\x01", 1)
    library = sentencepiece.SentencePieceProcessor(model_proto=data.replace(old, new, 1))
    v = sentencepiece_scan.Vocabulary(data)
    for t in [*PROSE, "The quick brown fox.", "a\nb\tc", "Éric à la  plage", "日本語"]:
        t = t[:300]
        assert np.frombuffer(v.encode(sentencepiece_scan.prepared(t)), np.int32).tolist() == library.encode(t)


def test_sentencepiece_words_together():
    """Words segmented together have the scores and ids of each by itself."""
    v, rng = sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read()), random.Random(3)
    odd = "abc▁\ud800 \n\t日本語é😀𝔘xyz中\x00漢🤖нет"
    odd = list({"".join(rng.choices(odd, k=rng.randint(1, 80))) for _ in range(1000)} | {"▁" * 70, "a" * 200})
    alone = [v.word(w) for w in odd]
    assert [*map(list, zip(*alone, strict=True))] == [*v.segment(odd)] == [v.known(odd, 0), v.known(odd, 1)]


def test_sentencepiece_unseen_words_cost():
    """Words that no text had before take less CPU time than one by one, for the same ids."""
    v, rng = sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read()), random.Random(3)
    words = list({"▁" + "".join(rng.choices("abcdefghilmnoprstuvéß", k=rng.randint(4, 14))) for _ in range(30_000)})
    v.encode("".join(w[::-1] for w in words[:10_000]))  # builds the tables
    at = [time.process_time()]
    got = v.encode("".join(words))
    at.append(time.process_time())
    alone = b"".join(np.array(v.ids(w, v.forward(w, 0, len(w))[1], 0, len(w)), np.int32).tobytes() for w in words)
    at.append(time.process_time())
    assert got == alone and at[1] - at[0] < 0.75 * (at[2] - at[1])


def test_sentencepiece_kept_words(monkeypatch):
    """Ids don't depend on which words a worker still keeps, of which there are never more characters than the bound."""
    v, rng = sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read()), random.Random(4)
    texts = [sentencepiece_scan.prepared(" ".join("".join(rng.choices("abeinorst", k=rng.randint(1, 6))) for _ in range(60))) for _ in range(40)]
    whole = v.encode_all([*texts, "", texts[0]])
    monkeypatch.setattr(sentencepiece_scan, "CACHED", 700)
    v = sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read())
    for t, ids in zip(texts, whole, strict=False):
        assert v.encode(t) == ids and sum(len(w) for x in v.kept for w in x) == v.held <= 700
    assert whole[-2:] == [b"", whole[0]]


def test_language(docs, spark):
    one = [(k, " ".join(random.choices(["the", "thing", "other", "then"], k=30)), "en") for k in range(40)]
    two = [(100 + k, " ".join(random.choices(["über", "schön", "straße"], k=30)), "de") for k in range(40)]
    df = spark.createDataFrame(one + two, "doc_id long, text string, lang string")
    model = langid.learn(df.filter("doc_id % 2 = 0"))
    got = by_id(langid.predict_language(df, model), "lang_pred", "score")
    assert all(got[i][0] == lang for i, _, lang in one + two)
    edges = by_id(langid.predict_language(docs, model), "lang_pred", "score")
    assert [edges[i][0] for i in (100, 101, 102)] == ["und"] * 3 and all(0 <= s <= 1 for _, s in edges.values())


def test_ogg(docs, rows):
    got = by_id(ogg.describe(ogg.store(docs)), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "feature")
    for i, t in texts(rows):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[i][:4] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_ogg_damage():
    media = ogg.write(bytes(range(256)) * 9 * 64)
    assert b"".join(ogg.read(media)[ogg.SAMPLES].packets[1:]) == bytes(range(256)) * 9 * 64
    slow = 0
    for c in media[:22] + b"\0\0\0\0" + media[26 : 28 + media[27]]:
        slow ^= c << 24
        for _ in range(8):
            slow = (slow << 1 ^ (0x04C11DB7 if slow >> 31 else 0)) & 0xFFFFFFFF
    assert slow == int.from_bytes(media[22:26], "little")
    for at in (0, 30, 2000, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ValueError):
        ogg.read(media[:-60])


def test_targets():
    t = mixing.targets({"a": 10, "b": 100, "c": 100, None: 90})
    assert t["a"] == 20 and t[None] <= 180 and abs(sum(t.values()) - 450) < 1e-6 and all(t[s] <= 2 * n + 1e-9 for s, n in {"a": 10, "b": 100, "c": 100, None: 90}.items())


def test_flow():
    """Overlap fills the scarce source before anything repeats."""
    given = mixing.flow({"a": 100, "b": 100, "ab": 100}, {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}, {"a": 180, "b": 90})
    assert abs(given["a"]["a"] - 100) < 1e-6 and abs(given["ab"]["a"] - 80) < 1e-6
    over = mixing.flow({"a": 100}, {"a": ["a"]}, {"a": 500})
    assert over["a"]["a"] == 200


def test_mix(docs, rows):
    taken, quota, sizes = mixing.mix(docs, F.array("source"), extra=("source",))
    got = taken.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    want = {}
    for r in got:
        assert r.size == len(brute.WORD.findall(dict(texts(rows))[r.doc_id] or "")) and 0 <= r.taken <= 2 * r.size
        want[r.source] = want.get(r.source, 0) + r.taken
    assert all(abs(want[s] - quota[s]) <= 1 for s in quota)


def test_licenses(spark):
    rows = [(k, f"{PROSE[k % 6]} {t} {PROSE[(k + 1) % 6]}") for k, t in enumerate(licenses.TEMPLATES.values())]
    rows += [(50, None), (51, ""), (52, "Released under"), (53, PROSE[3]), (54, licenses.TEMPLATES["BSD-grant"].replace("binary", "other"))]
    got = {(r.doc_id, r.license): r.shared for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = {(i, n): len(s & shingles(t)) for i, t in rows for n, body in licenses.TEMPLATES.items() if (s := shingles(body)) and 5 * len(s & shingles(t)) >= 4 * len(s)}
    assert got == want


def test_short_licenses_are_never_missed(spark):
    """Templates of one to four shingles amid full windows of other words."""
    rng = random.Random(3)
    body = {f"t{k}": " ".join(f"w{rng.randrange(10**9)}" for _ in range(5 + k % 4)) for k in range(240)}
    words = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    rows = [(k, f"{words(20 + k % 5)} {t} {words(20)}") for k, t in enumerate(body.values())]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), body).collect()
    assert sorted((r.doc_id, r.license, r.containment) for r in got) == sorted((k, n, 1.0) for k, n in enumerate(body))


def test_license_bands_are_min_wise(spark):
    """Nearly every shingle of a window of five is the least under some permutation."""
    h = spark.range(2000).select(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.xxhash64("id", k)).alias("h"))
    own = h.select(F.explode("h").alias("one"), licenses.let(F.col("h"), lambda x: licenses.window_bands(x, 5)).alias("all"))
    alone = licenses.let(F.array("one"), lambda x: licenses.window_bands(x, 5))
    missed = own.filter(F.size(F.array_intersect(alone, "all")) == 0).count() / 10_000
    assert missed < 0.003  # 0.8 ** 32 = 0.0008


def test_suffix_array_recurses_on_text(spark, sf):
    """On 500 KB of text the induced sorting goes on by itself, level after level, until all names differ."""
    raw = "\0".join(r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()).encode()[:500_000] + b"\0"
    present, codes = np.unique(np.frombuffer(raw, np.uint8), return_inverse=True)
    s = codes + 1
    s[-1] = 0
    levels, whole = [], suffix_array.suffix_array

    def counted(s, sigma):
        levels.append(len(s))
        return whole(s, sigma)

    suffix_array.suffix_array = counted
    try:
        sa = counted(s, len(present) + 1)
    finally:
        suffix_array.suffix_array = whole
    assert len(levels) >= 4 and all(b <= a / 2 for a, b in zip(levels, levels[1:], strict=False))
    assert np.array_equal(np.sort(sa), np.arange(len(s)))
    text = s.astype(np.uint8).tobytes()
    for k in range(0, len(sa) - 1, 97):
        assert text[sa[k] : sa[k] + 3000] <= text[sa[k + 1] : sa[k + 1] + 3000]


def test_factors_are_the_longest():
    """Against comparing each place with every place of earlier documents."""
    rng = random.Random(2)
    for t in range(30):
        texts = [b" ".join(rng.choices([b"a", b"b", b"c"][: 2 + t % 2], k=rng.randint(1, 30))) for _ in range(12)]
        docs = np.sort(np.array([rng.randrange(6) for _ in texts]))
        words_ = [x.split() for x in texts]
        counts = np.array([max(0, len(w) - 4) for w in words_])
        piece, place = rlz.factored(texts, counts, docs, 5)
        held = lambda j: {tuple(w[i : i + 5]) for k, w in enumerate(words_) if docs[k] < docs[j] for i in range(len(w) - 4)}
        want = [(j, i) for j, w in enumerate(words_) for i in range(len(w) - 4) if tuple(w[i : i + 5]) in held(j)]
        assert list(zip(piece.tolist(), place.tolist(), strict=True)) == want


def test_candidates_grow_with_the_members(spark, monkeypatch):
    """Near copies of one text, some linked with it and some not: candidates grow no faster than the group, and the result
    is that of brute force."""
    rng, seen = random.Random(4), {}
    keep = minhash.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(minhash.Scratch, "keep", counted)
    base = [f"w{k}" for k in rng.choices(range(300), k=140)]
    made = []
    for size in (150, 600):
        rows = []
        for i in range(size):
            w = base[:]
            for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
            rows.append((i, " ".join(w)))
        got = by_id(minhash.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4), "n_shingles", "component_id", "kept")
        assert got == brute.near_dedup(rows, 4)
        assert len({c for _, c, _ in got.values()}) > size // 10  # many are not linked
        made.append((seen["members"], seen["first"], seen["pairs"]))
    assert all(b <= 6 * a + 50 for a, b in zip(*made, strict=True)), made
    assert made[1][2] <= 4 * 600, made


def test_fingerprints_of_repeated_and_null_ids(spark):
    """Rows of one id follow each other by text, rows without an id come last."""
    rows = [(5, "five five"), (None, "nothing b"), (3, "b text of three"), (3, "a text of three"), (None, "nothing a"), (10**13, "far away")]
    got = {(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = set()
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        want.add((i, len(t), hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()))
    assert got == want


def test_language_against_loops(spark):
    """Profiles, prototypes and cosines by plain loops over letters; ties go to the language that sorts first."""
    texts_ = [(k, " ".join(random.choices(["the", "then", "Übung", "ab1c"][k % 2 :], k=6)), "ba"[k % 2]) for k in range(8)] + [(90, "?? 12", "a"), (91, "", "b")]
    vectors = {}

    def vector(c):
        if c not in vectors:
            vectors[c] = langid.letter_vectors(np.array([c], np.int64))[0].astype(int)
        return vectors[c]

    def bundle(text):
        out, runs = np.zeros(langid.DIM, int), [0]
        for c in text.lower():
            if c.isalpha():
                runs.append(ord(c))
            elif runs[-1]:
                runs.append(0)
        runs += [0] if runs[-1] else []
        for a, b, c in zip(runs, runs[1:], runs[2:], strict=False):
            if b:
                out += vector(a) * np.roll(vector(b), 1) * np.roll(vector(c), 2)
        return out

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    prototypes = {}
    for _, t, lang in texts_:
        prototypes[lang] = prototypes.get(lang, 0) + unit(bundle(t))
    df = spark.createDataFrame(texts_, "doc_id long, text string, lang string")
    got = by_id(langid.predict_language(df, langid.learn(df)), "lang_pred", "score")
    for i, t, _ in texts_:
        own = unit(bundle(t))
        near = {lang: float(own @ unit(p)) for lang, p in prototypes.items()}
        best = min(near, key=lambda x: (-round(near[x], 5), x))
        assert got[i][0] == (best if own.any() else "und")
        assert abs(got[i][1] - (max(0.0, near[best]) if own.any() else 0.0)) < 1e-4
    same = df.filter("doc_id < 8").select("doc_id", "text", F.explode(F.array(F.lit("y"), F.lit("x"))).alias("lang"))
    assert {x for x, in by_id(langid.predict_language(same, langid.learn(same)), "lang_pred").values()} == {"x"}


def test_quality_scores_against_loops(spark):
    """The score of a document is the softmax of the mean of its words' and n-grams' learned vectors."""
    raw = ["good words here", "BAD!! BAD!!", "x", ""]
    labels_ = [1, 0, 1, 0]
    weights, bias = quality.train(raw, labels_)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(raw)] * 2, "doc_id long, text string")
    got = quality.quality_scores(df, spark.createDataFrame(list(enumerate(labels_)) , "doc_id long, quality int")).collect()
    assert len(got) == 8
    two = {r.doc_id: r.score for r in got}
    weights, bias = quality.train([t for t in raw for _ in range(2)], [x for x in labels_ for _ in range(2)])
    for k, t in enumerate(raw):
        ids = []
        data = np.frombuffer(t.encode(), np.uint8)
        for w in t.split():
            at = t.index(w)
            b, e = np.array([at]), np.array([at + len(w)])
            ids.append(int(quality.word_hashes(data, b, e)[0] >> np.uint64(48)))
        for n in quality.GRAMS:
            for i in range(len(data) - n + 1):
                ids.append(int(quality.mixed(quality.grams(quality.BYTE[data[i : i + n]], n))[0] >> np.uint64(48)) + quality.BUCKETS)
        z = sum(float(weights[i]) for i in ids) / max(len(ids), 1) + bias
        assert abs(two[k] - 1 / (1 + np.exp(-z))) < 1e-5


def test_held_out_accuracy_on_documents(spark, sf):
    """Learned without the rows that are held out, both classifiers are right on nearly all of these."""
    from quillon.llm import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.op7_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    assert lang.filter("lang_pred = lang").count() >= 0.97 * lang.count() > 20
    quality_ = queries.op3_quality_classifier(spark, sf).join(labels, "doc_id").filter("held_out and quality is not null")
    assert quality_.filter("predicted = quality").count() >= 0.8 * quality_.count() > 5
