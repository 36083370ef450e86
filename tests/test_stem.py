"""English stems, and searches by them against brute force."""

import math
import random
import re
import tracemalloc
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest

from quillon.functions import stem as stemming
from quillon.functions.stem import common, stem
from quillon.operators.search import matching, scores
from quillon.plans.schema import STOPWORDS, TEXT, Field, Index

ENDINGS = "s es ed eed ing ingly edly ies ied y ly li ation ational ization izer iveness iviti biliti bility fulness ousness alism ment ement able ible ion al ence ative icate".split()


@pytest.mark.parametrize(
    ("word", "want"),
    [("learning", "learn"), ("learns", "learn"), ("running", "run"), ("ran", "ran"), ("happy", "happi"), ("hoping", "hope"), ("hopped", "hop"), ("adding", "add"), ("generate", "generat"), ("relational", "relat"), ("knots", "knot"), ("skies", "sky"), ("dying", "die"), ("proceed", "proceed"), ("evening", "evening"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("kiwis", "kiwi"), ("by", "by"), ("say", "say"), ("falling", "fall"), ("", ""), ("é", "é"), ("dog's", "dog")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_a_word_begins_like_its_stem():
    for head in "a b be rel organ gener pass happ hop fall ab sk l agre conspicu yy past e".split():
        for one in ["", *ENDINGS]:
            for two in ["", *ENDINGS]:
                word = head + one + two
                assert word.startswith(common(stem(word))), word


def test_language_is_checked():
    with pytest.raises(ValueError, match="no stems"):
        Index("i", "id", (), language="klingon")


WORDS = ["The machine is learning fast.", "machines learned, slowly", "machine learn", "a learner and happy machines", "hurried learning of machines; quick", None, "", "license", "licensing LICENSED the learnt", "learning " * 40]
ROWS = [(str(k), t) for k, t in enumerate(WORDS)]


def index(**how):
    return Index("i", "id", (Field("t", TEXT),), **how)


def filed(text, groups=()):
    out = Counter()
    for w in re.findall(r"[^\s.,;]+", (text or "").lower()):
        if w not in STOPWORDS:
            out.update({w, stem(w)})
            out.update(f" {k}" for k, g in enumerate(groups) if w in g)
    return out


def found(spark, query, ix):
    df = spark.createDataFrame(ROWS, "id string, t string")
    return {r[0] for r in matching(df, ix, query).select("id").collect()}


@pytest.mark.parametrize("term", ["learn", "learned", "machines", "happy", "licenses", "hurry", "zebra"])
def test_terms(spark, term):
    assert found(spark, term, index()) == {k for k, t in ROWS if filed(t)[stem(term)]}
    assert found(spark, f"-{term}", index()) == {k for k, t in ROWS if not filed(t)[stem(term)]}


def test_other_lookups_are_not_stemmed(spark):
    assert found(spark, '"machine learn"', index()) == {"0", "2"}
    assert found(spark, '"machines learning"', index()) == set()
    assert found(spark, '"learn machin"~1', index()) == {"4"}
    assert found(spark, "happi*", index()) == {"3"}
    assert found(spark, "*censing", index()) == {"8"}
    assert found(spark, "w'mach?n'", index()) == {"0", "1", "2", "3", "4"}
    assert found(spark, "learn", index(language=None)) == {"2"}
    assert found(spark, "learn", Index("i", "id", (Field("t", TEXT, no_stem=True),))) == {"2"}


def test_synonyms_join_stems(spark):
    ix = index(synonyms=(frozenset({"quick", "fast"}),))
    assert found(spark, "fast", ix) == {"0", "4"}
    assert found(spark, "quickly", ix) == {"4"}


def bm25(texts, terms, groups=()):
    """(row, score) of documents that hold a term."""
    docs = {k: filed(t, groups) for k, t in texts}
    lengths = {k: sum(d.values()) for k, d in docs.items()}
    mean = sum(lengths.values()) / sum(n > 0 for n in lengths.values())
    out = {}
    for t in terms:
        n = sum(d[t] > 0 for d in docs.values())
        for k, d in docs.items():
            if d[t]:
                out[k] = out.get(k, 0) + math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * lengths[k] / mean))
    return out


@pytest.mark.parametrize(("query", "terms"), [("learned", ["learn"]), ("machines | fast", ["machin", "fast", " 0"]), ("learning | happi*", ["learn", "happi"])])
def test_scores(spark, query, terms):
    groups = (frozenset({"quick", "fast"}),)
    df = spark.createDataFrame(ROWS, "id string, t string")
    got = {r[0]: r[1] for r in scores(df, index(synonyms=groups), query).select("__key", "__score").collect()}
    assert got == pytest.approx(bm25(ROWS, terms, groups))


def test_scores_of_documents(spark):
    from quillon.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = pd.read_parquet(f"{sf}/documents.parquet")
    separators = re.compile("[" + re.escape("\t\n\r\v\f,.<>{}[]\"':;!@#$%^&*()-+=~?/|` ") + "]+")
    rows = [(str(k), " ".join(w for w in separators.split(t or "") if w)) for k, t in zip(texts.doc_id, texts.text, strict=True) if "\\" not in (t or "")]
    assert len(rows) == len(texts)
    want = bm25(rows, [stem("licenses"), stem("permission")])
    got = {r.doc: r.score for r in QUERIES["score_bm25_stem"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-6) and got


@pytest.mark.parametrize("stretch", [1, 3, 1 << 18])
def test_stretches_run_across_rows(monkeypatch, stretch):
    monkeypatch.setattr(stemming, "STRETCH", stretch)
    deal = random.Random(7)
    some = ["learning", "learned", "learn", "machines", "machin", "fast", "by", "é", "dog's"]
    rows = [None, [], *([deal.choice(some) for _ in range(deal.choice([0, 1, 2, 5, 9]))] for _ in range(300)), [], None]
    batch = pa.array([["machines", "learning"], *rows, ["learned"]], pa.list_(pa.string())).slice(1, len(rows))
    terms = ["learn", "machin", "by"]
    changed = [[stem(w) for w in ws or [] if stem(w) != w] for ws in rows]
    assert stemming._stemmed(batch).to_pylist() == [None if ws is None else [stem(w) for w in ws] for ws in rows]
    assert stemming._tallied(batch, terms).to_pylist() == [[len(c), *map(c.count, terms)] for c in changed]
    assert stemming._stemmed(batch.slice(0, 1)).to_pylist() == [None] and stemming._tallied(batch.slice(1, 1), terms).to_pylist() == [[0, 0, 0, 0]]
    for slop in (0, 2):
        for phrase in (["learn"], ["learn", "machin"], ["machin", "learn", "learn"]):
            want = []
            for ws in rows:
                reached = None
                for t in phrase:
                    places = [i for i, w in enumerate(ws or []) if t in (w, stem(w))]
                    reached = places if reached is None else [p for p in places if any(0 < p - q <= slop + 1 for q in reached)]
                want.append(bool(reached))
            assert stemming._phrases(batch, phrase, slop) == want


def test_memory_is_that_of_a_stretch_not_of_a_batch():
    """Two million words of a batch would take 100 MB as Python's own."""
    words = [f"{a}a{b}ing" for a in "bcdfg" for b in range(2000)]
    batch = pa.ListArray.from_arrays(pa.array(range(0, 2_000_001, 500), pa.int32()), pa.array(words * 200))
    tracemalloc.start()
    try:
        out = stemming._tallied(batch, [stem("ba1ing")])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == 4000 and sum(out.flatten().to_pylist()) == 2_000_000 + 200
    assert peak < 40e6
