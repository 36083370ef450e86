"""The pipeline's stages on a small scale: what goes, what stays, and that all five follow each other."""

import corpus_pipeline
import numpy as np

from quillon.llm import sentencepiece_scan


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    v = sentencepiece_scan.Vocabulary(open(sentencepiece_scan.MODEL, "rb").read())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert out and all(r.doc_id in docs and r.n_tokens == len(r.ids) // 4 for r in out)
    for r in out[:50]:
        if r.key == 0:
            kept = v.decode(np.frombuffer(r.ids, np.int32))
            assert len(kept) == r.n_chars and len(kept) <= len(docs[r.doc_id])


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS)
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 !!", "en", "s", 6)], docs.schema)
    first = corpus_pipeline.identify_language(spark, docs.unionByName(odd), sf)
    assert first.columns == corpus_pipeline.COLUMNS and first.count() == docs.count()


def test_giants_taken_twice(spark, sf):
    """Both copies of a document that the mix takes twice are encoded, whether short or giant."""
    docs = spark.createDataFrame([(1, "ab cd " * 20, "en", "s", 120), (2, "ab cd " * 8000, "en", "s", 48000)], ", ".join(("doc_id long", "text string", "lang string", "source string", "n_chars long")))
    got = [(r.doc_id, r.n_chars) for r in corpus_pipeline.encode_pieces(spark, docs.union(docs), sf).collect()]
    assert sorted(got) == [(1, 120)] * 2 + [(2, 48000 - sentencepiece_scan.CHUNK)] * 2 + [(2, sentencepiece_scan.CHUNK)] * 2


def test_no_language_known(spark, sf):
    """A corpus without a single lang keeps its documents with letters."""
    docs = spark.createDataFrame([(1, "ab cd", None, "s", 5), (2, "12 !", None, "s", 4), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()] == [1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, part string, copy string, kept string, score string, size string"
LONG = " ".join(f"w{k * 7 % 1009}" for k in range(300))


def table(spark, *rows):
    """Documents with columns whose names the operators use, too."""
    return spark.createDataFrame([(i, t, lang, source, len(t) if t is not None else None, *["clash"] * 6) for i, t, lang, source in rows], SCHEMA)


def got(df):
    assert df.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


STAGES = [f for _, f in corpus_pipeline.STAGES[:4]]


def test_stages_on_empty_tables(spark, sf):
    for stage in STAGES:
        assert got(stage(spark, table(spark).limit(0), sf)) == []
    assert corpus_pipeline.encode_pieces(spark, table(spark).limit(0), sf).count() == 0


def test_language_stage_acts_on_its_prediction(spark, sf):
    """Texts that declare another language go; scraps, and texts that declare none, stay."""
    english = [(k, f"the other thing then there {k} with this and that " * 4, "en", "s") for k in range(30)]
    german = [(100 + k, f"über schöne straßen und große häuser {k} gehört " * 4, "de", "s") for k in range(30)]
    odd = [(200, german[3][1], "en", "s"), (201, english[3][1], "de", "s"), (202, german[4][1], None, "s"), (203, german[5][1], "xx", None), (204, "is", "de", "s"), (205, "12 !", "en", "s"), (206, None, "en", "s"), (207, "", None, "s")]
    kept = {i for i, _ in got(corpus_pipeline.identify_language(spark, table(spark, *english, *german, *odd), sf))}
    assert kept == {*range(30), *range(100, 130), 202, 203, 204}


def test_language_stage_precision_on_documents(spark, sf):
    """On the documents few go, and each of these has more words of the other language's learned texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.COLUMNS)
    rows = docs.collect()
    words = {}
    for r in rows:
        words.setdefault(r.lang, set()).update((r.text or "").lower().split())
    kept = {i for i, _ in got(corpus_pipeline.identify_language(spark, docs, sf))}
    gone = [r for r in rows if r.doc_id not in kept]
    assert len(gone) <= 0.01 * len(rows)
    for r in gone:
        own = (r.text or "").lower().split()
        assert not any(c.isalpha() for c in r.text or "") or max(sum(w in words[x] for w in own) for x in words if x != r.lang) > 0.5 * len(own)


def test_near_stage_tells_rows_of_one_id_apart(spark, sf):
    other = " ".join(f"v{k * 5 % 97}" for k in range(200))
    near = LONG.replace("w7 ", "zz ", 1)
    rows = [(1, LONG, "en", "s"), (1, other, "en", "s"), (2, near, "en", "s"), (3, other, None, None), (None, LONG, "en", "s"), (None, None, "en", "s"), (4, "", "en", "s"), (4, "", "en", "s")]
    assert got(corpus_pipeline.drop_near_duplicates(spark, table(spark, *rows), sf)) == sorted([(1, LONG), (1, other), (None, None), (4, ""), (4, "")], key=repr)
    rows = rows[1:4]
    assert got(corpus_pipeline.drop_near_duplicates(spark, table(spark, *rows), sf)) == [(1, other), (2, near)]


def test_string_stage_tells_rows_of_one_id_apart(spark, sf):
    a, b = "a" + "bc" * 20 + LONG, "x" * 30 + LONG[:150] + "y" * 30
    rows = [(1, a, "en", "s"), (1, "another text of the same id", "en", "s"), (2, b, "en", "s"), (2, b, "en", "s"), (3, "", "en", "s"), (4, None, "en", None)]
    kept = got(corpus_pipeline.drop_repeated_strings(spark, table(spark, *rows), sf))
    assert kept == [(1, a), (1, "another text of the same id"), (2, "x" * 30 + "y" * 30)]


def test_mixing_stage_takes_parts(spark, sf):
    """Words that come out are the targets, to a word; all but one row a source is a whole text."""
    rows = [(k, " ".join([f"t{k}"] * (5 + k % 7)), "en", "abc"[k % 3]) for k in range(60)] + [(60, None, "en", "a"), (61, " ", "en", None), (2, "same id again", "en", "c")]
    docs = table(spark, *rows)
    out = corpus_pipeline.mix_sources(spark, docs, sf).collect()
    sizes, whole = {}, {(i, t) for i, t, _, _ in rows}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    from quillon.llm.mixing import targets

    for s, quota in targets(sizes).items():
        assert abs(sum(len(r.text.split()) for r in out if r.source == s) - quota) <= 1
    assert sum((r.doc_id, r.text) not in whole for r in out) <= 3 and all(r.n_chars == len(r.text) for r in out)
    assert got(corpus_pipeline.mix_sources(spark, docs, sf)) == sorted(((r.doc_id, r.text) for r in out), key=repr)
