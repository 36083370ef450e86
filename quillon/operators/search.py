"""Searching an index: admission of documents, predicates, scores, nearest vectors and hybrid ranking."""

from __future__ import annotations

import functools
import shlex
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, stem, text, vectors
from ..functions.values import clean, number_text
from ..plans.schema import GEO, NUMERIC, TAG, TEXT, VECTOR, Field, Index
from ..plans.search import Node, Query, parse

K1, B, TANH = 1.2, 0.75, 4.0


def raw(index: Index, f: Field) -> Column:
    source = f.source or f.name
    if source.startswith("$"):
        return F.get_json_object(F.col(index.document), source)
    return F.col(source)


def value(index: Index, f: Field) -> Column:
    """A field as its type has it: double, string, point or vector; null where missing or refused."""
    c = raw(index, f)
    if f.kind == NUMERIC:
        return clean(c.try_cast("double"))
    if f.kind == GEO:
        return geo.point(c.cast("string"))
    return c if f.kind == VECTOR else c.cast("string")


def tokens(index: Index, f: Field) -> Column:
    return text.tokens(value(index, f), index.stopwords)


def postings(index: Index, f: Field, words: Column) -> Column:
    """What words are filed under: themselves, their stems where these differ, and a mark for each word of a synonym group
    (a space, which no word has, and the group's number). All count toward a text's length."""
    out = [words]
    if index.stemmed(f):
        changed = F.filter(F.zip_with(words, stem.stems(words), lambda w, s: F.when(w != s, s)), lambda s: s.isNotNull())
        out.append(changed)
    for k, group in enumerate(index.synonyms):
        same = F.filter(words, functools.partial(lambda group, w: w.isin(group), sorted(group)))
        out.append(F.array_repeat(F.lit(f" {k}"), F.size(same)))
    return F.concat(*out) if len(out) > 1 else words


def tallies(index: Index, f: Field, words: Column, terms: list[str]) -> tuple[Column, list[Column]]:
    """How many postings there are, and how many for each term, without making them."""
    one = lambda test: F.size(F.filter(words, test))
    marks = {f" {k}": one(functools.partial(lambda group, w: w.isin(group), sorted(group))) for k, group in enumerate(index.synonyms)}
    length, each = sum(marks.values(), F.size(words)), [one(functools.partial(lambda t, w: w == t, t)) + marks.get(t, F.lit(0)) for t in terms]
    if index.stemmed(f):
        by_stem = stem.tally(words, terms)
        length, each = length + by_stem[0], [n + by_stem[k] for k, n in enumerate(each, 1)]
    return length, each


def filed(index: Index, f: Field, term: str) -> str:
    """What a query's word is looked up as."""
    return stem.stem(term) if index.stemmed(f) else term


def tags_of(index: Index, f: Field) -> Column:
    if f.multi:
        return F.coalesce(F.transform(F.from_json(raw(index, f), "array<string>"), F.lower), F.array().cast("array<string>"))
    return text.tags(value(index, f), f.separator, f.case_sensitive)


def admit(df: DataFrame, index: Index) -> DataFrame:
    """Documents of the index. One refused value (a number that is none, a bad point, a vector of another length) leaves
    the whole document out; a missing field does not. Adds ``__key``."""
    df = df.withColumn("__key", F.col(index.key).cast("string"))
    if index.prefix:
        df = df.filter(F.col("__key").startswith(index.prefix))
    for f in index.fields:
        if f.noindex:
            continue
        c = raw(index, f)
        if f.kind == NUMERIC:
            x = c.try_cast("double")
            df = df.filter(c.isNull() | (x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        elif f.kind == GEO:
            df = df.filter(c.isNull() | value(index, f).isNotNull())
        elif f.kind == VECTOR and f.dim:
            df = df.filter(c.isNull() | (F.size(c) == f.dim))
    return df


def _synonyms(index: Index, term: str) -> list[str]:
    group = next((g for g in index.synonyms if term in g), None)
    return sorted({term, *(group or ())})


def _on_text(node: Node, index: Index, f: Field) -> Column | None:
    """A predicate on one field's words; None for what is left out (stopwords). Texts are cut into words, and words are
    stemmed, only where the characters don't rule the words out."""
    words, raw_text, stemmed = tokens(index, f), value(index, f), index.stemmed(f)

    def may(parts: list[str]) -> Column:
        return F.coalesce(text.may_hold(raw_text, parts), F.lit(False))

    if node.kind == "term":
        terms = text.words_of(node.value)
        if len(terms) == 1:
            same = _synonyms(index, terms[0])
            if terms[0] in index.stopwords:
                return None
            if not stemmed:
                return may(same) & text.has_any(words, same)
            wanted = filed(index, f, terms[0])
            near = stem.common(wanted)
            group = same if len(same) > 1 else []
            like = F.when(may([near]), F.filter(words, lambda w: w.startswith(near)))
            by_stem = F.coalesce(F.array_contains(like, wanted) | F.array_contains(stem.stems(like), wanted), F.lit(False))
            return by_stem | (may(group) & text.has_any(words, group)) if group else may([near]) & by_stem
        node = Node("phrase", (), (node.value, 0))
    if node.kind == "phrase":
        terms = [w for w in text.words_of(node.value[0]) if w not in index.stopwords]
        if not terms:
            return F.lit(False)
        longest = max(terms, key=len)
        if stemmed:
            held = may([stem.common(longest)])
            return held & stem.has_phrase(F.when(held, words), terms, node.value[1])
        return may([longest]) & text.has_phrase(words, terms, node.value[1])
    if node.kind == "affix":
        kind, part = node.value
        if not stemmed:
            return may([part]) & text.has_affix(words, kind, part)
        if kind == "prefix":  # a stem begins like its word, but for two letters
            held = may([stem.common(part)])
            like = F.when(held, F.filter(words, lambda w: w.startswith(stem.common(part))))
            return held & F.coalesce(text.has_affix(like, kind, part) | text.has_affix(stem.stems(like), kind, part), F.lit(False))
        return text.has_affix(words, kind, part) | text.has_affix(stem.stems(words), kind, part)
    if node.kind == "glob":
        return text.has_glob(words, node.value) | text.has_glob(stem.stems(words), node.value) if stemmed else text.has_glob(words, node.value)
    raise ValueError(f"{node.kind} doesn't go with text")


def predicate(node: Node, index: Index, field: Field | None = None) -> Column | None:
    """A condition that is never null; None for stopwords, which drop out."""
    kind = node.kind
    if kind == "all":
        return F.lit(True)
    if kind in ("and", "or"):
        found = [p for p in (predicate(x, index, field) for x in node.parts) if p is not None]
        if not found:
            return F.lit(False)
        return functools.reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), found)
    if kind == "not":
        inner = predicate(node.parts[0], index, field)
        return None if inner is None else ~inner
    if kind == "optional":
        return F.lit(True)
    if kind == "weight":
        return predicate(node.parts[0], index, field)
    if kind == "field":
        return predicate(node.parts[0], index, index.field(node.value))
    if kind == "exists":
        return value(index, field).isNotNull()
    if kind == "range":
        low, no_low, high, no_high = node.value
        x = value(index, field)
        return F.coalesce(((x > low) if no_low else (x >= low)) & ((x < high) if no_high else (x <= high)), F.lit(False))
    if kind == "geo":
        return geo.near(value(index, field), *node.value)
    if kind == "tags":
        have = tags_of(index, field)
        fold = (lambda s: s) if field.case_sensitive else str.lower
        exact = [fold(v) for k, v in node.value if k == "exact"]
        found = [text.has_any(have, exact)] if exact else []
        found += [text.has_glob(have, fold(v)) if k == "glob" else text.has_affix(have, k, fold(v)) for k, v in node.value if k != "exact"]
        return functools.reduce(lambda a, b: a | b, found)
    if kind == "within":
        radius, vector = node.value
        return F.coalesce(vectors.distance(value(index, field), vectors.literal(vector), field.metric) <= radius, F.lit(False))
    fields = [field] if field else [f for f in index.fields if f.kind == TEXT and not f.noindex]
    if field and field.kind == TAG:
        return text.has_any(tags_of(index, field), [str(node.value).lower()])
    found = [_on_text(node, index, f) for f in fields]
    found = [p for p in found if p is not None]
    return functools.reduce(lambda a, b: a | b, found) if found else None


def matching(df: DataFrame, index: Index, query: str | Query, params: dict[str, Any] | None = None) -> DataFrame:
    """Admitted documents that the query's condition holds for, with all their columns and ``__key``."""
    q = parse(query, params) if isinstance(query, str) else query
    cond = predicate(q.where, index)
    return admit(df, index).filter(F.lit(False) if cond is None else cond)


def search(
    df: DataFrame,
    index: Index,
    query: str,
    *,
    params: dict[str, Any] | None = None,
    returns: dict[str, str] | list[str] | None = None,
    filters: dict[str, tuple[float, float]] | None = None,
    sort: tuple[str, bool] | None = None,
    offset: int = 0,
    limit: int | None = 10,
    scorer: str | None = None,
    sort_key: bool = False,
) -> DataFrame:
    """Rows ``__key`` and fields. ``returns``: names, or name to alias; an empty list gives keys alone. ``sort``: a field and
    whether it descends; missing values come last both ways. ``scorer`` adds ``__score``, highest first, and ``sort_key`` the ``__sortkey`` of a
    sort: ``#`` and the number, or ``$`` and the text. Ties go by key."""
    q = parse(query, params)
    found = matching(df, index, q)
    for name, (low, high) in (filters or {}).items():
        found = found.filter(value(index, index.field(name)).between(low, high))
    names = {f.name: f.name for f in index.fields if f.kind != VECTOR} if returns is None else returns if isinstance(returns, dict) else dict.fromkeys(returns)
    columns = {alias or name: value(index, index.field(name)) for name, alias in names.items()}
    order = [F.asc("__key")]
    if q.nearest:
        f = index.field(q.nearest.field)
        found = found.withColumn("__distance", vectors.distance(value(index, f), vectors.literal(q.nearest.vector), f.metric)).filter("__distance is not null").orderBy("__distance", "__key").limit(q.nearest.k)
        columns[q.nearest.alias] = F.col("__distance")
        order = [F.asc("__distance"), F.asc("__key")]
    if scorer:
        found = found.join(scores(df, index, q, scorer).select("__key", "__score"), "__key", "left").withColumn("__score", F.coalesce("__score", F.lit(0.0)))
        columns["__score"] = F.col("__score")
        order = [F.desc("__score"), F.asc("__key")]
    if sort:
        by = clean(value(index, index.field(sort[0]))) if index.field(sort[0]).kind == NUMERIC else value(index, index.field(sort[0]))
        found = found.withColumn("__sort", by)
        if sort_key:
            numeric = index.field(sort[0]).kind == NUMERIC
            columns["__sortkey"] = F.concat(F.lit("#"), number_text(F.col("__sort"))) if numeric else F.concat(F.lit("$"), F.col("__sort"))
        order = [F.col("__sort").desc_nulls_last() if sort[1] else F.col("__sort").asc_nulls_last(), F.asc("__key")]
    if limit is not None:
        found = found.orderBy(*order)
        found = (found.offset(offset) if offset else found).limit(limit)
    return found.select("__key", *(c.alias(a) for a, c in columns.items()))


def search_command(command: str, tables: dict[str, tuple[DataFrame, Index]], params: dict[str, Any] | None = None) -> DataFrame:
    """Runs ``index query option...``, for instance ``docs 'night owl' RETURN 1 title SORTBY year DESC LIMIT 0 5``.

    Options: NOCONTENT, RETURN n field [AS alias]... (n counts words), LIMIT offset count (0 and 10 by default), SORTBY field
    [ASC|DESC], FILTER field low high (``(`` before a bound leaves it out), PARAMS n name value..., SCORER name, WITHSCORES,
    WITHSORTKEYS, and DIALECT n and TIMEOUT n, which change nothing here. ``params``: values that no text has, as vectors.
    """
    words = shlex.split(command)
    if len(words) < 2:
        raise ValueError("a search needs an index and a query")
    (name, text_), rest = words[:2], words[2:]
    how: dict[str, Any] = {"params": dict(params or {}), "filters": {}}
    bounds: list[str] = []

    def given(n: int) -> list[str]:
        if len(rest) < n:
            raise ValueError(f"an option ends early in {command!r}")
        out = rest[:n]
        del rest[:n]
        return out

    def counted() -> list[str]:
        return given(int(given(1)[0]))

    while rest:
        option = given(1)[0].upper()
        if option == "NOCONTENT":
            how["returns"] = []
        elif option == "RETURN":
            fields = counted()
            how.setdefault("returns", {})
            while fields:
                field = fields.pop(0)
                alias = field
                if len(fields) >= 2 and fields[0].upper() == "AS":
                    alias, fields = fields[1], fields[2:]
                if isinstance(how["returns"], dict):
                    how["returns"][field] = alias
        elif option == "LIMIT":
            how["offset"], how["limit"] = map(int, given(2))
        elif option == "SORTBY":
            field = given(1)[0].lstrip("@")
            way = given(1)[0].upper() if rest and rest[0].upper() in ("ASC", "DESC") else "ASC"
            how["sort"] = (field, way == "DESC")
        elif option == "FILTER":
            field, low, high = given(3)
            bounds.append(f"@{field}:[{low} {high}]")
        elif option == "PARAMS":
            pairs = counted()
            how["params"] |= dict(zip(pairs[::2], map(_plain, pairs[1::2]), strict=True))
        elif option in ("SCORER", "WITHSCORES"):
            how["scorer"] = given(1)[0].upper() if option == "SCORER" else how.get("scorer") or "BM25STD"
        elif option == "WITHSORTKEYS":
            how["sort_key"] = True
        elif option in ("DIALECT", "TIMEOUT"):
            given(1)
        else:
            raise ValueError(f"unknown option {option}")
    if bounds:  # a nearest-neighbour part stays behind the conditions
        where, arrow, nearest = text_.partition("=>[")
        text_ = " ".join([f"({where})" if where.strip() != "*" else "", *bounds]).strip() + arrow + nearest
    df, index = tables[name]
    return search(df, index, text_, **how)


def _plain(value: str) -> float | str:
    """A parameter as a number, if it is one."""
    try:
        return float(value)
    except ValueError:
        return value


def scored_terms(node: Node, index: Index, weight: float = 1.0, field: str | None = None) -> dict[tuple[str | None, str, str], float]:
    """(field, kind, term) to weight: each once, weights added up. Negated parts don't score."""
    out: dict = {}
    if node.kind == "not":
        return out
    if node.kind == "weight":
        return scored_terms(node.parts[0], index, weight * node.value, field)
    if node.kind == "field":
        return scored_terms(node.parts[0], index, weight, node.value)
    if node.kind in ("term", "phrase"):
        for w in text.words_of(node.value if node.kind == "term" else node.value[0]):
            if w not in index.stopwords:
                out[field, "exact", w] = out.get((field, "exact", w), 0) + weight
    elif node.kind == "affix":
        out[field, *node.value] = weight
    for p in node.parts:
        for k, w in scored_terms(p, index, weight, field).items():
            out[k] = out.get(k, 0) + w
    return out


def scores(df: DataFrame, index: Index, query: str | Query, scorer: str = "BM25STD") -> DataFrame:
    """(__key, __score) of documents that hold a term of the query."""
    q = parse(query) if isinstance(query, str) else query
    terms = scored_terms(q.where, index)
    if terms and all(k == "exact" for _, k, _ in terms):
        out = _exact_scores(df, index, terms, scorer)
    else:
        out = _pattern_scores(df, index, terms, scorer)
    if scorer.endswith("NORM") and scorer.startswith("BM25"):
        best = out.agg(F.max("__score").alias("best"))
        return out.crossJoin(F.broadcast(best)).select("__key", F.when(F.col("best") > 0, F.col("__score") / F.col("best")).otherwise(0.0).alias("__score"))  # one row
    return out.withColumn("__score", F.tanh(F.col("__score") / TANH)) if scorer.endswith("TANH") else out


def _one(scorer: str, tf: Column, n: Column, df_: Column, length: Column, mean: Column) -> Column:
    """What a term adds to a document's score."""
    if scorer.startswith("BM25"):
        idf = F.log(F.lit(1.0) + (n - df_ + 0.5) / (df_ + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    if scorer.startswith("TFIDF"):
        return F.log(n / df_) * tf / (length if scorer.endswith("DOCNORM") else F.lit(1.0))
    raise ValueError(f"unknown scorer {scorer}")


def _lookups(index: Index, fields: list[Field], terms: dict) -> list[tuple[Field, str, str, float]]:
    """(field, kind, term, weight): the query's terms as each field has them, and the marks of their synonym groups."""
    out = []
    for f in fields:
        for (of, kind, t), w in terms.items():
            if of not in (None, f.name):
                continue
            out.append((f, kind, filed(index, f, t) if kind == "exact" else t, w))
            out += [(f, "exact", f" {k}", w) for k, group in enumerate(index.synonyms) if kind == "exact" and t in group]
    return out


def _hints(index: Index, f: Field, term: str) -> list[str]:
    """Of a text that has the term, what its characters hold, one of these at least."""
    if term.startswith(" "):
        return sorted(index.synonyms[int(term)])
    return [stem.common(term)] if index.stemmed(f) else [term]


def _exact_scores(df: DataFrame, index: Index, terms: dict, scorer: str) -> DataFrame:
    """For whole words: one pass gives the corpus statistics as one row, another scores by themselves the documents whose
    texts may hold a word. Nothing is shuffled but that row."""
    fields = [f for f in index.fields if f.kind == TEXT and not f.noindex]
    wanted = [(f, t, w) for f, _, t, w in _lookups(index, fields, terms)]
    admitted = admit(df, index)

    def counted(rows: DataFrame) -> DataFrame:
        rows = rows.select("__key", *(tokens(index, f).alias(f"__words_{f.name}") for f in fields))
        out = []
        for f in fields:
            own = {k: t for k, (g, t, _) in enumerate(wanted) if g is f}
            length, each = tallies(index, f, F.col(f"__words_{f.name}"), list(own.values()))
            out += [length.cast("double").alias(f"__length_{f.name}"), *(n.cast("double").alias(f"__tf_{k}") for k, n in zip(own, each, strict=True))]
        return rows.select("__key", *out)

    stats = counted(admitted).agg(
        F.count("__key").cast("double").alias("__docs"),
        *(F.avg(F.when(F.col(f"__length_{f.name}") > 0, F.col(f"__length_{f.name}"))).alias(f"__mean_{f.name}") for f in fields),
        *(F.sum((F.col(f"__tf_{k}") > 0).cast("double")).alias(f"__df_{k}") for k in range(len(wanted))),
    )
    any_ = lambda tests: functools.reduce(lambda a, b: a | b, tests, F.lit(False))
    may = any_(F.coalesce(text.may_hold(value(index, f), [p for g, t, _ in wanted if g is f for p in _hints(index, f, t)]), F.lit(False)) for f in fields if any(g is f for g, _, _ in wanted))

    def part(k: int, f: Field, weight: float) -> Column:
        tf = F.col(f"__tf_{k}")
        one = _one(scorer, F.lit(f.weight) * tf, F.col("__docs"), F.col(f"__df_{k}"), F.col(f"__length_{f.name}"), F.col(f"__mean_{f.name}"))
        return F.when(tf > 0, one * F.lit(float(weight))).otherwise(0.0)

    total = functools.reduce(lambda a, b: a + b, (part(k, f, w) for k, (f, _, w) in enumerate(wanted)), F.lit(0.0))
    held = any_(F.col(f"__tf_{k}") > 0 for k in range(len(wanted)))
    scored = counted(admitted.filter(may)).crossJoin(F.broadcast(stats)).select("__key", F.when(held, total).alias("__score"))  # one row
    return scored.filter("__score is not null")


def _pattern_scores(df: DataFrame, index: Index, terms: dict, scorer: str) -> DataFrame:
    """For prefixes, suffixes and infixes, whose words only the documents know: words that some pattern matches are counted."""
    docs = admit(df, index)
    spark = df.sparkSession
    fields = [f for f in index.fields if f.kind == TEXT and not f.noindex]
    lookups = _lookups(index, fields, terms)
    words = None
    for f in fields:
        one = docs.select("__key", F.lit(f.name).alias("field"), F.lit(f.weight).alias("field_weight"), tokens(index, f).alias("words")).withColumn("words", postings(index, f, F.col("words")))
        words = one if words is None else words.unionByName(one)
    lengths = words.filter(F.size("words") > 0).groupBy("field").agg(F.avg(F.size("words")).alias("mean"))
    total = docs.agg(F.count("__key").cast("double").alias("docs"))

    def wanted(w: Column) -> Column:
        tests = [w == t if k == "exact" else ~w.startswith(" ") & {"prefix": w.startswith, "suffix": w.endswith, "infix": w.contains}[k](t) for _, k, t, _ in lookups]
        return functools.reduce(lambda a, b: a | b, tests, F.lit(False))

    hits = words.select("__key", "field", "field_weight", F.size("words").cast("double").alias("length"), F.explode(F.filter("words", wanted)).alias("term")).groupBy("__key", "field", "field_weight", "length", "term").agg(F.count("term").cast("double").alias("tf"))
    table = spark.createDataFrame([(f.name, k, t, float(w)) for f, k, t, w in lookups] or [("", "exact", "", 0.0)], "of string, kind string, pattern string, weight double")
    cond = (F.col("of") == F.col("field")) & F.when(F.col("kind") == "exact", F.col("term") == F.col("pattern")).when(F.col("term").startswith(" "), F.lit(False)).when(F.col("kind") == "prefix", F.col("term").startswith(F.col("pattern"))).when(F.col("kind") == "suffix", F.col("term").endswith(F.col("pattern"))).otherwise(F.col("term").contains(F.col("pattern")))
    hits = hits.join(F.broadcast(table), cond)  # the query's few patterns, each against the few terms that some pattern matched
    by_term = hits.groupBy("field", "term").agg(F.countDistinct("__key").cast("double").alias("df"))
    hits = hits.join(F.broadcast(lengths), "field").join(by_term, ["field", "term"]).crossJoin(F.broadcast(total))  # one row
    one = _one(scorer, F.col("field_weight") * F.col("tf"), F.col("docs"), F.col("df"), F.col("length"), F.col("mean"))
    return hits.groupBy("__key").agg(F.sum(one * F.col("weight")).alias("__score"))


def hybrid(
    df: DataFrame,
    index: Index,
    query: str,
    field: str,
    vector: list[float],
    *,
    k: int = 10,
    radius: float | None = None,
    where: str = "*",
    combine: str = "RRF",
    constant: float = 60.0,
    window: int = 20,
    alpha: float = 0.5,
    beta: float = 0.5,
    scorer: str = "BM25STD",
    limit: int = 10,
) -> DataFrame:
    """(__key, __score): text and vector results fused by reciprocal ranks or linearly; an absent side gives 0."""
    f = index.field(field)
    text_side = matching(df, index, query).select("__key").join(scores(df, index, query, scorer), "__key")
    near = matching(df, index, where).select("__key", vectors.distance(value(index, f), vectors.literal(vector), f.metric).alias("d")).filter("d is not null")
    near = near.filter(F.col("d") <= radius) if radius is not None else near.orderBy("d", "__key").limit(k)
    near = near.select("__key", vectors.similarity(F.col("d"), f.metric).alias("similarity"))
    if combine == "RRF":  # at most ``window`` rows a side are ranked
        by_text = text_side.orderBy(F.desc("__score"), "__key").limit(window).select("__key", F.row_number().over(Window.orderBy(F.desc("__score"), "__key")).alias("r"))
        by_near = near.orderBy(F.desc("similarity"), "__key").limit(window).select("__key", F.row_number().over(Window.orderBy(F.desc("similarity"), "__key")).alias("s"))
        part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(constant) + F.col(c)), F.lit(0.0))
        both = by_text.join(by_near, "__key", "full_outer").select("__key", (part("r") + part("s")).alias("__score"))
    else:
        both = text_side.join(near, "__key", "full_outer").select("__key", (alpha * F.coalesce("__score", F.lit(0.0)) + beta * F.coalesce("similarity", F.lit(0.0))).alias("__score"))
    return both.orderBy(F.desc("__score"), "__key").limit(limit)


def tag_values(df: DataFrame, index: Index, field: str) -> DataFrame:
    """The distinct tags of a field."""
    return admit(df, index).select(F.explode(tags_of(index, index.field(field))).alias("tag")).distinct()


def profile(df: DataFrame) -> str:
    """The physical plan of a search or pipeline."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
