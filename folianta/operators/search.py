"""Full-text search over paragraphs: tiers of phrase, all-terms, metadata and LIKE matches, merged in order."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folianta.functions import analyze as an
from folianta.functions import text as tx
from folianta.model import lines_of
from folianta.operators import index as ix
from folianta.operators.index import INDEXED
from folianta.operators.relational import first_child, keep_one

#: Published constants of Okapi BM25, and decimal places to which a score counts.
K1, B, PLACES = 1.2, 0.75, 6


def combine_scope(one: int | None, allowed: Sequence[int] | None) -> list[int] | None:
    return an.scope(one, allowed)


def in_list(column: str, ids: Sequence[int] | None) -> Column:
    """True for None, false for an empty list."""
    if ids is None:
        return F.lit(True)
    return F.col(column).isin(list(ids)) if len(ids) else F.lit(False)


def wide(lib) -> DataFrame:
    """Paragraphs with the columns of their work, author and source; a work's columns go with its lines, without a join.

    Works without an id are left out.
    """
    w = lib.works.filter("work_id IS NOT NULL")
    p = w.select("work_id", "language", "source_id", "code", "title", "year", "work_date", "author_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "text"))
    p = p.withColumns({"number": (F.col("pos") + 1).cast("int"), "paragraph_id": F.col("work_id") * 1000000 + F.col("pos") + 1}).drop("pos")
    p = tx.with_search_text(p)
    a = lib.authors.select("author_id", F.col("display_name").alias("author"), F.col("full_name").alias("author_full"))
    s = lib.sources.select("source_id", F.col("display_name").alias("source_name"), F.col("name").alias("source_short"))
    return p.join(a, "author_id", "left").join(s, "source_id", "left")


def index_of(lib) -> ix.Index:
    """The stored index of a library, built by the first search over its documents."""
    return ix.stored(lib.spark, f"{lib.sf_dir}/documents.parquet", lambda: wide(lib))


def canonical() -> list[Column]:
    """Undated works last, then year, date, title, paragraph number and id."""
    return [F.when(F.col("year") > 0, 0).otherwise(1), F.col("year"), F.col("work_date").asc_nulls_first(), F.col("title"), F.col("number"), F.col("paragraph_id")]


def scope_of(language: str | None, sources: Sequence[int] | None) -> Column:
    """Whether a search may see a row."""
    inside = in_list("source_id", sources)
    return inside if language is None else tx.equals_folded(F.col("language"), language) & inside


def scoped(df: DataFrame, language: str | None, sources: Sequence[int] | None) -> DataFrame:
    """Rows a search may see; applied before any limit."""
    return df.filter(scope_of(language, sources))


def phrases_of(query_terms: Sequence[str]) -> list[list[str]]:
    """What the index looks up for query terms: a token each, or a phrase where the index cuts the term."""
    return [p for p in (an.index_terms(t) for t in query_terms) if p]


def with_all(index: ix.Index, query_terms: Sequence[str], scope: Column | None = None) -> DataFrame:
    """``index.lookup`` of the paragraphs that match every term."""
    phrases = phrases_of(query_terms)
    found = ix.lookup(index, phrases, scope)
    for k in range(len(phrases)):
        found = found.filter(f"match_{k}")
    return found


def bm25(index: ix.Index, found: DataFrame, query_terms: Sequence[str]) -> DataFrame:
    """``found`` (a lookup of the terms) with ``score``: Okapi BM25, larger is better.

    Statistics are those of the whole index, whatever rows the search may see.
    """
    n, mean = index.total("n"), index.total("mean_length")
    score = F.lit(0.0)
    for i, token in enumerate(ix.tokens_of(phrases_of(query_terms))):
        df, tf = index.frequency(token), F.col(f"tf_{i}")
        score = score + F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / mean))
    return found.withColumn("score", F.round(score, PLACES))


def simple_rank(text: str) -> Column:
    """Place of a metadata match: exact code, exact title, then prefixes and parts of both, names, and the text."""
    norm = an.normalise(text)
    c, t = F.col("code"), F.col("title")
    cases = [
        tx.equals_folded(c, text), tx.equals_folded(t, text), None, None, None,
        tx.starts_folded(c, text), tx.starts_folded(t, text), tx.contains_folded(c, text), tx.contains_folded(t, text),
        tx.starts_folded(F.col("author"), text), tx.starts_folded(F.col("author_full"), text), tx.starts_folded(F.col("source_name"), text),
        F.col("search_text") == norm, F.startswith("search_text", F.lit(norm)),
    ]
    intent = an.date_intent(text)
    if intent:
        inside = F.col("year").between(intent.low, intent.high)
        cases[2] = tx.equals_folded(t, f"{intent.month} {intent.low}") if intent.low == intent.high else None
        cases[3] = tx.contains_folded(t, f"{intent.month} {intent.low}") & inside
        cases[4] = tx.contains_folded(t, intent.month) & inside
    out = F.lit(14)
    for rank, case in reversed(list(enumerate(cases))):
        if case is not None:
            out = F.when(F.coalesce(case, F.lit(False)), rank).otherwise(out)
    return out


def metadata_match(text: str) -> Column:
    """LIKE on title, code, both author names and both source names; a number also as the year."""
    out = F.lit(False)
    for c in ("title", "code", "author", "author_full", "source_name", "source_short"):
        out = out | F.coalesce(tx.contains_folded(F.col(c), text), F.lit(False))
    return out | (F.col("year") == int(text.strip())) if text.strip().isdigit() else out


def phrase_tier(index: ix.Index, phrase: list[str], limit: int, scope: Column | None = None) -> DataFrame:
    """paragraph_id and place of phrase matches, unranked: the first by id."""
    found = ix.lookup(index, [phrase], scope).filter("match_0").orderBy("paragraph_id").limit(limit)
    return found.select("paragraph_id", F.col("paragraph_id").cast("double").alias("place"))


def terms_tier(index: ix.Index, query_terms: list[str], limit: int, scope: Column | None = None) -> DataFrame:
    """paragraph_id and place of all-terms matches by falling score, then id."""
    found = bm25(index, with_all(index, query_terms, scope), query_terms).orderBy(F.desc("score"), "paragraph_id").limit(limit)
    return _placed(found, [F.desc("score"), F.col("paragraph_id")]).select("paragraph_id", "place")


def fetched(index: ix.Index, tier: DataFrame) -> DataFrame:
    """The entries of a tier's paragraphs, with ``place``.

    A tier holds 250 rows at most. They are looked up first, so that the scan of the entries, which
    lie in the order of their ids, is given the ids themselves and skips what cannot hold them.
    """
    hits = [(r.paragraph_id, r.place) for r in tier.collect()]
    page = index.spark.createDataFrame(hits, "paragraph_id long, place double")
    return index.entries.filter(_one_of("paragraph_id", [h[0] for h in hits])).join(F.broadcast(page), "paragraph_id")


def _one_of(column: str, values: Sequence[int]) -> Column:
    """Equal to one of the values, as a balanced tree of equalities: unlike a long list, it is pushed down as it is."""
    if not values:
        return F.lit(False)
    if len(values) == 1:
        return F.col(column) == values[0]
    half = len(values) // 2
    return _one_of(column, values[:half]) | _one_of(column, values[half:])


def _placed(found: DataFrame, order: list[Column]) -> DataFrame:
    """``place`` 1, 2, … of a limited result, which is small enough for one task."""
    from pyspark.sql.window import Window

    return found.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("double"))


def metadata_tier(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """One paragraph, the first, of each work whose metadata match, by ``simple_rank`` and canonical order."""
    first = keep_one(rows.filter(metadata_match(text)), ["work_id"], [F.col("number")])
    order = [F.col("__rank"), *canonical()]
    found = first.withColumn("__rank", simple_rank(text)).orderBy(*order).limit(limit)
    return _placed(found, order).drop("__rank")


def like_tier(rows: DataFrame, text: str, limit: int) -> DataFrame:
    """Metadata or search text contains the query; a number also as year or paragraph number."""
    match = metadata_match(text) | F.contains("search_text", F.lit(an.normalise(text)))
    if text.strip().isdigit():
        match = match | (F.col("number") == int(text.strip()))
    order = [F.col("__rank"), *canonical()]
    return _placed(rows.filter(match).withColumn("__rank", simple_rank(text)).orderBy(*order).limit(limit), order).drop("__rank")


def merged(parts: Sequence[DataFrame], limit: int) -> DataFrame:
    """Tiers one after the other, each paragraph where it stands first."""
    out = None
    for tier, part in enumerate(parts):
        one = part.select("paragraph_id", "work_id", "code", "title", "year", "number", tx.preview(F.col("text"), 240).alias("preview"), F.lit(tier).alias("tier"), "place")
        out = one if out is None else out.unionByName(one)
    return keep_one(out, ["paragraph_id"], [F.col("tier"), F.col("place")]).orderBy("tier", "place").limit(limit)


def _empty(rows: DataFrame) -> DataFrame:
    return merged([rows.filter(F.lit(False)).withColumn("place", F.lit(0.0))], 1)


def search_free_text(lib, text: str, limit: int = 50, language: str | None = None, sources: Sequence[int] | None = None) -> DataFrame:
    """The tier cascade over the stored index.

    Blank: nothing. A text that ends in a paragraph number: structured search. Several terms
    without quotes: phrase tier, then all-terms tier. One term, or a quoted phrase: metadata
    tier first, unless the matches in the index alone fill the page.
    """
    limit = an.clamp(limit, 1, 250)
    if not an.normalise(text):
        return _empty(wide(lib))
    lookup = an.paragraph_lookup(text)
    if lookup:
        return search_structured(lib, an.SearchQuery(text=lookup.text, paragraph=lookup.number, limit=limit, language=language, sources=sources))
    quoted = an.exact_phrase(text)
    query_terms = an.terms(an.normalise(quoted if quoted is not None else text))
    parts = [p for t in query_terms for p in an.index_terms(t)]
    if not parts:
        return _empty(wide(lib))
    index, scope = index_of(lib), scope_of(language, sources)
    if quoted is None and len(query_terms) > 1:
        return merged([fetched(index, phrase_tier(index, parts, limit, scope)), fetched(index, terms_tier(index, query_terms, limit, scope))], limit)
    found = fetched(index, phrase_tier(index, parts, limit, scope) if quoted is not None else terms_tier(index, query_terms, limit, scope))
    meta = metadata_tier(index.entries.filter(scope), quoted if quoted is not None else text.strip(), limit)
    full = found.agg(F.count("*").alias("n")).scalar() >= limit
    return merged([meta.filter(~full), found], limit)


def search_structured(lib, q: an.SearchQuery) -> DataFrame:
    """Filters of every field given; matches of metadata and text first, those of the index after them."""
    limit = an.clamp(q.limit, 1, 250)
    if not any((q.text, q.title, q.code, q.keyword, q.author_id is not None, q.source_id is not None, q.year, q.paragraph, q.sources is not None)):
        return _empty(wide(lib))
    index = index_of(lib)
    rows = scoped(index.entries, q.language, an.scope(q.source_id, q.sources))
    for column, value in (("author_id", q.author_id), ("year", q.year), ("number", q.paragraph)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if q.title:
        rows = rows.filter(tx.contains_folded(F.col("title"), q.title))
    if q.code:
        rows = rows.filter(tx.contains_folded(F.col("code"), q.code))
    rank = filtered_rank(q)
    order = [F.col("__rank"), *canonical()]

    def tier(df: DataFrame) -> DataFrame:
        return _placed(df.withColumn("__rank", rank).orderBy(*order).limit(limit), order).drop("__rank")

    like = rows
    if q.text:
        like = like.filter(metadata_match(q.text) | F.contains("search_text", F.lit(an.normalise(q.text))))
    if q.keyword:
        like = like.filter(F.contains("search_text", F.lit(an.normalise(q.keyword))))
    words = an.terms(an.normalise(" ".join(x for x in (q.text, q.keyword) if x)))
    if not phrases_of(words):
        return merged([tier(like)], limit)
    matching = with_all(index, words, scope_of(q.language, an.scope(q.source_id, q.sources))).select("paragraph_id")
    return merged([tier(like), tier(rows.join(matching, "paragraph_id", "left_semi"))], limit)


def filtered_rank(q: an.SearchQuery) -> Column:
    """Rank by the fields that are given: code, then title, then the text's matches, each exact before prefix before part."""
    cases: list[Column] = []

    def shades(column: str, value: str) -> list[Column]:
        c = F.col(column)
        return [tx.equals_folded(c, value), tx.starts_folded(c, value), tx.contains_folded(c, value)]

    if q.paragraph is not None:
        here = F.col("number") == q.paragraph
        if q.code:
            cases.append(tx.equals_folded(F.col("code"), q.code) & here)
        if q.text:
            cases += [tx.equals_folded(F.col("code"), q.text) & here, *[x & here for x in shades("title", q.text)]]
        if q.title:
            cases += [x & here for x in shades("title", q.title)]
    if q.code:
        cases += shades("code", q.code)
    if q.text:
        cases += shades("code", q.text)
    if q.title:
        cases += shades("title", q.title)
    if q.text:
        norm = an.normalise(q.text)
        cases += shades("title", q.text)
        cases += [tx.starts_folded(F.col(c), q.text) for c in ("author", "author_full", "source_name")]
        cases += [F.col("search_text") == norm, F.startswith("search_text", F.lit(norm))]
    if q.keyword:
        norm = an.normalise(q.keyword)
        cases += [F.col("search_text") == norm, F.startswith("search_text", F.lit(norm))]
    out = F.lit(len(cases))
    for rank, case in reversed(list(enumerate(cases))):
        out = F.when(F.coalesce(case, F.lit(False)), rank).otherwise(out)
    return out


def browse(lib, author_id: int | None = None, source_id: int | None = None, year: int | None = None, limit: int = 2000, language: str | None = None, sources: Sequence[int] | None = None) -> DataFrame:
    """Works by filters alone, one row each with its first paragraph; works are limited before paragraphs are touched."""
    w = lib.works
    if language is not None:
        w = w.filter(tx.equals_folded(F.col("language"), language))
    w = w.filter(in_list("source_id", an.scope(source_id, sources)))
    for column, value in (("author_id", author_id), ("year", year)):
        if value is not None:
            w = w.filter(F.col(column) == value)
    order = [F.when(F.col("year") > 0, 0).otherwise(1), F.col("year"), F.col("work_date").asc_nulls_first(), F.col("title"), F.col("work_id")]
    page = w.select("work_id", "code", "title", "year", "work_date").orderBy(*order).limit(an.clamp(limit, 1, 2000))
    p = lib.paragraphs.join(page.select("work_id"), "work_id", "left_semi").select("work_id", "number", "paragraph_id", "text")
    out = first_child(page, p, "work_id", [F.col("number")], "left")
    return out.select("work_id", "code", "title", "year", F.coalesce("paragraph_id", F.lit(0)).alias("paragraph_id"), F.coalesce("number", F.lit(1)).alias("number"), tx.preview(F.coalesce("text", F.lit("")), 240).alias("preview"))


def search_paragraphs(lib, text: str, limit: int = 50) -> DataFrame:
    """The repository's search: search text contains the query; by year, date and number."""
    rows = index_of(lib).entries.filter(F.contains("search_text", F.lit(an.normalise(text))))
    order = [F.col("year"), F.col("work_date").asc_nulls_first(), F.col("number"), F.col("paragraph_id")]
    return rows.orderBy(*order).limit(an.clamp(limit, 1, 100)).select("paragraph_id", "work_id", "code", "title", "year", "number", F.substring("text", 1, 240).alias("preview"))


_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_SCORE = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("occurrences", T.IntegerType())])


def scatter(text: str | None, words: list[str]) -> dict[str, int] | None:
    """Score of a normalised text for terms that stand apart; None if one is missing."""
    found = [(m[0], m.start()) for m in _WORD.finditer(text or "")]
    places: dict[str, list[int]] = {}
    for w, at in found:
        places.setdefault(w, []).append(at)
    if any(w not in places for w in words):
        return None
    spans = []
    for i, (w, at) in enumerate(found):
        if w == words[0]:
            rest = iter(found[i + 1 :])
            ends = [next((p for x, p in rest if x == term), None) for term in words[1:]]
            if None not in ends:
                spans.append((ends[-1] if ends else at) - at)
    score = 100_000 + min(spans) if spans else 200_000 + sum(places[w][0] for w in words)
    return {"score": score, "occurrences": max(1, min(len(places[w]) for w in words))}


def scattered_score(words: list[str]):
    """``scatter`` as a pandas UDF over normalised texts."""

    @F.pandas_udf(_SCORE)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [scatter(t, words) if t is not None else None for t in texts]
        return pd.DataFrame({c: pd.array([r[c] if r else None for r in rows], "Int32") for c in ("score", "occurrences")})

    return lambda c: F.when(run(c)["score"].isNotNull(), run(c))


def match_score(text: Column, query: str) -> Column:
    """Score of a text for a query of several terms, smaller is better, null without a match: struct of score and occurrences.

    A phrase scores its position (from 0). Otherwise all terms must occur: 100,000 and the
    length in characters of the shortest run that has the terms in order, or 200,000 and the sum
    of their first positions.
    """
    quoted = an.exact_phrase(query)
    norm = an.normalise(quoted if quoted is not None else query)
    n = tx.normalise_for_search(text)
    words = an.terms(norm)
    phrase = F.instr(n, norm) - 1
    times = (F.length(n) - F.length(F.replace(n, F.lit(norm), F.lit("")))) / F.lit(max(1, len(norm)))
    exact = F.when(phrase >= 0, F.struct(phrase.cast("int").alias("score"), times.cast("int").alias("occurrences")))
    if quoted is not None or not words:
        return exact
    has_all = F.lit(True)
    for w in words:
        has_all = has_all & F.contains(n, F.lit(w))
    scattered = scattered_score(words)
    # Python sees only texts that hold all terms; nested array functions would compute the words anew at every step
    return F.coalesce(exact, scattered(F.when(has_all & (phrase < 0), n)))
