"""Search, browse and navigation over the library model (I)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.functions import analyze as an
from folianta.functions import text as tx
from folianta.functions.references import BOOKS, parse_reference
from folianta.model import Library
from folianta.operators import index as ix
from folianta.operators import relational as op
from folianta.operators import search as se
from folianta.plans.catalog import AUTHORS, PARAS, SEARCH_TEXT, SONGS, SOURCES, VERSES, WORKS, W, WP, query

L = Library

#: Query texts of the registered searches; words of the test texts.
SEVERAL, SINGLE, PHRASE = "the and", "that", '"and the"'

_FOLD = f"translate(lower({{}}), '{tx.ACCENTED}', '{tx.PLAIN}')"
_TOKENS = rf"list_filter(string_split_regex({_FOLD}, '[^\p{{{{L}}}}\p{{{{Nd}}}}]+'), lambda x: x <> '')"


def _tokens(c: str) -> str:
    return _TOKENS.format(f"coalesce({c}, '')").replace("{{", "{").replace("}}", "}")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WIDE = f"""wide AS (
  SELECT p.*, {SEARCH_TEXT.format("p.text")} AS search_text, w.code, w.title, w.year, w.work_date, w.author_id, a.display_name AS author, a.full_name AS author_full, s.display_name AS source_name, s.name AS source_short
  FROM paras p JOIN works w ON p.work_id = w.work_id LEFT JOIN authors a ON w.author_id = a.author_id LEFT JOIN sources s ON w.source_id = s.source_id
)"""
IDX = "idx AS (SELECT *, " + ", ".join(f"' ' || array_to_string({_tokens(c)}, ' ') || ' ' AS t_{c}" for c in se.INDEXED) + ", " + " || ".join(_tokens(c) for c in se.INDEXED) + " AS tokens FROM wide)"
BASE = f"WITH {WORKS}, {PARAS}, {SOURCES}, {AUTHORS}, {WIDE}"
_CANON = "CASE WHEN year > 0 THEN 0 ELSE 1 END, year, work_date NULLS FIRST, title, number, paragraph_id"
_PREVIEW = "CASE WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 240) || '...' END AS preview"


def _phrase(words: str) -> str:
    return "(" + " OR ".join(f"contains(t_{c}, ' {words} ')" for c in se.INDEXED) + ")"


def _all(words: list[str]) -> str:
    return " AND ".join(f"list_contains(tokens, '{w}')" for w in words)


def _scored(words: list[str]) -> str:
    """CTEs st and scored: BM25 over idx."""
    df = ", ".join(f"CAST(count(*) FILTER (list_contains(tokens, '{w}')) AS DOUBLE) AS df{i}" for i, w in enumerate(words))
    tf = lambda w: f"len(list_filter(tokens, lambda x: x = '{w}'))"
    one = [f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * {tf(w)} * {se.K1 + 1} / ({tf(w)} + {se.K1} * (1 - {se.B} + {se.B} * len(tokens) / al))" for i, w in enumerate(words)]
    return f"st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tokens)) AS al, {df} FROM idx), scored AS (SELECT idx.*, round({' + '.join(one)}, {se.PLACES}) AS score FROM idx, st)"


def _like(c: str, part: str) -> str:
    return f"coalesce(contains({_LOW.format(c)}, '{part}'), false)"


def _meta(part: str) -> str:
    return "(" + " OR ".join(_like(c, part) for c in ("title", "code", "author", "author_full", "source_name", "source_short")) + ")"


def _rank(text: str) -> str:
    low, norm = text.lower(), text.upper()
    starts = lambda c: f"starts_with({_LOW.format(c)}, '{low}')"
    cases = [(0, f"{_LOW.format('code')} = '{low}'"), (1, f"{_LOW.format('title')} = '{low}'"), (5, starts("code")), (6, starts("title")), (7, _like("code", low)), (8, _like("title", low)),
             (9, starts("author")), (10, starts("author_full")), (11, starts("source_name")), (12, f"search_text = '{norm}'"), (13, f"starts_with(search_text, '{norm}')")]
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for r, c in cases) + " ELSE 14 END"


def _merge(parts: list[tuple[str, str]], limit: int) -> str:
    """Merge (relation, order) parts as the search does."""
    union = " UNION ALL ".join(f"SELECT paragraph_id, work_id, code, title, year, number, {_PREVIEW}, {i} AS tier, CAST(row_number() OVER (ORDER BY {o}) AS DOUBLE) AS pos FROM {r}" for i, (r, o) in enumerate(parts))
    return f"SELECT paragraph_id, work_id, code, title, year, number, preview, tier FROM (SELECT *, row_number() OVER (PARTITION BY paragraph_id ORDER BY tier, pos) AS rn FROM ({union})) WHERE rn = 1 ORDER BY tier, pos LIMIT {limit}"


@query("i01_search_several_terms", f"""{BASE}, {IDX}, {_scored(["the", "and"])}, ph AS (SELECT * FROM idx WHERE {_phrase("the and")} ORDER BY paragraph_id LIMIT 50),
tm AS (SELECT * FROM scored WHERE {_all(["the", "and"])} ORDER BY score DESC, paragraph_id LIMIT 50) {_merge([("ph", "paragraph_id"), ("tm", "score DESC, paragraph_id")], 50)}""")  # fmt: skip
def i01(lib: L) -> DataFrame:
    return se.search_free_text(lib, SEVERAL, 50).drop("place")


@query("i01_search_single_term", f"""{BASE}, {IDX}, {_scored(["idiot"])}, tm AS (SELECT * FROM scored WHERE {_all(["idiot"])} ORDER BY score DESC, paragraph_id LIMIT 250),
mt AS (SELECT *, {_rank("idiot")} AS rk FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY number) AS rn FROM wide WHERE {_meta("idiot")}) WHERE rn = 1 ORDER BY rk, {_CANON} LIMIT 250),
mf AS (SELECT * FROM mt WHERE (SELECT count(*) FROM tm) < 250) {_merge([("mf", f"rk, {_CANON}"), ("tm", "score DESC, paragraph_id")], 250)}""")  # fmt: skip
def i01_single(lib: L) -> DataFrame:
    return se.search_free_text(lib, "Idiot", 250).drop("place")


@query("i01_search_quoted_phrase", f"""{BASE}, {IDX}, ph AS (SELECT * FROM idx WHERE {_phrase("and the")} ORDER BY paragraph_id LIMIT 20),
mt AS (SELECT *, {_rank("and the")} AS rk FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY number) AS rn FROM wide WHERE {_meta("and the")}) WHERE rn = 1 ORDER BY rk, {_CANON} LIMIT 20),
mf AS (SELECT * FROM mt WHERE (SELECT count(*) FROM ph) < 20) {_merge([("mf", f"rk, {_CANON}"), ("ph", "paragraph_id")], 20)}""")  # fmt: skip
def i01_quoted(lib: L) -> DataFrame:
    return se.search_free_text(lib, PHRASE, 20).drop("place")


@query("g02_computed_rank", f"{BASE} SELECT paragraph_id, {_rank('the')} AS rk FROM wide")
def g02(lib: L) -> DataFrame:
    return se.index_of(lib).entries.select("paragraph_id", se.simple_rank("the").alias("rk"))


def _shades(c: str, part: str) -> list[str]:
    return [f"{_LOW.format(c)} = '{part}'", f"starts_with({_LOW.format(c)}, '{part}')", f"contains({_LOW.format(c)}, '{part}')"]


_G03 = [f"number = 2 AND {x}" for x in (_shades("code", "d-000002")[0], _shades("code", "the")[0], *_shades("title", "the"))]
_G03 += [*_shades("code", "d-000002"), *_shades("code", "the"), *_shades("title", "the"), *[_shades(c, "the")[1] for c in ("author", "author_full", "source_name")]]
_G03 += ["search_text = 'THE'", "starts_with(search_text, 'THE')", "search_text = 'AND'", "starts_with(search_text, 'AND')"]


@query("g03_rank_by_filters", f"{BASE} SELECT paragraph_id, CASE {' '.join(f'WHEN {c} THEN {i}' for i, c in enumerate(_G03))} ELSE {len(_G03)} END AS rk FROM wide")
def g03(lib: L) -> DataFrame:
    q = an.SearchQuery(text="the", code="D-000002", keyword="and", paragraph=2)
    return se.index_of(lib).entries.select("paragraph_id", se.filtered_rank(q).alias("rk"))


@query("i02_search_structured", f"""{BASE}, {IDX}, r AS (SELECT *, CASE WHEN {_LOW.format("title")} = 'the' THEN 0 WHEN starts_with({_LOW.format("title")}, 'the') THEN 1 WHEN contains({_LOW.format("title")}, 'the') THEN 2
  WHEN search_text = 'AND' THEN 3 WHEN starts_with(search_text, 'AND') THEN 4 ELSE 5 END AS rk FROM idx WHERE author_id = 1 AND contains({_LOW.format("title")}, 'the')),
a AS (SELECT * FROM r WHERE contains(search_text, 'AND') ORDER BY rk, {_CANON} LIMIT 50), b AS (SELECT * FROM r WHERE list_contains(tokens, 'and') ORDER BY rk, {_CANON} LIMIT 50)
{_merge([("a", f"rk, {_CANON}"), ("b", f"rk, {_CANON}")], 50)}""")  # fmt: skip
def i02(lib: L) -> DataFrame:
    return se.search_structured(lib, an.SearchQuery(title="the", keyword="and", author_id=1, limit=50)).drop("place")


@query("i03_browse", f"""{WP}, top AS (SELECT * FROM works WHERE source_id IN (1, 2, 3) AND {_LOW.format("language")} = 'en' ORDER BY CASE WHEN year > 0 THEN 0 ELSE 1 END, year, work_date NULLS FIRST, title, work_id LIMIT 40),
f AS (SELECT * FROM paras WHERE number = 1) SELECT t.work_id, t.code, t.title, t.year, coalesce(f.paragraph_id, 0) AS paragraph_id, coalesce(f.number, 1) AS number,
CASE WHEN length(coalesce(f.text, '')) <= 240 THEN coalesce(f.text, '') ELSE substr(f.text, 1, 240) || '...' END AS preview FROM top t LEFT JOIN f ON t.work_id = f.work_id""")  # fmt: skip
def i03(lib: L) -> DataFrame:
    return se.browse(lib, limit=40, language="EN", sources=[3, 1, 2])


@query("i04_all_terms", f"{BASE}, {IDX} SELECT paragraph_id FROM idx WHERE {_all(['idiot', 'the'])}")
def i04(lib: L) -> DataFrame:
    return se.with_all(se.index_of(lib), ["IDIOT", "THE"]).select("paragraph_id")


@query("i05_phrase_in_column", f"{BASE}, {IDX} SELECT paragraph_id FROM idx WHERE {_phrase('source 3')} OR {_phrase('of the')}")
def i05(lib: L) -> DataFrame:
    return ix.lookup(se.index_of(lib), [["source", "3"], ["of", "the"]]).filter("match_0 OR match_1").select("paragraph_id")


@query("i06_source_filter_first", f"{BASE}, {IDX} SELECT paragraph_id FROM idx WHERE source_id IN (4, 5) AND list_contains(tokens, 'the')")
def i06(lib: L) -> DataFrame:
    return se.with_all(se.index_of(lib), ["THE"], se.scope_of(None, [5, 4])).select("paragraph_id")


@query("i07_bm25", f"{BASE}, {IDX}, {_scored(['that', 'with'])} SELECT paragraph_id, score FROM scored WHERE score > 0 ORDER BY score DESC, paragraph_id LIMIT 200")
def i07(lib: L) -> DataFrame:
    index = se.index_of(lib)
    scored = se.bm25(index, ix.lookup(index, [["that"], ["with"]]), ["THAT", "WITH"])
    return scored.filter("score > 0").select("paragraph_id", "score").orderBy(F.desc("score"), "paragraph_id").limit(200)


@query("i08_metadata_fallback", f"{BASE} SELECT paragraph_id, work_id, {_rank('source 1')} AS rk FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY number) AS rn FROM wide WHERE {_meta('source 1')}) WHERE rn = 1 ORDER BY rk, {_CANON} LIMIT 60")
def i08(lib: L) -> DataFrame:
    return se.metadata_tier(se.wide(lib), "Source 1", 60).select("paragraph_id", "work_id", se.simple_rank("Source 1").alias("rk"))


@query("i09_like_fallback", f"{BASE} SELECT paragraph_id, {_rank('1955')} AS rk FROM wide WHERE {_meta('1955')} OR year = 1955 OR number = 1955 OR contains(search_text, '1955') ORDER BY rk, {_CANON} LIMIT 80")
def i09(lib: L) -> DataFrame:
    return se.like_tier(se.wide(lib), "1955", 80).select("paragraph_id", se.simple_rank("1955").alias("rk"))


@query("i10_text_and_keyword", f"{BASE}, {IDX} SELECT paragraph_id FROM idx WHERE {_all(['the', 'with', 'idiot'])}")
def i10(lib: L) -> DataFrame:
    return se.with_all(se.index_of(lib), an.terms(an.normalise("The with" + " " + "idiot"))).select("paragraph_id")


@query("i11_scope_inside_limit", f"{BASE}, {IDX}, w2 AS (SELECT * FROM idx WHERE source_id = 7 AND {_LOW.format('language')} = 'en' AND {_phrase('of the')} ORDER BY paragraph_id LIMIT 15) SELECT paragraph_id, source_id FROM w2")
def i11(lib: L) -> DataFrame:
    index = se.index_of(lib)
    return se.fetched(index, se.phrase_tier(index, ["of", "the"], 15, se.scope_of("En", [7]))).select("paragraph_id", "source_id")


@query("i12_merge_tiers", f"{BASE}, {IDX}, {_scored(['the'])}, a AS (SELECT * FROM idx WHERE {_phrase('of the')} ORDER BY paragraph_id LIMIT 30), b AS (SELECT * FROM scored WHERE list_contains(tokens, 'the') ORDER BY score DESC, paragraph_id LIMIT 30) {_merge([('a', 'paragraph_id'), ('b', 'score DESC, paragraph_id')], 40)}")
def i12(lib: L) -> DataFrame:
    index = se.index_of(lib)
    return se.merged([se.fetched(index, se.phrase_tier(index, ["of", "the"], 30)), se.fetched(index, se.terms_tier(index, ["THE"], 30))], 40).drop("place")


_NORM = r"trim(regexp_replace(replace(translate(text, '‘’‚‛`´', ''''''''''''''), '''', chr(1)), '[\p{P}\p{S}\p{Z}\t\n\x0B\f\r]+', ' ', 'g'))"
_NORMED = f"norm AS (SELECT paragraph_id, work_id, number, replace(replace(upper(replace({_NORM}, 'ß', chr(2))), chr(2), 'ß'), chr(1), '''') AS n FROM paras)"


@query("i13_phrase_score", f"{WP}, {_NORMED} SELECT paragraph_id, CAST(instr(n, 'OF THE') - 1 AS INTEGER) AS score, CAST((length(n) - length(replace(n, 'OF THE', ''))) / 6 AS INTEGER) AS occurrences FROM norm WHERE contains(n, 'OF THE')")
def i13(lib: L) -> DataFrame:
    scored = lib.paragraphs.select("paragraph_id", se.match_score(F.col("text"), '"of the"').alias("m")).filter("m IS NOT NULL")
    return scored.select("paragraph_id", "m.score", "m.occurrences")


@query("i13_scattered_score")
def i13_scattered(lib: L) -> DataFrame:
    scored = lib.paragraphs.select("paragraph_id", se.match_score(F.col("text"), "idiot the of").alias("m")).filter("m IS NOT NULL")
    return scored.select("paragraph_id", "m.score", "m.occurrences")


@query("i14_within_work", f"{WP}, {_NORMED} SELECT number, CAST(instr(n, 'THE') - 1 AS INTEGER) AS score FROM norm WHERE work_id = (SELECT min(work_id) FROM works WHERE language = 'en') AND contains(n, 'THE') ORDER BY score, number")
def i14(lib: L) -> DataFrame:
    first = lib.works.filter("language = 'en'").agg(F.min("work_id").alias("i")).scalar()
    p = lib.paragraphs.filter(F.col("work_id") == first).select("number", se.match_score(F.col("text"), '"the"').alias("m"))
    return p.filter("m IS NOT NULL").select("number", "m.score").orderBy("score", "number")


@query("i15_highlight_ranges")
def i15(lib: L) -> DataFrame:
    from folianta.operators.highlight import highlights

    p = lib.paragraphs.filter(F.lower("text").contains("idiot"))
    return p.select("paragraph_id", highlights("of the")(F.col("text")).alias("ranges")).select("paragraph_id", F.array_join(F.transform("ranges", lambda r: F.concat_ws("+", r["start"].cast("string"), r["length"].cast("string"))), ",").alias("ranges"))


@query("i16_verse_by_reference", f"WITH {VERSES} SELECT chapter, verse, text FROM verses WHERE book_id = 2 AND chapter = 1 ORDER BY verse, text")
def i16(lib: L) -> DataFrame:
    # the verse number doesn't restrict: the whole chapter is shown
    ref = parse_reference("Exodus 1:3")
    v = lib.verses.filter((F.col("book_id") == ref.book_id) & (F.col("chapter") == ref.chapter))
    return v.select("chapter", "verse", "text").orderBy("verse", "text")


@query("i16_verse_by_text", f"WITH {VERSES} SELECT book_id, chapter, verse, text FROM verses WHERE contains(upper(text), 'PART 12 ') ORDER BY book_id, chapter, verse, text LIMIT 100")
def i16_text(lib: L) -> DataFrame:
    return lib.verses.filter(F.upper("text").contains("PART 12 ")).orderBy("book_id", "chapter", "verse", "text").limit(100)


@query("i17_translation_choice", "SELECT coalesce((SELECT min(n_nationkey) FROM nation WHERE n_nationkey = 99), (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 2), 1) AS translation_id")
def i17(lib: L) -> DataFrame:
    n = lib.table("nation")
    by_id = n.filter("n_nationkey = 99").agg(F.min("n_nationkey").alias("i")).scalar()
    by_language = n.filter("n_regionkey = 2").agg(F.min("n_nationkey").alias("i")).scalar()
    return lib.spark.range(1).select(F.coalesce(by_id, by_language, F.lit(1)).alias("translation_id"))


@query("i18_verse_navigation", f"WITH {VERSES} SELECT book_id, chapter, count(*) AS verses FROM verses WHERE book_id = 1 GROUP BY ALL ORDER BY chapter LIMIT 50")
def i18(lib: L) -> DataFrame:
    from folianta.functions.references import navigate

    target = navigate("gen", current_book=None)
    v = lib.verses.filter(F.col("book_id") == target.book_id)
    return v.groupBy("book_id", "chapter").agg(F.count("*").alias("verses")).orderBy("chapter").limit(50)




@query("i19_song_search", f"""WITH {SONGS}, k AS (SELECT song_id, section_order, trim(regexp_replace(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n FROM songs),
t AS (SELECT song_id, n AS title FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY section_order) AS rn FROM k) WHERE rn = 1),
m AS (SELECT song_id, min(section_order) AS hit FROM k WHERE contains(n, 'the and') GROUP BY song_id)
SELECT m.song_id, m.hit AS section_order, CASE WHEN title = 'the and' THEN 0 WHEN starts_with(title, 'the and') THEN 1 WHEN contains(title, 'the and') THEN 2 ELSE 3 END AS rk FROM m JOIN t ON m.song_id = t.song_id ORDER BY rk, m.song_id LIMIT 150""")  # fmt: skip
def i19(lib: L) -> DataFrame:
    # the terms are implied by the whole phrase, so the phrase alone decides
    phrase = an.normalise("The, and").lower()
    k = lib.songs.select("song_id", "section_order", F.lower(tx.song_key_native(F.col("text"))).alias("n"))
    title = op.keep_one(k, ["song_id"], [F.col("section_order")]).select("song_id", F.col("n").alias("title"))
    hit = k.filter(F.contains("n", F.lit(phrase))).groupBy("song_id").agg(F.min("section_order").alias("section_order"))
    rank = F.when(F.col("title") == phrase, 0).when(F.startswith("title", F.lit(phrase)), 1).when(F.contains("title", F.lit(phrase)), 2).otherwise(3)
    return hit.join(title, "song_id").select("song_id", "section_order", rank.alias("rk")).orderBy("rk", "song_id").limit(150)


@query("i20_song_browse", f"WITH {SONGS} SELECT song_id, section_order, CASE WHEN length(text) <= 220 THEN text ELSE substr(text, 1, 220) || '...' END AS preview FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY section_order) AS rn FROM songs) WHERE rn = 1 ORDER BY song_id LIMIT 150")
def i20(lib: L) -> DataFrame:
    ids = lib.songs.select("song_id").distinct().orderBy("song_id").limit(150)
    first = op.first_child(ids, lib.songs.join(ids, "song_id", "left_semi"), "song_id", [F.col("section_order")], "left")
    return first.select("song_id", "section_order", tx.preview(F.col("text"), 220).alias("preview"))


@query("i21_repository_search", f"{BASE} SELECT paragraph_id, work_id, code, title, year, number, substr(text, 1, 240) AS preview FROM wide WHERE contains(search_text, 'OF THE') ORDER BY year, work_date NULLS FIRST, number, paragraph_id LIMIT 100")
def i21(lib: L) -> DataFrame:
    return se.search_paragraphs(lib, "of the", 500)


@query("i22_facets", f"{W} SELECT 'source' AS facet, CAST(source_id AS VARCHAR) AS value FROM works WHERE author_id = 2 GROUP BY ALL UNION ALL SELECT 'author', CAST(author_id AS VARCHAR) FROM works WHERE source_id IN (1, 2) GROUP BY ALL UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM works WHERE author_id = 2 AND year > 0 GROUP BY ALL")
def i22(lib: L) -> DataFrame:
    w = lib.works.select("source_id", "author_id", "year")
    parts = [("source", w.filter("author_id = 2").select("source_id")), ("author", w.filter("source_id IN (1, 2)").select("author_id")), ("year", w.filter("author_id = 2 AND year > 0").select("year"))]
    out = None
    for name, part in parts:
        one = part.distinct().select(F.lit(name).alias("facet"), F.col(part.columns[0]).cast("string").alias("value"))
        out = one if out is None else out.union(one)
    return out


@query("i23_favourite_flag", f"{W} SELECT work_id, work_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS favourite FROM works")
def i23(lib: L) -> DataFrame:
    return lib.works.select("work_id").join(lib.favourites.withColumn("f", F.lit(True)), "work_id", "left").select("work_id", F.col("f").isNotNull().alias("favourite"))


@query("i24_group_hits", f"{WP} SELECT work_id, count(*) AS hits, min(number) AS first_number FROM paras WHERE contains(lower(text), 'of the') GROUP BY work_id ORDER BY hits DESC, work_id LIMIT 200")
def i24(lib: L) -> DataFrame:
    hits = lib.paragraphs.filter(F.lower("text").contains("of the"))
    return hits.groupBy("work_id").agg(F.count("*").alias("hits"), F.min("number").alias("first_number")).orderBy(F.desc("hits"), "work_id").limit(200)


@query("i26_cli_search", f"""{BASE}, r AS (SELECT *, CASE WHEN starts_with({_LOW.format("title")}, 'the') AND {_LOW.format("title")} = 'the' AND number = 1 THEN 0 WHEN starts_with({_LOW.format("title")}, 'the') AND number = 1 THEN 1
WHEN contains({_LOW.format("title")}, 'the') AND number = 1 THEN 2 ELSE 3 END AS rk FROM wide WHERE number = 1 AND contains({_LOW.format("title")}, 'the')) SELECT paragraph_id, code, number FROM r ORDER BY rk, {_CANON} LIMIT 20""")  # fmt: skip
def i26(lib: L) -> DataFrame:
    from folianta.cli import query_of

    return se.search_structured(lib, query_of(["--title", "the", "--paragraph", "1"])).select("paragraph_id", "code", "number")


@query("n06_matching_books")
def n06(lib: L) -> DataFrame:
    from folianta.functions.references import matching_books

    rows = [(v, i, b) for v in ("ro", "ex", "1 s", "jo") for i, b in enumerate(matching_books(v), 1)]
    return lib.spark.createDataFrame(rows, "value string, place int, book string")


@query("o01_books", "SELECT count(*) AS n FROM (SELECT unnest(range(1, 67)))")
def o01(lib: L) -> DataFrame:
    return lib.spark.createDataFrame([(b,) for b in BOOKS], "name string").agg(F.count("*").alias("n"))
