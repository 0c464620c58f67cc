"""Scalar functions over the library model (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.functions import analyze as an
from folianta.functions import dates, names, references
from folianta.functions import text as tx
from folianta.model import Library
from folianta.plans.catalog import SEARCH_TEXT, SONGS, W, WP, query
from folianta.plans.search import _NORM, _NORMED, _tokens

L = Library


@query("h01_clean_extracted")
def h01(lib: L) -> DataFrame:
    return lib.table("documents").select("doc_id", tx.clean_extracted(tx.nfkc(F.col("text"))).alias("clean"), tx.clean_extracted(tx.nfkc(F.col("text")), True).alias("clean_lines"))


_FROM = tx.SPACES + tx.SINGLE_QUOTES + tx.DOUBLE_QUOTES + tx.DASHES + tx.ZERO_WIDTH
_TO = " " * len(tx.SPACES) + "''" * len(tx.SINGLE_QUOTES) + '"' * len(tx.DOUBLE_QUOTES) + "-" * len(tx.DASHES)


@query("h02_unify_characters", rf"SELECT doc_id, regexp_replace(translate(replace(text, '…', '...'), '{_FROM}', '{_TO}'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g') AS unified FROM documents")
def h02(lib: L) -> DataFrame:
    return lib.table("documents").select("doc_id", tx.unify_characters(F.col("text")).alias("unified"))


@query("h03_search_text", f"{WP} SELECT paragraph_id, {SEARCH_TEXT.format('text')} AS search_text FROM paras")
def h03(lib: L) -> DataFrame:
    return lib.searchable.select("paragraph_id", "search_text")


@query("h04_clean_display")
def h04(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", tx.clean_display(F.col("text")).alias("clean"))


@query("h05_letter_spacing")
def h05(lib: L) -> DataFrame:
    return lib.paragraphs.filter(tx.has_letter_spacing(F.col("text"))).select("paragraph_id")


@query("h06_normalise_for_search", f"{WP}, {_NORMED} SELECT paragraph_id, n FROM norm")
def h06(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", tx.normalise_for_search(F.col("text")).alias("n"))


@query("h07_tokens", rf"{WP}, {_NORMED} SELECT paragraph_id, len(w) AS n_tokens, coalesce(w[1], '') AS first_token, coalesce(w[-1], '') AS last_token FROM (SELECT paragraph_id, regexp_extract_all(n, '[\p{{L}}\p{{Nd}}]+(?:''[\p{{L}}\p{{Nd}}]+)*') AS w FROM norm)")
def h07(lib: L) -> DataFrame:
    w = tx.tokens(tx.normalise_for_search(F.col("text")))
    p = lib.paragraphs.select("paragraph_id", w.alias("w"))
    return p.select("paragraph_id", F.size("w").cast("long").alias("n_tokens"), F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("first_token"), F.coalesce(F.get("w", F.size("w") - 1), F.lit("")).alias("last_token"))


_QUERIES = ["faith 12", '"of the"', "47-0412", "December 2020", "dec 196", "2019 march", "mar 20", "plain", "x  0", "june 19 spirit"]


@query("h08_query_analysis", """SELECT * FROM (VALUES ('faith 12', NULL, 'faith', 12, NULL, NULL, NULL), ('"of the"', 'of the', NULL, NULL, NULL, NULL, NULL), ('47-0412', NULL, NULL, NULL, NULL, NULL, NULL),
('December 2020', NULL, 'December', 2020, 'december', 2020, 2020), ('dec 196', NULL, 'dec', 196, 'december', 1960, 1969), ('2019 march', NULL, NULL, NULL, 'march', 2019, 2019), ('mar 20', NULL, 'mar', 20, 'march', 2000, 2029),
('plain', NULL, NULL, NULL, NULL, NULL, NULL), ('x  0', NULL, NULL, NULL, NULL, NULL, NULL), ('june 19 spirit', NULL, NULL, NULL, 'june', 1900, 1999)) AS v(query, phrase, lookup_text, lookup_number, month, low, high)""")  # fmt: skip
def h08(lib: L) -> DataFrame:
    rows = []
    for q in _QUERIES:
        look, date = an.paragraph_lookup(q), an.date_intent(q)
        rows.append((q, an.exact_phrase(q), look and look.text, look and look.number, date and date.month, date and date.low, date and date.high))
    return lib.spark.createDataFrame(rows, "query string, phrase string, lookup_text string, lookup_number int, month string, low int, high int")


@query("h09_song_key", rf"WITH {SONGS} SELECT song_id, section_order, replace(upper(replace(trim(regexp_replace(translate(lower(text), '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), 'ß', chr(1))), chr(1), 'ß') AS key FROM songs")
def h09(lib: L) -> DataFrame:
    return lib.songs.select("song_id", "section_order", tx.song_key_native(F.col("text")).alias("key"))


@query("h09_song_key_full")
def h09_full(lib: L) -> DataFrame:
    return lib.songs.select("song_id", "section_order", tx.song_key(F.col("text")).alias("key"))


@query("h10_parse_references", "SELECT * FROM (VALUES ('Romans 12 1', 45, 12, 1), ('Rom 12 1', 45, 12, 1), ('Romans 12', 45, 12, NULL), ('Jn 3 16', 43, 3, 16), ('Ps 23', 19, 23, NULL), ('Exo 3 15', 2, 3, 15), ('1 Samuel 2:2', 9, 2, 2), ('Jean 3:16', 43, 3, 16), ('Yohana 3:16', 43, 3, 16), ('Genèse 1:1', 1, 1, 1), ('Mwanzo 1:1', 1, 1, 1), ('Nowhere 1:1', NULL, 1, 1)) AS v(ref, book_id, chapter, verse)")
def h10(lib: L) -> DataFrame:
    refs = ["Romans 12 1", "Rom 12 1", "Romans 12", "Jn 3 16", "Ps 23", "Exo 3 15", "1 Samuel 2:2", "Jean 3:16", "Yohana 3:16", "Genèse 1:1", "Mwanzo 1:1", "Nowhere 1:1"]
    df = lib.spark.createDataFrame([(r,) for r in refs], "ref string").withColumn("p", references.reference_parts(F.col("ref")))
    found = df.select("ref", "p.*").withColumnRenamed("key", "alias").join(F.broadcast(references.alias_frame(lib.spark)), "alias", "left")
    return found.select("ref", "book_id", "chapter", "verse")


@query("h11_alias_keys", "SELECT * FROM (VALUES ('First Samuel', 9), ('2nd Kings', 12), ('Song of Solomon', 22), ('songofsolomon', 22), ('Ésaïe', 23), ('Esaie', 23)) AS v(name, book_id)")
def h11(lib: L) -> DataFrame:
    rows = [(n, references.ALIASES.get(references.book_key(n))) for n in ("First Samuel", "2nd Kings", "Song of Solomon", "songofsolomon", "Ésaïe", "Esaie")]
    return lib.spark.createDataFrame(rows, "name string, book_id int")


@query("h12_book_suggestions", "SELECT * FROM (VALUES ('ro', 'Romans'), ('ex', 'Exodus')) AS v(value, book)")
def h12(lib: L) -> DataFrame:
    rows = [(v, references.matching_books(v, 1)[0]) for v in ("ro", "ex")]
    return lib.spark.createDataFrame(rows, "value string, book string")


@query("h13_display_names", "SELECT * FROM (VALUES (1, 'Genèse', 'Mwanzo', 'Genesis'), (43, 'Jean', 'Yohana', 'John'), (66, 'Apocalypse', 'Ufunuo', 'Revelation')) AS v(book_id, fr, sw, other)")
def h13(lib: L) -> DataFrame:
    n = references.name_frame(lib.spark).filter(F.col("book_id").isin(1, 43, 66))
    return n.groupBy("book_id").agg(*[F.max(F.when(F.col("language") == c, F.col("name"))).alias(a) for c, a in (("fr", "fr"), ("sw", "sw"), ("en", "other"))])


@query("h14_date_of_code", """WITH c AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS yy, lpad(CAST(o_orderkey % 13 AS VARCHAR), 2, '0') AS mm, lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') AS dd FROM orders)
SELECT o_orderkey, TRY_CAST((CASE WHEN yy >= '30' THEN '19' ELSE '20' END) || yy || '-' || mm || '-' || dd AS DATE) AS code_date FROM c""")
def h14(lib: L) -> DataFrame:
    two = lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    code = F.concat(two(100), F.lit("-"), two(13), two(32))
    return lib.table("orders").select("o_orderkey", dates.date_of_code(code).alias("code_date"))


@query("h15_month_ranges", "SELECT * FROM (VALUES ('March-April 1998', 1998, 3, 4), ('Summer 1998', 1998, 6, 8), ('décembre 2001', 2001, 12, 12), ('2004-07', 2004, 7, 7), ('2004-17', NULL, NULL, NULL), ('words 1998', NULL, NULL, NULL)) AS v(text, year, first, last)")
def h15(lib: L) -> DataFrame:
    rows = [(t,) for t in ("March-April 1998", "Summer 1998", "décembre 2001", "2004-07", "2004-17", "words 1998")]
    return lib.spark.createDataFrame(rows, "text string").select("text", dates.month_range(F.col("text")).alias("m")).select("text", "m.*")


@query("h16_year_of_path", "SELECT page_id, TRY_CAST(nullif(list_filter(string_split(url, '/'), lambda x: regexp_matches(x, '^[0-9]{4}$') AND x BETWEEN '1800' AND '2200')[1], '') AS INTEGER) AS year FROM pages WHERE NOT regexp_matches(url, '[^0-9][0-9]{4}$') AND NOT regexp_matches(url, '/[0-9]{4}[^0-9/][^/]*$')")
def h16(lib: L) -> DataFrame:
    u = F.col("url")
    p = lib.table("pages").filter(~u.rlike("[^0-9][0-9]{4}$") & ~u.rlike("/[0-9]{4}[^0-9/][^/]*$"))
    return p.select("page_id", dates.year_of_path(u).alias("year"))


@query("h17_language_of_path", f"{W} SELECT work_id, language AS detected FROM works")
def h17(lib: L) -> DataFrame:
    return lib.works.select("work_id", names.language_of_path(F.col("path")).alias("detected"))


@query("h18_publication_code", rf"{W} SELECT work_id, 'CL-' || lpad(CAST(year AS VARCHAR), 4, '0') || '-' || lpad(CAST(coalesce(month(work_date), 0) AS VARCHAR), 2, '0') || '-' || regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{Nd}}]+', '-', 'g'), '^-|-$', '', 'g') AS code FROM works WHERE NOT starts_with(lower(title), 'cl')")
def h18(lib: L) -> DataFrame:
    w = lib.works.filter(~F.lower("title").startswith("cl"))
    return w.select("work_id", names.publication_code("CL", F.col("year"), F.month("work_date"), F.col("title")).alias("code"))


@query("h19_titles", "SELECT * FROM (VALUES ('AB-1234 the_word of life - Published by X', 'the word of life', 'The Word of Life'), ('  on the road. ', 'on the road.', 'On the Road.')) AS v(raw, clean, cased)")
def h19(lib: L) -> DataFrame:
    df = lib.spark.createDataFrame([("AB-1234 the_word of life - Published by X",), ("  on the road. ",)], "raw string")
    return df.select("raw", names.clean_title(F.col("raw")).alias("clean")).withColumn("cased", names.title_case(F.col("clean")))


@query("h22_section_types", f"WITH {SONGS} SELECT song_id, section_order, CASE WHEN section_order % 3 = 0 THEN 'Verse' WHEN section_order % 3 = 1 THEN 'Chorus' ELSE 'Section' END AS kind FROM songs")
def h22(lib: L) -> DataFrame:
    label = F.when(F.col("section_order") % 3 == 0, F.concat((F.col("section_order") + 1).cast("string"), F.lit("."))).when(F.col("section_order") % 3 == 1, "Refrain:").otherwise(F.col("section_type"))
    return lib.songs.select("song_id", "section_order", names.section_type(label).alias("kind"))


@query("h23_content_hash", f"WITH {SONGS} SELECT song_id, upper(sha256(string_agg(section_type || chr(10) || trim(text), chr(10) ORDER BY section_order))) AS hash FROM songs GROUP BY song_id")
def h23(lib: L) -> DataFrame:
    from folianta.operators.relational import ordered_concat

    s = lib.songs.withColumn("t", F.concat_ws("\n", "section_type", F.trim("text")))
    return ordered_concat(s, ["song_id"], "section_order", "t", "\n", "all").select("song_id", F.upper(F.sha2("all", 256)).alias("hash"))


@query("h24_alnum_key", rf"{WP} SELECT paragraph_id, lower(regexp_replace(text, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS key FROM paras")
def h24(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", tx.alnum_key(F.col("text"), upper=False).alias("key"))


@query("h25_shorten", rf"{W}, f AS (SELECT work_id, trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g')) AS t FROM works) SELECT work_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 57)) || '...' END AS short FROM f")
def h25(lib: L) -> DataFrame:
    return lib.works.select("work_id", tx.shorten(F.col("text"), 60).alias("short"))


@query("h26_counts", r"SELECT doc_id, len(list_filter(string_split_regex(text, '[\s\x0B]+'), lambda x: x <> '')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\s\x0B]+', '', 'g') <> '')) AS lines FROM documents")
def h26(lib: L) -> DataFrame:
    return lib.table("documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"), tx.line_count(F.col("text")).cast("long").alias("lines"))


_NUMBERED = "nm AS (SELECT paragraph_id, CASE paragraph_id % 4 WHEN 0 THEN CAST(number AS VARCHAR) || '. ' WHEN 1 THEN CAST(number AS VARCHAR) || ' ' WHEN 2 THEN '0 ' ELSE '' END || text AS text FROM paras)"


@query("h27_leading_number", rf"{WP}, {_NUMBERED} SELECT paragraph_id, CASE WHEN TRY_CAST(nullif(regexp_extract(text, '^\s*(\d{{1,3}})(?:[.)]?\s+)\S', 1), '') AS INTEGER) >= 1 THEN TRY_CAST(nullif(regexp_extract(text, '^\s*(\d{{1,3}})(?:[.)]?\s+)\S', 1), '') AS INTEGER) END AS n FROM nm")
def h27(lib: L) -> DataFrame:
    k, n = F.col("paragraph_id") % 4, F.col("number").cast("string")
    text = F.concat(F.when(k == 0, F.concat(n, F.lit(". "))).when(k == 1, F.concat(n, F.lit(" "))).when(k == 2, "0 ").otherwise(""), F.col("text"))
    return lib.paragraphs.select("paragraph_id", tx.leading_number(text).alias("n"))


@query("h28_ratios", rf"""{WP}, v AS (SELECT paragraph_id, length(regexp_replace(text, '[\s\x0B]', '', 'g')) AS v, length(regexp_replace(text, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS g, length(regexp_replace(text, '[\p{{L}}\p{{Nd}}\s\x0B.,;:!?''"()\[\]/&-]', '', 'g')) AS o FROM paras)
SELECT paragraph_id, round(CASE WHEN v > 0 THEN g / v ELSE 0 END, 6) AS readable, round(CASE WHEN v > 0 THEN o / v ELSE 0 END, 6) AS symbols FROM v""")
def h28(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", F.round(tx.readable_ratio(F.col("text")), 6).alias("readable"), F.round(tx.symbol_ratio(F.col("text")), 6).alias("symbols"))


@query("h29_snippet", f"""{WP}, s AS (SELECT paragraph_id, text, instr(lower(text), 'with') AS hit FROM paras), b AS (SELECT *, greatest(1, hit - 55) AS st FROM s)
SELECT paragraph_id, CASE WHEN hit = 0 THEN CASE WHEN length(text) <= 170 THEN text ELSE substr(text, 1, 170) || '...' END ELSE CASE WHEN st > 1 THEN '...' ELSE '' END || trim(substr(text, st, 170)) || CASE WHEN st + 169 < length(text) THEN '...' ELSE '' END END AS snippet FROM b""")  # fmt: skip
def h29(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", tx.snippet(F.col("text"), "with").alias("snippet"))


@query("h30_editor_notes", rf"{WP} SELECT paragraph_id, text AS shown FROM paras WHERE NOT regexp_matches(text, '^\s*\[')")
def h30(lib: L) -> DataFrame:
    noted = F.concat(F.lit("[Note.] [Blank.]"), F.lit(" [Tape.] "), F.col("text"))
    return lib.paragraphs.filter(~F.col("text").rlike(r"^\s*\[")).select("paragraph_id", tx.without_editor_notes(noted).alias("shown"))


@query("h31_paths", f"{W} SELECT work_id, code AS base, lower(path) AS key FROM works")
def h31(lib: L) -> DataFrame:
    copied = F.regexp_replace(F.replace("path", F.lit("/"), F.lit("\\")), r"\.txt$", " (2).txt")
    return lib.works.select("work_id", names.base_name(copied).alias("base"), names.path_key(copied).alias("key"))


@query("h32_typography", "SELECT doc_id, translate(text, '‘’“”–—', '''''' || chr(34) || chr(34) || '--') AS plain FROM documents")
def h32(lib: L) -> DataFrame:
    # a map of one character to one keeps offsets, so no separate table of places is needed
    return lib.table("documents").select("doc_id", F.translate("text", "‘’“”–—", "''\"\"--").alias("plain"))


@query("h33_email", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(trim(c_name)) || '@example.org' END AS email FROM customer WHERE NOT regexp_matches(trim(c_name), '[\\s@]')")
def h33(lib: L) -> DataFrame:
    raw = F.concat(F.lit("  "), F.col("c_name"), F.when(F.col("c_custkey") % 3 == 0, "@example").otherwise("@Example.org"))
    return lib.table("customer").filter(~F.trim("c_name").rlike(r"[\s@]")).select("c_custkey", tx.email_of(raw).alias("email"))


@query("h34_try_integer", "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS INTEGER) AS n FROM pages")
def h34(lib: L) -> DataFrame:
    return lib.table("pages").select("page_id", F.regexp_extract("url", "([0-9]+)", 1).try_cast("int").alias("n"))
