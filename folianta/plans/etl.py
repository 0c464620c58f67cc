"""Document transforms over the library model (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianta.functions import text as tx
from folianta.model import Library, lines_of
from folianta.operators import etl, metadata, mutations, songs
from folianta.operators import relational as op
from folianta.plans.catalog import COLLAPSED_UPPER, SONGS, VERSES, WORKS, W, WP, query

L = Library


def _pages(lib: L) -> DataFrame:
    """Pages of four paragraphs each, the paragraphs as blocks; every third number is printed before its paragraph."""
    p = lib.paragraphs
    printed = F.when(F.col("number") % 3 == 0, F.concat(F.col("number").cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    q = p.select("work_id", F.expr("cast((number - 1) div 4 + 1 as int)").alias("page"), "number", printed.alias("t"))
    return op.ordered_concat(q, ["work_id", "page"], "number", "t", "\n\n", "text")


_FILES = "f AS (SELECT work_id AS file_id, CASE WHEN work_id % 10 = 3 THEN '/library/copy/' || (work_id // 20) || '.txt' ELSE path END AS path, CASE WHEN work_id % 10 = 4 THEN 'D-' || (work_id // 30) ELSE code END AS code, author_id, source_id, length(text) AS size, sha256(coalesce(text, '')) AS hash FROM works)"


@query("j01_import_status", f"""{W}, {_FILES}, k AS (SELECT path FROM works WHERE work_id % 13 = 0),
a AS (SELECT lower(path) AS p, min(file_id) AS i FROM f GROUP BY ALL HAVING count(*) > 1), c AS (SELECT author_id, source_id, code, min(file_id) AS i FROM f WHERE author_id IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1), b AS (SELECT size, hash, min(file_id) AS i FROM f GROUP BY ALL HAVING count(*) > 1)
SELECT f.file_id, CASE WHEN lower(f.path) IN (SELECT lower(path) FROM k) THEN 'exists' WHEN a.i < f.file_id THEN 'browser_copy' WHEN c.i < f.file_id THEN 'duplicate_code' WHEN b.i < f.file_id THEN 'duplicate_bytes' ELSE 'import' END AS status
FROM f LEFT JOIN a ON lower(f.path) = a.p LEFT JOIN c ON f.author_id = c.author_id AND f.source_id = c.source_id AND f.code = c.code LEFT JOIN b ON f.size = b.size AND f.hash = b.hash""")  # fmt: skip
def j01(lib: L) -> DataFrame:
    i = F.col("work_id")
    w = lib.works.select(
        i.alias("file_id"), F.when(i % 10 == 3, F.concat(F.lit("/library/copy/"), F.expr("work_id div 20").cast("string"), F.lit(".txt"))).otherwise(F.col("path")).alias("path"),
        F.when(i % 10 == 4, F.concat(F.lit("D-"), F.expr("work_id div 30").cast("string"))).otherwise(F.col("code")).alias("code"), "author_id", "source_id", F.length("text").alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"),
    )
    return etl.import_status(w, lib.works.filter("work_id % 13 = 0").select("path")).select("file_id", "status")


@query("j02_split_pages")
def j02(lib: L) -> DataFrame:
    return etl.candidates(_pages(lib))


@query("j02_numbered_drafts")
def j02_drafts(lib: L) -> DataFrame:
    joined = etl.rejoin(etl.candidates(_pages(lib)))
    return op.fallback_number(joined, ["work_id"], "pos", "detected").select("work_id", "number", "page", "text", F.col("detected").isNotNull().alias("has_number"))


@query("j03_sentence_packing")
def j03(lib: L) -> DataFrame:
    flat = tx.flatten_spaces(F.coalesce("text", F.lit("")))
    return lib.works.select("work_id", F.posexplode(etl.pack_sentences(flat)).alias("chunk", "text"))


@query("j04_numbered_split")
def j04(lib: L) -> DataFrame:
    return _pages(lib).select("work_id", "page", F.size(etl.split_numbered(F.col("text"))).alias("parts"))


@query("j05_rejoin_page_breaks")
def j05(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", F.expr("cast((number - 1) div 2 + 1 as int)").alias("page"), F.col("number").cast("long").alias("pos"), F.lit(None).cast("int").alias("detected"), F.regexp_replace("text", "[.]$", "").alias("text"))
    return etl.rejoin(p).select("work_id", "page", "pos", F.length("text").alias("n"))


@query("j06_running_heads", f"{WP} SELECT paragraph_id FROM paras p WHERE NOT (length(text) <= 32 AND (work_id, {COLLAPSED_UPPER.format('text')}) IN (SELECT (work_id, {COLLAPSED_UPPER.format('text')}) FROM paras WHERE length(text) <= 32 GROUP BY work_id, {COLLAPSED_UPPER.format('text')} HAVING count(*) >= 2))")
def j06(lib: L) -> DataFrame:
    p = lib.paragraphs.withColumn("key", tx.collapsed_upper(F.col("text")))
    heads = op.duplicate_keys(p.filter(F.length("text") <= 32), ["work_id", "key"]).select("work_id", "key").withColumn("head", F.lit(True))
    return p.join(heads, ["work_id", "key"], "left").filter(~(F.col("head").isNotNull() & (F.length("text") <= 32))).select("paragraph_id")


@query("j07_accepted_numbers")
def j07(lib: L) -> DataFrame:
    d = F.when((F.col("paragraph_id") * 31) % 3 == 0, ((F.col("paragraph_id") * 17) % 9 + F.expr("number div 2")).cast("int"))
    return etl.accepted_numbers(lib.paragraphs.select("work_id", F.col("number").cast("long").alias("pos"), d.alias("detected")))


def _judged(lib: L) -> DataFrame:
    return etl.verdicts(lib.paragraphs.select("work_id", "number", "paragraph_id", "text", F.expr("cast(number div 4 as int)").alias("page")))


_VERDICT = rf"""v0 AS (SELECT work_id, number, paragraph_id, text, number // 4 AS page, CASE WHEN length(text) <= 140 AND length({COLLAPSED_UPPER.format("text")}) >= 3 THEN {COLLAPSED_UPPER.format("text")} ELSE '' END AS k FROM paras),
hd AS (SELECT work_id, k FROM v0 WHERE k <> '' GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT page) >= 2 AND (regexp_matches(k, '\b(CIRCULAR LETTER|MISSION CENTER|POSTFACH|WWW[.]|HTTP|E-MAIL|EMAIL|FAX|TELEPHONE|PHONE|PAGE)') OR (length(k) <= 32 AND len(list_filter(string_split_regex(k, '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')) <= 4))),
v1 AS (SELECT v0.*, length(regexp_replace(text, '[\s\x0B]', '', 'g')) AS vis, length(regexp_replace(text, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS good, length(regexp_replace(text, '[\p{{L}}\p{{Nd}}\s\x0B.,;:!?''"()\[\]/&-]', '', 'g')) AS odd, len(list_filter(string_split_regex(text, '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')) AS words, hd.k IS NOT NULL AS head FROM v0 LEFT JOIN hd ON v0.work_id = hd.work_id AND v0.k = hd.k),
judged AS (SELECT work_id, number, paragraph_id, CASE WHEN trim(text) = '' THEN 'too_short' WHEN regexp_matches(lower(text), '^(page\s*)?\d{{1,3}}$') THEN 'page_number'
WHEN regexp_matches(text, '[#@$%^*_+=~`|\\<>]{{3,}}|["'']?#[$%]["'']?') OR (vis >= 5 AND good / vis < 0.45 AND odd / vis > 0.25) OR (vis >= 12 AND odd / vis > 0.45) THEN 'corrupted' WHEN head THEN 'header_footer' WHEN good < 8 OR (words < 2 AND length(text) < 24) THEN 'too_short' ELSE 'accepted' END AS verdict FROM v1)"""


@query("j08_quality_verdicts", f"{WP}, {_VERDICT} SELECT paragraph_id, verdict FROM judged")
def j08(lib: L) -> DataFrame:
    return _judged(lib).select("paragraph_id", "verdict")


@query("j08_renumbered", f"{WP}, {_VERDICT} SELECT paragraph_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY number) AS INTEGER) AS renumbered FROM judged WHERE verdict = 'accepted'")
def j08_numbers(lib: L) -> DataFrame:
    from pyspark.sql.window import Window

    accepted = _judged(lib).filter("verdict = 'accepted'")
    return accepted.select("paragraph_id", F.row_number().over(Window.partitionBy("work_id").orderBy("number")).alias("renumbered"))


@query("j09_repeated_headers", f"{WP}, {_VERDICT} SELECT work_id, k AS header_key FROM hd")
def j09(lib: L) -> DataFrame:
    return etl.repeated_headers(lib.paragraphs.select("work_id", "text", F.expr("cast(number div 4 as int)").alias("page")))


@query("j10_quality_summary", f"{WP}, {_VERDICT} SELECT work_id, count(*) AS paragraphs, count(*) FILTER (verdict = 'accepted') AS accepted, count(*) FILTER (verdict = 'page_number') AS page_number, count(*) FILTER (verdict = 'corrupted') AS corrupted, count(*) FILTER (verdict = 'header_footer') AS header_footer, count(*) FILTER (verdict = 'too_short') AS too_short FROM judged GROUP BY work_id")
def j10(lib: L) -> DataFrame:
    return etl.quality_summary(_judged(lib))


@query("j11_duplicate_codes", f"{W}, c AS (SELECT work_id, author_id, source_id, 'C' || (work_id // 25) AS code FROM works) SELECT work_id, min(work_id) OVER (PARTITION BY author_id, source_id, code) AS original FROM c WHERE author_id IS NOT NULL AND source_id IS NOT NULL")
def j11(lib: L) -> DataFrame:
    w = lib.works.filter("author_id IS NOT NULL AND source_id IS NOT NULL").select("work_id", "author_id", "source_id", F.concat(F.lit("C"), F.expr("work_id div 25").cast("string")).alias("code"))
    return etl.with_original(w, ["author_id", "source_id", "code"], "work_id").select("work_id", "original")


@query("j12_duplicate_bytes", f"{W} SELECT work_id, min(work_id) OVER (PARTITION BY octet_length(encode(text)), sha256(text)) AS original FROM works WHERE text IS NOT NULL")
def j12(lib: L) -> DataFrame:
    # sizes first: only works that share one are hashed
    sized = lib.works.filter("text IS NOT NULL").select("work_id", "text", F.octet_length("text").alias("size"))
    shared = op.duplicate_keys(sized.select("size"), ["size"]).select("size")
    hashed = sized.join(shared, "size", "left_semi").select("work_id", "size", F.sha2("text", 256).alias("hash"))
    firsts = etl.with_original(hashed, ["size", "hash"], "work_id").select("work_id", "original")
    return sized.select("work_id").join(firsts, "work_id", "left").select("work_id", F.coalesce("original", "work_id").alias("original"))


@query("j13_duplicate_content", f"{WP}, h AS (SELECT work_id, sha256(string_agg(text, chr(30) ORDER BY number)) AS hash FROM paras GROUP BY work_id) SELECT work_id, min(work_id) OVER (PARTITION BY hash) AS original FROM h")
def j13(lib: L) -> DataFrame:
    # a work's paragraphs stand in one row already, so nothing is collected to join them
    h = lib.works.select("work_id", lines_of(F.col("text")).alias("ps")).filter(F.size("ps") > 0).select("work_id", F.sha2(F.array_join("ps", "\x1e"), 256).alias("hash"))
    return etl.with_original(h, ["hash"], "work_id").select("work_id", "original")


@query("j14_equal_hash_other_path", f"{W} SELECT work_id, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) - 1 AS others FROM works")
def j14(lib: L) -> DataFrame:
    h = lib.works.select("work_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    counts = op.duplicate_keys(h, ["hash"])
    return h.join(counts, "hash", "left").select("work_id", (F.coalesce("n", F.lit(1)) - 1).alias("others"))


@query("j15_refrains")
def j15(lib: L) -> DataFrame:
    found = lib.works.select("work_id", songs.refrain(lines_of(F.col("text"))).alias("refrain"))
    return found.filter("refrain IS NOT NULL").select("work_id", F.array_join("refrain", "\n").alias("refrain"))


@query("j16_interleaved_sections", f"""WITH {SONGS}, s AS (SELECT song_id, list(CASE WHEN section_type = 'assistant' THEN 'Chorus' ELSE 'Verse' END ORDER BY section_order) AS k, list(left(text, 20) ORDER BY section_order) AS t FROM songs GROUP BY song_id),
v AS (SELECT *, list_filter(t, lambda x, i: k[i] <> 'Chorus') AS vs, list_filter(t, lambda x, i: k[i] = 'Chorus') AS cs, len(list_filter(range(1, len(k)), lambda i: k[i] = 'Verse' AND k[i + 1] <> 'Chorus')) = 0 AS woven FROM s)
SELECT song_id, array_to_string(CASE WHEN len(cs) = 0 OR len(vs) = 0 OR (woven AND len(cs) >= greatest(1, len(vs) - 1)) THEN t ELSE flatten(list_transform(vs, lambda x: [x, cs[1]])) END, '|') AS sections FROM v""")  # fmt: skip
def j16(lib: L) -> DataFrame:
    kind = F.when(F.col("section_type") == "assistant", "Chorus").otherwise("Verse")
    held = F.sort_array(F.collect_list(F.struct("section_order", kind.alias("k"), F.left("text", F.lit(20)).alias("t"))))
    s = lib.songs.groupBy("song_id").agg(held.alias("h")).select("song_id", F.transform("h", lambda x: x["k"]).alias("k"), F.transform("h", lambda x: x["t"]).alias("t"))
    return s.select("song_id", F.array_join(songs.interleaved(F.col("k"), F.col("t")), "|").alias("sections"))


@query("j17_choruses")
def j17(lib: L) -> DataFrame:
    held = F.sort_array(F.collect_list(F.struct("section_order", F.col("text").alias("t"))))
    s = lib.songs.groupBy("song_id").agg(F.transform(held, lambda x: x["t"]).alias("stanzas"))
    return s.select("song_id", F.array_join(songs.chorus("stanzas"), "\n").alias("chorus")).filter("chorus IS NOT NULL")


@query("j18_line_breaks", f"{WP} SELECT work_id, CASE WHEN work_id % 3 <> 0 THEN array_to_string(list_transform(list(text ORDER BY number), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), chr(10)) END AS restored FROM paras GROUP BY work_id")
def j18(lib: L) -> DataFrame:
    # stored in one line with other spaces; every third text has another character as well
    lines = lines_of(F.col("text"))
    stored = F.concat(F.regexp_replace(F.array_join(lines, " "), " ", "\t "), F.when(F.col("work_id") % 3 == 0, "#").otherwise(" "))
    return lib.works.filter(F.size(lines) > 0).select("work_id", songs.with_breaks(stored, lines).alias("restored"))


@query("j19_pages_by_budget")
def j19(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", F.posexplode(metadata.pages_within(F.col("text"), 60)).alias("page", "text"))


_FILE_PATHS = r"""n0 AS (SELECT work_id, code, language, source, CAST(1950 + work_id % 60 AS VARCHAR) AS y, lpad(CAST(work_id % 12 + 1 AS VARCHAR), 2, '0') AS m, lpad(CAST(work_id % 31 + 1 AS VARCHAR), 2, '0') AS d FROM works),
fn AS (SELECT *, CASE work_id % 3 WHEN 0 THEN code WHEN 1 THEN 'FR' || right(y, 2) || '-' || m || d || ' evening_word' ELSE 'ENG_' || y || m || d || 'E_The_Word' END AS name FROM n0)"""
_PARSED = r"""p0 AS (SELECT *, regexp_replace(name, '(?i)^(?:swa|fra|fre|frn|fr|eng|en)(?:[-_ ]+|(\d))', '\1') AS bare, lower(regexp_extract(name, '(?i)^(swa|fra|fre|frn|fr|eng|en)[-\d_ ]', 1)) AS prefix FROM fn),
p1 AS (SELECT *, regexp_extract(bare, '(?:^|\D)((?:\d\d|\d{{4}})[-_. ]?\d\d[-_. ]?\d\d[A-Za-z]?)(?:\D|$)', 1) AS found FROM p0),
p2 AS (SELECT *, regexp_extract(found, '^(\d\d|\d{{4}})[-_. ]?(\d\d)[-_. ]?(\d\d)[A-Za-z]?$', ['y', 'm', 'd']) AS g, trim(regexp_replace(translate(replace(bare, nullif(found, ''), ''), '_.', '  '), '\s+', ' ', 'g'), ' -') AS rest, trim(regexp_replace(translate(bare, '_.', '  '), '\s+', ' ', 'g'), ' -') AS whole FROM p1),
p3 AS (SELECT *, TRY_CAST(CASE WHEN length(g.y) = 4 THEN g.y WHEN g.y >= '30' THEN '19' || g.y ELSE '20' || g.y END || '-' || g.m || '-' || g.d AS DATE) AS date FROM p2),
parsed AS (SELECT work_id, CASE WHEN prefix = 'swa' THEN 'sw' WHEN starts_with(prefix, 'fr') THEN 'fr' WHEN starts_with(prefix, 'en') THEN 'en' ELSE language END AS language, CASE WHEN found <> '' THEN found ELSE left(bare, 80) END AS code, date, CAST(coalesce(year(date), 0) AS INTEGER) AS year, left(CASE WHEN found = '' OR rest = '' THEN whole ELSE rest END, 300) AS title FROM p3)""".replace("{{", "{").replace("}}", "}")


def _dated(work_id: str = "work_id") -> tuple[Column, Column, Column]:
    """Year, month and day that a file's name shows, by the work's id; some days don't exist."""
    i = F.col(work_id)
    two = lambda n: F.lpad((i % n + 1).cast("string"), 2, "0")
    return (1950 + i % 60).cast("string"), two(12), two(31)


def _file_paths(lib: L) -> DataFrame:
    """Works with ``file``, a path whose name is a code, or holds a language, a date and a title."""
    y, m, d = _dated()
    i = F.col("work_id") % 3
    name = F.when(i == 0, F.col("code")).when(i == 1, F.concat(F.lit("FR"), F.right(y, F.lit(2)), F.lit("-"), m, d, F.lit(" evening_word"))).otherwise(F.concat(F.lit("ENG_"), y, m, d, F.lit("E_The_Word")))
    return lib.works.withColumn("file", F.concat(F.lit("/library/"), F.col("source"), F.lit("/"), F.col("language"), F.lit("/"), name, F.lit(".txt")))


@query("j20_metadata", f"{W}, {_FILE_PATHS}, {_PARSED} SELECT * FROM parsed")
def j20(lib: L) -> DataFrame:
    return _file_paths(lib).select("work_id", metadata.parsed(F.col("file")).alias("m")).select("work_id", "m.*")


@query("j21_verse_import", f"WITH {VERSES}, i AS (SELECT book_id, chapter, verse, arg_max(text, text) AS text FROM verses WHERE book_id <= 5 GROUP BY ALL) SELECT book_id, chapter, verse, text FROM verses WHERE book_id > 5 UNION ALL SELECT * FROM i")
def j21(lib: L) -> DataFrame:
    v = lib.verses
    incoming = op.keep_one(v.filter("book_id <= 5"), ["book_id", "chapter", "verse"], [F.desc("text")])
    return mutations.replace_all(v, incoming, ["book_id"])


_CORPUS = "corpus AS (SELECT CASE WHEN book_id = 13 THEN 70 ELSE book_id END AS book_id, chapter, verse FROM verses WHERE NOT (verse = 2 AND chapter % 50 = 0) UNION ALL SELECT book_id, chapter, verse FROM verses WHERE verse = 1 AND chapter % 100 = 1 AND book_id <> 13), k AS (SELECT book_id, chapter, verse, count(*) AS n FROM corpus GROUP BY ALL)"


@query("j22_verse_findings", f"""WITH {VERSES}, {_CORPUS}, f AS (
SELECT 'missing_book' AS kind, range AS book_id, NULL AS chapter, NULL AS verse, NULL AS n FROM range(1, 67) WHERE range NOT IN (SELECT book_id FROM k)
UNION ALL SELECT 'extra_book', book_id, NULL, NULL, sum(n) FROM k WHERE book_id NOT BETWEEN 1 AND 66 GROUP BY book_id
UNION ALL SELECT 'missing_landmark', b, c, v, NULL FROM (VALUES (1, 1, 1), (19, 23, 1), (27, 5, 23), (43, 3, 16), (45, 8, 28), (66, 22, 21)) AS t(b, c, v) WHERE NOT EXISTS (SELECT 1 FROM k WHERE book_id = b AND chapter = c AND verse = v)
UNION ALL SELECT 'gap', book_id, chapter, NULL, max(verse) - count(*) FROM k GROUP BY book_id, chapter HAVING max(verse) <> count(*)
UNION ALL SELECT 'repeated', book_id, chapter, verse, n FROM k WHERE n > 1)
SELECT kind, CAST(book_id AS BIGINT) AS book_id, CAST(chapter AS BIGINT) AS chapter, CAST(verse AS BIGINT) AS verse, CAST(n AS BIGINT) AS n FROM f""")  # fmt: skip
def j22(lib: L) -> DataFrame:
    v = lib.verses.select("book_id", "chapter", "verse")
    damaged = v.filter("NOT (verse = 2 AND chapter % 50 = 0)").withColumn("book_id", F.when(F.col("book_id") == 13, 70).otherwise(F.col("book_id")))
    return metadata.verse_findings(damaged.union(v.filter("verse = 1 AND chapter % 100 = 1 AND book_id <> 13")))


@query("j23_organiser", f"{W} SELECT work_id, CASE WHEN source_id = 1 THEN 'circular-letters' WHEN content_type = 'brochure' THEN 'brochures' WHEN year > 0 THEN 'meetings' ELSE 'unsorted' END AS category, CASE WHEN year > 0 AND title <> '' THEN 'high' WHEN year > 0 OR title <> '' THEN 'medium' ELSE 'low' END AS confidence FROM works")
def j23(lib: L) -> DataFrame:
    category = F.when(F.col("source_id") == 1, "circular-letters").when(F.col("content_type") == "brochure", "brochures").when(F.col("year") > 0, "meetings").otherwise("unsorted")
    confidence = F.when((F.col("year") > 0) & (F.col("title") != ""), "high").when((F.col("year") > 0) | (F.col("title") != ""), "medium").otherwise("low")
    return lib.works.select("work_id", category.alias("category"), confidence.alias("confidence"))


_FIELDS = {"title": "title", "code": "code", "year": "year", "work_date": "date", "language": "language"}


@query("j24_metadata_repair", f"""{W}, {_FILE_PATHS}, {_PARSED}, st AS (SELECT w.work_id, CASE WHEN w.work_id % 2 = 0 THEN p.title ELSE w.title END AS title, CASE WHEN w.work_id % 2 = 0 THEN p.code ELSE w.code END AS code, CASE WHEN w.work_id % 2 = 0 THEN p.year ELSE w.year END AS year, CASE WHEN w.work_id % 2 = 0 THEN p.date ELSE w.work_date END AS work_date, CASE WHEN w.work_id % 4 = 0 THEN p.language ELSE w.language END AS language FROM works w JOIN parsed p ON w.work_id = p.work_id)
SELECT st.work_id, p.title AS new_title, array_to_string(list_filter([CASE WHEN st.title IS DISTINCT FROM p.title THEN 'title' END, CASE WHEN st.code IS DISTINCT FROM p.code THEN 'code' END, CASE WHEN st.year IS DISTINCT FROM p.year THEN 'year' END, CASE WHEN st.work_date IS DISTINCT FROM p.date THEN 'work_date' END, CASE WHEN st.language IS DISTINCT FROM p.language THEN 'language' END], lambda x: x IS NOT NULL), ',') AS changed FROM st JOIN parsed p ON st.work_id = p.work_id""")  # fmt: skip
def j24(lib: L) -> DataFrame:
    # every other work is as an earlier repair left it, but some of those have another language
    m = metadata.parsed(F.col("file"))
    kept = {c: F.when(F.col("work_id") % (4 if c == "language" else 2) == 0, m[p]).otherwise(F.col(c)).alias(c) for c, p in _FIELDS.items()}
    stored = _file_paths(lib).select("work_id", "file", *kept.values())
    return metadata.repairs(stored, "file", _FIELDS).select("work_id", F.col("new.title").alias("new_title"), F.array_join("changed", ",").alias("changed"))


_CASCADE = r"""n0 AS (SELECT work_id, code, CAST(1950 + work_id % 60 AS VARCHAR) AS y, lpad(CAST(work_id % 12 + 1 AS VARCHAR), 2, '0') AS m, lpad(CAST(work_id % 31 + 1 AS VARCHAR), 2, '0') AS d FROM works),
n1 AS (SELECT *, CASE work_id % 8 WHEN 0 THEN code WHEN 1 THEN y || '-' || m || '-' || d || '-1400-Oslo-english' WHEN 2 THEN 'A_Known_Title' || work_id WHEN 3 THEN 'spring' || y WHEN 4 THEN y || '0304' WHEN 5 THEN y || '_' || m || '-Wakeup' WHEN 6 THEN y || '-Circular-english' ELSE 'plain_name.part-' || work_id END AS name FROM n0),
n2 AS (SELECT *, regexp_extract(name, '^((?:19|20)\d\d)-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])-\d{4}-([A-Za-z]+)', ['y', 'm', 'd', 'place']) AS me, regexp_extract(name, '(?i)^(spring|summer|autumn|fall|winter)((?:19|20)\d\d)', ['name', 'y']) AS se, regexp_extract(name, '^((?:19|20)\d\d)(0[1-9]|1[0-2])(0[1-9]|1[0-2])(?:\D|$)', ['y', 'a', 'b']) AS mr,
 regexp_extract(name, '^((?:19|20)\d\d)[-_]?(0[1-9]|1[0-2])(?:\D|$)', ['y', 'm']) AS ym, regexp_extract(name, '(?:^|\D)((?:19|20)\d\d)(?:\D|$)', 1) AS yr, CASE WHEN contains(lower(name), 'wakeup') THEN ' - Wake up' ELSE '' END AS extra, trim(regexp_replace(regexp_replace(translate(name, '_.', '  '), '\s*-\s*', ' - ', 'g'), '\s+', ' ', 'g'), ' -') AS plain FROM n1),
n3 AS (SELECT *, TRY_CAST(me.y || '-' || lpad(me.m, 2, '0') || '-' || lpad(me.d, 2, '0') AS DATE) AS met FROM n2),
n4 AS (SELECT *, CASE WHEN work_id % 16 = 0 THEN 'catalog' WHEN met IS NOT NULL THEN 'meeting' WHEN contains(lower(name), 'known_title') THEN 'known' WHEN se.y <> '' THEN 'season' WHEN mr.y <> '' THEN 'month_range' WHEN ym.y <> '' THEN 'year_month' WHEN yr <> '' THEN 'year' ELSE 'fallback' END AS rule FROM n3),
n5 AS (SELECT *, CASE rule WHEN 'meeting' THEN met WHEN 'season' THEN TRY_CAST(se.y || '-03-01' AS DATE) WHEN 'month_range' THEN TRY_CAST(mr.y || '-' || mr.a || '-01' AS DATE) WHEN 'year_month' THEN TRY_CAST(ym.y || '-' || ym.m || '-01' AS DATE) WHEN 'year' THEN TRY_CAST(yr || '-01-01' AS DATE) END AS date FROM n4)
SELECT work_id, rule, date, CAST(CASE WHEN rule = 'catalog' THEN CAST(y AS INTEGER) ELSE coalesce(year(date), 0) END AS INTEGER) AS year, CASE WHEN rule = 'meeting' THEN me.place END AS location,
 CASE rule WHEN 'catalog' THEN 'Listed ' || work_id WHEN 'meeting' THEN 'Meeting in ' || me.place || ' - ' || strftime(met, '%B %-d, %Y') WHEN 'known' THEN 'A Known Title' WHEN 'season' THEN 'Circular Letter - Spring ' || se.y WHEN 'month_range' THEN 'Circular Letter - ' || strftime(date, '%B') || '-' || monthname(TRY_CAST(mr.y || '-' || mr.b || '-01' AS DATE)) || ' ' || mr.y || extra
  WHEN 'year_month' THEN 'Circular Letter - ' || strftime(date, '%B %Y') || extra WHEN 'year' THEN 'Circular Letter - ' || yr || extra ELSE plain END AS title,
 CASE rule WHEN 'catalog' THEN 'CAT-' || work_id WHEN 'meeting' THEN 'EF-' || strftime(met, '%Y-%m-%d') || '-' || upper(me.place) WHEN 'known' THEN 'EF-KNOWN' WHEN 'season' THEN 'CL-' || se.y || '-SPRING' WHEN 'month_range' THEN 'CL-' || mr.y || '-' || mr.a || '-' || mr.b WHEN 'year_month' THEN 'CL-' || ym.y || '-' || ym.m WHEN 'year' THEN 'CL-' || yr ELSE upper(trim(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g'), '-')) END AS code FROM n5"""


@query("j25_metadata_cascade", f"{W}, {_CASCADE}")
def j25(lib: L) -> DataFrame:
    y, m, d = _dated()
    i = F.col("work_id")
    number = i.cast("string")
    named = [F.col("code"), F.concat_ws("-", y, m, d, F.lit("1400-Oslo-english")), F.concat(F.lit("A_Known_Title"), number), F.concat(F.lit("spring"), y), F.concat(y, F.lit("0304")), F.concat(y, F.lit("_"), m, F.lit("-Wakeup")), F.concat(y, F.lit("-Circular-english")), F.concat(F.lit("plain_name.part-"), number)]
    listed = F.struct(F.concat(F.lit("Listed "), number).alias("title"), F.concat(F.lit("CAT-"), number).alias("code"), y.cast("int").alias("year"), F.lit(None).cast("date").alias("date"))
    w = lib.works.select("work_id", F.get(F.array(*named), (i % 8).cast("int")).alias("name"), F.when(i % 16 == 0, listed).alias("catalog"))
    found = metadata.cascade(F.col("name"), F.col("catalog"), {"known_title": ("A Known Title", "EF-KNOWN")}, {"wakeup": "Wake up"})
    return w.select("work_id", found.alias("m")).select("work_id", "m.*")


_KEY = r"replace(upper(replace(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]', '', 'g'), 'ß', chr(1))), chr(1), 'ß')"


@query("j26_publisher_pages", f"""{WP}, pg AS (SELECT work_id, (number - 1) // 4 AS page, list(text ORDER BY number) AS ls FROM paras GROUP BY ALL),
pt AS (SELECT pg.work_id, page, title, CASE (pg.work_id + page) % 5 WHEN 0 THEN list_prepend('Copyright notice', ls) WHEN 1 THEN list_append(ls, 'All rights reserved. See www.example.org') WHEN 2 THEN list_append(ls, 'ALL RIGHTS RESERVED') WHEN 3 THEN list_append(list_prepend(title, ls), 'Example Press') ELSE ls END AS ls FROM pg JOIN works w ON pg.work_id = w.work_id),
pk AS (SELECT *, {_KEY.format("array_to_string(ls, ' ')")} AS k FROM pt)
SELECT work_id, page, page > 0 AND (lower(ls[1]) = 'copyright notice' OR CAST(contains(k, 'ALLRIGHTSRESERVED') AS INTEGER) + CAST(contains(k, 'WWWEXAMPLEORG') AS INTEGER) + CAST(contains(k, 'EXAMPLEPRESSEDITIONS') AS INTEGER) + CAST(contains(k, 'PRINTEDUNABRIDGED') OR contains(k, 'PRINTEDATHOME') AS INTEGER) >= 2 OR ({_KEY.format("title")} <> '' AND {_KEY.format("ls[1]")} = {_KEY.format("title")} AND contains(k, 'EXAMPLEPRESS'))) AS dropped FROM pk""")  # fmt: skip
def j26_pages(lib: L) -> DataFrame:
    # pages of four lines, with a publisher's lines on most of them; the lines stand in one row, so no shuffle is needed
    lines = lines_of(F.col("text"))
    w = lib.works.filter(F.size(lines) > 0).select("work_id", "title", tx.once(lines).alias("ls"))
    p = w.select("work_id", "title", "ls", F.explode(F.sequence(F.lit(0), F.expr("cast((size(ls) - 1) div 4 as int)"))).alias("page"))
    ls, kind = F.slice("ls", F.col("page") * 4 + 1, F.lit(4)), (F.col("work_id") + F.col("page")) % 5
    put = F.when(kind == 0, F.array_prepend(ls, "Copyright notice")).when(kind == 1, F.array_append(ls, "All rights reserved. See www.example.org")).when(kind == 2, F.array_append(ls, "ALL RIGHTS RESERVED"))
    put = put.when(kind == 3, F.array_append(F.array_prepend(ls, F.col("title")), "Example Press")).otherwise(ls)
    signals = (("All rights reserved",), ("www.example.org",), ("Example Press Editions",), ("printed unabridged", "printed at home"))
    found = metadata.is_publisher_page(put, F.col("title"), signals, "Example Press")
    return p.select("work_id", F.col("page").cast("long").alias("page"), ((F.col("page") > 0) & found).alias("dropped"))


@query("j26_headings", f"{WP} SELECT paragraph_id, round(CASE WHEN length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) > 0 THEN length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) / length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) ELSE 0 END, 6) >= 0.85 AS heading FROM paras")
def j26(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", (F.round(etl.upper_ratio(F.col("text")), 6) >= 0.85).alias("heading"))


@query("j27_target_names", f"{W}, r AS (SELECT work_id AS id, 'name' || (work_id // 4) AS name, sha256(coalesce(text, '')) AS hash FROM works), f AS (SELECT name, hash, min(id) AS id FROM r GROUP BY ALL), n AS (SELECT id, name, row_number() OVER (PARTITION BY name ORDER BY id) AS k FROM f) SELECT r.id, CASE WHEN n.id IS NULL THEN NULL WHEN k = 1 THEN n.name ELSE n.name || '-' || k END AS target, CASE WHEN n.id IS NULL THEN 'skip' ELSE 'copy' END AS action FROM r LEFT JOIN n ON r.id = n.id")
def j27(lib: L) -> DataFrame:
    r = lib.works.select(F.col("work_id").alias("id"), F.concat(F.lit("name"), F.expr("work_id div 4").cast("string")).alias("name"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return etl.target_names(r).select("id", "target", "action")
