"""Data quality and reconciliation over the library model (K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianta.functions import text as tx
from folianta.model import Library
from folianta.operators import mutations
from folianta.operators import quality as qa
from folianta.operators import relational as op
from folianta.plans.catalog import SONGS, VERSES, W, WP, query

L = Library

_FLAT = r"trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'))"


def _rules(flat: str = _FLAT) -> str:
    """The rules of quality.rules as a SQL list."""
    tests = {
        "at_sign": f"contains({flat}, '@')",
        "hash_sign": f"contains({flat}, '#')",
        "percent_sign": f"contains({flat}, '%')",
        "repeated_symbols": "(" + " OR ".join(f"contains({flat}, '{c * 3}')" for c in "@#%*_=~-") + ")",
        "spaced_letters": rf"(regexp_matches({flat}, '\b([A-Z]\s+){{2,}}[A-Z]\b') OR regexp_matches({flat}, '\b([a-z]\s+){{4,}}[a-z]\b'))",
        "encoding": f"regexp_matches({flat}, '[ÃÂâ€�]')",
        "control_characters": r"regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')",
        "repeated_space": r"regexp_matches(text, '[ \t]{4,}')",
        "footer": "(" + " OR ".join(f"contains(lower({flat}), '{w}')" for w in qa.FOOTERS) + ")",
        "page_label": rf"(regexp_matches(lower({flat}), '^(page\s*)?\d{{1,4}}$|^page\s+\d+\s+(of\s+\d+)?$') OR regexp_matches({flat}, '^\d{{2}}-\d{{4}}\s+.*$'))",
        "short_junk": rf"(length({flat}) BETWEEN 1 AND 4 AND NOT regexp_matches({flat}, '[\p{{L}}\p{{Nd}}]'))",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items()) + "], lambda x: x IS NOT NULL)"


_REASONS = f"rs AS (SELECT paragraph_id, language, source_id, {_rules()} AS reasons FROM paras)"
_SEVERITY = "CASE WHEN {0} IN ('encoding', 'control_characters', 'spaced_letters') THEN 3 WHEN {0} IN ('repeated_symbols', 'footer', 'page_label', 'short_junk') THEN 2 ELSE 1 END"


@query("k01_rule_scan", f"{WP}, {_REASONS} SELECT paragraph_id, array_to_string(reasons, ',') AS reasons FROM rs WHERE len(reasons) > 0")
def k01(lib: L) -> DataFrame:
    r = qa.with_reasons(lib.paragraphs.select("paragraph_id", "text")).filter(F.size("reasons") > 0)
    return r.select("paragraph_id", F.array_join("reasons", ",").alias("reasons"))


@query("k02_cross_corpus_scan", f"""{WP}, {VERSES}, {SONGS}, a AS (SELECT 'paragraph' AS corpus, text FROM paras UNION ALL SELECT 'verse', text FROM verses UNION ALL SELECT 'song', text FROM songs), r AS (SELECT corpus, unnest({_rules()}) AS reason FROM a)
SELECT corpus, reason, CAST({_SEVERITY.format("reason")} AS INTEGER) AS severity, count(*) AS n FROM r GROUP BY ALL""")  # fmt: skip
def k02(lib: L) -> DataFrame:
    parts = [lib.paragraphs.select(F.lit("paragraph").alias("corpus"), "text"), lib.verses.select(F.lit("verse").alias("corpus"), "text"), lib.songs.select(F.lit("song").alias("corpus"), "text")]
    every = qa.with_reasons(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("corpus", F.explode("reasons").alias("reason"))
    return every.groupBy("corpus", "reason").agg(F.count("*").alias("n")).select("corpus", "reason", qa.severity(F.col("reason")).alias("severity"), "n")


@query("k03_safe_fixes")
def k03(lib: L) -> DataFrame:
    p = qa.with_reasons(lib.paragraphs.select("paragraph_id", "text")).filter(F.size("reasons") > 0)
    fixes = p.withColumn("new", qa.suggested(F.col("text"))).filter("new <> text").select("paragraph_id", F.col("text").alias("old"), "new")
    return mutations.compare_and_set(p.select("paragraph_id", "text"), fixes, "paragraph_id", "text").filter("applied").select("paragraph_id", "text")


def _source_and_stored(lib: L) -> tuple[DataFrame, DataFrame]:
    """Paragraphs and a faulty copy of them, whose faults recur every eight paragraphs; 0 numbers what only the copy has."""
    p = lib.paragraphs.select("work_id", "number", "text")
    n, w = (F.col("number") - 1) % 8 + 1, F.col("work_id")
    stored = p.filter(~((w % 7 == 0) & (n == 1)) & ~((w % 5 == 0) & (n == 3)))
    text = F.when(n == 2, F.concat(F.lit(" "), F.col("text"))).when((n == 4) & (w % 2 == 0), F.substring(F.col("text"), 1, 12)).when(n == 5, F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text"))
    extra = p.filter((w % 9 == 0) & (F.col("number") == 1)).select("work_id", F.lit(0).alias("number"), "text")
    return p, stored.withColumn("text", text).unionByName(extra)


_SRC = """src AS (SELECT work_id, number, (number - 1) % 8 + 1 AS n, text FROM paras),
sto AS (SELECT work_id, number, CASE WHEN n = 2 THEN ' ' || text WHEN n = 4 AND work_id % 2 = 0 THEN substr(text, 1, 12) WHEN n = 5 THEN 'x' || text ELSE text END AS text FROM src WHERE NOT (work_id % 7 = 0 AND n = 1) AND NOT (work_id % 5 = 0 AND n = 3) UNION ALL SELECT work_id, 0, text FROM src WHERE work_id % 9 = 0 AND number = 1)"""
_KEY = r"lower(regexp_replace({}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
_BARE = r"regexp_replace({}, '[\s\x0B]+', '', 'g')"


@query("k04_paragraph_reconciliation", f"""{WP}, {_SRC}, j AS (SELECT coalesce(a.work_id, b.work_id) AS work_id, coalesce(a.number, b.number) AS number, a.text AS s, b.text AS t, a.work_id IS NOT NULL AS e, b.work_id IS NOT NULL AS f FROM src a FULL JOIN sto b ON a.work_id = b.work_id AND a.number = b.number),
i AS (SELECT *, CASE WHEN NOT f THEN CASE WHEN number = 1 THEN 'missing_opening' ELSE 'missing' END WHEN NOT e THEN 'unexpected' WHEN s = t THEN NULL WHEN {_BARE.format("s")} = {_BARE.format("t")} THEN 'spacing' WHEN {_KEY.format("s")} = {_KEY.format("t")} THEN NULL
WHEN {_KEY.format("t")} <> '' AND starts_with({_KEY.format("s")}, {_KEY.format("t")}) THEN 'cut' WHEN length({_KEY.format("s")}) - length({_KEY.format("t")}) > 80 THEN 'shorter' ELSE 'mismatch' END AS issue FROM j) SELECT work_id, number, issue FROM i WHERE issue IS NOT NULL""")  # fmt: skip
def k04(lib: L) -> DataFrame:
    return qa.compare_paragraphs(*_source_and_stored(lib)).filter("issue IS NOT NULL").select("work_id", "number", "issue")


@query("k04_length_shortfall", f"{WP}, {_SRC}, a AS (SELECT work_id, CAST(sum(length(text)) AS BIGINT) AS source_length FROM src GROUP BY ALL), b AS (SELECT work_id, CAST(sum(length(text)) AS BIGINT) AS stored_length FROM sto GROUP BY ALL) SELECT a.work_id, source_length, coalesce(stored_length, 0) AS stored_length FROM a LEFT JOIN b ON a.work_id = b.work_id WHERE coalesce(stored_length, 0) < source_length * 0.98")
def k04_short(lib: L) -> DataFrame:
    return qa.length_shortfall(*_source_and_stored(lib))


@query("k05_song_lines")
def k05(lib: L) -> DataFrame:
    lines = F.filter(F.split("text", r"(?<=[.]) |\n"), lambda x: F.trim(x) != "")
    s = lib.songs.select("song_id", "section_order", lines.alias("a"))
    k = F.col("section_order") % 6
    b = F.when(k == 0, F.col("a")).when(k == 1, F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(1)))).when(k == 2, F.transform("a", lambda x: F.upper(x))).when(k == 3, F.array().cast("array<string>")).when(k == 4, F.concat("a", F.array(F.lit("new")))).otherwise(F.array_distinct("a"))
    return s.select("song_id", "section_order", qa.compare_lines(F.col("a"), b).alias("issue")).filter("issue IS NOT NULL")


_DEFECTS = r"""df AS (SELECT work_id, number, source_id, language, list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '(?i)lorem|ipsum|placeholder|sample text|\bTODO\b|FIXME|\bdummy\b|test paragraph|xxxxx|\bNULL\b|\bundefined\b|\bNaN\b') THEN 'placeholder' END,
CASE WHEN regexp_matches(text, '^\d{1,4}(\s|\.\.\.)') THEN 'leading_number' END, CASE WHEN text = lag(text) OVER (PARTITION BY work_id ORDER BY number) THEN 'same_as_previous' END], lambda x: x IS NOT NULL) AS d FROM paras)"""


@query("k06_library_checks", f"{WP}, {_DEFECTS} SELECT language, defect, count(*) AS n FROM (SELECT language, unnest(d) AS defect FROM df) GROUP BY ALL")
def k06(lib: L) -> DataFrame:
    before = F.lag("text").over(Window.partitionBy("work_id").orderBy("number"))
    d = lib.paragraphs.withColumn("before", before).select("language", F.explode(qa.library_defects(F.col("text"), F.col("before"))).alias("defect"))
    return d.filter("defect <> 'running_head'").groupBy("language", "defect").agg(F.count("*").alias("n"))


@query("k06_numbering", f"{WP}, k AS (SELECT * FROM paras WHERE paragraph_id % 4 <> 1), g AS (SELECT work_id, number - lag(number) OVER (PARTITION BY work_id ORDER BY number) AS step FROM k) SELECT a.work_id, a.first_number, (SELECT count(*) FROM g WHERE g.work_id = a.work_id AND step > 1) AS gaps FROM (SELECT work_id, min(number) AS first_number FROM k GROUP BY work_id) a")
def k06_numbers(lib: L) -> DataFrame:
    return qa.numbering_faults(lib.paragraphs.filter("paragraph_id % 4 <> 1"))


@query("k07_verse_compare", f"WITH {VERSES}, d AS (SELECT book_id, chapter, verse, max(text) AS text FROM verses GROUP BY ALL), a AS (SELECT * FROM d WHERE (chapter + verse) % 11 <> 0), b AS (SELECT book_id, chapter, verse, CASE WHEN verse = 3 THEN upper(text) ELSE text END AS text FROM d WHERE (chapter + verse) % 13 <> 0) SELECT CASE WHEN a.book_id IS NULL THEN 'extra' WHEN b.book_id IS NULL THEN 'missing' WHEN a.text <> b.text THEN 'different' ELSE 'same' END AS status, count(*) AS n FROM a FULL JOIN b ON a.book_id = b.book_id AND a.chapter = b.chapter AND a.verse = b.verse GROUP BY ALL")
def k07(lib: L) -> DataFrame:
    d = lib.verses.groupBy("book_id", "chapter", "verse").agg(F.max("text").alias("text"))
    a, b = d.filter("(chapter + verse) % 11 <> 0"), d.filter("(chapter + verse) % 13 <> 0").withColumn("text", F.when(F.col("verse") == 3, F.upper("text")).otherwise(F.col("text")))
    return op.reconcile(a, b, ["book_id", "chapter", "verse"], "text").groupBy("status").agg(F.count("*").alias("n"))


@query("k08_token_alignment")
def k08(lib: L) -> DataFrame:
    a, b = _source_and_stored(lib)
    both = b.withColumnRenamed("text", "stored").join(a.withColumnRenamed("text", "source"), ["work_id", "number"])
    ops = both.select("work_id", "number", F.explode(qa.aligned("stored", "source")).alias("o"))
    return ops.select("work_id", "number", "o.kind", "o.op", "o.stored", "o.source")


@query("k09_proven_repairs", f"{WP}, {_SRC} SELECT a.work_id, a.number, a.text AS repaired FROM src a JOIN sto b ON a.work_id = b.work_id AND a.number = b.number WHERE a.text <> b.text AND {_KEY.format('a.text')} = {_KEY.format('b.text')} AND {_KEY.format('a.text')} <> ''")
def k09(lib: L) -> DataFrame:
    a, b = _source_and_stored(lib)
    both = b.withColumnRenamed("text", "stored").join(a.withColumnRenamed("text", "source"), ["work_id", "number"])
    return both.select("work_id", "number", qa.proven_repair("stored", "source").alias("repaired")).filter("repaired IS NOT NULL")


@query("k09_resegmentation", f"{WP} SELECT work_id, work_id % 6 <> 0 OR count(*) = 1 AS accepted FROM paras GROUP BY work_id")
def k09_segments(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", "number", "text")
    # every sixth work loses its order, unless it has one paragraph only
    last = F.max("number").over(Window.partitionBy("work_id"))
    new = p.withColumn("last", last).select("work_id", F.when((F.col("work_id") % 6 == 0) & (F.col("last") > 1), F.col("number") + 1).otherwise(F.col("number")).alias("number"), "text")
    return qa.resegmentation_ok(p, new)


@query("k10_unknown_words", rf"{W}, v AS (SELECT language, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')) AS token FROM works) SELECT language, token FROM v WHERE language IS NOT NULL GROUP BY ALL HAVING count(*) < 3")
def k10(lib: L) -> DataFrame:
    """Words seen fewer than three times in the corpus's own vocabulary."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    named = lib.works.filter("language IS NOT NULL")
    vocabulary = named.select("language", F.explode(words).alias("token")).groupBy("language", "token").agg(F.count("*").alias("n"))
    return qa.unknown_words(named.select("language", "text"), vocabulary)


@query("k11_containment", f"{W} SELECT b.item_id, count(w.work_id) AS works FROM benchmark b LEFT JOIN works w ON contains(w.text, b.text) GROUP BY b.item_id")
def k11(lib: L) -> DataFrame:
    # a work that has an item has its inner words whole: candidates share the first three of them, whatever white space parts
    # them; containment is then exact, and the few items of less than five words are held against every work
    b = lib.table("benchmark").select("item_id", F.col("text").alias("piece"), F.split("text", "[ \n]").alias("p"))
    works = lib.works.select("work_id", "text", F.split("text", "[ \n]").alias("w"))
    items = b.filter(F.size("p") >= 5).select("item_id", "piece", F.array_join(F.slice("p", 2, 3), " ").alias("key"))
    at = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, 3), " "))
    keys = works.select("work_id", "text", F.explode(F.array_distinct(at)).alias("key"))
    found = F.contains("text", F.col("piece"))
    hits = keys.join(op.small(items), "key").filter(found).select("item_id", "work_id")
    short = b.filter(F.size("p") < 5).select("item_id", "piece")
    hits = hits.union(works.join(op.small(short), found).select("item_id", "work_id"))
    counts = hits.groupBy(F.col("item_id").alias("k")).agg(F.count("work_id").alias("works"))
    return b.select("item_id").distinct().join(counts, F.col("item_id").eqNullSafe(F.col("k")), "left").select("item_id", F.coalesce("works", F.lit(0)).alias("works"))


@query("k11_coverage")
def k11_coverage(lib: L) -> DataFrame:
    held = lib.songs.groupBy("song_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_order", "text"))), lambda x: x["text"]), " ").alias("text"), F.collect_list(F.when(F.col("section_order") % 2 == 0, F.col("text"))).alias("pieces"))
    return held.select("song_id", F.round(qa.covered_share("text", "pieces"), 6).alias("share"))


@query("k12_expected_counts", "SELECT name, n >= low AND n <= high AS passed FROM (VALUES ('nation', 25, 25), ('region', 5, 5), ('supplier', 1, 5), ('ghost', 1, 1)) AS e(name, low, high) JOIN (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'ghost', -1) c USING (name)")
def k12(lib: L) -> DataFrame:
    counts = None
    for name in ("nation", "region", "supplier"):
        one = lib.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.union(one)
    e = lib.spark.createDataFrame([("nation", 25, 25), ("region", 5, 5), ("supplier", 1, 5), ("ghost", 1, 1)], "name string, low int, high int")
    return qa.expected_counts(counts, e).select("name", "passed")


@query("k13_index_sync", f"{WP} SELECT count(*) AS source_rows, count(*) AS index_rows, false AS rebuild FROM paras")
def k13(lib: L) -> DataFrame:
    return mutations.rebuild_needed(lib.paragraphs, lib.searchable)


@query("k14_scope_leak", f"{WP} SELECT count(*) AS leaked FROM paras WHERE source_id = 3 AND source_id <> 3")
def k14(lib: L) -> DataFrame:
    from folianta.operators.search import search_free_text

    found = search_free_text(lib, "of the", 100, sources=[3]).select("work_id")
    owned = lib.works.filter("source_id = 3").select("work_id")
    return found.join(owned, "work_id", "left_anti").agg(F.count("*").alias("leaked"))


@query("k15_source_diagnostics", f"""{W} SELECT source_id, count(*) AS works, count(*) FILTER (year = 0) AS undated, count(*) FILTER (length(title) < 4 OR regexp_matches(title, '^[0-9]')) AS odd_titles,
CASE WHEN count(*) FILTER (year = 0) * 5 > count(*) THEN 'undated' WHEN count(*) FILTER (length(title) < 4 OR regexp_matches(title, '^[0-9]')) > 0 THEN 'check titles' ELSE 'good' END AS status FROM works WHERE source_id IS NOT NULL GROUP BY source_id""")  # fmt: skip
def k15(lib: L) -> DataFrame:
    odd = (F.length("title") < 4) | F.col("title").rlike("^[0-9]")
    g = lib.works.filter("source_id IS NOT NULL").groupBy("source_id").agg(F.count("*").alias("works"), F.count_if(F.col("year") == 0).alias("undated"), F.count_if(odd).alias("odd_titles"))
    return g.withColumn("status", F.when(F.col("undated") * 5 > F.col("works"), "undated").when(F.col("odd_titles") > 0, "check titles").otherwise("good"))


@query("k16_cleanup_preview", f"{WP} SELECT w.source_id, count(DISTINCT w.work_id) AS works, count(p.paragraph_id) AS paragraphs, count(DISTINCT f.doc_id) AS favourites FROM works w LEFT JOIN paras p ON w.work_id = p.work_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) f ON w.work_id = f.doc_id WHERE w.source_id IS NOT NULL GROUP BY w.source_id")
def k16(lib: L) -> DataFrame:
    s = lib.works.filter("source_id IS NOT NULL").select("source_id", "work_id")
    favourites = s.join(lib.favourites, "work_id", "left_semi")
    return op.per_parent_counts(s.select("source_id").distinct(), "source_id", {"works": s, "paragraphs": lib.paragraphs.select("source_id"), "favourites": favourites})
