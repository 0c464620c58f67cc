"""Predicates, joins, aggregates, windows, orders and sets over the library model (C, D, E, F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folianta.functions import text as tx
from folianta.model import Library
from folianta.operators import relational as op
from folianta.operators.search import combine_scope, in_list
from folianta.plans.catalog import AUTHORS, PARAS, SEARCH_TEXT, SONGS, SOURCES, VERSES, WORKS, W, WP, query

L = Library

# ---- C: projections, filters, predicates


@query("c01_result_projection", f"""WITH {WORKS}, {PARAS}, {SOURCES}, {AUTHORS}
SELECT p.paragraph_id, w.work_id, coalesce(w.code, '') AS code, coalesce(w.title, '') AS title, w.year,
  coalesce(a.display_name, a.full_name, 'Unknown') AS author, coalesce(s.display_name, s.name, w.source, 'Unknown') AS source_name, w.language, p.number
FROM paras p JOIN works w ON p.work_id = w.work_id LEFT JOIN authors a ON w.author_id = a.author_id LEFT JOIN sources s ON w.source_id = s.source_id""")  # fmt: skip
def c01(lib: L) -> DataFrame:
    out = lib.paragraphs.select("paragraph_id", "work_id", "number").join(lib.works.drop("text"), "work_id")
    out = out.join(op.small(lib.authors), "author_id", "left").join(op.small(lib.sources).withColumnRenamed("display_name", "source_display"), "source_id", "left")
    return out.select(
        "paragraph_id", "work_id", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("title", F.lit("")).alias("title"), "year",
        F.coalesce("display_name", "full_name", F.lit("Unknown")).alias("author"), F.coalesce("source_display", "name", "source", F.lit("Unknown")).alias("source_name"), "language", "number",
    )


@query("c02_preview_240", f"""{WP} SELECT paragraph_id, CASE WHEN length(text) <= 240 THEN text ELSE substr(text, 1, 240) || '...' END AS preview FROM paras""")
def c02(lib: L) -> DataFrame:
    return lib.paragraphs.select("paragraph_id", tx.preview(F.col("text"), 240).alias("preview"))


@query("c03_preview_220", f"""WITH {SONGS} SELECT song_id, section_order, CASE WHEN length(trim(text)) <= 220 THEN trim(text) ELSE substr(trim(text), 1, 220) || '...' END AS searched,
  CASE WHEN length(text) <= 220 THEN text ELSE substr(text, 1, 220) || '...' END AS browsed, substr(text, 1, 240) AS stored FROM songs""")
def c03(lib: L) -> DataFrame:
    t = F.col("text")
    return lib.songs.select("song_id", "section_order", tx.preview(F.trim(t), 220).alias("searched"), tx.preview(t, 220).alias("browsed"), tx.preview(t, 240, "").alias("stored"))


@query("c04_like_escaped", r"""SELECT page_id, contains(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/en/') AS has, starts_with(translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '<!doctype') AS starts,
  contains(html, '%') AS percent FROM pages""")
def c04(lib: L) -> DataFrame:
    p = lib.table("pages")
    return p.select("page_id", tx.contains_folded(F.col("url"), "/EN/").alias("has"), tx.starts_folded(F.col("html"), "<!Doctype").alias("starts"), tx.contains_folded(F.col("html"), "%").alias("percent"))


@query("c05_equal_nocase", "SELECT n_nationkey, n_name FROM nation WHERE lower(n_name) = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 7)")
def c05(lib: L) -> DataFrame:
    n = lib.table("nation")
    wanted = n.filter("n_nationkey = 7").select(F.upper("n_name")).scalar()
    return n.filter(F.lower("n_name") == F.lower(wanted)).select("n_nationkey", "n_name")


@query("c06_in_list", f"{W} SELECT 'some' AS scope, count(*) AS n FROM works WHERE source_id IN (1, 3, 5) UNION ALL SELECT 'empty', 0 UNION ALL SELECT 'none', count(*) FROM works")
def c06(lib: L) -> DataFrame:
    w = lib.works.select("source_id")
    parts = [w.filter(in_list("source_id", ids)).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n") for name, ids in (("some", [1, 3, 5]), ("empty", []), ("none", None))]
    return parts[0].union(parts[1]).union(parts[2])


@query("c07_class_match", f"{W} SELECT work_id, code FROM works WHERE regexp_matches(code, '^D-[0-9]{{4}}[05][0-9]$')")
def c07(lib: L) -> DataFrame:
    return lib.works.filter(F.col("code").rlike("^D-[0-9]{4}[05][0-9]$")).select("work_id", "code")


@query("c08_year_between", f"{W} SELECT work_id, year FROM works WHERE year BETWEEN 1950 AND 1955")
def c08(lib: L) -> DataFrame:
    return lib.works.filter(F.col("year").between(1950, 1955)).select("work_id", "year")


@query("c09_exists_not_exists", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F') AS has_finished FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')""")
def c09(lib: L) -> DataFrame:
    o = lib.table("orders")
    urgent = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    done = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("f", F.lit(True))
    c = lib.table("customer").select("c_custkey").join(urgent, "c_custkey", "left_anti")
    return c.join(done, "c_custkey", "left").select("c_custkey", F.col("f").isNotNull().alias("has_finished"))


@query("c10_scope_combination", f"{W} SELECT 'inside' AS scope, count(*) AS n FROM works WHERE source_id = 3 UNION ALL SELECT 'outside', 0 UNION ALL SELECT 'list', count(*) FROM works WHERE source_id IN (2, 3)")
def c10(lib: L) -> DataFrame:
    w, out = lib.works.select("source_id"), None
    for name, one, allowed in (("inside", 3, [2, 3]), ("outside", 9, [2, 3]), ("list", None, [2, 3])):
        part = w.filter(in_list("source_id", combine_scope(one, allowed))).agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), "n")
        out = part if out is None else out.union(part)
    return out


@query("c11_deterministic_ids", f"{W} SELECT DISTINCT source_id FROM works WHERE source_id IN (7, 2, 2, 5) ORDER BY source_id")
def c11(lib: L) -> DataFrame:
    return lib.works.filter(in_list("source_id", combine_scope(None, [7, 2, 2, 5]))).select("source_id").distinct().orderBy("source_id")


@query("c12_scope_predicate", f"{WP} SELECT language, count(*) AS n FROM paras WHERE source_id IN (1, 2) AND language <> 'en' GROUP BY language")
def c12(lib: L) -> DataFrame:
    scoped = lib.paragraphs.filter(in_list("source_id", [1, 2]))
    return scoped.filter("language <> 'en'").groupBy("language").agg(F.count("*").alias("n"))


@query("c13_visible", f"{W} SELECT work_id FROM works WHERE NOT (source_id = 19 OR starts_with(lower(title), 'test') OR (content_type = 'letter' AND year = 0))")
def c13(lib: L) -> DataFrame:
    hidden = (F.col("source_id") == 19) | tx.starts_folded(F.col("title"), "test") | ((F.col("content_type") == "letter") & (F.col("year") == 0))
    return lib.works.filter(~hidden).select("work_id")


@query("c14_null_safe", f"{W} SELECT work_id, work_date IS DISTINCT FROM make_date(1950, 4, 4) AS differs FROM works")
def c14(lib: L) -> DataFrame:
    return lib.works.select("work_id", (~F.col("work_date").eqNullSafe(F.make_date(F.lit(1950), F.lit(4), F.lit(4)))).alias("differs"))


@query("c15_clamped_limit", f"{W} SELECT work_id, code FROM works ORDER BY work_id LIMIT 250")
def c15(lib: L) -> DataFrame:
    from folianta.functions.analyze import clamp

    return lib.works.select("work_id", "code").orderBy("work_id").limit(clamp(10_000, 1, 250))


@query("c16_content_type", f"""{W} SELECT work_id, CASE WHEN source_id = 1 THEN 'Circular letter' WHEN starts_with(code, 'D-0000') THEN 'Early' WHEN year > 0 AND content_type = 'brochure' THEN 'Dated brochure'
  WHEN content_type = 'brochure' THEN 'Brochure' ELSE 'Sermon' END AS kind FROM works""")
def c16(lib: L) -> DataFrame:
    brochure = F.col("content_type") == "brochure"
    kind = F.when(F.col("source_id") == 1, "Circular letter").when(F.col("code").startswith("D-0000"), "Early").when((F.col("year") > 0) & brochure, "Dated brochure").when(brochure, "Brochure")
    return lib.works.select("work_id", kind.otherwise("Sermon").alias("kind"))


# ---- D: joins


@query("d01_inner_paragraph_work", f"{WP} SELECT p.paragraph_id, w.code, p.number FROM paras p JOIN works w ON p.work_id = w.work_id WHERE w.year >= 1960")
def d01(lib: L) -> DataFrame:
    w = lib.works.filter("year >= 1960").select("work_id", "code")
    return lib.paragraphs.select("paragraph_id", "work_id", "number").join(w, "work_id").select("paragraph_id", "code", "number")


@query("d02_left_dimensions", f"""WITH {WORKS}, {SOURCES}, {AUTHORS} SELECT w.work_id, a.display_name AS author, s.display_name AS source_name FROM works w
LEFT JOIN authors a ON w.author_id = a.author_id LEFT JOIN (SELECT * FROM sources WHERE source_id < 15) s ON w.source_id = s.source_id""")
def d02(lib: L) -> DataFrame:
    a = op.small(lib.authors.select("author_id", F.col("display_name").alias("author")))
    s = op.small(lib.sources.filter("source_id < 15").select("source_id", F.col("display_name").alias("source_name")))
    return lib.works.select("work_id", "author_id", "source_id").join(a, "author_id", "left").join(s, "source_id", "left").select("work_id", "author", "source_name")


_FIRST = "first AS (SELECT work_id, paragraph_id, number, text AS first_text FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY number) AS rn FROM paras WHERE length(text) > 12) WHERE rn = 1)"


@query("d03_first_paragraph_inner", f"{WP}, {_FIRST} SELECT w.work_id, f.paragraph_id, f.first_text FROM works w JOIN first f ON w.work_id = f.work_id")
def d03(lib: L) -> DataFrame:
    p = lib.paragraphs.filter(F.length("text") > 12).select("work_id", "paragraph_id", "number", F.col("text").alias("first_text"))
    return op.first_child(lib.works.select("work_id"), p, "work_id", [F.col("number")], "inner").select("work_id", "paragraph_id", "first_text")


@query("d04_first_paragraph_left", f"{WP}, {_FIRST} SELECT w.work_id, coalesce(f.paragraph_id, 0) AS paragraph_id, coalesce(f.number, 1) AS number, coalesce(f.first_text, '') AS first_text FROM works w LEFT JOIN first f ON w.work_id = f.work_id")
def d04(lib: L) -> DataFrame:
    p = lib.paragraphs.filter(F.length("text") > 12).select("work_id", "paragraph_id", "number", F.col("text").alias("first_text"))
    out = op.first_child(lib.works.select("work_id"), p, "work_id", [F.col("number")], "left")
    return out.select("work_id", F.coalesce("paragraph_id", F.lit(0)).alias("paragraph_id"), F.coalesce("number", F.lit(1)).alias("number"), F.coalesce("first_text", F.lit("")).alias("first_text"))


@query("d05_late_materialisation", f"{WP}, top AS (SELECT paragraph_id, length(text) AS n FROM paras ORDER BY n DESC, paragraph_id LIMIT 50) SELECT t.paragraph_id, t.n, p.text, w.code FROM top t JOIN paras p ON t.paragraph_id = p.paragraph_id JOIN works w ON p.work_id = w.work_id")
def d05(lib: L) -> DataFrame:
    top = lib.paragraphs.select("paragraph_id", F.length("text").alias("n")).orderBy(F.desc("n"), "paragraph_id").limit(50)
    wide = lib.paragraphs.select("paragraph_id", "work_id", "text").join(top, "paragraph_id")
    return wide.join(lib.works.select("work_id", "code"), "work_id").select("paragraph_id", "n", "text", "code")


@query("d06_semi_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def d06(lib: L) -> DataFrame:
    c = lib.table("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lib.table("orders").join(c, "o_custkey", "left_semi").select("o_orderkey")


@query("d07_anti_set", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d07(lib: L) -> DataFrame:
    return lib.table("documents").select("doc_id").join(lib.table("labels").select("doc_id"), "doc_id", "left_anti")


@query("d08_lookup_in_order", f"""{W}, q AS (SELECT work_id AS q_id, CASE WHEN work_id % 3 = 0 THEN path END AS path, CASE WHEN work_id % 3 <> 2 THEN code END AS code, title, year FROM works),
p AS (SELECT path, min(work_id) AS i FROM works GROUP BY path), c AS (SELECT code, title, min(work_id) AS i FROM works GROUP BY ALL), y AS (SELECT code, year, min(work_id) AS i FROM works GROUP BY ALL), t AS (SELECT title, min(work_id) AS i FROM works GROUP BY ALL)
SELECT q_id, coalesce(p.i, c.i, y.i, t.i) AS work_id, CASE WHEN p.i IS NOT NULL THEN 'path' WHEN c.i IS NOT NULL THEN 'code_title' WHEN y.i IS NOT NULL THEN 'code_year' WHEN t.i IS NOT NULL THEN 'title' END AS rule
FROM q LEFT JOIN p ON q.path = p.path LEFT JOIN c ON q.code = c.code AND q.title = c.title LEFT JOIN y ON q.code = y.code AND q.year = y.year LEFT JOIN t ON q.title = t.title""")
def d08(lib: L) -> DataFrame:
    w = lib.works
    q = w.select(F.col("work_id").alias("q_id"), F.when(F.col("work_id") % 3 == 0, F.col("path")).alias("path"), F.when(F.col("work_id") % 3 != 2, F.col("code")).alias("code"), "title", "year")
    found = op.lookup_in_order(q, w.select("work_id", "path", "code", "title", "year"), [("path", ["path"]), ("code_title", ["code", "title"]), ("code_year", ["code", "year"]), ("title", ["title"])], "work_id")
    return found.select("q_id", "work_id", "rule")


@query("d10_alias_join", f"WITH {VERSES}, a(alias, book_id) AS (VALUES ('gen', 1), ('exo', 2), ('rom', 45)) SELECT a.alias, count(*) AS n FROM a JOIN verses v ON a.book_id = v.book_id GROUP BY a.alias")
def d10(lib: L) -> DataFrame:
    a = lib.spark.createDataFrame([("gen", 1), ("exo", 2), ("rom", 45)], "alias string, book_id int")
    return lib.verses.join(F.broadcast(a), "book_id").groupBy("alias").agg(F.count("*").alias("n"))


@query("d11_navigation_chain", f"""WITH {WORKS}, {SOURCES}, {AUTHORS}, fav AS (SELECT DISTINCT doc_id AS work_id FROM labels WHERE quality = 1)
SELECT f.work_id, w.code, a.display_name AS author, s.display_name AS source_name FROM fav f LEFT JOIN works w ON f.work_id = w.work_id LEFT JOIN authors a ON w.author_id = a.author_id LEFT JOIN sources s ON w.source_id = s.source_id""")
def d11(lib: L) -> DataFrame:
    a = op.small(lib.authors.select("author_id", F.col("display_name").alias("author")))
    s = op.small(lib.sources.select("source_id", F.col("display_name").alias("source_name")))
    out = lib.favourites.join(lib.works.select("work_id", "code", "author_id", "source_id"), "work_id", "left")
    return out.join(a, "author_id", "left").join(s, "source_id", "left").select("work_id", "code", "author", "source_name")


@query("d12_positional_zip", f"{W}, l AS (SELECT work_id, source_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM works), a AS (SELECT work_id, unnest(ps) AS x, unnest(range(1, len(ps) + 1)) AS pos FROM l), b AS (SELECT work_id, unnest(ps[2:]) AS y, unnest(range(1, len(ps[2:]) + 1)) AS pos FROM l) SELECT coalesce(a.work_id, b.work_id) AS work_id, CAST(coalesce(a.pos, b.pos) AS INTEGER) AS pos, x, y FROM a FULL JOIN b ON a.work_id = b.work_id AND a.pos = b.pos")
def d12(lib: L) -> DataFrame:
    p = lib.paragraphs
    a = p.select("work_id", F.col("number").alias("pos"), F.col("text").alias("x"))
    b = p.filter("number >= 2").select("work_id", (F.col("number") - 1).alias("pos"), F.col("text").alias("y"))
    return a.join(b, ["work_id", "pos"], "full_outer")


@query("d13_reconcile", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'extra' WHEN b.k IS NULL THEN 'missing' WHEN a.v IS DISTINCT FROM b.v THEN 'different' ELSE 'same' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY ALL""")
def d13(lib: L) -> DataFrame:
    o = lib.table("orders")
    a = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    b = o.filter("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return op.reconcile(a, b, ["k"], "v").groupBy("status").agg(F.count("*").alias("n"))


@query("d14_lag_pairs", f"{WP} SELECT work_id, number, lag(length(text)) OVER (PARTITION BY work_id ORDER BY number) AS before, length(text) AS n FROM paras")
def d14(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", "number", F.length("text").alias("n"))
    return p.withColumn("before", F.lag("n").over(Window.partitionBy("work_id").orderBy("number")))


# ---- E: aggregates


@query("e01_scalar_count", f"{WP} SELECT count(*) AS n FROM paras p JOIN works w ON p.work_id = w.work_id WHERE w.year > 0 AND length(p.text) > 100")
def e01(lib: L) -> DataFrame:
    p = lib.paragraphs.filter(F.length("text") > 100).select("work_id")
    return p.join(lib.works.filter("year > 0").select("work_id"), "work_id").agg(F.count("*").alias("n"))


@query("e02_count_by_language_author", f"WITH {WORKS}, {AUTHORS} SELECT coalesce(w.language, 'unknown') AS language, coalesce(a.display_name, 'unknown') AS author, count(*) AS n FROM works w LEFT JOIN authors a ON w.author_id = a.author_id GROUP BY ALL")
def e02(lib: L) -> DataFrame:
    counted = lib.works.groupBy("language", "author_id").agg(F.count("*").alias("n"))
    named = counted.join(op.small(lib.authors), "author_id", "left")
    return named.groupBy(F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("display_name", F.lit("unknown")).alias("author")).agg(F.sum("n").alias("n"))


@query("e03_verses_per_chapter", f"WITH {VERSES} SELECT book_id, chapter, count(*) AS verses FROM verses GROUP BY ALL")
def e03(lib: L) -> DataFrame:
    return lib.verses.groupBy("book_id", "chapter").agg(F.count("*").alias("verses"))


@query("e04_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def e04(lib: L) -> DataFrame:
    return op.keep_one(lib.table("events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("e05_group_per_work", f"""{WP} SELECT work_id, min(length(text)) AS best, count(*) AS hits, arg_min(number, (length(text), number)) AS first_number FROM paras WHERE contains(lower(text), 'the') GROUP BY work_id""")
def e05(lib: L) -> DataFrame:
    p = lib.paragraphs.filter(F.lower("text").contains("the"))
    return p.groupBy("work_id").agg(F.min(F.length("text")).alias("best"), F.count("*").alias("hits"), F.min_by("number", F.struct(F.length("text"), "number")).alias("first_number"))


@query("e06_count_distinct", f"WITH {SONGS} SELECT section_type, count(DISTINCT song_id) AS songs, count(DISTINCT text) AS texts FROM songs GROUP BY section_type")
def e06(lib: L) -> DataFrame:
    return lib.songs.groupBy("section_type").agg(F.countDistinct("song_id").alias("songs"), F.countDistinct("text").alias("texts"))


@query("e07_duplicate_keys", f"{W}, g AS (SELECT source_id, title, count(*) AS n FROM works GROUP BY ALL HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(CAST(sum(n) AS BIGINT), 0) AS rows FROM g")
def e07(lib: L) -> DataFrame:
    d = op.duplicate_keys(lib.works.select("source_id", "title"), ["source_id", "title"])
    return d.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


@query("e08_having_ratio", f"WITH {SONGS} SELECT song_id, count(*) AS sections, max(length(text)) AS longest, min(length(text)) AS shortest FROM songs GROUP BY song_id HAVING count(*) >= 3 ORDER BY max(length(text)) / greatest(1, min(length(text))) DESC, song_id LIMIT 5")
def e08(lib: L) -> DataFrame:
    g = lib.songs.groupBy("song_id").agg(F.count("*").alias("sections"), F.max(F.length("text")).alias("longest"), F.min(F.length("text")).alias("shortest")).filter("sections >= 3")
    return g.orderBy(F.desc(F.col("longest") / F.greatest(F.lit(1), "shortest")), "song_id").limit(5)


@query("e09_counts_per_parent", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS orders, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer c")
def e09(lib: L) -> DataFrame:
    o = lib.table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return op.per_parent_counts(lib.table("customer").select("c_custkey"), "c_custkey", {"orders": o, "open_orders": o.filter("o_orderstatus = 'O'")})


@query("e10_ordered_concat", f"WITH {SONGS} SELECT song_id, string_agg(section_type || ':' || length(text), chr(30) ORDER BY section_order) AS outline FROM songs GROUP BY song_id")
def e10(lib: L) -> DataFrame:
    s = lib.songs.withColumn("t", F.concat_ws(":", "section_type", F.length("text").cast("string")))
    return op.ordered_concat(s, ["song_id"], "section_order", "t", "\x1e", "outline")


@query("e11_issue_counts", f"{WP} SELECT issue, count(*) AS n FROM (SELECT CASE WHEN length(text) < 20 THEN 'short' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'shout' END AS issue FROM paras) WHERE issue IS NOT NULL GROUP BY issue ORDER BY n DESC, issue")
def e11(lib: L) -> DataFrame:
    issue = F.when(F.length("text") < 20, "short").when(F.col("text").contains("|"), "table").when(F.col("text").contains("!!"), "shout")
    return lib.paragraphs.select(issue.alias("issue")).filter("issue IS NOT NULL").groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue")


@query("e12_conditional_counters", f"{W} SELECT count(*) FILTER (year = 0) AS undated, count(*) FILTER (content_type = 'letter') AS letters, CAST(sum(length(text)) AS BIGINT) AS characters FROM works")
def e12(lib: L) -> DataFrame:
    return lib.works.agg(F.count_if(F.col("year") == 0).alias("undated"), F.count_if(F.col("content_type") == "letter").alias("letters"), F.sum(F.length("text")).alias("characters"))


@query("e13_tally_with_examples", f"""{WP}, d AS (SELECT source_id, 'short' AS defect, paragraph_id FROM paras WHERE length(text) < 20 UNION ALL SELECT source_id, 'no_stop', paragraph_id FROM paras WHERE NOT regexp_matches(text, '[.!?]$'))
SELECT source_id, defect, count(*) AS n, string_agg(CAST(paragraph_id AS VARCHAR), ',' ORDER BY paragraph_id) FILTER (rn <= 4) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY source_id, defect ORDER BY paragraph_id) AS rn FROM d) GROUP BY ALL""")
def e13(lib: L) -> DataFrame:
    t = F.col("text")
    defects = F.array_compact(F.array(F.when(F.length(t) < 20, "short"), F.when(~t.rlike("[.!?]$"), "no_stop")))
    d = lib.paragraphs.select("source_id", "paragraph_id", F.explode(defects).alias("defect"))
    counts = d.groupBy("source_id", "defect").agg(F.count("*").alias("n"))
    some = op.top_per_group(d, ["source_id", "defect"], [F.col("paragraph_id")], 4).groupBy("source_id", "defect").agg(F.array_join(F.transform(F.sort_array(F.collect_list("paragraph_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return counts.join(some, ["source_id", "defect"])


@query("e14_vocabulary", rf"""{W} SELECT language, token, count(*) AS n FROM (SELECT language, unnest(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')) AS token FROM works) GROUP BY ALL""")
def e14(lib: L) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    return lib.works.select("language", F.explode(words).alias("token")).groupBy("language", "token").agg(F.count("*").alias("n"))


@query("e15_extremes_and_median", """SELECT o_orderstatus, max(o_totalprice) AS top, min(o_totalprice) AS low, round(avg(o_totalprice), 4) AS mean, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median FROM orders GROUP BY o_orderstatus""")
def e15(lib: L) -> DataFrame:
    # the middle row by rank instead of a list of all values
    o = lib.table("orders").select("o_orderstatus", "o_totalprice")
    stats = o.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"))
    ranked = o.withColumn("rn", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_totalprice")))
    middle = ranked.join(F.broadcast(stats.select("o_orderstatus", "n")), "o_orderstatus").filter("rn = n div 2 + 1").select("o_orderstatus", F.col("o_totalprice").alias("median"))
    return stats.drop("n").join(middle, "o_orderstatus")


@query("e16_totals_with_percentage", f"WITH {WORKS}, {AUTHORS} SELECT a.display_name AS author, w.language, CAST(sum(length(w.text)) AS BIGINT) AS total, round(100.0 * sum(CASE WHEN w.year > 0 THEN length(w.text) ELSE 0 END) / sum(length(w.text)), 3) AS dated_percent FROM works w JOIN authors a ON w.author_id = a.author_id GROUP BY ALL")
def e16(lib: L) -> DataFrame:
    n = F.length("text")
    g = lib.works.groupBy("author_id", "language").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("year") > 0, n).otherwise(0)).alias("dated"))
    return g.join(op.small(lib.authors), "author_id").select(F.col("display_name").alias("author"), "language", "total", F.round(F.col("dated") * 100.0 / F.col("total"), 3).alias("dated_percent"))


@query("e17_facet_values", f"{W} SELECT DISTINCT year FROM works WHERE year > 0 ORDER BY year DESC")
def e17(lib: L) -> DataFrame:
    return lib.works.filter("year > 0").select("year").distinct().orderBy(F.desc("year"))


@query("e18_term_statistics", rf"""{WP}, t AS (SELECT paragraph_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+')) AS token FROM paras), tf AS (SELECT paragraph_id, token, count(*) AS tf FROM t WHERE token <> '' GROUP BY ALL)
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM tf GROUP BY token""")
def e18(lib: L) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda x: x != "")
    t = lib.paragraphs.select("paragraph_id", F.explode(words).alias("token")).groupBy("paragraph_id", "token").agg(F.count("*").alias("tf"))
    return t.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query("e19_all_passed", f"{W} SELECT bool_and(length(code) = 8) AS codes_ok, bool_and(year = 0 OR year >= 1947) AS years_ok, min(CASE WHEN NOT (year > 0) THEN code END) AS first_failure FROM works")
def e19(lib: L) -> DataFrame:
    return lib.works.agg(F.bool_and(F.length("code") == 8).alias("codes_ok"), F.bool_and((F.col("year") == 0) | (F.col("year") >= 1947)).alias("years_ok"), F.min(F.when(~(F.col("year") > 0), F.col("code"))).alias("first_failure"))


# ---- F: windows


@query("f01_longest_paragraphs_per_language", f"{WP} SELECT coalesce(language, 'en') AS language, paragraph_id, length(text) AS n, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(language, 'en') ORDER BY length(text) DESC, work_id, number) AS rn FROM paras) WHERE rn <= 100")
def f01(lib: L) -> DataFrame:
    p = lib.paragraphs.select(F.coalesce("language", F.lit("en")).alias("language"), "paragraph_id", F.length("text").alias("n"), "work_id", "number")
    return op.top_per_group(p, ["language"], [F.desc("n"), F.col("work_id"), F.col("number")], 100).select("language", "paragraph_id", "n", "rn")


@query("f02_longest_verses_per_book", f"WITH {VERSES} SELECT book_id, chapter, verse, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY length(text) DESC, chapter, verse, text) AS rn FROM verses) WHERE rn <= 10")
def f02(lib: L) -> DataFrame:
    return op.top_per_group(lib.verses, ["book_id"], [F.desc(F.length("text")), F.col("chapter"), F.col("verse"), F.col("text")], 10).select("book_id", "chapter", "verse", "rn")


_PAGED = "paged AS (SELECT *, CASE WHEN number % 5 = 0 THEN NULL WHEN (paragraph_id * 7) % 13 = 0 THEN number // 3 - 1 ELSE number // 3 END AS page FROM paras)"


def _paged(lib: L) -> DataFrame:
    page = F.when(F.col("number") % 5 == 0, None).when((F.col("paragraph_id") * 7) % 13 == 0, F.expr("number div 3 - 1")).otherwise(F.expr("number div 3"))
    return lib.paragraphs.withColumn("page", page)


@query("f03_page_inversions", f"{WP}, {_PAGED} SELECT work_id, number, before, page FROM (SELECT work_id, number, page, lag(page) OVER (PARTITION BY work_id ORDER BY number) AS before FROM paged) WHERE page < before")
def f03(lib: L) -> DataFrame:
    w = Window.partitionBy("work_id").orderBy("number")
    return _paged(lib).select("work_id", "number", "page", F.lag("page").over(w).alias("before")).filter("page < before")


@query("f04_numbering_gaps", f"{WP}, k AS (SELECT * FROM paras WHERE paragraph_id % 4 <> 1) SELECT work_id, after, before, before - after - 1 AS missing FROM (SELECT work_id, lag(number) OVER (PARTITION BY work_id ORDER BY number) AS after, number AS before FROM k) WHERE before - after > 1")
def f04(lib: L) -> DataFrame:
    return op.number_gaps(lib.paragraphs.filter("paragraph_id % 4 <> 1").select("work_id", "number"), ["work_id"], "number")


@query("f04_start_not_one", f"{WP}, k AS (SELECT * FROM paras WHERE paragraph_id % 4 <> 1) SELECT work_id, min(number) AS first_number FROM k GROUP BY work_id HAVING min(number) <> 1")
def f04b(lib: L) -> DataFrame:
    return lib.paragraphs.filter("paragraph_id % 4 <> 1").groupBy("work_id").agg(F.min("number").alias("first_number")).filter("first_number <> 1")


@query("f05_same_as_previous", f"{WP} SELECT work_id, number FROM (SELECT work_id, number, text, lag(text) OVER (PARTITION BY work_id ORDER BY number) AS before FROM paras) WHERE text = before")
def f05(lib: L) -> DataFrame:
    return lib.paragraphs.withColumn("before", F.lag("text").over(Window.partitionBy("work_id").orderBy("number"))).filter("text = before").select("work_id", "number")


@query("f06_adjacent_rows", f"{WP} SELECT paragraph_id, lag(paragraph_id) OVER (PARTITION BY work_id ORDER BY number) AS previous_paragraph_id, lead(paragraph_id) OVER (PARTITION BY work_id ORDER BY number) AS next_paragraph_id FROM paras")
def f06(lib: L) -> DataFrame:
    return op.neighbours(lib.paragraphs.select("work_id", "number", "paragraph_id"), ["work_id"], "number", ["paragraph_id"]).drop("work_id", "number")


@query("f07_renumber_accepted", f"{WP} SELECT paragraph_id, CAST(row_number() OVER (PARTITION BY work_id ORDER BY number) AS INTEGER) AS renumbered FROM paras WHERE length(text) >= 40")
def f07(lib: L) -> DataFrame:
    accepted = lib.paragraphs.filter(F.length("text") >= 40)
    return accepted.select("paragraph_id", F.row_number().over(Window.partitionBy("work_id").orderBy("number")).alias("renumbered"))


_DETECTED = "det AS (SELECT work_id, number AS pos, CASE WHEN (paragraph_id * 31) % 3 = 0 THEN CAST((paragraph_id * 17) % 9 + number // 2 AS INTEGER) END AS detected FROM paras)"


def _detected(lib: L) -> DataFrame:
    d = F.when((F.col("paragraph_id") * 31) % 3 == 0, ((F.col("paragraph_id") * 17) % 9 + F.expr("number div 2")).cast("int"))
    return lib.paragraphs.select("work_id", F.col("number").alias("pos"), d.alias("detected"))


@query("f08_fallback_numbers", f"""{WP}, {_DETECTED}, m AS (SELECT *, detected IS NOT NULL AND detected > 0 AND row_number() OVER (PARTITION BY work_id, detected ORDER BY pos) = 1 AS first FROM det),
k AS (SELECT *, sum(CASE WHEN first THEN 0 ELSE 1 END) OVER (PARTITION BY work_id ORDER BY pos) AS k FROM m),
free AS (SELECT c.work_id, c.v, row_number() OVER (PARTITION BY c.work_id ORDER BY c.v) AS k FROM (SELECT work_id, unnest(range(1, max(pos) + coalesce(max(detected), 0) + 2)) AS v FROM det GROUP BY work_id) c ANTI JOIN (SELECT DISTINCT work_id, detected AS v FROM m WHERE first) h ON c.work_id = h.work_id AND c.v = h.v)
SELECT k.work_id, k.pos, CAST(CASE WHEN k.first THEN k.detected ELSE f.v END AS INTEGER) AS number FROM k LEFT JOIN free f ON k.work_id = f.work_id AND k.k = f.k""")
def f08(lib: L) -> DataFrame:
    return op.fallback_number(_detected(lib), ["work_id"], "pos", "detected").select("work_id", "pos", "number")


@query("f09_monotone_numbers", f"""{WP}, {_DETECTED}, i AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY pos) AS i FROM det)
SELECT work_id, pos, CAST(i + greatest(0, coalesce(max(detected - i) OVER (PARTITION BY work_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS INTEGER) AS number FROM i""")
def f09(lib: L) -> DataFrame:
    return op.running_number(_detected(lib), ["work_id"], "pos", "detected").select("work_id", "pos", "number")


@query("f11_running_section", f"{WP} SELECT work_id, number, sum(CASE WHEN length(text) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY work_id ORDER BY number) AS section, last_value(CASE WHEN length(text) < 60 THEN number END IGNORE NULLS) OVER (PARTITION BY work_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM paras")
def f11(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", "number", F.length("text").alias("n"))
    p = op.running_state(p, ["work_id"], "number", F.col("n") < 60, "section")
    return op.last_seen(p, ["work_id"], "number", F.when(F.col("n") < 60, F.col("number")), "heading").drop("n")


# ---- G: orders, limits, sets


def canonical() -> list:
    """Undated last, then year, date, title, id."""
    return [F.when(F.col("year") > 0, 0).otherwise(1), F.col("year"), F.col("work_date").asc_nulls_first(), F.col("title"), F.col("work_id")]


_CANON = "CASE WHEN year > 0 THEN 0 ELSE 1 END, year, work_date NULLS FIRST, title, work_id"


@query("g01_canonical_order", f"{W} SELECT work_id, CAST(row_number() OVER (ORDER BY {_CANON}) AS INTEGER) AS place FROM works ORDER BY place LIMIT 500")
def g01(lib: L) -> DataFrame:
    # numbered after the limit: no window over all rows
    first = lib.works.select("work_id", "year", "work_date", "title").orderBy(*canonical()).limit(500)
    return first.select("work_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*canonical())).alias("place"))


@query("g04_index_order_top", rf"{WP} SELECT paragraph_id, len(string_split_regex(lower(text), '[^a-z]+the[^a-z]+')) - 1 AS hits FROM paras ORDER BY hits DESC, paragraph_id LIMIT 100")
def g04(lib: L) -> DataFrame:
    hits = (F.size(F.split(F.lower("text"), "[^a-z]+the[^a-z]+")) - 1).alias("hits")
    return lib.paragraphs.select("paragraph_id", hits).orderBy(F.desc("hits"), "paragraph_id").limit(100)


@query("g05_candidates_then_order", f"{WP}, c AS (SELECT * FROM paras WHERE contains(lower(text), 'and the') ORDER BY paragraph_id LIMIT 100) SELECT paragraph_id, length(text) AS n FROM c ORDER BY n DESC, paragraph_id")
def g05(lib: L) -> DataFrame:
    some = lib.paragraphs.filter(F.lower("text").contains("and the")).select("paragraph_id", F.length("text").alias("n")).orderBy("paragraph_id").limit(100)
    return some.orderBy(F.desc("n"), "paragraph_id")


@query("g06_limit_before_join", f"{WP}, {_FIRST}, top AS (SELECT work_id, code FROM works ORDER BY {_CANON} LIMIT 60) SELECT t.work_id, t.code, f.first_text FROM top t LEFT JOIN first f ON t.work_id = f.work_id")
def g06(lib: L) -> DataFrame:
    top = lib.works.orderBy(*canonical()).limit(60).select("work_id", "code")
    p = lib.paragraphs.filter(F.length("text") > 12).join(top.select("work_id"), "work_id", "left_semi").select("work_id", "number", F.col("text").alias("first_text"))
    return op.first_child(top, p, "work_id", [F.col("number")], "left").select("work_id", "code", "first_text")


@query("g07_latest_75", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 75")
def g07(lib: L) -> DataFrame:
    return lib.table("events").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(75).drop("ts")


@query("g08_severity_order", f"{WP} SELECT paragraph_id, severity FROM (SELECT paragraph_id, CASE WHEN contains(text, '!!') THEN 'high' WHEN length(text) < 20 THEN 'medium' WHEN contains(text, '|') THEN 'low' END AS severity FROM paras) WHERE severity IS NOT NULL ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, paragraph_id LIMIT 300")
def g08(lib: L) -> DataFrame:
    severity = F.when(F.col("text").contains("!!"), "high").when(F.length("text") < 20, "medium").when(F.col("text").contains("|"), "low")
    weight = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    return lib.paragraphs.select("paragraph_id", severity.alias("severity")).filter("severity IS NOT NULL").orderBy(F.desc(weight), "paragraph_id").limit(300)


@query("g09_merge_ranked", f"""{W}, a AS (SELECT work_id, 0 AS tier, row_number() OVER (ORDER BY work_id) AS pos FROM (SELECT work_id FROM works WHERE contains(lower(title), 'the') ORDER BY work_id LIMIT 40)), b AS (SELECT work_id, 1 AS tier, row_number() OVER (ORDER BY work_id DESC) AS pos FROM (SELECT work_id FROM works WHERE year > 1960 ORDER BY work_id DESC LIMIT 40)),
u AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY tier, pos) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT work_id, tier FROM u WHERE rn = 1 ORDER BY tier, pos LIMIT 50""")
def g09(lib: L) -> DataFrame:
    a = lib.works.filter(F.lower("title").contains("the")).select("work_id").orderBy("work_id").limit(40).withColumn("pos", F.col("work_id"))
    b = lib.works.filter("year > 1960").select("work_id").orderBy(F.desc("work_id")).limit(40).withColumn("pos", -F.col("work_id"))
    return op.merge_ranked([a, b], "work_id", "pos", 50).select("work_id", "tier")


@query("g10_distinct_nocase", "SELECT lower(p_brand) AS brand, min(p_partkey) AS first_part FROM part GROUP BY lower(p_brand)")
def g10(lib: L) -> DataFrame:
    return lib.table("part").groupBy(F.lower("p_brand").alias("brand")).agg(F.min("p_partkey").alias("first_part"))


@query("g11_number_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 3")
def g11(lib: L) -> DataFrame:
    return lib.table("customer").select(F.col("c_custkey").alias("k")).subtract(lib.table("orders").filter("o_orderkey % 10 < 3").select("o_custkey"))


@query("g12_multiset_difference", f"{WP}, a AS (SELECT source_id, text, count(*) AS a FROM paras GROUP BY ALL), b AS (SELECT source_id, text, count(*) AS b FROM paras WHERE work_id % 2 = 0 GROUP BY ALL) SELECT a.source_id, a.text, a - coalesce(b, 0) AS missing FROM a LEFT JOIN b ON a.source_id = b.source_id AND a.text = b.text WHERE a - coalesce(b, 0) > 0")
def g12(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", "source_id", "text")
    return op.multiset_difference(p, p.filter("work_id % 2 = 0"), ["source_id", "text"])


@query("g13_all_contained", rf"""WITH b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')) AS w FROM benchmark) SELECT x.item_id, list_has_all(y.w, x.w[1:3]) AS contained FROM b x JOIN b y ON y.item_id = x.item_id + 1""")
def g13(lib: L) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+"), lambda x: x != ""))
    b = lib.table("benchmark").select("item_id", words.alias("w"))
    y = b.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("v"))
    return b.join(y, "item_id").select("item_id", (F.size(F.array_except(F.slice("w", 1, 3), "v")) == 0).alias("contained"))


@query("g14_concat_lists", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def g14(lib: L) -> DataFrame:
    c = lib.table("customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(lib.table("supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
