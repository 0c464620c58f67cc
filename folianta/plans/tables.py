"""Sources and mutations (A, B), and reservations (D9)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.model import Library, lines_of
from folianta.operators import mutations as mu
from folianta.operators import relational as op
from folianta.operators.index import shared_folder
from folianta.plans.catalog import AUTHORS, PARAS, SEARCH_TEXT, SOURCES, VERSES, WORKS, W, WP, query
from folianta.sources import readers as rd
from folianta.sources import reports
from folianta.streaming.reservations import latest_state, reserve, windowed_counts

L = Library

# ---- A: sources


@query("a01_table_scan", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def a01(lib: L) -> DataFrame:
    r = F.broadcast(lib.table("region").withColumnRenamed("r_regionkey", "n_regionkey"))
    return lib.table("nation").join(r, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("a02_parameterised_sql", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'MACHINERY'")
def a02(lib: L) -> DataFrame:
    sql = "SELECT c_custkey, c_name FROM customer_view WHERE c_acctbal > :least AND c_mktsegment = :segment"
    return rd.query_rows(lib.spark, sql, {"customer_view": lib.table("customer")}, least=5000, segment="MACHINERY")


@query("a03_index_scan", rf"{WP} SELECT paragraph_id FROM paras WHERE list_has_all(string_split_regex(lower(text), '[^\p{{L}}\p{{Nd}}]+'), ['of', 'with'])")
def a03(lib: L) -> DataFrame:
    words = F.split(F.lower("text"), r"[^\p{L}\p{Nd}]+")
    return lib.paragraphs.filter(F.array_contains(words, "of") & F.array_contains(words, "with")).select("paragraph_id")


def _placed_words(lib: L) -> DataFrame:
    """Words of the lines of documents, placed on pages as a printer would."""
    p = lib.paragraphs.select("work_id", "number", F.posexplode(F.split("text", " +")).alias("i", "text")).filter("text <> ''")
    return p.select(F.col("work_id").alias("page"), (F.col("i") * 10.0).alias("x"), (F.lit(700.0) - F.col("number") * 12 - F.col("i") % 2).alias("y"), F.lit(8.0).alias("w"), "text")


@query("a04_page_lines", f"{WP} SELECT work_id AS page, CAST(row_number() OVER (PARTITION BY work_id ORDER BY number) AS BIGINT) AS line, trim(regexp_replace(text, ' +', ' ', 'g')) AS text FROM paras")
def a04(lib: L) -> DataFrame:
    return rd.lines_of_words(_placed_words(lib))


@query("a05_two_columns")
def a05(lib: L) -> DataFrame:
    # lines are wrapped at the column's width; only x and the width of a word place it in a column
    words = _placed_words(lib).withColumn("x", F.col("x") % 190)
    right = words.withColumn("x", F.col("x") + 310)
    return rd.with_columns_of_page(words.union(right), 500.0).groupBy("page", "column").agg(F.count("*").alias("words"))


@query("a06_page_text_lines")
def a06(lib: L) -> DataFrame:
    return lib.table("pages").select("page_id", F.posexplode(rd.html_lines(F.col("html"))).alias("line", "text"))


@query("a08_stanzas", r"""SELECT conv_id, turn, pos - 1 AS stanza, s AS text FROM (SELECT conv_id, turn, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT conv_id, turn,
list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n[ \t]*(?:\n[ \t]*)+'), lambda x: trim(regexp_replace(x, '^\n+|\n+$', '', 'g'))), lambda x: x <> '') AS l FROM conversations))""")  # fmt: skip
def a08(lib: L) -> DataFrame:
    text = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    return lib.table("conversations").select("conv_id", "turn", F.posexplode(rd.stanzas(text)).alias("stanza", "text"))


@query("a09_verse_rows", """SELECT book, chapter, verse, text, reason FROM (SELECT CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE 'B' || l_orderkey END AS book, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CAST(l_orderkey % 50 AS INTEGER) END AS chapter, l_linenumber AS verse, 'part ' || l_partkey AS text,
CASE WHEN l_orderkey % 17 = 0 THEN 'book is missing' WHEN l_orderkey % 13 = 0 OR l_orderkey % 50 < 1 THEN 'chapter is not a positive number' END AS reason FROM lineitem)""")  # fmt: skip
def a09(lib: L) -> DataFrame:
    k = F.col("l_orderkey")
    raw = lib.table("lineitem").select(
        F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit(" B"), k.cast("string"))).alias("Book"), F.when(k % 13 == 0, "x").otherwise((k % 50).cast("string")).alias("CHAPTER"),
        F.col("l_linenumber").cast("string").alias(" verse"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("Text"),
    )
    return rd.verse_rows(rd.by_header(raw, ("book", "chapter", "verse", "text")))


@query("a10_catalog_lookups", "SELECT CAST(count(DISTINCT lower(url)) AS BIGINT) AS paths, CAST(count(DISTINCT lower(regexp_extract(url, '([^/]*)$', 1))) AS BIGINT) AS names FROM pages")
def a10(lib: L) -> DataFrame:
    by_path, by_name = rd.catalog_lookups(lib.table("pages").select(F.col("url").alias("path"), F.col("page_id").alias("entry")))
    return by_path.agg(F.count("*").alias("paths")).withColumn("names", by_name.agg(F.count("*").alias("n")).scalar())


def _verse_lines(lib: L, chapter: str, verse: str) -> DataFrame:
    """Orders as files: a chapter mark before each order's first line, a verse mark before every other line."""
    li = lib.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    c = (o % 20 + 1).cast("string")
    head = F.format_string(chapter, c) if chapter else F.lit(None).cast("string")
    body = F.format_string(verse, c, n.cast("string"), F.col("p").cast("string")) if chapter == "" else F.format_string(verse, n.cast("string"), F.col("p").cast("string"))
    lines = F.array_compact(F.array(F.when(n == 1, head), body, F.concat(F.lit("and more "), F.col("p").cast("string"))))
    return li.select(F.expr("l_orderkey div 20").alias("file"), o, n, F.posexplode(lines).alias("k", "line")).select("file", (o * 1000 + n * 10 + F.col("k")).alias("pos"), "line")


_LI = "li AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY ALL)"


@query("a11_plain_verses", f"WITH {_LI} SELECT o // 20 AS file, CAST(sum(CASE WHEN o % 20 + 1 = 1 AND n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o // 20 ORDER BY o, n) AS BIGINT) AS book, CAST(o % 20 + 1 AS INTEGER) AS chapter, n AS verse, 'part ' || p || ' and more ' || p AS text FROM li")
def a11(lib: L) -> DataFrame:
    return rd.plain_verses(_verse_lines(lib, "", "%s:%s part %s"))


@query("a12_chapter_files", f"{WP} SELECT 'book_' || (work_id % 30) || '_' || work_id AS file, CAST(work_id AS INTEGER) AS chapter, number AS verse, text, CASE WHEN work_id % 9 = 0 THEN 'header and file differ' END AS fault FROM paras")
def a12(lib: L) -> DataFrame:
    header = F.concat(F.lit("Chapter "), F.when(F.col("work_id") % 9 == 0, F.col("work_id") + 1).otherwise(F.col("work_id")).cast("string"))
    w = lib.works.select(
        F.concat(F.lit("book_"), (F.col("work_id") % 30).cast("string"), F.lit("_"), F.col("work_id").cast("string")).alias("file"),
        F.concat(header, F.lit("\n"), F.array_join(lines_of(F.col("text")), "\n"), F.lit("\n")).alias("text"), F.size(lines_of(F.col("text"))).alias("n"),
    )
    return rd.chapter_files(w.filter("n > 0").drop("n"))


@query("a13_usfm_verses", f"WITH {_LI} SELECT o // 20 AS file, CAST(last_value(CASE WHEN n = 1 THEN o % 20 + 1 END IGNORE NULLS) OVER (PARTITION BY o // 20 ORDER BY o, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS chapter, n AS verse, 'part ' || p || ' and more ' || p AS text FROM li")
def a13(lib: L) -> DataFrame:
    return rd.usfm_verses(_verse_lines(lib, "\\c %s", "\\v %s \\w part\\w* %s"))


@query("a14_corrections", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'paragraph' ELSE 'title' END AS op, o_orderstatus AS old, o_orderpriority AS new FROM orders")
def a14(lib: L) -> DataFrame:
    o = F.col("o_orderkey")
    line = F.to_json(F.struct(F.when(o % 2 == 0, "paragraph").otherwise("title").alias("op"), o.alias("id"), F.col("o_orderstatus").alias("old"), F.col("o_orderpriority").alias("new")))
    c = lib.table("orders").select(rd.parse_corrections(line).alias("c"))
    return c.select(F.col("c.id").cast("long").alias("id"), "c.op", "c.old", "c.new")


@query("a15_directory_scan", "SELECT * FROM (VALUES ('benchmark.parquet'), ('customer.parquet'), ('nation.parquet'), ('orders.parquet'), ('part.parquet'), ('region.parquet'), ('supplier.parquet')) AS v(name)")
def a15(lib: L) -> DataFrame:
    f = rd.files(lib.spark, lib.sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"))
    wanted = ["benchmark", "customer", "nation", "orders", "part", "region", "supplier"]
    return f.filter(F.col("name").isin([f"{w}.parquet" for w in wanted])).orderBy(F.lower("name"))


@query("a16_catalog_introspection", "SELECT * FROM (VALUES ('nation', 3), ('region', 2), ('supplier', 4)) AS v(name, n_columns)")
def a16(lib: L) -> DataFrame:
    found = rd.describe_catalog({n: lib.table(n) for n in ("region", "nation", "supplier")})
    return lib.spark.createDataFrame([(n, k) for n, _, k, _ in found], "name string, n_columns int")


# ---- B: mutations


@query("b01_insert_family", f"{WP} SELECT w.work_id, w.code, count(p.paragraph_id) AS children, 'imported' AS status FROM works w LEFT JOIN paras p ON w.work_id = p.work_id GROUP BY ALL")
def b01(lib: L) -> DataFrame:
    counted = op.per_parent_counts(lib.works.select("work_id", "code"), "work_id", {"children": lib.paragraphs.select("work_id")})
    return counted.withColumn("status", F.lit("imported"))


@query("b02_materialised_index", f"WITH {WORKS}, {PARAS}, {SOURCES}, {AUTHORS} SELECT p.paragraph_id, p.work_id, {SEARCH_TEXT.format('p.text')} AS search_text, w.title, w.code, a.display_name AS author, s.display_name AS source_name FROM paras p JOIN works w ON p.work_id = w.work_id LEFT JOIN authors a ON w.author_id = a.author_id LEFT JOIN sources s ON w.source_id = s.source_id")
def b02(lib: L) -> DataFrame:
    from folianta.operators.search import index_of

    return index_of(lib).entries.select("paragraph_id", "work_id", "search_text", "title", "code", "author", "source_name")


@query("b03_upsert", """WITH s AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier WHERE s_suppkey % 4 <> 0), i AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_nationkey END AS v FROM supplier WHERE s_suppkey % 3 = 0)
SELECT coalesce(s.k, i.k) AS k, CASE WHEN s.k IS NULL OR (i.k IS NOT NULL AND s.v IS DISTINCT FROM i.v) THEN i.v ELSE s.v END AS v, CASE WHEN s.k IS NULL THEN 'inserted' WHEN i.k IS NOT NULL AND s.v IS DISTINCT FROM i.v THEN 'updated' ELSE 'kept' END AS action FROM s FULL JOIN i ON s.k = i.k""")  # fmt: skip
def b03(lib: L) -> DataFrame:
    t = lib.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    incoming = t.filter("k % 3 = 0").withColumn("v", F.when(F.col("k") % 6 != 0, F.col("v")))
    return mu.upsert(t.filter("k % 4 <> 0"), incoming, ["k"], ["v"])


@query("b04_insert_or_ignore", "SELECT c_custkey AS k, 'stored' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'incoming' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def b04(lib: L) -> DataFrame:
    c = lib.table("customer").select(F.col("c_custkey").alias("k"))
    return mu.insert_missing(c.filter("k % 2 = 0").withColumn("origin", F.lit("stored")), c.filter("k % 3 = 0").withColumn("origin", F.lit("incoming")), ["k"])


@query("b05_backfill", f"{W} SELECT work_id, coalesce(CASE WHEN work_id % 5 <> 0 THEN content_type END, CASE WHEN source_id = 1 THEN 'Circular letter' ELSE 'Sermon' END) AS content_type FROM works")
def b05(lib: L) -> DataFrame:
    w = lib.works.select("work_id", "source_id", F.when(F.col("work_id") % 5 != 0, F.col("content_type")).alias("content_type"))
    return mu.backfill(w, "content_type", F.when(F.col("source_id") == 1, "Circular letter").otherwise("Sermon")).select("work_id", "content_type")


@query("b06_delete_in_order", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))")
def b06(lib: L) -> DataFrame:
    c = lib.table("customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    doomed = lib.table("orders").join(c, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return mu.delete_in(lib.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), doomed, "l_orderkey")


@query("b07_set_null", f"{W} SELECT work_id, CASE WHEN source_id < 10 THEN source_id END AS source_id FROM works")
def b07(lib: L) -> DataFrame:
    removed = lib.sources.filter("source_id >= 10").select("source_id")
    return mu.set_null(lib.works.select("work_id", "source_id"), removed, "source_id", "source_id").select("work_id", "source_id")


@query("b08_replace_all", f"WITH {VERSES}, i AS (SELECT DISTINCT book_id, chapter, verse, 'new' AS text FROM verses WHERE book_id IN (3, 4) AND verse <= 2) SELECT book_id, chapter, verse, text FROM verses WHERE book_id NOT IN (3, 4) UNION ALL SELECT * FROM i")
def b08(lib: L) -> DataFrame:
    v = lib.verses
    incoming = op.keep_one(v.filter("book_id IN (3, 4) AND verse <= 2").withColumn("text", F.lit("new")), ["book_id", "chapter", "verse"], [F.desc("text")])
    return mu.replace_all(v, incoming, ["book_id"])


@query("b09_refresh_index", f"{WP} SELECT paragraph_id, CASE WHEN work_id % 10 = 0 THEN lower(text) ELSE text END AS entry FROM paras WHERE NOT (work_id % 10 = 0 AND number > 2)")
def b09(lib: L) -> DataFrame:
    p = lib.paragraphs
    index = p.select("work_id", "paragraph_id", F.col("text").alias("entry"))
    touched = lib.works.filter("work_id % 10 = 0").select("work_id")
    rebuilt = p.filter("number <= 2").select("work_id", "paragraph_id", F.lower("text").alias("entry"))
    return mu.refresh(index, touched, rebuilt, "work_id").select("paragraph_id", "entry")


@query("b10_compare_and_set", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 100 = 7 THEN 'Z' ELSE o_orderstatus END AS v, o_orderkey % 100 = 7 AS applied FROM orders")
def b10(lib: L) -> DataFrame:
    t = lib.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    fixes = t.filter("k % 100 = 7").select("k", F.col("v").alias("old"), F.lit("Z").alias("new"))
    return mu.compare_and_set(t, fixes, "k", "v")


@query("b10_compare_and_set_refused", "SELECT o_orderkey AS k, o_orderstatus AS v, false AS applied FROM orders")
def b10_refused(lib: L) -> DataFrame:
    t = lib.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    fixes = t.filter("k % 100 = 7").select("k", F.when(F.col("k") == 107, "?").otherwise(F.col("v")).alias("old"), F.lit("Z").alias("new"))
    return mu.compare_and_set(t, fixes, "k", "v")


@query("b11_positional_plan", f"{WP}, a AS (SELECT work_id, number, text AS old FROM paras WHERE work_id % 4 <> 0 OR number <= 3), b AS (SELECT work_id, number, CASE WHEN number = 2 THEN 'changed' ELSE text END AS new FROM paras WHERE work_id % 3 <> 0 OR number <= 5) SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.work_id IS NULL THEN 'delete' WHEN a.work_id IS NULL THEN 'insert' WHEN old IS NOT DISTINCT FROM new THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b ON a.work_id = b.work_id AND a.number = b.number) GROUP BY action")
def b11(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", "number", "text")
    wanted = p.filter("work_id % 3 <> 0 OR number <= 5").withColumn("text", F.when(F.col("number") == 2, "changed").otherwise(F.col("text")))
    return mu.positional_plan(p.filter("work_id % 4 <> 0 OR number <= 3"), wanted, "work_id", "number", "text").groupBy("action").agg(F.count("*").alias("n"))


@query("b12_keyed_plan", f"{WP}, a AS (SELECT work_id, number, text AS old FROM paras WHERE NOT (work_id % 4 = 0 AND number % 5 = 0)), b AS (SELECT work_id, number, CASE WHEN number = 2 THEN 'changed' ELSE text END AS new FROM paras WHERE NOT (work_id % 3 = 0 AND number % 7 = 0)), r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT action, count(*) AS n FROM (SELECT CASE WHEN b.work_id IS NULL AND r.doc_id IS NOT NULL THEN 'guard' WHEN b.work_id IS NULL THEN 'delete' WHEN a.work_id IS NULL THEN 'insert' WHEN old IS NOT DISTINCT FROM new THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b ON a.work_id = b.work_id AND a.number = b.number LEFT JOIN r ON coalesce(a.work_id, b.work_id) = r.doc_id) GROUP BY action")
def b12(lib: L) -> DataFrame:
    p = lib.paragraphs.select("work_id", "number", "text")
    # the two sides lack other paragraphs
    stored = p.filter("NOT (work_id % 4 = 0 AND number % 5 = 0)")
    wanted = p.filter("NOT (work_id % 3 = 0 AND number % 7 = 0)").withColumn("text", F.when(F.col("number") == 2, "changed").otherwise(F.col("text")))
    referenced = stored.select("work_id", "number").join(lib.favourites, "work_id", "left_semi")
    return mu.keyed_plan(stored, wanted, ["work_id", "number"], "text", referenced).groupBy("action").agg(F.count("*").alias("n"))


@query("b13_toggled", "SELECT user_id, event_type, count(*) AS toggles FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def b13(lib: L) -> DataFrame:
    return mu.toggled(lib.table("events"), ["user_id", "event_type"])


def _report(lib: L) -> DataFrame:
    return lib.works.filter("work_id IS NOT NULL").select("work_id", "code", F.concat(F.lit(' "'), F.col("title"), F.lit('", ')).alias("title"), "year")


_REPORT = f"""{W} SELECT work_id, code, ' "' || title || '", ' AS title, year FROM works WHERE work_id IS NOT NULL"""


@query("b14_csv_report", _REPORT)
def b14(lib: L) -> DataFrame:
    path = f"{shared_folder(lib.spark)}/reports/{uuid.uuid4().hex}"
    reports.write_csv(_report(lib), path)
    return lib.spark.read.schema("work_id long, code string, title string, year int").csv(path, header=True, escape='"', multiLine=True)


@query("b14_json_report", _REPORT)
def b14_json(lib: L) -> DataFrame:
    path = f"{shared_folder(lib.spark)}/reports/{uuid.uuid4().hex}"
    reports.write_json_lines(_report(lib), path)
    return lib.spark.read.schema("work_id long, code string, title string, year int").json(path)


@query("b15_snapshot", f"{W} SELECT count(*) AS n, true AS matches FROM works")
def b15(lib: L) -> DataFrame:
    works = lib.works
    at = reports.snapshot(works, f"{shared_folder(lib.spark)}/snapshots/{uuid.uuid4().hex}", 1)
    return lib.spark.read.parquet(at).agg(F.count("*").alias("n")).withColumn("matches", F.lit(reports.snapshot_matches(lib.spark, works, at)))


@query("b16_rebuild_needed", f"{WP} SELECT count(*) AS source_rows, count(*) FILTER (number > 1) AS index_rows, count(*) <> count(*) FILTER (number > 1) AS rebuild FROM paras")
def b16(lib: L) -> DataFrame:
    return mu.rebuild_needed(lib.paragraphs, lib.paragraphs.filter("number > 1"))


# ---- D9 and logs


@query("d09_reservation", "SELECT 'v1' AS tag, c_custkey AS subscriber_id FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 1) ORDER BY c_acctbal, c_custkey LIMIT 100")
def d09(lib: L) -> DataFrame:
    subscribers = lib.table("customer").select(F.col("c_custkey").alias("subscriber_id"), (F.col("c_custkey") % 3 != 0).alias("confirmed"), F.col("c_acctbal").alias("created_at"))
    deliveries = lib.table("orders").filter("o_orderkey % 50 = 1").select(F.lit("v1").alias("tag"), F.col("o_custkey").alias("subscriber_id"))
    return reserve(subscribers, deliveries, "v1", 100)


@query("l01_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def l01(lib: L) -> DataFrame:
    return latest_state(lib.table("events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("ext_windowed_counts", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_windows(lib: L) -> DataFrame:
    return windowed_counts(lib.table("events")).withColumn("total", F.round("total", 4))


@query("ext_rollup", "SELECT coalesce(l_returnflag, '') AS flag, coalesce(l_linestatus, '') AS status, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(lib: L) -> DataFrame:
    r = lib.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("l_returnflag", F.lit("")).alias("flag"), F.coalesce("l_linestatus", F.lit("")).alias("status"), "n")
