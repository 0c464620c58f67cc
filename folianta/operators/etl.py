"""From pages to numbered, filtered and deduplicated paragraphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianta.functions import names
from folianta.functions import text as tx
from folianta.operators.relational import keep_one

#: Characters that a packed chunk prefers, and beyond which a block is packed at all.
PREFERRED, HARD = 900, 1400
#: Closing characters after which a paragraph doesn't go on.
CLOSING = ".!?:;\"”’)]"
#: Words that mark a header or footer beside short lines; fixed values, extended by a library's own names.
HEADER_WORDS = ("CIRCULAR LETTER", "MISSION CENTER", "POSTFACH", "WWW.", "HTTP", "E-MAIL", "EMAIL", "FAX", "TELEPHONE", "PHONE", "PAGE")

_NUMBERED = r"(?m)(?=^\s*\d{1,4}\s+[A-Z][a-z])"


def pack_sentences(text: Column, preferred: int = PREFERRED, hard: int = HARD) -> Column:
    """A text longer than ``hard`` as chunks of whole sentences, each filled up to ``preferred``; a shorter one as it is."""
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(a: Column, s: Column) -> Column:
        full = (F.length(a["now"]) > 0) & (F.length(a["now"]) + F.length(s) + 1 > preferred)
        done = F.when(full, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        now = F.when(full | (F.length(a["now"]) == 0), s).otherwise(F.concat(a["now"], F.lit(" "), s))
        return F.struct(done.alias("done"), now.alias("now"))

    packed = F.aggregate(sentences, empty, add, lambda a: F.filter(F.concat(a["done"], F.array(a["now"])), lambda x: x != ""))
    return F.when(F.length(text) <= hard, F.filter(F.array(text), lambda x: F.trim(x) != "")).otherwise(packed)


def split_numbered(text: Column) -> Column:
    """A block at lines that open with a number and a capitalised word, if there are two or more of them."""
    parts = F.filter(F.split(text, _NUMBERED), lambda x: F.trim(x) != "")
    return F.when(F.regexp_count(text, F.lit(_NUMBERED)) <= 1, F.array(text)).otherwise(parts)


def page_blocks(text: Column) -> Column:
    """Blocks of a page between blank lines, cut further at numbered lines."""
    blocks = F.filter(F.transform(F.split(text, r"(?:\n\s*){2,}"), lambda x: F.trim(x)), lambda x: x != "")
    return F.flatten(F.transform(blocks, split_numbered))


def candidates(pages: DataFrame) -> DataFrame:
    """Paragraph candidates of pages (work_id, page, text): work_id, page, pos, detected, text.

    A detected number is taken off its text; blocks without one are packed by sentences.
    """
    cleaned = pages.withColumn("clean", tx.clean_extracted(F.col("text"), True))
    blocks = cleaned.select("work_id", "page", F.posexplode(page_blocks(F.col("clean"))).alias("b", "block")).withColumn("flat", tx.flatten_spaces(F.col("block")))
    detected = tx.leading_number(F.col("flat"))
    parts = F.when(detected.isNotNull(), F.array(tx.without_leading_number(F.col("flat")))).otherwise(pack_sentences(F.col("flat")))
    out = blocks.select("work_id", "page", "b", detected.alias("detected"), F.posexplode(parts).alias("c", "text")).filter(F.trim("text") != "")
    return out.select("work_id", "page", (F.col("page") * F.lit(10_000_000) + F.col("b") * F.lit(10_000) + F.col("c")).cast("long").alias("pos"), "detected", "text")


def rejoin(rows: DataFrame) -> DataFrame:
    """Paragraphs that a page break cut, joined again; one pass over each work in order.

    The joined paragraph keeps the page it began on, and the next one is held against that page:
    a running state that a lag can't express, so each work is folded in Python.
    """

    def fold(work: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for page, pos, detected, text in work.sort_values("pos")[["page", "pos", "detected", "text"]].itertuples(index=False):
            if out and _goes_on(out[-1], page, detected, text):
                out[-1][3] += ("" if out[-1][3].endswith("-") else " ") + text
            else:
                out.append([page, pos, detected, text])
        done = pd.DataFrame(out, columns=["page", "pos", "detected", "text"])
        done.insert(0, "work_id", work["work_id"].iloc[0])
        done["detected"] = done["detected"].astype("Int32")
        return done

    return rows.select("work_id", "page", "pos", "detected", "text").groupBy("work_id").applyInPandas(fold, "work_id long, page int, pos long, detected int, text string")


def _goes_on(last: list, page: int, detected, text: str) -> bool:
    before, after = last[3].rstrip(), text.lstrip()
    if last[0] == page or not pd.isna(last[2]) or not pd.isna(detected) or not before or not after:
        return False
    return before.endswith("-") or (before[-1] not in CLOSING and after[0].islower())


def accepted_numbers(rows: DataFrame, reach: int = 5) -> DataFrame:
    """Detected numbers that are believed: unused, and at most ``reach`` above the last believed one (the first: at most ``reach``)."""

    def fold(work: pd.DataFrame) -> pd.DataFrame:
        work = work.sort_values("pos")
        last, out = 0, []
        for d in work["detected"]:
            good = not pd.isna(d) and last < d <= last + reach
            out.append(int(d) if good else None)
            last = int(d) if good else last
        return pd.DataFrame({"work_id": work["work_id"], "pos": work["pos"], "accepted": pd.array(out, "Int32")})

    return rows.select("work_id", "pos", "detected").groupBy("work_id").applyInPandas(fold, "work_id long, pos long, accepted int")


def header_key(text: Column) -> Column:
    """Collapsed upper-case text of a line that could be a header: 3 to 140 characters; else empty."""
    key = F.when(F.length(text) <= 140, tx.collapsed_upper(text)).otherwise("")
    return F.when(F.length(key) >= 3, key).otherwise("")


def repeated_headers(rows: DataFrame) -> DataFrame:
    """(work_id, header_key) of lines that come twice or more, on two pages or more where pages are known, and look like a header."""
    word = F.size(F.filter(F.split("header_key", r"[^\p{L}\p{Nd}]+"), lambda x: x != ""))
    marked = F.col("header_key").rlike("|".join(rf"\b{w.replace('.', '[.]')}" for w in HEADER_WORDS))
    keyed = rows if "header_key" in rows.columns else rows.withColumn("header_key", tx.once(header_key(F.col("text"))))
    keyed = keyed.filter("header_key <> ''")
    counted = keyed.groupBy("work_id", "header_key").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))
    likely = marked | ((F.length("header_key") <= 32) & (word <= 4))
    return counted.filter((F.col("n") >= 2) & ((F.col("pages") == 0) | (F.col("pages") >= 2)) & likely).select("work_id", "header_key")


def verdicts(rows: DataFrame) -> DataFrame:
    """Rows with ``verdict``, the first that fits: too_short (empty), page_number, corrupted, header_footer, too_short, accepted."""
    text = F.col("text")
    counted = {
        "__visible": F.length(F.regexp_replace(text, r"[\s\x0B]+", "")),
        "__letters": F.length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", "")),
        "__odd": F.length(F.regexp_replace(text, r"[\p{L}\p{Nd}\s\x0B.,;:!?'\"()\[\]/&-]+", "")),
        "__words": F.when(F.length(text) < 24, F.size(F.filter(F.split(text, r"[^\p{L}\p{Nd}]+"), lambda x: x != ""))),
        "header_key": header_key(text),
    }
    rows = rows.withColumns({n: tx.once(c) for n, c in counted.items()})
    visible, letters = F.col("__visible"), F.col("__letters")
    readable, symbols = letters / F.greatest(visible, F.lit(1)), F.col("__odd") / F.greatest(visible, F.lit(1))
    corrupted = text.rlike(r"""[#@$%^*_+=~`|\\<>]{3,}|["']?#[$%]["']?""") | ((visible >= 5) & (readable < 0.45) & (symbols > 0.25)) | ((visible >= 12) & (symbols > 0.45))
    short = (letters < 8) | ((F.length(text) < 24) & (F.col("__words") < 2))
    headers = repeated_headers(rows).withColumn("__h", F.lit(True))
    marked = rows.join(headers, ["work_id", "header_key"], "left")
    verdict = (
        F.when(F.trim(text) == "", "too_short")
        .when(text.rlike(r"(?i)^(?:page\s*)?\d{1,3}$"), "page_number")
        .when(corrupted, "corrupted")
        .when(F.col("__h").isNotNull(), "header_footer")
        .when(short, "too_short")
        .otherwise("accepted")
    )
    return marked.withColumn("verdict", verdict).drop("__h", "header_key", *[c for c in counted if c.startswith("__")])


def quality_summary(judged: DataFrame) -> DataFrame:
    """Per work: paragraphs, accepted and the rejected by verdict."""
    counters = [F.count_if(F.col("verdict") == v).alias(v) for v in ("accepted", "page_number", "corrupted", "header_footer", "too_short")]
    return judged.groupBy("work_id").agg(F.count("*").alias("paragraphs"), *counters)


def with_original(rows: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Rows with ``original``: the smallest id with the same keys; null keys match nothing."""
    firsts = rows.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min(id_column).alias("original"), F.count("*").alias("copies"))
    return rows.join(firsts.filter("copies > 1").drop("copies"), keys, "left").withColumn("original", F.coalesce("original", id_column))


def import_status(incoming: DataFrame, stored_paths: DataFrame) -> DataFrame:
    """Status of each incoming file (file_id, path, code, author_id, source_id, size, hash), the first that fits:
    exists, browser_copy, duplicate_code, duplicate_bytes or import. Nothing raises; a file's fault is its status."""
    key = names.path_key(F.col("path"))
    rows = incoming.withColumn("path_key", key)
    known = stored_paths.select(names.path_key(F.col("path")).alias("path_key")).distinct().withColumn("__known", F.lit(True))
    rows = rows.join(known, "path_key", "left")
    rows = with_original(rows, ["path_key"], "file_id").withColumnRenamed("original", "__path")
    rows = with_original(rows, ["author_id", "source_id", "code"], "file_id").withColumnRenamed("original", "__code")
    rows = with_original(rows, ["size", "hash"], "file_id").withColumnRenamed("original", "__bytes")
    status = F.when(F.col("__known").isNotNull(), "exists")
    for mark, name in (("__path", "browser_copy"), ("__code", "duplicate_code"), ("__bytes", "duplicate_bytes")):
        status = status.when(F.col(mark) < F.col("file_id"), name)
    return rows.withColumn("status", status.otherwise("import")).drop("__known", "__path", "__code", "__bytes", "path_key")


def upper_ratio(text: Column) -> Column:
    """Share of capitals among letters; 0 without letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) / letters).otherwise(0.0)


def target_names(rows: DataFrame) -> DataFrame:
    """A free name for each row (id, name, hash): identical content keeps one copy (``skip``), equal names get -2, -3, …"""
    firsts = keep_one(rows, ["name", "hash"], [F.col("id")])
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    named = firsts.select("id", F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit("-"), n.cast("string"))).alias("target"))
    return rows.join(named, "id", "left").withColumn("action", F.when(F.col("target").isNull(), "skip").otherwise("copy"))
