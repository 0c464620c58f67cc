"""Readers: each parses with DataFrame functions, and gives a reason where a row is rejected."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folianta.operators.relational import keep_one, last_seen, running_state

#: Corrections: one JSON object per line, told apart by ``op``.
CORRECTIONS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("op", "old", "new")]
    + [T.StructField(n, T.IntegerType()) for n in ("id", "sermonId", "songId")]
    + [
        T.StructField("expectedIds", T.ArrayType(T.IntegerType())),
        T.StructField("paragraphs", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("page", T.IntegerType())]))),
        T.StructField("sections", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("label", T.StringType()), T.StructField("text", T.StringType())]))),
    ]
)


def query_rows(spark: SparkSession, sql: str, views: dict[str, DataFrame], **parameters) -> DataFrame:
    """A SQL text with named parameters over temporary views."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=parameters)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a folder: path, length, modificationTime; contents aren't read unless asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def by_header(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns whatever the case of the header; a missing one is null."""
    have = {c.strip().lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[w]}`").alias(w) if w in have else F.lit(None).cast("string").alias(w) for w in wanted])


def verse_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of verses (book, chapter, verse, text), header in any case; see ``verse_rows``."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return verse_rows(by_header(raw, ("book", "chapter", "verse", "text")))


def verse_rows(df: DataFrame) -> DataFrame:
    """Typed verses with ``reason``: the first fault of a row, null for a good one."""
    number = lambda c: F.trim(c).try_cast("int")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = (
        F.when(blank("book"), "book is missing")
        .when(number("chapter").isNull() | (number("chapter") < 1), "chapter is not a positive number")
        .when(number("verse").isNull() | (number("verse") < 1), "verse is not a positive number")
        .when(blank("text"), "text is empty")
    )
    return df.select(F.trim("book").alias("book"), number("chapter").alias("chapter"), number("verse").alias("verse"), F.trim("text").alias("text"), reason.alias("reason"))


def catalog_lookups(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two lookups of a catalogue: by normalised path and by file name, the first entry for each."""
    norm = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    rows = df.withColumn("path_key", norm).withColumn("name_key", F.element_at(F.split(norm, "/"), -1))
    return keep_one(rows, ["path_key"], [F.col("entry")]), keep_one(rows, ["name_key"], [F.col("entry")])


def stanzas(text: Column) -> Column:
    """Parts of a text between blank lines, trimmed; empty ones dropped."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), r"\n[ \t]*(?:\n[ \t]*)+"), lambda x: F.trim(F.regexp_replace(x, r"^\n+|\n+$", ""))), lambda x: x != "")


def plain_verses(lines: DataFrame) -> DataFrame:
    """Verses of plain text (file, pos, line): ``c:v`` markers open verses, ``1:1`` opens a book, lines without one go on.

    Result: file, book (running number), chapter, verse, text.
    """
    marked = lines.withColumn("chapter", F.regexp_extract("line", r"^\s*(\d+):(\d+)\s", 1).try_cast("int")).withColumn("verse", F.regexp_extract("line", r"^\s*(\d+):(\d+)\s", 2).try_cast("int"))
    opens = F.col("chapter").isNotNull()
    at = running_state(marked, ["file"], "pos", opens, "unit")
    at = running_state(at, ["file"], "pos", (F.col("chapter") == 1) & (F.col("verse") == 1), "book").filter("unit > 0")
    bare = F.trim(F.regexp_replace("line", r"^\s*\d+:\d+\s", ""))
    held = F.sort_array(F.collect_list(F.struct("pos", bare.alias("t"))))
    return at.groupBy("file", "unit").agg(F.max("book").alias("book"), F.max("chapter").alias("chapter"), F.max("verse").alias("verse"), F.array_join(F.filter(F.transform(held, lambda x: x["t"]), lambda x: x != ""), " ").alias("text")).drop("unit")


def chapter_files(texts: DataFrame) -> DataFrame:
    """One file per chapter (file, text): header ``Book N``, then verse n on line n.

    ``fault`` tells a blank line inside the body or a header that doesn't fit the file's number.
    """
    lines = F.split(F.regexp_replace(F.regexp_replace("text", r"\r\n?", "\n"), r"\n+$", ""), "\n")
    number = F.regexp_extract("file", r"(\d+)\D*$", 1).try_cast("int")
    body = F.slice("lines", 2, 100_000)
    out = texts.select("file", number.alias("chapter"), lines.alias("lines"))
    header = F.regexp_extract(F.get("lines", F.lit(0)), r"(\d+)\s*$", 1).try_cast("int")
    fault = F.when(~header.eqNullSafe(F.col("chapter")), "header and file differ").when(F.exists(body, lambda x: F.trim(x) == ""), "blank line")
    return out.select("file", "chapter", fault.alias("fault"), F.posexplode(body).alias("pos", "text")).select("file", "chapter", (F.col("pos") + 1).alias("verse"), F.trim("text").alias("text"), "fault")


def usfm_verses(lines: DataFrame) -> DataFrame:
    r"""Verses of USFM (file, pos, line): ``\c`` opens a chapter, ``\v n`` a verse; other markers are stripped and their text goes on."""
    chapter = F.regexp_extract("line", r"^\\c\s+(\d+)", 1).try_cast("int")
    verse = F.regexp_extract("line", r"^\\v\s+(\d+)", 1).try_cast("int")
    at = last_seen(lines.withColumn("v", verse), ["file"], "pos", chapter, "chapter")
    at = running_state(at, ["file"], "pos", F.col("v").isNotNull(), "unit").filter(~F.col("line").rlike(r"^\\(?:c|id|h|toc\d|mt\d?)\b") & (F.col("unit") > 0))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^\\v\s+\d+\s*", ""), r"\\[a-z]+\d?\*", ""), r"\\[a-z]+\d?\s?", ""))
    held = F.sort_array(F.collect_list(F.struct("pos", bare.alias("t"))))
    return at.groupBy("file", "unit").agg(F.max("chapter").alias("chapter"), F.max("v").alias("verse"), F.array_join(F.filter(F.transform(held, lambda x: x["t"]), lambda x: x != ""), " ").alias("text")).drop("unit")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """Corrections from JSON lines, all five operations in one schema."""
    return spark.read.schema(CORRECTIONS).json(path)


def parse_corrections(lines: Column) -> Column:
    return F.from_json(lines, CORRECTIONS)


def html_lines(html: Column) -> Column:
    """Visible lines of a page: scripts, styles and comments dropped, block ends and breaks as line ends, entities of the five basic kinds decoded."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|title|article|nav|ul)>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(c))
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))), lambda x: x != "")


def lines_of_words(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Lines of pages from placed words (page, x, y, text): a new line where y falls by more than the tolerance, words by x."""
    w = Window.partitionBy("page").orderBy(F.desc("y"), "x")
    fresh = F.coalesce(F.lag("y").over(w) - F.col("y") > tolerance, F.lit(True))
    marked = words.withColumn("fresh", fresh.cast("int"))
    numbered = marked.withColumn("line", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.sort_array(F.collect_list(F.struct("x", "text")))
    return numbered.groupBy("page", "line").agg(F.array_join(F.transform(held, lambda t: t["text"]), " ").alias("text"))


def with_columns_of_page(words: DataFrame, width: float, slots: int = 40) -> DataFrame:
    """Words with ``column`` 0 or 1 by the page's gutter: the emptiest vertical slot in its middle third.

    A page whose emptiest slot is crossed by over a tenth of its words has one column.
    """
    slot = lambda x: F.least(F.lit(slots - 1), F.greatest(F.lit(0), F.floor(x / width * slots))).cast("int")
    covered = words.select("page", F.explode(F.sequence(slot(F.col("x")), slot(F.col("x") + F.col("w")))).alias("slot")).groupBy("page", "slot").agg(F.count("*").alias("n"))
    pages = words.groupBy("page").agg(F.count("*").alias("words"))
    middle = pages.select("page", "words", F.explode(F.sequence(F.lit(slots // 3), F.lit(2 * slots // 3))).alias("slot")).join(covered, ["page", "slot"], "left")
    gutter = keep_one(middle.withColumn("n", F.coalesce("n", F.lit(0))), ["page"], [F.col("n"), F.abs(F.col("slot") - slots / 2), F.col("slot")])
    gutter = gutter.select("page", F.when(F.col("n") * 10 <= F.col("words"), (F.col("slot") + 0.5) * width / slots).alias("gutter"))
    return words.join(gutter, "page").withColumn("column", F.when(F.col("x") > F.col("gutter"), 1).otherwise(0)).drop("gutter")


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def paragraph_lines(paragraph: ElementTree.Element) -> list[str]:
    """Lines of one drawing paragraph: runs joined, breaks and vertical tabs end a line, tabs are spaces."""
    out = [""]
    for x in paragraph.iter():
        if x.tag == f"{_A}t":
            out[-1] += x.text or ""
        elif x.tag == f"{_A}br":
            out.append("")
        elif x.tag == f"{_A}tab":
            out[-1] += " "
    lines = [y for x in out for y in re.split(r"[\v\n]", x)]
    return [" ".join(x.split()) for x in lines]


def presentation_lines(content: bytes) -> list[str]:
    """Lines of a presentation, slide by slide in the order of its relations; an empty line ends a slide."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        deck = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        for slide in (x for x in deck.iter() if x.tag.endswith("}sldId")):
            target = rels.get(slide.get(f"{_R}id"), "").lstrip("/").removeprefix("ppt/")
            for p in ElementTree.fromstring(z.read(f"ppt/{target}")).iter(f"{_A}p"):
                out += [x for x in paragraph_lines(p) if x]
            out.append("")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def pptx_lines(content: pd.Series) -> pd.Series:
    """``presentation_lines`` of binary files; null where a file can't be read."""

    def one(x: bytes) -> list[str] | None:
        try:
            return presentation_lines(x)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    return content.map(one)


def describe_catalog(frames: dict[str, DataFrame], sample: int = 2) -> list[tuple[str, str, int, int]]:
    """(table, columns, number of columns, sampled rows) of frames, from their schemas and a few rows."""
    return [(n, ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema), len(df.columns), len(df.limit(sample).collect())) for n, df in sorted(frames.items())]
