"""The library model: works, paragraphs, sources and the rest, derived from the base tables.

Everything is a lazy DataFrame. A work is a document; its paragraphs are its trimmed lines that
aren't empty, numbered from 1 without a shuffle (the array is filtered before it is exploded).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folianta.functions.text import with_search_text


def lines_of(text: Column) -> Column:
    """Trimmed lines of a text that aren't empty; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def code_of(doc_id: Column) -> Column:
    """D- and the id, padded to six digits at least."""
    digits = doc_id.cast("string")
    return F.concat(F.lit("D-"), F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(digits))), digits)


class Library:
    """The tables of one directory and the model over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def works(self) -> DataFrame:
        """One row per document: work_id, code, title, year (0: undated), work_date, language, source_id, author_id, content_type, path, text."""
        d = self.table("documents")
        number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
        year = F.when(F.col("doc_id") % 11 == 0, 0).otherwise(1947 + F.col("doc_id") % 20).cast("int")
        code = code_of(F.col("doc_id"))
        return d.select(
            F.col("doc_id").alias("work_id"),
            code.alias("code"),
            F.coalesce(F.get(lines_of(F.col("text")), F.lit(0)), F.lit("")).alias("title"),
            year.alias("year"),
            F.when(year > 0, F.make_date(year, (F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 28 + 1).cast("int"))).alias("work_date"),
            F.col("lang").alias("language"),
            F.col("source"),
            number.alias("source_id"),
            (number % 5).alias("author_id"),
            F.when(F.col("doc_id") % 7 == 0, "letter").when(F.col("doc_id") % 7 == 1, "brochure").otherwise("address").alias("content_type"),
            F.concat(F.lit("/library/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), code, F.lit(".txt")).alias("path"),
            F.col("text"),
        )

    @cached_property
    def paragraphs(self) -> DataFrame:
        """work_id, language, source_id, number (from 1), paragraph_id, text; no shuffle."""
        w = self.works.select("work_id", "language", "source_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "text"))
        return w.select("work_id", "language", "source_id", (F.col("pos") + 1).cast("int").alias("number"), (F.col("work_id") * 1000000 + F.col("pos") + 1).alias("paragraph_id"), "text")

    @cached_property
    def searchable(self) -> DataFrame:
        """Paragraphs with search_text."""
        return with_search_text(self.paragraphs)

    @cached_property
    def sources(self) -> DataFrame:
        """source_id, name, display_name, source_type; one row per distinct source."""
        s = self.works.filter("source_id IS NOT NULL").select("source_id").distinct()
        kind = F.when(F.col("source_id") == 0, "sermons").when(F.col("source_id") == 1, "letters").when(F.col("source_id") == 2, "brochures").otherwise("archive")
        return s.select("source_id", F.concat(F.lit("src"), F.col("source_id").cast("string")).alias("name"), F.concat(F.lit("Source "), F.col("source_id").cast("string")).alias("display_name"), kind.alias("source_type"))

    @cached_property
    def authors(self) -> DataFrame:
        """author_id, full_name, display_name."""
        a = self.works.filter("author_id IS NOT NULL").select("author_id").distinct()
        return a.select("author_id", F.concat(F.lit("Author Number "), F.col("author_id").cast("string")).alias("full_name"), F.concat(F.lit("Author "), F.col("author_id").cast("string")).alias("display_name"))

    @cached_property
    def favourites(self) -> DataFrame:
        """work_id of documents marked as good."""
        return self.table("labels").filter("quality = 1").select(F.col("doc_id").alias("work_id")).distinct()

    @cached_property
    def songs(self) -> DataFrame:
        """song_id, section_order, section_type, text: conversations read as songs."""
        return self.table("conversations").select(F.col("conv_id").alias("song_id"), F.col("turn").alias("section_order"), F.col("role").alias("section_type"), F.coalesce("text", F.lit("")).alias("text"))

    @cached_property
    def verses(self) -> DataFrame:
        """book_id (1 to 66), chapter, verse, text: lines of orders read as verses of chapters."""
        li = self.table("lineitem")
        return li.select((F.col("l_orderkey") % 66 + 1).cast("int").alias("book_id"), F.col("l_orderkey").alias("chapter"), F.col("l_linenumber").alias("verse"), F.concat_ws(" ", F.lit("part"), F.col("l_partkey").cast("string"), F.lit("from"), F.col("l_suppkey").cast("string")).alias("text"))
