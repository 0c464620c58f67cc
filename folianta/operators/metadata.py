"""Metadata of works from the names of their files, a publisher's own pages, and findings in verse corpora."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folianta.functions import dates, names
from folianta.functions import text as tx

# What file names look like. Years are of the 20th or 21st century.
MEETING = r"(?i)^((?:19|20)\d\d)-(0?[1-9]|1[0-2])-(0?[1-9]|[12]\d|3[01])-\d{4}-([A-Za-z]+)"
SEASON = r"(?i)^(spring|summer|autumn|fall|winter)((?:19|20)\d\d)"
MONTHS = r"^((?:19|20)\d\d)(0[1-9]|1[0-2])(0[1-9]|1[0-2])(?!\d)"
MONTH = r"^((?:19|20)\d\d)[-_]?(0[1-9]|1[0-2])(?!\d)"
YEAR = r"(?<!\d)((?:19|20)\d\d)(?!\d)"
LANGUAGE = r"(?i)^(swa|fra|fre|frn|fr|eng|en)(?=[-\d_ ])"
CODE = r"(?<!\d)(?:\d\d|\d{4})[-_. ]?\d\d[-_. ]?\d\d[A-Za-z]?(?!\d)"
#: Letters that a title and a code may have.
TITLE_LENGTH, CODE_LENGTH = 300, 80
# Verses that every whole corpus has, as (book, chapter, verse), and its number of books.
LANDMARKS = ((1, 1, 1), (19, 23, 1), (27, 5, 23), (43, 3, 16), (45, 8, 28), (66, 22, 21))
BOOKS = 66

METADATA = "struct<title:string,code:string,year:int,date:date,location:string,rule:string>"


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _struct(rule: str, title: Column, code: Column, year: Column | int, date: Column | None, location: Column | None = None) -> Column:
    none = F.lit(None)
    fields = {"title": F.left(title, F.lit(TITLE_LENGTH)), "code": F.left(code, F.lit(CODE_LENGTH)), "year": F.lit(year) if isinstance(year, int) else year, "date": none if date is None else date, "location": none if location is None else location, "rule": F.lit(rule)}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(METADATA)


def cascade(name: Column, catalog: Column | None = None, known: Mapping[str, tuple[str, str]] | None = None, subtitles: Mapping[str, str] | None = None, meeting: str = "EF", letter: str = "CL", untitled: str = "Publication") -> Column:
    """Title, code, year, date, location and ``rule`` of a publication by its file name, from the first rule that fits.

    catalog (a struct of title, code, year, date; null where it lists nothing), meeting (a dated
    one with time and place), known (a part of the name, any case, with title and code), season,
    month_range, year_month, year, fallback. An impossible day fits no rule of dates; a null name
    is an empty one.
    """
    name = F.coalesce(name, F.lit(""))
    g = lambda pattern, i: F.regexp_extract(name, pattern, i)
    one = F.lit("1")
    extra = F.lit("")
    for part, subtitle in reversed(list((subtitles or {}).items())):
        extra = F.when(tx.contains_folded(name, part), F.lit(f" - {subtitle}")).otherwise(extra)
    month_name = lambda d: F.date_format(d, "MMMM")

    rules: list[tuple[Column, Column]] = []
    if catalog is not None:
        rules.append((catalog.isNotNull(), _struct("catalog", catalog["title"], catalog["code"], catalog["year"], catalog["date"])))
    met = _day(g(MEETING, 1), g(MEETING, 2), g(MEETING, 3))
    place = g(MEETING, 4)
    title = F.concat(F.lit("Meeting in "), place, F.lit(" - "), F.date_format(met, "MMMM d, yyyy"))
    rules.append((met.isNotNull(), _struct("meeting", title, F.concat(F.lit(f"{meeting}-"), F.date_format(met, "yyyy-MM-dd-"), F.upper(place)), F.year(met), met, place)))
    for part, (known_title, code) in (known or {}).items():
        rules.append((tx.contains_folded(name, part), _struct("known", F.lit(known_title), F.lit(code), 0, None)))
    season = F.initcap(F.lower(g(SEASON, 1)))
    start = _day(g(SEASON, 2), dates.month_of(season).cast("string"), one)
    rules.append((start.isNotNull(), _struct("season", F.concat_ws(" ", F.lit("Circular Letter -"), season, g(SEASON, 2)), F.concat_ws("-", F.lit(letter), g(SEASON, 2), F.upper(season)), F.year(start), start)))
    first, last = _day(g(MONTHS, 1), g(MONTHS, 2), one), _day(g(MONTHS, 1), g(MONTHS, 3), one)
    title = F.concat(F.lit("Circular Letter - "), month_name(first), F.lit("-"), month_name(last), F.lit(" "), g(MONTHS, 1), extra)
    rules.append((first.isNotNull(), _struct("month_range", title, F.concat_ws("-", F.lit(letter), g(MONTHS, 1), g(MONTHS, 2), g(MONTHS, 3)), F.year(first), first)))
    first = _day(g(MONTH, 1), g(MONTH, 2), one)
    title = F.concat(F.lit("Circular Letter - "), month_name(first), F.lit(" "), g(MONTH, 1), extra)
    rules.append((first.isNotNull(), _struct("year_month", title, F.concat_ws("-", F.lit(letter), g(MONTH, 1), g(MONTH, 2)), F.year(first), first)))
    start = _day(g(YEAR, 1), one, one)
    rules.append((start.isNotNull(), _struct("year", F.concat(F.lit("Circular Letter - "), g(YEAR, 1), extra), F.concat_ws("-", F.lit(letter), g(YEAR, 1)), F.year(start), start)))

    plain = tx.flatten_spaces(F.regexp_replace(F.translate(name, "_.", "  "), r"\s*-\s*", " - "))
    plain = F.btrim(plain, F.lit(" -"))
    code = F.upper(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9]+", "-"), F.lit("-")))
    out = _struct("fallback", F.when(plain == "", untitled).otherwise(plain), code, 0, None)
    for fits, value in reversed(rules):
        out = F.when(fits, value).otherwise(out)
    return out


def parsed(path: Column) -> Column:
    """Language, code, date, year and title of a file by its path.

    The language is that of a prefix of the name, else of the path. The code is the first run of
    year, month and day in the name, else the name; years of two digits from 30 on are 19YY. An
    undated file has the year of a part of its path, else 0. The title is what is left of the name.
    """
    name = names.base_name(F.coalesce(path, F.lit("")))
    prefix = F.lower(F.regexp_extract(name, LANGUAGE, 1))
    language = F.when(prefix == "swa", "sw").when(prefix.startswith("fr"), "fr").when(prefix.startswith("en"), "en").otherwise(names.language_of_path(F.coalesce(path, F.lit(""))))
    bare = F.regexp_replace(name, rf"{LANGUAGE}[-_ ]*", "")
    found = F.regexp_extract(bare, CODE, 0)
    part = lambda i: F.regexp_extract(found, r"^(\d\d|\d{4})[-_. ]?(\d\d)[-_. ]?(\d\d)[A-Za-z]?$", i)
    year = F.when(F.length(part(1)) == 4, part(1)).when(part(1) >= "30", F.concat(F.lit("19"), part(1))).otherwise(F.concat(F.lit("20"), part(1)))
    date = F.when(found != "", _day(year, part(2), part(3)))
    left = F.btrim(tx.flatten_spaces(F.translate(F.replace(bare, F.when(found != "", found), F.lit("")), "_.", "  ")), F.lit(" -"))
    title = F.when((found == "") | (left == ""), F.btrim(tx.flatten_spaces(F.translate(bare, "_.", "  ")), F.lit(" -"))).otherwise(left)
    code = F.when(found != "", found).otherwise(F.left(bare, F.lit(CODE_LENGTH)))
    return F.struct(
        language.alias("language"), code.alias("code"), date.alias("date"), F.coalesce(F.year(date), dates.year_of_path(path), F.lit(0)).alias("year"), F.left(title, F.lit(TITLE_LENGTH)).alias("title"),
    )


def repairs(stored: DataFrame, path: str, fields: Mapping[str, str]) -> DataFrame:
    """``stored`` with ``new``, the metadata parsed from its path anew, and ``changed``, the names of stored columns that differ.

    ``fields`` maps stored columns to parsed ones; two nulls are equal.
    """
    out = stored.withColumn("new", parsed(F.col(path)))
    differ = [F.when(~F.col(c).eqNullSafe(F.col("new")[p]), F.lit(c)) for c, p in fields.items()]
    return out.withColumn("changed", F.array_compact(F.array(*differ)))


def is_publisher_page(lines: Column, title: Column, signals: Sequence[Sequence[str]], publisher: str, notice: str = "copyright notice") -> Column:
    """Whether a page, as its lines that aren't blank, is the publisher's and not the work's.

    It opens with the notice, or shows two of the signals (each a choice of phrases), or opens
    with the title and names the publisher. Phrases are held against letters and digits alone.
    """
    key = lambda c: tx.alnum_key(c)
    plain = lambda words: "".join(c for c in words.upper() if c.isalnum())
    first, page = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), key(F.array_join(lines, " "))
    shown = F.lit(0)
    for phrases in signals:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | F.contains(page, F.lit(plain(p)))
        shown = shown + hit.cast("int")
    titled = (key(title) != "") & (key(first) == key(title)) & F.contains(page, F.lit(plain(publisher)))
    return F.coalesce((F.lower(first) == notice) | (shown >= 2) | titled, F.lit(False))


def verse_findings(verses: DataFrame, books: int = BOOKS, landmarks: Sequence[tuple[int, int, int]] = LANDMARKS) -> DataFrame:
    """Faults of a corpus (book_id, chapter, verse), one row each: kind, book_id, chapter, verse, n.

    missing_book; extra_book (n: its verses); missing_landmark; gap (n: numbers lacking between a
    chapter's first verse, which should be 1, and its last); repeated (n: rows of one verse).
    """
    spark = verses.sparkSession
    counted = verses.groupBy("book_id", "chapter", "verse").agg(F.count("*").alias("n"))
    by_book = counted.groupBy("book_id").agg(F.sum("n").alias("n"))
    null = F.lit(None).cast("long")
    columns = lambda kind, chapter, verse, n: [F.lit(kind).alias("kind"), F.col("book_id").cast("long").alias("book_id"), chapter.cast("long").alias("chapter"), verse.cast("long").alias("verse"), n.cast("long").alias("n")]
    wanted = spark.range(1, books + 1).select(F.col("id").cast("int").alias("book_id"))
    missing = wanted.join(by_book, "book_id", "left_anti").select(*columns("missing_book", null, null, null))
    extra = by_book.filter(~F.col("book_id").between(1, books)).select(*columns("extra_book", null, null, F.col("n")))
    marks = spark.createDataFrame(list(landmarks), "book_id int, chapter long, verse int")
    lost = marks.join(counted, ["book_id", "chapter", "verse"], "left_anti").select(*columns("missing_landmark", F.col("chapter"), F.col("verse"), null))
    chapters = counted.groupBy("book_id", "chapter").agg(F.count("*").alias("held"), F.max("verse").alias("high"))
    gaps = chapters.filter("held <> high").select(*columns("gap", F.col("chapter"), null, F.col("high") - F.col("held")))
    again = counted.filter("n > 1").select(*columns("repeated", F.col("chapter"), F.col("verse"), F.col("n")))
    return missing.union(extra).union(lost).union(gaps).union(again)


def pages_within(text: Column, budget: int) -> Column:
    """A text as pages of at most ``budget`` characters: whole sentences, longer ones by clauses, longer clauses by words, longer words cut."""

    def cut(parts: Column, pattern: str) -> Column:
        pieces = lambda x: F.filter(F.split(x, pattern), lambda y: y != "")
        return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) <= budget, F.array(x)).otherwise(pieces(x))))

    units = F.filter(F.array(tx.flatten_spaces(F.coalesce(text, F.lit("")))), lambda x: x != "")
    for pattern in (r"(?<=[.!?]) ", r"(?<=[,;:]) ", " ", rf"(?<=\G.{{{budget}}})"):
        units = cut(units, pattern)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def add(a: Column, x: Column) -> Column:
        full = F.length(a["now"]) + F.length(x) + 1 > budget
        done = F.when(full & (a["now"] != ""), F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"])
        return F.struct(done.alias("done"), F.when(full | (a["now"] == ""), x).otherwise(F.concat(a["now"], F.lit(" "), x)).alias("now"))

    return F.aggregate(units, empty, add, lambda a: F.filter(F.concat(a["done"], F.array(a["now"])), lambda x: x != ""))
