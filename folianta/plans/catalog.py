"""The catalogue of queries: name, plan and, where SQL has an equal, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folianta.model import Library

PLANS: dict[str, Callable[[Library], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The works of the library model in SQL.
WORKS = """works AS (
  SELECT doc_id AS work_id, 'D-' || repeat('0', greatest(0, 6 - length(CAST(doc_id AS VARCHAR)))) || CAST(doc_id AS VARCHAR) AS code,
    coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') AS title,
    CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1947 + doc_id % 20 END AS INTEGER) AS year,
    CASE WHEN doc_id % 11 <> 0 THEN make_date(CAST(1947 + doc_id % 20 AS BIGINT), CAST(doc_id % 12 + 1 AS BIGINT), CAST(doc_id % 28 + 1 AS BIGINT)) END AS work_date,
    lang AS language, source, TRY_CAST(nullif(regexp_extract(source, '(\\d+)$', 1), '') AS INTEGER) AS source_id,
    TRY_CAST(nullif(regexp_extract(source, '(\\d+)$', 1), '') AS INTEGER) % 5 AS author_id,
    CASE WHEN doc_id % 7 = 0 THEN 'letter' WHEN doc_id % 7 = 1 THEN 'brochure' ELSE 'address' END AS content_type,
    '/library/' || source || '/' || lang || '/D-' || repeat('0', greatest(0, 6 - length(CAST(doc_id AS VARCHAR)))) || CAST(doc_id AS VARCHAR) || '.txt' AS path,
    text
  FROM documents
)"""
#: Paragraphs after WORKS.
PARAS = """paras AS (
  SELECT work_id, language, source_id, CAST(number AS INTEGER) AS number, work_id * 1000000 + number AS paragraph_id, text FROM (
    SELECT work_id, language, source_id, unnest(ps) AS text, unnest(range(1, len(ps) + 1)) AS number FROM (
      SELECT work_id, language, source_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ps FROM works))
)"""
WP = f"WITH {WORKS}, {PARAS}"
W = f"WITH {WORKS}"
#: collapsed_upper of a column in SQL.
COLLAPSED_UPPER = r"replace(upper(replace(trim(regexp_replace({}, '[\s\x0B]+', ' ', 'g')), 'ß', chr(1))), chr(1), 'ß')"


def _search_text() -> str:
    """search_text of a column in SQL, but for compatibility forms and letter-spaced words."""
    unified = "".join(map(chr, (0xA0, *range(0x2000, 0x200B), 0x202F, 0x3000))), "".join(map(chr, range(0x2018, 0x201C))), "".join(map(chr, range(0x201C, 0x2020))), "".join(map(chr, (*range(0x2010, 0x2015), 0x2212)))
    # a single quote is doubled in SQL
    source, target = "".join(unified), "".join(a * len(u) for a, u in zip((" ", "''", '"', "-"), unified, strict=True))
    out = r"regexp_replace({}, '([–—])[ \t]*[\n\f\r]\s*', '\1', 'g')"
    out = f"translate(replace({out}, '…', '...'), '{source}', '{target}')"
    steps = (
        (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{200B}}-\x{{200D}}\x{{FEFF}}\x{{FFFD}}\p{{Co}}]", ""),
        (r"\b([Ii])[Ss][Pp][Aa][Ss][Tt]\b", r"\1s past"),
        (r"-\s*[\n\r]\s*", ""),
        (r"([,;:!?])([\p{{L}}\p{{N}}])", r"\1 \2"),
        (r"([a-z]\.)([A-Z])", r"\1 \2"),
        (r"\s+([,.;:!?%\])])", r"\1"),
        (r"\s+", " "),
    )
    for found, instead in steps:
        out = f"regexp_replace({out}, '{found}', '{instead}', 'g')"
    return f"replace(upper(replace(trim({out}), 'ß', chr(1))), chr(1), 'ß')"


SEARCH_TEXT = _search_text()
SOURCES = """sources AS (
  SELECT DISTINCT source_id, 'src' || source_id AS name, 'Source ' || source_id AS display_name,
    CASE source_id WHEN 0 THEN 'sermons' WHEN 1 THEN 'letters' WHEN 2 THEN 'brochures' ELSE 'archive' END AS source_type
  FROM works WHERE source_id IS NOT NULL
)"""
AUTHORS = "authors AS (SELECT DISTINCT author_id, 'Author Number ' || author_id AS full_name, 'Author ' || author_id AS display_name FROM works WHERE author_id IS NOT NULL)"
VERSES = "verses AS (SELECT CAST(l_orderkey % 66 + 1 AS INTEGER) AS book_id, l_orderkey AS chapter, l_linenumber AS verse, 'part ' || l_partkey || ' from ' || l_suppkey AS text FROM lineitem)"
SONGS = "songs AS (SELECT conv_id AS song_id, turn AS section_order, role AS section_type, coalesce(text, '') AS text FROM conversations)"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a plan under ``name``."""

    def keep(plan: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return keep


def _runner(plan: Callable[[Library], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Library(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered plans as (spark, sf_dir) -> DataFrame."""
    from folianta.plans import etl, quality, relational, scalar, search, tables  # noqa: F401

    return {name: _runner(plan) for name, plan in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
