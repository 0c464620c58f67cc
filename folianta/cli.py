"""Command line: ``python -m folianta.cli SF_DIR --title the --limit 20``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from folianta.functions.analyze import SearchQuery


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Structured search over a library.")
    p.add_argument("--text")
    p.add_argument("--title")
    p.add_argument("--code")
    p.add_argument("--year", type=int)
    p.add_argument("--paragraph", type=int)
    p.add_argument("--keyword")
    p.add_argument("--language")
    p.add_argument("--limit", type=int, default=20)
    return p


def query_of(argv: Sequence[str]) -> SearchQuery:
    """The query that command-line arguments describe."""
    return SearchQuery(**vars(_parser().parse_args(list(argv))))


def main(argv: Sequence[str] | None = None) -> None:
    import sys

    from pyspark.sql import SparkSession

    from folianta.model import Library
    from folianta.operators.search import search_structured

    args = list(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    search_structured(Library(spark, args[0]), query_of(args[1:])).show(truncate=80)


if __name__ == "__main__":
    main()
