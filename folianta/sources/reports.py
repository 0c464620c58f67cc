"""Report sinks and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled, with a header; spaces at a value's ends are kept."""
    df.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def snapshot(df: DataFrame, path: str, version: int) -> str:
    """A version of a table in a folder of its own; an existing version is never overwritten."""
    to = f"{path.rstrip('/')}/v{version:06d}"
    df.write.mode("error").parquet(to)
    return to


def snapshot_matches(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Whether a snapshot holds the same rows: numbers and sums of row hashes agree."""
    sums = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first() for x in (df, spark.read.parquet(path))]
    return sums[0] == sums[1]


def write_family(parents: DataFrame, children: DataFrame, log: DataFrame, path: str) -> None:
    """Parents, children and log appended below one folder: children first, parents last.

    There is no transaction over tables; readers start from parents, so that a parent never
    lacks its children, and children without a parent are not seen.
    """
    for name, df in (("children", children), ("log", log), ("parents", parents)):
        df.write.mode("append").parquet(f"{path.rstrip('/')}/{name}")
