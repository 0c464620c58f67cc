"""Changes of tables, as the table that results or the actions that lead to it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(left: Sequence[str], prefix: str = "new_") -> Column:
    """Whether any column differs from its ``prefix`` twin, null-safe."""
    return reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in left])


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The table after an upsert, with ``action``: inserted, updated (only if something differs) or kept."""
    a = stored.select(*keys, *values, F.lit(True).alias("__s"))
    b = incoming.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("__i"))
    joined = a.join(b, list(keys), "full_outer")
    action = F.when(F.col("__s").isNull(), "inserted").when(F.col("__i").isNotNull() & changed(values), "updated").otherwise("kept")
    fresh = F.col("action") != "kept"
    return joined.withColumn("action", action).select(*keys, *[F.when(fresh, F.col(f"new_{v}")).otherwise(F.col(v)).alias(v) for v in values], "action")


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows, and incoming ones whose key isn't there."""
    return stored.unionByName(incoming.dropDuplicates(list(keys)).join(stored.select(*keys).distinct(), list(keys), "left_anti"))


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """``value`` where the column is null."""
    return df.withColumn(column, F.coalesce(F.col(column), value))


def delete_in(df: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among the doomed ones."""
    return df.join(doomed.select(key).distinct(), key, "left_anti")


def set_null(df: DataFrame, removed: DataFrame, key: str, reference: str) -> DataFrame:
    """References to removed keys as null."""
    gone = removed.select(F.col(key).alias(reference)).distinct().withColumn("__gone", F.lit(True))
    return df.join(gone, reference, "left").withColumn(reference, F.when(F.col("__gone").isNull(), F.col(reference))).drop("__gone")


def replace_all(stored: DataFrame, incoming: DataFrame, scope: Sequence[str]) -> DataFrame:
    """All rows of the scopes that come in are replaced by the incoming ones."""
    return stored.join(incoming.select(*scope).distinct(), list(scope), "left_anti").unionByName(incoming)


def refresh(index: DataFrame, changed_keys: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """An index after the rows of some keys were rebuilt; keys without new rows disappear."""
    return delete_in(index, changed_keys, key).unionByName(rebuilt.join(changed_keys.select(key).distinct(), key, "left_semi"))


def compare_and_set(stored: DataFrame, corrections: DataFrame, key: str, value: str) -> DataFrame:
    """Corrections (key, old, new) applied all or none: one mismatch with the stored value and nothing changes.

    Result: stored columns with the new value, and ``applied``.
    """
    met = corrections.join(stored.select(key, F.col(value).alias("__v")), key, "left")
    wrong = met.agg(F.count_if(~F.col("__v").eqNullSafe(F.col("old"))).alias("n")).scalar()
    out = stored.join(corrections.select(key, "old", "new"), key, "left")
    applied = F.col("old").isNotNull() & (wrong == 0)
    return out.withColumn("applied", applied).withColumn(value, F.when(applied, F.col("new")).otherwise(F.col(value))).drop("old", "new")


def positional_plan(stored: DataFrame, wanted: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """Actions by position that turn the stored list of a group into the wanted one: keep, update, insert or delete."""
    a = stored.select(group, position, F.col(value).alias("old"), F.lit(True).alias("__s"))
    b = wanted.select(group, position, F.col(value).alias("new"), F.lit(True).alias("__w"))
    action = F.when(F.col("__w").isNull(), "delete").when(F.col("__s").isNull(), "insert").when(F.col("old").eqNullSafe(F.col("new")), "keep").otherwise("update")
    return a.join(b, [group, position], "full_outer").withColumn("action", action).drop("__s", "__w")


def keyed_plan(stored: DataFrame, wanted: DataFrame, keys: Sequence[str], value: str, referenced: DataFrame) -> DataFrame:
    """As ``positional_plan`` by key, but a row that others refer to is never deleted: its action is ``guard``."""
    a = stored.select(*keys, F.col(value).alias("old"), F.lit(True).alias("__s"))
    b = wanted.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__w"))
    r = referenced.select(*keys).distinct().withColumn("__r", F.lit(True))
    action = (
        F.when(F.col("__w").isNull() & F.col("__r").isNotNull(), "guard")
        .when(F.col("__w").isNull(), "delete")
        .when(F.col("__s").isNull(), "insert")
        .when(F.col("old").eqNullSafe(F.col("new")), "keep")
        .otherwise("update")
    )
    return a.join(b, list(keys), "full_outer").join(r, list(keys), "left").withColumn("action", action).drop("__s", "__w", "__r")


def toggled(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are on after all their toggles: an odd number of them."""
    return events.groupBy(*keys).agg(F.count("*").alias("toggles")).filter("toggles % 2 = 1")


def rebuild_needed(source: DataFrame, index: DataFrame) -> DataFrame:
    """One row: source_rows, index_rows and whether the index has to be rebuilt."""
    a = source.agg(F.count("*").alias("source_rows"))
    return a.withColumn("index_rows", index.agg(F.count("*").alias("n")).scalar()).withColumn("rebuild", F.col("source_rows") != F.col("index_rows"))
