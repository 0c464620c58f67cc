"""Joins, windows, sets and orders that the library's queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Dimension tables of at most so many rows are broadcast without asking Spark's own size estimate.
SMALL_ROWS = 10_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group, with their place in ``rank``. ``order`` must be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return top_per_group(df, keys, order, 1, "__rn").drop("__rn")


def first_child(parents: DataFrame, children: DataFrame, key: str, order: Sequence[Column], how: str = "left") -> DataFrame:
    """Each parent with its first child; ``left`` keeps parents without one."""
    return parents.join(keep_one(children, [key], order), key, how)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of more than one row, with their number ``n``."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def merge_ranked(parts: Sequence[DataFrame], key: str, position: str, limit: int) -> DataFrame:
    """Result lists one after the other, each key where it first stands, cut to ``limit``.

    Each part has its own order in ``position``; the result has ``tier`` (0 for the first part)
    and is ordered by tier and position.
    """
    out = None
    for tier, part in enumerate(parts):
        tagged = part.withColumn("tier", F.lit(tier))
        out = tagged if out is None else out.unionByName(tagged)
    return keep_one(out, [key], [F.col("tier"), F.col(position)]).orderBy("tier", position).limit(limit)


def multiset_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` beyond their number in ``right``, with that number ``missing``."""
    a = left.groupBy(*keys).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("b"))
    return a.join(b, list(keys), "left").withColumn("missing", F.col("a") - F.coalesce("b", F.lit(0))).filter("missing > 0").select(*keys, "missing")


def reconcile(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full comparison by key: status missing, extra, different or same."""
    a = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("__e"))
    b = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("__a"))
    status = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("actual")), "different").otherwise("same")
    return a.join(b, list(keys), "full_outer").withColumn("status", status).drop("__a", "__e")


def lookup_in_order(left: DataFrame, right: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], id_column: str) -> DataFrame:
    """For each left row the first rule (name, key columns) with a match: ``id_column`` of the match and ``rule``.

    Where several right rows match under one rule, the smallest id is taken.
    """
    out = left
    for name, keys in rules:
        one = right.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.min(id_column).alias(f"__{name}"))
        out = out.join(one, list(keys), "left")
    ids = [F.col(f"__{name}") for name, _ in rules]
    rule = F.coalesce(*[F.when(F.col(f"__{name}").isNotNull(), name) for name, _ in rules])
    return out.withColumn(id_column, F.coalesce(*ids)).withColumn("rule", rule).drop(*[f"__{name}" for name, _ in rules])


def per_parent_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Each parent with the number of its rows in each child table, 0 where there is none."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def ordered_concat(df: DataFrame, keys: Sequence[str], order: str, text: str, separator: str, out: str) -> DataFrame:
    """Texts of a group joined in order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(held, lambda x: x["t"]), separator).alias(out))


def neighbours(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each row with ``previous_`` and ``next_`` values of its neighbours in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    for c in columns:
        df = df.withColumn(f"previous_{c}", F.lag(c).over(w)).withColumn(f"next_{c}", F.lead(c).over(w))
    return df


def number_gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Gaps in a numbering: after (the last number before), before (the next), missing (how many lie between)."""
    w = Window.partitionBy(*keys).orderBy(number)
    return df.select(*keys, F.lag(number).over(w).alias("after"), F.col(number).alias("before")).filter("before - after > 1").withColumn("missing", F.col("before") - F.col("after") - 1)


def running_number(df: DataFrame, keys: Sequence[str], order: str, detected: str, out: str = "number") -> DataFrame:
    """Monotone numbering: a detected number counts if it isn't below the next one, else the next one is taken.

    n = i + max(0, running maximum of detected - i), with i the place in the group.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(w)
    with_i = df.withColumn("__i", i)
    lead = F.max(F.col(detected) - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return with_i.withColumn(out, (F.col("__i") + F.greatest(F.lit(0), F.coalesce(lead, F.lit(0)))).cast("int")).drop("__i")


def fallback_number(df: DataFrame, keys: Sequence[str], order: str, detected: str, out: str = "number") -> DataFrame:
    """First occurrences of a detected number keep it; the k-th other row takes the k-th positive number that none detected.

    The k-th free number is k plus the number of detected ones below it: with the detected set
    sorted, that is k plus how many of its elements d at place j (from 1) satisfy d - j < k.
    """
    by_number = Window.partitionBy(*keys, detected).orderBy(order)
    first = F.col(detected).isNotNull() & (F.col(detected) > 0) & (F.row_number().over(by_number) == 1)
    marked = df.withColumn("__first", first)
    held = F.sort_array(F.collect_set(F.when(F.col("__first"), F.col(detected))).over(Window.partitionBy(*keys)))
    k = F.sum(F.when(F.col("__first"), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy(order))
    numbered = marked.withColumn("__held", held).withColumn("__k", k)
    below = F.size(F.filter(F.col("__held"), lambda d, j: d - (j + 1) < F.col("__k")))
    return numbered.withColumn(out, F.when(F.col("__first"), F.col(detected)).otherwise(F.col("__k") + below).cast("int")).drop("__first", "__held", "__k")


def running_state(df: DataFrame, keys: Sequence[str], order: str, starts: Column, out: str) -> DataFrame:
    """How many rows up to this one satisfy ``starts``: the index of the current section."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def last_seen(df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str) -> DataFrame:
    """The latest value that isn't null up to this row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
