"""Connected components of a graph of edges, by minimum labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folianta.llm.common import cut

#: Graphs of at most so many directed edges (16 bytes each), which is counted, are solved by one task.
SMALL_EDGES = 1 << 18


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a small graph, by union-find."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            up.setdefault(x, x)
            up.setdefault(y, y)
            a, b = find(x), find(y)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, a: str, b: str, small_edges: int = SMALL_EDGES) -> DataFrame:
    """(node, root) for each node of ``edges``; root is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours (a sum-like aggregate with
    map-side combination, so that a hub's edges shrink before the shuffle) and then the label
    of that label, which halves long chains. Only the number of changes reaches the driver.
    Nulls and loops carry no link. Larger graphs than ``small_edges`` stay dealt over all partitions.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = cut(e.union(e.select("y", "x")).distinct())
    if both.count() <= small_edges:
        return cut(both.coalesce(1).mapInArrow(_united, "node long, root long"))
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        step = cut(step)
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        labels_next = step.join(jump, "root", "left").select("node", F.coalesce(F.least("root", "far"), "root").alias("root"), "was")
        labels_next = cut(labels_next)
        changed = labels_next.filter("root <> was").limit(1).count()
        labels = labels_next.select("node", "root")
        if not changed:
            return labels
