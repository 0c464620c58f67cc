"""At-most-once reservations of deliveries, and streams over append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reserve(subscribers: DataFrame, deliveries: DataFrame, tag: str, batch: int) -> DataFrame:
    """The next ``batch`` confirmed subscribers without a delivery under ``tag``, oldest first; append it to reserve them.

    A subscriber with a reservation is never picked again, also if the delivery failed later:
    at most once. Running it again after appending goes on where it stopped.
    """
    done = deliveries.filter(F.col("tag") == tag).select("subscriber_id").distinct()
    open_ = subscribers.filter("confirmed").join(done, "subscriber_id", "left_anti")
    return open_.orderBy("created_at", "subscriber_id").limit(batch).select(F.lit(tag).alias("tag"), "subscriber_id")


def latest_state(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key in an append-only log; stale versions drop out."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def windowed_counts(events: DataFrame, minutes: int = 10, late: str = "1 hour") -> DataFrame:
    """Events per type in tumbling windows with a watermark; for batch and stream alike."""
    w = F.window("ts", f"{minutes} minutes")
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
