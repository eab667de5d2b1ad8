"""Streams of decisions: event-time counts and dedupe, for batch frames and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(posts: DataFrame, every: str = "6 hours", late: str | None = "1 hour") -> DataFrame:
    """Posts by state in tumbling windows; a stream drops rows later than `late` (None: it has a watermark already)."""
    rows = posts.withWatermark("posted_at", late) if posts.isStreaming and late else posts
    return rows.groupBy(F.window("posted_at", every).alias("w"), "status").agg(F.count("*").alias("posts")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "status", "posts")


def last_of_each(posts: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order; a stream (update or complete mode) sends a key's row again when a later one comes, as an upserted table would have it."""
    others = [c for c in posts.columns if c != key]
    return posts.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def first_of_each(posts: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """One row for each key: in a stream the first that comes, within the watermark."""
    return posts.withWatermark("posted_at", late).dropDuplicatesWithinWatermark([key]) if posts.isStreaming else posts.dropDuplicates([key])
