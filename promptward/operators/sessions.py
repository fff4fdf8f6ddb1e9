"""Sessions of the audit over time: activity, alerts and repeats.

All three are aggregations over event time, so they run on a table as they are and on a
stream behind a watermark; counts are combined before they are shuffled, and a stream
keeps one narrow row for each open window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.functions.scalars import digest_bytes, digest_text, other_text

ACTIVITY_GAP = "30 minutes"
ALERT_WINDOW, ALERT_EVERY, ALERT_LIMIT = "1 hour", "10 minutes", 2
REPEAT_HORIZON = "1 hour"


def session_activity(audit: DataFrame, gap: str = ACTIVITY_GAP) -> DataFrame:
    """Stretches of a session without a pause longer than ``gap``.

    session_id, started and ended (first and last row), total, blocked.  Rows without a session or
    time belong to none.
    """
    return (
        audit.filter(F.col("session_id").isNotNull())
        .groupBy("session_id", F.session_window("timestamp", gap).alias("_window"))
        .agg(
            F.min("timestamp").alias("started"),
            F.max("timestamp").alias("ended"),
            F.count("*").alias("total"),
            F.count_if("blocked").alias("blocked"),
        )
        .drop("_window")
    )


def session_alerts(
    audit: DataFrame, limit: int = ALERT_LIMIT, window: str = ALERT_WINDOW, every: str = ALERT_EVERY
) -> DataFrame:
    """Overlapping windows in which a session had ``limit`` blocked prompts or more, one alert each.

    session_id, window_start, window_end, blocked, total.  The limit applies to whole counts.
    """
    return (
        audit.filter(F.col("session_id").isNotNull())
        .groupBy("session_id", F.window("timestamp", window, every).alias("_window"))
        .agg(F.count_if("blocked").alias("blocked"), F.count("*").alias("total"))
        .filter(F.col("blocked") >= limit)
        .select(
            "session_id",
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "blocked",
            "total",
        )
    )


def first_in_horizon(audit: DataFrame, horizon: str = REPEAT_HORIZON) -> DataFrame:
    """The earliest row of every prompt hash in each ``horizon`` of time, with the number of repeats.

    prompt_hash, horizon_start, timestamp, id, times; of equal times the smallest id counts.  Horizons
    are aligned, not chained from row to row: so the earliest of parts is the earliest of
    all, repeats are combined in each task before the shuffle, and the order of arrival does not matter.
    Digests are shuffled, and kept in the state, as bytes; ids that are none beside them.
    """
    digest, packed = F.col("prompt_hash"), digest_bytes(F.col("id"))
    unpacked = F.struct(F.col("_packed.timestamp"), digest_text(F.col("_packed.id")).alias("id"))
    return (
        audit.groupBy(
            digest_bytes(digest).alias("_digest"),
            other_text(digest).alias("_other"),
            F.window("timestamp", horizon).alias("_window"),
        )
        .agg(
            F.min(F.when(packed.isNotNull(), F.struct("timestamp", packed.alias("id")))).alias("_packed"),
            F.min(F.when(packed.isNull(), F.struct("timestamp", "id"))).alias("_plain"),
            F.count("*").alias("times"),
        )
        .withColumn("_first", F.least(F.when(F.col("_packed").isNotNull(), unpacked), "_plain"))
        .select(
            F.coalesce(digest_text(F.col("_digest")), "_other").alias("prompt_hash"),
            F.col("_window.start").alias("horizon_start"),
            F.col("_first.timestamp").alias("timestamp"),
            F.col("_first.id").alias("id"),
            "times",
        )
    )
