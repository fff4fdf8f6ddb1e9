"""Dashboard aggregates over the audit table.

``as_of`` is a time, so that the bound is pushed into the scan, or a column
expression such as a scalar subquery.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptward.functions.scalars import half_up, percentage, session_label, severity_band
from promptward.operators.audit import instant, recent_audit
from promptward.rules import (
    ATTACK_COMBINED,
    ATTACK_NONE,
    ATTACK_ORDER,
    ATTACK_PII,
    MIN_LABELLED_SHARE,
    RANKED_SESSIONS,
    TIMELINE_HOURS,
    TIMELINE_LABEL_STEP,
)


def hourly_timeline(audit: DataFrame, as_of: Column | datetime) -> DataFrame:
    """24 hourly slots, oldest first, with all and blocked rows, zero where empty.

    Rows go to the slot of their hour of day, so the part of an hour that lies
    24 hours back is counted in the newest slot and the sum is the 24-hour total.
    """
    counted = (
        recent_audit(audit, as_of)
        .groupBy(F.hour("timestamp").alias("_hour"))
        .agg(F.count("*").alias("_total"), F.count_if("blocked").alias("_blocked"))
    )
    last = TIMELINE_HOURS - 1
    ago = F.make_dt_interval(hours=F.lit(last) - F.col("slot"))
    slots = (
        audit.sparkSession.range(TIMELINE_HOURS)
        .select(F.col("id").cast("int").alias("slot"))
        .select("slot", F.hour(instant(as_of) - ago).alias("_hour"))
    )
    hour = F.format_string("%02d:00", F.col("_hour"))
    return (
        slots.join(F.broadcast(counted), "_hour", "left")  # at most 24 rows
        .select(
            "slot",
            hour.alias("hour"),
            F.when(F.col("slot") % TIMELINE_LABEL_STEP == 0, hour).otherwise("").alias("label"),
            F.coalesce("_total", F.lit(0)).cast("bigint").alias("total"),
            F.coalesce("_blocked", F.lit(0)).cast("bigint").alias("blocked"),
        )
        .orderBy("slot")
    )


def _attack_types(spark: SparkSession) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ATTACK_ORDER])
    return spark.range(1).select(F.posexplode(names).alias("ord", "name"))


def attack_breakdown(audit: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Rows per attack type of the last 24 hours; all four types in fixed order."""
    counted = (
        recent_audit(audit, as_of)
        .filter(F.col("attack_type").isin(*ATTACK_ORDER))
        .groupBy(F.col("attack_type").alias("name"))
        .agg(F.count("*").alias("_n"))
    )
    return (
        _attack_types(audit.sparkSession)
        .join(F.broadcast(counted), "name", "left")  # at most four rows
        .select("ord", "name", F.coalesce("_n", F.lit(0)).cast("bigint").alias("value"))
        .orderBy("ord")
    )


def attack_share(audit: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Shares of the attack types that occurred; small ones are not labelled."""
    present = attack_breakdown(audit, as_of).filter(F.col("value") > 0)
    share = F.col("value") / F.sum("value").over(Window.partitionBy())
    return present.select("ord", "name", "value", share.alias("share")).select(
        "*",
        F.concat(half_up(F.col("share") * 100).cast("string"), F.lit("%")).alias("label"),
        (F.col("share") >= MIN_LABELLED_SHARE).alias("show_label"),
    )


def risk_distribution(audit: DataFrame, as_of: Column | datetime) -> DataFrame:
    """Rows per risk level of the last 24 hours."""
    return recent_audit(audit, as_of).groupBy("risk_level").agg(F.count("*").alias("rows"))


def session_ranking(audit: DataFrame, top: int = RANKED_SESSIONS) -> DataFrame:
    """Sessions with most findings, with all their rows, threat rate and band.

    One aggregation gives findings and totals together, and the top is taken
    without sorting all sessions.
    """
    per_session = (
        audit.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.count_if(F.col("attack_type") != ATTACK_NONE).alias("threat_count"),
            F.count_if("blocked").alias("blocked_count"),
            F.count("*").alias("total"),
        )
        .filter(F.col("threat_count") > 0)
        .orderBy(F.col("threat_count").desc(), "session_id")
        .limit(top)
    )
    order = Window.orderBy(F.col("threat_count").desc(), F.col("session_id"))
    return (
        per_session.withColumn("rank", F.row_number().over(order))  # over the top only
        .withColumn("rate_pct", percentage(F.col("threat_count"), F.col("total")))
        .select(
            "rank",
            "session_id",
            session_label(F.col("session_id")).alias("session_label"),
            "threat_count",
            "blocked_count",
            "total",
            "rate_pct",
            severity_band(F.col("rate_pct")).alias("severity_band"),
        )
    )


def summary_metrics(audit: DataFrame, as_of: Column | datetime) -> DataFrame:
    """One row of headline numbers; zero for an empty table.

    The 24-hour part reads few columns of few files; the all-time count reads none.
    """
    recent = recent_audit(audit, as_of)
    numbers = recent.agg(
        F.count("*").alias("total_24h"),
        F.count_if("blocked").alias("blocked_24h"),
        F.count_if(F.col("attack_type").isin(ATTACK_PII, ATTACK_COMBINED)).alias("pii_detected"),
        F.coalesce(half_up(F.avg("latency")), F.lit(0)).alias("avg_latency_ms"),
    )
    all_time = audit.agg(F.count("*")).scalar()
    return numbers.select(
        "total_24h",
        "blocked_24h",
        "pii_detected",
        "avg_latency_ms",
        all_time.alias("all_time_total"),
        percentage(F.col("blocked_24h"), F.col("total_24h")).alias("block_rate_24h"),
    )


def all_time_metrics(audit: DataFrame) -> DataFrame:
    """All rows and their mean latency."""
    return audit.agg(F.count("*").alias("rows"), F.avg("latency").alias("avg_latency"))


def pii_rows(verdicts: DataFrame) -> DataFrame:
    """Prompts that really hold personal data (the summary counts all combined ones)."""
    return verdicts.agg(F.count_if(F.size("pii_matches") > 0).alias("pii_rows"))
