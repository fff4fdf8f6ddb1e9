"""Audit rows and queries over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptward.functions.scalars import prompt_hash, utc_day
from promptward.rules import DEFAULT_MODEL, MASKED_PROMPT_CHARS, RECENT_SCANS, RISK_LEVELS

AUDIT_COLUMNS = (
    "id",
    "timestamp",
    "prompt_hash",
    "masked_prompt",
    "risk_level",
    "attack_type",
    "latency",
    "model_used",
    "blocked",
    "triggered_rules",
    "similarity_score",
    "session_id",
)


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def audit_id(session: Column, timestamp: Column, digest: Column) -> Column:
    """Same prompt, session and instant give the same id, so replays can be recognised."""
    micros = F.unix_micros(timestamp).cast("string")
    return F.sha2(F.concat_ws(":", session, micros, digest), 256)


def to_audit(
    verdicts: DataFrame,
    text: str = "text",
    session: Column | str = "session_id",
    timestamp: Column | str = "ts",
    latency: Column | str = "latency_ms",
    model: Column | str | None = None,
) -> DataFrame:
    """Audit rows of a verdict table: the prompt itself is kept as a hash only."""
    parts = verdicts.withColumns(_prompt_columns(text))
    return stamped_audit(parts, session, timestamp, latency, model)


def _prompt_columns(text: str) -> dict[str, Column]:
    """What an audit row has from its prompt alone."""
    score = F.when(F.col("vector_check.triggered"), F.col("vector_check.similarity_score"))
    return {
        "_hash": prompt_hash(F.col(text)),
        "_shown": F.substring("masked_prompt", 1, MASKED_PROMPT_CHARS),
        "_score": score,
    }


def prompt_parts(verdicts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``keys`` and what ``stamped_audit`` needs of each prompt: no text, so joins carry none."""
    parts = verdicts.withColumns(_prompt_columns(text))
    return parts.select(*keys, "_hash", "_shown", "_score", "risk_level", "attack_type", "blocked", "triggered_rules")


def stamped_audit(
    parts: DataFrame,
    session: Column | str = "session_id",
    timestamp: Column | str = "ts",
    latency: Column | str = "latency_ms",
    model: Column | str | None = None,
) -> DataFrame:
    """Audit rows of ``prompt_parts`` joined with the requests that sent the prompts.

    Parts whose texts are stored already have a ``text_key`` for them, which goes with the row.
    """
    session, timestamp, latency = _column(session), _column(timestamp), _column(latency)
    apart = "text_key" in parts.columns
    return parts.select(
        audit_id(session, timestamp, F.col("_hash")).alias("id"),
        timestamp.alias("timestamp"),
        F.col("_hash").alias("prompt_hash"),
        (F.lit(None).cast("string") if apart else F.col("_shown")).alias("masked_prompt"),
        "risk_level",
        "attack_type",
        latency.cast("int").alias("latency"),
        (F.lit(DEFAULT_MODEL) if model is None else _column(model)).alias("model_used"),
        "blocked",
        "triggered_rules",
        F.col("_score").alias("similarity_score"),
        session.alias("session_id"),
        *(["text_key"] if apart else []),
    )


def instant(as_of: Column | datetime) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def recent_audit(audit: DataFrame, as_of: Column | datetime, hours: int = 24) -> DataFrame:
    """The columns dashboards need of the rows of the hours up to ``as_of``, both ends included.

    The table is read back by UTC day, so where it has a ``dt`` partition column the
    same bounds are put on it and other files are not listed.
    """
    until = instant(as_of)
    since = until - F.expr(f"INTERVAL {int(hours)} HOURS")
    rows = audit.filter((F.col("timestamp") >= since) & (F.col("timestamp") <= until))
    if "dt" in audit.columns:
        rows = rows.filter((F.col("dt") >= utc_day(since)) & (F.col("dt") <= utc_day(until)))
    return rows.select("timestamp", "blocked", "risk_level", "attack_type", "latency", "session_id")


def by_risk(audit: DataFrame, risk: str | None = None) -> DataFrame:
    return audit.filter(F.col("risk_level") == risk) if risk else audit


def threats(audit: DataFrame) -> DataFrame:
    """Rows with a finding and a session."""
    return audit.filter((F.col("attack_type") != "NONE") & F.col("session_id").isNotNull())


def _page_numbers(page: int | str, limit: int | str) -> tuple[int, int]:
    page, limit = int(page), int(limit)
    if page < 1 or limit < 1:
        raise ValueError("page and limit start at 1")
    return page, limit


def audit_page(
    audit: DataFrame, page: int | str = 1, limit: int | str = 20, risk: str | None = None
) -> DataFrame:
    """One page of audit rows, newest first.

    Every task keeps ``page * limit`` rows, and so does the merge: far pages cost as much as all
    before them.  ``audit_page_after`` goes on from a row instead.
    """
    page, limit = _page_numbers(page, limit)
    ordered = by_risk(audit, risk).orderBy(F.col("timestamp").desc(), "id")
    return ordered.offset((page - 1) * limit).limit(limit)


def page_end(page: DataFrame) -> tuple[datetime, str] | None:
    """Time and id of the last row of a page, from which the next page goes on; none for an empty page."""
    last = page.select("timestamp", "id").orderBy("timestamp", F.desc("id")).first()
    return None if last is None else (last["timestamp"], last["id"])


def audit_page_after(
    audit: DataFrame,
    after: tuple[datetime | Column, str | Column] | None = None,
    limit: int | str = 20,
    risk: str | None = None,
) -> DataFrame:
    """The ``limit`` rows that follow the row ``after`` (timestamp, id), newest first; the first ones without it.

    A page costs the same wherever it lies: tasks keep ``limit`` rows each, later days are not listed.
    """
    _, limit = _page_numbers(1, limit)
    rows = by_risk(audit, risk)
    if after is not None:
        until, last = instant(after[0]), after[1] if isinstance(after[1], Column) else F.lit(after[1])
        rows = rows.filter(
            (F.col("timestamp") <= until) & ((F.col("timestamp") < until) | (F.col("id") > last))
        )
        if "dt" in audit.columns:
            rows = rows.filter(F.col("dt") <= utc_day(until))
    return rows.orderBy(F.col("timestamp").desc(), "id").limit(limit)


def page_info(
    audit: DataFrame, page: int | str = 1, limit: int | str = 20, risk: str | None = None
) -> DataFrame:
    """Page, limit, number of rows and number of pages."""
    page, limit = _page_numbers(page, limit)
    return by_risk(audit, risk).agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"),
        F.lit(limit).alias("limit"),
        "total",
        F.ceil(F.col("total") / limit).cast("bigint").alias("total_pages"),
    )


def risk_counts(audit: DataFrame) -> DataFrame:
    """Rows per risk level over the whole table."""
    return audit.groupBy("risk_level").agg(F.count("*").alias("rows"))


def risk_counts_wide(audit: DataFrame) -> DataFrame:
    """Rows per risk level as one row with a column per level."""
    return audit.agg(
        *[F.count_if(F.col("risk_level") == level).alias(level.lower()) for level in RISK_LEVELS]
    )


def recent_scans(audit: DataFrame, n: int = RECENT_SCANS) -> DataFrame:
    """The newest scans of every session; rows without a session belong to none.

    The rank bound reaches below the shuffle, so a busy session sends on at most
    ``n`` rows per task.
    """
    newest = Window.partitionBy("session_id").orderBy(F.col("timestamp").desc(), F.col("id"))
    return (
        audit.filter(F.col("session_id").isNotNull())
        .select("session_id", "id", "timestamp", "risk_level", "attack_type", "latency", "model_used", "blocked")
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= n)
    )


def prompt_repeats(audit: DataFrame) -> DataFrame:
    """How often, from how many sessions and when each prompt was seen."""
    return audit.groupBy("prompt_hash").agg(
        F.count("*").alias("times"),
        F.count_distinct("session_id").alias("sessions"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
    )


def distinct_prompts(audit: DataFrame) -> DataFrame:
    """The first audit row of every prompt: the earliest, of equal times the one with the smallest id.

    Hashes meet their earliest time in a sum of numbers first, and that time their smallest id; only
    then are whole rows fetched, by id, so a prompt that a third of all rows repeat
    brings its texts to no task together.  Of rows that repeat an id as well one is kept.
    """
    narrow = audit.select("prompt_hash", "id", "timestamp")
    first = narrow.groupBy("prompt_hash").agg(F.min("timestamp").alias("timestamp"))
    earliest = narrow.join(first, ["prompt_hash", "timestamp"])
    ids = earliest.groupBy("prompt_hash", "timestamp").agg(F.array_min(F.collect_set("id")).alias("id"))
    key = ["id", "prompt_hash", "timestamp"]
    repeats = Window.partitionBy(*key).orderBy("latency", "model_used")
    fetched = audit.join(ids, key, "left_semi").withColumn("_repeat", F.row_number().over(repeats))
    return fetched.filter("_repeat = 1").select(*audit.columns)
