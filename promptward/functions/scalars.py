"""Scalar column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptward.rules import RISK_RANK, SEVERITY_BANDS


def sql_str(value: str) -> str:
    """SQL string literal, for expressions built from long constant lists."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_DAY_MICROS = 86_400_000_000


def utc_day(instant: Column) -> Column:
    """The date of a timestamp in UTC, whatever the session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / _DAY_MICROS).cast("int"))


def utc_text(instant: Column) -> Column:
    """A timestamp as ISO 8601 text in UTC with milliseconds, whatever the session time zone."""
    millis = F.floor(F.pmod(F.unix_micros(instant), F.lit(_DAY_MICROS)) / 1000).cast("int")
    seconds = F.floor(millis / 1000).cast("int")
    return F.format_string(
        "%sT%02d:%02d:%02d.%03dZ",
        utc_day(instant).cast("string"),
        F.floor(seconds / 3600).cast("int"),
        (F.floor(seconds / 60) % 60).cast("int"),
        seconds % 60,
        millis % 1000,
    )


def half_up(value: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(value + F.lit(0.5)).cast("int")


def three_decimals(value: Column) -> Column:
    return F.floor(value * 1000 + F.lit(0.5)) / F.lit(1000.0)


def percentage(part: Column, whole: Column) -> Column:
    """Rounded percentage; 0 for an empty whole."""
    return F.when(whole > 0, half_up(part / whole * 100)).otherwise(0)


def prompt_hash(text: Column) -> Column:
    """SHA-256 in hex of the UTF-8 text."""
    return F.sha2(text, 256)


def digest_bytes(digest: Column) -> Column:
    """The bytes of a digest in lower-case hex, half as long and in the same order; null for any other text."""
    return F.when(digest_text(F.unhex(digest)) == digest, F.unhex(digest))


def other_text(digest: Column) -> Column:
    """What has no ``digest_bytes``."""
    return F.when(digest_bytes(digest).isNull(), digest)


def digest_text(digest: Column) -> Column:
    """The lower-case hex of ``digest_bytes``."""
    return F.lower(F.hex(digest))


def risk_rank(level: Column) -> Column:
    """Numeric order of a risk level, 1 (LOW) to 4 (CRITICAL)."""
    return reduce(
        lambda chain, item: chain.when(level == item[0], F.lit(item[1])),
        list(RISK_RANK.items())[1:],
        F.when(level == "LOW", F.lit(1)),
    )


def session_label(session: Column) -> Column:
    """Short display form of a session id."""
    hex_id = F.regexp_replace(session, "-", "")
    return (
        F.when(session.startswith("Sim-") | session.startswith("User-"), session)
        .when(
            session.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-"),
            F.concat(F.lit("User-"), F.substring(hex_id, 1, 4)),
        )
        .when(F.length(session) <= 22, session)
        .otherwise(
            F.concat(F.substring(session, 1, 8), F.lit("…"), F.substring(session, -4, 4))
        )
    )


def severity_band(rate_pct: Column) -> Column:
    """Band of a session's threat rate: high from 70 %, mid from 40 %, else low."""
    (high, high_from), (mid, mid_from), (low, _) = SEVERITY_BANDS
    return F.when(rate_pct >= high_from, high).when(rate_pct >= mid_from, mid).otherwise(low)
