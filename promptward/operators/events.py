"""Scan events for downstream consumers, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.operators.audit import _column, audit_id
from promptward.functions.scalars import prompt_hash, utc_text
from promptward.rules import BLOCKED_MODEL, DEFAULT_MODEL

BLOCK_MESSAGE = "Request blocked by security policy."


def scan_events(
    verdicts: DataFrame,
    text: str = "text",
    session: Column | str = "session_id",
    timestamp: Column | str = "ts",
    latency: Column | str = "latency_ms",
    model: Column | str | None = None,
) -> DataFrame:
    """A metadata event per prompt, followed by an error event where it was blocked.

    Matched values are left out of the events; only their masks travel.
    """
    return stamped_events(verdicts.select("*", *_event_columns(text)), session, timestamp, latency, model)


def event_parts(verdicts: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """``keys`` and what ``stamped_events`` needs of each prompt: hash and events are made once for all requests."""
    return verdicts.select(*keys, *_event_columns(text), "risk_level", "blocked")


def _event_columns(text: str) -> list[Column]:
    """What an event has from its prompt alone: the hash, and the JSON up to the last field of the scan result."""
    hits = F.transform(
        "pii_matches",
        lambda h: F.struct(h["type"].alias("type"), h["masked"].alias("masked"), h["start"].alias("start"), h["end"].alias("end")),
    )
    signals = F.transform(
        "injection_signals",
        lambda s: F.struct(
            s["rule_name"].alias("ruleName"),
            s["description"].alias("description"),
            s["severity"].alias("severity"),
        ),
    )
    vector = F.col("vector_check")
    result = F.struct(
        F.col("risk_level").alias("riskLevel"),
        F.col("attack_type").alias("attackType"),
        F.col("blocked").alias("blocked"),
        hits.alias("piiMatches"),
        F.col("masked_prompt").alias("maskedPrompt"),
        signals.alias("injectionSignals"),
        F.struct(
            vector["triggered"].alias("triggered"),
            vector["similarity_score"].alias("similarityScore"),
            vector["closest_seed"].alias("closestSeed"),
        ).alias("vectorCheck"),
        F.col("triggered_rules").alias("triggeredRules"),
    )
    opened = F.to_json(F.struct(F.lit("metadata").alias("type"), result.alias("scanResult")))
    return [
        prompt_hash(F.col(text)).alias("_hash"),
        F.regexp_replace(opened, r"\}\}\z", "").alias("_opened"),
    ]


def stamped_events(
    parts: DataFrame,
    session: Column | str = "session_id",
    timestamp: Column | str = "ts",
    latency: Column | str = "latency_ms",
    model: Column | str | None = None,
) -> DataFrame:
    """Events of ``event_parts`` joined with the requests that sent the prompts."""
    session, timestamp, latency = _column(session), _column(timestamp), _column(latency).cast("int")
    model = F.lit(DEFAULT_MODEL) if model is None else _column(model)
    stamped = parts.select(
        audit_id(session, timestamp, F.col("_hash")).alias("request_id"),
        timestamp.alias("timestamp"),
        "risk_level",
        "blocked",
        F.when(F.col("blocked"), BLOCKED_MODEL).otherwise(model).alias("_model"),
        latency.alias("_latency"),
        "_opened",
    )
    comma = F.when(F.col("_opened").endswith("{"), "").otherwise(",")
    last_field = F.when(
        F.col("_latency").isNotNull(), F.concat(comma, F.lit('"latencyMs":'), F.col("_latency").cast("string"))
    ).otherwise("")
    request = F.to_json(
        F.struct(
            F.col("_model").alias("model"),
            F.col("request_id").alias("requestId"),
            utc_text(F.col("timestamp")).alias("timestamp"),
        )
    )
    metadata = F.concat("_opened", last_field, F.lit("},"), request.substr(F.lit(2), F.length(request)))
    error = F.to_json(
        F.struct(
            F.lit("error").alias("type"),
            F.lit(BLOCK_MESSAGE).alias("message"),
            F.concat(F.lit("BLOCKED_"), F.col("risk_level")).alias("code"),
        )
    )
    both = F.when(F.col("blocked"), F.array(metadata, error)).otherwise(F.array(metadata))
    return stamped.select(
        "request_id", "timestamp", "blocked", F.posexplode(both).alias("ord", "event")
    ).select(
        "request_id",
        "timestamp",
        (F.col("ord") + 1).alias("ord"),
        F.when(F.col("ord") == 0, "metadata").otherwise("error").alias("event_type"),
        "event",
    )


def scan_history(audit: DataFrame) -> DataFrame:
    """The audit columns shown in a scan history; blocked requests reached no model."""
    return audit.select(
        "id",
        "timestamp",
        "risk_level",
        "attack_type",
        F.col("latency").alias("latency_ms"),
        F.when(F.col("blocked"), BLOCKED_MODEL).otherwise(F.col("model_used")).alias("model"),
        "blocked",
    )
