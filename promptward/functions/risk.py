"""Risk level, attack type and block decision."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptward.functions.injection import max_severity
from promptward.functions.scalars import risk_rank
from promptward.rules import (
    ATTACK_COMBINED,
    ATTACK_INJECTION,
    ATTACK_NONE,
    ATTACK_PII,
    ATTACK_VECTOR,
    BLOCK_FROM,
    RISK_RANK,
)


def risk_level(severity: Column, has_pii: Column, vector: Column) -> Column:
    """Risk from the highest signal severity rank (0 for none), PII and similarity.

    Each finding sets a floor (PII medium, similarity high); personal data next to
    an attack raises medium and high by one level.
    """
    floor = F.greatest(
        severity,
        F.when(has_pii, RISK_RANK["MEDIUM"]).otherwise(RISK_RANK["LOW"]),
        F.when(vector, RISK_RANK["HIGH"]).otherwise(RISK_RANK["LOW"]),
    )
    raised = F.when(has_pii & ((severity > 0) | vector), 1).otherwise(0)
    rank = F.when(floor >= RISK_RANK["MEDIUM"], F.least(floor + raised, F.lit(RISK_RANK["CRITICAL"])))
    return reduce(
        lambda chain, level: chain.when(rank == RISK_RANK[level], level),
        ("HIGH", "CRITICAL"),
        F.when(rank == RISK_RANK["MEDIUM"], "MEDIUM"),
    ).otherwise("LOW")


def attack_type(has_injection: Column, has_pii: Column, vector: Column) -> Column:
    families = reduce(add, [c.cast("int") for c in (has_injection, has_pii, vector)])
    return (
        F.when(families == 0, ATTACK_NONE)
        .when(families > 1, ATTACK_COMBINED)
        .when(has_injection, ATTACK_INJECTION)
        .when(has_pii, ATTACK_PII)
        .otherwise(ATTACK_VECTOR)
    )


def is_blocked(level: Column, has_injection: Column, vector: Column) -> Column:
    """Personal data alone never blocks."""
    return (risk_rank(level) >= RISK_RANK[BLOCK_FROM]) & (has_injection | vector)


def triggered_rules(signals: Column, pii: Column, vector: Column) -> Column:
    """Signal names, then one entry per PII hit, then the seed when triggered."""
    return F.concat(
        F.transform(signals, lambda s: s["rule_name"]),
        F.transform(pii, lambda h: F.concat(F.lit("PII:"), h["type"])),
        F.when(
            vector["triggered"], F.array(F.concat(F.lit("VECTOR:"), vector["closest_seed"]))
        ).otherwise(F.array().cast("array<string>")),
    )


__all__ = ["attack_type", "is_blocked", "max_severity", "risk_level", "triggered_rules"]
