"""The scan: three detection layers and the verdict, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.functions import injection as inj
from promptward.functions import risk
from promptward.functions.fence import fence
from promptward.functions.keys import with_text_keys
from promptward.functions.pii import PiiPattern
from promptward.functions.similarity import Seed
from promptward.operators.injection import with_signals
from promptward.operators.pii import with_masked_text
from promptward.operators.similarity import with_vector_check
from promptward.rules import DEFAULT_THRESHOLD, KEYWORDS, RULES, Keyword, Rule

VERDICT_COLUMNS = (
    "risk_level",
    "attack_type",
    "blocked",
    "pii_matches",
    "masked_prompt",
    "injection_signals",
    "vector_check",
    "triggered_rules",
)


def scan(
    df: DataFrame,
    text: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
    patterns: Sequence[PiiPattern] | None = None,
    rules: Sequence[Rule] = RULES,
    keywords: Sequence[Keyword] = KEYWORDS,
    seeds: Sequence[Seed] | None = None,
) -> DataFrame:
    """Add the verdict columns to a text table.

    Everything is a projection: nothing is shuffled.  The findings of each layer and
    the decision made of them are computed once per row; the masked text and the
    lists made from them only where a later step reads them.  Works the same on a
    streaming DataFrame.
    """
    kept = df.columns
    df, keys = with_text_keys(df, text)
    # The layer that needs the longest helper columns comes first, so that they are
    # pruned early and not copied from step to step.
    df = with_vector_check(df, text, threshold, seeds, keys)
    df = with_signals(df, text, rules, keywords, keys)
    df = with_masked_text(df, text, patterns, "masked_prompt", keys)

    df = df.withColumns(
        {
            "_severity": inj.max_severity(F.col("_signals")),
            "_has_injection": F.size("_signals") > 0,
            "_has_pii": F.size("_pii_hits") > 0,
            "_triggered": F.col("_vector.triggered"),
        }
    )
    flags = F.col("_has_injection"), F.col("_has_pii"), F.col("_triggered")
    df = df.withColumn("risk_level", risk.risk_level(F.col("_severity"), flags[1], flags[2]))
    df = df.select(
        *kept,
        "risk_level",
        risk.attack_type(*flags).alias("attack_type"),
        risk.is_blocked(F.col("risk_level"), flags[0], flags[2]).alias("blocked"),
        F.col("_pii_hits").alias("pii_matches"),
        "masked_prompt",
        F.col("_signals").alias("injection_signals"),
        F.col("_vector").alias("vector_check"),
        risk.triggered_rules(F.col("_signals"), F.col("_pii_hits"), F.col("_vector")).alias(
            "triggered_rules"
        ),
    )
    return fence(df, ("risk_level", "attack_type", "blocked"))


def stage_status(verdicts: DataFrame, id_col: str = "id") -> DataFrame:
    """What each layer did to a prompt, with short details for display."""
    vector = F.col("vector_check")
    n_pii, n_signals = F.size("pii_matches"), F.size("injection_signals")
    kinds = F.array_distinct(F.transform("pii_matches", lambda h: h["type"]))
    names = F.transform("injection_signals", lambda s: s["rule_name"])
    return verdicts.select(
        id_col,
        F.when(n_pii > 0, "masked").otherwise("clean").alias("pii_status"),
        F.when(F.col("blocked") | (n_signals > 0), "blocked")
        .otherwise("passed")
        .alias("injection_status"),
        F.when(vector["triggered"], "triggered").otherwise("safe").alias("vector_status"),
        F.when(n_pii == 0, "0 items detected")
        .otherwise(F.concat(n_pii.cast("string"), F.lit(" item(s) masked")))
        .alias("pii_detail"),
        F.when(n_signals == 0, "0 signals detected")
        .otherwise(F.concat(n_signals.cast("string"), F.lit(" signal(s) fired")))
        .alias("injection_detail"),
        F.concat(F.lit("similarity: "), F.format_string("%.3f", vector["similarity_score"])).alias(
            "vector_detail"
        ),
        F.slice(kinds, 1, 5).alias("pii_tags"),
        F.slice(names, 1, 4).alias("injection_tags"),
        F.when(vector["triggered"], F.array(F.substring(vector["closest_seed"], 1, 36)))
        .otherwise(F.array().cast("array<string>"))
        .alias("vector_tags"),
    )


def badge_columns(verdicts: DataFrame, id_col: str = "id") -> DataFrame:
    """Badges of a chat row: number of PII hits, block notice, attack label."""
    return verdicts.select(
        id_col,
        F.size("pii_matches").alias("pii_badge"),
        F.when(
            F.col("blocked"),
            F.concat(
                F.lit("BLOCKED · "), F.col("risk_level"), F.lit(" RISK · "), F.col("attack_type")
            ),
        ).alias("blocked_badge"),
        F.when(F.col("attack_type") == "NONE", "CLEAN")
        .otherwise(F.col("attack_type"))
        .alias("attack_label"),
    )
