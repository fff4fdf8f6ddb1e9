"""Conversations: the prompt to scan, and what may be forwarded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.operators.pii import mask_pii


def accepted_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.filter(F.col(text).isNotNull())


def rejected_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """The rows ``accepted_messages`` drops."""
    return messages.filter(F.col(text).isNull())


def latest_turns(messages: DataFrame) -> DataFrame:
    """conv_id and ``latest``: a number that orders the user messages of a conversation.

    The number is the turn followed by a hash of the text, so that of two messages of one turn the same one
    wins everywhere.  It is a plain maximum of numbers: no text is sorted or sent on, and a
    stream keeps one number per conversation.
    """
    return _user_messages(messages).groupBy("conv_id").agg(F.max("latest").alias("latest"))


def _user_messages(messages: DataFrame) -> DataFrame:
    user = accepted_messages(messages).filter(F.col("role") == "user")
    # turn * 2**64 + hash + 2**63, exact in 38 digits.
    above = "CAST(turn AS DECIMAL(19, 0)) * CAST('18446744073709551616' AS DECIMAL(20, 0))"
    below = "CAST(xxhash64(text) AS DECIMAL(19, 0)) + CAST('9223372036854775808' AS DECIMAL(19, 0))"
    return user.withColumn("latest", F.expr(f"CAST({above} + {below} AS DECIMAL(38, 0))"))


def with_text_of(latest: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, turn and text of the messages that ``latest_turns`` names."""
    found = _user_messages(messages).join(latest, ["conv_id", "latest"])
    return found.groupBy("conv_id", "latest", "turn", "text").agg(F.count("*")).select("conv_id", "turn", "text")


def latest_user_prompt(messages: DataFrame) -> DataFrame:
    """Newest user message per conversation; conversations without one are left out.

    The newest turn is found on numbers alone and its text fetched by conversation and turn.
    Turns lie below 10**18.  Repeated messages count once.
    """
    return with_text_of(latest_turns(messages), messages)


def sanitize_conversation(
    messages: DataFrame, verdicts: DataFrame | None = None, mode: str = "all_user_turns"
) -> DataFrame:
    """Messages with personal data of the user masked.

    ``all_user_turns`` masks every user message where it stands.  ``latest_only``
    masks the user messages equal to the scanned prompt of ``verdicts``
    (conv_id, text, masked_prompt) and leaves other turns as they are.
    """
    columns = messages.columns
    if mode == "all_user_turns":
        user = F.col("role") == "user"
        masked = mask_pii(messages.withColumn("_t", F.when(user, F.col("text"))), "_t", out="_masked")
        return masked.select(
            *[F.when(user, F.col("_masked")).otherwise(F.col(c)).alias(c) if c == "text" else c for c in columns]
        )
    if mode != "latest_only":
        raise ValueError(f"unknown mode: {mode}")
    # A mask meets the messages of its own text only, by a digest: the other turns carry none.
    scanned = (
        verdicts.filter(F.col("text") != F.col("masked_prompt"))
        .select("conv_id", F.sha2("text", 256).alias("_digest"), F.col("masked_prompt").alias("_masked"))
        .dropDuplicates(["conv_id", "_digest"])
    )
    own = F.when(F.col("role") == "user", F.sha2("text", 256))
    return messages.withColumn("_digest", own).join(scanned, ["conv_id", "_digest"], "left").select(
        *[F.coalesce("_masked", c).alias(c) if c == "text" else c for c in columns]
    )


def forwardable(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Messages of conversations whose scanned prompt was not blocked.

    A conversation without a verdict, such as one without a user turn, was never
    scanned and stays behind; so does one whose verdict is unknown.
    """
    passed = verdicts.filter(~F.col("blocked")).select("conv_id")
    return messages.join(passed, "conv_id", "left_semi")


def not_forwardable(messages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The messages that ``forwardable`` holds back."""
    passed = verdicts.filter(~F.col("blocked")).select("conv_id")
    return messages.join(passed, "conv_id", "left_anti")
