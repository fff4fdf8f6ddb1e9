"""Derived columns of a text that the detectors share."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.functions.patterns import LOWER_ALNUM
from promptward.functions.scalars import sql_str


class TextKeys(NamedTuple):
    """Column names: lower-cased text, its words with repeats, distinct words, and
    the distinct words as one text.

    A literal of letters and digits occurs in a text exactly when it occurs in the
    text of its distinct words, which is several times shorter on long texts; the
    detectors search most of their literals there.
    """

    lower: str = "_low"
    words: str = "_split"
    distinct: str = "_distinct"
    vocabulary: str = "_vocab"


def with_lower_text(df: DataFrame, text: str) -> tuple[DataFrame, TextKeys]:
    """Lower-cased text only, for a layer that searches too little to pay for words."""
    k = TextKeys(vocabulary=TextKeys().lower)
    return df.withColumn(k.lower, F.lower(text)), k


def with_text_keys(df: DataFrame, text: str) -> tuple[DataFrame, TextKeys]:
    k = TextKeys()
    df = df.withColumn(k.lower, F.lower(text))
    df = df.withColumn(k.words, F.split(k.lower, f"[^{LOWER_ALNUM}]+"))
    df = df.withColumn(k.distinct, F.array_distinct(k.words))
    return df.withColumn(k.vocabulary, F.array_join(k.distinct, " ")), k


def holds(keys: TextKeys, literal: str) -> str:
    """SQL condition: the lower-cased text holds a lower-case literal."""
    plain = literal.isascii() and literal.isalnum()
    return f"contains({keys.vocabulary if plain else keys.lower}, {sql_str(literal)})"
