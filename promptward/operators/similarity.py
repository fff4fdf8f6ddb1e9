"""Similarity operators over any text table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.functions import similarity as fx
from promptward.functions.fence import fence
from promptward.functions.keys import TextKeys, with_text_keys
from promptward.rules import DEFAULT_THRESHOLD


def with_seed_scores(
    df: DataFrame,
    text: str = "text",
    seeds: Sequence[fx.Seed] | None = None,
    keys: TextKeys | None = None,
) -> DataFrame:
    """Add ``_scores``: the cosine similarity to every seed."""
    seeds = tuple(seeds or fx.builtin_seeds())
    own_keys = keys is None
    if own_keys:
        df, keys = with_text_keys(df, text)
    df = df.withColumn("_shared", fx.shared_words(keys, seeds))
    df = df.withColumn("_repeated", fx.repeated_words(keys, "_shared"))
    df = df.withColumn("_scores", fx.seed_scores(keys, "_shared", "_repeated", seeds))
    return df.drop("_shared", "_repeated", *(keys if own_keys else ()))


def seed_similarity(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seeds: Sequence[fx.Seed] | None = None,
) -> DataFrame:
    """One row per text and seed with the unrounded score."""
    scored = with_seed_scores(df.select(id_col, text), text, seeds)
    return scored.select(id_col, F.explode("_scores").alias("s")).select(
        id_col, F.col("s.seed").alias("seed"), F.col("s.score").alias("score")
    )


def with_vector_check(
    df: DataFrame,
    text: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
    seeds: Sequence[fx.Seed] | None = None,
    keys: TextKeys | None = None,
) -> DataFrame:
    """Add ``_vector``: the best seed, its rounded score and whether it triggered."""
    df = with_seed_scores(df, text, seeds, keys)
    df = df.withColumn("_best", fx.best_seed(F.col("_scores")))
    df = df.withColumn("_vector", fx.vector_check(F.col("_best"), threshold)).drop("_scores", "_best")
    return fence(df, ["_vector"])


def vector_check(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
    seeds: Sequence[fx.Seed] | None = None,
) -> DataFrame:
    """Best seed per text."""
    checked = with_vector_check(df.select(id_col, text), text, threshold, seeds)
    return checked.select(id_col, "_vector.*")


def similarity_histogram(
    df: DataFrame, text: str = "text", seeds: Sequence[fx.Seed] | None = None
) -> DataFrame:
    """Texts per tenth of the best (rounded) score and closest seed."""
    checked = with_vector_check(df.select(text), text, seeds=seeds)
    bucket = F.least(F.floor(F.col("_vector.similarity_score") * 10), F.lit(9)).cast("int")
    return checked.groupBy(
        bucket.alias("bucket"), F.col("_vector.closest_seed").alias("closest_seed")
    ).agg(F.count("*").alias("texts"))
