"""Personal-data operators over any text table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.functions.fence import fence
from promptward.functions.keys import TextKeys, with_lower_text
from promptward.functions.pii import (
    HIT_TYPE,
    PiiPattern,
    builtin_patterns,
    gaps_before,
    hits_of,
    mask_clusters,
    masked_text,
    matched_values,
    may_hold_numbers,
)
from promptward.functions.reuse import built_once


def with_pii_hits(
    df: DataFrame,
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
    keys: TextKeys | None = None,
) -> DataFrame:
    """Add ``_pii_hits``: all hits, kinds in declared order and each in text order."""
    patterns = tuple(patterns or builtin_patterns())
    own_keys = keys is None
    if own_keys:
        df, keys = with_lower_text(df, text)
    df = df.withColumn("_numeric", may_hold_numbers(F.col(text)))
    values = tuple(f"_pii_{i}" for i in range(len(patterns)))
    df = df.withColumns({c: matched_values(text, keys, p) for c, p in zip(values, patterns)})
    df = df.withColumn("_pii_hits", _hits_column(text, values, patterns))
    df = df.drop("_numeric", *values, *(keys if own_keys else ()))
    return fence(df, ["_pii_hits"])


@built_once
def _hits_column(text: str, values: tuple[str, ...], patterns: tuple[PiiPattern, ...]) -> Column:
    total = reduce(add, [F.size(c) for c in values])
    paired = F.concat(*[gaps_before(F.col(text), F.col(c), p) for c, p in zip(values, patterns)])
    none = F.array().cast(f"array<{HIT_TYPE}>")
    return F.when(total > 0, hits_of(paired, patterns)).otherwise(none)


@built_once
def _clusters_column(types: tuple[str, ...]) -> Column:
    return mask_clusters(F.col("_pii_hits"), types)


@built_once
def _masked_column(text: str) -> Column:
    return masked_text(F.col(text), F.col("_pii_marks"))


def with_masked_text(
    df: DataFrame,
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
    out: str = "masked_text",
    keys: TextKeys | None = None,
) -> DataFrame:
    """Add ``_pii_hits`` and the masked text."""
    patterns = tuple(patterns or builtin_patterns())
    df = with_pii_hits(df, text, patterns, keys)
    df = df.withColumn("_pii_marks", _clusters_column(tuple(p.type for p in patterns)))
    return df.withColumn(out, _masked_column(text)).drop("_pii_marks")


def pii_matches(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
    include_raw: bool = False,
) -> DataFrame:
    """One row per hit: id, type, ord, start, end, masked (and value on request)."""
    hits = with_pii_hits(df.select(id_col, text), text, patterns)
    rows = hits.select(id_col, F.posexplode("_pii_hits").alias("ord", "hit"))
    columns: list[Column | str] = [
        id_col,
        F.col("hit.type").alias("type"),
        (F.col("ord") + 1).alias("ord"),
        F.col("hit.start").alias("start"),
        F.col("hit.end").alias("end"),
        F.col("hit.masked").alias("masked"),
    ]
    if include_raw:
        columns.append(F.col("hit.value").alias("value"))
    return rows.select(*columns)


def mask_pii(
    df: DataFrame,
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
    out: str = "masked_text",
) -> DataFrame:
    """Add ``masked_text``; overlapping hits are resolved, nothing is masked twice."""
    return with_masked_text(df, text, patterns, out).drop("_pii_hits")


def pii_counts(
    df: DataFrame,
    by: Sequence[str] = ("type",),
    id_col: str = "doc_id",
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
) -> DataFrame:
    """Hits and texts with hits, by kind and any columns of the text table.

    Hits are counted inside the row first, so a kind met in a third of all rows
    sends one partial count per task to the shuffle, and each row one (row, kind) pair.
    """
    keep = [c for c in by if c != "type"]
    hits = with_pii_hits(df.select(*dict.fromkeys([id_col, text, *keep])), text, patterns)
    names = F.transform("_pii_hits", lambda h: h["type"])
    per_row = hits.select(*keep, names.alias("_names")).select(
        *keep, "_names", F.explode(F.array_distinct("_names")).alias("type")
    )
    counted = per_row.select(
        *by, F.size(F.filter("_names", lambda n: n == F.col("type"))).alias("_n")
    )
    return counted.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("hits"), F.count("*").alias("texts")
    )


def masked_corpus(
    df: DataFrame,
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
) -> DataFrame:
    """The table with its text masked, plus the kinds found and the number of hits."""
    masked = with_masked_text(df, text, patterns, "_masked")
    kinds = F.array_distinct(F.transform("_pii_hits", lambda h: h["type"]))
    return masked.select(
        *[F.col("_masked").alias(text) if c == text else F.col(c) for c in df.columns],
        kinds.alias("pii_types"),
        F.size("_pii_hits").alias("pii_count"),
    )


def pii_density(
    df: DataFrame,
    by: Sequence[str] = ("source", "lang"),
    text: str = "text",
    patterns: Sequence[PiiPattern] | None = None,
) -> DataFrame:
    """Hits, characters and hits per 1,000 characters for every combination of ``by``, each of its parts, and in all.

    Two sums in one pass; ``level`` tells the totals from null values: one bit for each
    column of ``by``, set where the row sums over it.  Null texts have no hits and no characters.
    """
    hits = with_pii_hits(df.select(*dict.fromkeys([*by, text])), text, patterns)
    sums = hits.select(
        *by, F.size("_pii_hits").cast("bigint").alias("_n"), F.coalesce(F.length(text), F.lit(0)).alias("_chars")
    )
    counted = sums.cube(*by).agg(
        F.grouping_id().cast("int").alias("level"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("_chars"), F.lit(0)).alias("chars"),
    )
    per_thousand = F.when(F.col("chars") > 0, F.col("hits") * 1000 / F.col("chars")).otherwise(0.0)
    return counted.select("level", *by, "hits", "chars", per_thousand.alias("per_1000_chars"))
