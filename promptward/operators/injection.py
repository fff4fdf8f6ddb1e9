"""Injection operators over any text table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.functions import injection as fx
from promptward.functions.fence import fence
from promptward.functions.keys import TextKeys, holds, with_text_keys
from promptward.rules import KEYWORDS, RULES, Keyword, Rule


def with_signals(
    df: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    keywords: Sequence[Keyword] = KEYWORDS,
    keys: TextKeys | None = None,
) -> DataFrame:
    """Add ``_signals``: rule and keyword signals by falling severity."""
    own_keys = keys is None
    if own_keys:
        df, keys = with_text_keys(df, text)
    shared = {w: f"_a{i}" for i, w in enumerate(fx.SHARED)}
    asked = F.array(*[F.lit(w) for w in fx.whole_words()])
    df = df.withColumns(
        {
            "_present": F.array_intersect(keys.distinct, asked),
            **{c: F.expr(holds(keys, w)) for w, c in shared.items()},
        }
    )
    anchors = fx.Anchors(keys, "_present", shared)

    names = [f"_m{i}" for i in range(len(rules) + len(keywords))]
    column = f"`{text}`"
    matches = [fx.rule_match(column, r, anchors) for r in rules]
    matches += [fx.keyword_match(column, keys, k, anchors) for k in keywords]
    found = dict(zip(names, matches))
    df = df.withColumns(found)

    df = df.withColumn("_signals", fx.signals_in_order(names, rules, keywords))
    df = df.drop("_present", *shared.values(), *names, *(keys if own_keys else ()))
    return fence(df, ["_signals"])


def injection_signals(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    keywords: Sequence[Keyword] = KEYWORDS,
) -> DataFrame:
    """One row per signal, in order within the text."""
    found = with_signals(df.select(id_col, text), text, rules, keywords)
    return found.select(id_col, F.posexplode("_signals").alias("ord", "s")).select(
        id_col,
        F.col("s.layer").alias("layer"),
        F.col("s.rule_name").alias("rule_name"),
        F.col("s.description").alias("description"),
        F.col("s.severity").alias("severity"),
        F.col("s.matched").alias("matched"),
        (F.col("ord") + 1).alias("ord"),
    )


def keyword_hits(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    keywords: Sequence[Keyword] = KEYWORDS,
) -> DataFrame:
    """Keyword layer only: one row per text and keyword."""
    return injection_signals(df, id_col, text, (), keywords).drop("layer", "ord")


def rule_prevalence(
    df: DataFrame,
    by: Sequence[str] = (),
    text: str = "text",
) -> DataFrame:
    """Texts per rule and severity, and per any columns of the text table."""
    found = with_signals(df.select(*dict.fromkeys([*by, text])), text)
    rows = found.select(*by, F.explode("_signals").alias("s"))
    return rows.groupBy(
        *by, F.col("s.rule_name").alias("rule_name"), F.col("s.severity").alias("severity")
    ).agg(F.count("*").alias("texts"))


def max_severity(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Highest severity rank per text; 0 where nothing fired."""
    found = with_signals(df.select(id_col, text), text)
    return found.select(id_col, fx.max_severity(F.col("_signals")).alias("max_severity"))


def rule_cooccurrence(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts in which two rules fire together, and how much oftener than by chance.

    One row per pair ``rule_a < rule_b`` that occurs: texts, texts_a, texts_b, lift.  Pairs come
    from the distinct rule names of a row, so no table is joined with itself; single rules and all
    texts are counted in the same pass.  A text without findings counts in the total only.
    """
    found = with_signals(df.select(text), text)
    names = F.array_sort(F.array_distinct(F.transform("_signals", lambda s: s["rule_name"])))
    # The total has no names, a single rule is a pair with itself.
    total = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    pairs = F.flatten(
        F.transform(
            "_names",
            lambda a, i: F.transform(
                F.filter("_names", lambda _, j: j >= i), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    counted = (
        found.select(names.alias("_names"))
        .select(F.explode(F.concat(total, pairs)).alias("p"))
        .groupBy("p.a", "p.b")
        .agg(F.count("*").alias("n"))
    )
    # All counts in one row: the number of rules bounds them.
    entry = F.struct(F.struct("a", "b").alias("key"), F.col("n").alias("value"))
    table = counted.agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))

    def count_of(a, b):
        return F.element_at("counts", F.struct(a.alias("a"), b.alias("b")))

    a, b = F.col("key.a"), F.col("key.b")
    n, n_a, n_b = F.col("value"), count_of(a, a), count_of(b, b)
    everything = count_of(F.lit(""), F.lit(""))
    return (
        table.select("counts", F.explode("counts"))
        .filter("key.a < key.b AND key.a <> ''")
        .select(
            a.alias("rule_a"),
            b.alias("rule_b"),
            n.alias("texts"),
            n_a.alias("texts_a"),
            n_b.alias("texts_b"),
            (n * everything / (n_a * n_b)).alias("lift"),
        )
    )
