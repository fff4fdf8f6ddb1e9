"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is ``WINDOW`` consecutive words.  Its fingerprint is the least hash of the
``GRAM``-word grams in it, so two equal windows have equal fingerprints: every
shared span of ``WINDOW`` words is found.  Neighbouring windows mostly share their
fingerprint and travel as one run.  Runs are joined with the fingerprints of the
benchmark; the runs that meet one are then read again, word by word, and their windows are
compared as text, which removes false hits and extends the others to the whole shared
span.  Items shorter than a window are one window of their own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.functions.fence import fence
from promptward.llm.common import digest, text_or_empty, unused, written

WINDOW = 10
GRAM = 5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_NO_WORD_OF_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def exact_words(text: str) -> Column:
    """Words of a text with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text_or_empty(text), _UPPER, _UPPER.lower()), _NO_WORD), "")


def folded_words(text: str) -> Column:
    """As many words in full lower case, each by itself; equal ``exact_words`` are equal here too, and this is faster."""
    return F.transform(F.array_remove(F.split(text_or_empty(text), _NO_WORD_OF_ANY_CASE), ""), F.lower)


def _joined(values: Column, i: Column, n: int) -> list[Column]:
    return [F.get(values, i + k) for k in range(n)]


def _with_runs(df: DataFrame, words: str) -> DataFrame:
    """Add ``runs``: first and last window start and fingerprint of each run of windows."""
    n = F.size(words)
    df = fence(df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w))), ["_h"])
    grams = F.transform(
        F.slice("_h", 1, F.greatest(F.size("_h") - (GRAM - 1), F.lit(0))),
        lambda _, i: F.xxhash64(*_joined(F.col("_h"), i, GRAM)),
    )
    df = fence(df.withColumn("_g", grams), ["_g"])
    span = WINDOW - GRAM + 1
    least = F.transform(
        F.slice("_g", 1, F.greatest(F.size("_g") - (span - 1), F.lit(0))),
        lambda _, i: F.least(*_joined(F.col("_g"), i, span)),
    )
    df = fence(df.withColumn("_m", least), ["_m"])
    starts = F.filter(
        F.transform(
            "_m",
            lambda m, i: F.when(
                (i == 0) | (F.get(F.col("_m"), i - 1) != m), F.struct(m.alias("print"), i.alias("first"))
            ),
        ),
        lambda x: x.isNotNull(),
    )
    df = fence(df.withColumn("_s", starts).withColumn("_windows", F.greatest(n - (WINDOW - 1), F.lit(0))), ["_s"])
    runs = F.transform(
        "_s",
        lambda x, i: F.struct(
            x["print"].alias("print"),
            x["first"].alias("first"),
            (F.coalesce(F.get(F.col("_s"), i + 1)["first"], F.col("_windows")) - 1).alias("last"),
            F.lit(WINDOW).alias("length"),
        ),
    )
    return df.withColumn("runs", runs).drop("_h", "_g", "_m", "_s", "_windows")


def _short_runs(words: str, length: int) -> Column:
    """All grams of ``length`` words as runs of one window each."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - (length - 1), F.lit(0)))
    return F.transform(
        heads,
        lambda _, i: F.struct(
            F.xxhash64(F.lit(length), *_joined(F.col(words), i, length)).alias("print"),
            i.alias("first"),
            i.alias("last"),
            F.lit(length).alias("length"),
        ),
    )


def _window_text(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _item_windows(items: DataFrame, item_col: str, text: str) -> DataFrame:
    """Every window of every item: item, length, window (text) and print."""
    base = items.select(
        F.col(item_col).cast("string").alias("item"),
        exact_words(text).alias("words"),
        folded_words(text).alias("folded"),
    ).filter(F.size("words") > 0)
    long = _with_runs(base.filter(F.size("words") >= WINDOW), "folded")
    long = long.select("item", "words", F.inline("runs")).select(
        "item", "words", "length", "print", F.explode(F.sequence("first", "last")).alias("start")
    )
    short = base.filter(F.size("words") < WINDOW)
    prints = reduce(
        lambda other, n: F.when(
            F.size("words") == n, F.xxhash64(F.lit(n), *_joined(F.col("folded"), F.lit(0), n))
        ).otherwise(other),
        range(1, WINDOW),
        F.lit(None).cast("bigint"),
    )
    short = short.select(
        "item", "words", F.size("words").alias("length"), prints.alias("print"), F.lit(0).alias("start")
    )
    return (
        long.unionByName(short)
        .select("item", "length", "print", _window_text("words", F.col("start"), F.col("length")).alias("window"))
        .distinct()
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, key, n_words, n_hit, spans, items.

    ``key`` is the digest of the text, ``spans`` the shared windows as (start, end)
    in words, ``items`` the ids of the items they come from, sorted as strings.  A
    null or wordless text has no words and no hits; an item without words has no
    window.  Windows of an item without an id count as hits but name no item; rows
    that share an item id are one item.  Repeated rows of ``docs`` each get their
    row; other columns are ignored.  Empty tables give no rows or no hits.
    """
    windows = written(_item_windows(items, item_col, item_text), "item-windows")
    lengths = [r["length"] for r in windows.filter(F.col("length") < WINDOW).select("length").distinct().collect()]

    base = docs.select(
        F.col(id_col).alias("id"), digest(text_or_empty(text)).alias("key"), folded_words(text).alias("words")
    )
    found = _with_runs(fence(base, ["words"]), "words")
    runs = [F.col("runs"), *[_short_runs("words", n) for n in sorted(lengths)]]
    prints = written(
        found.select("id", "key", F.size("words").cast("bigint").alias("n_words"), F.concat(*runs).alias("runs")),
        "prints",
    )

    met = (
        prints.select("id", "key", F.inline("runs"))
        .join(windows.select("print", "length").distinct(), ["print", "length"], "left_semi")
        .groupBy("key")
        .agg(F.min("id").alias("of"), F.collect_set(F.struct("first", "last", "length")).alias("runs"))
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).withColumn(
        "key", digest(text_or_empty("text"))
    )
    # Both sides grow with the corpus, so they are shuffled at every size.
    # One copy of each text is read again; its id is part of the join key, so copies meet nowhere.
    one = written(met, "met").hint("merge").alias("m")
    same = (F.col("t.key") == F.col("m.key")) & F.col("t.id").eqNullSafe(F.col("m.of"))
    read = texts.alias("t").join(one, same).select("m.key", "runs", exact_words("text").alias("words"))
    read = fence(read, ["words"])
    tried = (
        read.select("key", "words", F.inline("runs"))
        .select("key", "words", "length", F.explode(F.sequence("first", "last")).alias("start"))
        .select(
            "key", "start", "length", _window_text("words", F.col("start"), F.col("length")).alias("window")
        )
    )
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.col("length")).alias("end"))
    hits = (
        tried.join(windows.select("item", "length", "window").distinct(), ["length", "window"])
        .groupBy("key")
        .agg(
            F.sort_array(F.collect_set(span)).alias("spans"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )["n"]
    hits = hits.withColumn("n_hit", covered.cast("bigint"))
    return prints.select("id", "key", "n_words").join(hits.hint("merge"), "key", "left").select(
        F.col("id").alias(id_col),
        "key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    hit = contamination(docs, items, id_col, text).filter("n_hit > 0").select("key").distinct()
    key = unused(docs, "text_digest")
    hit = written(hit.withColumnRenamed("key", key), "hit")
    return docs.withColumn(key, digest(text_or_empty(text))).join(hit.hint("merge"), key, "left_anti").select(*docs.columns)
