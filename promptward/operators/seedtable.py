"""Similarity to a table of seed texts of any size.

The in-row form of ``operators.similarity`` writes its seeds into the expression, which
suits the few built-in ones.  Here seeds are a table, and only pairs whose cosine can reach the
threshold are ever looked at:

* words are put in order of the number of seeds that hold them, rarest first;
* of a text only the words that some seed holds travel, and a text whose other words
  weigh too much cannot reach the threshold at all (most texts end here);
* of the rest, a word is looked up only while it and the words after it weigh enough: two
  texts that reach the threshold share such a word (prefix filter);
* pairs whose sums and largest weights cannot give the threshold go before they are
  summed (length filter);
* the words that both sides look up give their part of the product in that same join.  Only the few
  words left over are added afterwards, for pairs that can still reach the threshold.

Weights are integers as in the in-row form, so both give the same scores.  Equal texts are
compared once.  Nothing is broadcast by hint, and a word that many texts look up is dealt
to ``SALTS`` keys.  Null texts and texts without words are similar to nothing; repeated rows
each get theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptward.functions.fence import fence
from promptward.functions.similarity import squared_norm
from promptward.rules import BOOST_FACTOR, BOOST_TERMS, DEFAULT_THRESHOLD, STOPWORDS
from promptward.sources.folders import stored

SALTS = 8
#: Relative error that the filters allow for; scores are doubles.
SLACK = 1e-9


def _words(text: Column) -> Column:
    stop = [F.lit(w) for w in STOPWORDS]
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def _weight(word: str, times: str) -> Column:
    boosted = F.col(word).isin(*BOOST_TERMS)
    return (F.col(times) * F.when(boosted, F.lit(BOOST_FACTOR)).otherwise(F.lit(1))).cast("bigint")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """``keys``, squared norm and word of every word of every text, with repeats."""
    # Fenced: the norm of a text is computed once, not once for each of its words.
    words = fence(df.select(*keys, _words(F.col("text")).alias("words")), ["words"]).filter(F.size("words") > 0)
    words = fence(words.withColumn("norm2", F.expr(squared_norm("words"))), ["words", "norm2"])
    return words.select(*keys, "norm2", F.explode("words").alias("word"))


def _ranked(terms: DataFrame, key: str, threshold: float) -> DataFrame:
    """Add what the filters need: ``lookup``, ``mass``, ``total`` and ``largest`` of the text.

    ``mass`` is the squared weight of all words that seeds hold, and a word is looked up
    if the part of it from that word on reaches the threshold; ``rest`` is that of the others.
    """
    whole = Window.partitionBy(key)
    onwards = whole.orderBy("seeds", "word").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    square = F.col("weight") * F.col("weight")
    least = threshold * threshold * (1 - SLACK)
    return (
        terms.withColumn("mass", F.sum(square).over(whole))
        .filter(F.col("mass") >= F.col("norm2") * least)
        .withColumn("lookup", F.sum(square).over(onwards) >= F.col("norm2") * least)
        .withColumn("rest", F.sum(F.when(~F.col("lookup"), square).otherwise(0)).over(whole))
        .withColumn("total", F.sum("weight").over(whole))
        .withColumn("largest", F.max("weight").over(whole))
    )


def _seed_terms(seeds: DataFrame, seed_col: str, text: str) -> DataFrame:
    """side (number of a seed and text), seed, norm2, word, weight and the number of seeds that hold the word."""
    given = seeds.select(F.col(seed_col).alias("seed"), F.col(text).alias("text")).distinct()
    # Numbered as they are read back, so that a task that runs again gives the same numbers.
    given = stored(given, "seeds").withColumn("side", F.monotonically_increasing_id())
    counted = _spread(given, "side", "seed").groupBy("side", "seed", "norm2", "word").agg(F.count("*").alias("times"))
    held = counted.groupBy("word").agg(F.count("*").alias("seeds"))
    weight = _weight("word", "times").alias("weight")
    return counted.join(held, "word").select("side", "seed", "norm2", "word", weight, "seeds")


def seed_pairs(
    df: DataFrame,
    seeds: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seed_col: str = "item_id",
    seed_text: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """All pairs of a text and a seed whose cosine is ``threshold`` or more: id, seed, score.

    ``threshold`` is above 0.  Rows of ``seeds`` with one id and different texts are one
    seed each; a pair shows the better one.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    wanted = stored(_seed_terms(seeds, seed_col, seed_text), "seed-terms")
    vocabulary = wanted.select("word", "seeds").distinct()

    body = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    body = body.withColumn("key", F.md5("text")).withColumn("row", F.monotonically_increasing_id())
    terms = (
        _spread(body, "row", "id", "key")
        .join(vocabulary, "word")
        .groupBy("row", "id", "key", "norm2", "word", "seeds")
        .agg(F.count("*").alias("times"))
        .withColumn("weight", _weight("word", "times"))
        .drop("times")
    )
    near = stored(_ranked(terms, "row", threshold), "near-terms")

    # Equal texts are one from here on, under the number of the first row that has them.
    one = near.groupBy("key").agg(F.min("row").alias("row"))
    texts = stored(near.join(one, ["key", "row"], "left_semi").drop("key", "id"), "texts")
    other = _ranked(wanted, "side", threshold).select(
        "side",
        "word",
        "lookup",
        *[F.col(c).alias(f"{c}_s") for c in ("norm2", "weight", "total", "largest", "rest")],
    )

    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    asked = texts.filter("lookup").drop("lookup", "mass", "seeds").withColumn("salt", salt)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    kept = other.filter("lookup").drop("lookup").select("*", salts)
    norms = F.sqrt(F.col("norm2").cast("double")) * F.sqrt(F.col("norm2_s").cast("double"))
    reach = norms * (threshold * (1 - SLACK))
    # Words are looked up in one order on both sides, so what is left over lies in the rest of the text or in
    # the rest of the seed, whichever begins first.
    left = F.greatest(
        F.sqrt(F.col("rest").cast("double")) * F.sqrt(F.col("norm2_s").cast("double")),
        F.sqrt(F.col("rest_s").cast("double")) * F.sqrt(F.col("norm2").cast("double")),
    )
    product = F.col("weight") * F.col("weight_s")
    pair = ["row", "side", "norm2", "norm2_s"]
    part = (
        asked.join(kept, ["word", "salt"])
        .filter((F.col("total") * F.col("largest_s") >= reach) & (F.col("total_s") * F.col("largest") >= reach))
        .groupBy(*pair, "rest", "rest_s")
        .agg(F.sum(product).alias("dot"))
        .filter(F.col("dot") + left >= reach)
    )
    part = stored(part.select(*pair, "dot"), "near-pairs")
    pairs = part.select(*pair)
    of_text = texts.select("row", "word", "weight", "lookup")
    of_seed = other.select("side", "word", "weight_s", "lookup")
    rest_of_text = pairs.join(of_text.filter(~F.col("lookup")), "row").join(of_seed.drop("lookup"), ["side", "word"])
    rest_of_seed = pairs.join(of_seed.filter(~F.col("lookup")), "side").join(
        of_text.filter("lookup").drop("lookup"), ["row", "word"]
    )
    found = (
        part.unionByName(rest_of_text.select(*pair, product.alias("dot")))
        .unionByName(rest_of_seed.select(*pair, product.alias("dot")))
        .groupBy(*pair)
        .agg(F.sum("dot").alias("dot"))
        .select("row", "side", (F.col("dot") / norms).alias("score"))
        .filter(F.col("score") >= threshold)
        .join(wanted.select("side", "seed").distinct(), "side")
        .groupBy("row", "seed")
        .agg(F.max("score").alias("score"))
    )
    owners = near.select("key", "row", "id").distinct().select("key", "id").join(one, "key")
    return owners.join(found, "row").select(F.col("id").alias(id_col), F.col("seed").alias(seed_col), "score")


def seed_table_check(
    df: DataFrame,
    seeds: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    seed_col: str = "item_id",
    seed_text: str = "text",
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """The best seed of every text that reaches the threshold with one; of equal scores the smaller seed."""
    pairs = seed_pairs(df, seeds, id_col, text, seed_col, seed_text, threshold)
    best = F.min(F.struct((-F.col("score")).alias("below"), F.col(seed_col).alias("seed"))).alias("best")
    return pairs.groupBy(id_col).agg(best).select(
        id_col, F.col("best.seed").alias(seed_col), (-F.col("best.below")).alias("score")
    )
