"""Weighted term-frequency cosine similarity to attack seeds, inside the row.

A text is compared without leaving its row: no token is ever shuffled, so a
corpus costs one pass whatever its size, and the same expression works on streams.
All weights are integers, so dot products and squared norms are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptward.functions.arrays import bind
from promptward.functions.keys import TextKeys
from promptward.functions.patterns import LOWER_ALNUM
from promptward.functions.scalars import sql_str, three_decimals
from promptward.rules import BOOST_FACTOR, BOOST_TERMS, DEFAULT_THRESHOLD, SEEDS, STOPWORDS


class Seed(NamedTuple):
    label: str
    weights: dict[str, int]

    @property
    def norm2(self) -> int:
        return sum(w * w for w in self.weights.values())


def term_weight(token: str) -> int:
    return BOOST_FACTOR if token in BOOST_TERMS else 1


def seed_of(label: str, text: str) -> Seed:
    words = [w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) > 1 and w not in STOPWORDS]
    return Seed(label, {w: n * term_weight(w) for w, n in Counter(words).items()})


def builtin_seeds() -> tuple[Seed, ...]:
    return tuple(seed_of(label, text) for label, text in SEEDS.items())


def _in(word: str, words: Iterable[str]) -> str:
    return f"{word} IN ({', '.join(sql_str(w) for w in words)})"


def shared_words(keys: TextKeys, seeds: tuple[Seed, ...]) -> Column:
    """The distinct tokens of a text that any seed has; tokens are words of two or more characters and no stopwords."""
    return F.expr(f"array_intersect({keys.distinct}, {_array(filter(_is_token, vocabulary(seeds)))})")


def repeated_words(keys: TextKeys, shared: str) -> Column:
    """``array<struct<word, n>>``: the tokens that a text holds more than once, with their number.

    Empty where ``shared`` is: the score is zero then, whatever else the text holds.  Equal words are
    side by side once sorted, and a regex finds runs of them at a fraction of what a fold over all words takes.
    """
    runs = f"regexp_extract_all(array_join(sort_array({keys.words}), ' '), {sql_str(RUN)}, 0)"
    return F.expr(
        f"""IF(size({shared}) > 0,
               filter(
                   transform(
                       transform({runs}, r -> named_struct('word', substring_index(r, ' ', 1), 'size', length(r))),
                       r -> named_struct('word', r.word, 'n', (r.size + 1) DIV (length(r.word) + 1))),
                   r -> length(r.word) > 1 AND NOT {_in('r.word', STOPWORDS)}),
               CAST(array() AS array<struct<word:string,n:bigint>>))"""
    )


#: Two or more equal words in a row, among words joined by single blanks.
RUN = f"(?<![{LOWER_ALNUM}])([{LOWER_ALNUM}]++)(?: \\1(?![{LOWER_ALNUM}]))++"


def _is_token(word: str) -> bool:
    return len(word) > 1 and word not in STOPWORDS


def _array(words: Iterable[str]) -> str:
    return f"CAST(array({', '.join(sql_str(w) for w in words)}) AS array<string>)"


def tokens_norm(keys: TextKeys, repeated: str) -> str:
    """Sum over distinct tokens of (count x weight)^2: all of them once, and what the repeated ones add."""
    others = _array(("", *LOWER_ALNUM, *STOPWORDS))
    boosted = _array(filter(_is_token, BOOST_TERMS))
    more = BOOST_FACTOR * BOOST_FACTOR
    return f"""
        CAST(size(array_except({keys.distinct}, {others})) AS BIGINT)
        + {more - 1}L * size(array_intersect({keys.distinct}, {boosted}))
        + aggregate({repeated}, 0L,
                    (total, r) -> total + (r.n * r.n - 1L) * IF({_in('r.word', BOOST_TERMS)}, {more}L, 1L))"""


def vocabulary(seeds: tuple[Seed, ...]) -> list[str]:
    return sorted({w for s in seeds for w in s.weights})


def squared_norm(words: str) -> str:
    """Sum over distinct words of (count x weight)^2, by run lengths of the sorted words."""
    ended = (
        f"run.done + run.n * run.n * IF({_in('run.word', BOOST_TERMS)}, {BOOST_FACTOR * BOOST_FACTOR}L, 1L)"
    )
    return f"""
        aggregate(
            sort_array({words}),
            named_struct('word', '', 'n', 0L, 'done', 0L),
            (run, w) -> IF(run.word = w,
                           named_struct('word', w, 'n', run.n + 1L, 'done', run.done),
                           named_struct('word', w, 'n', 1L, 'done', {ended})),
            run -> {ended})"""


def seed_scores(keys: TextKeys, shared: str, repeated: str, seeds: tuple[Seed, ...]) -> Column:
    """``array<struct<seed_ord, seed, score>>`` with one element per seed.

    ``shared`` and ``repeated`` name the columns of ``shared_words`` and ``repeated_words``.
    """
    gains = ", ".join(
        f"{sql_str(w)}, array({', '.join(f'{term_weight(w) * s.weights.get(w, 0)}L' for s in seeds)})"
        for w in vocabulary(seeds)
    )
    table = ", ".join(
        f"named_struct('seed_ord', {i}, 'seed', {sql_str(s.label)}, 'norm', sqrt({s.norm2}D))"
        for i, s in enumerate(seeds)
    )
    zeros = ", ".join("0L" for _ in seeds)
    return F.expr(
        f"""
        IF(size({shared}) > 0,
           element_at(transform(
               array(named_struct(
                   'norm', sqrt(CAST({tokens_norm(keys, repeated)} AS DOUBLE)),
                   'dots', aggregate(
                       concat(transform({shared}, w -> named_struct('word', w, 'n', 1L)),
                              transform(filter({repeated}, r -> {_in('r.word', vocabulary(seeds))}),
                                        r -> named_struct('word', r.word, 'n', r.n - 1L))),
                       array({zeros}),
                       (acc, r) -> zip_with(acc, element_at(map({gains}), r.word), (a, g) -> a + r.n * g)))),
               t -> zip_with(array({table}), t.dots, (s, dot) -> named_struct(
                   'seed_ord', s.seed_ord, 'seed', s.seed,
                   'score', IF(dot > 0, dot / (t.norm * s.norm), 0D)))), 1),
           transform(array({table}), s -> named_struct(
               'seed_ord', s.seed_ord, 'seed', s.seed, 'score', 0D)))"""
    )


def best_seed(scores: Column) -> Column:
    """``struct<score, label>`` of the best seed; the first wins ties, no score has no label."""
    top = F.array_max(
        F.transform(
            scores,
            lambda s: F.struct(
                s["score"].alias("score"), (-s["seed_ord"]).alias("first"), s["seed"].alias("label")
            ),
        )
    )
    return bind(
        top,
        lambda t: F.struct(
            t["score"].alias("score"),
            F.when(t["score"] > 0, t["label"]).otherwise("").alias("label"),
        ),
    )


def vector_check(best: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Compare the unrounded score with the threshold, then round it for display."""
    return F.struct(
        (best["score"] >= F.lit(float(threshold))).alias("triggered"),
        three_decimals(best["score"]).alias("similarity_score"),
        best["label"].alias("closest_seed"),
    )
