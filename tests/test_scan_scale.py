"""Scores of texts with repeated words."""

from __future__ import annotations

import math
import re
from collections import Counter

from promptward.functions.similarity import builtin_seeds, term_weight
from promptward.operators.similarity import seed_similarity
from promptward.rules import STOPWORDS

TEXTS = [
    "ignore ignore ignore the the prompt, prompt! a b 7 77 77",
    "system " * 3000 + "x " * 50 + "reveal",
    "prompts prompt prompt1 1prompt prompt",
    "the and of",
    "",
    None,
    "é now é NOW now\tdan Dan",
]


def _scores(text):
    words = [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if len(w) > 1 and w not in STOPWORDS]
    weights = {w: n * term_weight(w) for w, n in Counter(words).items()}
    norm = math.sqrt(sum(v * v for v in weights.values()))
    dots = {s.label: sum(v * s.weights.get(w, 0) for w, v in weights.items()) for s in builtin_seeds()}
    return {s.label: dots[s.label] / (norm * math.sqrt(s.norm2)) if dots[s.label] else 0.0 for s in builtin_seeds()}


def test_repeated_words_are_counted_without_a_fold_over_words(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id BIGINT, text STRING")
    scored = seed_similarity(docs)
    assert "aggregate(sort_array" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.seed): r.score for r in scored.collect()}
    for i, text in enumerate(TEXTS):
        for label, score in _scores(text).items():
            assert math.isclose(got[i, label], score, rel_tol=1e-12, abs_tol=0), (i, label)
