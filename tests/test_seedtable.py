"""Similarity to a table of seeds against the in-row form and a plain definition."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from promptward.functions.similarity import seed_of
from promptward.operators import seedtable
from promptward.operators.evaluation import label_eval
from promptward.operators.injection import rule_cooccurrence
from promptward.operators.pii import pii_density
from promptward.operators.seedtable import seed_pairs, seed_table_check
from promptward.operators.similarity import seed_similarity
from promptward.plans.planted import PLANTED
from promptward.rules import SEEDS


def cosine(a, b):
    dot = sum(n * b.get(w, 0) for w, n in a.items())
    return dot / (math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))) if dot else 0.0


def brute(texts, seeds, threshold):
    seeds = [(i, seed_of("", t or "").weights) for i, t in seeds]
    out = {}
    for d, t in texts:
        own = seed_of("", t or "").weights
        for s, w in seeds:
            score = cosine(own, w)
            if score >= threshold:
                out[d, s] = max(score, out.get((d, s), 0))
    return out


def sample(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["ignore", "system", "instructions", "the", "a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [" ".join(rng.choices(words, weights, k=rng.choice([2, 4, 8, 30]))) for _ in range(n)]


@pytest.mark.parametrize("threshold,salts", [(0.85, 8), (0.5, 1), (0.3, 3), (1.0, 8)])
def test_pairs(spark, threshold, salts, monkeypatch):
    monkeypatch.setattr(seedtable, "SALTS", salts)
    given = sample(120, 1)
    texts = [*enumerate(given), (500, given[0]), (501, None), (502, ""), (503, "the a"), (504, "unknown words only")]
    seeds = [*enumerate(sample(40, 2) + given[3:5]), (900, None), (901, "the"), (902, "..."), (3, "w1 w2")]
    df = spark.createDataFrame(texts, "doc_id INT, text STRING")
    got = seed_pairs(df, spark.createDataFrame(seeds, "item_id INT, text STRING"), threshold=threshold).collect()
    want = brute(texts, seeds, threshold * (1 - 1e-12))
    # At the threshold itself the last bit decides.
    near = {k for k, v in want.items() if abs(v - threshold) < 1e-12}
    found = {(r.doc_id, r.item_id): r.score for r in got}
    assert len(found) == len(got) and set(found) - near == set(want) - near
    assert all(abs(found[k] - want[k]) < 1e-12 for k in found)


def test_equal_to_the_in_row_form(spark):
    """The built-in seeds as a table."""
    texts = spark.createDataFrame([(i, p[1]) for i, p in enumerate(PLANTED)], "doc_id INT, text STRING")
    seeds = spark.createDataFrame(list(SEEDS.items()), "item_id STRING, text STRING")
    got = {(r.doc_id, r.item_id): r.score for r in seed_pairs(texts, seeds, threshold=0.2).collect()}
    in_row = {(r.doc_id, r.seed): r.score for r in seed_similarity(texts).collect() if r.score >= 0.2}
    assert got == in_row and len(got) > 20


def test_best_seed_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "purple elephant"), (1, "purple elephant"), (2, "green tree house"), (3, "x")], "doc_id INT, text STRING")
    seeds = spark.createDataFrame([(9, "purple elephant"), (4, "elephant purple"), (5, "green tree")], "item_id INT, text STRING")
    got = seed_table_check(df, seeds, threshold=0.8).collect()
    assert sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in got) == [(1, 4, 1.0), (2, 5, round(math.sqrt(2 / 3), 9))]
    pairs = seed_pairs(df, seeds, threshold=0.8)
    assert sorted((r.doc_id, r.item_id) for r in pairs.collect()) == [(1, 4), (1, 4), (1, 9), (1, 9), (2, 5)]
    assert seed_pairs(df, seeds.limit(0)).count() == seed_pairs(df.limit(0), seeds).count() == 0
    with pytest.raises(ValueError):
        seed_pairs(df, seeds, threshold=0)


def test_cooccurrence(texts):
    from promptward.operators.injection import injection_signals

    given = [PLANTED[i][1] + " " + PLANTED[(i * 7 + 3) % len(PLANTED)][1] for i in range(len(PLANTED))] + [None, ""]
    df = texts(given)
    names = {}
    for r in injection_signals(df, "id").collect():
        names.setdefault(r.id, set()).add(r.rule_name)
    n = len(given)
    got = {(r.rule_a, r.rule_b): (r.texts, r.texts_a, r.texts_b, r.lift) for r in rule_cooccurrence(df).collect()}
    single = {a: sum(a in s for s in names.values()) for s in names.values() for a in s}
    want = {}
    for a in single:
        for b in single:
            both = sum(a in s and b in s for s in names.values())
            if a < b and both:
                want[a, b] = (both, single[a], single[b], both * n / (single[a] * single[b]))
    assert got == want and len(want) > 5
    assert rule_cooccurrence(texts([])).count() == 0 and rule_cooccurrence(texts(["hello", None])).count() == 0


def test_density(spark):
    rows = [("a@b.co xx", "en", "s1"), ("nothing", "en", "s1"), (None, "en", None), ("10.0.0.1", None, "s2")]
    df = spark.createDataFrame(rows, "text STRING, lang STRING, source STRING")
    got = {(r.level, r.source, r.lang): (r.hits, r.chars, r.per_1000_chars) for r in pii_density(df).collect()}
    assert got[3, None, None] == (2, 24, 2 * 1000 / 24)
    assert got[0, "s1", "en"] == (1, 16, 62.5) and got[0, None, "en"] == (0, 0, 0.0)
    assert got[1, None, None] == (0, 0, 0.0) and got[2, None, None] == (1, 8, 125.0)
    assert len(got) == 1 + 3 + 2 + 3


def test_label_sweep(spark):
    scored = [(1, 0.0), (2, 0.25), (3, 0.5), (4, 1.0), (5, None), (6, 0.9)]
    labels = [(1, 0), (2, 1), (3, 0), (4, 1), (5, 1), (6, None), (7, 1), (3, 1)]
    got = label_eval(
        spark.createDataFrame(scored, "doc_id INT, s DOUBLE"), spark.createDataFrame(labels, "doc_id INT, toxic INT"), "s", cuts=4
    )
    rows = {r.cut: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in got.collect()}
    assert rows == {
        0.0: (3, 2, 0, 0.6, 1.0),
        0.25: (3, 1, 0, 0.75, 1.0),
        0.5: (2, 1, 1, 2 / 3, 2 / 3),
        0.75: (1, 0, 2, 1.0, 1 / 3),
        1.0: (1, 0, 2, 1.0, 1 / 3),
    }


def test_products_are_summed_where_words_meet(spark, monkeypatch):
    """A pair gets its product where its words meet; no text is joined with all its words once per candidate."""
    parts = {}
    keep = seedtable.stored
    monkeypatch.setattr(seedtable, "stored", lambda df, name: parts.setdefault(name, keep(df, name)))
    texts, seeds = [*enumerate(sample(60, 5))], [*enumerate(sample(20, 6))]
    df = spark.createDataFrame(texts, "doc_id INT, text STRING")
    got = seed_pairs(df, spark.createDataFrame(seeds, "item_id INT, text STRING"), threshold=0.2701)
    want = brute(texts, seeds, 0.2701)
    assert {(r.doc_id, r.item_id): r.score for r in got.collect()} == pytest.approx(want)
    # Most of the product of the pairs found is there before anything is joined by pairs.
    weights = lambda t: seed_of("", t).weights
    dot = lambda a, b: sum(n * b.get(w, 0) for w, n in a.items())
    whole = sum(dot(weights(t), weights(s)) for t, s in {(texts[d][1], seeds[i][1]) for d, i in want})
    assert parts["near-pairs"].agg(F.sum("dot")).first()[0] >= 0.8 * whole
