"""Near-duplicate classes of families: pivots meet members in cells, not in pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptward.llm import near
from promptward.llm.components import components, merged


def _family(seed: int, n: int, words: int, most: float) -> list[str]:
    """Copies of one text with up to ``most`` of its words changed."""
    draw = random.Random(seed)
    base = [f"w{seed}x{draw.randrange(10**6)}" for _ in range(words)]
    return [
        " ".join(f"n{draw.randrange(10**9)}" if draw.random() < rate else w for w in base)
        for rate in (draw.uniform(0, most) for _ in range(n))
    ]


def _classes(pairs, nodes) -> dict:
    label = {x: x for x in nodes}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        label[b] = a
    return {x: top(x) for x in nodes}


def _expected(texts: dict[int, str], weights) -> dict[int, int]:
    """Components of all pairs that share a band and are similar."""
    sets = {i: near.weighted_set(t.encode(), weights) for i, t in texts.items()}
    starts = np.cumsum([0, *(len(s[0]) for s in sets.values())])[:-1]
    samples = near.Sampler().sample(*(np.concatenate(x) for x in zip(*sets.values())), starts)
    bands = dict(zip(sets, near.band_hashes(samples)))
    links = [
        (a, b) for a in sets for b in sets
        if a < b and (bands[a] == bands[b]).any() and near.similarity(sets[a], sets[b]) >= near.SIMILARITY
    ]
    return _classes(links, sets)


@pytest.mark.parametrize("block", [near.BLOCK, 1000])
def test_families_make_no_pairs(spark, monkeypatch, block):
    """A family whose members mostly miss 0.8 has the classes of brute force, and few of its pairs are rows."""
    texts = dict(enumerate([*_family(1, 90, 150, 0.06), *_family(2, 60, 100, 0.1), *_family(3, 30, 60, 0.02)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    pairs, plain = [], near._verified

    def counted(some, *args):
        pairs.append(some.count())
        return plain(some, *args)

    monkeypatch.setattr(near, "_verified", counted)
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "MORE_PIVOTS", 4)
    monkeypatch.setattr(near, "GROWTH", 4)
    got = {r.doc_id: r.class_id for r in near.near_duplicates(docs).collect()}
    expected = _expected(texts, near.shingle_weights(docs, "text"))
    assert got == expected and len(set(got.values())) > 10
    assert sum(pairs) <= 3 * len(texts)


def test_cell_tells_covers_joins_and_foreign_pivots():
    def texts(names):
        return [(n.encode(), n.encode(), (np.array(h, dtype=np.uint64), np.ones(len(h)))) for n, h in names]

    ten = list(range(10))
    pivots = texts([("p", ten), ("q", [*range(3, 13)])])
    members = texts([("m", [*ten[:9], 50]), ("n", [*range(3, 12), 60]), ("o", [*range(100, 110)]), ("p", ten)])
    whole = {(k, p): round(s, 4) for k, p, s in near._cell(pivots, members, 0.8, True)}
    assert whole == {(b"m", b"p"): 0.8182, (b"n", b"q"): 0.8182}
    # 7 of 13 words in common: below 0.6, so neither pivot reaches the other's member.
    close = texts([("p", ten), ("q", [*range(2, 12)])])
    members = texts([("m", [*ten[:9], 50]), ("n", [*range(2, 11), 60])])
    rows = {(k, p) for k, p, _ in near._cell(close, members, 0.8, True)}
    assert rows == {(b"m", b"p"), (b"n", b"q")} | {
        (k, p) for k, p, s in near._cell(close, members, 0.8, False) if 0.8 + 9 / 11 - 1 <= s
    }


def test_merged_labels_are_those_of_all_links(spark):
    draw = random.Random(5)
    links = [tuple(sorted(draw.sample(range(200), 2))) for _ in range(120)]
    table = lambda some: spark.createDataFrame(some, "a LONG, b LONG")
    labels = components(table(links[:60]))
    for part in (links[60:90], links[90:], links[:5]):
        labels = merged(labels, table(part))
    nodes = {x for pair in links for x in pair}
    assert {r.node: r.label for r in labels.select("node", F.col("label")).collect()} == _classes(links, nodes)


def test_a_round_of_components_has_two_joins(spark, monkeypatch):
    from promptward.llm import components as module

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    links = spark.createDataFrame(chain, "a LONG, b LONG")
    joins, names = [], []
    join, write = type(links).join, module.written
    monkeypatch.setattr(type(links), "join", lambda *args, **kw: joins.append(1) or join(*args, **kw))
    monkeypatch.setattr(module, "written", lambda df, name: names.append(name) or write(df, name))
    labels = module.components(links)
    assert labels.columns == ["node", "label"]
    assert {r.node: r.label for r in labels.collect()} == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    rounds = (names.count("labels") - 1) // 2
    assert rounds > 2 and len(joins) == 2 * rounds
