"""Packing, ranked search and collocations against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from promptward.llm import collocations as col
from promptward.llm import lexical, packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None,
    "",
    " ",
    "\t\n\x0b",
    "a",
    "<|endoftext|> in the text <|endoftext|>",
    "x" * 4000 + " " * 3000 + "y",
    "naïve Größe ΟΔΟΣ 数据 \U0001f600" * 3,
    "It's, we'll: they've 12345 3.14\r\n\r\n  end ",
]


def corpus(n: int, seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Common", "common", "of", "the"]
    out = list(ODD)
    for _ in range(n):
        k = rng.choice([1, 3, 20, 80, 300, 2600])
        out.append(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(k)))
    return out + out[-6:]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i % 3, ["en", "de", None][i % 3]) for i, t in enumerate(corpus(120))]
    rows += [rows[20], (None, "the common of the w1", 0, "en")]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, rank INT, lang STRING").repartition(5)


# --- packing -------------------------------------------------------------------------


def test_ids_equal_the_library():
    tool, mine = Tokenizer.from_file(VOCABULARY), packing.encoder(VOCABULARY)
    for text in corpus(30):
        assert mine.ids(text or "").tolist() == tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("bucket", [200_000, 7])
def test_pack(spark, docs, bucket, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    tool = Tokenizer.from_file(VOCABULARY)
    placed = packing.pack(docs, VOCABULARY)
    rows = placed.toPandas()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tool.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(r.doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    keys = rows[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(rows.notna(), None)
    got = Counter((None if r[0] is None else int(r[0]), *map(int, r[1:])) for r in keys.itertuples(index=False))
    assert got == want
    total = 0
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        ends = (part.offset + part.length).tolist()
        assert part.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
        total += 1
    assert total <= math.ceil(rows.length.sum() / 2048) + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(list(enumerate(corpus(30))), "doc_id BIGINT, text STRING").dropDuplicates(["doc_id"])
    placed = packing.pack(docs, VOCABULARY, capacity=256)
    tool = packing.encoder(VOCABULARY)
    texts = {r.doc_id: np.append(tool.ids(r.text or ""), 0) for r in docs.collect()}
    starts = {(r.doc_id, r.piece): r.start for r in placed.collect()}
    seen = 0
    for r in packing.sequences(docs, placed, VOCABULARY).collect():
        assert len(r.ids) <= 256
        for d in r.documents:
            a = starts[d.doc_id, d.piece]
            assert r.ids[d.offset : d.offset + d.length] == texts[d.doc_id][a : a + d.length].tolist()
            seen += d.length
    assert seen == sum(map(len, texts.values()))


@pytest.mark.parametrize("seed", range(6))
def test_genetic_steps_keep_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = dict(Counter(rng.integers(20, 90, 400).tolist()))

    def sound(packed):
        held = Counter()
        for pattern, times in packed.items():
            assert packing.used(pattern) <= 100 and times > 0
            for s, c in pattern:
                held[s] += c * times
        return held == counts

    one, two = packing.first_fit(counts, 100), packing.first_fit(counts, 100, rng)
    child = packing.crossover(one, two, counts, 100, rng)
    assert sound(one) and sound(two) and sound(child) and sound(packing.mutate(child, counts, 100, rng))
    found = packing.evolve([one, two], counts, 100, 30, seed)
    bins = [packing.quality(p, 100)[0] for p in found]
    assert all(map(sound, found)) and bins[0] <= packing.quality(one, 100)[0]
    assert bins[0] >= packing.lower_bound(counts, 100)


def test_evolution_beats_first_fit(spark):
    """Three pieces fill a bin exactly, but first fit puts the longest together wrongly."""
    counts = {44: 30, 33: 30, 23: 30, 52: 20, 29: 20, 19: 20}
    first = packing.quality(packing.first_fit(counts, 100), 100)[0]
    best = packing.quality(packing.best_packing(spark, counts, 100), 100)[0]
    assert packing.lower_bound(counts, 100) <= best <= first


def test_pack_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id BIGINT, text STRING")
    assert packing.pack(none, VOCABULARY).count() == 0


# --- search --------------------------------------------------------------------------


def brute_search(rows, items, top=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    texts = [(i, terms(t)) for i, t in rows]
    texts = [(i, w) for i, w in texts if w]
    n_docs, words = len(texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in set(items):
        asked, scored = set(terms(text)), []
        for i, w in texts:
            times, m = Counter(w), 10 + (90 * len(w) * n_docs) // words
            score = 0
            for t in asked & times.keys():
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += weight * (1_000_000_000 * times[t] // (1000 * times[t] + 8 * m))
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        for r, (s, i) in enumerate(sorted(scored)[:top], 1):
            out.append((item, r, None if i == math.inf else i, -s))
    return sorted(out, key=str)


ITEMS = [
    (1, "the common of w1 w2 w3"),
    (2, "W7 w7 w8, w9; nowhere"),
    (3, "ΟΔΟΣ größe NAÏVE"),
    (4, None),
    (5, "... !"),
    (6, "nowhere"),
    (None, "w5 w6"),
    (2, "w30 w31"),
    (1, "the common of w1 w2 w3"),
]


@pytest.mark.parametrize("tree,leaf,block", [(8192, 48, 4 << 20), (16, 2, 40), (37, 5, 4 << 20)])
def test_search(spark, docs, tree, leaf, block, monkeypatch):
    monkeypatch.setattr(lexical, "TREE", tree)
    monkeypatch.setattr(lexical, "LEAF", leaf)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id INT, text STRING, doc_id STRING")
    got = lexical.search(docs, items, block_bytes=block).collect()
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    # Equal rows of one id tie; both are there.
    assert sorted(map(tuple, got), key=str) == want


def test_bounds_hold():
    """No document of a ball scores above the bound of the ball."""
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 12, 500)
    terms = np.concatenate([np.sort(rng.choice(60, s, replace=False)) for s in sizes])
    values = rng.integers(1, 1_000_000, len(terms))
    tree = lexical.BallTree(np.arange(500), sizes, terms, values, 60)
    for _ in range(40):
        query = np.sort(rng.choice(60, 8, replace=False))
        dense = np.zeros(60, dtype=np.int64)
        dense[query] = rng.integers(0, 20_000, 8)
        best: list = []
        tree.search(query, dense[query], dense, best, 10)
        scores = np.add.reduceat(tree.values * dense[tree.terms], tree.starts[:-1])
        want = sorted(((int(s), -int(i)) for s, i in zip(scores, tree.ids) if s > 0), reverse=True)[:10]
        assert sorted(best, reverse=True) == want


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id INT, text STRING")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


# --- collocations --------------------------------------------------------------------


def brute_phrases(rows, at_least, top):
    counts, n = {}, Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = counts.setdefault(lang or "und", Counter())
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        often = {p: a for p, a in own.items() if a >= at_least}
        scored = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            holders = (
                a2 >= a
                for q, a2 in often.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if any(holders):
                continue
            cuts = [(1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(
    "at_least,top,tile,chunk,sent,part",
    [(4, 2000, 512, 4 << 20, 1 << 20, 1 << 20), (2, 7, 4, 3000, 0, 5000), (100, 50, 16, 9000, 20, 20_000)],
)
def test_collocations(spark, docs, at_least, top, tile, chunk, sent, part, monkeypatch):
    monkeypatch.setattr(col, "PART", part)
    monkeypatch.setattr(col, "TOGETHER", 4 if part < 9000 else 1 << 12)
    monkeypatch.setattr(col, "TILE", tile)
    monkeypatch.setattr(col, "SENT", sent)
    monkeypatch.setattr(col, "CHUNK", chunk)
    repeated = [("a a a a a a b. a a b, a b c d e f", "en")] * 30 + [("x y z z Z", None)] * 9
    rows = [(r.text, r.lang) for r in docs.collect()] + repeated
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "text STRING, lang STRING, score INT, phrase STRING")
    got = col.collocations(table.repartition(3), at_least=at_least, top=top).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, at_least, top)


def test_tiles_count_exactly():
    rng = np.random.default_rng(2)
    left, right = np.minimum(rng.geometric(0.01, (2, 200_000)), 1999)
    keys = left * 2000 + right
    found, counts, place = col.tiled(keys, 2000)
    want = Counter(keys.tolist())
    assert dict(zip(found.tolist(), counts.tolist())) == want and (found[place] == keys).all()


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F

    values = [(10**13 + 7, 10**13 + 9, 3, 10**14 - 1), (123_456_789_012, 5 * 10**12, 10**13, 9 * 10**13)]
    rows = spark.createDataFrame(values, "a BIGINT, l BIGINT, r BIGINT, n BIGINT")
    got = [r[0] for r in rows.select(col._score(F.col("a"), F.col("l"), F.col("r"), F.col("n"))).collect()]
    want = [1000 * a * n // (l * r) for a, l, r, n in values]
    assert got == want


def test_collocations_of_nothing(spark, docs):
    assert col.collocations(docs.limit(0)).count() == 0
    assert col.collocations(docs.filter("text = 'a'")).count() == 0
