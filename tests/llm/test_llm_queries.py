"""Queries of the training-data operators against DuckDB or plain Python, over the smallest tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from promptward.llm.oracle import ORACLE
from promptward.llm.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


def sha(text) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def rows_of(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, str(SF_DIR)).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    sql = duck.execute(ORACLE[name])
    columns = [d[0] for d in sql.description]
    got = QUERIES[name](spark, str(SF_DIR)).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(sql.fetchall())


def test_pieces(spark, documents):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = rows_of(spark, "op1_sentencepiece")
    for i, text in documents:
        ids = model.encode(text, add_eos=True)
        assert got[i][1:] == (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))


def test_passages(spark, documents):
    words = {i: re.findall("[^\\x20\\x09-\\x0D]+", t) for i, t in documents}
    first = {}
    for i, w in words.items():
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a : a + 50]), i)
    got = rows_of(spark, "op3_passages")
    for i, w in words.items():
        gone = {p for a in range(len(w) - 49) if first[tuple(w[a : a + 50])] < i for p in range(a, a + 50)}
        assert got[i][1:] == (len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone)))


@pytest.mark.parametrize("bucket", [2048, 3])
def test_suffixes(spark, documents, bucket, monkeypatch):
    from promptward.llm import suffixes

    monkeypatch.setattr(suffixes, "BUCKET", bucket)
    data = {i: t.encode() for i, t in documents}
    times = Counter(x[a : a + 400] for x in data.values() for a in range(len(x) - 399))
    got = rows_of(spark, "op5_suffixes")
    for i, x in data.items():
        gone = np.zeros(len(x) + 1, dtype=bool)
        for a in range(len(x) - 399):
            if times[x[a : a + 400]] > 1:
                gone[a : a + 400] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone) if not g)
        assert got[i][1:] == (len(x), int(gone.sum()), spans, sha(kept))


def test_shards(spark, documents):
    rows = QUERIES["op6_shards"](spark, str(SF_DIR)).toPandas()
    texts = dict(documents)
    assert sorted(rows.doc_id) == sorted(texts)
    assert all(r[1] == len(texts[r[0]].encode()) + 1 for r in rows[["doc_id", "size"]].itertuples(index=False))
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(rows.doc_id, rows.text_crc32))
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = rows.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.02 * sizes.min()
    rows["text"] = rows.doc_id.map(texts)
    assert rows.groupby("text").shard.nunique().max() == 1


def test_personal_data(spark, documents):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    got = rows_of(spark, "op7_personal_data")
    for i, text in documents:
        base = []
        for order, (kind, pattern) in enumerate(patterns.items()):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                worth = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
                fits = {
                    "email": True,
                    "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255,
                    "card": 12 <= len(digits) <= 19 and sum(w - 9 * (w > 9) for w in worth) % 10 == 0,
                    "phone": 9 <= len(digits) <= 15,
                }[kind]
                if fits:
                    base.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        names = [s for _, _, s in sorted(base)]
        row = got[i]
        assert row.base_sha256 == sha(",".join(names)) and set(names) <= set(row.spans.split(",")) | {""}
        for kind in patterns:
            assert row[f"n_{kind}"] == sum(n.startswith(kind) for n in names)


def test_toxicity(spark, duck):
    got = rows_of(spark, "op8_toxicity")
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.5)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_toxicity_finds_held_out_rows(spark):
    """Nine of ten toxic rows that were not learnt from, and hardly a clean one."""
    from promptward.llm import toxicity as tox

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    index = tox.fit(docs, labels)
    unseen = docs.join(labels.filter(tox.held_out()), "doc_id")
    rows = tox.score(unseen, index).select("toxic", "predicted").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert len(toxic) > 90 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01


def test_token_files(spark, documents):
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = rows_of(spark, "op9_token_files"), 0
    for i, text in documents:
        ids = np.array([*tool.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i][1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_near_duplicates(spark):
    """Classes against the components of all pairs with an exact weighted Jaccard similarity of 0.8 or more."""
    from promptward.llm import near

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    weights = near.shingle_weights(docs, "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {i: near.weighted_set(t.encode(), weights) for i, t in texts.items()}
    true = Counter(h for hashes, _ in sets.values() for h in hashes.tolist())
    hashes = np.fromiter(true, dtype=np.uint64, count=len(true))
    exact = near.idf_weights(np.fromiter(true.values(), dtype=np.int64, count=len(true)), len(texts))
    # Slots are shared by chance: few weights are off, and those by little.
    off = np.abs(weights[near._slots(hashes)].max(axis=0) - exact)
    assert (off > 1e-6).mean() < 0.005 and off.max() < 0.03 and exact.min() < 1.25
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, by_text = {}, {}
    for i, t in texts.items():
        by_text.setdefault(t, []).append(i)
        for h in sets[i][0].tolist():
            holders.setdefault(h, []).append(i)
    tried = {(a, b) for ids in holders.values() if len(ids) < 200 for a in ids for b in ids if a < b}
    links = [(a, b) for a, b in tried if near.similarity(sets[a], sets[b]) >= near.SIMILARITY]
    links += [(ids[0], i) for ids in by_text.values() for i in ids]
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    sizes = Counter(map(top, texts))
    got = {r.doc_id: (r.class_id, r.class_size) for r in near.near_duplicates(docs).collect()}
    want = {i: (top(i), sizes[top(i)]) for i in texts}
    # Sampling finds a pair at the bound itself with a chance of 99.8 %.
    missed = sum(got[i] != want[i] for i in texts)
    assert len(got) == len(texts) and missed <= len(texts) // 500 and len(links) > 50
