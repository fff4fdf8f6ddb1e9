"""The stages of the pipeline, each against what it may drop."""

from __future__ import annotations

from pathlib import Path

import corpus_pipeline
import pytest

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(SF_DIR)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2] > 100
    assert docs.filter("n_tokens < 1").count() == 0


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shouted(text):
    return "".join(c.upper() if c.isascii() else c for c in text)


def planted(spark):
    """The smallest documents with exact copies, near copies, benchmark passages, null and empty texts."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect() if len(words(r.text)) >= 12]
    given = sorted((r for r in docs.collect() if r.text and len(r.text.split()) > 120), key=lambda r: r.doc_id)
    new = []
    for n, r in enumerate(given[:12]):
        parts = r.text.split(" ")
        new.append((10_000 + n, r.text.replace(" ", "  \n"), r.lang, r.source, 1))
        new.append((20_000 + n, " ".join([*parts[:60], "changed", *parts[61:]]), r.lang, r.source, 1))
        new.append((30_000 + n, f"{n} other words before {shouted(items[n % len(items)])} and after", "en", "x", 1))
    new += [(40_000, None, None, None, None), (40_001, "", "en", "x", 0), (None, "no id here", "en", "x", 1)]
    return docs.unionByName(spark.createDataFrame(new, docs.schema))


def test_stages_against_plain_python(spark):
    """What each stage keeps of planted documents, from its own input."""
    import re
    import hashlib

    import public_tokenizers
    import sentencepiece

    stages = dict(corpus_pipeline.STAGES)
    docs = planted(spark)
    sf = str(SF_DIR)
    rows = {r.doc_id: r for r in docs.collect()}
    order = sorted(rows, key=lambda i: (i is None, i or 0))

    kept = {r.doc_id for r in stages["exact dedup"](spark, docs, sf).collect()}
    first = {}
    for i in order:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i].text or ""), i)
    assert kept == set(first.values()) and not any(i and 10_000 <= i < 20_000 for i in kept)

    near = {r.doc_id for r in stages["minhash near-dedup"](spark, docs, sf).collect()}
    assert not any(i and 20_000 <= i < 30_000 for i in near) and {30_000, 30_001} <= near

    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if w else set()
    lengths = {len(g) for g in grams}
    clean = {
        i
        for i, r in rows.items()
        if not any(tuple(w[a : a + n]) in grams for w in [words(r.text)] for n in lengths for a in range(len(w) - n + 1))
    }
    left = {r.doc_id for r in stages["benchmark decontamination"](spark, docs, sf).collect()}
    assert left == clean and not any(i and 30_000 <= i < 40_000 for i in left)

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages["sentencepiece"](spark, docs.filter("doc_id >= 10000"), sf).collect():
        ids = model.encode(rows[r.doc_id].text or "", add_eos=True)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

    toxic = stages["toxicity"](spark, docs, sf)
    assert toxic.columns == docs.columns and {40_000, 40_001} <= {r.doc_id for r in toxic.collect()}
