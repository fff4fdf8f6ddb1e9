"""Edge cases of the training-data operators: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from promptward.llm import near, shards
from promptward.llm.decontaminate import contamination, drop_contaminated
from promptward.llm.exact import build_hash, drop_exact_duplicates, exact_duplicates, find_slots
from promptward.llm.near import near_duplicates
from promptward.llm.passages import drop_repeated_passages
from promptward.llm.personal import find_personal_data, luhn
from promptward.llm.pieces import PieceCodec, encode_decode
from promptward.llm.shards import pack
from promptward.llm.suffixes import drop_repeated_bytes, refine
from promptward.llm.tokenfile import TokenFileReader, TokenFileWriter, WordEncoder, read_token_files, write_token_files
from promptward.llm.toxicity import drop_toxic, fit, score, words_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id BIGINT, text STRING, key STRING, n_words STRING, digest STRING"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, equal ids, and columns with names of the operators' own."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "a b c d e f g h i j k l", "x", None, None),
        (2, None, None, "y", None),
        (3, "", "x", "y", "z"),
        (4, " \t\n", "x", "y", "z"),
        (5, long, "x", "y", "z"),
        (6, long + " tail", "x", "y", "z"),
        (7, "a  b c d e f\ng h i j k l", "x", "y", "z"),
        (7, "a  b c d e f\ng h i j k l", "x", "y", "z"),
        (None, "a b c d e f g h i j k l", "x", "y", "z"),
        (8, "é" * 500 + "日本語🙂", "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "C D E F G H I J K L M"), (2, "g h i"), (3, None), (4, "..")], "item_id BIGINT, text STRING")


def test_pieces_agree_with_the_library():
    tool, library = PieceCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(5)
    alphabet = ["ab", " ", "  ", "th", "er", "▁", "\n", ".", "é", "한", "🙂", "\x01", "12", "'s"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for text in [*texts, "", " ", "   ", "x" * 5000, "▁▁", "\x00"]:
        ids = library.encode(text, add_eos=True)
        assert tool.encode(text) == ids and tool.decode(ids) == library.decode(ids)


def test_pieces_keep_rows_and_columns(odd, empty):
    out = encode_decode(odd.withColumnRenamed("n_words", "n_tokens"), PIECES)
    assert out.columns == ["doc_id", "text", "key", "digest", "n_tokens", "ids_text", "decoded_text"]
    assert sorted(r.decoded_text for r in out.collect()) == sorted(r.text or "" for r in odd.collect())
    assert encode_decode(empty, PIECES).count() == 0


def test_contamination(spark, odd, items, empty):
    rows = contamination(odd, items).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    # Items 1 (ten of its words from the third on) and 2 (three words, one window).
    assert by_id[1].n_words == 12 and by_id[1].n_hit == 10 and by_id[1]["items"] == ["1", "2"]
    assert by_id[2].n_words == by_id[3].n_hit == by_id[5].n_hit == 0
    assert {r.doc_id for r in drop_contaminated(odd, items).collect()} == {2, 3, 4, 5, 6, 8}
    assert drop_contaminated(odd, items).columns == odd.columns
    assert contamination(empty, items).count() == 0
    # A final capital sigma is lower-cased by what follows it; the words are the same all the same.
    greek = spark.createDataFrame([(1, "ΟΔΟΣ α b c d e f g h"), (2, "ΟΔΟΣ.α b c d e f g h"), (3, "x ΟΔΟΣ'α b c d e f g h")], "doc_id BIGINT, text STRING")
    one = greek.filter("doc_id = 1").withColumnRenamed("doc_id", "item_id")
    assert {r.doc_id: r.n_hit for r in contamination(greek, one).collect()} == {1: 9, 2: 9, 3: 9}
    assert all(r.n_hit == 0 for r in contamination(odd, items.limit(0)).collect())


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 62, (5000, 4)).astype(np.uint64)
    sizes, bits = build_hash(keys)
    assert sorted(find_slots(keys, sizes, bits)) == list(range(5000))


def test_exact(odd, empty):
    for share in (0.0, 0.5, 1.0):
        rows = exact_duplicates(odd, history_share=share).collect()
        assert len(rows) == 10
        assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in rows) == sorted(
            [("1", 1, 4), ("7", 1, 4), ("7", 1, 4), ("None", 1, 4), ("2", 2, 2), ("3", 2, 2), ("4", 4, 1), ("5", 5, 1), ("6", 6, 1), ("8", 8, 1)]
        )
        assert sorted(r.doc_id for r in rows if r.kept) == [1, 2, 4, 5, 6, 8]
    out = drop_exact_duplicates(odd)
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 4, 5, 6, 8] and out.columns == odd.columns
    assert exact_duplicates(empty).count() == drop_exact_duplicates(empty).count() == 0


def test_exact_keeps_one_of_repeated_rows(spark):
    rows = spark.createDataFrame([(3, "t")] * 5 + [(None, "u")] * 3, "doc_id BIGINT, text STRING")
    assert sorted((r.doc_id or 0, r.text) for r in drop_exact_duplicates(rows).collect()) == [(0, "u"), (3, "t")]
    assert sum(r.kept for r in exact_duplicates(rows).collect()) == 2


def test_passages(odd, empty):
    rows = {str(r.doc_id): r for r in drop_repeated_passages(odd).collect()}
    assert rows["5"].n_removed == 0 and rows["6"].n_removed == 30_000 and rows["6"].kept == "tail"
    assert rows["2"].n_words == rows["4"].n_words == 0 and rows["7"].kept == "a b c d e f g h i j k l"
    assert drop_repeated_passages(odd).count() == 10 and drop_repeated_passages(empty).count() == 0


def test_repeated_bytes(odd, empty):
    rows = {str(r.doc_id): r for r in drop_repeated_bytes(odd).collect()}
    assert bytes(rows["5"].kept) == b"" and bytes(rows["6"].kept) == b" tail" and rows["6"].n_spans == 1
    assert rows["8"].n_bytes == 1000 + 9 + 4 and bytes(rows["8"].kept) == "日本語🙂".encode()
    assert drop_repeated_bytes(odd).count() == 10 and drop_repeated_bytes(empty).count() == 0


def test_refine_against_counts():
    rng = np.random.default_rng(3)
    contents = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (40, 60, 25, 33)]
    for width in (5, 9, 12, 20):
        lasts = [len(c) - width for c in contents]
        got = refine(contents, np.zeros(4, dtype=int), np.array(lasts), width)
        seen = [[c[i : i + width] for i in range(n + 1)] for c, n in zip(contents, lasts)]
        every = [w for s in seen for w in s]
        assert [g.tolist() for g in got] == [[i for i, w in enumerate(s) if every.count(w) > 1] for s in seen]


def test_sampling_estimates_the_similarity():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = np.arange(0, 330), np.arange(40, 400)
    weights = 1 + rng.random(400).astype(np.float32)
    sets = [(pool[a], weights[a]), (pool[b], weights[b])]
    samples = near.Sampler(2000).sample(np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets]), np.array([0, len(a)]))
    assert abs((samples[0] == samples[1]).mean() - near.similarity(*sets)) < 0.04


def test_near_duplicates(spark, odd, empty):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join("new" if j == 20 * i + 7 else w for j, w in enumerate(words))) for i in range(8)]
    rows += [(20, " ".join(words[:100])), (21, None), (22, " ")]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
    assert {got[i].class_id for i in range(8)} == {0} and got[0].class_size == 8
    assert [got[i].class_id for i in (20, 21, 22)] == [20, 21, 22]
    rows = near_duplicates(odd).collect()
    assert len(rows) == 10 and {r.class_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert near_duplicates(empty).count() == 0


def test_best_fit_decreasing():
    runs = [(7, 3), (5, 2), (3, 4), (1, 5)]
    steps, bins = shards.best_fit_decreasing(runs, 10)
    assert bins == 5 and sum(n for _, n in steps) == 14
    room = [10] * bins
    sizes = [s for s, n in runs for _ in range(n)]
    for b, n in steps:
        for _ in range(n):
            room[b] -= sizes.pop(0)
    assert min(room) >= 0
    tree, rng, kept = shards.RoomTree(), random.Random(4), set()
    for i in range(600):
        if kept and rng.random() < 0.4:
            x = rng.choice(sorted(kept))
            kept.remove(x)
            tree.discard(*x)
        else:
            kept.add((rng.randint(0, 99), i))
            tree.add(*max(kept, key=lambda k: k[1]))
        want = min((k for k in kept if k[0] >= 50), default=None)
        assert tree.tightest(50) == want


def test_shards(spark, odd, empty):
    rows = pack(odd, shards=2).collect()
    assert len(rows) == 10
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert pack(empty).count() == 0
    hot = spark.createDataFrame([(i, "same text " * 10) for i in range(900)] + [(i, f"t{i}") for i in range(900, 1000)], "doc_id BIGINT, text STRING")
    sizes = pack(hot).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 8 and sizes.max() < 1.35 * sizes.mean()
    assert pack(hot, shards=None, capacity=20_000).agg({"shard": "max"}).first()[0] >= 4


def test_personal_data(spark, odd, empty):
    text = "mail a.b@c.org or +49 (89) 123 4567 8, 4111 1111 1111 1111, 999.1.1.1 10.0.0.1 é🙂 x@y.z"
    one = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    base = [(s.kind, text[s.start : s.end]) for s in find_personal_data(one).first().base]
    assert base == [("email", "a.b@c.org"), ("phone", "+49 (89) 123 4567 8"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1"), ("email", "x@y.z")]
    assert find_personal_data(odd).count() == 10 and find_personal_data(empty).count() == 0
    hostile = spark.createDataFrame([(1, "a" * 100_000), (2, "a." * 50_000 + "@"), (3, "1" * 100_000), (4, "a@" + "b." * 50_000 + "c")], "doc_id BIGINT, text STRING")
    assert {r.doc_id: len(r.base) for r in find_personal_data(hostile).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_long_secrets_are_marked_whole(spark):
    """A run of any length is one span; no part of it stays outside."""
    from promptward.llm.personal import listed

    secret, local = "x9" * 900, "n" * 200
    texts = [(i, f"login config: password={secret}{i} and then") for i in range(40)]
    texts += [(100 + i, f"please contact {local}{i} [at] mail{i} [dot] corp [dot] example [dot] a [dot] b [dot] com or write") for i in range(40)]
    texts += [(200 + i, f"plain words without anything, number {i}") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    rows = find_personal_data(docs).select("doc_id", listed("spans").alias("s")).collect()
    cut = [(r.doc_id, s) for r in rows for s in r.s.split(",") if s.startswith("secret")]
    for i, s in cut:
        assert int(s.split(":")[2]) == len("login config: password=") + 1800 + len(str(i))
    assert not [r for r in rows if r.doc_id >= 200 and r.s] and len(cut) == 40


def test_toxicity(spark, empty):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(40)]
        if i % 3 == 0:
            text[rng.randrange(40)] = rng.choice(["vile", "nasty"])
        rows.append((i, " ".join(text), "x"))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (600, "", "x")], "doc_id BIGINT, text STRING, score STRING")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id BIGINT, toxic INT")
    out = score(docs, fit(docs, labels)).collect()
    wrong = sum(r.predicted != int(r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 600)
    assert len(out) == 602 and wrong == 0 and all(e.label for r in out if r.predicted for e in r.evidence)
    assert drop_toxic(docs, labels).count() == 402 and drop_toxic(docs, labels).columns == docs.columns
    none = score(empty, fit(empty, labels.limit(0)))
    assert none.count() == 0


def test_toxicity_by_rare_terms(spark):
    """Marking words of three toxic texts each, and neighbours against a full scan of all terms."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(600):
        text = [rng.choice(words) for _ in range(12)]
        rows.append((i, " ".join([*text, f"mark{chr(97 + i // 9 % 26)}{chr(97 + i // 9 // 26)}"] if i % 3 == 0 else text)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    index = fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id BIGINT, toxic INT"))
    vectors = {i: dict(zip(*map(np.ndarray.tolist, index.vector(t)))) for i, t in rows}
    assert all(index.numbers[sorted(vectors[i])].tolist() == words_of(dict(rows)[i])[0].tolist() for i in index.ids)
    for i in range(0, 600, 7):
        cosines = [sum(w * vectors[i].get(t, 0) for t, w in vectors[j].items()) for j in index.ids]
        near = index.nearest(*index.vector(dict(rows)[i]))
        assert np.allclose([c for c, _ in near], sorted(cosines, reverse=True)[: len(near)], atol=1e-5) and len(near) == 15
    got = {r.doc_id: r.predicted for r in score(docs, index).collect()}
    assert sum(got[i] for i in index.ids if i % 3 == 0) > 0.9 * sum(i % 3 == 0 for i in index.ids)


def test_toxicity_by_late_ids(spark):
    """Every sampled example is in the index, those of the largest ids too."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"{name(i)} {name(i * 7 + 1)} {name(i * 11 + 2)} " + ("awful" if i < 4400 else "rotten") * (i % 2)) for i in range(5600)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    index = fit(docs, spark.createDataFrame([(i, i % 2) for i in range(5600)], "doc_id BIGINT, toxic INT"))
    assert sum(index.labels == 1) == sum(index.labels == 0) == 1_000 and max(index.ids) > 5_400
    new = spark.createDataFrame([(9_001, "rotten"), (9_002, "zz rotten zz")], "doc_id BIGINT, text STRING")
    for r in score(new, index).collect():
        assert r.predicted == 1 and all(e.doc_id >= 4400 and e.label == 1 for e in r.evidence)


def test_toxicity_of_odd_rows(spark, odd):
    """Clashing names, repeated rows, long texts, an id with two labels and one without a document."""
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (3, 0), (6, 1), (7, 0), (8, 0), (None, 1), (99, 1), (7, 5)], "doc_id BIGINT, toxic INT"
    )
    docs = odd.withColumnsRenamed({"key": "score", "digest": "evidence"})
    index = fit(docs, labels)
    want = [(1, 0), (1, 1), (6, 1), (7, 0), (8, 0)]
    assert sorted(zip(index.ids, index.labels.tolist())) == [x for x in want if zlib.crc32(str(x[0]).encode()) % 5]
    out = score(docs, index)
    assert out.count() == 10 and all(0 <= r.score <= 1 for r in out.collect())
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 10
    one = fit(docs, labels.filter("toxic = 0"))
    assert {r.predicted for r in score(docs, one).collect()} == {0}


def test_token_file_round_trip(tmp_path):
    path = str(tmp_path / "f" / "x.zst")
    writer, docs = TokenFileWriter(path), [(3, b""), (None, b"\1\0\0\0"), (9, bytes(range(8)) * 1000)]
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = TokenFileReader(path)
    assert reader.doc_ids == [3, None, 9] and [reader.read(i).tobytes() for i in (2, 0, 1)] == [docs[i][1] for i in (2, 0, 1)]
    damaged = bytearray((tmp_path / "f" / "x.zst").read_bytes())
    damaged[reader.ends[1] + 14] ^= 1
    (tmp_path / "f" / "y.zst").write_bytes(damaged)
    with pytest.raises(Exception):
        TokenFileReader(str(tmp_path / "f" / "y.zst")).read(2)


def test_word_encoder():
    tool = WordEncoder(WORDS)
    rng = random.Random(1)
    alphabet = ["a", "B", " ", ".", "'s", "Σ", "é", "\n", "<|endoftext|>", "!", "ıİ", "3", "\xa0", "日本", "\u0301"]
    for _ in range(2000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        want = tool.tool.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == want


def test_new_words_are_encoded_together():
    class Counted:
        def __init__(self, tool):
            self.tool, self.calls = tool, []

        def encode(self, *args, **kw):
            self.calls.append("one")
            return self.tool.encode(*args, **kw)

        def encode_batch_fast(self, *args, **kw):
            self.calls.append("many")
            return self.tool.encode_batch_fast(*args, **kw)

    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÉÞàéßÿ"
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(400)]
    texts = [f"({words[i]}-{words[i + 1]}) {i} x×{words[i]}÷ <{words[i]}>! 7{words[i]}|" for i in range(399)]
    texts += ["", " ", "a", "b" * 200, "e\u0301 É'S Σ", "<|endoftext|>x <|"]
    for limit in (50, 200_000):
        tool = WordEncoder(WORDS)
        plain, tool.tool, tool.parts.limit = tool.tool, Counted(tool.tool), limit
        found = [x for i in range(0, len(texts), 150) for x in tool.encode_all(texts[i : i + 150])]
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == want
        # One by one are the pieces with × and ÷, a long word and those of the last texts.
        assert tool.tool.calls.count("many") <= 6 and tool.tool.calls.count("one") <= 399 + 10


def test_token_files(odd, empty, tmp_path):
    manifest = write_token_files(odd, str(tmp_path / "t"), WORDS, 2, file_bytes=2000)
    rows = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 6, 7, 7, 8, None]
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(rows, rows[1:]))
    assert bytes(rows[1].ids) == b"\2\0\0\0"
    nothing = write_token_files(empty, str(tmp_path / "e"), WORDS, 2)
    assert read_token_files(nothing).count() == 0


def test_luhn(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("4111111111111111",), ("4111111111111112",)], "d STRING")
    assert [r[0] for r in rows.select(luhn(F.col("d"))).collect()] == [True, False]
