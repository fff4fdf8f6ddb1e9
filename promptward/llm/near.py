"""Near-duplicate classes by consistent weighted sampling of TF-IDF shingles.

A text is a weighted set of five-word shingles; the weight of one is its count times a
damped inverse document frequency, counted over all documents.  The frequency is the share of
documents that hold the shingle, and shares below ``RARE`` weigh the same, so a weight
depends on neither the size of the corpus nor the noise of counting.  Improved consistent weighted
sampling draws one (shingle, level) per hash so that two texts agree with the
probability of their weighted Jaccard similarity.  Bands of samples put similar
texts into common buckets; members of a bucket are compared with its pivots, and
every reported link is verified with the exact weighted Jaccard similarity.

Pivots stand in for all pairs.  Every member meets the most central one of each of its buckets, that is the one
that shares most buckets with others, so the original of a group of copies comes first.  1 - similarity
is a metric, so two members have no unseen link where a pivot covers one of them and is far from the other.
Members for which that does not hold become pivots of later rounds, which meet all members of their bucket in
cells: a block of members, a block of pivots, a text once in each.  Rounds go on until
no bucket has such a member: there is no cap on partners.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptward.llm.common import text_or_empty, written
from promptward.llm.components import components, merged
from promptward.llm.repeats import squeezed, unsqueezed
from promptward.llm.windows import kmer_hashes, mix, word_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: Slots of each of the two document-frequency tables; the smaller count of a shingle's two slots is never
#: below its own.  A slot holds (shingles of a text / SLOTS) of the documents by chance, at any corpus size.
SLOTS = 1 << 20
CHUNKS = 64
#: Shingles in at most this share of the documents weigh 1 + DAMPING, one that is everywhere weighs 1.
RARE = 1 / 256
DAMPING = 0.25
#: Entries of the table of random variates of one hash.
VARIATES = 1 << 14
#: Pivots of a bucket in the round after the first, which has one; each later one takes
#: ``GROWTH`` times as many, so the number of rounds is that of a bucket's digits.
MORE_PIVOTS, GROWTH = 32, 32
#: Shingles of the members and of the pivots that meet in one cell, about.
BLOCK = 1 << 18
#: Rows of a cell that go on together.
EMITTED = 10_000
#: What rounding may add to a distance.
SLACK = 1e-9
#: Shingles that are sampled together.
TOGETHER = 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_NO_WORD = np.ones(256, dtype=bool)
_NO_WORD[48:58] = _NO_WORD[97:123] = False
_NO_WORD[128:] = False


def shingles(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in ascending order, and their counts.

    Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.
    A text of one to four words is one shingle; one without words has none.
    """
    data = _FOLD[np.frombuffer(text, dtype=np.uint8)]
    starts, ends = word_spans(data, _NO_WORD[data])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    words = word_hashes(data, starts, ends, 0x9E3779B97F4A7C15)
    return np.unique(kmer_hashes(words, min(SHINGLE, len(words))), return_counts=True)


def _slots(hashes: np.ndarray) -> np.ndarray:
    """The slots of every hash in the two tables, which lie one after the other."""
    one, two = hashes % np.uint64(SLOTS), (hashes >> np.uint64(40)) % np.uint64(SLOTS)
    return np.stack([one.astype(np.int64), two.astype(np.int64) + SLOTS])


def idf_weights(df: np.ndarray, n: float) -> np.ndarray:
    """Weight of shingles that ``df`` of ``n`` documents hold: by the logarithm of their share, down to ``RARE``."""
    share = np.clip(df.astype(np.float64) / max(n, 1.0), RARE, 1)
    return (1 + DAMPING * np.log(share) / np.log(RARE)).astype(np.float32)


def shingle_weights(docs: DataFrame, text: str) -> np.ndarray:
    """Weight by slot, from document frequencies over all rows; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(2 * SLOTS, dtype=np.uint64), 0
        for batch in batches:
            for t in batch.column(0):
                df[np.unique(_slots(shingles(t.as_py().encode())[0]))] += np.uint64(1)
            n += batch.num_rows
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(df, CHUNKS)]
        numbers = np.arange(CHUNKS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers), pa.array(np.where(numbers == 0, n, 0)), pa.array(parts, pa.binary())],
            names=["chunk", "n", "counts"],
        )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * SLOTS // CHUNKS, dtype=np.uint64)
        for part in group["counts"]:
            total += np.frombuffer(zlib.decompress(part), dtype=np.uint64)
        return pd.DataFrame(
            {"chunk": [group["chunk"].iloc[0]], "n": [group["n"].sum()], "counts": [zlib.compress(total.tobytes(), 1)]}
        )

    kinds = "chunk INT, n BIGINT, counts BINARY"
    counted = docs.select(text_or_empty(text)).mapInArrow(count, kinds)
    # Two steps, so that no task sees the counts of all tasks.
    halfway = counted.withColumn("some", F.spark_partition_id() % 16).groupBy("chunk", "some").applyInPandas(merge, kinds)
    rows = sorted(halfway.groupBy("chunk").applyInPandas(merge, kinds).collect())  # CHUNKS rows
    n = float(sum(r["n"] for r in rows))
    df = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint64) for r in rows]) if rows else np.zeros(2 * SLOTS)
    return idf_weights(df, n)


def weighted_set(text: bytes, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = shingles(text)
    return hashes, counts * weights[_slots(hashes)].max(axis=0)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 where a set is empty."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0
    common = float(np.minimum(a[1][at], b[1][bt]).sum(dtype=np.float64))
    return common / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common)


class Sampler:
    """Improved consistent weighted sampling with variates from fixed tables."""

    def __init__(self, hashes: int = BANDS * ROWS):
        rng = np.random.default_rng(20_250_101)
        self.factors = (rng.integers(1 << 62, size=hashes, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        gamma = lambda: rng.gamma(2.0, 1.0, (hashes, VARIATES)).astype(np.float32)
        self.r, self.c = gamma(), np.log(gamma())
        self.beta = rng.random((hashes, VARIATES), dtype=np.float32)

    def sample(self, hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row per set (``starts`` in the joined arrays), one column per hash."""
        counts = np.diff(np.append(starts, len(hashes)))
        of = np.repeat(np.arange(len(starts)), counts)
        log_weight = np.log(weights).astype(np.float32)
        out = np.empty((len(starts), len(self.factors)), dtype=np.uint64)
        shift = np.uint64(64 - (VARIATES - 1).bit_length())
        for k, factor in enumerate(self.factors):
            slot = ((hashes * factor) >> shift).astype(np.int64)
            r, beta = self.r[k][slot], self.beta[k][slot]
            level = np.floor(log_weight / r + beta)
            value = self.c[k][slot] - r * (level - beta + 1)
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == least[of])[::-1]
            first = np.empty(len(starts), dtype=np.int64)
            first[of[hit]] = hit  # the least shingle of equal values is written last
            levels = level[first].astype(np.int64).astype(np.uint64)
            out[:, k] = mix(hashes[first] + levels * np.uint64(0x9E3779B97F4A7C15))
        return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """Hash of the ``ROWS`` samples of each band, told apart by the band."""
    out = np.zeros((len(samples), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        value = np.full(len(samples), b + 1, dtype=np.uint64)
        for k in range(b * ROWS, (b + 1) * ROWS):
            value = mix(value * np.uint64(0xC2B2AE3D27D4EB4F) + samples[:, k])
        out[:, b] = value
    return out.astype(np.int64)


def _banded(rows: DataFrame, weights) -> DataFrame:
    """doc, key, number of shingles and band hashes of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, table = Sampler(), weights.value
        for batch in batches:
            sets, at, size = [], [], 0
            for i in range(batch.num_rows):
                found = weighted_set(batch.column(2)[i].as_py().encode(), table)
                if len(found[0]):
                    sets.append(found)
                    at.append(i)
                    size += len(found[0])
                if sets and (size >= TOGETHER or i + 1 == batch.num_rows):
                    starts = np.cumsum([0, *(len(h) for h, _ in sets[:-1])])
                    joined = [np.concatenate(x) for x in zip(*sets)]
                    bands = band_hashes(sampler.sample(*joined, starts))
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                    picked = batch.take(pa.array(at))
                    many = pa.array([len(h) for h, _ in sets], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [picked.column(0), picked.column(1), many, lists], names=["doc", "key", "shingles", "bands"]
                    )
                    sets, at, size = [], [], 0

    return rows.select("doc", "key", "text").mapInArrow(run, "doc BIGINT, key BINARY, shingles INT, bands ARRAY<BIGINT>")


def _members(banded: DataFrame) -> DataFrame:
    """bucket, key, shingles, central, volume: distinct texts of buckets with at least two; of buckets with the same texts one.

    Texts are ``central`` by the members of all their buckets, those left out too; ``volume`` has all shingles of a bucket.
    """
    texts = banded.dropDuplicates(["key"]).select("key", "shingles", F.explode("bands").alias("bucket"))
    sizes = texts.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(texts.join(sizes.hint("merge"), "bucket"), "shared")
    central = shared.groupBy("key").agg(F.sum("size").alias("central"))
    prints = [F.bit_xor(F.xxhash64("key", F.lit(salt))).alias(f"print_{salt}") for salt in (1, 2)]
    buckets = shared.groupBy("bucket", "size").agg(F.sum("shingles").alias("volume"), *prints)
    kept = buckets.groupBy("size", "volume", "print_1", "print_2").agg(F.min("bucket").alias("bucket"))
    members = shared.join(kept.select("bucket", "volume").hint("merge"), "bucket").join(central.hint("merge"), "key")
    return written(members.select("bucket", "key", "shingles", "central", "volume"), "members")


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` most central of ``rows`` in every bucket as pivots; ranks are cut off below the shuffle."""
    order = Window.partitionBy("bucket").orderBy(F.col("central").desc(), "key")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("bucket", F.col("key").alias("pivot"), "shingles")


def _met(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """bucket, key, pivot: every member with the one pivot that its bucket has."""
    return members.select("bucket", "key").join(pivots.drop("shingles"), "bucket").filter("key != pivot")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """a, b, similarity for every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, held = weights.value, None, None
        for batch in batches:
            out = []
            for a, at, bt in zip(batch.column(0), batch.column(2), batch.column(3)):
                if a != last:
                    last, held = a, weighted_set(unsqueezed(at.as_py()), table)
                out.append(similarity(held, weighted_set(unsqueezed(bt.as_py()), table)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"]
            )

    one = texts.select(F.col("key").alias("a"), F.col("text").alias("at"))
    two = texts.select(F.col("key").alias("b"), F.col("text").alias("bt"))
    both = pairs.hint("merge").join(two.hint("merge"), "b").join(one.hint("merge"), "a").select("a", "b", "at", "bt")
    return both.mapInArrow(run, "a BINARY, b BINARY, similarity DOUBLE")


def _cell(pivots: list[tuple], members: list[tuple], bound: float, whole: bool) -> Iterator[tuple]:
    """key, pivot and similarity of what later rounds need of pivots and members: (key, label, weighted set) each.

    That is the nearest pivot of a member that one covers, links that join classes, and pivots of other classes that
    could reach a member: from ``2 * bound - 1`` on, or closer where the bucket is ``whole`` in this
    cell, since then the members that a pivot covers are all here.
    """
    starts = np.cumsum([0, *(len(m[2][0]) for m in members[:-1])])
    hashes, weights = (np.concatenate([m[2][i] for m in members]) for i in (0, 1))
    known, at = np.unique(hashes, return_inverse=True)
    totals = np.add.reduceat(weights, starts, dtype=np.float64)
    place_of = {m[0]: i for i, m in enumerate(members)}
    best, chosen, alike = np.zeros(len(members)), np.full(len(members), -1), []
    for j, (pivot, _, (own, own_weights)) in enumerate(pivots):
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        held = known[place] == own
        of_pivot = np.zeros(len(known))
        of_pivot[place[held]] = own_weights[held]
        common = np.add.reduceat(np.minimum(weights, of_pivot[at]), starts)
        found = common / (totals + own_weights.sum(dtype=np.float64) - common)
        if pivot in place_of:
            found[place_of[pivot]] = 0
        nearer = (found >= bound) & (found > best)
        best[nearer], chosen[nearer] = found[nearer], j
        some = np.flatnonzero(found >= 2 * bound - 1 - SLACK)
        alike.append((some, found[some]))
    plain = np.ones(len(members), dtype=bool)  # no pivots themselves
    plain[[place_of[p[0]] for p in pivots if p[0] in place_of]] = False

    above: dict[bytes, bytes] = {}

    def top(label: bytes) -> bytes:
        while (up := above.get(label, label)) != label:
            label = up
        return label

    def joins(i: int, j: int) -> bool:
        one, two = top(members[i][1]), top(pivots[j][1])
        above[max(one, two)] = min(one, two)
        return one != two

    for i in np.flatnonzero(plain & (chosen >= 0)):
        joins(i, chosen[i])
        yield members[i][0], pivots[chosen[i]][0], float(best[i])
    for j, (some, found) in enumerate(alike):
        for i, similar in zip(some, found):
            if similar >= bound and joins(i, j):
                yield members[i][0], pivots[j][0], float(similar)
    numbers = {x: n for n, x in enumerate({top(x[1]) for x in [*members, *pivots]})}
    classes = np.array([numbers[top(m[1])] for m in members])
    for j, (some, found) in enumerate(alike):
        covers = best[plain & (chosen == j)]
        if whole and not len(covers):
            continue
        least = (bound + covers.min() - 1 if whole else 2 * bound - 1) - SLACK
        foreign = (found >= least) & (found < bound) & plain[some] & (classes[some] != numbers[top(pivots[j][1])])
        for i, similar in zip(some[foreign], found[foreign]):
            yield members[i][0], pivots[j][0], float(similar)


def _crossed(
    members: DataFrame, used: DataFrame, pivots: DataFrame, labels: DataFrame, texts: DataFrame, weights, bound: float
) -> DataFrame:
    """bucket, key, pivot, similarity: new pivots against the members of their buckets, what ``_cell`` tells of them.

    The members of a bucket and its pivots are dealt into blocks; a cell has one of each, and a
    text goes to a cell once, not to every pair.  Pivots of earlier rounds have met all members, and members that are in
    the class of all new pivots stay out too.
    """
    named = lambda rows, key: rows.join(labels.withColumnRenamed("node", key), key, "left").withColumn(
        "label", F.coalesce("label", key)
    )
    classes = named(pivots, "pivot").groupBy("bucket").agg(
        F.sum("shingles").alias("many"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("key", F.lit(3)), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    shown = ["bucket", "part", "block", "role", "whole", "label", "key"]
    rows = named(members.join(classes, "bucket"), "key").withColumn("whole", blocks("volume") == 1)
    others = rows.join(used.select("bucket", F.col("pivot").alias("key")), ["bucket", "key"], "left_anti")
    others = others.filter((F.col("low") != F.col("high")) | (F.col("label") != F.col("low")))
    others = others.withColumns({"part": dealt("volume"), "role": F.lit(1)}).select("*", each("many").alias("block"))
    of_pivot = rows.join(pivots.select("bucket", F.col("pivot").alias("key")), ["bucket", "key"])
    of_pivot = of_pivot.withColumns({"block": dealt("many"), "role": F.lit(0)}).select("*", each("volume").alias("part"))
    cells = others.select(*shown).unionByName(of_pivot.select(*shown)).hint("merge").join(texts.hint("merge"), "key")
    cell = ["bucket", "part", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, held = weights.value, None, ([], [])
        found: list[tuple] = []

        def packed() -> pa.RecordBatch:
            names = ["bucket", "key", "pivot", "similarity"]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.float64()]
            columns = [[r[i] for r in found] for i in range(len(names))]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def ended() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                for row in _cell(*held, bound, now[3]):
                    found.append((now[0], *row))
                    if len(found) >= EMITTED:
                        yield packed()

        for batch in batches:
            plain = [batch.column(i).to_pylist() for i in range(len(shown))]
            for *place, role, whole, label, key, text in zip(*plain, batch.column(len(shown))):
                if (*place, whole) != now:
                    yield from ended()
                    now, held = (*place, whole), ([], [])
                held[role].append((key, label, weighted_set(unsqueezed(text.as_py()), table)))
        yield from ended()
        yield packed()

    # A number, so that no adaptive read joins cells into a few tasks.
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = cells.select(*shown, "text").repartition(n, *cell).sortWithinPartitions(*cell)
    return ready.mapInArrow(run, "bucket BIGINT, key BINARY, pivot BINARY, similarity DOUBLE")


def _open(members: DataFrame, used: DataFrame, near: DataFrame, labels: DataFrame, bound: float) -> DataFrame:
    """Members that could still have an unseen link to another class of their bucket, with ``central``.

    Two members that are no pivots have no such link where a pivot covers one of them and is far from the other:
    farther than 1 - ``bound`` beyond the farthest member that it covers.  What is left are members that no pivot
    covers, where they are of several classes, and members that a pivot of another class reaches; if
    both are covered, one of the two has to become a pivot, and that is the one of the smaller class.
    """
    sizes = labels.groupBy("label").agg(F.count("*").alias("class_size"))
    named = written(labels.join(sizes, "label").select("node", "label", "class_size"), "sized")

    def classed(rows: DataFrame, key: str, label: str, size: str) -> DataFrame:
        of = named.select(F.col("node").alias(key), F.col("label").alias("_label"), F.col("class_size").alias("_size"))
        return rows.join(of, key, "left").withColumns(
            {label: F.coalesce("_label", key), size: F.coalesce("_size", F.lit(1))}
        ).drop("_label", "_size")

    pivots = used.select("bucket", F.col("pivot").alias("key"))
    rest = classed(members.join(pivots, ["bucket", "key"], "left_anti"), "key", "label", "many")
    seen = near.join(pivots, ["bucket", "key"], "left_anti")
    links = seen.filter(F.col("similarity") >= bound)
    covered = links.select("bucket", "key", F.lit(True).alias("covered")).distinct()
    farthest = links.groupBy("bucket", "pivot").agg(F.min("similarity").alias("least"))
    reached = seen.filter(F.col("similarity") < bound).join(farthest, ["bucket", "pivot"])
    reached = reached.filter(F.col("similarity") >= bound + F.col("least") - 1 - SLACK).select("bucket", "key", "pivot")
    reached = classed(classed(reached, "key", "label", "many"), "pivot", "top_label", "top_many")
    reached = reached.filter("label != top_label").groupBy("bucket", "key").agg(
        F.max(F.struct("top_many", "top_label")).alias("top")
    )
    state = rest.join(covered, ["bucket", "key"], "left").join(reached, ["bucket", "key"], "left")
    state = written(state.withColumn("covered", F.coalesce("covered", F.lit(False))), "state")
    mixed = state.filter("not covered").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = mixed.filter("low != high").select("bucket", F.lit(True).alias("mixed"))
    smaller = F.struct("many", "label") < F.struct("top.top_many", "top.top_label")
    alone = ~F.col("covered") & (F.col("mixed").isNotNull() | F.col("top").isNotNull())
    crossing = F.col("covered") & F.col("top").isNotNull() & smaller
    return state.join(mixed, "bucket", "left").filter(alone | crossing).select("bucket", "key", "shingles", "central")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", bound: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: id, class_id, class_size.

    ``class_id`` is the smallest id of the rows connected by similarities of at least
    ``bound`` and ``class_size`` their number.  Rows of equal texts are in one class.  A
    text without words, a null one too, is similar to nothing but equal texts.  Rows
    without an id take part; their class has a null id only if none of its rows has
    one.  Other columns are ignored; an empty table gives no rows.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.unhex(F.md5(body)).alias("key"), body.alias("text")
    )
    weights = docs.sparkSession.sparkContext.broadcast(shingle_weights(docs, text))  # 2 * SLOTS numbers
    banded = written(_banded(rows, weights), "bands")
    members = _members(banded)
    # One row of each text that is in a bucket, compressed.
    first = banded.groupBy("key").agg(F.min("doc").alias("of"))
    wanted = members.select("key").distinct().join(first, "key")
    same = (F.col("t.key") == F.col("w.key")) & F.col("t.doc").eqNullSafe(F.col("w.of"))
    texts = squeezed(rows).alias("t").join(wanted.alias("w").hint("merge"), same).select("t.key", "t.text")
    texts = written(texts, "texts").dropDuplicates(["key"])

    pivots = used = written(_first(members, 1), "pivots")
    met = _met(members, pivots)
    seen = written(_verified(_ordered(met), texts, weights).filter(F.col("similarity") >= 2 * bound - 1 - SLACK), "verified")
    either = seen.select(F.col("a").alias("key"), F.col("b").alias("pivot"), "similarity").unionByName(
        seen.select(F.col("b").alias("key"), F.col("a").alias("pivot"), "similarity")
    )
    near, most = written(met.join(either, ["key", "pivot"]).select("bucket", "key", "pivot", "similarity"), "near"), MORE_PIVOTS
    linked = lambda rows: _ordered(rows.filter(F.col("similarity") >= bound))
    labels = components(linked(near))
    while True:
        pivots = written(_first(_open(members, used, near, labels, bound), most), "pivots")
        if pivots.isEmpty():
            break
        found = written(_crossed(members, used, pivots, labels, texts, weights, bound), "near")
        labels, near = merged(labels, linked(found)), near.unionByName(found)
        used = used.unionByName(pivots)
        most *= GROWTH

    labelled = written(
        rows.select("doc", "key")
        .join(labels.withColumnRenamed("node", "key").hint("merge"), "key", "left")
        .select("doc", F.coalesce("label", "key").alias("label")),
        "labelled",
    )
    weights.destroy()  # all that needs it is written
    classes = labelled.groupBy("label").agg(F.min("doc").alias("class_id"), F.count("*").alias("class_size"))
    return labelled.join(classes.hint("merge"), "label").select(
        F.col("doc").alias(id_col), "class_id", "class_size"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their class, with all their columns.

    Rows without an id stay only where their class has no id at all; of repeated
    rows with one id all stay or go.
    """
    keep = near_duplicates(docs, id_col, text)
    keep = written(keep.filter(F.col(id_col).eqNullSafe(F.col("class_id"))).select(id_col).distinct(), "kept")
    same = docs[id_col].eqNullSafe(keep[id_col])
    return docs.join(keep.hint("merge"), same, "left_semi").select(*docs.columns)
