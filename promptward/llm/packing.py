"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents become token ids and an end id; only documents longer than a sequence are
cut, and then only their first piece may be shorter than a sequence.  Pieces of equal
length are interchangeable, so the algorithm works on the number of pieces of each
length, at most ``capacity`` numbers whatever the size of the corpus, and on bins as
patterns: how many pieces of which length, and how many bins look like that.

A chromosome is a whole packing; its genes are bins.  Crossover injects well-filled bins
of one parent into the other, takes out the bins that would use a piece twice, and puts
their displaced pieces back by best fit.  Mutation takes out badly filled bins.  Islands
evolve in separate tasks; between epochs, the table of all populations is written and the
best packing of each island moves to the next one.  Evolution ends when a packing meets
the lower bound of its number of sequences, or after ``EPOCHS``.

Pieces then find their place by their rank among the pieces of their length: ranks
come from hash buckets of bounded size and from the counts of the buckets before, so a
length that a third of all pieces share is no hot group.

Null text is an empty one: a piece of one end id.  Rows with equal ids are packed each.
An empty table gives no rows.  Ids may be null.
"""

from __future__ import annotations

import json
import math
import pickle
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptward.llm.common import text_or_empty, written

CAPACITY = 2048
ISLANDS = 6
#: Packings of an island, children of an epoch, and epochs at most.
POPULATION, CHILDREN, EPOCHS = 6, 10, 6
#: Share of a parent's bins that a crossover injects at most.
INJECTED = 0.5
#: Pieces that are ranked together.
BUCKET = 200_000
#: A run this long of one kind of character goes to the slower, never quadratic, encoder.
LONG_RUN = re.compile(r"\S{1500}|\s{1500}")
#: How a byte-level vocabulary splits a text before merging (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"
POPULATIONS = "island INT, place INT, bins BIGINT, fill DOUBLE, packing BINARY"

#: Bins of one look: pairs of length and number, longest first.
Pattern = tuple[tuple[int, int], ...]
Packing = dict[Pattern, int]


# --- ids -----------------------------------------------------------------------------


class ByteLevelEncoder:
    """Ids of a byte-level vocabulary file, equal to those of the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.slow = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if LONG_RUN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode(text, allowed_special="all"), dtype="<u4")


_ENCODERS: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteLevelEncoder(path)
    return _ENCODERS[path]


def bounds(total: int, capacity: int) -> list[tuple[int, int]]:
    """Pieces of ``total`` ids: all are full but perhaps the first."""
    first = (total - 1) % capacity + 1
    return [(0, first)] + [(a, a + capacity) for a in range(first, total, capacity)]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece of every document: its place in the document and a checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tool.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                for i, (a, b) in enumerate(bounds(len(ids), capacity)):
                    rows.append((doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text")).mapInArrow(run, PIECES)


# --- packings ------------------------------------------------------------------------


def used(pattern: Pattern) -> int:
    return sum(s * c for s, c in pattern)


def quality(packing: Packing, capacity: int) -> tuple[int, float]:
    """Number of bins, and the sum of squared fills, which tells full from even bins."""
    return (
        sum(packing.values()),
        -sum(m * (used(p) / capacity) ** 2 for p, m in packing.items()),
    )


def first_fit(counts: dict[int, int], capacity: int, rng: np.random.Generator | None = None) -> Packing:
    """Fill bin after bin with the longest pieces that fit; equal bins are made at once.

    With ``rng`` a piece that would fit is now and then left for a later bin.
    """
    left = {s: c for s, c in counts.items() if c}
    sizes = sorted(left)
    out: Packing = {}
    while sizes:
        room, pattern = capacity, []
        at = len(sizes) - 1
        while at >= 0 and room >= sizes[0]:
            size = sizes[at]
            skip = rng is not None and pattern and rng.random() < 0.1
            if size <= room and not skip:
                number = min(left[size], room // size)
                pattern.append((size, number))
                room -= size * number
            at = min(at, bisect_left(sizes, room + 1)) - 1
        times = min(left[s] // c for s, c in pattern)
        key = tuple(pattern)
        out[key] = out.get(key, 0) + times
        for s, c in pattern:
            left[s] -= c * times
            if not left[s]:
                sizes.pop(bisect_left(sizes, s))
    return out


def best_fit(packing: Packing, displaced: dict[int, int], capacity: int, rng: np.random.Generator) -> Packing:
    """Put displaced pieces, longest first, into the bins they fill best; the rest into new bins."""
    mult = dict(packing)
    open_bins = sorted((capacity - used(p), p) for p in mult if used(p) < capacity)
    rest: dict[int, int] = {}
    for size in sorted((s for s, c in displaced.items() if c), reverse=True):
        todo = displaced[size]
        while todo:
            at = bisect_left(open_bins, (size,))
            if at == len(open_bins):
                rest[size] = todo
                break
            room, old = open_bins[at]
            times = min(todo, mult[old])
            parts = dict(old)
            parts[size] = parts.get(size, 0) + 1
            new = tuple(sorted(parts.items(), reverse=True))
            mult[old] -= times
            if not mult[old]:
                del mult[old]
                open_bins.pop(at)
            if room > size and new not in mult:
                insort(open_bins, (room - size, new))
            mult[new] = mult.get(new, 0) + times
            todo -= times
    for pattern, times in first_fit(rest, capacity, rng if rng.random() < 0.5 else None).items():
        mult[pattern] = mult.get(pattern, 0) + times
    return mult


def left_after(counts: dict[int, int], packing: Packing) -> dict[int, int]:
    left = dict(counts)
    for pattern, times in packing.items():
        for s, c in pattern:
            left[s] -= c * times
    return {s: c for s, c in left.items() if c}


def crossover(
    one: Packing, two: Packing, counts: dict[int, int], capacity: int, rng: np.random.Generator
) -> Packing:
    """Well-filled bins of ``two``, then all bins of ``one`` that need no piece twice, then best fit."""
    child: Packing = {}
    left = dict(counts)
    quota = max(1, int(sum(two.values()) * INJECTED * rng.random()))
    # Bins in order of their fill, roughly: chance decides between neighbours.
    order = sorted(two, key=lambda p: used(p) + rng.integers(0, max(2, capacity // 64)), reverse=True)
    for source, limit in ((order, quota), (sorted(one, key=used, reverse=True), None)):
        for pattern in source:
            have = two[pattern] if limit is not None else one[pattern]
            times = min(have, min(left.get(s, 0) // c for s, c in pattern))
            if limit is not None:
                times = min(times, quota)
                quota -= times
            if times:
                child[pattern] = child.get(pattern, 0) + times
                for s, c in pattern:
                    left[s] -= c * times
    return best_fit(child, left, capacity, rng)


def mutate(packing: Packing, counts: dict[int, int], capacity: int, rng: np.random.Generator) -> Packing:
    """Take out the worst bins and some others, and put their pieces back."""
    kept = dict(packing)
    out = max(2, int(len(kept) * 0.05))
    worst = sorted(kept, key=used)[:out]
    others = list(kept)
    chosen = worst + [others[i] for i in rng.integers(0, len(others), out)]
    for pattern in chosen:
        if pattern in kept:
            kept[pattern] -= 1 + int(rng.integers(0, kept[pattern]))
            if not kept[pattern]:
                del kept[pattern]
    return best_fit(kept, left_after(counts, kept), capacity, rng)


def evolve(
    population: list[Packing], counts: dict[int, int], capacity: int, children: int, seed: int
) -> list[Packing]:
    """One epoch of an island: the best of parents and children."""
    rng = np.random.default_rng(seed)
    least = lower_bound(counts, capacity)
    population = sorted(population, key=lambda p: quality(p, capacity))
    for _ in range(children):
        if quality(population[0], capacity)[0] <= least:
            break
        a, b = (population[min(rng.integers(0, len(population), 2))] for _ in range(2))
        child = crossover(a, b, counts, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, counts, capacity, rng)
        if child not in population:
            population = sorted([*population, child], key=lambda p: quality(p, capacity))[:POPULATION]
    return population


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: all tokens, and pieces of which no two share a bin."""
    tokens = -(-sum(s * c for s, c in counts.items()) // capacity)
    return max(tokens, sum(c for s, c in counts.items() if 2 * s > capacity))


def best_packing(spark, counts: dict[int, int], capacity: int) -> Packing:
    """The best packing that the islands find."""
    least = lower_bound(counts, capacity)

    def start(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for island in batch.column(0).to_pylist():
                rng = np.random.default_rng(island)
                found = [first_fit(counts, capacity, rng if island or i else None) for i in range(POPULATION // 2)]
                yield _rows(island, found, capacity)

    def epoch(number: int):
        def run(part: pd.DataFrame) -> pd.DataFrame:
            island = int(part["island"].iloc[0])
            known = [pickle.loads(p) for p in part["packing"]]
            found = evolve(known, counts, capacity, CHILDREN, 1_000_003 * number + island)
            return _rows(island, found, capacity).to_pandas()

        return run

    islands = spark.range(ISLANDS).repartition(ISLANDS, "id")
    population = written(islands.mapInArrow(start, POPULATIONS), "islands")
    for number in range(1, EPOCHS + 1):
        if population.agg(F.min("bins")).first()[0] <= least:
            break
        moved = population.filter("place = 0").withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        together = population.unionByName(moved).repartition(ISLANDS, "island")
        population = written(together.groupBy("island").applyInPandas(epoch(number), POPULATIONS), "islands")
    best = population.orderBy("bins", "fill", "island").select("packing").first()
    return pickle.loads(best[0])


def _rows(island: int, found: list[Packing], capacity: int) -> pa.RecordBatch:
    ranked = sorted(found, key=lambda p: quality(p, capacity))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([island] * len(ranked), pa.int32()),
            pa.array(range(len(ranked)), pa.int32()),
            pa.array([quality(p, capacity)[0] for p in ranked], pa.int64()),
            pa.array([quality(p, capacity)[1] for p in ranked], pa.float64()),
            pa.array([pickle.dumps(p) for p in ranked], pa.binary()),
        ],
        names=["island", "place", "bins", "fill", "packing"],
    )


# --- places --------------------------------------------------------------------------


def place_table(packing: Packing) -> dict[str, np.ndarray]:
    """Rows of (length, pattern): the first rank of the length that belongs there, and where it lies."""
    rows, bin_at, taken = [], 0, {}
    for pattern, times in packing.items():
        offset = 0
        for size, number in pattern:
            rows.append((size, taken.get(size, 0), number, bin_at, offset))
            taken[size] = taken.get(size, 0) + number * times
            offset += size * number
        bin_at += times
    rows.sort()
    names = ("length", "rank", "number", "bin", "offset")
    return {n: np.array(c, dtype=np.int64) for n, c in zip(names, zip(*rows))}


def ranked(found: DataFrame, total: int) -> DataFrame:
    """``found`` with the rank of each piece among those of its length, from 0."""
    buckets = max(1, math.ceil(total / BUCKET))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    group = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket")
        .agg(F.count("*").alias("many"))
        .select("length", "bucket", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("before"))
    )
    return (
        dealt.withColumn("place", F.row_number().over(group) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("place") + F.col("before"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    )


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``offset`` is where the piece's first id lies in its sequence.
    """
    spark = docs.sparkSession
    found = written(pieces(docs, vocabulary, end_id, capacity), "pieces")
    counts = {r[0]: r[1] for r in found.groupBy("length").count().collect()}
    schema = PIECES + ", sequence_id BIGINT, offset BIGINT"
    if not counts:
        return spark.createDataFrame([], schema)
    table = place_table(best_packing(spark, counts, capacity))
    # One order over (length, rank): no rank reaches the step between lengths.
    step = 1 + max(counts.values())
    keys = table["length"] * step + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            inside = rank - table["rank"][at]
            number = table["number"][at]
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(table["bin"][at] + inside // number))
            yield out.append_column("offset", pa.array(table["offset"][at] + inside % number * length))

    return ranked(found, sum(counts.values())).mapInArrow(run, schema)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents in them with their bounds.

    ``placed`` comes from ``pack`` on documents with unique ids; texts are encoded again
    and meet their places by id, so no ids were stored before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            ids = [np.append(tool.ids(t), end_id).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "all_ids"]
            )

    texts = docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text"))
    encoded = texts.mapInArrow(run, "doc_id BIGINT, all_ids ARRAY<INT>")
    part = F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    return (
        placed.join(encoded, "doc_id")
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", part.alias("ids")))).alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.col("parts.ids")).alias("ids"),
            F.transform("parts", lambda p: F.struct(p["doc_id"], p["piece"], p["offset"], p["length"])).alias("documents"),
        )
    )
