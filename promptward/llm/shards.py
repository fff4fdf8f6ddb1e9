"""Shards of near equal size by best-fit-decreasing packing of indivisible groups.

Groups of equal texts are sorted by size, the largest first, and each enters the bin with
the least room that still holds it; bins stand in a balanced tree ordered by room.
Sizes are rounded up to eleven significant bits, so all groups fall into a bounded
number of size classes (about a thousand for each doubling), and the plan is made
over counts of classes: a run of equal items fills the tightest bin as far as it
goes in one step, which places them exactly as one by one.  Groups then look up
their bin by their rank in the sorted order, which Spark finds with one range
partitioning and the number of rows of each partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.llm.common import digest, text_or_empty, written

SHARDS = 8
#: Significant bits of a size class beyond the first.
CLASS_BITS = 10
#: The capacity of a fixed number of shards is found to one part in so many.
PRECISION = 1 << 13
#: A group that no shard can hold is cut into this many parts for each shard it would fill.
CUTS = 8


class RoomTree:
    """An AA tree of (room, bin): insertion, removal and the least key not below a bound."""

    class _Node:
        __slots__ = ("key", "level", "left", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n.left and n.left.level == n.level:
            top = n.left
            n.left, top.right = top.right, n
            return top
        return n

    @staticmethod
    def _split(n):
        if n.right and n.right.right and n.right.right.level == n.level:
            top = n.right
            n.right, top.left = top.left, n
            top.level += 1
            return top
        return n

    def _insert(self, n, key):
        if n is None:
            return self._Node(key)
        if key < n.key:
            n.left = self._insert(n.left, key)
        else:
            n.right = self._insert(n.right, key)
        return self._split(self._skew(n))

    def _remove(self, n, key):
        if n is None:
            return None
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif key > n.key:
            n.right = self._remove(n.right, key)
        elif n.left is None:
            return n.right
        elif n.right is None:
            return n.left
        else:
            next_one = n.right
            while next_one.left:
                next_one = next_one.left
            n.key = next_one.key
            n.right = self._remove(n.right, next_one.key)
        low = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
        if low < n.level:
            n.level = low
            if n.right and n.right.level > low:
                n.right.level = low
        n = self._skew(n)
        if n.right:
            n.right = self._skew(n.right)
            if n.right.right:
                n.right.right = self._skew(n.right.right)
        n = self._split(n)
        if n.right:
            n.right = self._split(n.right)
        return n

    def add(self, room: int, bin_: int) -> None:
        self.root = self._insert(self.root, (room, bin_))

    def discard(self, room: int, bin_: int) -> None:
        self.root = self._remove(self.root, (room, bin_))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room of at least ``size``."""
        n, best = self.root, None
        while n:
            if n.key >= (size, -1):
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int]], int]:
    """Place (size, count) runs, largest size first; gives (bin, count) steps in order and the number of bins.

    An item larger than the capacity has a bin of its own.
    """
    tree, steps, bins = RoomTree(), [], 0
    for size, count in runs:
        while count:
            found = tree.tightest(size)
            if found:
                room, bin_ = found
                tree.discard(room, bin_)
            else:
                room, bin_, bins = max(capacity, size), bins, bins + 1
            n = min(count, room // size)
            tree.add(room - n * size, bin_)
            steps.append((bin_, n))
            count -= n
    return steps, bins


def least_capacity(runs: list[tuple[int, int]], shards: int) -> int:
    """About the least capacity with which the runs fit into so many bins."""
    total = sum(s * n for s, n in runs)
    low, high = -(-total // shards) - 1, max(1, -(-total // shards) + (runs[0][0] if runs else 0))
    while best_fit_decreasing(runs, high)[1] > shards:
        high *= 2
    while high - low > max(1, high // PRECISION):
        middle = (low + high) // 2
        if best_fit_decreasing(runs, middle)[1] <= shards:
            high = middle
        else:
            low = middle
    return high


def size_class(size: Column) -> Column:
    """The size rounded up to ``CLASS_BITS`` + 1 significant bits."""
    step = F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.floor(F.log2(size)) - CLASS_BITS))
    return (F.ceil(size / step) * step).cast("bigint")


def _numbered(df: DataFrame, order: list[Column], within: str | None = None) -> DataFrame:
    """Rows in global order with ``part`` and ``at``, the place in the part (of its ``within`` value)."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{n} {t}" for n, t in ordered.dtypes) + ", part INT, at BIGINT"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys = batch.column(within).to_numpy() if within else np.zeros(batch.num_rows, dtype=np.int64)
            at = np.zeros(batch.num_rows, dtype=np.int64)
            for key in np.unique(keys).tolist():
                same = keys == key
                n = int(same.sum())
                at[same] = seen.get(key, 0) + np.arange(n)
                seen[key] = seen.get(key, 0) + n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, dtype=np.int32)), pa.array(at)],
                names=[*batch.schema.names, "part", "at"],
            )

    return written(ordered.mapInArrow(run, kinds), "numbered")


def _looked_up(groups: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """The bin of every group, by its rank among all."""
    parts = dict(groups.groupBy("part").agg(F.max("at") + 1).collect())  # one row for each partition
    before, total = {}, 0
    for part in sorted(parts):
        before[part], total = total, total + parts[part]
    ends = np.cumsum([n for _, n in steps])
    bins = np.array([b for b, _ in steps], dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([before[p] for p in batch.column("part").to_pylist()], dtype=np.int64)
            rank = start + batch.column("at").to_numpy()
            shard = bins[np.searchsorted(ends, rank, side="right")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), batch.column("piece"), pa.array(shard)], names=["digest", "piece", "shard"]
            )

    return groups.select("digest", "piece", "part", "at").mapInArrow(run, "digest BINARY, piece INT, shard INT")


def pack(
    docs: DataFrame,
    shards: int | None = SHARDS,
    capacity: int | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, digest, shard, slot.

    The size of a row is the UTF-8 bytes of its text plus one; null texts are empty.
    Rows of equal texts are one group and stay in one shard.  With ``capacity``
    as few shards of that size as best-fit-decreasing finds are filled; otherwise the least
    capacity is taken with which ``shards`` suffice, which makes their sizes near
    equal.  A group larger than a shard is cut into parts by a hash of the ids.  In
    a shard rows are in order of their ids, rows without one last, and ``slot``
    counts them from 0.  Repeated rows each have a slot; other columns are ignored;
    an empty table gives no rows.
    """
    body = text_or_empty(text)
    rows = written(
        docs.select(
            F.col(id_col).cast("bigint").alias("id"),
            (F.octet_length(body) + 1).cast("bigint").alias("size"),
            F.crc32(body).alias("text_crc32"),
            digest(body).alias("digest"),
        ),
        "sizes",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    room = capacity or -(-total // shards)
    # Fewer than total / room groups can exceed the room, so this list is short.
    too_large = rows.groupBy("digest").agg(F.sum("size").alias("size")).filter(F.col("size") > room).collect()
    piece = F.lit(0)
    for row in too_large:
        cuts = CUTS * -(-row["size"] // room)
        piece = F.when(
            F.col("digest") == F.lit(bytes(row["digest"])), F.pmod(F.xxhash64("id"), F.lit(cuts)).cast("int")
        ).otherwise(piece)
    cut = rows.withColumn("piece", piece)

    groups = cut.groupBy("digest", "piece").agg(size_class(F.sum("size")).alias("class"))
    groups = _numbered(groups, [F.col("class").desc(), F.col("digest"), F.col("piece")])
    counts = groups.groupBy("class").count().collect()  # bounded by the number of size classes
    runs = sorted(((r["class"], r["count"]) for r in counts), reverse=True)
    steps, _ = best_fit_decreasing(runs, capacity or least_capacity(runs, shards))

    placed = cut.join(_looked_up(groups, steps), ["digest", "piece"]).drop("piece")
    placed = _numbered(placed, [F.col("shard"), F.col("id").asc_nulls_last(), F.col("digest")], within="shard")
    # One row for each partition and shard in it; both are sorted, so few partitions hold two.
    sizes = sorted(placed.groupBy("shard", "part").agg(F.max("at") + 1).collect())
    before, seen = [], {}
    for shard, part, n in sizes:
        before.append((shard, part, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + n
    offsets = docs.sparkSession.createDataFrame(before, "shard INT, part INT, before BIGINT")
    return placed.join(F.broadcast(offsets), ["shard", "part"]).select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        "digest",
        "shard",
        (F.col("before") + F.col("at")).alias("slot"),
    )
