"""Removal of byte strings that occur more than once, by bucket-pointer refinement.

Suffixes are put into initial buckets by a q-gram: the anchor of their window.
Buckets with one member are done.  A bucket with many classes of content is refined
by the bytes at later offsets, through a grouping in Spark whose result is the new
bucket identifier; this repeats until every bucket is small or its windows are
equal throughout.  Small buckets are refined in numpy: positions start in buckets
of eight bytes, and each round sorts them by the identifiers of their own bucket
and of the bucket one bucket-length further on, which doubles the sorted length;
the new identifiers are what the next round sorts by, up to the whole window.
Bytes themselves are compared, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.llm.common import written
from promptward.llm.passages import covered
from promptward.llm.repeats import Units, keyed, repeated_runs, squeezed, unsqueezed

WIDTH = 400
GRAM = 64
#: Bytes of an initial bucket inside a task.
FIRST = 8
#: Classes that one task refines at a time, about 800 bytes each.
BUCKET = 2048
#: Ranges that the anchor places of a larger bucket are cut into.
FAN = 8
_CLASS = ["c1", "c2"]


def refine(contents: list[bytes], firsts: np.ndarray, lasts: np.ndarray, width: int) -> list[np.ndarray]:
    """Which windows of each content occur again among those of the others.

    Content ``i`` takes part with its windows ``firsts[i]`` to ``lasts[i]``.
    """
    sizes = np.array([len(c) for c in contents])
    base = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(contents), dtype=np.uint8)
    left = np.repeat(base[1:], sizes) - np.arange(len(data))  # bytes up to the end of the content
    length = min(FIRST, width)
    bucket = np.zeros(len(data), dtype=np.uint64)
    for i in range(length):
        bucket[: len(data) - i] = (bucket[: len(data) - i] << np.uint64(8)) | data[i:]
    alive = left >= length
    while True:
        at = np.flatnonzero(alive)
        _, new, times = np.unique(bucket[at], return_inverse=True, return_counts=True)
        bucket[:] = 0
        bucket[at] = new + 1
        alive[at] = times[new] > 1  # a bucket of one stays one at any length
        if length == width:
            break
        step = min(length, width - length)
        at = np.flatnonzero(alive & (left >= length + step))
        at = at[alive[at + step]]
        joined = (bucket[at] << np.uint64(32)) | bucket[at + step]
        alive[:] = False
        alive[at] = True
        bucket[at] = joined
        length += step
    # Windows outside the given ranges do not count as partners.
    inside = np.zeros(len(data), dtype=bool)
    for b, x, y in zip(base, firsts, lasts):
        inside[b + x : b + y + 1] = True
    at = np.flatnonzero(alive & inside)
    _, new, times = np.unique(bucket[at], return_inverse=True, return_counts=True)
    repeated = np.zeros(len(data), dtype=bool)
    repeated[at] = times[new] > 1
    return [np.flatnonzero(repeated[b : b + s]) for b, s in zip(base, sizes)]


def intervals(places: np.ndarray) -> list[dict[str, int]]:
    """Maximal runs of consecutive numbers as (from, to)."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    starts, ends = np.append(places[0], places[cut + 1]), np.append(places[cut], places[-1])
    return [{"from": int(a), "to": int(b)} for a, b in zip(starts, ends)]


def _contents(rows: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The bytes of each class, from the document that represents it."""
    wanted = classes.groupBy("doc", "text_key").agg(F.collect_list(F.struct(*_CLASS, "first", "n")).alias("runs"))
    same = (F.col("t.text_key") == F.col("r.text_key")) & F.col("t.doc").eqNullSafe(F.col("r.doc"))
    both = squeezed(rows).alias("t").join(wanted.alias("r"), same).select("t.text", "r.runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, runs in zip(batch.column(0), batch.column(1)):
                body, found = unsqueezed(packed.as_py()), runs.values
                first, n = found.field("first").to_numpy(), found.field("n").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [found.field("c1"), found.field("c2"), pa.array([body[a : a + m + width - 1] for a, m in zip(first, n)], pa.binary())],
                    names=[*_CLASS, "content"],
                )

    return both.mapInArrow(run, "c1 BIGINT, c2 BIGINT, content BINARY").dropDuplicates(_CLASS)


def _split(buckets: DataFrame, width: int) -> DataFrame:
    """Cut the anchor places of every bucket into ``FAN`` ranges and refine it by the bytes all its windows share.

    A window whose anchor stands ``o`` bytes after its start covers the bytes from
    ``place - o`` on; for places from ``low`` to ``high`` those from ``place - low``
    to ``place - high + width - 1`` are in every window.
    """
    step = F.ceil((F.col("high") - F.col("low") + 1) / FAN).cast("int")

    def share(i: int) -> Column:
        low = F.col("low") + i * step
        high = F.least(F.col("high"), low + step - 1)
        shared = F.substring(
            F.col("content"), F.col("place") - low + 1, F.lit(width) - (high - low)
        )
        return F.struct(
            F.unhex(F.md5(F.concat(F.col("bucket"), F.encode(low.cast("string"), "utf-8"), shared))).alias("bucket"),
            low.alias("low"),
            high.alias("high"),
        )

    part = F.col("part")
    return (
        buckets.select(*_CLASS, "times", "content", "place", "n", "low", "high", "bucket")
        .withColumn("part", F.explode(F.array(*[share(i) for i in range(FAN)])))
        .filter(part["low"] <= part["high"])
        # Windows of the class start at 0 to n - 1, so their anchor places are place - n + 1 to place.
        .filter((part["low"] <= F.col("place")) & (part["high"] >= F.col("place") - F.col("n") + 1))
        .select(*_CLASS, "times", "content", "place", "n", part["low"].alias("low"), part["high"].alias("high"), part["bucket"].alias("bucket"))
    )


def _window_range() -> tuple[Column, Column]:
    """First and last window start of a class within the anchor places of its bucket."""
    first = F.greatest(F.lit(0), F.col("place") - F.col("high"))
    return first, F.least(F.col("n") - 1, F.col("place") - F.col("low"))


def _settler(width: int):
    """Refines sorted rows of small buckets, some whole buckets at a time.

    Equal windows are always in one bucket, so buckets need not be told apart.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        _, c1, c2, contents, firsts, lasts = zip(*rows)
        found = refine(list(contents), np.array(firsts), np.array(lasts), width)
        out = [(a, b, x["from"], x["to"]) for a, b, f in zip(c1, c2, found) for x in intervals(f)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["c1", "c2", "from", "to"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= BUCKET and held[-1][0] != row[0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return run


def _refined(buckets: DataFrame, width: int) -> DataFrame:
    """Repeated windows of every class of the branching buckets: c1, c2, from, to."""
    results: list[DataFrame] = []
    first, last = _window_range()
    while True:
        sized = buckets.join(
            buckets.groupBy("bucket").agg(F.count("*").alias("classes")).filter("classes > 1"), "bucket"
        )
        small = sized.filter(F.col("classes") <= BUCKET)

        results.append(
            small.select("bucket", *_CLASS, "content", first.alias("first_window"), last.alias("last_window"))
            .repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(_settler(width), "c1 BIGINT, c2 BIGINT, `from` INT, `to` INT")
        )
        large = sized.filter(F.col("classes") > BUCKET)
        # One anchor place left: the windows of such a bucket are equal.
        results.append(large.filter("low = high").select(*_CLASS, first.alias("from"), last.alias("to")))
        large = large.filter("low < high")
        if not large.limit(1).count():
            break
        buckets = written(_split(large, width), "buckets")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _repeated(rows: DataFrame, units: Units) -> DataFrame:
    """Covered windows (first, last) of each document, as one list per row."""
    found = repeated_runs(rows, units, with_prints=False)
    classes = written(
        found.groupBy(*_CLASS, "anchor", "n", "place").agg(
            F.count("*").alias("times"), F.min(F.struct("text_key", "doc", "first")).alias("at")
        ),
        "classes",
    )
    paths = classes.groupBy("anchor").agg(F.count("*").alias("paths"))
    branching = classes.join(paths.filter("paths > 1").select("anchor"), "anchor").select(
        *_CLASS, "anchor", "n", "place", "times", F.col("at.doc").alias("doc"),
        F.col("at.text_key").alias("text_key"), F.col("at.first").alias("first"),
    )
    branching = written(branching, "branching")
    buckets = branching.join(_contents(rows, branching, units.width), _CLASS).select(
        *_CLASS, "times", "content", "place", "n",
        F.lit(0).alias("low"), F.lit(units.width - units.k).alias("high"),
        F.encode(F.col("anchor").cast("string"), "utf-8").alias("bucket"),
    )
    single = _refined(written(buckets, "buckets"), units.width)
    whole = classes.filter("times > 1").select(*_CLASS, F.lit(0).alias("from"), (F.col("n") - 1).alias("to"))
    parts = written(
        single.unionByName(whole).groupBy(*_CLASS).agg(F.collect_list(F.struct("from", "to")).alias("parts")), "parts"
    )
    part = F.col("part")
    return (
        found.select("doc", "text_key", *_CLASS, "first")
        .join(parts, _CLASS)
        .select("doc", "text_key", "first", F.explode("parts").alias("part"))
        .select("doc", "text_key", (F.col("first") + part["from"]).alias("a"), (F.col("first") + part["to"]).alias("b"))
        .groupBy("doc", "text_key")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )


def drop_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept (bytes).

    A byte of the UTF-8 text goes if a string of ``width`` bytes covers it that also
    starts anywhere else, in the same document or another; strings may overlap and
    are those of the given texts.  ``n_spans`` counts the maximal removed stretches.
    What is kept may end inside a character, so it is BINARY.  A null text is empty.
    Repeated rows are documents of their own and remove each other, other columns
    are ignored, and an empty table gives no rows.
    """
    units = Units(False, width, gram)
    rows = keyed(docs, id_col, text)
    removals = written(_repeated(rows, units), "removals")
    same = (F.col("t.text_key") == F.col("r.text_key")) & F.col("t.doc").eqNullSafe(F.col("r.doc"))
    both = (
        squeezed(rows).alias("t").join(removals.alias("r"), same, "left").select("t.doc", "t.text", "r.spans")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, stretches, kept = [], [], [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                data = np.frombuffer(unsqueezed(packed.as_py()), dtype=np.uint8)
                gone = covered(len(data), spans, width)
                sizes.append(len(data))
                removed.append(int(gone.sum()))
                stretches.append(int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1)))
                kept.append(data[~gone].tobytes())
            counts = [pa.array(x, pa.int64()) for x in (sizes, removed, stretches)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(kept, pa.binary())],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return both.mapInArrow(
        run, "doc BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, kept BINARY"
    ).withColumnRenamed("doc", id_col)
