"""Candidate regions for the two substring operators.

Both look for equal windows of many units: 50 words or 400 bytes.  A window is
found through its anchor, the least k-mer in it (see ``windows``).  Anchors are
counted over all documents; only runs of windows whose anchor occurs at least
twice go on, and runs with equal content form one class, so copies of a passage
are one row however many documents hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.llm.common import text_or_empty, written
from promptward.llm.windows import mix, pieces, powers, runs, word_hashes, word_spans

#: Bits of the filter over repeated anchors: sixteen for each, up to this bound (16 MB).
FILTER_BITS = 1 << 27
_BLOCK = 1 << 16
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Runs in one batch on the way to Spark.
BATCH = 20_000
LAST = (1 << 63) - 1

RUNS = (
    "doc BIGINT, text_key BIGINT, anchor BIGINT, c1 BIGINT, c2 BIGINT, first BIGINT, n INT, place INT, prints BINARY"
)


def separators(data: np.ndarray) -> np.ndarray:
    """ASCII white space: blank and the characters 9 to 13."""
    return (data == 32) | ((data >= 9) & (data <= 13))


class Units:
    """What a window is made of: words of ``width`` 50 or bytes of ``width`` 400."""

    def __init__(self, words: bool, width: int, k: int):
        self.words, self.width, self.k = words, width, k

    def hashes(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit values per unit."""
        data = np.frombuffer(text, dtype=np.uint8)
        if not self.words:
            one = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))
            two = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 40))
            return one[data], two[data]
        starts, ends = word_spans(data, separators(data))
        return tuple(word_hashes(data, starts, ends, f) for f in _FACTORS)


def _sums(units: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.concatenate(([np.uint64(0)], np.cumsum(units * powers(len(units), factor))))
    return total, powers(len(units) + 1, pow(factor, -1, 1 << 64))


def _span_hash(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, back = sums
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Document id, a key of its text, and the text; null texts are empty."""
    body = text_or_empty(text)
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(body).alias("text_key"), body.alias("text")
    )


def _anchors(rows: DataFrame, units: Units) -> DataFrame:
    """The anchor of every run of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i, text in enumerate(batch.column(0)):
                values, _ = units.hashes(text.as_py().encode())
                for a, b in pieces(len(values), units.width):
                    found = runs(values[a:b], units.width, units.k)[0]
                    out.append(found)
                    held += len(found)
                if out and (held >= BATCH or i + 1 == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out), pa.int64())], names=["anchor"])
                    out, held = [], 0

    return rows.select("text").mapInArrow(run, "anchor BIGINT")


def repeated_anchors(rows: DataFrame, units: Units) -> DataFrame:
    """Anchors that start at least two runs."""
    counts = _anchors(rows, units).groupBy("anchor").agg(F.count("*").alias("n"))
    return written(counts.filter("n > 1").select("anchor"), "anchors")


def anchor_filter(anchors: DataFrame) -> np.ndarray:
    """A bit per slot that some repeated anchor falls into; of bounded size."""
    n = anchors.count()
    bits = _BLOCK
    while bits < min(16 * n, FILTER_BITS):
        bits *= 2
    slot = F.pmod(F.col("anchor"), F.lit(bits))

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(_BLOCK, dtype=bool)
        marks[block["at"].to_numpy()] = True
        return pd.DataFrame({"block": [block["block"].iloc[0]], "bits": [np.packbits(marks).tobytes()]})

    filled = (
        anchors.select(F.floor(slot / _BLOCK).cast("int").alias("block"), (slot % _BLOCK).cast("int").alias("at"))
        .distinct()
        .groupBy("block")
        .applyInPandas(fill, "block INT, bits BINARY")
    )
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in filled.collect():  # at most FILTER_BITS in all
        at = row["block"] * _BLOCK // 8
        out[at : at + _BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def repeated_runs(rows: DataFrame, units: Units, with_prints: bool) -> DataFrame:
    """Runs whose anchor may be repeated, with a 128-bit hash of their content.

    ``prints`` holds the 128-bit hashes of the run's windows where asked for.
    """
    marks = rows.sparkSession.sparkContext.broadcast(anchor_filter(repeated_anchors(rows, units)))

    def of_text(text: bytes) -> Iterator[tuple]:
        values, others = units.hashes(text)
        if len(values) < units.width:
            return
        known = marks.value
        sums = None
        for a, b in pieces(len(values), units.width):
            anchor, place, first, last = runs(values[a:b], units.width, units.k)
            slot = anchor % (len(known) * 8)
            keep = (known[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
            if not keep.any():
                continue
            sums = sums or (_sums(values, _FACTORS[0]), _sums(others, _FACTORS[1]))
            anchor, place = anchor[keep], place[keep] - first[keep]
            first, last = first[keep] + a, last[keep] + a
            ends = last + units.width
            prints = None
            if with_prints:
                n = last - first + 1
                starts = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = [_span_hash(s, starts, starts + units.width) for s in sums]
                blob, at = np.stack(both, axis=1).tobytes(), 16 * np.concatenate(([0], np.cumsum(n)))
                prints = [blob[x:y] for x, y in zip(at[:-1], at[1:])]
            contents = [_span_hash(s, first, ends).astype(np.int64) for s in sums]
            yield anchor, *contents, first, (last - first + 1).astype(np.int32), place.astype(np.int32), prints

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = 0, []
            for i in range(batch.num_rows):
                doc, key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for found in of_text(batch.column(2)[i].as_py().encode()):
                    out.append((doc, key, found))
                    held += len(found[0])
                if out and (held >= BATCH or i + 1 == batch.num_rows):
                    sizes = [len(f[0]) for _, _, f in out]
                    spread = [np.repeat(np.arange(len(out)), sizes)]
                    docs = pa.array([d for d, _, _ in out], pa.int64()).take(pa.array(spread[0]))
                    keys = pa.array([k for _, k, _ in out], pa.int64()).take(pa.array(spread[0]))
                    columns = [pa.array(np.concatenate([f[c] for _, _, f in out])) for c in range(6)]
                    if with_prints:
                        prints = pa.array([p for _, _, f in out for p in f[6]], pa.binary())
                    else:
                        prints = pa.nulls(held, pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [docs, keys, *columns, prints],
                        names=["doc", "text_key", "anchor", "c1", "c2", "first", "n", "place", "prints"],
                    )
                    held, out = 0, []

    return written(rows.select("doc", "text_key", "text").mapInArrow(run, RUNS), "runs")


def squeezed(rows: DataFrame) -> DataFrame:
    """The same rows with the text compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            packed = pa.array([tool.compress(x.as_py().encode()) for x in batch.column(at)], pa.binary())
            yield batch.set_column(at, "text", packed)

    kinds = ", ".join(f"{n} {'BINARY' if n == 'text' else t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, kinds)


def unsqueezed(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text) if text else b""


def owner(doc: str = "doc") -> Column:
    """The document id as a number that puts rows without an id last."""
    return F.coalesce(F.col(doc), F.lit(LAST))
