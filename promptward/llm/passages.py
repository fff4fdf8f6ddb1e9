"""Removal of long word passages that an earlier document already has.

The k-word anchors are the edges of a sparse De Bruijn graph: every window of
``width`` words holds one, and equal windows hold the same.  Edges seen once drop
out.  The maximal stretch of windows around an edge is a path; paths with equal
words are compacted into one class by a grouping join.  An edge with a single class
does not branch: all its occurrences share all its windows.  The classes of a
branching edge are taken apart into windows, which are grouped by their words.
The source coordinates of every class then say which words of which document are
covered by a window that starts in an earlier document too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptward.llm.common import written
from promptward.llm.repeats import Units, keyed, owner, repeated_runs, separators, squeezed, unsqueezed
from promptward.llm.windows import word_spans

WIDTH = 50
GRAM = 16
_CLASS = ["anchor", "c1", "c2"]


def _path_results(found: DataFrame) -> DataFrame:
    """Per class: parts (from, to, least) of its windows with the first document that has them."""
    classes = written(
        found.groupBy(*_CLASS, "n").agg(F.min(owner()).alias("least"), F.count("*").alias("times")), "paths"
    )
    edges = classes.groupBy("anchor").agg(F.count("*").alias("paths"), F.sum("times").alias("times"))
    repeated = edges.filter("times > 1")
    whole = classes.join(repeated.filter("paths = 1").select("anchor"), "anchor").select(
        *_CLASS, F.lit(0).alias("from"), (F.col("n") - 1).alias("to"), "least"
    )

    branching = written(
        found.join(repeated.filter("paths > 1").select("anchor"), "anchor")
        .groupBy(*_CLASS)
        .agg(F.min(owner()).alias("own"), F.first("prints").alias("prints")),
        "branching",
    )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(p.as_py()) // 16 for p in batch.column("prints")]
            values = np.frombuffer(b"".join(p.as_py() for p in batch.column("prints")), "<i8").reshape(-1, 2)
            back = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            index = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]) if sizes else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(back) for c in (*_CLASS, "own")]
                + [pa.array(index), pa.array(values[:, 0]), pa.array(values[:, 1])],
                names=[*_CLASS, "own", "i", "w1", "w2"],
            )

    single = branching.mapInArrow(
        windows, "anchor BIGINT, c1 BIGINT, c2 BIGINT, own BIGINT, i INT, w1 BIGINT, w2 BIGINT"
    )
    first = single.groupBy("w1", "w2").agg(F.min("own").alias("least"))
    parts = single.join(first, ["w1", "w2"]).select(
        *_CLASS, F.col("i").alias("from"), F.col("i").alias("to"), "least"
    )
    return (
        whole.unionByName(parts).groupBy(*_CLASS).agg(F.collect_list(F.struct("from", "to", "least")).alias("parts"))
    )


def _removals(found: DataFrame) -> DataFrame:
    """Covered windows (first, last) of each document, as one list per row."""
    part = F.col("part")
    return (
        found.select("doc", "text_key", *_CLASS, "first")
        .join(_path_results(found), _CLASS)
        .select("doc", "text_key", "first", F.explode("parts").alias("part"))
        .filter(part["least"] < owner())
        .select("doc", "text_key", (F.col("first") + part["from"]).alias("a"), (F.col("first") + part["to"]).alias("b"))
        .groupBy("doc", "text_key")
        .agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    )


def drop_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (text).

    Words are runs of anything but ASCII white space.  A word goes if a window of
    ``width`` words covers it whose words also start in a document with a smaller
    id; windows are those of the given texts.  Rows that share an id never remove
    each other's words, and a row without an id counts as later than all others.
    The kept words are joined by one space.  A null text has no words.  Repeated
    rows each get their row, other columns are ignored, an empty table gives none.
    """
    units = Units(True, width, gram)
    rows = keyed(docs, id_col, text)
    removals = written(_removals(repeated_runs(rows, units, with_prints=True)), "removals")
    same = (F.col("t.text_key") == F.col("r.text_key")) & F.col("t.doc").eqNullSafe(F.col("r.doc"))
    both = (
        squeezed(rows).alias("t").join(removals.alias("r"), same, "left").select("t.doc", "t.text", "r.spans")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                body = unsqueezed(packed.as_py())
                data = np.frombuffer(body, dtype=np.uint8)
                starts, ends = word_spans(data, separators(data))
                gone = covered(len(starts), spans, width)
                words = [body[a:b] for a, b in zip(starts[~gone], ends[~gone])]
                counts.append(len(starts))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc", "n_words", "n_removed", "kept"],
            )

    return both.mapInArrow(run, "doc BIGINT, n_words BIGINT, n_removed BIGINT, kept STRING").withColumnRenamed(
        "doc", id_col
    )


def covered(n: int, spans: pa.Scalar, width: int) -> np.ndarray:
    """Which of ``n`` units the windows (first, last start) of ``width`` units cover."""
    gone = np.zeros(n + 1, dtype=np.int64)
    if spans.is_valid:
        fields = spans.values
        np.add.at(gone, fields.field("a").to_numpy(), 1)
        np.add.at(gone, fields.field("b").to_numpy() + width, -1)
    return np.cumsum(gone)[:n] > 0
