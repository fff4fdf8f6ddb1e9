"""Exact de-duplication against a minimal perfect hash of historical digests.

The history is a set of distinct text digests.  It is split into shards by digest
(uniform, so shards stay small and even), and each shard is a minimal perfect
hash: bit arrays of several levels in which every key of the shard has one bit of
its own; the rank of that bit is the slot.  A slot holds the whole digest and the
locator of the row that stays.  A lookup goes to one slot and compares all 32
bytes, so a text outside the history is never taken for a member; such texts are
grouped among themselves.

Hot groups: copies are counted per task before anything is shuffled, so neither a
shard nor a group ever holds more than one row per distinct text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptward.llm.common import digest, text_or_empty, unused, written
from promptward.llm.windows import mix

#: Distinct texts per shard, on average; a shard takes about 60 bytes for each.
SHARD_KEYS = 1 << 14
#: Bits per key of a level.
GAMMA = 2.0
#: Rows that one array may stand for when counted rows are laid out again.
BLOCK = 1 << 16

GROUP_SCHEMA = (
    "shard INT, digest BINARY, keep_id BIGINT, no_id BOOLEAN, n_first BIGINT, group_size BIGINT"
)
TABLE_SCHEMA = (
    "shard INT, levels ARRAY<BIGINT>, bits BINARY, digests BINARY, keep_ids BINARY, "
    "no_ids BINARY, n_first BINARY, sizes BINARY"
)


def normalised(text: str) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), "[\\x20\\x09-\\x0D]+", " ")


def _keys(digests: np.ndarray) -> np.ndarray:
    """Digests as rows of four 64-bit numbers."""
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 4)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seeded = mix(keys[:, 1] + np.uint64(level + 1) * (keys[:, 2] | np.uint64(1)))
    return (seeded % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their joined bits; ``keys`` are distinct."""
    sizes, bits = [], []
    left = keys
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        place = _places(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level has its bit."""
    rank = np.cumsum(bits) - 1
    slots = np.full(len(keys), -1, dtype=np.int64)
    waiting = np.arange(len(keys))
    base = 0
    for level, size in enumerate(sizes):
        place = base + _places(keys[waiting], level, size)
        hit = bits[place]
        slots[waiting[hit]] = rank[place[hit]]
        waiting = waiting[~hit]
        base += size
    return slots


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(b"".join(rows["digest"]))
    sizes, bits = build_hash(keys)
    order = np.argsort(find_slots(keys, sizes, bits))
    column = lambda name, kind: rows[name].to_numpy()[order].astype(kind).tobytes()
    return pd.DataFrame(
        {
            "shard": [rows["shard"].iloc[0]],
            "levels": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [keys[order].tobytes()],
            "keep_ids": [column("keep_id", "<i8")],
            "no_ids": [column("no_id", "u1")],
            "n_first": [column("n_first", "<i8")],
            "sizes": [column("group_size", "<i8")],
        }
    )


def build_table(history: DataFrame) -> DataFrame:
    """One perfect hash with its slots per shard, of a table of ``GROUP_SCHEMA``."""
    return history.groupBy("shard").applyInPandas(_build_shard, TABLE_SCHEMA)


def _merge_shard(incoming: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    """Groups of a shard: the members' counts are added to their slots."""
    if not len(table):
        return incoming
    row = table.iloc[0]
    sizes = [int(x) for x in row["levels"]]
    held = _keys(row["digests"])
    out = pd.DataFrame(
        {
            "shard": row["shard"],
            "digest": [x.tobytes() for x in held],
            "keep_id": np.frombuffer(row["keep_ids"], "<i8"),
            "no_id": np.frombuffer(row["no_ids"], "u1").astype(bool),
            "n_first": np.frombuffer(row["n_first"], "<i8"),
            "group_size": np.frombuffer(row["sizes"], "<i8").copy(),
        }
    )
    if not len(incoming):
        return out
    bits = np.unpackbits(np.frombuffer(row["bits"], "u1"), count=sum(sizes)).astype(bool)
    keys = _keys(b"".join(incoming["digest"]))
    slots = find_slots(keys, sizes, bits)
    member = slots >= 0
    member[member] = (held[slots[member]] == keys[member]).all(axis=1)
    out_sizes = out["group_size"].to_numpy().copy()
    np.add.at(out_sizes, slots[member], incoming["group_size"].to_numpy()[member])
    out["group_size"] = out_sizes
    return pd.concat([out, incoming[~member]], ignore_index=True)


def _grouped(rows: DataFrame, shards: int) -> DataFrame:
    """One row per digest of (digest, id, n) rows: the first id, null last, and the counts."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("n"))).alias("first")
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")
    return rows.groupBy("digest").agg(first, F.sum("n").alias("group_size")).select(
        shard.alias("shard"),
        "digest",
        F.coalesce("first.id", F.lit(0)).cast("bigint").alias("keep_id"),
        F.col("first.no_id").alias("no_id"),
        F.col("first.n").alias("n_first"),
        "group_size",
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", history_share: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Counted rows (digest, id, n) and one row per distinct text (``GROUP_SCHEMA``).

    The rows with the lowest ids, about ``history_share`` of all, are the history
    that the perfect hash is built over; the others are looked up in it.  The
    result does not depend on that share.
    """
    counted = written(
        docs.select(F.col(id_col).cast("bigint").alias("id"), digest(normalised(text)).alias("digest"))
        .groupBy("digest", "id")
        .agg(F.count("*").alias("n")),
        "digests",
    )
    size = counted.agg(
        F.count("*").alias("rows"), F.percentile_approx("id", history_share).alias("bound")
    ).first()
    shards = max(1, -(-size["rows"] // SHARD_KEYS))
    old = F.coalesce(F.col("id") < F.lit(size["bound"]).cast("bigint"), F.lit(False))
    table = build_table(_grouped(counted.filter(old), shards))
    incoming = _grouped(counted.filter(~old), shards)
    groups = (
        incoming.groupBy("shard").cogroup(table.groupBy("shard")).applyInPandas(_merge_shard, GROUP_SCHEMA)
    )
    return counted, written(groups, "groups")


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", history_share: float = 0.5
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Texts are equal when they agree after white space is normalised; a null text
    is empty, and empty texts are equal to each other.  Of equal texts the row
    with the smallest id stays, a null id counting as larger than all others; of
    rows that agree in id and text exactly one stays.  Ids are read as BIGINT, other
    columns are ignored.  An empty table gives an empty result.
    """
    counted, groups = duplicate_groups(docs, id_col, text, history_share)
    found = groups.select(
        "digest", F.when(~F.col("no_id"), F.col("keep_id")).alias("keep_id"), "group_size"
    )
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("block")
    copies = F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)
    return (
        counted.join(found, "digest")
        .select("*", blocks)
        .select("*", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("block") == 0) & (F.col("copy") == 1)).alias(
                "kept"
            ),
            "digest",
        )
    )


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", history_share: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Of rows that agree in id and text one is kept, whichever comes first.
    """
    _, groups = duplicate_groups(docs, id_col, text, history_share)
    key, keep, times = (unused(docs, n) for n in ("text_digest", "keep_this", "times_first"))
    winners = groups.select(
        F.col("digest").alias(key),
        F.when(~F.col("no_id"), F.col("keep_id")).alias(keep),
        F.col("n_first").alias(times),
    )
    rows = docs.withColumn(key, digest(normalised(text)))
    same = rows[key] == winners[key]
    first = rows[id_col].cast("bigint").eqNullSafe(winners[keep])

    def of(part: DataFrame) -> DataFrame:
        return rows.join(part.hint("merge"), same & first, "left_semi")

    kept = of(winners.filter(F.col(times) == 1))
    repeated = winners.filter(F.col(times) > 1)
    if repeated.limit(1).count():
        kept = kept.unionByName(of(repeated).dropDuplicates([key, id_col]))
    return kept.select(*docs.columns)

