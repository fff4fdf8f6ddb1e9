"""Phrase collocation mining by direct-address tiling.

Words of a language that occur often enough get ids in order of their frequency, so the
pairs of frequent words lie together in the low corner of the table of all pairs.  That
table is cut into square tiles.  A task counts the pairs of a chunk of text tile by tile:
a tile with many pairs is a dense array counted by ``bincount``, one with few is a sorted
coordinate list.  Counts of all tasks are summed by pair.  The frequent pairs get ids
in order of their frequency again, and two overlapping ones in a row are a
phrase of three words, counted in the same way; so it goes on up to the longest phrase.

A chunk is a few megabytes of one language's text as ids, one row of a written table; it
has its own short list of the distinct things in it.  Their global ids come from a table that is
sent to all tasks while it is small (``SENT`` rows), and beyond that through a join, in which a word
that is in every chunk is spread over ``SALTS`` keys.

Each candidate phrase is scored at its weakest cut, and goes where a longer candidate
occurs just as often and holds it.

Null text is an empty one, null ``lang`` is ``und``.  Rows with equal ids or texts count each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptward.llm.common import text_or_empty, written

LONGEST, AT_LEAST, TOP = 5, 100, 2000
#: UTF-8 bytes of text of one chunk, about.
CHUNK = 2 << 20
#: Frequent things that are sent to every task; where there are more, chunks and things are joined.
SENT = 1 << 18
#: Words of the corpus for each part that counts are summed in, and chunks that are summed together.
PART, TOGETHER = 1 << 20, 1 << 12
#: Side of a tile; a tile with a pair for every ``DENSE`` cells at least is counted as an array.
TILE, DENSE = 512, 8
SALTS = 8
#: Lower-cases A-Z, makes one break of all that ends a piece, and one blank of all between words.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b in b" \t" else b for b in range(256)
)

# Lists travel as bytes, which the JVM hands on as they are: numbers as 32 or 64 bits each, names
# joined by blanks, which no name holds.
CHUNKS = "chunk BIGINT, lang STRING, words BIGINT, ids BINARY, names BINARY, counts BINARY"
PAIRS = "chunk BIGINT, lang STRING, ids BINARY, keys BINARY, counts BINARY"
PARTS = "lang STRING, part BIGINT, salt INT, things BINARY, counts BINARY"


def words_of(texts: list[str]) -> list[bytes]:
    """Words of all texts in order; ``.`` stands wherever a piece ends."""
    return b"\n".join(t.encode("utf-8", "surrogatepass") for t in texts).translate(_TABLE).replace(b".", b" . ").split()


def chunks(docs: DataFrame) -> DataFrame:
    """Text as chunks of local ids: 0 ends a piece, i stands for the i-th name of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[str]] = {}
        size: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                waiting.setdefault(lang, []).append(text)
                size[lang] += len(text) + 1
                if size[lang] >= CHUNK:
                    yield row(number, lang, waiting.pop(lang))
                    number += 1
                    del size[lang]
        for lang, texts in waiting.items():
            yield row(number, lang, texts)
            number += 1

    def row(number: int, lang: str, texts: list[str]) -> pa.RecordBatch:
        words = words_of(texts)
        times = Counter(words)
        times.pop(b".", None)
        place = {w: i for i, w in enumerate(times, 1)}
        place[b"."] = 0
        ids = np.fromiter(map(place.__getitem__, words), dtype=np.int32, count=len(words))
        counts = np.fromiter(times.values(), dtype=np.int64, count=len(times))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([lang]),
                pa.array([int(counts.sum())], pa.int64()),
                pa.array([ids.tobytes()], pa.binary()),
                pa.array([b" ".join(times)], pa.binary()),
                pa.array([counts.tobytes()], pa.binary()),
            ],
            names=["chunk", "lang", "words", "ids", "names", "counts"],
        )

    text = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty("text").alias("text"))
    return text.mapInArrow(run, CHUNKS)


def tiled(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, their numbers, and for every given pair its place among them.

    A pair is ``left * width + right``; both are ranks, the most frequent 0.
    """
    left, right = keys // width, keys % width
    across = width // TILE + 1
    tile = (left // TILE) * across + right // TILE
    cell = (left % TILE) * TILE + right % TILE
    order = np.argsort(tile, kind="stable")
    cuts = np.flatnonzero(np.diff(tile[order], prepend=-1, append=-1))
    place = np.empty(len(keys), dtype=np.int64)
    found, numbers, known, sparse = [], [], 0, []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        rows = order[a:b]
        if (b - a) * DENSE < TILE * TILE:
            sparse.append(rows)
            continue
        times = np.bincount(cell[rows], minlength=TILE * TILE)
        there = np.flatnonzero(times)
        rank = np.empty(TILE * TILE, dtype=np.int64)
        rank[there] = np.arange(len(there)) + known
        place[rows] = rank[cell[rows]]
        row, column = divmod(int(tile[rows[0]]), across)
        found.append((row * TILE + there // TILE) * width + column * TILE + there % TILE)
        numbers.append(times[there])
        known += len(there)
    if sparse:
        # Sparse tiles lie in order already: one sorted coordinate list holds them all.
        rows = np.concatenate(sparse)
        distinct, back, times = np.unique(keys[rows], return_inverse=True, return_counts=True)
        place[rows] = back + known
        found.append(distinct)
        numbers.append(times)
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, place
    return np.concatenate(found), np.concatenate(numbers).astype(np.int64), place


def ranked(counted: DataFrame, name: str) -> DataFrame:
    """``counted`` with ``id``: 1 for the most frequent, without gaps; equal counts in any fixed order."""
    ordered = written(
        counted.orderBy(F.desc("f"), "lang", *[c for c in counted.columns if c not in ("f", "lang")])
        .withColumn("part", F.spark_partition_id())
        .withColumn("row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    # One row per partition of the sort.
    sizes = {r[0]: r[1] for r in ordered.groupBy("part").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part] = total
        total += sizes[part]
    start = ordered.sparkSession.createDataFrame(list(before.items()), "part INT, before BIGINT")
    return ordered.join(F.broadcast(start), "part").withColumn("id", F.col("row") + F.col("before") + 1).drop("part", "row", "before")


def _unpacked(things: bytes, key: str) -> np.ndarray:
    """The names or keys of a list."""
    return np.array(things.split(), dtype=object) if key == "names" else np.frombuffer(things, dtype=np.int64)


def _packed(things: np.ndarray, key: str) -> bytes:
    return b" ".join(things.tolist()) if key == "names" else things.tobytes()


def _part(things: np.ndarray, key: str, parts: int) -> np.ndarray:
    """The part of each thing, from its value alone."""
    if key == "names":
        return np.fromiter((zlib.crc32(t) % parts for t in things), dtype=np.int64, count=len(things))
    mixed = things.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _summed(rows: pa.Table, key: str, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct things of the lists of all rows and their sums, where they reach ``at_least``."""
    lists = [_unpacked(t, key) for t in rows.column("things").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in rows.column("counts").to_pylist()])
    things = np.concatenate(lists)
    if key == "names":
        times: Counter = Counter()
        for t, n in zip(things.tolist(), counts.tolist()):
            times[t] += n
        distinct, total = np.array(list(times), dtype=object), np.fromiter(times.values(), np.int64, len(times))
    else:
        order = np.argsort(things, kind="stable")
        things, counts = things[order], counts[order]
        first = np.flatnonzero(np.diff(things, prepend=things[:1] - 1))
        distinct, total = things[first], np.add.reduceat(counts, first) if len(first) else counts[:0]
    often = total >= at_least
    return distinct[often], total[often]


def frequent(table: DataFrame, key: str, at_least: int, words: int, name: str) -> DataFrame:
    """Things of all chunks that occur ``at_least`` times: lang, key, f, id.

    The counts of a chunk are lists, dealt to parts by a hash of the thing; a part is a row, and
    so large that its lists from all chunks fit a task whatever the corpus.  Where there
    are many chunks, the rows of a part are summed in groups of chunks first.
    """
    one = key[:-1]
    parts = max(1, -(-words // PART))
    groups = max(1, -(-(words * 8 // CHUNK) // TOGETHER))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, lang, things, counts = (c[at].as_py() for c in batch.columns)
                things, counts = _unpacked(things, key), np.frombuffer(counts, dtype=np.int64)
                of = _part(things, key, parts)
                order = np.argsort(of, kind="stable")
                cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1)).tolist()
                rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(rows), pa.string()),
                        pa.array([int(of[r[0]]) for r in rows], pa.int64()),
                        pa.array([chunk % groups] * len(rows), pa.int32()),
                        pa.array([_packed(things[r], key) for r in rows], pa.binary()),
                        pa.array([counts[r].tobytes() for r in rows], pa.binary()),
                    ],
                    names=["lang", "part", "salt", "things", "counts"],
                )

    def halfway(part: pa.Table) -> pa.Table:
        things, counts = _summed(part, key, 1)
        lists = [pa.array([x], pa.binary()) for x in (_packed(things, key), counts.tobytes())]
        return pa.table([*(part.column(c).slice(0, 1) for c in ("lang", "part", "salt")), *lists], names=part.column_names)

    def finish(part: pa.Table) -> pa.Table:
        things, counts = _summed(part, key, at_least)
        lang = pa.array([part.column("lang")[0].as_py()] * len(things), pa.string())
        shown = pa.array([t.decode("utf-8", "surrogatepass") for t in things], pa.string()) if key == "names" else pa.array(things)
        return pa.table({"lang": lang, one: shown, "f": pa.array(counts)})

    dealt = table.select("chunk", "lang", key, "counts").mapInArrow(deal, PARTS)
    if groups > 1:
        dealt = dealt.groupBy("lang", "part", "salt").applyInArrow(halfway, PARTS)
    item = "STRING" if key == "names" else "BIGINT"
    counted = dealt.groupBy("lang", "part").applyInArrow(finish, f"lang STRING, {one} {item}, f BIGINT")
    return written(ranked(counted, name + "-sorted"), name)


def _paired(chunk: int, lang: str, ids: np.ndarray, names: np.ndarray, width: int) -> pa.RecordBatch:
    """A chunk of local ids as pairs of the global ids ``names`` gives them (0: not frequent), counted."""
    new = names[ids]
    left, right = new[:-1], new[1:]
    both = np.flatnonzero((left > 0) & (right > 0))
    keys, counts, place = tiled((left[both] - 1) * width + right[both] - 1, width)
    local_ids = np.zeros(len(left), dtype=np.int32)
    local_ids[both] = place + 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([chunk], pa.int64()),
            pa.array([lang]),
            pa.array([local_ids.tobytes()], pa.binary()),
            pa.array([keys.tobytes()], pa.binary()),
            pa.array([counts.tobytes()], pa.binary()),
        ],
        names=["chunk", "lang", "ids", "keys", "counts"],
    )


def renamed(table: DataFrame, key: str, known: DataFrame, width: int) -> DataFrame:
    """Chunks with pairs of global ids in place of local ones, counted: chunk, lang, ids, keys, counts.

    A local id whose thing is not frequent becomes a break.  Position i of the new ids
    stands for the two overlapping things that begin at i.  Up to ``SENT`` frequent things go to
    every task; more of them meet the chunks that hold them through a join.
    """
    if known.limit(SENT + 1).count() <= SENT:
        return _renamed_by_table(table, key, known, width)
    return _renamed_by_join(table, key, known, width)


def _renamed_by_table(table: DataFrame, key: str, known: DataFrame, width: int) -> DataFrame:
    tables: dict[str, dict] = {}
    for lang, thing, number in zip(*(c.to_pylist() for c in known.select("lang", key[:-1], "id").toArrow().columns)):
        thing = thing.encode("utf-8", "surrogatepass") if key == "names" else thing
        tables.setdefault(lang, {})[thing] = number
    sent = table.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, lang, ids, own = (c[at].as_py() for c in batch.columns)
                if lang in tables and own:
                    own, known = _unpacked(own, key).tolist(), tables[lang]
                    names = np.zeros(len(own) + 1, dtype=np.int64)
                    names[1:] = np.fromiter((known.get(t, 0) for t in own), dtype=np.int64, count=len(own))
                    yield _paired(chunk, lang, np.frombuffer(ids, dtype=np.int32), names, width)

    return table.select("chunk", "lang", "ids", key).mapInArrow(run, PAIRS)


def _renamed_by_join(table: DataFrame, key: str, known: DataFrame, width: int) -> DataFrame:
    one = key[:-1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk, lang, own = (c[at].as_py() for c in batch.columns)
                own = _unpacked(own, key)
                shown = pa.array([t.decode("utf-8", "surrogatepass") for t in own], pa.string()) if key == "names" else pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), chunk, dtype=np.int64)),
                        pa.array([lang] * len(own), pa.string()),
                        pa.array(np.arange(len(own), dtype=np.int32)),
                        shown,
                    ],
                    names=["chunk", "lang", "local", one],
                )

    item = "STRING" if key == "names" else "BIGINT"
    own = table.select("chunk", "lang", key).mapInArrow(spread, f"chunk BIGINT, lang STRING, local INT, {one} {item}")
    own = own.withColumn("salt", F.pmod("chunk", F.lit(SALTS)).cast("int"))
    salted = known.select("lang", one, "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mapped = own.join(salted, ["lang", one, "salt"]).select("chunk", "local", "id").toDF("of", "local", "id")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids = np.frombuffer(left.column("ids")[0].as_py(), dtype=np.int32)
        names = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
        names[right.column("local").to_numpy() + 1] = right.column("id").to_numpy()
        batch = _paired(left.column("chunk")[0].as_py(), left.column("lang")[0].as_py(), ids, names, width)
        return pa.Table.from_batches([batch])

    blobs = [(c, pa.binary()) for c in ("ids", "keys", "counts")]
    schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), *blobs])
    chunks = table.select("chunk", "lang", "ids")
    return chunks.groupBy("chunk").cogroup(mapped.groupBy("of")).applyInArrow(run, PAIRS)


def phrases(docs: DataFrame, longest: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur ``at_least`` times (lang, phrase, size, f), and n per lang."""
    table = written(chunks(docs), "chunks")
    n = table.groupBy("lang").agg(F.sum("words").alias("n"))
    words = table.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    known = frequent(table, "names", at_least, words, "words")
    spelled = known.select("lang", "id", F.col("name").alias("phrase"), F.col("name").alias("last"), "f")
    out = spelled.select("lang", "phrase", F.lit(1).alias("size"), "f")
    key = "names"
    for size in range(2, longest + 1):
        width = known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        if not width:
            break
        table = written(renamed(table, key, known, width), f"pairs-{size}")
        key = "keys"
        known = frequent(table, key, at_least, words, f"phrases-{size}")
        # A pair of things is the first one and the last word of the second.
        first = spelled.select("lang", F.col("id").alias("one"), "phrase")
        second = spelled.select("lang", F.col("id").alias("two"), "last")
        pairs = known.select("lang", "id", "f", F.expr(f"key div {width} + 1").alias("one"), F.expr(f"key % {width} + 1").alias("two"))
        spelled = written(
            pairs.join(first, ["lang", "one"])
            .join(second, ["lang", "two"])
            .select("lang", "id", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f"),
            f"spelled-{size}",
        )
        out = out.unionByName(spelled.select("lang", "phrase", F.lit(size).alias("size"), "f"))
    return out, n


def _score(a: Column, l: Column, r: Column, n: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in exact decimals: no count passes 10**14, no product 10**38."""

    def wide(c: Column) -> Column:
        return c.cast("decimal(16,0)")

    up = (wide(a) * wide(n)).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    down = (wide(l) * wide(r)).cast("decimal(38,0)")
    return F.call_function("div", up.cast("decimal(38,0)"), down)


def collocations(docs: DataFrame, longest: int = LONGEST, at_least: int = AT_LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    found, n = phrases(docs.select("text", "lang"), longest, at_least)
    found = written(found, "frequent-phrases")
    long = found.filter("size > 1").select("lang", "phrase", F.col("size"), F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("w", start, length), " ")

    k = F.col("k")
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "size", "a", "k", joined(F.lit(1), k).alias("first"), joined(k + 1, F.col("size") - k).alias("rest")
    )
    scored = (
        cuts.join(part.withColumnsRenamed({"part": "first", "part_f": "l"}), ["lang", "first"])
        .join(part.withColumnsRenamed({"part": "rest", "part_f": "r"}), ["lang", "rest"])
        .join(F.broadcast(n), "lang")
        .withColumn("score", _score(F.col("a"), F.col("l"), F.col("r"), F.col("n")))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )
    inner = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = (
        long.filter("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("outer"))
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        scored.join(inside, ["lang", "phrase"], "left")
        .filter("outer IS NULL OR outer < a")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
