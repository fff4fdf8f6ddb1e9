"""Toxicity scores from the nearest labelled examples, by exact TF-IDF cosine.

Fitting takes a bounded sample of the labelled rows, ``SAMPLE`` of each label and
``SAMPLE_BYTES`` of their texts at most, chosen by a hash of the id; equal texts of one label
count once, equal texts of both labels stay both.  All words of the examples enter the
vectors, as 64-bit hashes.  A word weighs its TF-IDF, with document frequencies counted over all
documents, times the normal deviate of its share between the labels, 1 at least.  (Without
that factor the words that mark a label drown in the others: on the largest small tables
half of the held-out toxic rows are found instead of nine in ten.)

The examples form a block-max inverted index: for every word, the examples that hold it by
blocks, with the largest weight in each block.  The blocks of a query are visited in order of
the bound that these weights give, and the search ends as soon as no block left can reach the
k-th best cosine.  The neighbours are exact.  They vote with a weight that falls with their distance;
votes are corrected for the sampling and calibrated on the sample itself, each example
searched without itself.

Labels other than 0 and 1, labels of null ids, labels of documents that are not there and labels
that are held out are left out.  Without any label left every score is 0.  Null text is an empty one;
a text without words of the examples has no neighbours and the rate of such texts in the sample.
An id with both labels gives an example of each.  Ties between neighbours go to the earlier example.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptward.llm.common import digest, text_or_empty, unused, written
from promptward.llm.windows import word_hashes, word_spans

#: Labelled rows of each label that the model is fitted on, and UTF-8 bytes of their texts, at most.
SAMPLE, SAMPLE_BYTES = 1_000, 32 << 20
#: Sample rows of each label that the votes are calibrated on, at most.
CALIBRATION = 1_000
NEIGHBOURS = 15
#: Rows whose evidence a task holds at a time.
ROWS = 512
BLOCK = 32
#: Blocks that a search looks at before it bounds the others anew, and more than rounding loses.
TOGETHER = 8
SLACK = 1e-5
#: Votes at distance d weigh 1 / (SOFT + d); the prior weighs as one vote at distance 1.
SOFT = 0.05
BINS = 20
#: Every fifth labelled document, by a checksum of its id, is held out.
FOLDS = 5

_NO_LETTER = np.ones(256, dtype=bool)
_NO_LETTER[97:123] = _NO_LETTER[128:] = False
_HASH = 0x9E3779B97F4A7C15

VECTORS = "label INT, digest BINARY, id BIGINT, terms ARRAY<INT>, counts ARRAY<INT>"


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words in ascending order, and their counts."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    starts, ends = word_spans(data, _NO_LETTER[data])
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.unique(word_hashes(data, starts, ends, _HASH), return_counts=True)


def counted(numbers: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``numbers`` of the words that are there, and their counts."""
    hashes, counts = words_of(text)
    at = np.searchsorted(numbers, hashes)
    known = at < len(numbers)
    known[known] = numbers[at[known]] == hashes[known]
    return at[known], counts[known]


def unit_vector(values: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights = (1 + np.log(counts)) * values[terms]
    norm = np.sqrt((weights**2).sum())
    return terms, weights / norm if norm else weights


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range of each."""
    counts = ends - starts
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) + (starts - np.cumsum(counts) + counts)[of], of


class Index:
    """Examples as unit vectors, in blocks of ``BLOCK``: arrays only, so that it travels as it is.

    The lists of a word are split where a block ends.  List ``j`` holds the examples
    ``places[list_start[j]:list_start[j + 1]]``, all of block ``list_block[j]``, and their largest
    weight is ``list_max[j]``; word ``t`` has the lists from ``term_start[t]`` to ``term_start[t + 1]``.
    """

    def __init__(self, numbers: np.ndarray, values: np.ndarray, ids: list, labels: np.ndarray, vectors: list):
        self.numbers, self.values = numbers, values
        self.ids, self.labels, self.class_weight = ids, labels, np.zeros(2)
        self.prior = 0.0
        self.cuts, self.rates = np.zeros(0), np.zeros(1)
        self.n_blocks = -(-len(ids) // BLOCK)
        sizes = np.array([len(v[0]) for v in vectors], dtype=np.int64)
        terms = np.concatenate([np.zeros(0, dtype=np.int64), *[v[0] for v in vectors]])
        weights = np.concatenate([np.zeros(0), *[v[1] for v in vectors]])
        places = np.repeat(np.arange(len(vectors), dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        terms, self.places, self.weights = terms[order], places[order].astype(np.int64), weights[order]
        list_of = terms * max(1, self.n_blocks) + self.places // BLOCK
        self.list_start = np.flatnonzero(np.diff(list_of, prepend=-1, append=-1))
        if not len(terms):
            self.list_start = np.zeros(1, dtype=np.int64)
        first = self.list_start[:-1]
        self.list_block = (self.places[first] // BLOCK).astype(np.int32)
        self.list_max = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.term_start = np.searchsorted(terms[first], np.arange(len(values) + 1))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return unit_vector(self.values, *counted(self.numbers, text))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> list[tuple[float, int]]:
        """The ``NEIGHBOURS`` examples of largest positive cosine, as (cosine, example)."""
        lists, of = _ranges(self.term_start[terms], self.term_start[terms + 1])
        if not len(lists):
            return []
        weight, block = weights[of], self.list_block[lists]
        bound = np.bincount(block, self.list_max[lists] * weight, self.n_blocks) + SLACK
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > SLACK]
        near, numbers, least = np.zeros(0), np.zeros(0, dtype=np.int64), 0.0
        seen = np.zeros(self.n_blocks, dtype=bool)
        while len(order):
            if 2 * len(order) > self.n_blocks and seen.any():
                # Bounds part too little: all lists are read once, without looking at their blocks.
                visit, order = order, order[:0]
                found = self._all_cosines(terms, weights)
            else:
                visit, order = order[:TOGETHER], order[TOGETHER:]
                looked = np.zeros(self.n_blocks, dtype=bool)
                looked[visit] = True
                mine = np.flatnonzero(looked[block])
                at, part = _ranges(self.list_start[lists[mine]], self.list_start[lists[mine] + 1])
                found = np.bincount(self.places[at], self.weights[at] * weight[mine][part], len(self.ids))
            hit = np.flatnonzero(found >= max(least, 1e-12))
            hit = hit[(hit != without) & ~seen[hit // BLOCK]]
            seen[visit] = True
            near, numbers = np.append(near, np.round(found[hit], 9)), np.append(numbers, hit)
            if len(near) >= NEIGHBOURS:
                least = np.partition(near, -NEIGHBOURS)[-NEIGHBOURS] - SLACK
                near, numbers = near[near >= least], numbers[near >= least]
            # Only blocks whose bound reaches the last neighbour so far can hold a better one.
            order = order[bound[order] >= least]
        best = np.lexsort((numbers, -near))[:NEIGHBOURS]
        return list(zip(near[best].tolist(), numbers[best].tolist()))

    def _all_cosines(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosine of every example, from whole lists: long ones one by one, the others together."""
        first, last = self.list_start[self.term_start[terms]], self.list_start[self.term_start[terms + 1]]
        long = last - first > 2 * BLOCK
        at, part = _ranges(first[~long], last[~long])
        found = np.bincount(self.places[at], self.weights[at] * weights[~long][part], len(self.ids)).astype(np.float64)
        for a, b, w in zip(first[long].tolist(), last[long].tolist(), weights[long].tolist()):
            found[self.places[a:b]] += self.weights[a:b] * w
        return found

    def vote(self, neighbours: list[tuple[float, int]]) -> float:
        """Share of toxic votes, each weighted by distance and for the sampling of its label."""
        weight, toxic = 1 / (SOFT + 1), self.prior / (SOFT + 1)
        for cosine, i in neighbours:
            w = self.class_weight[self.labels[i]] / (SOFT + max(0.0, 1 - cosine))
            weight += w
            toxic += w * self.labels[i]
        return toxic / weight

    def weigh(self, totals: dict[int, int], sizes: dict[int, int]) -> None:
        """Votes of a label that was sampled more thinly weigh more."""
        full, sampled = (np.array([x.get(0, 0), x.get(1, 0)], dtype=np.float64) for x in (totals, sizes))
        self.prior = float(full[1] / full.sum()) if full.sum() else 0.0
        weight = np.divide(full, sampled, out=np.zeros(2), where=sampled > 0)
        self.class_weight = weight / max(weight.max(), 1e-12)

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Observed rates by bins of the vote, made non-decreasing; equal votes share a bin."""
        values, of = np.unique(np.round(votes, 6), return_inverse=True)
        sums = [np.bincount(of, w, minlength=len(values)) for w in (weights, weights * labels, np.ones(len(votes)))]
        bins = (np.cumsum(sums[2]) - sums[2]) // max(1.0, len(votes) / BINS)
        pools: list[list[float]] = []  # weight, toxic weight, largest and least vote
        for b in np.unique(bins):
            g = bins == b
            pools.append([sums[0][g].sum(), sums[1][g].sum(), values[g].max(), values[g].min()])
            while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
                w, t, top, _ = pools.pop()
                pools[-1] = [pools[-1][0] + w, pools[-1][1] + t, top, pools[-1][3]]
        # Votes that the sample does not have belong to the nearer bin.
        self.cuts = np.array([(p[2] + after[3]) / 2 for p, after in zip(pools, pools[1:])])
        self.rates = np.array([(p[1] + 0.5) / (p[0] + 1) for p in pools]) if pools else np.array([self.prior])

    def score(self, vote: float) -> float:
        return float(self.rates[np.searchsorted(self.cuts, round(vote, 6), side="left")])


def held_out(id_col: str = "doc_id"):
    """Whether a row is for testing only."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """id, label, digest and text of the sample: at most ``SAMPLE`` rows and ``SAMPLE_BYTES`` of each label."""
    by_hash = (F.xxhash64("id"), F.col("id"))
    known = labels.select("id", F.col(label).cast("int").alias("label")).distinct()
    some = [known.filter(F.col("label") == y).orderBy(*by_hash).limit(SAMPLE) for y in (0, 1)]
    chosen = written(some[0].unionByName(some[1]), "sample")
    # At most 2 * SAMPLE rows of two numbers are broadcast; repeated rows of an id are one from here on.
    texts = docs.join(F.broadcast(chosen), "id").withColumn("digest", digest(F.col("text")))
    narrow = texts.groupBy("label", "digest").agg(F.min("id").alias("id"), F.min(F.octet_length("text")).alias("bytes"))
    order = Window.partitionBy("label").orderBy(*by_hash, "digest")
    kept = (
        narrow.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= SAMPLE)
        .withColumn("total", F.sum("bytes").over(order))
        .filter((F.col("total") <= SAMPLE_BYTES) | (F.col("rank") == 1))
        .select("label", "digest", "id")
    )
    return written(texts.join(F.broadcast(kept), ["label", "digest", "id"]).dropDuplicates(["label", "digest"]), "examples")


def _vocabulary(texts: DataFrame) -> pa.Table:
    """term, toxic, clean: the words of at most 2 * SAMPLE texts, with their examples of each label."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                found = words_of(t)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), y, dtype=np.int32))], names=["term", "label"]
                )

    toxic, clean = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return (
        texts.select("label", "text")
        .mapInArrow(spread, "term BIGINT, label INT")
        .groupBy("term")
        .agg(toxic.cast("int").alias("toxic"), clean.cast("int").alias("clean"))
        .toArrow()
    )


def _frequencies(docs: DataFrame, numbers: np.ndarray) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(sent.value), dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                df[counted(sent.value, t.as_py())[0]] += 1
            n += batch.num_rows
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], n))], names=["term", "n"]
        )

    found = docs.select("text").mapInArrow(count, "term BIGINT, n BIGINT").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(numbers) + 1, dtype=np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()  # the total is the last one
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Index:
    """An index over labelled documents that are not held out."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"))
    totals = dict(usable.groupBy("label").count().collect())
    body = docs.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text).alias("text"))
    texts = _examples(body, usable, "label")

    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    held = _vocabulary(texts)
    hashes = held.column("term").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    numbers = hashes[order]
    toxic, clean = (held.column(c).to_numpy()[order] for c in ("toxic", "clean"))
    share = (toxic + clean) / max(n0 + n1, 1)
    spread = np.sqrt(share * (1 - share) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)
    deviate = (toxic / max(n1, 1) - clean / max(n0, 1)) / spread
    df, n = _frequencies(body, numbers)
    values = (np.log((1 + n) / (1 + df)) + 1) * np.hypot(1, deviate)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(sent.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"),
                    batch.column("digest"),
                    batch.column("id"),
                    pa.array([t.astype(np.int32) for t, _ in found], pa.list_(pa.int32())),
                    pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32())),
                ],
                names=["label", "digest", "id", "terms", "counts"],
            )

    sent = docs.sparkSession.sparkContext.broadcast(numbers)
    table = written(texts.mapInArrow(vectors, VECTORS), "vectors")
    index, places = build_index(numbers, values, table.toArrow())  # the words of at most 2 * SAMPLE texts
    index.weigh(totals, sizes)
    return calibrated(index, places, table, totals)


def build_index(numbers: np.ndarray, values: np.ndarray, rows: pa.Table) -> tuple[Index, dict[tuple[int, bytes], int]]:
    """The index over the counted sample rows, and the place of each row with words."""
    vectors, keys, ids = [], list(zip(rows.column("label").to_pylist(), rows.column("digest").to_pylist())), rows.column("id").to_pylist()
    for t, c in zip(rows.column("terms"), rows.column("counts")):
        vectors.append(unit_vector(values, t.values.to_numpy().astype(np.int64), c.values.to_numpy()))

    def leading(i: int):
        terms, weights = vectors[i]
        return terms[np.argsort(-weights, kind="stable")[:3]].tolist(), keys[i]

    # Examples with the same leading words stand together, so that bounds of blocks are tight.
    used = sorted((i for i, v in enumerate(vectors) if len(v[0])), key=leading)
    labels = np.array([keys[i][0] for i in used], dtype=np.int64)
    index = Index(numbers, values, [ids[i] for i in used], labels, [vectors[i] for i in used])
    return index, {keys[i]: at for at, i in enumerate(used)}


def calibrated(index: Index, places: dict, table: DataFrame, totals: dict[int, int]) -> Index:
    """``index`` with rates for its votes, from rows of the sample that are searched without themselves."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("digest"), "digest")
    tried = table.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= CALIBRATION).drop("rank")
    spark = table.sparkSession
    sent = spark.sparkContext.broadcast((index, places))

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, places = sent.value
        for batch in batches:
            out = []
            for y, d, t, c in zip(*(batch.column(n) for n in ("label", "digest", "terms", "counts"))):
                vector = unit_vector(index.values, t.values.to_numpy().astype(np.int64), c.values.to_numpy())
                out.append(index.vote(index.nearest(*vector, without=places.get((y.as_py(), d.as_py()), -1))))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.float64())], names=["label", "vote"])

    spread = tried.repartition(spark.sparkContext.defaultParallelism, "digest")
    found = spread.mapInArrow(votes, "label INT, vote DOUBLE").toArrow()  # at most 2 * CALIBRATION rows
    labels, numbers = found.column("label").to_numpy().astype(np.int64), found.column("vote").to_numpy()
    order = np.lexsort((labels, numbers))
    labels, numbers = labels[order], numbers[order]
    full = np.array([totals.get(0, 0), totals.get(1, 0)], dtype=np.float64)
    of = np.bincount(labels, minlength=2)
    share = np.divide(full, of, out=np.zeros(2), where=of > 0)
    index.calibrate(numbers, labels, share[labels] if len(labels) else np.zeros(0))
    return index


def score(docs: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Add ``score``, ``predicted`` and ``evidence`` to every row.

    ``evidence`` lists the neighbours as (doc_id, cosine, label).  Columns of these
    names are replaced; all other columns and all rows, repeated ones too, stay as they are.
    """
    new = ("score", "predicted", "evidence")
    kept = [c for c in docs.columns if c not in new]
    at = kept.index(text)
    model = docs.sparkSession.sparkContext.broadcast(index)  # the words of 2 * SAMPLE texts, SAMPLE_BYTES each label
    item = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = model.value
        for batch in (b.slice(a, ROWS) for b in batches for a in range(0, b.num_rows, ROWS)):
            scores, evidence = [], []
            for t in batch.column(at):
                near = index.nearest(*index.vector(t.as_py() or ""))
                scores.append(index.score(index.vote(near)))
                evidence.append([(index.ids[i], c, int(index.labels[i])) for c, i in near])
            predicted = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), predicted, pa.array(evidence, pa.list_(item))],
                names=[*kept, *new],
            )

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return docs.select(*kept).mapInArrow(
        run,
        ", ".join(fields)
        + ", score DOUBLE, predicted INT, evidence ARRAY<STRUCT<doc_id: BIGINT, cosine: DOUBLE, label: INT>>",
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; repeated rows and null texts are rows like others."""
    aside = {c: unused(docs, "kept_" + c) for c in docs.columns if c.lower() in ("score", "predicted", "evidence")}
    scored = score(docs.withColumnsRenamed(aside), fit(docs, labels, id_col, text), aside.get(text, text))
    return scored.filter("predicted = 0").select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
