"""Ranked lexical search by exact sparse ball trees.

A document is a sparse vector of integer impacts over its terms, a query the integer
weights of its terms; a score is their inner product in 64-bit integers.  Documents are
split into balls, each with a centroid and a radius around it.  No document of a ball
scores more than ``query . centroid + |query| * radius``; the bound is rounded up past
every error of its floating-point parts, so a ball is passed over only where none of its
documents can enter the result.  Balls are visited best bound first, and the documents
of a leaf are scored exactly.

Queries come in blocks of bounded size, each broadcast to all tasks.  Per block, documents
are read once and reduced to the counts of the block's terms, which is all that inner
products with its queries need; a task builds one tree for every ``TREE`` documents and
keeps one list of best documents per query over its trees, so what a task sends on does not grow
with its documents.

Null text and text without terms are never found and count neither in N nor in L.  A null
id is ranked after all others of its score.  Queries of equal id and text count once;
those without terms find nothing.  Rows of equal ids are documents of their own.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptward.llm.common import text_or_empty, written

TOP = 10
#: UTF-8 bytes of the queries of one block, about.
BLOCK_BYTES = 4 << 20
#: Documents of one tree and of one leaf.
TREE, LEAF = 8192, 48
#: Relative errors that a bound allows for; actual ones are below terms * 2**-52.
SLACK = 1e-9
#: Words of a block of text that are lower-cased and split: all but letters, digits and bytes from 0x80.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_NULL_ID = np.iinfo(np.int64).max

VECTORS = "doc_id BIGINT, n BIGINT, terms ARRAY<INT>, tfs ARRAY<INT>"
FOUND = "query INT, doc_id BIGINT, score BIGINT"


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with terms: their number, and the counts of those in ``vocabulary``."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value
        for batch in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    times = Counter(words)
                    shared = sorted((place[w], times[w]) for w in times.keys() & place.keys())
                    ids.append(doc_id)
                    lengths.append(len(words))
                    terms.append([t for t, _ in shared])
                    tfs.append([c for _, c in shared])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(tfs, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text")).mapInArrow(run, VECTORS)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """Integer impact of each count of a term in a document of n terms; Python's integers where 64 bits may not do."""
    longest = int(n.max(initial=0))
    if 90 * longest * documents < 1 << 62:
        m = 10 + 90 * n * documents // words
    else:
        m = np.array([10 + 90 * int(x) * documents // words for x in n], dtype=np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class BallTree:
    """A tree of balls over documents given as rows of (term, impact) in one long array."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, n_terms: int):
        self.n_terms = n_terms
        starts = np.concatenate(([0], np.cumsum(sizes)))
        floats = values.astype(np.float64)
        norms = np.add.reduceat(floats * floats, starts[:-1])
        order, self.bounds, self.children, centroids, self.radius = [], [], [], [], []
        # Depth first, so that every ball is one range of the final order.
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.bounds)
            if parent >= 0:
                self.children[parent][side] = node
            at = _flat(starts, rows)
            t, v = terms[at], floats[at]
            cuts = np.concatenate(([0], np.cumsum(sizes[rows])))[:-1]
            centre = np.bincount(t, weights=v, minlength=n_terms) / len(rows)
            around = np.flatnonzero(centre)
            square = float((centre[around] ** 2).sum())
            away = norms[rows] - 2 * np.add.reduceat(v * centre[t], cuts) + square
            # Differences of nearly equal squares: what rounding may have taken is added back.
            away = np.maximum(away, 0) + SLACK * (norms[rows] + square)
            self.radius.append(math.sqrt(float(away.max())))
            self.bounds.append([len(order), len(order) + len(rows)])
            self.children.append([-1, -1])
            centroids.append((around, centre[around]))
            if len(rows) <= LEAF:
                order.extend(rows.tolist())
                continue
            near = self._side(rows, t, v, cuts, starts, terms, floats, norms, int(away.argmax()))
            todo.append((rows[~near], node, 1))
            todo.append((rows[near], node, 0))
        order = np.array(order, dtype=np.int64)
        at = _flat(starts, order)
        self.ids, self.terms, self.values = ids[order], terms[at], values[at]
        self.starts = np.concatenate(([0], np.cumsum(sizes[order])))
        self.radius = np.array(self.radius)
        # Centroids by term, so that a query reads only those of its own terms.
        nodes = np.repeat(np.arange(len(centroids)), [len(a) for a, _ in centroids])
        flat = np.concatenate([a for a, _ in centroids])
        by_term = np.argsort(flat, kind="stable")
        self.centre_node = nodes[by_term]
        self.centre_value = np.concatenate([c for _, c in centroids])[by_term]
        self.centre_start = np.searchsorted(flat[by_term], np.arange(n_terms + 1))

    def _side(self, rows, t, v, cuts, starts, terms, floats, norms, far: int) -> np.ndarray:
        """Which rows are nearer to the farthest document than to the one farthest from that."""

        def distances(row: int) -> np.ndarray:
            pivot = np.zeros(self.n_terms)
            pivot[terms[starts[row] : starts[row + 1]]] = floats[starts[row] : starts[row + 1]]
            return norms[rows] - 2 * np.add.reduceat(v * pivot[t], cuts)

        one = distances(rows[far])
        two = distances(rows[int(one.argmax())])
        half = len(rows) // 2
        # Halves of equal size keep the tree shallow, whatever repeats.
        near = np.zeros(len(rows), dtype=bool)
        near[np.argpartition(one - two, half)[:half]] = True
        return near

    def search(self, query: np.ndarray, weights: np.ndarray, dense: np.ndarray, best: list, top: int) -> None:
        """Improve ``best``, a heap of (score, -id) that holds at most ``top`` documents."""
        spans = [slice(self.centre_start[t], self.centre_start[t + 1]) for t in query]
        bound = self.radius * math.sqrt(float((weights.astype(np.float64) ** 2).sum()))
        for span, w in zip(spans, weights.tolist()):
            bound[self.centre_node[span]] += self.centre_value[span] * w
        bound = (bound * (1 + SLACK) + 1).tolist()
        heap = [(-bound[0], 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            if len(best) == top and -upper < best[0][0]:
                return
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-min(-upper, bound[left]), left))
                heapq.heappush(heap, (-min(-upper, bound[right]), right))
                continue
            a, b = self.bounds[node]
            span = slice(self.starts[a], self.starts[b])
            scores = np.add.reduceat(self.values[span] * dense[self.terms[span]], self.starts[a:b] - self.starts[a])
            floor = max(best[0][0], 1) if len(best) == top else 1
            for i in np.flatnonzero(scores >= floor).tolist():
                entry = (int(scores[i]), -int(self.ids[a + i]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def _flat(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of all entries of ``rows``, in that order."""
    sizes = starts[rows + 1] - starts[rows]
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[rows] - (ends - sizes), sizes)


def found_in(table: DataFrame, queries: list[np.ndarray], weights: np.ndarray, totals: tuple[int, int], top: int) -> DataFrame:
    """The best documents of each task for each query."""
    sent = table.sparkSession.sparkContext.broadcast((queries, weights))
    documents, words = totals

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[BallTree]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                waiting.append(part)
                rows += part.num_rows
                if rows >= TREE:
                    yield build(waiting)
                    waiting, rows = [], 0
        if rows:
            yield build(waiting)

    def build(parts: list[pa.RecordBatch]) -> BallTree:
        table = pa.Table.from_batches(parts).combine_chunks()
        sizes = table["terms"].combine_chunks().value_lengths().to_numpy().astype(np.int64)
        terms = table["terms"].combine_chunks().flatten().to_numpy().astype(np.int64)
        tfs = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        n = np.repeat(table["n"].to_numpy(), sizes)
        ids = table["doc_id"].fill_null(_NULL_ID).to_numpy()
        return BallTree(ids, sizes, terms, impacts(tfs, n, documents, words), len(sent.value[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        dense = np.zeros(len(w), dtype=np.int64)
        for tree in trees(batches):
            for query, heap in zip(asked, best):
                if len(query):
                    dense[query] = w[query]
                    tree.search(query, w[query], dense, heap, top)
                    dense[query] = 0
        rows = [(q, -i, s) for q, heap in enumerate(best) for s, i in heap]
        columns = list(zip(*rows)) if rows else [[]] * 3
        ids = [None if i == _NULL_ID else i for i in columns[1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(ids, pa.int64()), pa.array(columns[2], pa.int64())],
            names=["query", "doc_id", "score"],
        )

    return table.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, FOUND)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of every row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = items.select("item_id", text_or_empty("text").alias("text")).distinct()
    asked = written(asked, "queries")
    size = asked.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    item_type = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank INT, doc_id BIGINT, score BIGINT")
    for block in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        out = out.unionByName(_search_block(docs, mine, top, item_type))
    return out


def _search_block(docs: DataFrame, block: list, top: int, item_type: str) -> DataFrame:
    spark = docs.sparkSession
    words = [sorted(set(terms_of(r["text"]))) for r in block]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    queries = [np.array([vocabulary[w] for w in ws], dtype=np.int64) for ws in words]
    table = written(vectors(docs, vocabulary), "vectors")
    totals = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    seen = table.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
    for term, df in seen:
        weights[term] = weight(totals[0], df)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"query INT, item_id {item_type}")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found_in(table, queries, weights, tuple(totals), top)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .join(F.broadcast(names), "query")
        .select("item_id", F.col("rank").cast("int"), "doc_id", "score")
    )
