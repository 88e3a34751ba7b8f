"""Ranked lexical search, reversed: the items are indexed and the documents are streamed through the index.

An inverted index over the items' terms (term, item, repeats) goes to every task. Documents are cut into terms once; the
counts of the index's terms are kept in a table, from which the corpus statistics come and past which the index is then
streamed. Each task keeps a heap of the k best documents for each item; the heaps are merged in two levels. Items beyond
`BLOCK_CHARS` are dealt over several indexes, each of which all documents pass, so an index is bounded and no item is left
out; one item is never divided.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A to Z lower-cased. Null and empty texts have
no terms, match nothing and don't count among the documents. Repeated documents are ranked as often as they occur; equal
scores go by ascending doc_id, a null id last. Rows of `items` with one item_id and one text are one item; other rows with
the same id are ranked each of their own. Empty tables on either side give an empty one. Texts of any length are worked on
whole; columns but doc_id, item_id and text are not used.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import LOWER, checkpointed, discard, pieces, raw

#: Characters of item texts in one index, on average; the index of a block is a few times as large.
BLOCK_CHARS = 4 << 20
#: Cells of the score matrix of one step.
CELLS = 1 << 20
#: First-level merges of an item's heaps.
SALTS = 64

TERM = np.ones(256, bool)
TERM[:128] = [chr(c).isalnum() for c in range(128)]


def terms(text: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The terms of all rows, one after another, and the number of terms of each row."""
    data, off = raw(text)
    own = TERM[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    begins, ends = own.copy(), own.copy()
    if len(data):
        begins[1:] &= ~own[:-1] | first[1:-1]
        ends[:-1] &= ~own[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[own]])])
    return flat, np.diff(np.searchsorted(start, off))


class Index:
    """Inverted index of a block of items: sorted terms, and for each the items that hold it and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        flat, count = terms(pa.array([t for _, t in items], pa.string()))
        self.terms = pc.unique(flat)
        row = np.repeat(np.arange(len(items)), count)
        code = pc.index_in(flat, value_set=self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        key, self.repeats = np.unique(code * max(1, len(items)) + row, return_counts=True)
        self.item = key % max(1, len(items))
        self.first = np.searchsorted(key // max(1, len(items)), np.arange(len(self.terms) + 1))


def counted(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, n (all terms of the document), and the index's terms that occur in it with their counts."""
    known = docs.sparkSession.sparkContext.broadcast(index.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            flat, n = terms(b.column("text"))
            code = pc.fill_null(pc.index_in(flat, value_set=known.value), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)[code >= 0]
            key, times = np.unique(row * len(known.value) + code[code >= 0], return_counts=True)
            bounds = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * len(known.value)), pa.int32())
            held = [pa.ListArray.from_arrays(bounds, pa.array(v, t)) for v, t in ((key % len(known.value), pa.int32()), (times, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *held], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class Heaps:
    """The k best (score, document) of each item: bounded heaps whose roots are the scores to beat."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """scores: (documents, items)."""
        beat = self.floor
        if len(ids) > self.k:
            beat = np.maximum(beat, np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k])
        for doc, item in zip(*np.nonzero(scores >= beat), strict=True):
            at = ids[doc]
            entry = (int(scores[doc, item]), -math.inf if at is None else -at, at)
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]


def best_of_tasks(hits: DataFrame, index: Index, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place in the index), item_id, doc_id, score: each task's k best documents of each item."""
    shared = hits.sparkSession.sparkContext.broadcast((index, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        heaps = Heaps(len(index.ids), k)
        held = np.diff(index.first)
        step = max(1, CELLS // len(index.ids))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                n, lists = part.column("n").to_numpy(), part.column("term")
                row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                term, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                m = 75 + 25 * n * n_docs // n_terms
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                total = np.zeros(len(n) * len(index.ids), np.int64)
                done = np.concatenate(([0], np.cumsum(held[term])))
                a = 0
                while a < len(term):  # the postings of some terms at a time, one term at least
                    e = max(a + 1, int(np.searchsorted(done, done[a] + CELLS, "right")) - 1)
                    size = held[term[a:e]]
                    place = np.arange(int(size.sum())) + np.repeat(index.first[term[a:e]] - (done[a:e] - done[a]), size)
                    cell = np.repeat(row[a:e], size) * len(index.ids) + index.item[place]
                    np.add.at(total, cell, np.repeat(gain[a:e], size) * index.repeats[place])
                    a = e
                heaps.update(total.reshape(len(n), -1), part.column("doc_id").to_pylist())
        out = [(item, index.ids[item], doc, score) for item, heap in enumerate(heaps.heaps) for score, _, doc in heap]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["item", "item_id", "doc_id", "score"])

    return hits.where(F.size("term") > 0).mapInArrow(run, "item int, item_id long, doc_id long, score long")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """The k best of each item, ranked; its heaps meet in SALTS parts first."""
    order = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    part = heaps.withColumn("_salt", F.spark_partition_id() % SALTS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _searched(docs: DataFrame, items: list[tuple[int | None, str | None]], k: int) -> DataFrame | None:
    index = Index(items)
    if not len(index.terms):
        return None
    hits = checkpointed(counted(docs, index))
    n_docs, n_terms = hits.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(index.terms), np.int64)
    for r in hits.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():  # a row a term of the index
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    out = checkpointed(merged(best_of_tasks(hits, index, weight, n_docs, n_terms, k), k))
    discard(hits)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest score above 0 for each item."""
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    size = own.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    found = []
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # one block, about BLOCK_CHARS
        if part := _searched(docs, [(r.item_id, r.text) for r in rows], k):
            found.append(part)
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
