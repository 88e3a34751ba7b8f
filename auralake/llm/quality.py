"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features are hashed words, word pairs, word shapes (letters, capitals, digits and marks, runs counted once), pairs of
shapes and a mark for a word equal to the one before. A document's score is a sparse dot product of its feature shares.
Training reads at most `sample` labelled rows (those with the smallest id hashes), in `shards` parallel parts whose
weights are averaged; nothing else is sampled. Weights are `2 ** bits` numbers whatever the corpus.

Null and empty texts get the score of the bias alone. Rows without a label, with a null label or held out are not learnt
from; repeated labels of one id count once (the larger). Without any label every score is 0.5. Repeated rows are scored as often
as they occur, an empty table gives an empty one, and a text of any length is hashed whole, in time in proportion. Ties can't
matter, as nothing is ranked. Columns but doc_id and text are not used, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, gram_hashes, held_out, mix, pieces, span_hashes

BITS = 18
#: Byte classes of shapes: letters a, capitals A, digits 0, other bytes themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48
SCALE = 8.0


def gram_features(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of every n-gram occurrence; values of one family in one row sum to SCALE or less."""
    w = Words(text)
    word = w.hashes()
    shape = SHAPE[w.data]
    fresh = ~w.gap
    if len(shape):
        fresh[1:] &= shape[1:] != shape[:-1]
        fresh[w.start] = True
    at = np.concatenate(([0], np.cumsum(fresh)))
    shapes = span_hashes(shape[fresh], at[w.start], at[w.end])
    rows, index = [], []
    shift = np.uint64(64 - bits)
    for k, (value, size) in enumerate(((word, 1), (word, 2), (shapes, 1), (shapes, 2), (None, 2))):
        if value is None:
            keep = np.flatnonzero(word[1:] == word[:-1])
            hashed = np.full(len(keep), mix(np.array([99], np.uint64))[0])
        else:
            hashed = gram_hashes(value, size)
            keep = np.arange(len(hashed))
        if size == 2:
            inside = w.row[keep] == w.row[keep + 1]
            keep, hashed = keep[inside], hashed[inside]
        rows.append(w.row[keep])
        index.append((mix(hashed ^ np.uint64(k + 1)) >> shift).astype(np.int64))
    row = np.concatenate(rows)
    return row, np.concatenate(index), SCALE / np.maximum(w.count, 1)[row]


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, epochs: int = 3) -> np.ndarray:
    """Follow-the-regularised-leader (proximal) updates, one example at a time; the last weight is the bias."""
    size = (1 << bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in examples:
            p = 1 / (1 + np.exp(-np.clip(w[index] @ value, -35, 35)))
            g = (p - label) * value
            old = n[index]
            new = old + g * g
            z[index] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w[index]
            n[index] = new
            zi = z[index]
            w[index] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(new)) / alpha + l2))
    return w


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """At most `sample` labelled documents that are not held out: doc_id, text, label, key (the hash that chose them)."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("double").alias("label")).where("label is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("key", F.xxhash64("doc_id"))
    chosen = known.orderBy("key", "doc_id").limit(sample)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, shards: int = 4, bits: int = BITS) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for b in pieces(batches):
            row, index, value = gram_features(b.column("text"), bits)
            order = np.argsort(row, kind="stable")
            bound = np.searchsorted(row[order], np.arange(b.num_rows + 1))
            for r, y in enumerate(b.column("label").to_pylist()):
                own = order[bound[r] : bound[r + 1]]
                i, back = np.unique(index[own], return_inverse=True)
                v = np.bincount(back, weights=value[own], minlength=len(i))
                examples.append((np.append(i, 1 << bits), np.append(v, 1.0), float(y)))
        if examples:
            w = ftrl(examples, bits)
            i = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(w[i], 1.0))], names=["feature", "weight"])

    rows = labelled(docs, labels, label, sample).withColumn("shard", F.pmod("key", F.lit(shards)))
    parts = rows.repartition(shards, "shard").sortWithinPartitions("key", "doc_id").select("text", "label").mapInArrow(run, "feature long, weight double")
    got = parts.groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()  # 2 ** bits rows at most
    weights = np.zeros((1 << bits) + 1)
    trained = got.loc[got.feature == -1, "weight"].sum()
    kept = got[got.feature >= 0]
    weights[kept.feature.to_numpy(np.int64)] = kept.weight.to_numpy() / max(trained, 1.0)
    return weights


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """doc_id and the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, index, value = gram_features(b.column("text"), bits)
            total = np.bincount(row, weights=shared.value[index] * value, minlength=b.num_rows) + shared.value[-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 20_000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every document."""
    scored = score(docs, train(docs, labels, "quality", sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
