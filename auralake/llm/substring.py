"""Exact removal of repeated passages with one compressed FM-index for each shard.

A window is `window` consecutive words of one document; each word covered by a window that also starts anywhere else goes.

1. Anchors: of the 8-word runs in a window the first in a fixed order (frequent runs last) is its anchor, so equal windows
   have equal anchors. A window of frequent runs only takes the first runs of three orders together, so that no frequent
   run gathers what has nothing else in common. A document's windows with one anchor in a row make a fragment. A shuffle
   by anchor keeps the fragments whose anchor occurs again; frequent anchors are salted and always kept. Equal fragments of
   a group are one content, marked if it stands for several.
2. Contents are cut from the texts and go to shards by their anchor, so all occurrences of a window meet in one shard of
   bounded mean size.
3. Each shard builds an FM-index over its contents with a bit for the marked ones, and one over their mirror images;
   contents are streamed past them, backward search over the wavelet matrices gives how far a match with a second
   occurrence reaches, and intervals of `window` words or more are reported.
4. Intervals are joined to the fragments by content and to the documents by row; the words outside them are kept.

Words are compared as 64-bit hashes. Null text has no words; an empty table gives an empty one; texts may be of any length.
Equal rows (same id and text) count as two documents with equal results; no column but doc_id and text is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fmindex import repeated
from .text import Words, _power, checkpointed, discard, gram_hashes, joined, mix, pieces

WINDOW, GRAM = 35, 8
#: One in so many documents is looked at to find frequent runs, of which at most FREQUENT go last in the order.
SAMPLE, FREQUENT = 16, 1 << 17
#: Documents a salt of a frequent anchor, and the fewest salts.
SALT_DOCS, SALTS = 20_000, 32
#: Mean words of a shard.
SHARD_WORDS = 600_000
#: Ids (8 bytes each) and bytes of intervals that are broadcast, at most; beyond it tables are shuffled.
BROADCAST, BROADCAST_BYTES = 1 << 20, 64 << 20
HOT = np.uint64(1 << 63)
#: Orders beside the first whose minima make the anchor of a window of frequent runs.
ORDERS = (0x51A7_0001, 0x51A7_0002)


def frequent_grams(docs: DataFrame) -> np.ndarray:
    """Order values of frequent word runs, sorted; FREQUENT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            gram = gram_hashes(w.hashes(), GRAM)
            n = len(gram)
            value, count = np.unique(gram[w.row[:n] == w.row[GRAM - 1 : GRAM - 1 + n]] >> np.uint64(1), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["g", "n"])

    some = docs.where(F.pmod(F.xxhash64("row_key", F.lit(3)), F.lit(SAMPLE)) == 0).select("text")
    got = some.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "g").limit(FREQUENT).toPandas()
    return np.sort(got.g.to_numpy(np.int64)).view(np.uint64)


def minima(value: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each run of `span` values and its place, the first of equal ones."""
    low, place, size = value, np.arange(len(value)), 1
    while size < span:
        step = min(size, span - size)
        right = low[step:] < low[:-step]
        low, place = np.where(right, low[step:], low[:-step]), np.where(right, place[step:], place[:-step])
        size += step
    return low, place


def window_anchors(words: Words, frequent: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Fragments: (row, first word, last window's first word, anchor value, places of the anchor) with words counted within rows."""
    plain = gram = gram_hashes(words.hashes(), GRAM) >> np.uint64(1)
    if len(frequent) and len(gram):
        at = np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)
        gram = np.where(frequent[at] == gram, gram | HOT, gram)
    span = window - GRAM + 1
    if len(gram) < span:
        return (np.zeros(0, np.int64),) * 5
    low, place = minima(gram, span)
    hot = low >= HOT
    if hot.any():
        for seed in ORDERS:
            low = np.where(hot, mix(low ^ minima(mix(plain ^ np.uint64(seed)), span)[0]) | HOT, low)
    inside = words.row[: len(low)] == words.row[window - 1 : window - 1 + len(low)]
    at = np.flatnonzero(inside)
    if not len(at):
        return (np.zeros(0, np.int64),) * 5
    fresh = np.concatenate(([True], (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1) | (words.row[at[1:]] != words.row[at[:-1]])))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    moved = np.concatenate(([0], np.cumsum(place[at[1:]] != place[at[:-1]])))
    row = words.row[at[first]]
    return row, at[first] - words.first[row], at[last] - words.first[row], low[at[first]], 1 + moved[last] - moved[first]


def repeated_anchors(docs: DataFrame, frequent: np.ndarray, window: int) -> DataFrame:
    """Fragments (row_key, anchor, content, first, more, index, several) whose anchor occurs more than once; those with `index`
    stand for their content, and `several` marks contents of more than one fragment."""
    salts = max(SALTS, docs.count() // SALT_DOCS)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            row, first, last, anchor, places = window_anchors(w, shared.value, window)
            word = w.hashes()
            power, inverse = _power(len(word) + 1)
            with np.errstate(over="ignore"):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word * power[: len(word)])))
                base = w.first[row] + first
                size = (last - first + window).astype(np.uint64)
                body = mix((total[w.first[row] + last + window] - total[base]) * inverse[base] ^ mix(size))
            key = b.column("row_key").to_numpy()[row]
            salt = np.where(anchor >= HOT, mix(key.view(np.uint64)) % np.uint64(salts), np.uint64(1 << 30)).astype(np.int32)
            bounds = first << 32 | np.minimum(last - first, (1 << 31) - 1) << 1 | (places > 1)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(salt), pa.array(body.view(np.int64)), pa.array(key), pa.array(bounds)], names=["anchor", "salt", "body", "row_key", "bounds"])

    def judge(t: pa.Table) -> pa.RecordBatch:
        anchor, salt, body, bounds = (t.column(c).to_numpy() for c in ("anchor", "salt", "body", "bounds"))
        group = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])))
        index = group | np.concatenate(([True], body[1:] != body[:-1]))
        g, p = np.cumsum(group) - 1, np.cumsum(index) - 1
        several = np.bincount(p)[p] > 1
        again = (np.bincount(g)[g] > 1) | (salt < 1 << 30) | (bounds & 1 == 1)
        cols = [t.column(c).combine_chunks() for c in ("row_key", "anchor", "body", "bounds")] + [pa.array(index), pa.array(several)]
        return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["row_key", "anchor", "content", "bounds", "index", "several"]).filter(pa.array(again))

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            anchor, salt = t.column("anchor").to_numpy(), t.column("salt").to_numpy()
            last = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
            done = int(last[-1]) + 1 if len(last) else 0  # the last anchor may go on in the next batch
            if done:
                yield judge(t.slice(0, done))
            held = t.slice(done)
        if held is not None and held.num_rows:
            yield judge(held)

    rows = docs.select("row_key", "text").mapInArrow(cut, "anchor long, salt int, body long, row_key long, bounds long")
    kept = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "body", "row_key", "bounds").mapInArrow(twice, "row_key long, anchor long, content long, bounds long, index boolean, several boolean")
    return kept.select("row_key", "anchor", "content", F.shiftright("bounds", 32).alias("first"), F.expr("shiftright(bounds, 1) & 2147483647").alias("more"), "index", "several")


def fragments(docs: DataFrame, found: DataFrame, shards: int, window: int) -> DataFrame:
    """Contents by shard: shard, anchor, content, several, text (words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            data = w.data.tobytes()
            out = []
            for r, parts in enumerate(b.column("parts").to_pylist()):
                for p in parts:
                    base = int(w.first[r]) + p["first"]
                    body = b" ".join(data[w.start[base] : w.end[base + p["more"] + window - 1]].split())
                    out.append((p["anchor"] % shards, p["anchor"], p["content"], p["several"], body))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["shard", "anchor", "content", "several", "text"])

    own = found.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "content", "first", "more", "several")).alias("parts"))  # as many as a document has
    texts = docs.select("row_key", "text")
    ids = checkpointed(found.select("row_key").distinct())
    if ids.count() <= BROADCAST:
        texts = texts.join(F.broadcast(ids), "row_key", "left_semi")
    return texts.join(own, "row_key").mapInArrow(run, "shard long, anchor long, content long, several boolean, text binary")


def shard_repeats(frags: DataFrame, shards: int, window: int) -> DataFrame:
    """(anchor, content, at, words) of repeated intervals of contents."""

    def search(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        anchor, content, several = (t.column(c).to_numpy() for c in ("anchor", "content", "several"))
        fresh = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))))
        several = np.logical_or.reduceat(several, fresh) | (np.diff(np.append(fresh, len(anchor))) > 1)  # salts and repeated rows meet here
        w = Words(t.column("text").take(pa.array(fresh)).combine_chunks().cast(pa.large_binary()))
        anchor, content = anchor[fresh].tolist(), content[fresh].tolist()
        out = [(anchor[p], content[p], a, e - a) for p, a, e in repeated(w.hashes(), w.count, window, several)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], [], []))], names=["anchor", "content", "at", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        shard = None
        for b in batches:
            key = b.column("shard").to_numpy()
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(bounds, bounds[1:], strict=False):
                if i < j:
                    if held and key[i] != shard:
                        yield search(held)
                        held = []
                    shard = int(key[i])
                    held.append(b.slice(i, j - i))
        if held:
            yield search(held)

    placed = frags.repartition(shards, "shard").sortWithinPartitions("shard", "anchor", "content")
    return placed.mapInArrow(run, "anchor long, content long, at long, words long")


def merged(intervals: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of a row as one."""
    w = Window.partitionBy("row_key").orderBy("first", "words")
    reach = F.max(F.col("first") + F.col("words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("first") > reach), 1).otherwise(0)
    island = intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("row_key", "island").agg(F.min("first").alias("first"), (F.max(F.col("first") + F.col("words")) - F.min("first")).alias("words"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with `keep_text`, the kept words joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = checkpointed(repeated_anchors(docs, frequent_grams(docs), window))
    index = found.where("index")
    words = index.agg(F.sum(F.col("more") + window)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    reported = checkpointed(shard_repeats(fragments(docs, index, shards, window), shards, window))
    own = found.join(reported, ["anchor", "content"]).select("row_key", (F.col("first") + F.col("at")).alias("first"), "words")
    intervals = checkpointed(merged(own))
    discard(found, reported)
    gone = intervals.groupBy("row_key").agg(F.collect_list(F.struct("first", "words")).alias("gone"))
    size = intervals.agg(F.countDistinct("row_key").alias("rows"), F.count("*").alias("n")).first()
    if 96 * size["rows"] + 16 * size["n"] <= BROADCAST_BYTES:
        gone = F.broadcast(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column("text"))
            cover = np.zeros(len(w.start) + 1, np.int64)
            for r, parts in enumerate(b.column("gone").to_pylist()):
                for p in parts or ():
                    cover[w.first[r] + p["first"]] += 1
                    cover[w.first[r] + p["first"] + p["words"]] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            texts = joined(w, keep)
            removed = w.count - np.bincount(w.row[keep], minlength=len(w.count))
            cols = [b.column("doc_id"), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols.append(pa.array([t.decode() for t in texts], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", text string" if keep_text else ""
    return docs.join(gone, "row_key", "left").select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + more)
