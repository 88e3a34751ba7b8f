"""Exact Jaccard join of documents' word shingles as a metric-space join.

Distances: d(x, y) = 1 - |x & y| / |x | y| and its unnormalised form h(x, y) = |x - y| + |y - x|; a pair links when
h <= (1 - t) / (1 + t) * (|x| + |y|).

1. Documents with equal sets collapse into a class; its smallest id stands for it.
2. Pivots make Voronoi regions. Unrelated texts are at distance 1 from each other, so whole documents as first pivots
   would give windows that replicate everything everywhere. The first pivots are the sets {s} of one shingle: s is nearest
   to the documents that hold it, and ties go to the pivot that comes first in one fixed order, rare shingles before
   frequent ones (a sample of documents finds the frequent ones; any order gives the same links). By the triangle
   inequality for h a document can only have partners in the regions of its first |x| - ceil(t |x|) + 1 pivots, and it is
   replicated to just these.
3. A region of few documents compares all of its pairs. In a larger one a document becomes pivot and is compared with
   all others. Regions of one pivot make its cell; the cell is closed when all of its documents are then in one component.
   In an open cell the documents outside the largest component are joined, in blocks, with all documents of the cell, which
   are dealt over slices, so a task holds one block and streams one slice.
4. Before texts are compared, the triangle inequality prunes pairs: counts of shingles in hash classes (64 or more, by
   size) are distances to fixed pivots, and the sum of their differences is at most h. Blocks and slices first meet as such
   counts, and only the texts of documents that then have a possible partner follow them.

Shingles are 64-bit hashes. Null or empty texts have no shingles, no links and their own id as component; a null id is
returned with a null component. Ids are taken as unique; rows that repeat one are returned as often. An empty table gives
an empty one, a text may have any length, and columns but doc_id and text are not used (`one_of_each` carries them along).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import STEP_BYTES, Words, checkpointed, discard, gram_hashes, mix, pieces

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: One in so many documents is looked at to find frequent shingles, of which at most FREQUENT go last in the order.
SAMPLE, FREQUENT = 16, 1 << 17
#: Regions of so many documents or fewer compare all pairs; larger ones take a pivot.
SMALL = 12
#: Outsiders of a cell in a block, and documents that are compared with a block at once.
BLOCK, CHUNK = 1000, 256
#: Documents of a cell that one task streams past a block, on average.
SLICE = 1000
#: Shingles of a block in so many of its documents are compared by a matrix product, rarer ones by an index.
DENSE = 16
SALTS = 32
#: Ids that are broadcast to pick texts, at most (8 bytes each).
BROADCAST_IDS = 1 << 20


def shingle_sets(text: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = Words(text, lower=True)
    word = w.hashes()
    gram = gram_hashes(word, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(gram[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(word[a:b], b - a))
        else:
            out.append(word[:0])
    return out


def needed(n: np.ndarray) -> np.ndarray:
    """Least intersection of a set of n with any partner."""
    return (n * PERCENT + 99) // 100


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes of frequent shingles, the rarest of them first; FREQUENT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = shingle_sets(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["s"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SAMPLE)) == 0).select("text")
    got = some.mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    return got.sort_values(["n", "s"]).s.to_numpy(np.int64).view(np.uint64)


def class_bits(n: int) -> int:
    """log2 of the hash classes that a set of n is counted in: about eight shingles to a class, 64 classes at least."""
    return min(12, max(6, (n // 8).bit_length()))


def set_keys(docs: DataFrame) -> DataFrame:
    """doc_id, n, two keys of the set, and its counts in hash classes (by leading bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            cols: list[list] = [[], [], [], []]
            for s in shingle_sets(b.column("text")):
                m = mix(s)
                bits = class_bits(len(s))
                cols[0].append(len(s))
                cols[1].append(int(m.sum().view(np.int64)) if len(s) else 0)
                cols[2].append(int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if len(s) else 0)
                # a count stops at 255, which only makes distances smaller
                cols[3].append(np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], names=["doc_id", "n", "k1", "k2", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, counts binary")


def windows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """Each document's first pivots: region (the pivot), salt (of a frequent one, else -1), node, n."""
    order = np.argsort(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rank = shared.value
        for b in pieces(batches):
            heads, salts, nodes, sizes = [], [], [], []
            for node, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text")), strict=True):
                n = len(s)
                if not n:
                    continue
                want = min(n, n - int(needed(np.int64(n))) + 1)
                at = np.minimum(np.searchsorted(values, s), len(values) - 1) if len(values) else None
                often = values[at] == s if at is not None else np.zeros(n, bool)
                head = s[~often][:want]
                salt = np.full(want, -1, np.int32)
                if len(head) < want:
                    late = s[often]
                    salt[len(head) :] = node % SALTS
                    head = np.concatenate((head, late[np.argsort(rank[at[often]], kind="stable")][: want - len(head)]))
                heads.append(head)
                salts.append(salt)
                nodes.append(np.full(want, node, np.int64))
                sizes.append(np.full(want, n, np.int64))
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes))], names=["region", "salt", "node", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "region long, salt int, node long, n long")


def regions(rows: DataFrame) -> DataFrame:
    """Pairs of small regions (a, b), and of large or salted ones each document with its pivot (a pivot, b document, star true; region of salted ones); `fits` if the sizes of a and b can link.

    rows: region, salt, node, n. Regions arrive sorted and are streamed: a large one keeps its pivot only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region: tuple | None = None
        held: list[tuple[int, int]] = []
        large = False
        out: list[tuple] = []

        def close() -> None:
            if not large:
                for i, (x, nx) in enumerate(held):
                    for y, ny in held[i + 1 :]:
                        if x != y and 100 * min(nx, ny) >= PERCENT * max(nx, ny):
                            out.append((min(x, y), max(x, y), False, None, True))

        def taken() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else ([], [], [], [], [])
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "b", "star", "region", "fits"])
            out.clear()
            return b

        for batch in batches:
            key, salt, node, n = (batch.column(c).to_numpy() for c in ("region", "salt", "node", "n"))
            if not len(key):
                continue
            edge = np.concatenate(([True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
            alone = edge & np.concatenate((edge[1:], [False])) & (salt < 0)  # regions of one document within the batch
            alone[0] = False
            start = np.flatnonzero(edge)
            stop = np.append(start[1:], len(key))
            kept = ~alone[start]
            for a, b in zip(start[kept].tolist(), stop[kept].tolist(), strict=True):
                here = (int(key[a]), int(salt[a]))
                if here != region:
                    close()
                    region, held, large = here, [], here[1] >= 0
                    pivot, size = int(node[a]), int(n[a])
                own = here[0] if here[1] >= 0 else None
                for x, nx in zip(node[a:b].tolist(), n[a:b].tolist(), strict=True):
                    if large:
                        out.append((pivot, x, True, own, 100 * min(nx, size) >= PERCENT * max(nx, size)))
                        continue
                    held.append((x, nx))
                    if len(held) > SMALL:
                        large = True
                        out += [(pivot, y, True, own, 100 * min(ny, size) >= PERCENT * max(ny, size)) for y, ny in held]
                if len(out) > 20_000:
                    yield taken()
        close()
        yield taken()

    placed = rows.repartition("region", "salt").sortWithinPartitions("region", "salt", F.xxhash64("node"), "node")
    return placed.mapInArrow(run, "a long, b long, star boolean, region long, fits boolean")


def close_enough(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b, n) that sizes and distances to the fixed pivots leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m, n = (b.column(c).to_numpy() for c in ("na", "nb"))
                # intersection >= p / (100 + p) * (m + n), so h <= (100 - p) / (100 + p) * (m + n)
                keep = 100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)
                x, y = (b.column(c) for c in ("ca", "cb"))
                for i in np.flatnonzero(keep).tolist():
                    u, v = (np.frombuffer(c[i].as_buffer(), np.uint8).astype(np.int64) for c in (x, y))
                    few = min(len(u), len(v))
                    away = np.abs(u.reshape(few, -1).sum(axis=1) - v.reshape(few, -1).sum(axis=1)).sum()
                    keep[i] = (100 + PERCENT) * away <= (100 - PERCENT) * (m[i] + n[i])
                yield b.select(["a", "b", "n"]).filter(pa.array(keep))

    pairs = pairs.where("a < b")
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "na", "nb", "ca", "cb").mapInArrow(run, "a long, b long, n long")


def verified(pairs: DataFrame, docs: DataFrame, per_part: int = 2000) -> DataFrame:
    """Pairs (a, b) whose texts link. Texts of `a` go to as many parts as its pairs fill, so a hot one stays spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pivot = None, np.zeros(0, np.uint64)
        for b in unpacked(batches):
            out_a, out_b = [], []
            for a, other, s in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), shingle_sets(b.column("text")), strict=True):
                if other is None:
                    own, pivot = a, s
                elif a == own:
                    both = len(np.intersect1d(pivot, s, assume_unique=True))
                    if both and 100 * both >= PERCENT * (len(pivot) + len(s) - both):
                        out_a.append(a)
                        out_b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # spares a shuffle of all texts; beyond the bound they are shuffled
    texts = checkpointed(packed(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")))
    centre = parts.join(texts, parts.a == texts.doc_id).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    other = pairs.join(parts, "a").join(texts, F.col("b") == texts.doc_id).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "text")
    linked = checkpointed(centre.union(other).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).select("a", "b", "text").mapInArrow(run, "a long, b long").distinct())
    discard(texts)
    return linked


class Block:
    """Shingle sets of a block of documents, for counting intersections with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        value = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(value, kind="stable")
        self.value, first, count = np.unique(value[order], return_index=True, return_counts=True)
        self.first, self.count, self.row = first, count, row[order]
        self.column = np.full(len(count), -1)
        often = np.flatnonzero(count >= DENSE)
        self.column[often] = np.arange(len(often))
        self.dense = np.zeros((len(sets), len(often)), np.float32)
        for c, k in enumerate(often.tolist()):
            self.dense[self.row[first[k] : first[k] + count[k]], c] = 1

    def shared(self, sets: list[np.ndarray]) -> np.ndarray:
        """Intersection sizes (sets, block)."""
        value = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.value, value), len(self.value) - 1)
        there = self.value[at] == value
        at, row = at[there], row[there]
        column = self.column[at]
        often = column >= 0
        other = np.zeros((len(sets), self.dense.shape[1]), np.float32)
        other[row[often], column[often]] = 1
        at, row = at[~often], row[~often]
        count = self.count[at]
        begin = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(begin - self.first[at], count)
        pair = np.repeat(row, count) * len(self.size) + self.row[place]
        rare = np.bincount(pair, minlength=len(sets) * len(self.size)).reshape(len(sets), -1)
        return rare + np.rint(other @ self.dense.T).astype(np.int64)


def packed(rows: DataFrame) -> DataFrame:
    """doc_id and text of rows, texts compressed: they are shuffled once for each pair, or block and slice, and shuffles compress less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches):
            texts = pa.array([small.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), texts], names=["doc_id", "text"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, text binary")


def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts as they were, about a step of them at a time."""
    import zstandard

    whole = zstandard.ZstdDecompressor()
    for b in batches:
        at, texts, size = b.schema.names.index("text"), [], 0
        for end, text in enumerate(b.column("text").to_pylist(), 1):
            texts.append(whole.decompress(text))
            size += len(texts[-1])
            if size >= STEP_BYTES or end == b.num_rows:
                yield b.slice(end - len(texts), len(texts)).set_column(at, "text", pa.array(texts, pa.binary()))
                texts, size = [], 0


def folded(counts: np.ndarray, bits: int) -> np.ndarray:
    """Counts (the last axis) in 2^bits hash classes, made from those in as many or more."""
    return counts.reshape(*counts.shape[:-1], 1 << bits, -1).sum(axis=-1, dtype=np.float32)


def with_partners(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows (cell, block, slice, held, node, component, n) that sizes and distances to the fixed pivots leave a partner of another component in their block and slice.

    Held rows are a block, the others are streamed past it; counts stand for texts, a tenth of their bytes or less.
    """
    names = ["cell", "block", "slice", "held", "node", "component"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held, found = None, [], np.zeros(0, bool)
        out: list[tuple] = []

        def close() -> None:
            out.extend((*where, True, held[i][0], held[i][1]) for i in np.flatnonzero(found).tolist())

        def taken() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), kinds, strict=True)], names=names)
            out.clear()
            return b

        for b in batches:
            for cell, block, piece, own, node, part, n, c in zip(*(b.column(x).to_pylist() for x in (*names, "n", "counts")), strict=True):
                if (cell, block, piece) != where:
                    close()
                    where, held, found, at = (cell, block, piece), [], np.zeros(0, bool), {}
                x = np.frombuffer(c, np.uint8)
                if own:
                    held.append((node, part, n, x))
                    continue
                if not held:
                    continue
                if not at:
                    parts, size, found = np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.zeros(len(held), bool)
                    least = min(len(h[3]) for h in held).bit_length() - 1
                    at[least] = np.stack([folded(h[3], least) for h in held])
                bits = min(least, len(x).bit_length() - 1)
                if bits not in at:
                    at[bits] = folded(at[least], bits)
                away = np.abs(at[bits] - folded(x, bits)) @ np.ones(1 << bits, np.float32)
                fits = (parts != part) & (100 * np.minimum(size, n) >= PERCENT * np.maximum(size, n)) & ((100 + PERCENT) * away.astype(np.int64) <= (100 - PERCENT) * (size + n))
                if fits.any():
                    found |= fits
                    out.append((*where, False, node, part))
            if out:
                yield taken()
        close()
        yield taken()

    placed = rows.join(classes.select("node", "counts"), "node").repartition("cell", "block", "slice").sortWithinPartitions("cell", "block", "slice", F.desc("held"), "node")
    return placed.select(*names, "n", "counts").mapInArrow(run, "cell long, block string, slice int, held boolean, node long, component long")


def outside_links(members: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the outsiders of open cells and any document of the cell, for each outsider one a component and chunk at least.

    members: cell, node, n, component, outer. Outsiders are blocked by size, and a block meets the documents of its cell whose
    sizes can link with one of its own; it is held and they are streamed past it, in slices that each have a task. Both are
    counts first, and texts only of those that then have a possible partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, block, nodes, parts, sets = None, None, [], [], []
        todo: list[tuple] = []
        out: list[tuple] = []

        def compare() -> None:
            if todo and block is not None:
                both = block.shared([t[2] for t in todo])
                size = np.array([len(t[2]) for t in todo])
                hit = 100 * both >= PERCENT * (size[:, None] + block.size[None, :] - both)
                told = set()
                for i, j in zip(*np.nonzero(hit), strict=True):
                    node, part, _ = todo[i]
                    if part != parts[j] and (nodes[j], part) not in told:
                        told.add((nodes[j], part))
                        out.append((min(node, nodes[j]), max(node, nodes[j])))
            todo.clear()

        for b in unpacked(batches):
            here = zip(*(b.column(c).to_pylist() for c in ("cell", "block", "slice", "held", "node", "component")), shingle_sets(b.column("text")), strict=True)
            for cell, number, piece, held, node, part, s in here:
                if (cell, number, piece) != where:
                    compare()
                    where, block, nodes, parts, sets = (cell, number, piece), None, [], [], []
                if held:
                    nodes.append(node)
                    parts.append(part)
                    sets.append(s)
                    continue
                if block is None:
                    if not sets:
                        continue
                    block, sets = Block(sets), []
                todo.append((node, part, s))
                if len(todo) >= CHUNK:
                    compare()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
                out = []
        compare()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    band = F.floor(F.log("n") / math.log(1.1)).cast("int")
    outer = members.where("outer").withColumn("band", band)
    bands = outer.groupBy("cell", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("n").alias("least"), F.max("n").alias("most"))
    block = lambda number: F.concat_ws(":", "band", number).alias("block")
    slices = members.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    own = outer.join(bands.select("cell", "band", "blocks"), ["cell", "band"]).join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = own.select("cell", block(F.pmod(F.xxhash64("node"), F.col("blocks"))), "slice", F.lit(True).alias("held"), "node", "component", "n")
    fits = (100 * F.col("n") >= PERCENT * F.col("least")) & (PERCENT * F.col("n") <= 100 * F.col("most"))
    every = members.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int")).join(bands, "cell").where(fits)
    every = every.select("cell", "slice", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("number"), "node", "component", "n").select("cell", block("number"), "slice", F.lit(False).alias("held"), "node", "component", "n")
    near = checkpointed(with_partners(own.union(every), classes))
    ids = checkpointed(near.select(F.col("node").alias("doc_id")).distinct())
    packs = checkpointed(packed(docs.select("doc_id", "text").join(few(ids), "doc_id", "left_semi")))
    placed = near.join(packs.withColumnRenamed("doc_id", "node"), "node").repartition("cell", "block", "slice").sortWithinPartitions("cell", "block", "slice", F.desc("held"), "node").select("cell", "block", "slice", "held", "node", "component", "text")
    linked = checkpointed(placed.mapInArrow(run, "a long, b long").distinct())
    discard(near, ids, packs)
    return linked


def linked_classes(docs: DataFrame, classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(node, component) of classes that link with others; docs hold one document of each class."""
    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    parts = spark.createDataFrame([], "node long, component long")
    found = checkpointed(regions(windows(docs, frequent)))
    star = found.where("star")
    tops = star.where("region is not null and a = b").groupBy("region").agg(F.min("a").alias("top"))  # frequent regions only
    salted = star.where("region is not null").join(F.broadcast(tops), "region")
    pairs = found.where("fits").select("a", "b").union(salted.select("a", F.col("top").alias("b")).distinct())
    pairs = pairs.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    links, parts = joined(close_enough(pairs, classes), docs, links, parts)

    cells = star.where("region is null").select(F.col("a").alias("cell"), F.col("b").alias("node")).union(salted.select(F.col("top").alias("cell"), F.col("b").alias("node"))).distinct()
    cells = checkpointed(cells.join(parts, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("component")))
    discard(found)
    shares = cells.groupBy("cell", "component").agg(F.count("*").alias("k"))
    opened = shares.groupBy("cell").agg(F.max(F.struct("k", "component")).alias("most"), F.sum("k").alias("m")).where("m > most.k")
    opened = opened.select("cell", F.col("most.component").alias("main"))
    sized = cells.join(opened, "cell").join(classes.select("node", "n"), "node")
    members = checkpointed(sized.select("cell", "node", "n", "component", (F.col("component") != F.col("main")).alias("outer")))
    discard(cells)
    if not members.isEmpty():
        new = outside_links(members, docs, classes)
        if not new.isEmpty():
            parts = components(links.union(new))
    discard(members)
    return parts


def few(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are BROADCAST_IDS or fewer."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def between(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component."""
    left, right = (parts.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def joined(pairs: DataFrame, docs: DataFrame, links: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and components after comparing the texts of pairs (a, b, n: regions they share).

    First each document is compared with the one it shares most regions with; then only pairs are left that aren't in one
    component yet, and no component depends on the others.
    """
    pairs = checkpointed(pairs)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    for todo in (best, pairs.select("a", "b")):
        todo = checkpointed(between(todo, parts))
        if not todo.isEmpty():
            new = verified(todo, docs)
            if not new.isEmpty():
                links = links.union(new)
                last, parts = parts, components(links)
                discard(last)
        discard(todo)
    discard(pairs)
    return links, parts


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest id with the same shingles) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = ["n", "k1", "k2"]
    own = checkpointed(set_keys(docs))
    classes = checkpointed(own.where("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("node"), F.first("counts").alias("counts")))
    placed = own.drop("counts").join(classes.drop("counts"), keys, "left")
    copies = few(checkpointed(placed.where("doc_id != node").select("doc_id")))
    one = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti")
    parts = linked_classes(one, classes.select("node", "n", "counts"), frequent_shingles(one))
    out = placed.join(parts, "node", "left")
    mine = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(mine, F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("node", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that link, directly or not, with a row of a smaller id."""
    found = jaccard_join(docs)
    gone = checkpointed(found.where("component_id != doc_id").select("doc_id").distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
