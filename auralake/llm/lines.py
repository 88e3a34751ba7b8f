"""Line dedup by a log-template tree.

A line's tokens are its words; a token with a digit, an at-sign or a scheme is a variable field. The tree has a fixed
depth: token count, then the first LEADING tokens. In a leaf a token that `min_contexts` or more texts have at its place is
constant, others are variable. A line whose constant tokens are a share of `similarity` or more belongs to the template that
they and the gaps between them make; any other line is a template of its own. Templates that recur across documents are
dropped: with `min_contexts` or more different contexts. A context is a group of near copies (see copies; `alike` of their
word triples agree) or a text without any, so what only copies of a document share is no template and stays, a group counts
once whatever copies it holds, and a block of several lines counts in each unrelated document whatever its own lines have
beside them.

Lines of one or two words are judged like longer ones. Null text stays null, and documents stay even if nothing is left of
them; an empty table gives an empty one. Repeated rows are one text when counted. Lines end at "\\n" only and have any
length. Other columns are carried along whatever their names; an added column whose name is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .copies import copy_groups, sketches
from .text import SMALL_STEP, Words, _power, checkpointed, discard, mix, pieces, span_hashes

LEADING = 3
FIELD = np.uint64(0x5EED_F1E1D)
VARIABLE = np.zeros(256, bool)
VARIABLE[list(b"0123456789@")] = True
#: Hashes that are broadcast, at most (8 bytes each); beyond it tables are joined.
BROADCAST = 1 << 20


class Lines:
    """The worded lines of a string column: row, number in its text, bounds, token count and leaf of each; other hashes as asked for."""

    def __init__(self, text: pa.Array):
        w = self.words = Words(text)
        breaks = np.flatnonzero(w.data == 10)
        fresh = np.zeros(len(w.start) + 1, bool)
        fresh[np.searchsorted(w.start, breaks)] = True
        fresh[w.first] = True
        self.first = np.flatnonzero(fresh[:-1])
        self.end = np.append(self.first[1:], len(w.start))[: len(self.first)]
        self.count = self.end - self.first
        self.row = w.row[self.first]
        self.number = np.searchsorted(breaks, w.start[self.first]) - np.searchsorted(breaks, w.off[self.row])  # of the line in its text
        leaf = self.count.astype(np.uint64)
        lead = np.minimum(self.count, LEADING)
        token = self._tokens(runs(self.first, lead))
        base = np.cumsum(lead) - lead
        with np.errstate(over="ignore"):
            for k in range(LEADING if len(leaf) else 0):
                leaf = mix(leaf * np.uint64(31) + np.where(k < lead, token[base + np.minimum(k, lead - 1)], np.uint64(1)))
        self.leaf = leaf

    def _tokens(self, word: np.ndarray) -> np.ndarray:
        """The token hashes of some words; only their bytes are worked on."""
        w = self.words
        data, start, end = w.data, w.start, w.end
        if len(word) < len(start):
            size = (end - start)[word]
            data = data[runs(start[word], size)]
            end = np.cumsum(size)
            start = end - size
        odd = np.concatenate(([0], np.cumsum(VARIABLE[data], dtype=np.int32)))
        return np.where(odd[end] > odd[start], FIELD, span_hashes(data, start, end))

    def hashes(self, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the lines `at` (all, if None): the hash of each, their tokens one after another, and where each begins there."""
        first, count = (self.first, self.count) if at is None else (self.first[at], self.count[at])
        token = self._tokens(runs(first, count))
        end = np.cumsum(count)
        start = end - count
        power, inverse = _power(len(token) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(token * power[: len(token)])))
            return mix((total[end] - total[start]) * inverse[start] ^ count.astype(np.uint64)), token, start


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, `size` of them, for one after another."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _once(row: np.ndarray, key: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Where each pair of text and key comes first, in order."""
    return np.sort(np.unique(mix(key ^ mix(body.view(np.uint64)[row])), return_index=True)[1])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with underscores appended while it is taken (in any case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def leaf_table(docs: DataFrame) -> DataFrame:
    """(leaf, body: hash of the text) of the lines, once a text or nearly so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SMALL_STEP):
            t = Lines(b.column("text"))
            body = b.column("body").to_numpy()
            at = _once(t.row, t.leaf, body)
            yield pa.RecordBatch.from_arrays([_signed(t.leaf[at]), pa.array(body[t.row[at]])], names=["leaf", "body"])

    return docs.select("text", F.xxhash64("text").alias("body")).mapInArrow(run, "leaf long, body long")


def line_table(docs: DataFrame, leaves: np.ndarray | None, tokens: bool) -> DataFrame:
    """Lines as (leaf, line, body: hash of the text), once a text, and their token hashes; only those of `leaves` (sorted) if given."""
    shared = docs.sparkSession.sparkContext.broadcast(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SMALL_STEP):
            t = Lines(b.column("text"))
            at = np.arange(len(t.leaf)) if shared.value is None else np.flatnonzero(member(t.leaf, shared.value))
            line, token, start = t.hashes(at)
            body = b.column("body").to_numpy()
            once = _once(t.row[at], line, body)
            line, start, at = line[once], start[once], at[once]
            cols = [_signed(t.leaf[at]), _signed(line), pa.array(body[t.row[at]])]
            if tokens:
                own = _signed(token[runs(start, t.count[at])])
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(t.count[at])), pa.int32()), own))
            yield pa.RecordBatch.from_arrays(cols, names=["leaf", "line", "body", "tokens"][: len(cols)])

    rows = docs.select("text", F.xxhash64("text").alias("body"))
    return rows.mapInArrow(run, "leaf long, line long, body long" + (", tokens array<long>" if tokens else ""))


def sketch_table(docs: DataFrame) -> DataFrame:
    """(body, sketch) of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SMALL_STEP):
            t = Lines(b.column("text"))
            row, sketch = sketches(t.hashes()[1], t.first, t.count, t.row)
            yield pa.RecordBatch.from_arrays([b.column("body").take(pa.array(row)), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["body", "sketch"])

    return docs.select("text", F.xxhash64("text").alias("body")).mapInArrow(run, "body long, sketch binary")


def grow_templates(lines: DataFrame, similarity: float, support: int) -> DataFrame:
    """(leaf, line, template) from distinct lines (leaf, line, n: texts, tokens).

    Counts of (leaf, place, token) alone decide what is constant, so a line's template depends neither on an order nor on
    how the lines are dealt over tasks, and no task holds a leaf.
    """
    each = lines.select("leaf", "line", "n", F.posexplode("tokens").alias("place", "token"))
    constant = checkpointed(each.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("leaf", "place", "token", F.lit(True).alias("constant")))
    known = F.broadcast(constant) if constant.count() <= BROADCAST else constant
    marked = each.drop("n").join(known, ["leaf", "place", "token"], "left").withColumn("kept", F.when(F.col("constant"), F.col("token")))
    shape = F.array_sort(F.collect_list(F.struct("place", "token", "kept")))
    whole = marked.groupBy("leaf", "line").agg(shape.alias("shape"), F.count("kept").alias("constants"), F.count("*").alias("places"))
    own = F.when(F.col("constants") >= similarity * F.col("places"), F.xxhash64(F.transform("shape", lambda s: F.coalesce(s["kept"], F.lit(0)))))
    return whole.select("leaf", "line", F.coalesce(own, F.xxhash64("line", F.lit("own"))).alias("template"))


def recurring(table: DataFrame, keys: list[str], min_contexts: int) -> DataFrame:
    """Keys with enough different contexts (origin)."""
    return table.select(*keys, "origin").distinct().groupBy(*keys).agg(F.count("*").alias("contexts")).where(F.col("contexts") >= min_contexts)


def recurring_lines(docs: DataFrame, similarity: float = 0.75, min_contexts: int = 8, alike: float = 0.55) -> DataFrame:
    """(leaf, line) of all lines whose template recurs across documents."""
    held = leaf_table(docs).distinct().groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_contexts).select("leaf")
    leaves = checkpointed(held)  # a template has no more contexts than its leaf has texts
    known = None
    if leaves.count() <= BROADCAST:
        known = np.sort(leaves.toPandas().leaf.to_numpy(np.int64).view(np.uint64))
    full = line_table(docs, known, True)
    full = checkpointed(full if known is not None else full.join(leaves, "leaf", "left_semi"))
    distinct = full.groupBy("leaf", "line").agg(F.countDistinct("body").alias("n"), F.min("tokens").alias("tokens"))
    named = checkpointed(grow_templates(distinct, similarity, min_contexts))
    if named.count() <= BROADCAST:
        named = F.broadcast(named)
    groups = copy_groups(sketch_table(docs), alike)
    placed = full.select("leaf", "line", "body").join(groups, "body", "left").withColumn("origin", F.coalesce("origin", "body"))
    kept = checkpointed(placed.join(named, ["leaf", "line"]))
    discard(leaves, full)
    wanted = checkpointed(recurring(kept, ["leaf", "template"], min_contexts).select("leaf", "template"))
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    gone = checkpointed(kept.join(wanted, ["leaf", "template"], "left_semi").select("leaf", "line").distinct())
    discard(kept)
    return gone


def drop_templates(docs: DataFrame, counts: bool = True, **options) -> DataFrame:
    """docs with the lines of recurring templates taken out of `text`; with `counts`, n_lines and n_dropped (worded lines) are added."""
    spark, names = docs.sparkSession, docs.columns
    gone = recurring_lines(docs.select(F.col("text").cast("string").alias("text")), **options)
    flat = [f"c{k}" for k in range(len(names))]
    at = flat[names.index("text")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f) for c, f in zip(names, flat, strict=True)]).withColumn(at, F.col(at).cast("string"))
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    known = None
    if gone.count() <= BROADCAST:
        got = gone.toPandas()
        known = spark.sparkContext.broadcast([np.unique(got[c].to_numpy(np.int64).view(np.uint64)) for c in ("leaf", "line")])
        rows = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    else:  # line by line through a join
        rows = rows.withColumn("body", F.xxhash64(at))
        own = line_table(docs.select("text"), None, False).select("body", "line").distinct().join(gone.select("line"), "line", "left_semi")
        rows = rows.join(own.groupBy("body").agg(F.collect_list("line").alias("gone")), "body", "left").drop("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at, SMALL_STEP):
            t = Lines(b.column(at))
            drop = np.zeros(len(t.leaf), bool)
            if known is not None:
                leaves, lines = known.value
                own = np.flatnonzero(member(t.leaf, leaves))
                drop[own] = member(t.hashes(own)[0], lines)
            else:
                for r, lines in enumerate(b.column("gone").to_pylist()):
                    if lines:
                        own = np.arange(*np.searchsorted(t.row, [r, r + 1]))
                        drop[own] = member(t.hashes(own)[0], np.sort(np.array(lines, np.int64).view(np.uint64)))
            texts = b.column(at).to_pylist()
            for r in np.unique(t.row[drop]).tolist():
                a, z = np.searchsorted(t.row, [r, r + 1])
                lost = set(t.number[a:z][drop[a:z]].tolist())
                texts[r] = "\n".join(x for k, x in enumerate(texts[r].split("\n")) if k not in lost)
            total = np.bincount(t.row, minlength=b.num_rows)
            dropped = np.bincount(t.row[drop], minlength=b.num_rows)
            cols = [pa.array(texts, pa.string()) if f == at else b.column(f) for f in flat]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total.astype(np.int64)), pa.array(dropped.astype(np.int64))], names=[*flat, "n_lines", "n_dropped"])

    done = rows.mapInArrow(run, f"{fields}, n_lines long, n_dropped long")
    added = [F.col(c).alias(free_name(c, names)) for c in ("n_lines", "n_dropped")] if counts else []
    return done.select(*[F.col(f).alias(c) for c, f in zip(names, flat, strict=True)], *added)
