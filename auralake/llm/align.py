"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

Within a task everything is Arrow: token lists are flattened with their parents' indices, byte ends are segmented cumulative
sums, an Acero hash join on (document, end) finds the places where tokens of both end, and `Table.group_by` counts the
documents of each pair of ids. A step's documents share one dictionary of pairs; its counts are what Spark merges, and the
corpus-wide counts come back by dictionary, so a pair shuffles once a step and not once a document that holds it.

The first tokenizer (byte-level BPE) encodes a space and the text, the second (sentencepiece) the text, to which it adds that
space itself; special tokens' strings are plain text. Null and empty texts, and those whose token bytes differ from space
and text (the second one may normalise), have no tokens: zeros and ''. Every row counts as a document, repeated ones and
those with a null id too; of ids with equally frequent partners all are best. An empty table gives an empty one. Texts are
encoded whole; a group of many tokens on both sides, as misaligned runs of one character give, is counted by distinct ids
and never written out as pairs of occurrences. Columns but doc_id and text are not used.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .packing import _fast, _tokenizer
from .text import checkpointed, discard, pieces, raw

#: Links that are written out at a time; a group of more is counted by distinct ids.
LINKS = 1 << 20

PARTS = "part long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, a array<int>, b array<int>, docs array<long>, held array<int>, gaps binary, times binary"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "a", "b", "docs", "held", "gaps", "times"]


class Tokens:
    """Token ids of a column of texts, one list a row, and the bytes of each id."""

    def __init__(self, vocabulary: list[bytes]):
        self.vocabulary = pa.array(vocabulary, pa.large_binary())
        self.size = pc.binary_length(self.vocabulary)

    def spelled(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, one after another, and the bounds of each row."""
        data, ends = raw(self.vocabulary.take(pc.list_flatten(lists)))
        return data, ends[lists.offsets.to_numpy()]


class ByteLevel(Tokens):
    def __init__(self, path: str):
        self.path, self.fast = path, _fast(path)
        if self.fast is None:
            raise ValueError(f"{path} is no byte-level BPE vocabulary")
        entries = json.loads(_tokenizer(path).to_str())
        known = {i: self.fast.decode_single_token_bytes(i) for i in entries["model"]["vocab"].values() if i < self.fast.n_vocab}
        known |= {t["id"]: t["content"].encode() for t in entries.get("added_tokens", [])}
        super().__init__([known.get(i, b"") for i in range(max(known) + 1)])

    def encode(self, texts: list[str]) -> pa.ListArray:
        ids = [self._one(" " + t) for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids], dtype=np.int64))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32()))

    def _one(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.int32)
        except ValueError:  # its regex engine gives up on white space of about a million characters
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(self.path)
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.int32)


class Pieces(Tokens):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        piece = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)])

    def encode(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.model.encode(texts, num_threads=1) if texts else [], pa.list_(pa.int32()))


@lru_cache(maxsize=2)
def _tokens(kind: type, path: str) -> Tokens:
    return kind(path)


@lru_cache(maxsize=2)
def _written(n: int) -> pa.Array:
    """The numbers below n, each followed by a comma, then each by a bar, a semicolon and nothing."""
    return pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(n)], pa.large_string())


def _ends(tokens: Tokens, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, rows and, within its row, the byte end of each token."""
    ids, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    total = pc.cumulative_sum(pc.cast(tokens.size.take(ids), pa.int64())).to_numpy()
    before = np.concatenate(([0], total))[lists.offsets.to_numpy()]
    return ids.to_numpy().astype(np.int64), row, total - before[row]


def _links(row: np.ndarray, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, groups: int, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, a, b) of linked tokens as one number each, in order, and how many pairs of occurrences each stands for."""
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
    keys, times = [], []

    def add(key: np.ndarray, weight: np.ndarray | None = None) -> None:
        t = pa.table({"key": key, "times": np.ones(len(key), np.int64) if weight is None else weight}).group_by("key", use_threads=False).aggregate([("times", "sum")])
        keys.append(t["key"].to_numpy())
        times.append(t["times_sum"].to_numpy())

    head = (row << sum(bits)) | (a << bits[1])
    large = na * nb > LINKS
    for g in np.flatnonzero(large):  # by distinct ids, a slice of the first side at a time
        (ua, ca), (ub, cb) = (np.unique(v[f : f + n], return_counts=True) for v, f, n in ((head, first_a[g], na[g]), (b, first_b[g], nb[g])))
        step = max(1, LINKS // len(ub))
        for at in range(0, len(ua), step):
            add((ua[at : at + step, None] | ub).ravel(), np.outer(ca[at : at + step], cb).ravel())
    width = np.where(large, 0, nb)[ga]
    done = np.concatenate(([0], np.cumsum(width)))
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(done, done[at] + LINKS, "right")) - 1)
        w = width[at:end]
        other = np.arange(int(w.sum())) + np.repeat(first_b[ga[at:end]] - (done[at:end] - done[at]), w)
        add(np.repeat(head[at:end], w) | b[other])
        at = end
    if len(keys) > 1:
        add(np.concatenate(keys), np.concatenate(times))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys[-1])
    return keys[-1][order], times[-1][order]


def aligned(texts: list[str | None], first: Tokens, second: Tokens) -> dict:
    """Figures of each text; the dictionary of its pairs (a, b, docs) and each text's share of it (held, gaps, times)."""
    n = len(texts)
    live = np.flatnonzero([bool(t) for t in texts])
    lists = [t.encode([texts[i] for i in live]) for t in (first, second)]
    want, bounds = raw(pa.array([" " + texts[i] for i in live], pa.large_string()))
    same = np.ones(len(live), bool)
    spelled = [t.spelled(x) for t, x in zip((first, second), lists, strict=True)]
    for _, own in spelled:
        same &= np.diff(own) == np.diff(bounds)
    for got, own in spelled:
        if same.all():
            differ = np.flatnonzero(got != want)
            same[np.searchsorted(bounds, differ, "right") - 1] = False
        else:
            for i in np.flatnonzero(same):
                same[i] = np.array_equal(got[own[i] : own[i + 1]], want[bounds[i] : bounds[i + 1]])
    if not same.all():
        lists = [x.filter(pa.array(same)) for x in lists]
        live = live[same]
    (a, row_a, end_a), (b, row_b, end_b) = (_ends(t, x) for t, x in zip((first, second), lists, strict=True))
    ends = [pa.table({"doc": r, "end": e}) for r, e in ((row_a, end_a), (row_b, end_b))]
    cuts = ends[0].join(ends[1], keys=["doc", "end"], join_type="inner", use_threads=False)
    doc = cuts["doc"].to_numpy()
    base = np.concatenate(([0], np.cumsum(np.bincount(row_a, weights=first.size.take(pa.array(a)).to_numpy(), minlength=len(live)).astype(np.int64))))
    cut = np.sort(base[doc] + cuts["end"].to_numpy())
    ga, gb = (np.searchsorted(cut, base[r] + e) for r, e in ((row_a, end_a), (row_b, end_b)))
    bits = tuple(max(1, (len(t.vocabulary) - 1).bit_length()) for t in (first, second))
    key, times = _links(row_a, a, ga, b, gb, len(cut), bits)
    row, pair = key >> sum(bits), key & ((1 << sum(bits)) - 1)
    counts = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by("pair")
    known = counts["pair"].to_numpy()
    place = np.searchsorted(known, pair).astype(np.int32)
    starts = np.searchsorted(row, np.arange(len(live) + 1))
    gaps = np.diff(place, prepend=np.int32(0))
    inner = starts[:-1][np.diff(starts) > 0]
    gaps[inner] = place[inner]

    written = _written(max(len(first.vocabulary), len(second.vocabulary)))
    width = len(written) // 4
    na, nb = np.bincount(ga, minlength=len(cut)), np.bincount(gb, minlength=len(cut))
    text = np.zeros(len(a) + len(b), np.int64)
    close = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
    text[np.arange(len(a)) + (np.cumsum(nb) - nb)[ga]] = a + width * close(ga)
    text[np.arange(len(b)) + np.cumsum(na)[gb]] = b + width * 2 * close(gb)
    size_a, size_b = (np.bincount(r, minlength=len(live)) for r in (row_a, row_b))
    last = np.cumsum(size_a + size_b)
    text[last - 1] += width
    body, at = raw(written.take(pa.array(text)))
    at, whole = at[np.concatenate(([0], last))], memoryview(body)
    sha = np.full(n, "", object)
    sha[live] = [hashlib.sha256(whole[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]

    def spread(v: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[live] = v
        return out

    links = np.zeros(len(live), np.int64)
    np.add.at(links, row, times)
    held = spread(np.diff(starts))
    return {
        "n_a": spread(size_a), "n_b": spread(size_b), "n_groups": spread(np.bincount(doc, minlength=len(live))), "n_links": spread(links), "sha": sha, "a": (known >> bits[1]).astype(np.int32), "b": (known & ((1 << bits[1]) - 1)).astype(np.int32),
        "docs": counts["pair_count"].to_numpy(), "held": held.astype(np.int32), "gaps": gaps.astype("<i4").tobytes(), "times": times.astype("<i4").tobytes(),
    }


def _parts(docs: DataFrame, first: tuple[type, str], second: tuple[type, str]) -> DataFrame:
    """A row for each step of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        schema = pa.schema([pa.field("part", pa.int64()), *(pa.field(c, pa.list_(pa.int64())) for c in COLUMNS[:5]), pa.field("sha", pa.list_(pa.string())), pa.field("a", pa.list_(pa.int32())), pa.field("b", pa.list_(pa.int32())), pa.field("docs", pa.list_(pa.int64())), pa.field("held", pa.list_(pa.int32())), pa.field("gaps", pa.binary()), pa.field("times", pa.binary())])
        for k, b in enumerate(pieces(batches)):
            found = aligned(b.column("text").to_pylist(), _tokens(*first), _tokens(*second)) | {"doc_id": b.column("doc_id").to_pylist(), "part": task + k}
            yield pa.RecordBatch.from_arrays([pa.array([found[f.name]], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PARTS)


def _figures(parts: DataFrame) -> DataFrame:
    """A row for each document of parts with their pairs' counts."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                held = value["held"].values.to_numpy()
                gaps, times = (np.frombuffer(value[c].as_py(), "<i4").astype(np.int64) for c in ("gaps", "times"))
                bounds = np.concatenate(([0], np.cumsum(held)))
                total = np.concatenate(([0], np.cumsum(gaps)))
                place = total[1:] - np.repeat(total[bounds[:-1]], held)
                count, best = (value[c].values.to_numpy() if value[c].is_valid else np.zeros(0, np.int64) for c in ("count", "best"))
                sums = [np.concatenate(([0], np.cumsum(times * v[place]))) for v in (best, count)]
                yield pa.RecordBatch.from_arrays([*(value[c].values for c in names[:5]), *(pa.array(s[bounds[1:]] - s[bounds[:-1]], pa.int64()) for s in sums), value["sha"].values], names=names)

    return parts.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_tokens(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    parts = checkpointed(_parts(docs, (ByteLevel, byte_level), (Pieces, piece_model)))
    entries = parts.select("part", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("place", "e")).select("part", "place", "e.a", "e.b", "e.docs")
    counts = entries.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("a"))).cast("long"))
    back = entries.join(counts, ["a", "b"]).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("known"))
    own = parts.drop("a", "b", "docs").join(back.select("part", F.col("known.count").alias("count"), F.col("known.best").alias("best")), "part", "left")
    out = checkpointed(_figures(own))
    discard(parts)
    return out
