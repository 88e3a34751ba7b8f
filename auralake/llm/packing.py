"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are cut into pieces of at most one sequence; pieces go to groups by a hash, and each group is packed by
itself, so no group needs more than a few thousand rows of counts in memory. Token ids never leave their task.

Null text counts as empty (one id, the end mark). Repeated rows are packed as often as they occur; ties of length go by
id, start and checksum. A null id stays null. An empty table gives an empty one. A text of any length is cut into pieces;
columns but doc_id and text are not used.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces

SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer of a file in the tokenizers library's format."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same byte-level vocabulary through tiktoken, which gives the same ids several times faster; None if the file is no such vocabulary."""
    import json

    import public_tokenizers
    import tiktoken

    spec = json.loads(_tokenizer(path).to_str())
    if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> np.ndarray:
    """Token ids as the tokenizers library gives them without special tokens added."""
    fast = _fast(path)
    if fast is None or SPECIAL in text:
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    try:
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
    except ValueError:  # its regex engine gives up on white space of about a million characters
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


class CapacityTree:
    """A tournament tree over bins: the leftmost bin with room for a size in log time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put `size` in the leftmost bin with room, and give that bin."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        free[at] -= size
        leaf = at
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return leaf - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes must already be in falling order."""
    tree = CapacityTree(len(sizes), capacity)
    return [tree.place(s) for s in sizes]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Each document's ids and an end mark, cut into pieces of at most `capacity`; `turn` tells equal documents of a task apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        task = TaskContext.get().partitionId() << 32
        for b in pieces(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or "", path), np.uint32(end_id)).astype("<u4")
                own = (doc, zlib.crc32(ids.tobytes()))
                turn = task + seen[own] if seen[own] else 0
                seen[own] += 1
                out += [(doc, i, len(part := ids[i : i + capacity]), zlib.crc32(part.tobytes()), len(ids), turn) for i in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[*NAMES, "turn"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", turn long")


def pack(docs: DataFrame, path: str, capacity: int = 1024, group_size: int = 4096, seed: int = 11) -> DataFrame:
    """Pieces with the sequence that holds them and their offset there.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `group_size` is about the number of pieces
    of a group, from the bytes of the texts. Pieces go to groups by a hash of id, start, ids and, for repeated documents,
    their turn, so neither null ids nor repeated rows fill one group; a sequence id is its group's number times 2 ** 32
    plus the bin's number.
    """
    each = F.lit(1) + F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) / F.lit(4 * capacity)
    groups = max(1, math.ceil((docs.agg(F.sum(each)).first()[0] or 0) / group_size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None
        for batch in batches:
            key = batch.column("grp").to_numpy()
            bounds = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a < b:
                    if held and key[a] != group:
                        yield placed(held, group)
                        held = []
                    group = int(key[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield placed(held, group)

    def placed(held: list[pa.RecordBatch], group: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        sizes = t.column("length").to_pylist()
        bins = first_fit_decreasing(sizes, capacity)
        used: dict[int, int] = {}
        offset = []
        for s, k in zip(sizes, bins, strict=True):
            offset.append(used.get(k, 0))
            used[k] = offset[-1] + s
        cols = [t.column(c).combine_chunks() for c in NAMES]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        return pa.RecordBatch.from_arrays([*cols, pa.array([(group << 32) + k for k in bins], pa.int64()), pa.array(offset, pa.int64())], names=[*NAMES, "sequence_id", "offset"])

    spread = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", "turn")
    cut = token_pieces(docs, path, capacity).withColumn("grp", F.pmod(spread, F.lit(groups))).drop("turn")
    ordered = cut.repartition("grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start", "ids_crc32")
    return ordered.mapInArrow(run, PIECES + ", sequence_id long, offset long")
