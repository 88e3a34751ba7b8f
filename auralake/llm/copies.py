"""Groups of near copies among texts, by min-hash sketches.

A sketch has SLOTS minima over a text's word triples. Texts that agree in SLOTS_A_BAND slots of a band meet, sorted by
the slots that follow; neighbours in that order are linked if at least `alike` of the remaining slots, which neither the
band nor the order has chosen, agree. Groups are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import mix

SLOTS, BANDS, SLOTS_A_BAND, ORDER = 64, 16, 3, 4
#: Texts before it in the order that each text is compared with.
NEIGHBOURS = 2
_FACTOR = np.random.default_rng(20240611).integers(1, 1 << 63, SLOTS, dtype=np.uint64) | np.uint64(1)


def sketches(token: np.ndarray, first: np.ndarray, count: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and SLOTS 16-bit minima of each.

    token: all words; first, count, row: of each line. A triple ends at each word and doesn't reach back over its line.
    """
    if not len(token):
        return np.zeros(0, np.int64), np.zeros((0, SLOTS), np.uint16)
    place = np.arange(len(token)) - np.repeat(first, count)
    with np.errstate(over="ignore"):
        gram = token * np.uint64(3)
        for k in (1, 2):
            gram[k:] = mix(gram[k:] + np.where(place[k:] >= k, token[:-k], np.uint64(k)))
        gram = mix(gram)
        fresh = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out = np.empty((len(fresh), SLOTS), np.uint16)
        for k in range(SLOTS):
            out[:, k] = (mix(np.minimum.reduceat(gram * _FACTOR[k], first[fresh])) & np.uint64(0xFFFF)).astype(np.uint16)
    return row[fresh], out


def links(table: DataFrame, alike: float) -> DataFrame:
    """(a, b) of neighbouring near copies among the texts of `table` (body, sketch), one row a text."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sketch = np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint16).reshape(-1, SLOTS)
            for j in range(BANDS):
                s = np.roll(sketch, -SLOTS_A_BAND * j, axis=1).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = mix((s[:, 0] << np.uint64(32) | s[:, 1] << np.uint64(16) | s[:, 2]) * np.uint64(BANDS) + np.uint64(j))
                order = np.zeros(len(s), np.uint64)
                for k in range(ORDER):
                    order = order << np.uint64(16) | s[:, SLOTS_A_BAND + k]
                rest = np.ascontiguousarray(s[:, SLOTS_A_BAND + ORDER :].astype(np.uint8))
                cols = [pa.array(key.view(np.int64)), pa.array(order.view(np.int64)), b.column("body"), pa.array([x.tobytes() for x in rest], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "place", "body", "rest"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = SLOTS - SLOTS_A_BAND - ORDER
        key, body, rest = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint8)
        for b in batches:
            old = len(key)
            key = np.concatenate((key, b.column("key").to_numpy()))
            body = np.concatenate((body, b.column("body").to_numpy()))
            rest = np.concatenate((rest, np.frombuffer(b"".join(b.column("rest").to_pylist()), np.uint8).reshape(-1, width)))
            for k in range(1, NEIGHBOURS + 1):
                at = np.arange(max(old, k), len(key))
                at = at[key[at] == key[at - k]]
                at = at[(rest[at] == rest[at - k]).mean(axis=1) >= alike]
                yield pa.RecordBatch.from_arrays([pa.array(body[at]), pa.array(body[at - k])], names=["a", "b"])
            key, body, rest = key[-NEIGHBOURS:], body[-NEIGHBOURS:], rest[-NEIGHBOURS:]

    banded = table.select("body", "sketch").mapInArrow(band, "key long, place long, body long, rest binary")
    return banded.repartition("key").sortWithinPartitions("key", "place", "body").mapInArrow(compare, "a long, b long")


def copy_groups(table: DataFrame, alike: float) -> DataFrame:
    """(body, origin) of every text of `table` (body, sketch) that has near copies; the origin is the group's smallest body."""
    once = table.groupBy("body").agg(F.min("sketch").alias("sketch"))
    return components(links(once, alike)).select(F.col("node").alias("body"), F.col("component").alias("origin"))
