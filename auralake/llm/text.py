"""Vectorised word work on Arrow string columns.

A word is a maximal run of bytes other than ASCII white space (`[^\\x20\\x09-\\x0D]+`); in UTF-8 those bytes
never occur inside a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on; a longer document makes a step of its own.
STEP_BYTES = 2 << 20
#: The same where many arrays of eight bytes a byte of text are held at once; they stay in the caches, too.
SMALL_STEP = 512 << 10

GAP = np.zeros(256, bool)
GAP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers[0], _powers[1]


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most `limit` text bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 row offsets; null counts as empty."""
    if text.null_count:
        text = pc.fill_null(text, "")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(text) or text.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a string column: byte bounds, row and words before each row."""

    def __init__(self, text: pa.Array, lower: bool = False):
        self.data, self.off = raw(text)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        gap = GAP[self.data]
        first = np.zeros(n + 1, bool)
        first[self.off] = True
        start, end = ~gap, ~gap
        if n:
            start[1:] &= gap[:-1] | first[1:n]
            end[:-1] &= gap[1:] | first[1:n]
        self.gap = gap
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.off)  # words before each row, and their number
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by differences of one running polynomial."""
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * inverse[start])


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, whatever row they belong to; len(word) - k + 1 of them."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _BASE + word[j : j + n]
    return mix(out ^ np.uint64(k))


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """For each row the kept words, one space between two, as UTF-8."""
    size = (words.end - words.start)[keep]
    row = words.row[keep]
    count = np.bincount(row, minlength=len(words.count))
    at = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    shift = np.repeat(words.start[keep] - at, size)
    place = np.arange(len(shift)) + np.repeat(np.arange(len(size)), size)
    out[place] = words.data[place + shift]
    last = np.concatenate(([0], np.cumsum(count)))
    bound = np.concatenate((at, [len(out)]))
    whole = out.tobytes()
    return [whole[bound[a] : max(bound[a], bound[b] - 1)] for a, b in zip(last[:-1], last[1:], strict=True)]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text is a multiple of 5; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session without one, as in tests, gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        folder = known.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Seconds between two times that the driver's garbage is collected.
COLLECT_S = 10
_collected = [0.0]


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files go from the disks once the driver's JVM has collected what refers to them, which it else puts off until its heap is full."""
    if time.monotonic() - _collected[0] >= COLLECT_S:
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder, compressed and readable by every executor."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    collect_garbage(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of `checkpointed` that nothing reads any more; other frames are left alone."""
    for t in tables:
        if path := getattr(t, "_table_path", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
