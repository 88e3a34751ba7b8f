"""Watching folders: a listing each round, a state a path that waits for files to settle, and the loop that analyses them.

The listing is a streaming source of its own, since Spark's file source knows a path once and would never show a file that
was written anew or must be tried again. Every round shows every file, so all waiting (for a second equal sighting, for a
debounce, for a retry) moves on without new files; a timer forgets the paths that are shown no more. Folders are listed by
tasks, one for the root and one for each folder below it, and contents are read by tasks too.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, StructField, StructType

from ..constants import SUPPORTED_SUFFIXES

LISTING = "path string, signature string, at double, first boolean"
EVENTS = "path string, kind string, signature string, at double, first boolean"
STATES = "path string, signature string, at double, status string, attempt int"
STATE = "processed string, flying string, pending string, since double, stable int, age int, attempts int, retry_at double, dropped boolean"


def opened(folder: str):
    """A file system and the folder's place on it: a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Folder(InputPartition):
    def __init__(self, folder: str, below: bool, at: int, first: bool):
        self.folder, self.below, self.at, self.first = folder, below, at, first


class ListingReader(DataSourceStreamReader):
    """An offset is the time of a round, so rounds follow each other across restarts."""

    def __init__(self, folders: list[str], suffixes: tuple[str, ...]):
        self.folders, self.suffixes = folders, suffixes

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        return {"round": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        from pyarrow import fs

        at, first, out = int(end["round"]), not int(start["round"]), []
        for folder in self.folders:
            system, place = opened(folder)
            out.append(Folder(folder, False, at, first))
            prefix = folder[: len(folder) - len(place)] if folder.endswith(place) else ""
            out += [Folder(prefix + f.path, True, at, first) for f in system.get_file_info(fs.FileSelector(place)) if f.type == fs.FileType.Directory]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, place = opened(partition.folder)
        prefix = partition.folder[: len(partition.folder) - len(place)] if partition.folder.endswith(place) else ""
        for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True, recursive=partition.below)):
            if f.type == fs.FileType.File and f.path.lower().endswith(self.suffixes):
                yield prefix + f.path, f"{f.size}:{f.mtime_ns}", partition.at / 1e9, partition.first


class FolderListing(DataSource):
    """Format `folder_listing`: option `folders` (newline-separated), and `suffixes` (comma-separated) if not the supported ones."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> ListingReader:
        suffixes = self.options.get("suffixes")
        return ListingReader([f for f in self.options["folders"].split("\n") if f], tuple(suffixes.split(",")) if suffixes else tuple(SUPPORTED_SUFFIXES))


def listing(spark: SparkSession, folders: list[str]) -> DataFrame:
    """path, signature (size and time), at, first (its round is the stream's first) of every supported file, each round."""
    spark.dataSource.register(FolderListing)
    return spark.readStream.format("folder_listing").option("folders", "\n".join(folders)).load()


def file_states(events: DataFrame, baseline: bool = True, debounce_s: float = 0.0, most_rounds: int = 120, retries: int = 2, backoff_s: float = 2.0, forget_s: float = 3600.0) -> DataFrame:
    """What becomes of each path: ready, unstable, retry or dropped, with the number of failures so far.

    events: sightings (kind `seen`) and outcomes of analyses (`done`, `failed`) of a path's signature. A file is ready when a
    later round shows the same signature and `debounce_s` passed since its first sighting; it is not ready again until its
    outcome is known, nor after a success until it changes. Failures wait `backoff_s`, doubled each time, and after `retries`
    of them the path is dropped for good. A file that hasn't settled after `most_rounds` is unstable and starts over. With
    `baseline`, what the first round shows counts as done. State is one row a path, forgotten when it isn't shown for `forget_s`.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if state.hasTimedOut:
            state.remove()
        else:
            own = dict(zip(NAMES, state.get, strict=True)) if state.exists else dict.fromkeys(NAMES) | {"since": 0.0, "stable": 0, "age": 0, "attempts": 0, "dropped": False}
            rows = pd.concat(batches)
            rows = rows.assign(_seen=rows.kind == "seen").sort_values(["at", "_seen"])
            for row in rows.itertuples():
                status = _seen(own, row, baseline, debounce_s, most_rounds) if row.kind == "seen" else _outcome(own, row, retries, backoff_s)
                if status:
                    out.append((key[0], row.signature, row.at, status, own["attempts"]))
            state.update(tuple(own[n] for n in NAMES))
            state.setTimeoutDuration(int(forget_s * 1000))
        yield pd.DataFrame(out, columns=["path", "signature", "at", "status", "attempt"]).astype({"attempt": "int32", "at": float})

    return events.groupBy("path").applyInPandasWithState(step, STATES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


NAMES = [f.split()[0] for f in STATE.split(", ")]


def _seen(own: dict, row, baseline: bool, debounce_s: float, most_rounds: int) -> str | None:
    if row.first and baseline:
        own["processed"] = row.signature
    if own["dropped"] or row.signature in (own["processed"], own["flying"]) or (own["retry_at"] is not None and row.at < own["retry_at"]):
        return None
    if own["pending"] is None:
        own.update(pending=row.signature, since=float(row.at), stable=0, age=0)
        return None
    own["age"] += 1
    if row.signature == own["pending"]:
        own["stable"] += 1
    else:
        own.update(pending=row.signature, since=float(row.at), stable=0)
    if own["age"] > most_rounds:
        own["pending"] = None
        return "unstable"
    if own["stable"] >= 1 and row.at - own["since"] >= debounce_s:
        own.update(flying=row.signature, pending=None)
        return "ready"
    return None


def _outcome(own: dict, row, retries: int, backoff_s: float) -> str | None:
    if own["flying"] == row.signature:
        own["flying"] = None
    if row.kind == "done":
        own.update(processed=row.signature, attempts=0, retry_at=None)
        return None
    own["attempts"] += 1
    if own["attempts"] > retries:
        own.update(dropped=True, retry_at=None)
        return "dropped"
    own["retry_at"] = float(row.at + backoff_s * 2 ** (own["attempts"] - 1))
    return "retry"


def contents(files: DataFrame) -> DataFrame:
    """files with `content`, read by the tasks; null for a file that is gone or can't be read."""
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one file a batch: contents are large
                own, path = b.slice(i, 1), b.column("path")[i].as_py()
                try:
                    system, place = opened(path)
                    with system.open_input_stream(place) as f:
                        data = f.read()
                except OSError:
                    data = None
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([data], pa.binary())], names=[*own.schema.names, "content"])

    return files.mapInArrow(run, schema)


def watch(spark: SparkSession, folders: list[str], analyse: Callable[[DataFrame], DataFrame], results: str, work: str, every: str | None = "5 seconds", most_files: int | None = None, on_state: Callable[[DataFrame, int], None] | None = None, **waiting) -> StreamingQuery:
    """Analyse files as they settle, a folder of `results` a round; give up on those that keep failing.

    analyse: (path, signature, content) -> rows with path and error (null: success), a row a file at least. Its outcomes are
    written below `work`, read back as a stream and decide in the next round, so a restart goes on where it was; a round that
    is repeated replaces its own files. `on_state` sees the states of each round. With `every` None one round is run; with
    `most_files` the query stops once so many files were analysed. `waiting` goes to `file_states`.
    """
    outcomes = f"{work}/outcomes"
    spark.createDataFrame([], EVENTS).write.mode("append").parquet(outcomes)
    done = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(outcomes)
    events = listing(spark, folders).select("path", F.lit("seen").alias("kind"), "signature", "at", "first").unionByName(done)
    running: list[StreamingQuery] = []
    analysed = [0]

    def step(batch: DataFrame, number: int) -> None:
        states = batch.persist()
        if on_state:
            on_state(states, number)
        ready = states.where("status = 'ready'").select("path", "signature")
        if not ready.isEmpty():
            target = f"{results}/batch={number}"
            analyse(contents(ready)).write.mode("overwrite").parquet(target)
            own = batch.sparkSession.read.parquet(target).groupBy("path").agg(F.first("error", ignorenulls=True).alias("error"))
            kind = F.when(F.col("error").isNull(), "done").otherwise("failed")
            told = ready.join(own, "path").select("path", kind.alias("kind"), "signature", F.lit(time.time()).alias("at"), F.lit(False).alias("first"))
            told.write.mode("overwrite").parquet(f"{outcomes}/batch={number}")
            analysed[0] += ready.count()
        states.unpersist()
        if most_files is not None and analysed[0] >= most_files and running:
            running[0].stop()

    writer = file_states(events, **waiting).writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint")
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    running.append(writer.start())
    return running[0]
