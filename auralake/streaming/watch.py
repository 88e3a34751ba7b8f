"""Watching for new files and values with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import SUPPORTED_SUFFIXES

BINARY_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def supported(path) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0)).isin(*SUPPORTED_SUFFIXES)


def watch_files(spark: SparkSession, folder: str, since: str | None = None, max_files: int = 512) -> DataFrame:
    """A stream of supported files below a folder, each path once; with `since` earlier ones count as done. Files that are written anew need `folder.watch`."""
    files = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)
    files = files.where(supported(F.col("path")))
    return files if since is None else files.where(F.col("modificationTime") > F.lit(since).cast("timestamp"))


def new_versions(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Of repeated sightings (`folder.listing`, or a listing table) each version of a file once: a path comes again when its size or time changes."""
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path", "length", "modificationTime"])


def windowed(history: DataFrame, size: str, delay: str | None = None) -> DataFrame:
    """Count and sum of each metric in event-time windows; `delay` bounds the state of a stream."""
    rows = history.withWatermark("ts", delay) if delay else history
    return rows.groupBy("metric", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("metric", F.col("w.start").alias("start"), "n", "total")


def alerts(stream: DataFrame, cooldown_s: float = 300.0) -> DataFrame:
    """(key, at, value) of alerts that are at least `cooldown_s` after the key's last emitted one; state is one time a key.

    stream: key string, at double (seconds), value double.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(batches).sort_values(["at", "value"]).itertuples():
            if last is None or row.at - last >= cooldown_s:
                last = row.at
                out.append((key[0], row.at, row.value))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    return stream.groupBy("key").applyInPandasWithState(step, "key string, at double, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def drift(stream: DataFrame, size: int = 20, threshold: float = 3.0, min_samples: int = 5) -> DataFrame:
    """(metric, at, value, status) of each value against the `size` before it; state is that window."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = list(state.get[0]) if state.exists else []
        out = []
        for row in pd.concat(batches).sort_values(["at", "value"]).itertuples():
            if len(window) < min_samples:
                status = "insufficient_history"
            else:
                mean = sum(window) / len(window)
                sd = (sum((x - mean) ** 2 for x in window) / len(window)) ** 0.5
                status = "drift" if (row.value != mean if sd == 0 else abs(row.value - mean) / sd > threshold) else "ok"
            out.append((key[0], row.at, row.value, status))
            window = [*window, float(row.value)][-size:]
        state.update((window,))
        yield pd.DataFrame(out, columns=["metric", "at", "value", "status"])

    return stream.groupBy("metric").applyInPandasWithState(step, "metric string, at double, value double, status string", "window array<double>", "append", GroupStateTimeout.NoTimeout)


SETTLED = "path string, signature string, at double, status string"


def settled(sightings: DataFrame, rounds: int = 1, debounce_s: float = 0.0, most_unstable: int = 120) -> DataFrame:
    """(path, signature, at, status) once a file's signature (size and time) was seen `rounds` times more and `debounce_s` after its first sighting.

    sightings: path string, signature string, at double (seconds). A new signature starts over, also for a file that was
    ready before; a file that changes more than `most_unstable` times is dropped. State is one row a path.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, since, seen, changes, done = state.get if state.exists else ("", 0.0, 0, 0, False)
        out = []
        for row in pd.concat(batches).sort_values("at").itertuples():
            if row.signature != last:
                changes = changes + 1 if last and not done else 0
                last, since, seen, done = row.signature, row.at, 0, False
            elif not done:
                seen += 1
            if done:
                continue
            if changes > most_unstable:
                out.append((key[0], last, row.at, "dropped"))
                done = True
            elif seen >= rounds and row.at - since >= debounce_s:
                out.append((key[0], last, row.at, "ready"))
                done, changes = True, 0
        state.update((last, float(since), seen, changes, done))
        yield pd.DataFrame(out, columns=["path", "signature", "at", "status"])

    return sightings.groupBy("path").applyInPandasWithState(step, SETTLED, "last string, since double, seen int, changes int, done boolean", "append", GroupStateTimeout.NoTimeout)


def retries(attempts: DataFrame, most: int = 2, backoff_s: float = 2.0) -> DataFrame:
    """(path, attempt, retry_at) after each failure, doubling the wait from `backoff_s`; retry_at is null when the file is dropped after `most` retries.

    attempts: path string, at double, failed boolean; a success starts the count again.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(batches).sort_values("at").itertuples():
            n = n + 1 if row.failed else 0
            if row.failed:
                out.append((key[0], n, row.at + backoff_s * 2 ** (n - 1) if n <= most else None))
        state.update((n,))
        yield pd.DataFrame(out, columns=["path", "attempt", "retry_at"]).astype({"retry_at": float})

    return attempts.groupBy("path").applyInPandasWithState(step, "path string, attempt int, retry_at double", "n int", "append", GroupStateTimeout.NoTimeout)


def enrich_so_far(stream: DataFrame, table: str, enrich: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Add each batch of report rows to a table (a folder a batch, so a retried batch replaces itself) and give the enriched whole so far to `sink`."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        sink(enrich(batch.sparkSession.read.parquet(table)), number)

    drain(stream, step, checkpoint)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what there is and stop; each batch goes to `sink` once, however often it is retried by id."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
