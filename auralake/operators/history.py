"""Persistent tables of metric history and emitted alerts, in the shared storage that the caller names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .baseline import bounded_history, zscore_drift
from .reports import recordable

HISTORY = "metric string, ts timestamp, tie long, value double"


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The history table, empty if there is none yet; unreadable files fail the job."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(HISTORY).parquet(folder) if there else spark.createDataFrame([], HISTORY)


def append(values: DataFrame, folder: str) -> None:
    """Add values (metric, ts, tie, value); each call is one atomic append."""
    values.select("metric", F.col("ts").cast("timestamp"), F.col("tie").cast("long"), F.col("value").cast("double")).write.mode("append").parquet(folder)


def record(facts: DataFrame, folder: str, at: str, order: str, names: tuple[str, ...] | None = None) -> None:
    """Add the finite facts of results without an error, all at the time `at`."""
    append(recordable(facts, names).select(F.col("name").alias("metric"), F.lit(at).cast("timestamp").alias("ts"), F.col(order).alias("tie"), "value"), folder)


def window(spark: SparkSession, folder: str, size: int = 20) -> DataFrame:
    """metric, n, mean, stdev, least, most and latest of the last `size` values of each metric."""
    last = bounded_history(load(spark, folder), size)
    v = F.col("value")
    return last.groupBy("metric").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.min(v).alias("least"), F.max(v).alias("most"), F.max_by("value", F.struct("ts", "tie")).alias("latest"))


def check(spark: SparkSession, folder: str, size: int = 20, threshold: float = 3.0, min_samples: int = 5) -> DataFrame:
    return zscore_drift(load(spark, folder), size, threshold, min_samples)


def compact(spark: SparkSession, folder: str, target: str, most: int = 1000) -> None:
    """Write the last `most` values of each metric to another folder."""
    bounded_history(load(spark, folder), most).select("metric", "ts", "tie", "value").write.parquet(target)


def deliver(batch: DataFrame, sent: DataFrame, transport: Callable[[list[dict]], None], cooldown_s: float = 300.0, bound: int = 10_000) -> tuple[list[dict], list[str]]:
    """Send alerts (key, at, text) whose key was last sent `cooldown_s` ago or more; the sent ones and errors.

    sent: key, at of earlier deliveries. The cooldown of a key starts only after its delivery succeeded, so failed ones come
    again. Alerts go out in pages of `bound`; the first of a key in the batch goes.
    """
    first = batch.groupBy("key").agg(F.min(F.struct("at", "text")).alias("a")).select("key", "a.*")
    last = sent.groupBy("key").agg(F.max("at").alias("_last"))
    due = first.join(last, "key", "left").where(F.col("_last").isNull() | (F.col("at") - F.col("_last") >= cooldown_s)).select("key", "at", "text")
    done, errors, page = [], [], []

    def send() -> None:
        try:
            transport(page)
            done.extend(page)
        except Exception as e:  # noqa: BLE001  a transport may fail in any way
            errors.append(str(e))

    for r in due.orderBy("at", "key").toLocalIterator():
        page.append(r.asDict())
        if len(page) == bound:
            send()
            page = []
    if page:
        send()
    return done, errors

