"""Baseline profiles, regressions against them, and drift."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DIRECTION, FEATURES
from .features import constant_map, tolerance
from .ranking import exact_percentiles, with_border


def profile(features: DataFrame) -> DataFrame:
    """feature, mean, p05 and p95 (linear interpolation) and the number of values."""
    return exact_percentiles(features, ["feature"], "value", {"p05": 0.05, "p95": 0.95}, mean="mean", n="n").select("feature", "mean", "p05", "p95", "n")


def compare(features: DataFrame, base: DataFrame) -> DataFrame:
    """features with their place against the profile's band (a row a feature, broadcast): status and excess in tolerances."""
    j = features.join(F.broadcast(base.drop("n")), "feature").withColumn("tolerance", tolerance(F.col("feature"), F.col("mean")))
    low, high = F.col("p05") - F.col("tolerance"), F.col("p95") + F.col("tolerance")
    band = F.when(F.col("value") < low, "below_band").when(F.col("value") > high, "above_band").otherwise("within_band")
    way = F.coalesce(F.try_element_at(constant_map(DIRECTION), F.col("feature")), F.lit("either"))
    worse = F.when(way == "higher", F.col("band") == "below_band").when(way == "lower", F.col("band") == "above_band").otherwise(F.col("band") != "within_band")
    excess = F.greatest(low - F.col("value"), F.col("value") - high, F.lit(0.0)) / F.col("tolerance")
    return j.withColumn("band", band).withColumn("excess", excess).withColumn("regressed", worse)


def top_regressions(compared: DataFrame, *keys: str, most: int = 5) -> DataFrame:
    """The `most` regressed features of each result by excess, ties by name."""
    order = Window.partitionBy(*keys).orderBy(F.desc("excess"), "feature")
    return compared.where("regressed").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def sequential_drift(rows: DataFrame, series: str, order: list[str]) -> DataFrame:
    """Changes of a feature from the last result before that has it (in `order` within the series) by its tolerance or more: a row a feature.

    rows: `features` array<struct<feature, value>>. A result is shuffled once, as numbers in the order of feature names.
    """
    names = sorted(set(FEATURES.values()))
    before = Window.partitionBy(series).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = lambda name: F.try_element_at(F.filter("features", lambda f: f["feature"] == name), F.lit(1))["value"]
    flat = rows.select(*[c for c in rows.columns if c != "features"], *[own(n).alias(f"_v{k}") for k, n in enumerate(names)])
    both = flat.select("*", *[F.last(f"_v{k}", ignorenulls=True).over(before).alias(f"_p{k}") for k in range(len(names))])
    each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"_v{k}").alias("value"), F.col(f"_p{k}").alias("previous")) for k, n in enumerate(names)])
    prev = both.select(*[c for c in rows.columns if c != "features"], F.inline(each)).where("value is not null")
    delta = F.col("value") - F.col("previous")
    moved = F.abs(delta) >= tolerance(F.col("feature"), F.col("previous"))
    return prev.withColumn("delta", delta).withColumn("status", F.when(F.col("previous").isNull(), "baseline").when(moved, "drift").otherwise("stable"))


def rolling(history: DataFrame, size: int = 20, include_current: bool = True) -> DataFrame:
    """Count, mean, population deviation, least and most of each metric's last `size` values; without the current one for tests against it."""
    frame = (-(size - 1), 0) if include_current else (-size, -1)
    w = Window.partitionBy("_part", "metric").orderBy("ts", "tie").rowsBetween(*frame)
    v = F.col("value")
    placed = with_border(history, "metric", ["ts", "tie"], size)
    out = placed.select("*", F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("mean"), F.stddev_pop(v).over(w).alias("stdev"), F.min(v).over(w).alias("least"), F.max(v).over(w).alias("most"))
    return out.where("not _carried").drop("_part", "_carried")


def zscore_drift(history: DataFrame, size: int = 20, threshold: float = 3.0, min_samples: int = 5) -> DataFrame:
    """Each value against the window before it: insufficient_history, drift or ok, and its z-score to 6 digits; over a window without spread that is 0 or infinite."""
    r = rolling(history, size, include_current=False)
    away = F.col("value") - F.col("mean")
    endless = F.when(away > 0, float("inf")).when(away < 0, float("-inf")).otherwise(0.0)
    z = F.when(F.col("stdev") == 0, endless).otherwise(away / F.nullif(F.col("stdev"), F.lit(0.0)))
    ready = F.col("n") >= min_samples
    return r.withColumn("zscore", F.when(ready, F.when(F.abs(z) < float("inf"), F.round(z, 6)).otherwise(z))).withColumn("status", F.when(~ready, "insufficient_history").when(F.abs(z) > threshold, "drift").otherwise("ok"))


def bounded_history(history: DataFrame, most: int = 1000) -> DataFrame:
    """The last `most` values of each metric: the last of each range partition, then of those."""
    parts = int(history.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = history.repartitionByRange(parts, "metric", "ts", "tie").withColumn("_part", F.spark_partition_id())
    late = [F.desc("ts"), F.desc("tie")]
    some = placed.withColumn("age", F.row_number().over(Window.partitionBy("_part", "metric").orderBy(*late))).where(F.col("age") <= most)
    return some.withColumn("age", F.row_number().over(Window.partitionBy("metric").orderBy(*late))).where(F.col("age") <= most).drop("_part")


#: Chunks of time that a metric's events are ordered in, as a multiple of the cooldown.
CHUNK = 16


def _sessions(events: DataFrame, cooldown: int) -> DataFrame:
    """events (metric, us, tie) with `session`, the time of the last event whose gap to the one before is `cooldown` or more.

    Windows order a chunk of time of a metric; what goes before a chunk comes from a row a chunk.
    """
    within, chunks = Window.partitionBy("metric", "chunk").orderBy("us", "tie"), Window.partitionBy("metric").orderBy("chunk")
    rows = events.withColumn("chunk", F.floor(F.col("us") / F.lit(CHUNK * max(cooldown, 1))))

    def with_chunk(rows: DataFrame, summary: DataFrame) -> DataFrame:
        side = summary.select(F.col("metric").alias("m"), F.col("chunk").alias("c"), "before")
        return rows.join(side, F.col("metric").eqNullSafe(F.col("m")) & (F.col("chunk") == F.col("c"))).drop("m", "c")

    rows = with_chunk(rows, rows.groupBy("metric", "chunk").agg(F.max("us").alias("us")).withColumn("before", F.lag("us").over(chunks)))
    previous = F.coalesce(F.lag("us").over(within), "before")
    rows = rows.withColumn("previous", previous).withColumn("start", F.when(F.col("previous").isNull() | (F.col("us") - F.col("previous") >= cooldown), F.col("us"))).drop("before", "previous")
    earlier = F.max("start").over(chunks.rowsBetween(Window.unboundedPreceding, -1))
    rows = with_chunk(rows, rows.groupBy("metric", "chunk").agg(F.max("start").alias("start")).withColumn("before", earlier))
    return rows.select("metric", "us", "tie", F.coalesce(F.max("start").over(within.rowsBetween(Window.unboundedPreceding, 0)), "before").alias("session"))


def alert_cooldown(history: DataFrame, cooldown_s: float = 300.0) -> DataFrame:
    """Values that are emitted when a key stays silent for `cooldown_s` after each emission; those without a time always are.

    The last emission only advances when one happens, so times are folded in order. An event after a gap of `cooldown_s`
    is always emitted, so a group ends there; its rows are streamed past one time. streaming.watch.alerts is the stream form.
    """
    cooldown = round(cooldown_s * 1e6)
    events = history.select("metric", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "tie")
    kinds = ", ".join(f"`{n}` {t}" for n, t in events.select("metric", "tie").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, 0
        for b in batches:
            out = []
            for k, (*key, us) in enumerate(zip(*(b.column(c).to_pylist() for c in ("metric", "session", "us")), strict=True)):
                if key != group or us - last >= cooldown:
                    group, last = key, us
                    out.append(k)
            yield b.select(["metric", "tie"]).take(pa.array(out, pa.int64()))

    placed = _sessions(events.where("us is not null"), cooldown).repartition("metric", "session").sortWithinPartitions("metric", "session", "us", "tie")
    return placed.mapInArrow(run, kinds).union(events.where("us is null").select("metric", "tie"))
