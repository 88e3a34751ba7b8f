"""A row number over all rows that no single task has to order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder that the session names; only a local session without one gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows from 1 in `order` (which must be total): range partitions, an offset for each, and a number within it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = 33  # monotonically_increasing_id is a partition's number and, in these lower bits, a row's number in it
    numbered = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = numbered.withColumn("_part", F.shiftright("_id", bits)).withColumn("_own", F.col("_id").bitwiseAND((1 << bits) - 1) + 1).drop("_id")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def _before(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """sizes (keys, _part, _n) with `_before`, the rows of the key in earlier partitions, and `_total`."""
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))).drop("_n")


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], mean: str | None = None, n: str | None = None) -> DataFrame:
    """keys and a column for each share, by linear interpolation: equal values are counted first, range partitions order the rest.

    mean, n: names of columns for the mean and the number of values, from the same counts. No task holds all values of a key. Keys are not null; null and NaN values are left out.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(counts.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()))
    side = _before(placed.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n")), keys)
    within = Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("_upto", F.sum("_c").over(within)).join(side, [*keys, "_part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    picks, out = [], []
    for name, share in shares.items():
        at = (F.col("_total") - 1) * F.lit(share)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col("_v"))).alias(f"_{name}_{end}"))
        rest = (F.col("_total") - 1) * F.lit(share) - F.floor((F.col("_total") - 1) * F.lit(share))
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * rest).alias(name))
    more = [c.alias(name) for name, c in ((mean, F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")), (n, F.sum("_c"))) if name]
    return rows.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks, *more).select(*keys, *out, *[c for c in (mean, n) if c])


def with_border(df: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """df in range partitions (`_part`) by key and order, each with copies (`_carried`) of the `size` rows of the key before its first one.

    A window of up to `size` rows back over (_part, key) then equals one over the key, and no task orders a whole key.
    `order` must be total within a key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(df.repartitionByRange(parts, key, *order).withColumn("_part", F.spark_partition_id()))
    side = _before(placed.groupBy(key, "_part").agg(F.count("*").alias("_n")), [key]).drop("_total")
    back = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_part", key).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= size)
    count = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    tails = back.join(side, [key, "_part"]).join(count, [key, "_part"]).withColumn("_place", F.col("_before") + F.col("_n") - F.col("_r") + 1)
    tails = tails.drop("_before", "_n", "_r").withColumnRenamed("_part", "_from")  # at most `size` rows a key and partition
    borders = side.select(F.col(key).alias("_key"), "_part", F.col("_before").alias("_at"))
    carried = tails.join(borders, (F.col(key) == F.col("_key")) & (F.col("_part") > F.col("_from")) & (F.col("_place") <= F.col("_at")) & (F.col("_place") > F.col("_at") - size))
    return placed.withColumn("_carried", F.lit(False)).unionByName(carried.select(*df.columns, "_part", F.lit(True).alias("_carried")))
