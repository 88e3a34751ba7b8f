"""Scorecards: metric rollups over sources, outliers and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import checkpointed, exact_percentiles


def metric_status(value: Column, warning: Column) -> Column:
    return F.when(value.isNull(), "missing").when(warning.isNotNull() & (warning != ""), "warn").otherwise("ok")


def result_status(facts: DataFrame, *keys: str) -> DataFrame:
    """error, warn, partial or ok for each result."""
    s = metric_status(F.col("value"), F.col("warning"))
    any_of = lambda x: F.max(F.when(s == x, 1).otherwise(0)) == 1
    return facts.groupBy(*keys).agg(F.when(F.max("error").isNotNull(), "error").when(any_of("warn"), "warn").when(any_of("missing"), "partial").otherwise("ok").alias("status"))


def group_health(facts: DataFrame, *keys: str) -> DataFrame:
    """Counts and status of each metric group of a result: warn, missing, partial or ok; an error of the result overrides."""
    s = metric_status(F.col("value"), F.col("warning"))
    own = facts.groupBy(*keys, "grp").agg(F.count("*").alias("metric_count"), F.count_if(s == "warn").alias("warning_count"), F.count_if(s == "missing").alias("missing_count"), F.count_if(F.col("error").isNotNull()).alias("diagnostic_count"))
    status = F.when(F.col("diagnostic_count") > 0, "error").when(F.col("warning_count") > 0, "warn").when(F.col("missing_count") == F.col("metric_count"), "missing").when(F.col("missing_count") > 0, "partial").otherwise("ok")
    return own.withColumn("status", status)


def by_source(facts: DataFrame) -> DataFrame:
    """The first level, a row a source, group and metric: mean of finite values, most frequent category, any warning, first range and unit.

    facts: grp, name, source_key, value, warning, ref_lo, ref_hi, and optionally category, unit and ord (input order; else segment_index).
    """
    order = F.col("ord") if "ord" in facts.columns else F.col("segment_index")
    has = lambda c: F.col(c) if c in facts.columns else F.lit(None).cast("string")
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    bounds = F.when(F.col("ref_lo").isNotNull() & F.col("ref_hi").isNotNull(), F.struct("ref_lo", "ref_hi"))
    keys = ["grp", "name", "source_key"]
    rows = facts.select(*keys, finite.alias("value"), (F.col("warning").isNotNull() & (F.col("warning") != "")).alias("warned"), bounds.alias("r"), has("category").alias("category"), has("unit").alias("unit"), order.alias("_ord"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_ord")))
    if "category" not in facts.columns:
        own = rows.groupBy(*keys).agg(F.avg("value").alias("value"), F.max("warned").alias("warned"), first("r").alias("r"), first("unit").alias("unit"), F.lit(None).cast("string").alias("category"))
    else:  # numbers first, which need no sort; then counts of each category, then the largest of the most frequent ones
        flat = rows.select(*keys, "category", "unit", "r.ref_lo", "r.ref_hi", "value", "warned", "_ord").groupBy(*keys, "category", "unit", "ref_lo", "ref_hi")
        flat = flat.agg(F.sum("value").alias("s"), F.count("value").alias("c"), F.max("warned").alias("warned"), F.min("_ord").alias("_ord"), F.count("category").alias("n")).withColumn("r", F.when(F.col("ref_lo").isNotNull(), F.struct("ref_lo", "ref_hi")))
        some = flat.groupBy(*keys, "category").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.max("warned").alias("warned"), F.min(F.when(F.col("r").isNotNull(), F.struct("_ord", "r"))).alias("r"), F.min(F.when(F.col("unit").isNotNull(), F.struct("_ord", "unit"))).alias("unit"), F.sum("n").alias("n"))
        own = some.groupBy(*keys).agg(
            (F.sum("s") / F.nullif(F.sum("c"), F.lit(0))).alias("value"), F.max("warned").alias("warned"), F.min("r").alias("r"), F.min("unit").alias("unit"), F.max(F.when(F.col("n") > 0, F.struct("n", "category"))).alias("m")
        ).select(*keys, "value", "warned", F.col("r.r").alias("r"), F.col("unit.unit").alias("unit"), F.col("m.category").alias("category"))
    return own.select(*keys, "value", "warned", F.col("r.ref_lo").alias("ref_lo"), F.col("r.ref_hi").alias("ref_hi"), "unit", "category")


def category_counts(sources: DataFrame) -> DataFrame:
    """Sources of each category by group and metric, with rank 1 for the most frequent (ties: smaller name first)."""
    counts = sources.where("category is not null").groupBy("grp", "name", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "name").orderBy(F.desc("n"), "category")))


def rollup(facts: DataFrame, total_sources: DataFrame | None = None, digits: int = 12) -> DataFrame:
    """The second level, a row a group and metric, by group and metric: counts, extremes with their sources (values equal to `digits` tie; the smaller name wins), mean and exact percentiles.

    Numbers are rounded to 6 digits. measured_count is the larger of numeric and categorical sources; range counts are null
    where no range was seen; dominant_category ties go to the larger name.
    """
    keys = ["grp", "name"]
    sources = checkpointed(by_source(facts))
    total = (sources if total_sources is None else total_sources).select(F.countDistinct("source_key").alias("source_count"))
    near = F.round("value", digits)
    inside = near.between(F.col("ref_lo"), F.col("ref_hi"))
    out = sources.groupBy(*keys).agg(
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("source_key"))).alias("unit"), F.count("value").alias("_n"), F.count("category").alias("_c"), F.count_if("warned").alias("warning_count"),
        F.when(F.count("ref_lo") > 0, F.count_if(inside)).alias("in_range_count"), F.when(F.count("ref_lo") > 0, F.count_if(~inside)).alias("out_of_range_count"),
        F.min("value").alias("min_value"), F.min_by("source_key", F.when(near.isNotNull(), F.struct(near, "source_key"))).alias("min_file"), F.max("value").alias("max_value"), F.min_by("source_key", F.when(near.isNotNull(), F.struct(-near, "source_key"))).alias("max_file"), F.avg("value").alias("mean"),
    )
    counts = sources.where("category is not null").groupBy(*keys, "category").agg(F.count("*").alias("n"))
    dominant = counts.groupBy(*keys).agg(F.max(F.struct("n", "category")).alias("d"))
    shares = exact_percentiles(sources, keys, "value", {"p05": 0.05, "median": 0.5, "p95": 0.95})
    out = out.join(shares, keys, "left").join(dominant, keys, "left").crossJoin(F.broadcast(total))  # one row
    kind = F.when((F.col("_n") > 0) & (F.col("_c") > 0), "mixed").when(F.col("_n") > 0, "numeric").when(F.col("_c") > 0, "categorical").otherwise("missing")
    measured = F.greatest("_n", "_c")
    six = lambda c: F.round(c, 6).alias(c)
    return out.select(
        *keys, F.coalesce("unit", F.lit("")).alias("unit"), kind.alias("value_kind"), "source_count", measured.alias("measured_count"), F.greatest(F.col("source_count") - measured, F.lit(0)).alias("missing_count"), "warning_count", "in_range_count", "out_of_range_count",
        six("min_value"), "min_file", six("max_value"), "max_file", six("mean"), six("median"), six("p05"), six("p95"), F.col("d.category").alias("dominant_category"), F.col("d.n").alias("dominant_category_count"),
    ).orderBy(*keys)


def outliers(facts: DataFrame, threshold: float = 3.0, most: int = 5, digits: int = 12) -> DataFrame:
    """The `most` sources of each metric that lie `threshold` robust deviations or more from the median."""
    keys = ["grp", "name"]
    sources = checkpointed(by_source(facts).where("value is not null").select(*keys, "source_key", "value"))
    centre = exact_percentiles(sources, keys, "value", {"median": 0.5}).join(sources.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    away = sources.join(F.broadcast(centre), keys).withColumn("away", F.abs(F.col("value") - F.col("median")))  # a row a metric
    mad = exact_percentiles(away, keys, "away", {"mad": 0.5})
    scored = away.join(F.broadcast(mad), keys).where("n >= 4 and mad > 1e-12").withColumn("deviation", F.col("away") / (1.4826 * F.col("mad"))).where(F.col("deviation") >= threshold)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("deviation", digits)), "source_key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*keys, "source_key", "value", "deviation", "rank")


def insight_counts(enriched: DataFrame) -> DataFrame:
    """kind, key and n over enriched report rows, by kind and key: label ids, severities, gates, gate statuses, drift statuses and audit issues."""
    one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    entries = [F.transform("defect_labels", lambda x: one("defect_label", x["id"])), F.transform("defect_labels", lambda x: one("label_severity", x["severity"]))]
    if "ci_checks" in enriched.columns:
        entries += [F.transform("ci_checks", lambda x: one("ci_check", x["id"])), F.transform("ci_checks", lambda x: one("ci_status", x["status"]))]
    if "drift_monitor" in enriched.columns:
        entries.append(F.array(one("drift_status", F.col("drift_monitor.status"))))
    if "dataset_audit" in enriched.columns:
        entries.append(F.transform("dataset_audit", lambda x: one("dataset_issue", x["id"])))
    return enriched.select(F.inline(F.concat(*entries))).groupBy("kind", "key").agg(F.count("*").alias("n")).orderBy("kind", "key")


def modal(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key; ties go to the largest."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias("dominant"), F.col("m.n").alias("n"))
