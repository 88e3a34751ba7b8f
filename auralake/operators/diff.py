"""Report-to-report differences, repair evaluation and performance budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key in `order`, which should be total, as one of equal rows is taken otherwise."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("r")).select(*keys, "r.*")


def close(a: Column, b: Column) -> Column:
    """Equal up to a relative 1e-9 or an absolute 1e-12; nulls are equal to each other, and so are NaNs."""
    near = F.abs(a - b) <= F.greatest(1e-9 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    return F.coalesce(near | (F.isnan(a) & F.isnan(b)), a.isNull() & b.isNull())


def classify(before: Column, after: Column, warned: Column, warns: Column, higher: Column, low: Column, high: Column) -> Column:
    """Warnings first, then the metric's direction, then entry to or exit from its range."""
    both = before.isNotNull() & after.isNotNull()
    was, now = before.between(low, high), after.between(low, high)
    return (
        F.when(warned.isNotNull() & warns.isNull(), "improvement")
        .when(warned.isNull() & warns.isNotNull(), "regression")
        .when(both & higher, F.when(after > before, "improvement").otherwise("regression"))
        .when(both & ~higher, F.when(after < before, "improvement").otherwise("regression"))
        .when(both & was & ~now, "regression")
        .when(both & ~was & now, "improvement")
        .otherwise("changed")
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, grp, name, before, after, classification of changed metrics, and one row of group `meta` for a file that came, went or changed its error.

    Inputs: file, error, grp, name, value, warning, higher_is_better, ref_lo, ref_hi with one row a file, group and name.
    """
    keys = ["file", "grp", "name"]
    cols = ["value", "warning", "higher_is_better", "ref_lo", "ref_hi"]
    files = before.groupBy("file").agg(F.max("error").alias("b_error"), F.lit(True).alias("b")).join(after.groupBy("file").agg(F.max("error").alias("a_error"), F.lit(True).alias("a")), "file", "full_outer")
    meta = files.select(
        "file", F.lit("meta").alias("grp"), F.when(F.col("a").isNull() | F.col("b").isNull(), "file").otherwise("error").alias("name"),
        F.lit(None).cast("double").alias("before"), F.lit(None).cast("double").alias("after"),
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a_error").isNotNull(), "regression").otherwise("improvement").alias("classification"),
        (F.col("a").isNull() | F.col("b").isNull() | ~F.col("a_error").eqNullSafe(F.col("b_error"))).alias("told"),
    ).where("told").drop("told")
    both = files.where("a and b").select("file")
    x = before.join(both, "file", "left_semi").select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("in_b"))
    y = after.join(both, "file", "left_semi").select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("in_a"))
    joined = x.join(y, keys, "full_outer")
    changed = ~(close(F.col("b_value"), F.col("a_value")) & F.col("b_warning").eqNullSafe(F.col("a_warning")))
    kind = classify(F.col("b_value"), F.col("a_value"), F.col("b_warning"), F.col("a_warning"), F.col("a_higher_is_better"), F.coalesce("a_ref_lo", "b_ref_lo"), F.coalesce("a_ref_hi", "b_ref_hi"))
    kind = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").otherwise(kind)
    metrics = joined.where(F.col("in_a").isNull() | F.col("in_b").isNull() | changed).select(*keys, F.col("b_value").alias("before"), F.col("a_value").alias("after"), kind.alias("classification"))
    return meta.unionByName(metrics)


def summary(changes: DataFrame) -> DataFrame:
    """One row: files added and removed, regressions, improvements and all changes."""
    is_file = (F.col("grp") == "meta") & (F.col("name") == "file")
    c = F.col("classification")
    return changes.agg(F.count_if(is_file & (c == "added")).alias("files_added"), F.count_if(is_file & (c == "removed")).alias("files_removed"), F.count_if(c == "regression").alias("regressions"), F.count_if(c == "improvement").alias("improvements"), F.count("*").alias("changes"))


# name parts that tell which way is better where the metric doesn't (fixed values)
LOWER = "peak|clipping|clipped|noise floor|jitter|shimmer|roughness|dropout"
HIGHER = "snr|mos|pesq|stoi|si-sdr|hnr|harmonic-to-noise"


def evaluate_repair(before: DataFrame, after: DataFrame, targets: dict[str, float], tolerance: float = 1e-6) -> DataFrame:
    """file, name, delta and verdict of metrics on both sides (improvement, regression, neutral or unchanged) or missing after.

    A target judges by distance; else the metric's direction does, or its name's.
    """
    from .features import constant_map

    x = before.where("value is not null").select("file", "name", F.col("value").alias("old"), F.col("higher_is_better").alias("hb"))
    y = after.where("value is not null").select("file", "name", F.col("value").alias("new"), F.col("higher_is_better").alias("ha"))
    j = x.join(y.select("file").distinct(), "file", "left_semi").join(y, ["file", "name"], "left")
    target = F.try_element_at(constant_map(targets), F.col("name")) if targets else F.lit(None).cast("double")
    by_name = F.when(F.lower("name").rlike(LOWER), False).when(F.lower("name").rlike(HIGHER), True)
    up = F.coalesce("hb", "ha", by_name)
    gain = F.when(target.isNotNull(), F.abs(F.col("old") - target) - F.abs(F.col("new") - target)).when(up, F.col("new") - F.col("old")).when(~up, F.col("old") - F.col("new"))
    verdict = F.when(F.col("new").isNull(), "missing_after").when(gain > tolerance, "improvement").when(gain < -tolerance, "regression").when(gain.isNull() & (F.abs(F.col("new") - F.col("old")) > tolerance), "neutral").otherwise("unchanged")
    return j.select("file", "name", (F.col("new") - F.col("old")).alias("delta"), verdict.alias("verdict"))


def budget(baseline: DataFrame, current: DataFrame, max_regression: float = 0.1, higher_is_better: tuple[str, ...] = ()) -> DataFrame:
    """name, regression (share of the baseline; infinite for a worse value over a zero baseline), within and whether the metric is missing."""
    j = baseline.select("name", F.col("value").alias("old")).join(current.select("name", F.col("value").alias("new")), "name", "left")
    change = F.when(F.col("name").isin(*higher_is_better), F.col("old") - F.col("new")).otherwise(F.col("new") - F.col("old")) if higher_is_better else F.col("new") - F.col("old")
    share = F.when(F.col("old") == 0, F.when(change <= 0, 0.0).when(change > 0, float("inf"))).otherwise(change / F.abs(F.nullif(F.col("old"), F.lit(0.0))))
    return j.select("name", share.alias("regression"), F.coalesce(share <= max_regression, F.lit(False)).alias("within_budget"), F.col("new").isNull().alias("missing"))


def repair_plan(labels: Column, sample_rate: Column | None = None, lufs: float = -16.0, true_peak: float = -1.5) -> Column:
    """array<struct<filter, reason>> for labels, in a fixed order; a plain copy where nothing needs repair."""
    has = lambda *ids: F.exists(labels, lambda x: x["id"].isin(*ids))
    step = lambda name, reason: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("filter"), F.lit(reason).alias("reason"))
    loud = has("under_loud", "over_loud")
    steps = [
        F.when(has("hard_clipping"), step("adeclip", "reconstruct clipped samples")),
        F.when(has("noisy_floor"), step("afftdn=nf=-25", "reduce broadband noise")),
        F.when(has("clipping_risk", "hard_clipping"), step(f"alimiter=limit={min(1.0, max(0.0625, 10 ** (true_peak / 20))):.3f}:level=disabled", "restore true-peak headroom")),
        F.when(loud, step(f"loudnorm=I={lufs:g}:TP={true_peak:g}:LRA=11", f"normalize program loudness to {lufs:g} LUFS")),
    ]
    if sample_rate is not None:
        steps.append(F.when(loud & (sample_rate > 0), step(F.concat(F.lit("aresample="), sample_rate.cast("int").cast("string")), "restore the original sample rate after loudnorm")))
    plan = F.array_compact(F.array(*steps))
    return F.when(F.size(plan) == 0, F.array(step("anull", "no repair recommended; create a review copy"))).otherwise(plan)


def repair_accepted(evaluated: DataFrame) -> DataFrame:
    """file, numbers of each verdict, and accepted: no metric got worse."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return evaluated.groupBy("file").agg(n("improvement").alias("improvements"), n("regression").alias("regressions"), n("neutral").alias("neutral"), n("missing_after").alias("missing_after"), (n("regression") == 0).alias("accepted"))


def within_budget(judged: DataFrame, allow_missing: bool = False) -> DataFrame:
    """One row: whether every metric is within budget (missing ones fail unless allowed) and the names that aren't, sorted."""
    bad = F.when(F.col("missing"), F.lit(not allow_missing)).otherwise(~F.col("within_budget"))
    return judged.agg(F.every(~bad).alias("passed"), F.sort_array(F.collect_list(F.when(bad, F.col("name")))).alias("failed"))  # a row a metric


def ordered(changes: DataFrame) -> DataFrame:
    """Changes by file, a file's own rows before its metrics, then by group and name."""
    return changes.orderBy("file", F.col("grp") != "meta", "grp", "name")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
