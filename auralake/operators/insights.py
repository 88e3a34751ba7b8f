"""Defect labels, advice, gates and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LABEL_THRESHOLDS, SUGGESTIONS
from .features import constant_map
from .ranking import global_row_number


def _label(when: Column, name: str, severity, confidence) -> Column:
    """A label where the condition holds, else null."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(F.lit(name).alias("id"), as_col(severity).alias("severity"), as_col(confidence).cast("double").alias("confidence")))


def defect_labels(results: DataFrame, preset: str | None = None) -> DataFrame:
    """results with `labels`, in a fixed order. Missing feature columns count as null."""
    limits = LABEL_THRESHOLDS[preset]
    has = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("double")
    snr, peak, clip, lufs, dropouts = (has(c) for c in ("snr", "peak", "clip", "lufs", "dropouts"))
    mos = F.coalesce(has("mos"), has("p563"))
    silent = (F.coalesce(F.col("content_type"), F.lit("unknown")) == "silence") | (F.coalesce(has("duration_s"), F.lit(1.0)) == 0)
    noisy = snr < limits["snr_fail"]
    labels = [
        _label(snr < limits["snr_min"], "noisy_floor", F.when(noisy, "fail").otherwise("warn"), F.when(noisy, 0.95).otherwise(0.72)),
        _label(peak > -1.0, "clipping_risk", F.when(peak > 0.0, "fail").otherwise("warn"), 0.86),
        _label(clip > 0.005, "hard_clipping", "fail", 0.90),
        _label(lufs < limits["lufs_min"], "under_loud", "warn", 0.78),
        _label(lufs > limits["lufs_max"], "over_loud", "warn", 0.78),
        _label((mos < 2.8) & ~silent, "low_perceptual_quality", "warn", 0.82),
        _label(dropouts > 0, "dropouts", "warn", 0.85),
        _label(silent, "silence_heavy", "warn", 0.88),
    ]
    return results.withColumn("labels", F.array_compact(F.array(*labels)))


def suggestions(labels: Column) -> Column:
    """Advice for labels, each once, in label order."""
    return F.array_distinct(F.array_compact(F.transform(labels, lambda x: F.try_element_at(constant_map(SUGGESTIONS), x["id"]))))


def gate(labels: Column) -> Column:
    """The quality gate: fail if any label fails."""
    return F.when(F.exists(labels, lambda x: x["severity"] == "fail"), "fail").otherwise("pass")


def triage_score(labels: Column, regressed: Column, drifted: Column, gate_failed: Column) -> Column:
    """50, 20 or 5 a label by severity times its confidence (0.9 if unknown), and fixed amounts for regression, drift and a failed gate."""
    weight = lambda x: F.when(x["severity"] == "fail", 50.0).when(x["severity"] == "warn", 20.0).otherwise(5.0)
    base = F.aggregate(labels, F.lit(0.0), lambda total, x: total + weight(x) * F.coalesce(x["confidence"], F.lit(0.9)))
    return base + F.when(regressed, 25.0).otherwise(0.0) + F.when(drifted, 15.0).otherwise(0.0) + F.when(gate_failed, 20.0).otherwise(0.0)


def triage(labelled: DataFrame, *ties: str) -> DataFrame:
    """labelled with score and rank: score falling, then file, then `ties`."""
    no = F.lit(False)
    col = lambda c: F.col(c) if c in labelled.columns else no
    scored = labelled.withColumn("score", F.round(triage_score(F.col("labels"), col("regressed"), col("drifted"), gate(F.col("labels")) == "fail"), 3))
    return global_row_number(scored, [F.desc("score"), F.asc("file"), *[F.asc(t) for t in ties]])


def mos_explanation(facts: DataFrame) -> DataFrame:
    """Scores of opinion metrics as negative, mixed or positive."""
    direction = F.when(F.col("value") < 2.8, "negative").when(F.col("value") >= 3.8, "positive").otherwise("mixed")
    return facts.where((F.col("name").contains("MOS") | F.col("name").contains("P.563")) & F.col("value").isNotNull()).withColumn("direction", direction).withColumn("confidence", F.coalesce("confidence", F.lit("unknown")))


def heatmap(segments: DataFrame, source: str, index: str, label: Column) -> DataFrame:
    """Cells of each source in segment order: status warn where any label is set."""
    cell = F.struct(F.col(index).alias("index"), F.when(label, "warn").otherwise("ok").alias("status"))
    return segments.groupBy(source).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
