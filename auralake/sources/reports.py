"""Report scans: JSON arrays and JSON lines into result rows and metric facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC = "struct<name: string, value: string, unit: string, description: string, group: string, higher_is_better: boolean, warning: string, reference_range: array<double>, confidence: string, calibration_note: string>"
REPORT_SCHEMA = f"schema_version string, tool_version string, file string, source_file string, segment_index int, total_segments int, segment_start_s double, segment_end_s double, duration_s double, sample_rate int, channels int, bit_depth int, content_type string, speech_confidence double, notes array<string>, confidence_notes array<string>, error string, metrics array<{METRIC}>"


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of a report; `.jsonl` and `.ndjson` hold one object a line, other files one array. Values keep their JSON text."""
    lines = path.lower().endswith((".jsonl", ".ndjson"))
    rows = spark.read.schema(REPORT_SCHEMA).option("primitivesAsString", False).json(path, multiLine=not lines)
    return rows.where("file is not null").withColumn("ord", F.monotonically_increasing_id())


def source_key() -> F.Column:
    """The recording a result belongs to; an empty source counts as none."""
    return F.coalesce(F.nullif("source_file", F.lit("")), F.col("file"))


def metric_facts(reports: DataFrame) -> DataFrame:
    """One row a metric, in report order. Numbers go to `value`, other values to `text`; NaN and infinities are null."""
    m = reports.select("ord", "file", source_key().alias("source_key"), "segment_index", "content_type", "error", F.posexplode_outer("metrics").alias("pos", "m"))
    number = F.col("m.value").try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    kind = F.when(F.col("m.value").isNull(), "null").when(F.col("m.value").isin("true", "false"), "bool").when(number.isNotNull(), "number").otherwise("str")
    return m.select(
        "ord", "file", "source_key", "segment_index", "content_type", "error", "pos", F.col("m.group").alias("grp"), F.col("m.name").alias("name"), finite.alias("value"),
        F.when(kind.isin("str", "bool"), F.col("m.value")).alias("text"), kind.alias("kind"), F.col("m.unit").alias("unit"), F.col("m.higher_is_better").alias("higher_is_better"), F.col("m.warning").alias("warning"),
        F.try_element_at("m.reference_range", F.lit(1)).alias("ref_lo"), F.try_element_at("m.reference_range", F.lit(2)).alias("ref_hi"), F.col("m.confidence").alias("confidence"),
    )
