"""Projections within report rows: groups, health, notes, diagnostics, formatted values, the speech gate and JSON.

metrics: array<struct<name, grp, value, unit, confidence, warning, calibration_note>> (fields that a function needs);
diagnostics: array<struct<code, severity, source, message, grp, metric, count, context map<string, string>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import SPEECH_GROUPS
from ..functions.signal import bound

#: Metrics of other groups that only make sense on speech, and the share of speech that a mixed recording needs (fixed values).
SPEECH_METRICS = (
    "P.563 Proxy (NB Quality Estimate)",
    "PESQ (ITU-T P.862)",
    "PESQ proxy (install `pesq` for true score)",
    "STOI (Short-Time Objective Intelligibility)",
    "STOI proxy (install `pystoi` for true score)",
)
MIXED_SPEECH = 0.20
#: Notes by confidence (fixed texts), in their order.
CONFIDENCE_NOTES = {
    "proxy": "Includes proxy-derived metrics; use them for directional review rather than absolute scoring.",
    "heuristic": "Includes heuristic estimates; interpret demographic or inferred labels cautiously.",
    "model": "Includes model-backed metrics; results can shift with runtime, model file, or calibration changes.",
}
MISSING_NOTE = "One or more metrics were unavailable; inspect notes and missing values before comparing runs."
NAN_WARNING = "Unavailable: value is undefined (NaN) for this input"


def metrics_by_group(metrics: Column) -> Column:
    """array<struct<grp, metrics>> in the order in which groups first occur."""
    groups = F.array_distinct(F.transform(metrics, lambda m: m["grp"]))
    return F.transform(groups, lambda g: F.struct(g.alias("grp"), F.filter(metrics, lambda m: m["grp"] == g).alias("metrics")))


def value_text(value: Column, whole: Column | bool = False, unit: Column | None = None) -> Column:
    """N/A for null and NaN, digits only for whole numbers, else four decimals; the unit follows a space."""
    whole = whole if isinstance(whole, Column) else F.lit(whole)
    text = F.when(value.isNull() | F.isnan(value), "N/A").when(whole, value.cast("long").cast("string")).otherwise(F.format_string("%.4f", value))
    return text if unit is None else F.when(unit != "", F.concat(text, F.lit(" "), unit)).otherwise(text)


def without_nan(metrics: Column) -> Column:
    """NaN values become null, with a default warning where there is none."""

    def one(m: Column) -> Column:
        bad = F.coalesce(F.isnan(m["value"]), F.lit(False))
        told = m["warning"].isNotNull() & (m["warning"] != "")
        return m.withField("value", F.when(~bad, m["value"])).withField("warning", F.when(bad & ~told, NAN_WARNING).otherwise(m["warning"]))

    return F.transform(metrics, one)


def confidence_notes(metrics: Column, error: Column) -> Column:
    """Notes on confidence levels, on missing values and on calibration, each once."""
    found = F.transform(metrics, lambda m: m["confidence"])
    levels = [F.when(F.array_contains(found, level), text) for level, text in CONFIDENCE_NOTES.items()]
    missing = F.when(F.exists(metrics, lambda m: m["value"].isNull()) & F.coalesce(error == "", F.lit(True)), MISSING_NOTE)
    own = F.transform(F.filter(metrics, lambda m: m["calibration_note"].isNotNull() & (m["calibration_note"] != "")), lambda m: F.concat(F.lit("Calibration: "), m["calibration_note"]))
    return F.array_distinct(F.concat(F.array_compact(F.array(*levels, missing)), own))


def merged_diagnostics(diagnostics: Column) -> Column:
    """Diagnostics that agree in code, source, message, group and metric as one, at the first's place: counts add up, later context wins."""
    same = ("code", "source", "message", "grp", "metric")

    def join(of: Column) -> Column:
        alone = of[0].withField("count", F.coalesce(of[0]["count"], F.lit(1)).cast("int"))
        return F.when(F.size(of) == 1, alone).otherwise(joined(of))

    def joined(of: Column) -> Column:
        merged = F.aggregate(of, F.create_map().cast("map<string, string>"), lambda a, d: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(d["context"], k)), d["context"]))
        count = F.aggregate(of, F.lit(0), lambda a, d: a + F.coalesce(d["count"], F.lit(1)).cast("int"))
        return of[0].withField("count", count).withField("context", merged)

    full = F.transform(diagnostics, lambda d: d.withField("context", F.coalesce(d["context"], F.create_map().cast("map<string, string>"))))
    key = lambda d: F.struct(*[d[c].alias(c) for c in same])
    # lists are bound: an expression in a function over the keys is else computed again for each key and each use
    return bound(full, lambda held: F.transform(F.array_distinct(F.transform(held, key)), lambda k: bound(F.filter(held, lambda d: key(d).eqNullSafe(k)), join)))


def group_health(metrics: Column, diagnostics: Column) -> Column:
    """array<struct<grp, status, metric_count, warning_count, missing_count, diagnostic_count>> by group.

    Diagnostics overlay the metrics' status in order: an error forces it, a warning only raises ok, a `_skipped` code marks a group without metrics.
    """
    told = lambda m: m["warning"].isNotNull() & (m["warning"] != "")
    groups = F.array_sort(F.array_compact(F.array_distinct(F.concat(F.transform(metrics, lambda m: m["grp"]), F.transform(diagnostics, lambda d: d["grp"])))))

    def one(g: Column) -> Column:
        own, notes = F.filter(metrics, lambda m: m["grp"] == g), F.filter(diagnostics, lambda d: d["grp"] == g)
        n, warned, missing = F.size(own), F.size(F.filter(own, told)), F.size(F.filter(own, lambda m: m["value"].isNull()))
        start = F.when(n == 0, "skipped").when(warned > 0, "warn").when(missing == n, "missing").when(missing > 0, "partial").otherwise("ok")
        step = lambda s, d: F.when(d["severity"] == "error", "error").when((d["severity"] == "warn") & (s == "ok"), "warn").when(d["code"].endswith("_skipped") & (n == 0), "skipped").otherwise(s)
        count = F.aggregate(notes, F.lit(0), lambda a, d: a + F.coalesce(d["count"], F.lit(1)).cast("int"))
        return F.struct(g.alias("grp"), F.aggregate(notes, start, step).alias("status"), n.alias("metric_count"), warned.alias("warning_count"), missing.alias("missing_count"), count.alias("diagnostic_count"))

    return F.transform(groups, one)


def speech_allowed(content_type: Column, speech_fraction: Column) -> Column:
    return F.coalesce((content_type == "speech") | ((content_type == "mixed") & (speech_fraction >= MIXED_SPEECH)), F.lit(False))


def speech_gate(reports: DataFrame, groups: tuple[str, ...] = SPEECH_GROUPS) -> DataFrame:
    """Rows without enough speech lose the metrics of speech groups and the five speech-only metrics; notes and diagnostics tell the skipped groups."""
    ok = speech_allowed(F.col("content_type"), F.col("speech_fraction"))
    kept = F.filter("metrics", lambda m: ~m["grp"].isin(*groups) & ~m["name"].isin(*SPEECH_METRICS))
    message = lambda g: F.concat(F.lit(f"{g}: skipped (content_type='"), F.coalesce("content_type", F.lit("unknown")), F.lit("', not speech)"))
    none = F.lit(None).cast("string")
    told = [F.struct(F.lit("metric_group_skipped").alias("code"), F.lit("info").alias("severity"), F.lit("metric_group").alias("source"), message(g).alias("message"), F.lit(g).alias("grp"), none.alias("metric"), F.lit(1).alias("count"), F.create_map().cast("map<string, string>").alias("context")) for g in groups]
    notes = F.array_distinct(F.concat("notes", F.array(*[message(g) for g in groups])))
    return reports.withColumn("metrics", F.when(ok, F.col("metrics")).otherwise(kept)).withColumn("notes", F.when(ok, F.col("notes")).otherwise(notes)).withColumn("diagnostics", F.when(ok, F.col("diagnostics")).otherwise(F.concat("diagnostics", F.array(*told))))


def recordable(facts: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """Facts that a history may take: no error, a finite value, and one of `names` if given."""
    out = facts.where("error is null").where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return out.where(F.col("name").isin(*names)) if names is not None else out


def relabelled(rows: DataFrame, labels: DataFrame, column: str = "file") -> DataFrame:
    """rows whose `column` is replaced where labels (path, label) name it; backslashes count as slashes."""
    plain = lambda c: F.regexp_replace(c, r"\\", "/")
    side = labels.select(plain(F.col("path")).alias("_path"), F.col("label").alias("_label"))
    joined = rows.join(side, plain(F.col(column)) == F.col("_path"), "left")
    return joined.withColumn(column, F.coalesce("_label", F.col(column))).select(*rows.columns)


def joined_by_path(rows: DataFrame, side: DataFrame, value: str, how: str = "left") -> DataFrame:
    """rows (file, source_file) with `value` of side (path, value), by file first, then by source_file; how "inner" drops rows without one."""
    own, src = (side.select(F.col("path").alias(f"_p{k}"), F.col(value).alias(f"_v{k}")) for k in (0, 1))
    j = rows.join(own, F.col("file") == F.col("_p0"), "left").join(src, F.col("source_file") == F.col("_p1"), "left")
    out = j.withColumn(value, F.coalesce("_v0", "_v1")).drop("_p0", "_p1", "_v0", "_v1")
    return out.where(F.col(value).isNotNull()) if how == "inner" else out


def snippet_segments(enriched: DataFrame, pad_s: float = 0.25) -> DataFrame:
    """file, segment_index, name and bounds, padded and kept within the recording, of segments that have labels."""
    labelled = (F.size("defect_labels") > 0).alias("_hit")  # told before the shuffle, which then carries no labels
    rows = enriched.where("segment_index is not null and error is null").select("file", "source_file", "segment_index", "segment_start_s", "segment_end_s", labelled)
    end = F.max(F.when(F.col("_hit"), F.col("segment_end_s"))).over(Window.partitionBy(F.coalesce("source_file", "file")))
    name = F.concat(safe_name(F.coalesce("source_file", "file")), F.lit("_segment_"), F.lpad(F.col("segment_index").cast("string"), 4, "0"), F.lit(".wav"))
    return rows.withColumn("_end", end).where("_hit").select("file", "segment_index", name.alias("name"), F.greatest(F.col("segment_start_s") - pad_s, F.lit(0.0)).alias("start_s"), F.least(F.col("segment_end_s") + pad_s, "_end").alias("end_s"))


def safe_name(text: Column, hashed: bool = False) -> Column:
    """Letters and digits of ASCII, anything else an underscore; with `hashed`, eight digits of a SHA-1 follow."""
    plain = F.regexp_replace(text, "[^A-Za-z0-9]", "_")
    return F.concat(plain, F.lit("_"), F.substring(F.sha1(text), 1, 8)) if hashed else plain


def to_rows_of_json(reports: DataFrame) -> DataFrame:
    """One JSON text a row; NaN and infinite metric values become null."""
    finite = lambda m: m.withField("value", F.when(~F.isnan(m["value"]) & (F.abs(m["value"]) < float("inf")), m["value"]))
    clean = reports.withColumn("metrics", F.transform("metrics", finite)) if "metrics" in reports.columns else reports
    return clean.select(F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_rows_of_json(rows: DataFrame, schema: StructType) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")
