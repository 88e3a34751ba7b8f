"""Domain views over the given tables: quality results, metric facts, drift history, waveforms and dataset records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS_SQL = """
select concat('rec', l_orderkey) as source_key,
       concat('rec', l_orderkey, '#', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as int)) as file,
       l_linenumber as segment_index, l_extendedprice as tie, l_shipdate as shipped,
       l_quantity as snr, l_discount / 10 as clip, l_tax * 40 - 2.5 as peak, -8 - l_quantity / 2 as lufs,
       1 + 4 * l_extendedprice / 105000 as mos, l_extendedprice / 10 as centroid,
       case l_returnflag when 'A' then 'speech' when 'N' then 'music' else 'silence' end as content_type,
       case l_linestatus when 'F' then 'measured' else 'proxy' end as confidence,
       case when l_linenumber = 7 and l_tax > 0.06 then 'unreadable' end as error,
       l_quantity / 100 as duration_s
from lineitem
"""

#: name: (value column, group, unit, higher is better, range, warning expression)
METRICS = {
    "Estimated SNR": ("snr", "noise", "dB", True, (20.0, 40.0), "case when snr < 15 then 'SNR is low' end"),
    "Clipping Ratio": ("clip", "noise", "", False, None, "case when clip > 0.005 then 'clipped' end"),
    "True Peak": ("peak", "loudness", "dBTP", False, (-9.0, -1.0), "case when peak > -1 then 'clipping risk' end"),
    "Integrated Loudness (LUFS)": ("lufs", "loudness", "LUFS", None, (-18.0, -14.0), "case when lufs > -14 then 'loud' when lufs < -18 then 'quiet' end"),
    "DNSMOS OVRL": ("mos", "perceptual", "MOS", True, (3.0, 5.0), "cast(null as varchar(9))"),
    "Spectral Centroid": ("centroid", "spectral", "Hz", None, None, "cast(null as varchar(9))"),
}
KEEP = "file, source_key, segment_index, tie, shipped, content_type, confidence, error"


def _metric_select(name: str, value: str, group: str, unit: str, higher, bounds, warning: str, pos: int) -> str:
    low, high = bounds or ("cast(null as double)",) * 2
    better = {True: "true", False: "false", None: "cast(null as boolean)"}[higher]
    return f"select {KEEP}, {pos} as pos, '{group}' as grp, '{name}' as name, cast({value} as double) as value, '{unit}' as unit, {better} as higher_is_better, cast({low} as double) as ref_lo, cast({high} as double) as ref_hi, {warning} as warning from results"


FACTS_SQL = " union all ".join(_metric_select(n, *m, pos) for pos, (n, m) in enumerate(METRICS.items()))


def with_views(sql: str, *names: str) -> str:
    """A query for comparison engines with the named views as common table expressions."""
    known = {"results": RESULTS_SQL, "facts": FACTS_SQL, "reports": REPORTS_SQL, "history": HISTORY_SQL, "records": RECORDS_SQL, "cases": CASES_SQL}
    order = [n for n in known if n in names or (n == "results" and {"facts", "reports"} & set(names))]
    return "with " + ", ".join(f"{n} as ({known[n]})" for n in order) + " " + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per analysed segment, from line items."""
    return spark.sql(RESULTS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


def measured(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """One row per segment, whose metrics are an array in order; dealt by a column if one is given, before metrics are made."""
    entries = []
    for pos, (name, (value, group, unit, higher, bounds, warning)) in enumerate(METRICS.items()):
        low, high = bounds or (None, None)
        entries.append(
            F.struct(
                F.lit(pos).alias("pos"), F.lit(group).alias("grp"), F.lit(name).alias("name"), F.col(value).cast("double").alias("value"), F.lit(unit).alias("unit"),
                F.lit(higher).cast("boolean").alias("higher_is_better"), F.lit(low).cast("double").alias("ref_lo"), F.lit(high).cast("double").alias("ref_hi"), F.expr(warning.replace("varchar(9)", "string")).alias("warning"),
            )
        )
    rows = results(spark, sf_dir)
    return (rows.repartition(by) if by else rows).select(*KEEP.split(", "), F.array(*entries).alias("metrics"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment and metric: an unpivot in one pass over the results."""
    return measured(spark, sf_dir).select(*KEEP.split(", "), F.inline("metrics"))


HISTORY_SQL = "select event_type as metric, ts, event_id as tie, value from events where value is not null"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric values over time, from events."""
    return table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("metric"), "ts", F.col("event_id").alias("tie"), "value")


RECORDS_SQL = """
select doc_id, concat('/data/', case when doc_id % 10 < 7 then 'Train' when doc_id % 10 = 7 then 'val' when doc_id % 10 = 8 then 'TEST' else 'extra' end, '/', source, '/', doc_id, '.wav') as file,
       source as speaker, lang as content_type, concat(lang, ':', cast(round(n_chars / 50.0) as bigint)) as signature,
       case when n_chars < 40 then 'too short' end as error, case when doc_id % 17 = 0 then 'en' else lang end as declared
from documents
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset records with path, speaker, content type and signature, from documents."""
    return spark.sql(RECORDS_SQL.replace("from documents", "from {documents}"), documents=table(spark, sf_dir, "documents"))


CASES_SQL = """
select l.doc_id, label, case when label = 'low_quality' then l.quality = 0 else l.toxic = 1 end as expected,
       case when label = 'low_quality' then d.n_chars < 600 else d.n_chars % 5 = 0 end as predicted
from labels l join documents d on l.doc_id = d.doc_id cross join (select 'low_quality' as label union all select 'toxic' as label) t
"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and predicted labels of each annotated document, one row per label."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")  # noqa: E741
    each = l.join(d, "doc_id").select("doc_id", F.explode(F.array(F.struct(F.lit("low_quality").alias("label"), (F.col("quality") == 0).alias("expected"), (F.col("n_chars") < 600).alias("predicted")), F.struct(F.lit("toxic").alias("label"), (F.col("toxic") == 1).alias("expected"), (F.col("n_chars") % 5 == 0).alias("predicted")))).alias("c"))
    return each.select("doc_id", "c.*")


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short waveforms of 64 samples, from embeddings scaled by label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1) / 8).alias("samples"))


WAVE_SQL = "select vec_id, label, list_transform(embedding, lambda x: cast(x as double) * (label + 1) / 8) as samples from embeddings"


#: The feature values of report rows: rounded to 4 digits; a third segment holds a second, later SNR.
REPORTS_SQL = """
select * replace (round(case when segment_index = 3 then snr + 20 else snr end, 4) as snr, round(clip, 4) as clip, round(peak, 4) as peak, round(lufs, 4) as lufs, round(mos, 4) as mos, round(centroid, 4) as centroid)
from results
"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows whose metrics are an array, from line items; a third segment has `SNR` after `Estimated SNR`."""
    metric = lambda name, value, group, unit: F.struct(F.lit(name).alias("name"), F.lit(group).alias("grp"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), F.col("confidence"))
    own = [metric(n, F.col(c), g, u) for n, (c, g, u, *_) in METRICS.items()]
    later = F.when(F.col("segment_index") == 3, metric("SNR", F.col("snr") + 20, "noise", "dB"))
    r = results(spark, sf_dir).withColumn("metrics", F.array_compact(F.array(*own, later)))
    bounds = {"segment_start_s": (F.col("segment_index") - 1).cast("double"), "segment_end_s": F.col("segment_index").cast("double"), "sample_rate": F.lit(16000), "source_file": F.col("source_key")}
    return r.withColumns(bounds).select("file", "source_file", "segment_index", "segment_start_s", "segment_end_s", "duration_s", "sample_rate", "content_type", "error", "metrics", "tie", "shipped")
