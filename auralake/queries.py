"""Registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .constants import DIRECTION, FEATURES, SUGGESTIONS
from .functions import groups, reference, signal
from .operators import audit, baseline, calibration, contracts, diff, features, governance, insights, reports, rules, scorecard, sinks
from .plans.presets import preset_rules, rules_table
from .streaming import watch
from .views import METRICS, WAVE_SQL, with_views

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Register a query and, if SQL can say the same, its SQL over the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


FEATURE_CASE = "case name " + " ".join(f"when '{n}' then '{f}'" for n, f in FEATURES.items() if n in METRICS) + " end"
FEATURE_SQL = f"feats as (select file, source_key, segment_index, tie, shipped, error, content_type, {FEATURE_CASE} as feature, value from facts where {FEATURE_CASE} is not null and value is not null)"
LABELS_SQL = """labels as (
select file, tie, source_key, 'noisy_floor' as id, case when snr < 10 then 'fail' else 'warn' end as severity, case when snr < 10 then 0.95 else 0.72 end::double as confidence from results where snr < 15
union all select file, tie, source_key, 'clipping_risk', case when peak > 0 then 'fail' else 'warn' end, 0.86::double from results where peak > -1
union all select file, tie, source_key, 'hard_clipping', 'fail', 0.9::double from results where clip > 0.005
union all select file, tie, source_key, 'under_loud', 'warn', 0.78::double from results where lufs < -23
union all select file, tie, source_key, 'over_loud', 'warn', 0.78::double from results where lufs > -10
union all select file, tie, source_key, 'low_perceptual_quality', 'warn', 0.82::double from results where mos < 2.8 and content_type <> 'silence' and duration_s <> 0
union all select file, tie, source_key, 'silence_heavy', 'warn', 0.88::double from results where content_type = 'silence' or duration_s = 0)"""
TOLERANCE_SQL = "case feature when 'spectral.centroid' then greatest(abs({0}) * 0.10, 1e-6) when 'noise.snr' then 3.0 when 'loudness.integrated_lufs' then 3.0 when 'loudness.true_peak' then 1.0 when 'perceptual.dnsmos_ovrl' then 0.35 when 'noise.clipping_ratio' then 0.001 end"
FEATURE_KEYS = ("file", "source_key", "segment_index", "tie", "shipped", "error", "content_type")


def with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a result, whose features are an array."""
    return views.measured(spark, sf_dir).select(*FEATURE_KEYS, features.extract(F.col("metrics")).alias("features"))


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_features(spark, sf_dir).select(*FEATURE_KEYS, F.inline("features"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.defect_labels(views.results(spark, sf_dir))


@query("select file, tie, pos, grp, name, value, unit, warning from facts", "facts")
def metric_facts_explode(spark, sf_dir):
    return views.facts(spark, sf_dir).select("file", "tie", "pos", "grp", "name", "value", "unit", "warning")


@query(f"select file, tie, feature, value from (select file, tie, {FEATURE_CASE} as feature, value from facts) where feature is not null", "facts")
def feature_extract(spark, sf_dir):
    return feature_rows(spark, sf_dir).select("file", "tie", "feature", "value")


@query("select event_id, case when coalesce(value, 0) * 16 > 0 then case when user_id % 3 > 0 then least(1.0, user_id / (value * 16)) else 0.0 end end as ratio from events")
def derived_clipping(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    return e.select("event_id", features.clipping_ratio(F.col("user_id").cast("double"), F.col("user_id") % 3, F.coalesce("value", F.lit(0.0)), F.lit(16.0)).alias("ratio"))


STATUS_SQL = "status as (select file, tie, case when max(error) is not null then 'error' when bool_or(warning is not null) then 'warn' when bool_or(value is null) then 'partial' else 'ok' end as status from facts group by file, tie)"


@query(f"select file, tie, status from (with {STATUS_SQL} select * from status)", "facts")
def result_status(spark, sf_dir):
    return scorecard.result_status(views.facts(spark, sf_dir), "file", "tie")


@query(f"select status, n from (with {STATUS_SQL} select s.status, count(status.status) as n from (values ('ok'), ('warn'), ('partial'), ('error')) s(status) left join status on status.status = s.status group by s.status)", "facts")
def status_counts(spark, sf_dir):
    counts = scorecard.result_status(views.facts(spark, sf_dir), "file", "tie").groupBy("status").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(s,) for s in ("ok", "warn", "partial", "error")], "status string")
    return known.join(counts, "status", "left").na.fill(0, ["n"])


@query(
    """select file, tie, grp, count(*) as metric_count, count(*) filter (where warning is not null and value is not null) as warning_count, count(*) filter (where value is null) as missing_count, count(error) as diagnostic_count,
    case when count(error) > 0 then 'error' when count(*) filter (where warning is not null and value is not null) > 0 then 'warn' when count(value) = 0 then 'missing' when count(value) < count(*) then 'partial' else 'ok' end as status from facts group by file, tie, grp""",
    "facts",
)
def group_health(spark, sf_dir):
    return scorecard.group_health(views.facts(spark, sf_dir), "file", "tie").select("file", "tie", "grp", "metric_count", "warning_count", "missing_count", "diagnostic_count", "status")


@query(
    """select content, grp, name, count(*) as n from (select *, case when segment_index = 4 then 'mixed' else content_type end as content, (content_type = 'speech' and segment_index <> 4) or (segment_index = 4 and tie / 110000 >= 0.2) as ok from results r,
    (values ('speech', 'Speaking Rate'), ('perceptual', 'PESQ (ITU-T P.862)'), ('perceptual', 'DNSMOS OVRL'), ('noise', 'Estimated SNR')) m(grp, name)) where ok or (grp <> 'speech' and name <> 'PESQ (ITU-T P.862)') group by all
    union all select content, 'diagnostics', 'metric_group_skipped', 3 * count(*) from (select case when segment_index = 4 then 'mixed' else content_type end as content from results where not ((content_type = 'speech' and segment_index <> 4) or (segment_index = 4 and tie / 110000 >= 0.2))) group by all""",
    "results",
)
def speech_gate(spark, sf_dir):
    metric = lambda g, n: F.struct(F.lit(n).alias("name"), F.lit(g).alias("grp"))
    r = views.results(spark, sf_dir).withColumns({"content_type": F.when(F.col("segment_index") == 4, "mixed").otherwise(F.col("content_type")), "speech_fraction": F.col("tie") / 110000})
    none = F.array().cast("array<struct<code: string, severity: string, source: string, message: string, grp: string, metric: string, count: int, context: map<string, string>>>")
    r = r.withColumns({"metrics": F.array(metric("speech", "Speaking Rate"), metric("perceptual", "PESQ (ITU-T P.862)"), metric("perceptual", "DNSMOS OVRL"), metric("noise", "Estimated SNR")), "notes": F.array().cast("array<string>"), "diagnostics": none})
    told = F.transform("diagnostics", lambda d: F.struct(d["code"].alias("name"), F.lit("diagnostics").alias("grp")))
    return reports.speech_gate(r).select(F.col("content_type").alias("content"), F.inline(F.concat("metrics", told))).groupBy("content", "grp", "name").agg(F.count("*").alias("n"))


@query(
    """select file, tie, 0 as rule_id, 'Integrated Loudness (LUFS)' as metric, lufs as actual, 'Podcast loudness should usually land between -18 and -14 LUFS.' as message from results where lufs < -18 or lufs > -14
    union all select file, tie, 1, 'True Peak', peak, 'Podcast true peak should stay at or below -1 dBTP.' from results where peak > -1""",
    "results",
)
def rule_violations(spark, sf_dir):
    f = rules.matches(views.facts(spark, sf_dir), preset_rules(spark, "podcast")).where(rules.violated(F.col("value")))
    return f.select("file", "tie", "rule_id", F.col("name").alias("metric"), F.col("value").alias("actual"), F.coalesce("message", rules.default_message("name")).alias("message"))


REQUIRED = [("Estimated SNR", None, None, None, None, True, None), ("noise  FLOOR", "noise", None, None, None, True, "noise floor is needed"), ("true peak", None, None, -1.0, None, False, None)]


@query("select distinct file, 1 as rule_id, 'noise  FLOOR' as metric, 'noise' as grp, 'noise floor is needed' as message from results", "results")
def rule_required_missing(spark, sf_dir):
    return rules.required_missing(views.results(spark, sf_dir), views.facts(spark, sf_dir), rules_table(spark, REQUIRED))


@query("select file, n, concat('threshold rules: ', n, ' violation(s)') as note from (select file, count(*) filter (where lufs < -18 or lufs > -14) + count(*) filter (where peak > -1) as n from results group by file) where n > 0", "results")
def rule_violation_notes(spark, sf_dir):
    found = rules.violations(views.facts(spark, sf_dir), preset_rules(spark, "podcast"))
    return found.groupBy("file").agg(F.count("*").alias("n")).withColumn("note", F.concat(F.lit("threshold rules: "), "n", F.lit(" violation(s)")))


@query("select '*' as file, 2 as rule_id, 'Active Speech Level (ASL)' as metric, 'speech' as grp, 'Rule metric did not match any analyzed metric: Active Speech Level (ASL)' as message from (select count(*) from results)", "results")
def rule_unmatched(spark, sf_dir):
    return rules.unmatched(views.facts(spark, sf_dir), preset_rules(spark, "podcast")).drop("kind")


SOURCE_SQL = "sources as (select grp, name, source_key, avg(value) as value, bool_or(warning is not null) as warned, max(ref_lo) as ref_lo, max(ref_hi) as ref_hi from facts group by grp, name, source_key)"


CATEGORY_SQL = """more as (select grp, name, source_key, segment_index, value, warning, ref_lo, ref_hi, unit, null::varchar as category from facts
union all select 'content', 'Detected Content', source_key, segment_index, null::double, case when content_type = 'silence' then 'quiet' end, null::double, null::double, '', content_type from results
union all select 'content', 'Odd', source_key, segment_index, case when segment_index > 2 then snr end, null, case when segment_index > 1 then 10.0 end, case when segment_index > 1 then 40.0 end, 'dB', case when segment_index = 1 then content_type end from results),
cats as (select grp, name, source_key, arg_max(category, (n, category)) as category from (select grp, name, source_key, category, count(*) as n from more where category is not null group by all) group by all),
src as (select m.*, category from (select grp, name, source_key, avg(value) as value, bool_or(warning is not null) as warned, arg_min(ref_lo, segment_index) filter (where ref_lo is not null) as ref_lo, arg_min(ref_hi, segment_index) filter (where ref_lo is not null) as ref_hi, max(unit) as unit from more group by all) m left join cats using (grp, name, source_key)),
dom as (select grp, name, arg_max(category, (n, category)) as dominant_category, max(n) as dominant_category_count from (select grp, name, category, count(*) as n from src where category is not null group by all) group by all)"""


def mixed_facts(spark, sf_dir):
    """Facts with a categorical metric and one that is a number in some segments and a category in others."""
    none, seg, content = F.lit(None), F.col("segment_index"), F.col("content_type")
    fact = lambda grp, name, value, warning, low, high, unit, category: F.struct(grp.alias("grp"), name.alias("name"), value.cast("double").alias("value"), warning.cast("string").alias("warning"), low.cast("double").alias("ref_lo"), high.cast("double").alias("ref_hi"), unit.alias("unit"), category.cast("string").alias("category"))
    rows = F.transform("metrics", lambda m: fact(m["grp"], m["name"], m["value"], m["warning"], m["ref_lo"], m["ref_hi"], m["unit"], none))
    snr = F.filter("metrics", lambda m: m["name"] == "Estimated SNR")[0]["value"]
    more = [fact(F.lit("content"), F.lit("Detected Content"), none, F.when(content == "silence", "quiet"), none, none, F.lit(""), content)]
    more.append(fact(F.lit("content"), F.lit("Odd"), F.when(seg > 2, snr), none, F.when(seg > 1, 10.0), F.when(seg > 1, 40.0), F.lit("dB"), F.when(seg == 1, content)))
    return views.measured(spark, sf_dir, "source_key").select("source_key", "segment_index", F.inline(F.concat(rows, F.array(*more))))


@query(
    f"""select * from (with {CATEGORY_SQL} select grp, name, max(unit) as unit, case when count(value) > 0 and count(category) > 0 then 'mixed' when count(value) > 0 then 'numeric' when count(category) > 0 then 'categorical' else 'missing' end as value_kind,
    (select count(distinct source_key) from more) as source_count, greatest(count(value), count(category)) as measured_count, (select count(distinct source_key) from more) - greatest(count(value), count(category)) as missing_count, count(*) filter (where warned) as warning_count,
    case when count(ref_lo) > 0 then count(*) filter (where round(value, 9) between ref_lo and ref_hi) end as in_range_count, case when count(ref_lo) > 0 then count(*) filter (where round(value, 9) not between ref_lo and ref_hi) end as out_of_range_count,
    round(min(value), 6) as min_value, arg_min(source_key, (round(value, 9), source_key)) filter (where value is not null) as min_file, round(max(value), 6) as max_value, arg_min(source_key, (-round(value, 9), source_key)) filter (where value is not null) as max_file,
    round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.95), 6) as p95, any_value(dominant_category) as dominant_category, any_value(dominant_category_count) as dominant_category_count
    from src left join dom using (grp, name) group by grp, name)""",
    "results", "facts",
)
def scorecard_rollup(spark, sf_dir):
    return scorecard.rollup(mixed_facts(spark, sf_dir), digits=9)


@query(f"select grp, name, category, n, rank from (with {CATEGORY_SQL} select *, row_number() over (partition by grp, name order by n desc, category) as rank from (select grp, name, category, count(*) as n from src where category is not null group by all)) where rank <= 3", "results", "facts")
def scorecard_categories(spark, sf_dir):
    return scorecard.category_counts(scorecard.by_source(mixed_facts(spark, sf_dir))).where("rank <= 3").withColumn("rank", F.col("rank").cast("long"))


@query(
    f"""select grp, name, source_key, round(value, 6) as value, round(deviation, 6) as deviation, rank from (with {SOURCE_SQL},
    c as (select grp, name, quantile_cont(value, 0.5) as med, count(*) as n from sources group by grp, name), a as (select s.*, n, abs(value - med) as away from sources s join c using (grp, name)),
    m as (select grp, name, quantile_cont(away, 0.5) as mad from a group by grp, name), d as (select a.*, away / (1.4826 * mad) as deviation from a join m using (grp, name) where n >= 4 and mad > 1e-12)
    select *, row_number() over (partition by grp, name order by round(deviation, 9) desc, source_key) as rank from d where deviation >= 3) where rank <= 5""",
    "facts",
)
def scorecard_outliers(spark, sf_dir):
    o = scorecard.outliers(views.facts(spark, sf_dir), digits=9)
    return rounded(o, "value", "deviation").withColumn("rank", F.col("rank").cast("long"))


@query("select source_key, arg_max(content_type, (n, content_type)) as dominant, max(n) as n from (select source_key, content_type, count(*) as n from results group by all) group by source_key", "results")
def scorecard_modal(spark, sf_dir):
    return scorecard.modal(views.results(spark, sf_dir), ["source_key"], "content_type")


@query("select grp, name, confidence, count(*) as n from facts where confidence is not null group by all", "facts")
def confidence_counts(spark, sf_dir):
    return views.facts(spark, sf_dir).where("confidence is not null").groupBy("grp", "name", "confidence").agg(F.count("*").alias("n"))


@query(f"select file, tie, id, severity, confidence from (with {LABELS_SQL} select * from labels)", "results")
def defect_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("file", "tie", F.inline("labels"))


@query(f"select id, severity, count(*) as n from (with {LABELS_SQL} select * from labels) group by all", "results")
def label_summary(spark, sf_dir):
    return labelled(spark, sf_dir).select(F.inline("labels")).groupBy("id", "severity").agg(F.count("*").alias("n"))


SUGGEST_CASE = "case id " + " ".join("when '{}' then '{}'".format(k, v.replace("'", "''")) for k, v in SUGGESTIONS.items()) + " end"


@query(f"select distinct file, tie, {SUGGEST_CASE} as suggestion from (with {LABELS_SQL} select * from labels)", "results")
def repair_suggestions(spark, sf_dir):
    return labelled(spark, sf_dir).select("file", "tie", F.explode(insights.suggestions(F.col("labels"))).alias("suggestion"))


@query(f"select r.file, r.tie, case when count(*) filter (where severity = 'fail') > 0 then 'fail' else 'pass' end as gate from results r left join (with {LABELS_SQL} select * from labels) l on l.file = r.file and l.tie = r.tie group by all", "results")
def ci_gate(spark, sf_dir):
    return labelled(spark, sf_dir).select("file", "tie", insights.gate(F.col("labels")).alias("gate"))


SCORE_SQL = f"""scored as (select r.file, r.tie, round(coalesce(sum(case severity when 'fail' then 50 else 20 end * l.confidence), 0) + case when count(*) filter (where severity = 'fail') > 0 then 20 else 0 end, 3) as score
from results r left join (with {LABELS_SQL} select * from labels) l on l.file = r.file and l.tie = r.tie group by r.file, r.tie)"""


@query(f"select file, tie, score, row_number() over (order by score desc, file, tie) as rank from (with {SCORE_SQL} select * from scored)", "results")
def triage_rank(spark, sf_dir):
    return insights.triage(labelled(spark, sf_dir), "tie").select("file", "tie", "score", "rank")


@query("select file, tie, name, value as score, case when value < 2.8 then 'negative' when value >= 3.8 then 'positive' else 'mixed' end as direction, confidence from facts where name like '%MOS%' or name like '%P.563%'", "facts")
def mos_explanation(spark, sf_dir):
    return insights.mos_explanation(views.facts(spark, sf_dir)).select("file", "tie", "name", F.col("value").alias("score"), "direction", "confidence")


STEP_SQL = "case when abs(value) >= 100 then 10.0 when abs(value) >= 10 then 2.0 when abs(value) >= 1 then 0.5 else 0.05 end::double"


@query(f"select file, tie, feature, cast(round_even(value / {STEP_SQL}, 0) as bigint) as bucket from (with {FEATURE_SQL} select * from feats)", "facts")
def fingerprint_buckets(spark, sf_dir):
    return feature_rows(spark, sf_dir).select("file", "tie", "feature", features.bucket_index(F.col("value")).alias("bucket"))


BUCKETS_SQL = f"sigs as (select file, tie, source_key, string_agg(feature || ':' || {STEP_SQL} || ':' || cast(round_even(value / {STEP_SQL}, 0) as bigint), ',' order by feature) as sig from (with {FEATURE_SQL} select * from feats) group by all)"


@query(f"select count(*) as results, count(distinct source_key) as sources, count(*) filter (where n = 1) as n_groups from (select s.*, row_number() over (partition by sig) as n from (with {BUCKETS_SQL} select * from sigs) s join (with {BUCKETS_SQL} select sig from sigs group by sig having count(distinct source_key) > 1) d using (sig))", "facts")
def fingerprint_duplicates(spark, sf_dir):
    return features.duplicates(with_features(spark, sf_dir).select(features.signature(F.col("features")).alias("signature"), "source_key"))


@query("select file, tie, 'too_short_for_review' as issue from results where duration_s > 0 and duration_s < 0.25 union all select file, tie, 'unreadable_audio' from results where error is not null", "results")
def dataset_audit_issues(spark, sf_dir):
    short = F.when((F.col("duration_s") > 0) & (F.col("duration_s") < 0.25), "too_short_for_review")
    issues = F.array_compact(F.array(short, F.when(F.col("error").isNotNull(), "unreadable_audio")))
    return views.results(spark, sf_dir).select("file", "tie", F.explode(issues).alias("issue"))


CUT = "1998-01-01"
PROFILE_SQL = f"prof as (select feature, avg(value) as mean, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.95) as p95, count(*) as n from (with {FEATURE_SQL} select * from feats) where shipped < timestamp '{CUT}' group by feature)"
COMPARE_SQL = f"""{PROFILE_SQL}, cmp as (select file, tie, feature, value, tol, greatest(p05 - tol - value, value - p95 - tol, 0.0) / tol as excess,
case when value < p05 - tol then 'below_band' when value > p95 + tol then 'above_band' else 'within_band' end as band from (select f.*, mean, p05, p95, {TOLERANCE_SQL.format("mean")} as tol from (with {FEATURE_SQL} select * from feats where shipped >= timestamp '{CUT}') f join prof using (feature))),
worse as (select *, case when feature in ({", ".join(repr(k) for k, v in DIRECTION.items() if v == "higher")}) then band = 'below_band' when feature in ({", ".join(repr(k) for k, v in DIRECTION.items() if v == "lower")}) then band = 'above_band' else band <> 'within_band' end as regressed from cmp)"""


def baseline_pair(spark, sf_dir):
    f = feature_rows(spark, sf_dir)
    return baseline.profile(f.where(F.col("shipped") < F.lit(CUT).cast("timestamp_ntz"))), f.where(F.col("shipped") >= F.lit(CUT).cast("timestamp_ntz"))


@query(f"select feature, round(mean, 4) as mean, round(p05, 4) as p05, round(p95, 4) as p95, n from (with {PROFILE_SQL} select * from prof)", "facts")
def baseline_profile(spark, sf_dir):
    return rounded(baseline_pair(spark, sf_dir)[0], "mean", "p05", "p95", digits=4)


@query(f"select file, tie, feature, band, regressed, round(excess, 4) as excess from (with {COMPARE_SQL} select * from worse)", "facts")
def baseline_regressions(spark, sf_dir):
    base, now = baseline_pair(spark, sf_dir)
    return rounded(baseline.compare(now, base).select("file", "tie", "feature", "band", "regressed", "excess"), "excess", digits=4)


@query(f"select file, tie, feature, rank from (select *, row_number() over (partition by file, tie order by excess desc, feature) as rank from (with {COMPARE_SQL} select * from worse) where regressed) where rank <= 5", "facts")
def top_regressions(spark, sf_dir):
    base, now = baseline_pair(spark, sf_dir)
    return baseline.top_regressions(baseline.compare(now, base), "file", "tie").select("file", "tie", "feature", F.col("rank").cast("long"))


def side(spark, sf_dir, number: int) -> DataFrame:
    """The last result of each source's segment; of those with equal `tie`, which SQL leaves open, that with the larger name."""
    f = views.facts(spark, sf_dir).where(F.col("segment_index") == number).withColumn("row", F.col("file")).withColumn("file", F.col("source_key"))
    return diff.last_of(f.select("file", "grp", "name", "value", "warning", "higher_is_better", "ref_lo", "ref_hi", "error", "tie", "row"), ["file", "grp", "name"], "tie", "row")


SIDE = "(select source_key as file, grp, name, arg_max(value, tie) as value, arg_max(coalesce(warning, ''), tie) as warning, any_value(higher_is_better) as hb, any_value(ref_lo) as lo, any_value(ref_hi) as hi, arg_max(coalesce(error, ''), tie) as error from facts where segment_index = {0} group by source_key, grp, name)"
DIFF_SQL = f"""b as {SIDE.format(1)}, a as {SIDE.format(2)}, fb as (select file, max(error) as e from b group by file), fa as (select file, max(error) as e from a group by file),
changes as (select coalesce(fb.file, fa.file) as file, 'meta' as grp, case when fb.file is null or fa.file is null then 'file' else 'error' end as name, null::double as before, null::double as after,
case when fb.file is null then 'added' when fa.file is null then 'removed' when fa.e <> '' then 'regression' else 'improvement' end as classification from fb full join fa on fb.file = fa.file where fb.file is null or fa.file is null or fb.e <> fa.e
union all select b.file, b.grp, b.name, b.value, a.value, case when b.warning <> '' and a.warning = '' then 'improvement' when b.warning = '' and a.warning <> '' then 'regression'
 when a.hb then case when a.value > b.value then 'improvement' else 'regression' end when not a.hb then case when a.value < b.value then 'improvement' else 'regression' end
 when b.value between a.lo and a.hi and a.value not between a.lo and a.hi then 'regression' when b.value not between a.lo and a.hi and a.value between a.lo and a.hi then 'improvement' else 'changed' end
from b join a on a.file = b.file and a.grp = b.grp and a.name = b.name where not (abs(a.value - b.value) <= greatest(1e-9 * greatest(abs(a.value), abs(b.value)), 1e-12) and a.warning = b.warning))"""


@query(f"select * from (with {DIFF_SQL} select * from changes)", "facts")
def report_diff(spark, sf_dir):
    return diff.diff(side(spark, sf_dir, 1), side(spark, sf_dir, 2))


@query(f"select count(*) filter (where name = 'file' and grp = 'meta' and classification = 'added') as files_added, count(*) filter (where name = 'file' and grp = 'meta' and classification = 'removed') as files_removed, count(*) filter (where classification = 'regression') as regressions, count(*) filter (where classification = 'improvement') as improvements, count(*) as changes from (with {DIFF_SQL} select * from changes)", "facts")
def diff_summary(spark, sf_dir):
    return diff.summary(report_diff(spark, sf_dir))


@query(
    f"""select file, name, round(new - old, 6) as delta, case when gain > 1e-6 then 'improvement' when gain < -1e-6 then 'regression' when gain is null and abs(new - old) > 1e-6 then 'neutral' else 'unchanged' end as verdict
    from (with b as {SIDE.format(1)}, a as {SIDE.format(2)} select b.file, b.name, b.value as old, a.value as new, case when b.name = 'Integrated Loudness (LUFS)' then abs(b.value + 16) - abs(a.value + 16) when b.hb then a.value - b.value when not b.hb then b.value - a.value end as gain from b join a using (file, name))""",
    "facts",
)
def repair_evaluation(spark, sf_dir):
    e = diff.evaluate_repair(side(spark, sf_dir, 1), side(spark, sf_dir, 2), {"Integrated Loudness (LUFS)": -16.0})
    return rounded(e, "delta")


@query(
    """with m as (select o_orderpriority as name, avg(o_totalprice) filter (where year(o_orderdate) < 1997) as old, avg(o_totalprice) filter (where year(o_orderdate) >= 1997) as new from orders group by 1)
    select name, round((new - old) / abs(old), 6) as regression, coalesce((new - old) / abs(old) <= 0.001, false) as within_budget, new is null as missing from m where old is not null"""
)
def perf_budget(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("early", F.year("o_orderdate") < 1997)
    by = lambda early: o.where(F.col("early") == early).groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("value"))
    return rounded(diff.budget(by(True), by(False), 0.001), "regression")


@query(
    """select file, tie, step from (select file, tie, unnest(case when len(p) = 0 then ['anull|no repair recommended; create a review copy'] else p end) as step from (select file, tie, list_filter([case when clip > 0.005 then 'adeclip|reconstruct clipped samples' end, case when snr < 15 then 'afftdn=nf=-25|reduce broadband noise' end,
    case when peak > -1 or clip > 0.005 then 'alimiter=limit=0.841:level=disabled|restore true-peak headroom' end, case when lufs < -23 or lufs > -10 then 'loudnorm=I=-16:TP=-1.5:LRA=11|normalize program loudness to -16 LUFS' end,
    case when lufs < -23 or lufs > -10 then 'aresample=16000|restore the original sample rate after loudnorm' end], lambda x: x is not null) as p from results))""",
    "results",
)
def repair_plan(spark, sf_dir):
    steps = labelled(spark, sf_dir).select("file", "tie", F.explode(diff.repair_plan(F.col("labels"), F.lit(16000))).alias("s"))
    return steps.select("file", "tie", F.concat_ws("|", "s.filter", "s.reason").alias("step"))


@query(
    f"""select file, tie, feature, round(delta, 6) as delta, case when previous is null then 'baseline' when abs(delta) >= {TOLERANCE_SQL.format("previous")} then 'drift' else 'stable' end as status
    from (select *, value - previous as delta from (select *, lag(value) over (partition by source_key, feature order by segment_index, file, tie) as previous from (with {FEATURE_SQL} select * from feats)))""",
    "facts",
)
def sequential_drift(spark, sf_dir):
    d = baseline.sequential_drift(with_features(spark, sf_dir), "source_key", ["segment_index", "file", "tie"])
    return rounded(d.select("file", "tie", "feature", "delta", "status"), "delta")


ROLL_SQL = "select metric, tie, count(value) over w as n, round(avg(value) over w, 6) as mean, round(stddev_pop(value) over w, 5) as stdev, min(value) over w as least, max(value) over w as most from history window w as (partition by metric order by ts, tie rows between 19 preceding and current row)"


@query(ROLL_SQL, "history")
def rolling_window(spark, sf_dir):
    r = baseline.rolling(views.history(spark, sf_dir)).select("metric", "tie", "n", "mean", "stdev", "least", "most")
    return rounded(rounded(r, "mean"), "stdev", digits=5)


@query(
    """select metric, tie, value, case when n < 5 then 'insufficient_history' when case when sd = 0 then value <> m else abs((value - m) / sd) > 3 end then 'drift' else 'ok' end as status, round(round(case when n >= 5 then case when sd = 0 then case when value > m then 'inf'::double when value < m then '-inf'::double else 0 end else (value - m) / sd end end, 6), 3) as zscore
    from (select *, count(value) over w as n, avg(value) over w as m, stddev_pop(value) over w as sd from history window w as (partition by metric order by ts, tie rows between 20 preceding and 1 preceding))""",
    "history",
)
def zscore_drift(spark, sf_dir):
    return baseline.zscore_drift(views.history(spark, sf_dir)).select("metric", "tie", "value", "status", F.round("zscore", 3).alias("zscore"))


@query("select metric, tie, value, age from (select *, row_number() over (partition by metric order by ts desc, tie desc) as age from history) where age <= 1000", "history")
def bounded_history(spark, sf_dir):
    return baseline.bounded_history(views.history(spark, sf_dir)).select("metric", "tie", "value", F.col("age").cast("long"))


@query()
def alert_cooldown(spark, sf_dir):
    return baseline.alert_cooldown(views.history(spark, sf_dir))


@query(
    """select concat('audio_metric{file="', file, '",group="', grp, '",metric="', name, '"}') as series, value from (select file, grp, name, arg_min(value, (tie, pos)) as value from facts group by file, grp, name)
    union all select concat('audio_analysis_error{file="', file, '"}'), case when arg_min(coalesce(error, ''), tie) = '' then 0.0 else 1.0 end from results group by file""",
    "facts", "results",
)
def prometheus_series(spark, sf_dir):
    return sinks.prometheus_rows(views.measured(spark, sf_dir), ["tie"])


@query("select file, tie, " + ", ".join(f"{v} as \"{n}\"" for n, (v, *_) in METRICS.items()) + " from results", "results")
def csv_pivot(spark, sf_dir):
    return sinks.wide_rows(views.measured(spark, sf_dir), ["file", "tie"])


SPLIT_SQL = "case when doc_id % 10 < 7 then 'train' when doc_id % 10 = 7 then 'validation' when doc_id % 10 = 8 then 'test' end"


@query(f"select doc_id, {SPLIT_SQL} as split from records", "records")
def path_split(spark, sf_dir):
    return views.records(spark, sf_dir).select("doc_id", audit.split_of(F.col("file")).alias("split"))


@query(f"select 'speaker' as kind, speaker as key, count(*) as n from records where error is null and speaker is not null group by 2 union all select 'content', coalesce(content_type, 'unknown'), count(*) from records where error is null group by 2 union all select 'split', coalesce({SPLIT_SQL}, 'unassigned'), count(*) from records where error is null group by 2", "records")
def dataset_distributions(spark, sf_dir):
    return audit.distributions(views.records(spark, sf_dir))


DUP_SQL = f"dups as (select signature, count(*) as n, count(distinct file) as sources, coalesce(array_to_string(list_sort(list_distinct(list({SPLIT_SQL}) filter (where {SPLIT_SQL} is not null))), ','), '') as splits, coalesce(array_to_string(list_sort(list(distinct declared) filter (where declared is not null)), ','), '') as declared from records where error is null and signature is not null group by signature having count(*) > 1 and count(distinct file) > 1)"


@query(f"select signature, n, splits from (with {DUP_SQL} select * from dups)", "records")
def near_duplicates(spark, sf_dir):
    return audit.near_duplicates(views.records(spark, sf_dir)).select("signature", "n", F.array_join("splits", ",").alias("splits"))


@query(f"select 'duplicate' as kind, signature as key, splits from (with {DUP_SQL} select * from dups) where contains(splits, ',') union all select 'speaker', speaker, s from (select speaker, array_to_string(list_sort(list(distinct {SPLIT_SQL}) filter (where {SPLIT_SQL} is not null)), ',') as s from records where error is null and speaker is not null group by speaker) where contains(s, ',')", "records")
def split_leakage(spark, sf_dir):
    return audit.split_leakage(views.records(spark, sf_dir)).select("kind", "key", F.array_join("splits", ",").alias("splits"))


@query(f"select signature, n, declared from (with {DUP_SQL} select * from dups) where contains(declared, ',')", "records")
def label_conflicts(spark, sf_dir):
    return audit.label_conflicts(views.records(spark, sf_dir)).select("signature", "n", F.array_join("declared", ",").alias("declared"))


@query(
    f"""select priority, action, items from (with {DUP_SQL}, spk as (select speaker, count(*) as n, count(distinct {SPLIT_SQL}) as k from records where error is null and speaker is not null group by speaker)
    select 1 as priority, 'deduplicate' as action, count(*) as items from dups union all select 1, 'remove_split_leakage', (select count(*) from dups where contains(splits, ',')) + (select count(*) from spk where k > 1)
    union all select 1, 'fix_or_remove_unreadable', count(*) from records where error is not null
    union all select 2, 'rebalance_speakers', case when max(n) > greatest(1, sum(n) * 0.6) then count(*) end from spk
    union all select 2, 'review_content_labels', (select count(*) from records where error is null and declared <> content_type) + (select count(*) from dups where contains(declared, ','))) where items > 0""",
    "records",
)
def remediation_plan(spark, sf_dir):
    return audit.remediation(views.records(spark, sf_dir))


COUNTS_SQL = "counts as (select label, count(*) filter (where coalesce(expected, false) and coalesce(predicted, false)) as tp, count(*) filter (where not coalesce(expected, false) and coalesce(predicted, false)) as fp, count(*) filter (where coalesce(expected, false) and not coalesce(predicted, false)) as fn from cases group by label)"
PRF_SQL = "select *, coalesce(tp / nullif(tp + fp, 0), 0.0)::double as p, coalesce(tp / nullif(tp + fn, 0), 0.0)::double as r from "


@query(f"select label, tp, fp, fn, tp + fn as support, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from (with {COUNTS_SQL} {PRF_SQL} counts)", "cases")
def calibration_per_label(spark, sf_dir):
    return rounded(calibration.per_label(views.cases(spark, sf_dir)), "precision", "recall", "f1")


@query(
    f"""select round(avg(p), 5) as macro_precision, round(avg(r), 5) as macro_recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 5) as macro_f1, round(sum(tp) / (sum(tp) + sum(fp)), 5) as micro_precision, round(sum(tp) / (sum(tp) + sum(fn)), 5) as micro_recall,
    round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 5) as micro_f1 from (with {COUNTS_SQL} {PRF_SQL} counts)""",
    "cases",
)
def calibration_overall(spark, sf_dir):
    out = calibration.overall(views.cases(spark, sf_dir))
    return rounded(out, *out.columns, digits=5)


@query("select metric, count(*) as n, round(avg(value), 5) as mean, round(avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 5) as low, round(avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*)), 5) as high from history group by metric", "history")
def mean_confidence_interval(spark, sf_dir):
    return rounded(calibration.mean_interval(views.history(spark, sf_dir), "value", "metric"), "mean", "low", "high", digits=5)


@query("select s_nationkey as nation, round(max(s_acctbal) - min(s_acctbal), 6) as spread, max(s_acctbal) - min(s_acctbal) <= 5000 + 1e-12 as consistent from supplier group by 1")
def variant_consistency(spark, sf_dir):
    rows = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("value"))
    return rounded(calibration.consistency(rows, "nation", 5000.0), "spread").select("nation", "spread", "consistent")


@query(
    """select content_type, round(corr(mos, snr), 6) as pearson, round(corr(rp, rr), 6) as spearman, round(avg(abs(mos - snr)), 6) as mae, round(sqrt(avg((mos - snr) * (mos - snr))), 6) as rmse, round(avg(mos - snr), 6) as bias, count(*) as n
    from (select *, rank() over (partition by content_type order by mos) + (count(*) over (partition by content_type, mos) - 1) / 2.0 as rp, rank() over (partition by content_type order by snr) + (count(*) over (partition by content_type, snr) - 1) / 2.0 as rr from results) group by content_type""",
    "results",
)
def proxy_agreement(spark, sf_dir):
    a = calibration.agreement(views.results(spark, sf_dir), "mos", "snr", "content_type")
    return rounded(a, "pearson", "spearman", "mae", "rmse", "bias")


@query("select content_type, round(avg(mos), 6) as mean, round(quantile_cont(mos, 0.1), 6) as p10, count(*) as n from results group by 1", "results")
def condition_stats(spark, sf_dir):
    r = views.results(spark, sf_dir).groupBy("content_type").agg(F.avg("mos").alias("mean"), F.percentile("mos", 0.1).alias("p10"), F.count("*").alias("n"))
    return rounded(r, "mean", "p10")


@query("select conv_id, turn, i + 1 as index, i * 32 as start, least(i * 32 + 32, n) as end from (select conv_id, turn, length(text) as n, unnest(range(0, cast(ceil(length(text) / 32) as bigint))) as i from conversations)")
def segment_bounds(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(signal.segment_bounds(F.length("text"), F.lit(16.0), 2.0)).alias("s"))
    return c.select("conv_id", "turn", F.col("s.index").cast("long").alias("index"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("select conv_id, string_agg(turn || ':' || case when length(text) < 60 then 'warn' else 'ok' end, ',' order by turn) as cells from conversations group by conv_id")
def segment_heatmap(spark, sf_dir):
    cells = insights.heatmap(views.table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") < 60)
    return cells.select("conv_id", F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["index"].cast("string"), c["status"])), ",").alias("cells"))


@query(f"select vec_id, round(list_aggregate(list_transform(samples, lambda x: abs(x)), 'max'), 6) as peak, round(sqrt(list_dot_product(samples, samples) / 64), 6) as rms, round(list_aggregate(samples, 'sum') / 64, 6) as dc, len(list_filter(samples, lambda x: abs(x) < 0.001)) / 64.0 as silence from ({WAVE_SQL})")
def wave_basic(spark, sf_dir):
    x = F.col("samples")
    w = views.waveforms(spark, sf_dir).select("vec_id", signal.peak(x).alias("peak"), signal.rms(x).alias("rms"), signal.mean(x).alias("dc"), signal.silence_ratio(x).alias("silence"))
    return rounded(w, "peak", "rms", "dc")


@query(f"select vec_id, len(list_filter(range(1, 64), lambda i: sign(samples[i]) <> sign(samples[i + 1]))) / 64.0 as zcr from ({WAVE_SQL})")
def wave_zcr(spark, sf_dir):
    return views.waveforms(spark, sf_dir).select("vec_id", signal.zero_crossings(F.col("samples")).alias("zcr"))


@query(f"select vec_id, i as frame, round(list_dot_product(samples[i * 8 + 1 : i * 8 + 16], samples[i * 8 + 1 : i * 8 + 16]) / 16, 6) as energy from (select *, unnest(range(0, 7)) as i from ({WAVE_SQL}))")
def wave_frame_energy(spark, sf_dir):
    w = views.waveforms(spark, sf_dir).select("vec_id", F.posexplode(signal.frame_energy(F.col("samples"), 16, 8)).alias("frame", "energy"))
    return rounded(w.withColumn("frame", F.col("frame").cast("long")), "energy")


@query(f"select vec_id, round(list_dot_product(c[1:60], c[5:64]) / list_dot_product(c, c), 5) as r4 from (select vec_id, list_transform(samples, lambda x: x - list_aggregate(samples, 'sum') / 64) as c from ({WAVE_SQL}))")
def wave_autocorrelation(spark, sf_dir):
    return rounded(views.waveforms(spark, sf_dir).select("vec_id", signal.autocorrelation(F.col("samples"), 4).alias("r4")), "r4", digits=5)


def wave_pairs(spark, sf_dir):
    """Each waveform with the next of its label."""
    from pyspark.sql import Window

    w = views.waveforms(spark, sf_dir)
    return w.withColumn("other", F.lead("samples").over(Window.partitionBy("label").orderBy("vec_id"))).where("other is not null")


PAIR_SQL = f"pairs as (select * from (select *, lead(samples) over (partition by label order by vec_id) as other from ({WAVE_SQL})) where other is not null)"


@query(f"with {PAIR_SQL} select vec_id, round(list_dot_product(samples, other) / sqrt(list_dot_product(samples, samples) * list_dot_product(other, other)), 5) as cosine from pairs")
def wave_cosine(spark, sf_dir):
    return rounded(wave_pairs(spark, sf_dir).select("vec_id", signal.cosine(F.col("samples"), F.col("other")).alias("cosine")), "cosine", digits=5)


@query(f"with {PAIR_SQL}, c as (select vec_id, list_transform(samples, lambda x: x - list_aggregate(samples, 'sum') / 64) as r, list_transform(other, lambda x: x - list_aggregate(other, 'sum') / 64) as e from pairs), d as (select vec_id, list_dot_product(r, e) as re, list_dot_product(r, r) as rr, list_dot_product(e, e) as ee from c) select vec_id, round(10 * log10(re * re / rr / (ee - re * re / rr)), 3) as si_sdr from d")
def wave_si_sdr(spark, sf_dir):
    return rounded(wave_pairs(spark, sf_dir).select("vec_id", signal.si_sdr(F.col("samples"), F.col("other")).alias("si_sdr")), "si_sdr", digits=3)


@query(
    f"""with b as (select vec_id, i, list_dot_product(samples[i * 8 + 1 : i * 8 + 16], samples[i * 8 + 1 : i * 8 + 16]) / 16 as z from (select *, unnest(range(0, 7)) as i from ({WAVE_SQL}))),
    l as (select *, -0.691 + 10 * log10(z) as lu from b where z > 0), g as (select vec_id, -0.691 + 10 * log10(avg(z)) - 10 as gate from l where lu > -70 group by vec_id),
    k as (select vec_id, round(-0.691 + 10 * log10(avg(z)), 5) as lufs from l join g using (vec_id) where lu > -70 and lu > gate group by vec_id) select vec_id, lufs from embeddings left join k using (vec_id)"""
)
def wave_gated_loudness(spark, sf_dir):
    w = views.waveforms(spark, sf_dir).select("vec_id", signal.gated_lufs(signal.frame_energy(F.col("samples"), 16, 8)).alias("lufs"))
    return rounded(w, "lufs", digits=5)


@query(f"select vec_id, coalesce(max(n), 0) as longest from (select vec_id, g, count(*) filter (where f) as n from (select *, i - row_number() over (partition by vec_id, f order by i) as g from (select vec_id, i, samples[i] > 0 as f from (select *, unnest(range(1, 65)) as i from ({WAVE_SQL})))) group by vec_id, f, g) group by vec_id")
def wave_longest_run(spark, sf_dir):
    flags = F.transform("samples", lambda x: x > 0)
    return views.waveforms(spark, sf_dir).select("vec_id", signal.longest_run(flags).cast("long").alias("longest"))


@query("select p_partkey, case when p_partkey % 5 = 0 then 'changed' when p_partkey % 7 = 0 then 'new' else 'cached' end as state from part")
def incremental_sources(spark, sf_dir):
    now = views.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("size"))
    before = now.where((F.col("p_partkey") % 7 != 0) | (F.col("p_partkey") % 5 == 0)).select("path", F.when(F.col("p_partkey") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return governance.source_states(now, before, "path", ["size"]).select("p_partkey", "state")


@query("select path, hit, n from (select p_brand as path, p_partkey % 3 = 0 as hit, count(*) as n from part group by all)")
def cache_split(spark, sf_dir):
    now = views.table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").cast("string").alias("path"), F.lit("c1").alias("config"), F.col("p_size").alias("size"))
    cache = now.where(F.col("path").cast("long") % 3 == 0).select("path", "config", "size", F.lit(True).alias("payload"))
    return governance.cache_lookup(now, cache, ["path", "config", "size"]).groupBy(F.col("p_brand").alias("path"), F.col("payload").isNotNull().alias("hit")).agg(F.count("*").alias("n"))


@query("select user_id as file, arg_max(event_type, (ts, event_id)) as decision, count(*) as n from events group by 1")
def review_latest(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("decision"), "ts", F.col("event_id").alias("tie"))
    return governance.latest_decisions(e, ["ts", "tie"])


@query("select metric, date_trunc('hour', ts) as start, count(*) as n, round(sum(value), 4) as total from history group by all", "history")
def event_time_windows(spark, sf_dir):
    return rounded(watch.windowed(views.history(spark, sf_dir), "1 hour"), "total", digits=4)


def audio_rows(spark, sf_dir):
    """One-second clips of 4 kHz, eight for each label: waveforms strung together, as decoded audio."""
    w = views.waveforms(spark, sf_dir).withColumn("clip", (F.col("vec_id") / 64).cast("int"))
    parts = w.groupBy("label", "clip").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "samples"))), lambda x: x["samples"]).alias("parts"))
    return parts.select(F.concat_ws("-", "label", "clip").alias("path"), F.lit(4000).alias("sample_rate"), F.array(F.flatten("parts").cast("array<float>")).alias("samples"))


@query()
def audio_metrics(spark, sf_dir):
    return groups.metric_facts(audio_rows(spark, sf_dir))


CLIPS_SQL = f"select concat(label, '-', clip) as path, flatten(list(samples order by vec_id)) as x from (select *, floor(vec_id / 64)::int as clip from ({WAVE_SQL})) group by label, clip"
BASIC_SQL = f"""
with c as (select path, list_transform(x, lambda v: v::float::double) as x from ({CLIPS_SQL})),
m as (select *, len(x) as n, list_max(list_transform(x, lambda v: abs(v))) as peak, sqrt(list_dot_product(x, x) / len(x)) as rms from c),
v as (select *, unnest([
  struct_pack(name := 'Duration', value := n / 4000), struct_pack(name := 'Sample Rate', value := 4000.0::double), struct_pack(name := 'Channels', value := 1.0::double), struct_pack(name := 'Peak Amplitude', value := peak),
  struct_pack(name := 'Peak Level', value := 20 * log10(peak)), struct_pack(name := 'RMS Level', value := 20 * log10(rms)), struct_pack(name := 'Crest Factor', value := 20 * log10(peak / rms)), struct_pack(name := 'Dynamic Range (simple)', value := 20 * log10(peak / rms)),
  struct_pack(name := 'DC Offset', value := list_sum(x) / n), struct_pack(name := 'Silence Ratio', value := 100 * len(list_filter(x, lambda s: abs(s) < 0.001)) / n), struct_pack(name := 'Clipping Detected', value := (peak >= 0.999)::int::double),
  struct_pack(name := 'Zero Crossing Rate', value := len(list_filter(range(1, n), lambda i: sign(x[i]) <> sign(x[i + 1]))) / (n - 1))]) as m from m)
select path, m.name as name, round(m.value, 6) as value from v
"""


@query(BASIC_SQL)
def audio_basic(spark, sf_dir):
    """The group that needs no transform, value by value."""
    f = groups.metric_facts(audio_rows(spark, sf_dir), ["basic"])
    return f.select("path", "name", F.round("value", 6).alias("value"))


TEMPORAL_SQL = f"""
with c as (select path, list_transform(x, lambda v: v::float::double) as x from ({CLIPS_SQL})),
f as (select path, i, list_slice(x, i * 40 + 1, i * 40 + 100) as f from (select *, unnest(range(0, ((len(x) - 100 + 39) // 40))) as i from c)),
e as (select path, i, list_dot_product(f, f) / 100 as e, len(list_filter(range(1, 100), lambda k: sign(f[k]) <> sign(f[k + 1]))) / 99 as z from f),
d as (select *, case when e > 0 then 10 * log10(e + 2.220446049250313e-16) else -120 end as db from e),
g as (select *, db > greatest(quantile_cont(db, 0.3) over (partition by path), -50) as act, max(e) over (partition by path) as most from d),
r as (select *, sum(act::int) over (partition by path order by i) as run from g),
p as (select path, run, count(*) * 0.01 as seconds from r where not act and run < (select max(run) from r x where x.path = r.path) group by path, run),
q as (select path, count(*) as n, avg(seconds) as mean, max(seconds) as longest from p where round(seconds, 6) > 0.1 group by path),
s as (select path, 100 * avg(act::int) as active, 1000 * min(i * 0.01) filter (where e >= 0.9 * most) as attack, sum(e * i * 0.01) / sum(e) as centre, var_pop(db) as spread, avg(z) as z, var_pop(z) as zv from g group by path),
v as (select path, unnest([struct_pack(name := 'Speech/Activity Ratio', value := active), struct_pack(name := 'Attack Time', value := attack), struct_pack(name := 'Temporal Centroid', value := centre), struct_pack(name := 'Num Pauses (>100ms)', value := coalesce(n, 0)::double), struct_pack(name := 'Mean Pause Duration', value := coalesce(mean, 0)), struct_pack(name := 'Max Pause Duration', value := coalesce(longest, 0)), struct_pack(name := 'Energy Variance', value := spread), struct_pack(name := 'ZCR Mean', value := z), struct_pack(name := 'ZCR Variance', value := zv)]) as m from s left join q using (path))
select path, m.name as name, round(m.value, 4) as value from v
"""


@query(TEMPORAL_SQL)
def audio_temporal(spark, sf_dir):
    """Activity, pauses and sign changes of frames."""
    f = groups.metric_facts(audio_rows(spark, sf_dir), ["temporal"])
    return f.select("path", "name", F.round("value", 4).alias("value"))


@query()
def audio_content(spark, sf_dir):
    """The content vote on audio: cues, confidence and type of each clip."""
    return groups.content(audio_rows(spark, sf_dir)).select("path", "cues.*", "confidence", "is_speech", "content_type", "f0_hz", "speech_fraction")


CONTRACT_SQL = """
with o as (select o_orderkey as k from orders)
select k as o_orderkey, '$.file' as path, 'required field is missing' as message from o where k % 5 = 0
union all select k, '$.duration_s', 'must be 0 or more' from o where k % 7 = 0
union all select k, '$.sample_rate', 'must be integer' from o where k % 11 = 0
union all select k, '$.metrics[0].value', 'must be number or string or boolean or null' from o where k % 13 = 0
union all select k, '$.metrics[1]', 'must be object' from o where k % 17 = 0
"""


@query(CONTRACT_SQL)
def contract_issues(spark, sf_dir):
    """Report rows in JSON, some of them broken, against the schema of a report row."""
    k = F.col("o_orderkey")
    part = lambda n, bad, good: F.when(k % n == 0, F.lit(bad)).otherwise(good)
    text = F.concat(F.lit("{"), part(5, "", F.concat(F.lit('"file": "f'), k.cast("string"), F.lit('", '))), F.lit('"duration_s": '), part(7, "-1", (k % 100).cast("string")), F.lit(', "sample_rate": '), part(11, '"x"', F.lit("16000")), F.lit(', "channels": 1, "metrics": [{"name": "SNR", "value": '), part(13, "[]", F.lit("3.5")), F.lit(', "unit": "dB", "group": "noise"}'), part(17, ", 5", F.lit("")), F.lit("]}"))
    return contracts.json_issues(views.table(spark, sf_dir, "orders").select(k, text.alias("text")), "text", contracts.REPORT_ROW)


SLICES_SQL = f"""
with w as ({WAVE_SQL}), r as (select samples as ref from w where vec_id = 0),
s as (select vec_id, i + 1 as segment_index, i * 20 as s, least((i + 1) * 20, 64) as e, samples, ref from (select *, unnest(range(0, 4)) as i from w), r),
p as (select *, round_even(s * 3000 / 4000, 0)::int as a, least(round_even(e * 3000 / 4000, 0), 64)::int as b from s)
select vec_id, segment_index::int as segment_index, s::int as start, e::int as "end", a as ref_start, b as ref_end, round(list_sum(list_transform(list_slice(samples, s + 1, e), lambda x: x::float::double)), 5) as own, round(list_sum(list_transform(list_slice(ref, a + 1, b), lambda x: x::float::double)), 5) as other from p
"""


@query(SLICES_SQL)
def reference_slices(spark, sf_dir):
    """Segments of 5 ms at 4 kHz with the same span of a reference at 3 kHz."""
    own = views.waveforms(spark, sf_dir)
    audio = lambda df, rate: df.select(F.col("vec_id").cast("string").alias("path"), F.lit(rate).alias("sample_rate"), F.array(F.col("samples").cast("array<float>")).alias("samples"))
    parts = reference.with_reference(reference.segments(audio(own, 4000), 0.005), audio(own.where("vec_id = 0"), 3000))
    sums = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v.cast("double")), 5)
    return parts.select(F.col("path").cast("long").alias("vec_id"), "segment_index", "start", "end", "ref_start", "ref_end", sums(F.col("samples")[0]).alias("own"), sums(F.col("ref_samples")).alias("other"))


@query()
def intrusive_metrics(spark, sf_dir):
    """Clips in quarters of a second against the same spans of one of them."""
    a = audio_rows(spark, sf_dir)
    return reference.intrusive_facts(a, a.where("path = '0-0'"), 0.25)


@query()
def audio_scorecard(spark, sf_dir):
    f = groups.metric_facts(audio_rows(spark, sf_dir)).withColumn("source_key", F.col("path")).withColumn("segment_index", F.lit(1)).where("value is not null")
    return scorecard.rollup(f)

from . import report_queries, voice_queries  # noqa: E402, F401  register their queries
