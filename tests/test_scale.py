"""What queries send through shuffles: little enough for tables of a thousand times the tests' size."""

import os
import re

import pytest
from pyspark.sql import functions as F

from auralake import queries
from auralake.operators import baseline, diff, enrich, features, ranking, reports, scorecard, sinks
from auralake.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def shuffles(df) -> list[str]:
    """How rows are dealt in each shuffle of the plan."""
    return re.findall(r"Exchange (\w+\([^\n]*)", df._jdf.queryExecution().executedPlan().toString())

def written(monkeypatch) -> list[set[str]]:
    """Columns of the tables that cut lineage."""
    seen, real = [], ranking.checkpointed

    def one(df):
        seen.append(set(df.columns))
        return real(df)

    for module in (ranking, enrich):
        monkeypatch.setattr(module, "checkpointed", one)
    return seen


def test_duplicates_shuffle_signatures_only(spark):
    metrics = lambda *v: [("SNR", v[0]), ("Estimated SNR", v[-1]), ("Other", 1.0)]
    rows = [("a", metrics(1.0, 30.0)), ("a", metrics(2.0, 30.0)), ("b", metrics(30.0)), ("c", metrics(5.0)), ("d", [("SNR", None)])]
    df = spark.createDataFrame(rows, "source_key string, metrics array<struct<name: string, value: double>>")
    own = df.select("source_key", features.extract(F.col("metrics")).alias("features"))
    assert [[tuple(f) for f in r.features] for r in own.orderBy("source_key").collect()] == [[("noise.snr", 30.0)]] * 3 + [[("noise.snr", 5.0)], []]
    signed = own.select(features.signature(F.col("features")).alias("signature"), "source_key")
    assert not shuffles(signed)
    assert [tuple(r) for r in features.duplicates(signed).select("results", "sources", "n_groups").collect()] == [(3, 2, 1)]


def test_drift_shuffles_a_result_once(spark):
    rows = [("a", 1, [("noise.snr", 20.0)]), ("a", 2, []), ("a", 3, [("noise.snr", 30.0), ("loudness.true_peak", -2.0)]), ("b", 1, [("noise.snr", 5.0)])]
    df = spark.createDataFrame(rows, "s string, at int, features array<struct<feature: string, value: double>>")
    got = sorted((r.s, r["at"], r.feature, r.delta, r.status) for r in baseline.sequential_drift(df, "s", ["at"]).collect())
    assert got == [("a", 1, "noise.snr", None, "baseline"), ("a", 3, "loudness.true_peak", None, "baseline"), ("a", 3, "noise.snr", 10.0, "drift"), ("b", 1, "noise.snr", None, "baseline")]
    assert len(shuffles(QUERIES["sequential_drift"](spark, DATA))) == 1


def test_regressions_need_no_grouping_of_results(spark):
    assert not [s for s in shuffles(QUERIES["baseline_regressions"](spark, DATA)) if "file" in s]


def test_top_regressions_group_results_once(spark):
    assert len([s for s in shuffles(QUERIES["top_regressions"](spark, DATA)) if "file" in s]) == 1


def test_wide_rows_need_no_shuffle(spark):
    assert not shuffles(QUERIES["csv_pivot"](spark, DATA))


def test_features_need_no_shuffle(spark):
    assert not shuffles(QUERIES["feature_extract"](spark, DATA))


def test_buckets_need_no_shuffle(spark):
    assert not shuffles(QUERIES["fingerprint_buckets"](spark, DATA))


def test_profiles_count_values_once(spark):
    plan = shuffles(QUERIES["baseline_profile"](spark, DATA))
    assert not [s for s in plan if "file" in s]
    df = spark.createDataFrame([("f", float(v)) for v in (1, 2, 2, 4, 11)], "feature string, value double")
    assert [tuple(r) for r in baseline.profile(df).collect()] == [("f", 4.0, pytest.approx(1.2), pytest.approx(9.6), 5)]


def test_audit_writes_signatures_only(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["audit_issues"](spark, DATA).count()
    assert {"_sig", "_dup"} in seen and not [c for c in seen if c & {"metrics", "features", "defect_labels", "fingerprint"}]


def test_comparison_writes_no_rows(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["baseline_comparison"](spark, DATA).count()
    assert not [c for c in seen if c & {"metrics", "features", "defect_labels", "fingerprint"}]


def test_drift_changes_write_no_rows(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["drift_changes"](spark, DATA).count()
    assert not [c for c in seen if c & {"metrics", "features", "defect_labels", "fingerprint"}]


def test_report_ranks_what_it_returns(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["enrich_report"](spark, DATA).count()
    assert not [c for c in seen if c & {"metrics", "features", "defect_labels", "fingerprint"}] and any({"score", "labels", "_id"} <= c for c in seen)


def test_summary_ranks_its_own_columns(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["insight_summary"](spark, DATA).count()
    assert not [c for c in seen if c & {"metrics", "features", "repair_suggestions"}]


def test_heatmap_writes_no_rows(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["report_heatmap"](spark, DATA).count()
    assert not seen


def test_insights_write_no_rows(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["scorecard_insights"](spark, DATA).count()
    assert not [c for c in seen if c & {"metrics", "features", "defect_labels", "fingerprint"}]


def test_snippets_write_no_rows(spark, monkeypatch):
    seen = written(monkeypatch)
    assert QUERIES["labelled_snippets"](spark, DATA).count()
    assert not seen


def test_equal_ties_go_by_name(spark):
    rows = [("a", 1.0, 5.0, "x"), ("a", 2.0, 5.0, "y"), ("a", 3.0, 4.0, "z")]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "k string, value double, tie double, row string").coalesce(1)
        assert [r.value for r in diff.last_of(df, ["k"], "tie", "row").collect()] == [2.0]


def test_series_shuffle_a_result_once(spark):
    assert len([s for s in shuffles(QUERIES["prometheus_series"](spark, DATA)) if "file" in s]) == 1
    rows = [('a"', 2, None, [("g", "m", 2.0), ("g", "m", 3.0), ("g", "n", None)]), ('a"', 1, "bad", [("g", "m", None), ("g", "n", 7.0)])]
    df = spark.createDataFrame(rows, "file string, ord int, error string, metrics array<struct<grp: string, name: string, value: double>>")
    got = {r.series: r.value for r in sinks.prometheus_rows(df, ["ord"]).collect()}
    assert got == {'audio_metric{file="a\\"",group="g",metric="m"}': 2.0, 'audio_metric{file="a\\"",group="g",metric="n"}': 7.0, 'audio_analysis_error{file="a\\""}': 1.0}


def test_diagnostics_are_searched_once_a_key(spark):
    assert len(re.findall(r"(?<!_)filter\(", str(reports.merged_diagnostics(F.col("d"))))) == 1


def test_rollup_shuffles_a_result_once(spark):
    facts = queries.mixed_facts(spark, DATA)
    assert len(shuffles(facts)) == 1
    assert len(shuffles(scorecard.by_source(facts))) == 1  # dealt by source already
