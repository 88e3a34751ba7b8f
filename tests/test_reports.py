"""Enrichment, rule files, providers, histories, watching and writers, where queries with SQL don't reach."""

import json
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from auralake.functions import signal, voice
from auralake.operators import calibration, diff, enrich, governance, history, ranking, reports, rules, scorecard, sinks
from auralake.plans.presets import rules_table
from auralake.streaming import watch

METRICS = "array<struct<name: string, grp: string, value: double, unit: string, confidence: string>>"
ROWS = f"file string, source_file string, segment_index int, segment_start_s double, segment_end_s double, duration_s double, sample_rate int, content_type string, error string, metrics {METRICS}, ord int"


def row(file, ord, *metrics, content="speech", source=None, duration=2.0, error=None, segment=None):
    return (file, source, segment, None, None, duration, 16000, content, error, [(n, g, v, "dB", None) for n, g, v in metrics], ord)


def test_enrich_clean_and_noisy(spark):
    noisy = row("b.wav", 2, ("SNR", "noise", 8.0), ("True Peak", "loudness", 0.1), ("DNSMOS OVRL", "perceptual", 2.0))
    clean = row("a.wav", 1, ("SNR", "noise", 30.0), ("True Peak", "loudness", -2.0))
    mute = row("c.wav", 3, ("P.563 Proxy (NB Quality Estimate)", "perceptual", 1.0), ("Detected Dropouts", "noise", 2.0), content="silence", duration=0.0, error="broken")
    df = spark.createDataFrame([clean, noisy, mute], ROWS)
    e = {r.file: r for r in enrich.enrich(df, ci=True, drift_order=["ord"]).collect()}
    ids = {f: [x.id for x in r.defect_labels] for f, r in e.items()}
    assert ids == {"a.wav": [], "b.wav": ["noisy_floor", "clipping_risk", "low_perceptual_quality"], "c.wav": ["dropouts", "silence_heavy"]}
    assert e["b.wav"].defect_labels[0].evidence == "SNR is 8.0 dB" and e["b.wav"].defect_labels[0].evidence_metrics[0].metric == "SNR"
    assert e["b.wav"].ci_checks[0].status == "fail" and e["a.wav"].ci_checks[0].status == "pass"
    assert [e[f].drift_monitor.status for f in ("a.wav", "b.wav", "c.wav")] == ["baseline", "drift", "stable"]
    assert e["b.wav"].rank == 1 and e["b.wav"].reasons[-2:] == ["drift", "ci_failure"]
    assert [i.id for i in e["c.wav"].dataset_audit] == ["unreadable_audio"]
    assert enrich.enrich(df.limit(0), ci=True).count() == 0
    assert [r.kind for r in scorecard.insight_counts(enrich.enrich(df)).where("key = 'dropouts'").collect()] == ["defect_label"]


def test_signature_is_the_hash_of_compact_json(spark):
    import hashlib

    df = spark.createDataFrame([row("a", 1, ("SNR", "noise", 30.3), ("Spectral Centroid", "spectral", 2e7), ("True Peak", "loudness", -0.02))], ROWS)
    f = enrich.feature_array(F.col("metrics"), F.col("duration_s"), F.col("sample_rate"))
    got = df.select(enrich.fingerprint(f, "coarse", {"noise.snr": 2})["signature"].alias("s"), enrich.fingerprint(f, "nonsense")["signature"].alias("b")).first()
    weighted = {"buckets": {"loudness.true_peak": 0.0, "noise.snr": 60.0, "spectral.centroid": 20000000.0}, "sensitivity": "coarse", "weights": {"noise.snr": 2.0}}
    plain = {"buckets": {"loudness.true_peak": 0.0, "noise.snr": 30.0, "spectral.centroid": 20000000.0}, "sensitivity": "balanced", "weights": {}}
    assert (got.s, got.b) == tuple(hashlib.sha1(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16] for x in (weighted, plain))


def test_derived_clipping_and_duplicates(spark):
    near = lambda n, flag: [("Near-Clipped Samples", "noise", n), ("Clipping Detected", "basic", flag)]
    df = spark.createDataFrame([row("a", 1, *near(3200.0, 1.0)), row("b", 2, *near(3200.0, 1.0)), row("c", 3, *near(5.0, 0.0), source="a")], ROWS)
    e = {r.file: r for r in enrich.enrich(df).collect()}
    assert [f.value for f in e["a"].features] == [0.1] and [f.value for f in e["c"].features] == [0.0]
    assert [i.id for i in e["a"].dataset_audit] == ["duplicate_quality_fingerprint"] and e["c"].dataset_audit == []


def test_providers_and_carried_labels(spark):
    df = spark.createDataFrame([row("a", 1, ("SNR", "noise", 30.0))], ROWS)
    label = lambda name: F.array(F.struct(F.lit(name).alias("id"), F.lit(None).cast("string").alias("severity"), F.lit(0.5).alias("confidence"), F.lit("").alias("evidence"), F.array().cast("array<struct<metric: string, grp: string, value: double, unit: string>>").alias("evidence_metrics"), F.lit(None).cast("string").alias("source")))
    first = enrich.enrich(df, providers={"one": lambda m: label("x"), "two": lambda m: label("y")})
    assert [(x.id, x.severity, x.source) for x in first.first().defect_labels] == [("x", "warn", "plugin:one"), ("y", "warn", "plugin:two")]
    again = enrich.enrich(first.select(*df.columns, "defect_labels"), providers={"two": lambda m: label("z")}).first()
    assert [x.id for x in again.defect_labels] == ["x", "z"]

    def broken(metrics):
        raise KeyError("no such thing")

    mixed = enrich.enrich(df, providers={"broken": broken, "wrong": lambda m: m["nothing"], "one": lambda m: label("x")}).first()
    assert [x.id for x in mixed.defect_labels] == ["x"]
    assert [(d.code, d.source) for d in mixed.provider_diagnostics] == [("plugin_label_provider_failed", "broken"), ("plugin_label_provider_failed", "wrong")]
    assert "KeyError" in mixed.provider_diagnostics[0].message


def test_rule_files(spark, tmp_path):
    good = tmp_path / "r.toml"
    good.write_text('[[labels]]\nfeature = "noise.snr"\nmin = 20\n')
    assert enrich.load_insight_rules(str(good)) == {"labels": [{"feature": "noise.snr", "min": 20}]}
    bad = {"labels": [{"feature": "x"}, {"feature": "noise.snr", "min": 3, "max": 1}, {"feature": "noise.snr", "min": True, "severity": "bad", "confidence": 2, "ci_fail": 1, "id": 3}, 5], "more": 1}
    assert len(enrich.rule_problems(bad)) == 10 and enrich.rule_problems([]) and enrich.rule_problems({"labels": 1})
    (tmp_path / "b.json").write_text(json.dumps(bad))
    for name, text in (("b.json", None), ("broken.json", "{"), ("x.txt", ""), ("gone.json", None)):
        if text is not None:
            (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            enrich.load_insight_rules(str(tmp_path / name))
    (tmp_path / "t.json").write_text(json.dumps({"rules": [{"metric": "SNR", "min": 20, "max": 40.5}, {"metric": "X", "equals": 1, "require_present": True}]}))
    own = rules_table(spark, rules.load_threshold_rules(str(tmp_path / "t.json")))
    facts = spark.createDataFrame([("a", "noise", "SNR", 10.0, None), ("a", "noise", "X", 2.0, None), ("b", "noise", "X", 1.0, "old; X should be == 1.0")], "file string, grp string, name string, value double, warning string")
    got = {(r.file, r.message) for r in rules.violations(facts, own).collect()}
    assert got == {("a", "SNR should be >= 20 and <= 40.5"), ("a", "X should be == 1.0")}
    warned, every, notes = rules.apply_rules(facts, facts, own)
    assert {r.file: r.n for r in notes.collect()} == {"a": 2} and warned.where("warning like '%<= 40.5%'").count() == 1 and every.count() == 2
    for text in ('{"rules": 3}', '[{"min": 3}]', '[{"metric": "a", "least": 3}]', '[{"metric": "a", "min": "3"}]'):
        (tmp_path / "w.json").write_text(text)
        with pytest.raises(ValueError):
            rules.load_threshold_rules(str(tmp_path / "w.json"))


def test_percentiles_and_borders(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [(f"k{i % 3}", float(v)) for i, v in enumerate(rng.integers(0, 40, 400))] + [("one", 5.0), ("one", None), ("two", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {r.k: (r.lo, r.mid, r.hi) for r in ranking.exact_percentiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.95}).collect()}
    for k in ("k0", "k1", "k2"):
        assert got[k] == pytest.approx(np.percentile([v for a, v in data if a == k], [5, 50, 95]))
    assert got["one"] == (5.0, 5.0, 5.0) and "two" not in got


def test_student_quantiles():
    for df, want in ((1, 12.706204736174698), (2, 4.302652729749464), (3, 3.182446305283708), (4, 2.776445105197793), (30, 2.0422724563), (200, 1.9718962236)):
        assert calibration.t_quantile(df, 0.95) == pytest.approx(want, rel=1e-9)
    assert calibration.t_quantile(150, 0.95) > NormalDist().inv_cdf(0.975)


def test_history_and_alerts(spark, tmp_path):
    folder = str(tmp_path / "history")
    assert history.load(spark, folder).count() == 0
    facts = spark.createDataFrame([("SNR", v, None, i) for i, v in enumerate([20.0, 21.0, 19.0, 20.0, 20.5, 19.5, float("nan")])] + [("SNR", 1.0, "bad", 9)], "name string, value double, error string, ord int")
    history.record(facts, folder, "2024-01-01 00:00:00", "ord")
    history.append(spark.createDataFrame([("SNR", "2024-01-02 00:00:00", 0, 8.0)], "metric string, ts string, tie int, value double"), folder)
    states = [r.status for r in history.check(spark, folder).orderBy("ts", "tie").collect()]
    assert states == ["insufficient_history"] * 5 + ["ok", "drift"]
    w = history.window(spark, folder, 3).first()
    assert (w.n, w.least, w.latest) == (3, 8.0, 8.0)
    batch = spark.createDataFrame([("a", 0.0, "x"), ("a", 10.0, "x"), ("b", 400.0, "y")], "key string, at double, text string")
    sent = spark.createDataFrame([("b", 200.0)], "key string, at double")
    out = []
    assert history.deliver(batch, sent, out.append) == ([{"key": "a", "at": 0.0, "text": "x"}], []) and len(out) == 1
    assert history.deliver(batch, sent.limit(0), lambda page: 1 / 0)[0] == []


def test_watch_contract(spark, tmp_path):
    src, got = str(tmp_path / "s"), []
    sight = [("p", "1:1", 0.0), ("p", "2:2", 1.0), ("p", "2:2", 2.0), ("p", "2:2", 3.0), ("p", "3:3", 4.0), ("p", "3:3", 9.0), ("q", "1:1", 0.0)]
    spark.createDataFrame(sight, "path string, signature string, at double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("path string, signature string, at double").parquet(src)
    watch.drain(watch.settled(stream, debounce_s=2.0), lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "c"))
    assert sorted(got) == [("p", "2:2", 3.0, "ready"), ("p", "3:3", 9.0, "ready")]
    tries, got = str(tmp_path / "t"), []
    spark.createDataFrame([("p", float(i), True) for i in range(3)] + [("q", 0.0, True), ("q", 1.0, False), ("q", 2.0, True)], "path string, at double, failed boolean").coalesce(1).write.parquet(tries)
    watch.drain(watch.retries(spark.readStream.schema("path string, at double, failed boolean").parquet(tries)), lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "d"))
    assert sorted(got, key=repr) == [("p", 1, 2.0), ("p", 2, 5.0), ("p", 3, None), ("q", 1, 2.0), ("q", 1, 4.0)]


def test_migration_chain(spark):
    assert governance.version_chain("legacy") == ["legacy", "3.0", "3.4", "3.5", "3.6"]
    for steps in ({"1": "2"}, {"1": "2", "2": "1"}):
        with pytest.raises(ValueError):
            governance.version_chain("1", steps)
    with pytest.raises(Exception, match="unsupported schema version"):
        governance.migrate(spark.createDataFrame([("a", "9.9")], "file string, schema_version string")).collect()
    assert governance.compatible("1.2", "1.3") and not governance.compatible("2.0", "1.3") and not governance.compatible("x", "1.3")


def test_writers(spark):
    df = spark.createDataFrame([("a|b\\", 1.0, "<x>")] * 3, "s string, v double, t string")
    assert sinks.markdown_table(df.limit(1)).splitlines()[2] == "| a\\|b\\\\ | 1.0000 | <x> |"
    with pytest.raises(ValueError):
        sinks.markdown_table(df, most=2)
    assert sinks.html_rows(df.limit(1), "t").first().line == '<tr class="&lt;x&gt;"><td>a|b\\</td><td>1.0000</td><td>&lt;x&gt;</td></tr>'
    wide = sinks.wide_report(spark.createDataFrame([row("a", 1, ("SNR", "noise", 1.0), ("SNR", "noise", 2.0), ("X", "noise", math.inf))], ROWS))
    assert len(wide.columns) == 24 and (wide.first().SNR, wide.first().X) == (2.0, None)
    back = reports.from_rows_of_json(reports.to_rows_of_json(spark.createDataFrame([row("a", 1, ("SNR", "noise", math.nan))], ROWS)), spark.createDataFrame([], ROWS).schema)
    assert back.first().metrics[0].value is None
    lines = [r.line for r in sinks.exposition_lines(spark.createDataFrame([('audio_metric{file="a"}', 1.0)], "series string, value double")).orderBy("family", "ord").collect()]
    assert lines[1].startswith("# HELP audio_metric") and lines[2] == 'audio_metric{file="a"} 1.0'


def test_diff_edges(spark):
    x = F.col("x")
    assert spark.createDataFrame([(math.nan,)], "x double").select(diff.close(x, x).alias("c")).first().c
    labels = spark.createDataFrame([([("over_loud",)],), ([],)], "labels array<struct<id: string>>").select(diff.repair_plan(F.col("labels"), F.lit(44100)).alias("p")).collect()
    assert [s.filter for s in labels[0].p] == ["loudnorm=I=-16:TP=-1.5:LRA=11", "aresample=44100"] and [s.filter for s in labels[1].p] == ["anull"]


def test_voice_edges(spark):
    x = F.col("x")
    df = spark.createDataFrame([([0.0] * 40,), ([0.5, -0.5] * 20,), ([],)], "x array<double>")
    got = df.select(voice.silence_score(x, 8, 4).alias("s"), voice.active_level(x, 8, 4, 3).alias("a"), voice.voiced_ratio(x, 8, 4).alias("v"), voice.jitter(x)["local"].alias("j"), signal.sdr(x, x).alias("d")).collect()
    assert (got[0].s, got[0].a, got[0].v, got[0].j) == (0.0, None, None, None)
    assert got[1].s == 1.0 and got[1].a == pytest.approx(20 * math.log10(0.5)) or got[1].a is None
    assert got[2].a is None and got[2].j is None
