"""Operators on hand-made rows with known results."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auralake.functions import groups, signal
from auralake.operators import audit, baseline, calibration, diff, features, governance, insights, rules, scorecard, sinks
from auralake.operators.ranking import global_row_number
from auralake.plans.presets import PRESETS, preset_rules, rules_table
from auralake.sources import reports, wav
from auralake.streaming import watch

FACT = "file string, source_key string, segment_index int, pos int, grp string, name string, value double, warning string, higher_is_better boolean, ref_lo double, ref_hi double, error string"


def facts(spark, *rows):
    return spark.createDataFrame([(f, s, i, p, g, n, v, w, None, None, None, None) for f, s, i, p, g, n, v, w in rows], FACT)


def test_scorecard_basic(spark):
    f = facts(spark, ("a", "a", 1, 0, "loudness", "LUFS", -16.0, None), ("b", "b", 1, 0, "loudness", "LUFS", -14.0, None), ("a", "a", 1, 1, "loudness", "True Peak", -0.8, "hot"), ("b", "b", 1, 1, "loudness", "True Peak", -1.2, None))
    r = {x.name: x for x in scorecard.rollup(f).collect()}
    assert (r["LUFS"].mean, r["LUFS"].min_file, r["LUFS"].max_file) == (-15.0, "a", "b")
    assert r["True Peak"].warning_count == 1
    assert {x.file: x.status for x in scorecard.result_status(f, "file").collect()} == {"a": "warn", "b": "ok"}


def test_scorecard_means_segments_first(spark):
    f = facts(spark, ("call#1", "call", 1, 0, "g", "m", -20.0, "w"), ("call#2", "call", 2, 0, "g", "m", -10.0, None), ("other", "other", 1, 0, "g", "m", -6.0, None))
    r = scorecard.rollup(f).first()
    assert (r.source_count, r.warning_count, r.mean) == (2, 1, -10.5)


def test_outliers_and_modal(spark):
    f = facts(spark, *[(f"f{i}", f"f{i}", 1, 0, "g", "m", float(v), None) for i, v in enumerate([1, 2, 3, 2, 1, 2, 99])])
    assert [r.source_key for r in scorecard.outliers(f).collect()] == ["f6"]
    m = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", None)], "key string, v string")
    assert scorecard.modal(m, ["key"], "v").first().dominant == "b"  # ties go to the largest


def test_bucket_rounds_half_even(spark):
    rows = spark.createDataFrame([(2.5,), (1.25,), (0.125,), (-1.25,), (250.0,)], "v double")
    got = [r[0] for r in rows.select(features.bucket_index(F.col("v"))).collect()]
    assert got == [5, 2, 2, -2, 25]


def test_labels_and_triage(spark):
    r = spark.createDataFrame([("noisy", 8.0, 0.1, 0.0, -16.0, 3.5, "speech"), ("quiet", 30.0, -3.0, 0.0, -28.0, 2.2, "speech"), ("clean", 30.0, -2.0, 0.0, -16.0, 3.9, "speech"), ("empty", None, None, None, None, 1.0, "silence")], "file string, snr double, peak double, clip double, lufs double, mos double, content_type string")
    got = {x.file: [y.id for y in x.labels] for x in insights.defect_labels(r).collect()}
    assert got == {"noisy": ["noisy_floor", "clipping_risk"], "quiet": ["under_loud", "low_perceptual_quality"], "clean": [], "empty": ["silence_heavy"]}
    t = {x.file: (x.rank, x.score) for x in insights.triage(insights.defect_labels(r)).collect()}
    assert t["noisy"] == (1, round(50 * 0.95 + 50 * 0.86 + 20, 3)) and t["clean"] == (4, 0.0)
    with pytest.raises(KeyError):
        insights.defect_labels(r, "unknown")


def test_rules(spark):
    f = facts(spark, ("a", "a", 1, 0, "noise", "Estimated  SNR", 5.0, "old"), ("b", "b", 1, 0, "noise", "estimated snr", 50.0, None))
    r = rules_table(spark, [("Estimated SNR", None, 12.0, None, "low"), ("Other", None, None, None, None, True, None)])
    found = rules.violations(f, r)
    assert [(x.file, x.message) for x in found.collect()] == [("a", "low")]
    assert sorted(x.file for x in rules.required_missing(f, f, r).collect()) == ["a", "b"]
    assert [x.metric for x in rules.unmatched(f, r).collect()] == ["Other"]
    with pytest.raises(ValueError):
        rules.unmatched(f, r, "error")
    assert {x.file: x.warning for x in rules.add_warnings(f, found).collect()} == {"a": "old; low", "b": None}
    bad = rules_table(spark, [("m", "noise", 3.0, 1.0, None), ("M", "noise", 3.0, 1.0, None), ("x", "nowhere", None, 1.0, None)])
    assert sorted((x.rule_id, x.severity) for x in rules.lint(bad, ("noise",)).collect()) == [(0, "error"), (1, "error"), (1, "warn"), (2, "error")]
    assert all(preset_rules(spark, p).count() == 3 for p in PRESETS)
    with pytest.raises(ValueError):
        preset_rules(spark, "none")


def test_diff(spark):
    cols = "file string, error string, grp string, name string, value double, warning string, higher_is_better boolean, ref_lo double, ref_hi double"
    b = spark.createDataFrame([("a", None, "loudness", "True Peak", -2.0, None, False, None, None), ("a", None, "speech", "STOI", 0.82, None, True, None, None), ("gone", None, "g", "m", 1.0, None, None, None, None)], cols)
    a = spark.createDataFrame([("a", None, "loudness", "True Peak", -0.3, "hot", False, None, None), ("a", None, "speech", "STOI", 0.90, None, True, None, None), ("new", "bad", "g", "m", 1.0, None, None, None, None)], cols)
    got = {(x.file, x.name): x.classification for x in diff.diff(b, a).collect()}
    assert got == {("a", "True Peak"): "regression", ("a", "STOI"): "improvement", ("gone", "file"): "removed", ("new", "file"): "added"}
    s = diff.summary(diff.diff(b, a)).first()
    assert (s.files_added, s.files_removed, s.regressions, s.improvements, s.changes) == (1, 1, 1, 1, 4)
    e = {x.name: x.verdict for x in diff.evaluate_repair(b, a, {}).collect()}
    assert e == {"True Peak": "regression", "STOI": "improvement"}
    base, now = (spark.createDataFrame(r, "name string, value double") for r in ([("t", 1.0), ("z", 0.0), ("gone", 1.0)], [("t", 1.05), ("z", 1.0)]))
    assert {x.name: (x.within_budget, x.missing) for x in diff.budget(base, now).collect()} == {"t": (True, False), "z": (False, False), "gone": (False, True)}


@pytest.mark.parametrize("feature,value,worse", [("loudness.integrated_lufs", -10, True), ("loudness.integrated_lufs", -22, True), ("prosody.f0_mean", 160, True), ("spectral.centroid", 1100, True), ("noise.snr", 45, False), ("noise.snr", 20, True), ("loudness.true_peak", -8, False)])
def test_baseline_direction(spark, feature, value, worse):
    start = {"noise.snr": 30.0, "loudness.integrated_lufs": -16.0, "loudness.true_peak": -3.0, "spectral.centroid": 1500.0, "prosody.f0_mean": 120.0}[feature]
    base = baseline.profile(spark.createDataFrame([(feature, start)] * 3, "feature string, value double"))
    assert baseline.compare(spark.createDataFrame([(feature, float(value))], "feature string, value double"), base).first().regressed is worse


def test_drift_and_alerts(spark):
    h = spark.createDataFrame([("m", datetime.datetime(2024, 1, 1, 0, 0, i), i, float(v)) for i, v in enumerate([20, 21, 19, 20, 20.5, 19.5, 20.2, 8.0])], "metric string, ts timestamp, tie long, value double")
    assert [r.status for r in baseline.zscore_drift(h).orderBy("tie").collect()] == ["insufficient_history"] * 5 + ["ok", "ok", "drift"]
    a = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), s) for s in (0, 100, 400)] + [("b", datetime.datetime(2024, 1, 1, 0, 0, 5), 5)], "metric string, ts timestamp, tie long")
    assert sorted((r.metric, r.tie) for r in baseline.alert_cooldown(a).collect()) == [("a", 0), ("a", 400), ("b", 5)]
    assert baseline.bounded_history(h, 3).count() == 3


def test_alert_cooldown_streams_groups(spark):
    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows, want = [(None, None, -1), ("a", None, -2), ("a", None, -3)], [("None", -1), ("a", -2), ("a", -3)]
    for metric, step, n in (("a", 5, 800), ("b", 250, 200), ("c", 2000, 60), (None, 90, 100)):
        at, last = 0.0, None
        for i in range(n):
            at += rng.choice([0, step * rng.random(), step, 300]) if i else 0
            at = round(at, 6)
            rows.append((metric, start + datetime.timedelta(seconds=at), len(rows)))
            us = round(at * 1e6)
            if last is None or us - last >= 300_000_000:
                last = us
                want.append((str(metric), rows[-1][2]))
    h = spark.createDataFrame(rows, "metric string, ts timestamp, tie long").repartition(3)
    out = baseline.alert_cooldown(h)
    assert sorted((str(r.metric), r.tie) for r in out.collect()) == sorted(want)
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_audit(spark):
    p = spark.createDataFrame([("/home/test/data/train/a.wav",), ("/x/VAL/b.wav",), ("/x/y.wav",)], "p string")
    assert [r[0] for r in p.select(audit.split_of(F.col("p"))).collect()] == ["train", "validation", None]
    r = spark.createDataFrame([("/train/a", "s", "sig", "speech", "speech", None), ("/test/b", "s", "sig", "speech", "music", None), ("/test/c", "s", None, None, None, None), ("/d", None, None, None, None, "broken")], "file string, speaker string, signature string, content_type string, declared string, error string")
    assert {(x.kind, x.key) for x in audit.split_leakage(r).collect()} == {("duplicate", "sig"), ("speaker", "s")}
    assert {x.action: x["items"] for x in audit.remediation(r).collect()} == {"deduplicate": 1, "remove_split_leakage": 2, "fix_or_remove_unreadable": 1, "rebalance_speakers": 1, "review_content_labels": 2}


def test_calibration(spark):
    rows = [("a", "noisy", True, True), ("b", "noisy", False, True), ("c", "clip", True, True), ("c", "noisy", False, True), ("d", "clip", True, False), ("d", "loud", True, False)]
    c = spark.createDataFrame(rows, "case string, label string, expected boolean, predicted boolean")
    got = {r.label: r for r in calibration.per_label(c, spark.createDataFrame([("noisy",), ("clip",), ("loud",), ("none",)], "label string")).collect()}
    assert got["noisy"].precision == pytest.approx(1 / 3) and got["noisy"].recall == 1 and got["noisy"].f1 == pytest.approx(0.5)
    assert got["clip"].precision == 1 and got["clip"].recall == 0.5 and got["loud"].f1 == 0 and got["none"].support == 0
    o = calibration.overall(c).first()
    assert o.micro_precision == o.micro_recall == o.micro_f1 == 0.5
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    t = calibration.mean_interval(v, "v", method="t").first()
    assert (t.low, t.high) == pytest.approx((0.4457, 4.5543), abs=2e-2)
    one = calibration.mean_interval(v.limit(1), "v").first()
    assert one.low == one.high == one.mean
    k = spark.createDataFrame([("x", 1.0), ("x", 1.2), ("y", 1.0), ("y", None)], "key string, value double")
    assert {r.key: r.consistent for r in calibration.consistency(k, "key", 0.2).collect()} == {"x": True, "y": False}


def test_ranking(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("s"), "id").repartition(5)
    got = [r.id for r in global_row_number(df, [F.desc("s"), F.asc("id")]).orderBy("rank").collect()]
    assert got == sorted(range(1000), key=lambda i: (-(i % 7), i))


def test_governance(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size int")
    old = spark.createDataFrame([("a", 1), ("b", 9)], "path string, size int")
    assert {r.path: r.state for r in governance.source_states(now, old, "path", ["size"]).collect()} == {"a": "cached", "b": "changed", "c": "new"}
    codes = spark.createDataFrame([(0,), (2,), (1,)], "c int")
    assert codes.agg(governance.exit_severity(F.col("c"))).first()[0] == 1
    rep = spark.createDataFrame([("a", 16000, 1, 1.0), ("b", None, 1, -1.0)], "file string, sample_rate int, channels int, duration_s double")
    assert governance.validate(rep).count() == 2
    assert governance.migrate(rep).first().schema_version == "3.6"


def test_reports_and_sinks(spark, tmp_path):
    text = '[{"file": "a.wav", "source_file": "", "metrics": [{"name": "SNR", "value": 30, "unit": "dB", "group": "noise"}, {"name": "Backend", "value": "acf", "group": "prosody"}]}, {"file": "b.wav", "metrics": [{"name": "SNR", "value": null, "group": "noise"}]}]'
    (tmp_path / "r.json").write_text(text)
    f = reports.metric_facts(reports.read_report(spark, str(tmp_path / "r.json")))
    got = {(r.file, r.name): (r.value, r.text, r.kind) for r in f.collect()}
    assert got == {("a.wav", "SNR"): (30.0, None, "number"), ("a.wav", "Backend"): (None, "acf", "str"), ("b.wav", "SNR"): (None, None, "null")}
    w = {r.file: r.SNR for r in sinks.wide(f, ["file"]).collect()}
    assert w == {"a.wav": 30.0, "b.wav": None}
    j = sinks.json_lines(spark.createDataFrame([(float("nan"), "x")], "v double, s string")).first().value
    assert j == '{"v":null,"s":"x"}'
    assert "a\\|b" in sinks.markdown_table(spark.createDataFrame([("a|b", 1.0)], "s string, v double"))
    s = sinks.prometheus(f.withColumn("ord", F.lit(1)), f.select("file", "error").distinct().withColumn("ord", F.lit(1)), ["ord"])
    assert 'audio_metric{file="a.wav",group="noise",metric="SNR"}' in {r.series for r in s.collect()}


def tone(freq, level, seconds=2.0, rate=16000):
    return level * np.sin(2 * np.pi * freq * np.arange(int(seconds * rate)) / rate)


def test_wav_and_metrics(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "tone.WAV").write_bytes(wav.encode(tone(1000, 0.999)[None], 16000))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "notes.txt").write_text("no audio")
    audio_rows = wav.read_wav(spark, str(tmp_path)).collect()
    assert {r.path.rsplit("/", 1)[1]: r.error is None for r in audio_rows} == {"tone.WAV": True, "bad.wav": False}
    f = {r.name: r.value for r in groups.metric_facts(wav.read_wav(spark, str(tmp_path))).collect()}
    assert f["Peak Level"] == pytest.approx(0, abs=0.02) and f["RMS Level"] == pytest.approx(-3.01, abs=0.02) and f["Crest Factor"] == pytest.approx(3.01, abs=0.02)
    assert f["Spectral Centroid"] == pytest.approx(1000, rel=0.02)
    with pytest.raises(ValueError):
        groups.metric_facts(wav.read_wav(spark, str(tmp_path)), ("nothing",))


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_widths(width):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8000)
        half = {1: [192, 64], 2: [16384, -16384], 3: [1 << 22, -(1 << 22)], 4: [1 << 30, -(1 << 30)]}[width]
        w.writeframes(b"".join(v.to_bytes(width, "little", signed=width > 1) for v in half))
    rate, bits, x = wav.decode(out.getvalue())
    assert rate == 8000 and bits == 8 * width and x[:, 0].tolist() == [0.5, -0.5]


def test_signal_functions(spark):
    x = F.col("x")
    df = spark.createDataFrame([([1.0, -1.0, 1.0, -1.0],)], "x array<double>")
    r = df.select(signal.rms(x).alias("rms"), signal.zero_crossings(x).alias("z"), signal.autocorrelation(x, 2).alias("r"), signal.db(signal.peak(x)).alias("db"), signal.longest_run(F.transform(x, lambda v: v > 0)).alias("run"), signal.segment_bounds(F.lit(5), F.lit(2.0), 1.0).alias("s")).first()
    assert (r.rms, r.z, r.r, r.db, r.run) == (1.0, 0.75, 0.5, 0.0, 1)
    assert [tuple(s) for s in r.s] == [(1, 0, 2), (2, 2, 4), (3, 4, 5)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 0.0, 1.0), ("a", 100.0, 1.0), ("a", 400.0, 1.0), ("b", 5.0, 1.0)], "key string, at double, value double").coalesce(1).write.parquet(str(src))
    got = []
    stream = spark.readStream.schema("key string, at double, value double").parquet(str(src))
    watch.drain(watch.alerts(stream), lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "c1"))
    assert sorted(got) == [("a", 0.0, 1.0), ("a", 400.0, 1.0), ("b", 5.0, 1.0)]
    got.clear()
    values = spark.readStream.schema("key string, at double, value double").parquet(str(src)).withColumnRenamed("key", "metric")
    watch.drain(watch.drift(values, min_samples=2), lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "c2"))
    assert [s for m, _, _, s in sorted(got) if m == "a"] == ["insufficient_history", "insufficient_history", "ok"]


def test_watch_folder(spark, tmp_path):
    folder = tmp_path / "watch"
    folder.mkdir()
    (folder / "a.wav").write_bytes(wav.encode(tone(500, 0.5, 0.2)[None], 16000))
    (folder / "b.txt").write_text("x")
    seen = []
    run = lambda: watch.drain(watch.new_versions(watch.watch_files(spark, str(folder))), lambda df, i: seen.extend(r.path.rsplit("/", 1)[1] for r in df.select("path").collect()), str(tmp_path / "c"))
    run()
    assert seen == ["a.wav"]
    (folder / "c.wav").write_bytes(wav.encode(tone(500, 0.5, 0.2)[None], 16000))
    run()
    assert sorted(seen) == ["a.wav", "c.wav"]
