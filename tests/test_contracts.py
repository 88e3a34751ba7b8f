"""Schema validation of JSON, and custom metric groups."""

import json
import math

import pytest
import signals as S

from auralake.functions import groups, registry
from auralake.operators import contracts

METRIC = {"name": "SNR", "value": 3.5, "unit": "dB", "group": "noise"}
GOOD = {"file": "a.wav", "duration_s": 1.5, "sample_rate": 16000, "channels": 1, "metrics": [METRIC], "error": None, "insights": {"defect_labels": [{"id": "x", "severity": "fail", "confidence": 0.9}]}}


def changed(**fields):
    return {k: v for k, v in (GOOD | fields).items() if v is not Ellipsis}


def issues(spark, payloads, schema):
    df = spark.createDataFrame([(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)], "i int, text string")
    out = [[] for _ in payloads]
    for r in contracts.json_issues(df, "text", schema).collect():
        out[r.i].append((r.path, r.message))
    return [sorted(o) for o in out]


def test_report_rows(spark):
    cases = [
        (GOOD, []),
        ({}, [(f"$.{k}", "required field is missing") for k in ("channels", "duration_s", "file", "metrics", "sample_rate")]),
        (changed(file=3), [("$.file", "must be string")]),
        (changed(duration_s=-1), [("$.duration_s", "must be 0 or more")]),
        (changed(sample_rate=1.5), [("$.sample_rate", "must be integer")]),
        (changed(channels=True), [("$.channels", "must be integer")]),
        (changed(error=1), [("$.error", "must be string or null")]),
        (changed(metrics={}), [("$.metrics", "must be array")]),
        (changed(metrics=[METRIC, {"name": "x", "value": [], "unit": "", "group": "g"}, 3]), [("$.metrics[1].value", "must be number or string or boolean or null"), ("$.metrics[2]", "must be object")]),
        (changed(metrics=[METRIC | {"reference_range": [1.0]}]), [("$.metrics[0].reference_range", "must hold 2 items or more")]),
        (changed(metrics=[METRIC | {"reference_range": [1, "a", 3]}]), [("$.metrics[0].reference_range", "must hold 2 items or fewer"), ("$.metrics[0].reference_range[1]", "must be number")]),
        (changed(metrics=[METRIC | {"reference_range": None, "value": None}]), []),
        (changed(insights={"defect_labels": [{"id": "x", "severity": "bad", "confidence": None}]}), [("$.insights.defect_labels[0].severity", 'must be "info" or "warn" or "fail"')]),
        (changed(insights=None, notes=["a", 2]), [("$.notes[1]", "must be string")]),
        ([], [("$", "must be object")]),
        ("{broken", [("$", "is no JSON")]),
        ("", [("$", "is no JSON")]),
    ]
    assert issues(spark, [c for c, _ in cases], contracts.REPORT_ROW) == [sorted(w) for _, w in cases]


def test_other_keywords(spark):
    schema = {"type": "object", "properties": {"v": {"const": 2}, "w": {"type": "object", "additionalProperties": False, "properties": {"a": {}}}}}
    assert issues(spark, [{"v": 2, "w": {"a": 1}}, {"v": 3, "w": {"a": 1, "b": 2, "c": 3}}], schema) == [[], [("$.v", "must be 2"), ("$.w.b", "unexpected field"), ("$.w.c", "unexpected field")]]


def test_report_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([GOOD, changed(file=...)], indent=1))
    (tmp_path / "r.jsonl").write_text("\n".join([json.dumps(GOOD), "", json.dumps(changed(file=...)), "nothing"]))
    assert [tuple(r) for r in contracts.report_issues(spark, str(tmp_path / "r.json")).collect()] == [("$[1].file", "required field is missing")]
    assert sorted(map(tuple, contracts.report_issues(spark, str(tmp_path / "r.jsonl")).collect())) == [("$[1].file", "required field is missing"), ("$[2]", "is no JSON")]


@pytest.fixture
def custom():
    def own(x, rate):
        yield "Samples", x.shape[1], "samples"
        yield {"name": "Half", "value": float("nan"), "warning": "none"}

    def broken(x, rate):
        if x.shape[1] > 1000:
            raise RuntimeError("too long")
        return [("Fine", 1)]

    registry.register(" Own ", own)
    registry.register("broken", broken)
    yield own
    registry.unregister("own")
    registry.unregister("broken")


def test_registry(custom):
    assert registry.available()[-2:] == ["own", "broken"] and set(groups.GROUPS) < set(registry.available())
    for name, flags in ((" ALL ", {}), ("", {}), ("noise", {"overwrite": True}), ("OWN", {})):
        with pytest.raises(ValueError):
            registry.register(name, custom, **flags)
    registry.register("own", custom, overwrite=True)
    with pytest.raises(ValueError):
        registry.unregister("speech")
    with pytest.raises(KeyError):
        registry.unregister("nothing")
    assert registry.chosen(["own", "ALL", "noise"])[0] == "own" and set(registry.chosen(["all"])) == set(registry.available())
    with pytest.raises(ValueError):
        registry.chosen(["nothing"])


def test_custom_groups_run_beside_built_in_ones(spark, custom):
    audio = S.audio(spark, {"long": S.sine(200, 0.2), "short": S.sine(200, 0.05)})
    rows = registry.facts(audio, ["own", "broken", "spectral"])
    got = {(r.path, r.grp, r.name): r.value for r in rows.collect()}
    assert got["long", "own", "Samples"] == 3200 and got["short", "broken", "Fine"] == 1 and got["long", "own", "Half"] is None
    assert math.isclose(got["long", "spectral", "Spectral Centroid"], 200, rel_tol=0.1)
    assert [tuple(r) for r in registry.failures(rows).collect()] == [("long", "broken", "RuntimeError: too long")]


def test_table_function(spark, custom):
    name = registry.as_table_function(spark, "own")
    S.audio(spark, {"a": S.sine(200, 0.01), "b": S.sine(200, 0.02)}).createOrReplaceTempView("some_audio")
    got = spark.sql(f"select path, name, value from some_audio, lateral {name}(samples, sample_rate)").collect()
    assert sorted((r.path, r.name, r.value) for r in got if r.name == "Samples") == [("a", "Samples", 160.0), ("b", "Samples", 320.0)]
