"""Measures against a reference on signals with known answers; slices however the reference travels."""

import math

import numpy as np
import pytest
import signals as S
from pyspark.sql import functions as F

from auralake.functions import reference

RATE = S.RATE


def compare(spark, given, ref, rate=RATE, ref_rate=RATE, seconds=None):
    out = {}
    for r in reference.intrusive_facts(S.audio(spark, given, rate), S.audio(spark, {"ref": ref}, ref_rate), seconds).collect():
        out.setdefault((r.path, r.segment_index) if seconds else r.path, {})[r.name] = r.value
    return out


def test_ratios_equal_the_injected_noise(spark):
    ref = S.harmonic(150, 2.0)
    noise = S.white(2.0, 1.0, 11)
    noisy = {f"{db}": ref + noise * math.sqrt((ref**2).mean() / (noise**2).mean() / 10 ** (db / 10)) for db in (0, 10, 20)}
    got = compare(spark, noisy | {"half": 0.5 * ref, "same": ref.copy()}, ref)
    for db in (0, 10, 20):
        assert got[f"{db}"]["SI-SDR"] == pytest.approx(db, abs=0.3) and got[f"{db}"]["SDR (Signal-to-Distortion Ratio)"] == pytest.approx(db, abs=0.3)
    assert got["half"]["SI-SDR"] > 100 and got["half"]["SDR (Signal-to-Distortion Ratio)"] == pytest.approx(10 * math.log10(4), abs=0.01)
    same = got["same"]
    assert same["Log-Spectral Distance"] == pytest.approx(0, abs=1e-6) and same["Spectral Correlation"] == pytest.approx(1, abs=1e-6) and same["Cepstral Distance"] == pytest.approx(0, abs=1e-6)
    assert same["PESQ proxy"] == 4.5 and same["STOI proxy"] == 1
    distances = [got[k]["Log-Spectral Distance"] for k in ("same", "20", "10", "0")]
    assert distances == sorted(distances)


def test_reference_at_another_rate(spark):
    got = compare(spark, {"x": S.harmonic(150, 2.0, count=8)}, S.harmonic(150, 2.0, 8000, 8), ref_rate=8000)
    assert got["x"]["Spectral Correlation"] > 0.95


@pytest.mark.parametrize("limit,piece", [(1 << 24, 1 << 20), (10, 3000)])
def test_segments_meet_their_own_span(spark, monkeypatch, limit, piece):
    """A recording is compared with the same seconds of the reference, at another rate, in pieces or whole."""
    monkeypatch.setattr(reference, "BROADCAST_SAMPLES", limit)
    monkeypatch.setattr(reference, "PIECE", piece)
    notes = [S.harmonic(f, 0.5) for f in (120, 180, 250)]
    ref = np.concatenate([S.harmonic(f, 0.5, 8000) for f in (120, 180, 250)])
    got = compare(spark, {"x": np.concatenate(notes), "long": np.concatenate([*notes, notes[0]])}, ref, ref_rate=8000, seconds=0.5)
    assert sorted(got) == [("long", 1), ("long", 2), ("long", 3), ("x", 1), ("x", 2), ("x", 3)]  # nothing to compare the last half second with
    assert all(v["Spectral Correlation"] > 0.9 for v in got.values())
    parts = reference.with_reference(reference.segments(S.audio(spark, {"x": np.concatenate(notes)}), 0.4), S.audio(spark, {"r": ref}, 8000))
    rows = {r.segment_index: r for r in parts.collect()}
    assert [(rows[k].start, rows[k].end, rows[k].ref_start, rows[k].ref_end) for k in sorted(rows)] == [(0, 6400, 0, 3200), (6400, 12800, 3200, 6400), (12800, 19200, 6400, 9600), (19200, 24000, 9600, 12000)]
    for r in rows.values():
        np.testing.assert_allclose(r.ref_samples, ref.astype(np.float32)[r.ref_start : r.ref_end])


def test_reference_edges(spark):
    audio = S.audio(spark, {"x": S.sine(200, 0.2)})
    none = spark.createDataFrame([("n", RATE, None), ("e", RATE, [[]])], "path string, sample_rate int, samples array<array<float>>")
    with pytest.raises(ValueError):
        reference.with_reference(reference.segments(audio), none)
    with pytest.raises(ValueError):
        reference.with_reference(reference.segments(audio), S.audio(spark, {"a": S.sine(1, 0.1), "b": S.sine(2, 0.1)}))
    assert reference.intrusive_facts(none, audio).count() == 0
    stereo = audio.select("path", "sample_rate", F.array(F.col("samples")[0], F.transform(F.col("samples")[0], lambda v: -v)).alias("samples"))
    silent = {r.name: r.value for r in reference.intrusive_facts(stereo, audio).collect()}
    assert all(math.isfinite(v) for v in silent.values()) and silent["SDR (Signal-to-Distortion Ratio)"] == pytest.approx(0, abs=1e-6)
