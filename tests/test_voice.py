"""Speech, prosody, psychoacoustic and speaker metrics and the content vote on signals with known answers."""

import math

import numpy as np
import pytest
import signals as S

from auralake.functions import frames, groups

RATE = S.RATE


def facts(spark, given, group):
    out = {k: {} for k in given}
    for r in groups.metric_facts(S.audio(spark, given), [group]).collect():
        out[r.path][r.name] = r.value
    return out


# Kernels -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule,want", [("open", [0, 2, 4]), ("short", [0, 2, 4]), ("closed", [0, 2, 4, 6])])
def test_frame_rules(rule, want):
    x = np.arange(10.0)
    got = np.concatenate([b[:, 0] for b in frames.blocks(x, 4, 2, rule)]).tolist()
    assert got == want
    assert frames.frame_count(9, 4, 2, "open") == 3 and frames.frame_count(9, 4, 2, "short") == 2 and frames.frame_count(3, 4, 2, "closed") == 0


def test_blocks_do_not_change_results(monkeypatch):
    x = S.harmonic(150, 1.0) + S.white(1.0, 0.01)
    want = [frames.mean_spectra(x, 1024, 256), frames.formants(x, RATE), frames.prominences(x, RATE), frames.slow_pitch(x, RATE), frames.long_spectra(x, RATE)]
    monkeypatch.setattr(frames, "BLOCK", 5000)
    got = [frames.mean_spectra(x, 1024, 256), frames.formants(x, RATE), frames.prominences(x, RATE), frames.slow_pitch(x, RATE), frames.long_spectra(x, RATE)]
    for a, b in zip(want, got, strict=True):
        for k in a:
            np.testing.assert_allclose(a[k], b[k], rtol=1e-9)


def test_mel_filters_are_triangles():
    bank = frames.mel_filters(16000, 257, 40, 80.0, 8000.0, lambda hz: hz * 513 / 16000)
    assert bank.shape == (40, 257) and bank.max() == 1 and bank.min() == 0
    for a in bank:
        at = np.flatnonzero(a)
        assert (np.diff(at) == 1).all() and (np.diff(np.sign(np.diff(a[at]))) <= 0).all()


def test_cepstra_of_a_scaled_signal_move_in_the_first_coefficient_only():
    x = S.white(1.0, 0.3)
    a, b = frames.cepstra(x, RATE).mean(axis=0), frames.cepstra(2 * x, RATE).mean(axis=0)
    assert b[0] - a[0] == pytest.approx(math.sqrt(40) * math.log(4), abs=0.01)
    np.testing.assert_allclose(a[1:], b[1:], atol=0.01)


def test_levinson_solves_the_normal_equations():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((5, 200))
    r = np.stack([(x[:, : 200 - k] * x[:, k:]).sum(axis=1) for k in range(9)], axis=1)
    for own, a in zip(r, frames.levinson(r, 8), strict=True):
        matrix = own[np.abs(np.arange(8)[:, None] - np.arange(8))]
        np.testing.assert_allclose(matrix @ a[1:], -own[1:], atol=1e-8)


@pytest.mark.parametrize("rate,target", [(8000, 16000), (48000, 16000), (44100, 16000), (16000, 44100), (16000, 16000)])
def test_resampling_keeps_tones(rate, target):
    x = S.sine(1000, 0.5, rate)
    y = frames.resample(x, rate, target)
    assert len(y) == -(-len(x) * target // rate)
    want = S.sine(1000, 1.0, target)[: len(y)]
    np.testing.assert_allclose(y[400:-400], want[400:-400], atol=5e-3)


def test_resampling_removes_what_the_lower_rate_cannot_hold():
    y = frames.resample(S.sine(12000, 0.5, 48000), 48000, 16000)
    assert np.abs(y[200:-200]).max() < 0.01


def test_peaks():
    assert frames.peaks(np.array([0, 1, 0, 3, 3, 3, 0, 2, 2, 5.0])).tolist() == [1, 4]
    assert frames.peaks(np.array([0, 1, 0, 3, 0, 2, 0.0]), 1.5).tolist() == [3, 5]
    assert frames.peaks(np.array([0, 1, 0, 3, 0, 2, 0.0]), distance=3).tolist() == [3]
    assert frames.running_median(np.array([1.0, 9, 2, 3, 0]), 3).tolist() == [1, 2, 3, 2, 0]


def test_band_pass():
    mid, low = frames.band_passed(S.sine(1000, 1.0), RATE, 300, 3400), frames.band_passed(S.sine(50, 1.0), RATE, 300, 3400)
    assert np.abs(mid[2000:-2000]).max() == pytest.approx(1, abs=0.01) and np.abs(low[2000:-2000]).max() < 1e-3


# Levels, loudness, spectrum, time and noise ----------------------------------------------------------------------------


def test_levels_and_channels(spark):
    left = S.sine(500, 1.0, level=0.5)
    late = np.roll(left, 8)
    rows = [("one", RATE, [left.tolist()]), ("same", RATE, [left.tolist(), left.tolist()]), ("late", RATE, [left.tolist(), late.tolist()]), ("anti", RATE, [left.tolist(), (-left / 4).tolist()])]
    df = spark.createDataFrame(rows, "path string, sample_rate int, samples array<array<float>>")
    got = {}
    for r in groups.metric_facts(df, ["basic"]).collect():
        got.setdefault(r.path, {})[r.name] = (r.value, r.warning)
    assert not any(k.startswith(("Channel ", "Stereo", "Interaural")) for k in got["one"])
    assert got["one"]["Peak Level"][0] == pytest.approx(-6.02, abs=0.01) and got["one"]["Crest Factor"][0] == pytest.approx(3.01, abs=0.01)
    same, late, anti = got["same"], got["late"], got["anti"]
    assert same["Stereo Phase Correlation"][0] == pytest.approx(1) and same["Stereo Width"][0] == pytest.approx(0, abs=1e-6) and same["Interaural Time Difference (ITD)"][0] == 0
    assert late["Interaural Time Difference (ITD)"][0] == pytest.approx(-0.5, abs=0.07)
    assert anti["Stereo Phase Correlation"] == (pytest.approx(-1), "Phase problems") and anti["Interaural Level Difference (ILD)"] == (pytest.approx(12.04, abs=0.01), "Unequal channels")
    assert anti["Channel 2 Peak Level"][0] == pytest.approx(-18.06, abs=0.01)


def test_loudness(spark):
    rate = 48000
    tone = S.sine(1000, 5, rate, 10 ** (-23 / 20))
    quarter = np.sin(2 * np.pi * rate / 4 * S.time(1, rate) + np.pi / 4)
    wide = np.concatenate([S.sine(1000, 20, rate, 10 ** (db / 20)) for db in (-30, -20)])
    rows = [("stereo", rate, [tone.tolist()] * 2), ("mono", rate, [tone.tolist()]), ("peak", rate, [quarter.tolist()]), ("wide", rate, [wide.tolist()] * 2), ("noise", RATE, [S.white(1.0, 0.2).tolist()])]
    got = {}
    for r in groups.metric_facts(spark.createDataFrame(rows, "path string, sample_rate int, samples array<array<float>>").repartition(4), ["loudness"]).collect():
        got.setdefault(r.path, {})[r.name] = r.value
    level = "Integrated Loudness (LUFS)"
    assert got["stereo"][level] == pytest.approx(-23, abs=0.1) and got["stereo"][level] - got["mono"][level] == pytest.approx(3.01, abs=0.01)
    assert got["stereo"]["Loudness Delta vs EBU R128"] == pytest.approx(round(got["stereo"][level] + 23, 2), abs=1e-9)
    assert -0.4 <= got["peak"]["True Peak"] <= 0.2
    assert got["noise"]["True Peak"] >= 20 * math.log10(np.abs(S.white(1.0, 0.2)).max()) - 1e-6
    assert got["wide"]["Loudness Range (LRA)"] == pytest.approx(10, abs=1)


def test_spectrum(spark):
    got = facts(spark, {"tone": S.sine(1000, 2.0, level=0.5), "quiet": S.sine(1000, 2.0, level=0.005), "noise": S.white(4.0, 0.1), "step": np.concatenate((S.sine(500, 1.0, level=0.5), S.sine(3000, 1.0, level=0.5)))}, "spectral")
    tone, quiet, noise = got["tone"], got["quiet"], got["noise"]
    assert tone["Spectral Centroid"] == pytest.approx(1000, rel=0.02) and tone["Spectral Rolloff (95%)"] == pytest.approx(1000, abs=50) and tone["Spectral Bandwidth"] < 50
    assert tone["Spectral Flatness"] < -30 and tone["Band Energy: Low-Mid (300–2000 Hz)"] > 99
    assert quiet["Spectral Flatness"] == pytest.approx(tone["Spectral Flatness"], abs=0.5) and quiet["Spectral Centroid"] == pytest.approx(tone["Spectral Centroid"], rel=1e-3)
    assert noise["Spectral Centroid"] == pytest.approx(4000, rel=0.03) and noise["Spectral Bandwidth"] == pytest.approx(8000 / math.sqrt(12), rel=0.03) and noise["Spectral Rolloff (95%)"] == pytest.approx(7600, rel=0.02)
    assert noise["Spectral Flatness"] == pytest.approx(10 * math.log10(math.exp(-0.5772156649)), abs=0.3) and "Estimated Fundamental (F0)" not in noise
    for name, share in (("Presence (2–6 kHz)", 4000), ("Air (6–20 kHz)", 2000), ("Low-Mid (300–2000 Hz)", 1700), ("Bass (80–300 Hz)", 220)):
        assert noise[f"Band Energy: {name}"] == pytest.approx(100 * share / 8000, abs=2)
    assert got["step"]["Spectral Bandwidth"] < 200 and noise["Effective Bandwidth"] > 7900 and abs(noise["Spectral Skewness"]) < 0.1


def gated(std):
    t = S.time(4.0)
    return 0.5 * np.sin(2 * np.pi * 220 * t) * ((t % 1) < 0.5) + S.white(4.0, std)


def test_noise(spark):
    stds = (0.002, 0.01, 0.05)
    voice = S.harmonic(150, 2.0)
    given = {f"g{s}": gated(s) for s in stds} | {"silent floor": gated(0.0), "silence": np.zeros(RATE)} | {f"h{f}": S.harmonic(f, 1.5) for f in (100, 150, 220, 300)} | {f"n{h}": voice + S.white(2.0, math.sqrt((voice**2).mean() / 10 ** (h / 10)), 5) for h in (0, 10, 20)}
    got = facts(spark, given, "noise")
    for s in stds:
        assert got[f"g{s}"]["Estimated SNR"] == pytest.approx(10 * math.log10((0.125 + s * s) / (s * s)), abs=1.5)
        assert got[f"g{s}"]["Estimated Noise Floor"] == pytest.approx(20 * math.log10(s), abs=1.0)
    assert got["silent floor"]["Estimated SNR"] == 100 and got["silent floor"]["Spectral SNR"] <= 100 and "Estimated Noise Floor" not in got["silent floor"]
    assert "Estimated SNR" not in got["silence"]
    hnr = "Harmonic-to-Noise Ratio (HNR)"
    assert all(got[f"h{f}"][hnr] > 30 for f in (100, 150, 220, 300))
    for h in (0, 10, 20):
        assert got[f"n{h}"][hnr] == pytest.approx(h, abs=2)


def test_dropouts(spark):
    tone, t = S.sine(440, 4.0, level=0.5), S.time(4.0)
    given = {}
    for n in (0, 1, 3, 5):
        x = tone.copy()
        for k in range(n):
            x[int((0.5 + 0.6 * k) * RATE) :][: int(0.2 * RATE)] = 0
        given[f"{n}"] = x
    early = tone.copy()
    early[2 * RATE // 1000 : 10 * RATE // 1000] = 0
    given |= {"early": early, "dips": tone * (1 - 0.9 * sum(np.exp(-((t - c) ** 2) / 0.005) for c in (0.8, 1.6, 2.4, 3.2))), "fades": np.clip(np.sin(2 * np.pi * 3 * t), 0, None) ** 2 * S.harmonic(150, 4.0), "padded": np.concatenate((np.zeros(RATE), tone, np.zeros(RATE)))}
    got = {k: v["Detected Dropouts"] for k, v in facts(spark, given, "noise").items()}
    assert got == {"0": 0, "1": 1, "3": 3, "5": 5, "early": 1, "dips": 0, "fades": 0, "padded": 0}


def test_time(spark):
    x = np.concatenate((S.sine(200, 0.5, level=0.5), np.zeros(RATE // 2), S.sine(200, 0.5, level=0.25), np.zeros(RATE // 4)))
    got = facts(spark, {"x": x}, "temporal")["x"]
    assert got["Num Pauses (>100ms)"] == 1 and got["Max Pause Duration"] == pytest.approx(0.48, abs=0.03)  # the last is still open
    assert got["Speech/Activity Ratio"] == pytest.approx(100 * 1.0 / 1.75, abs=4) and got["Attack Time"] == 0


# Speech --------------------------------------------------------------------------------------------------------------


def plain_cepstra(x, rate=RATE):
    """Frame by frame, band by band, from the definition."""
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / 512) for i in range(512)]
    x = np.concatenate((np.zeros(256), x, np.zeros(256)))
    x = np.concatenate((x, np.zeros(-(len(x) - 512) % 256)))
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edge = [math.floor(700 * (10 ** ((mel(80) + (mel(8000) - mel(80)) * i / 41) / 2595) - 1) * 513 / rate) for i in range(42)]
    out = []
    for at in range(0, len(x) - 511, 256):
        power = np.abs(np.fft.rfft(x[at : at + 512] * window)) ** 2 / sum(window) ** 2
        logs = []
        for a, b, c in zip(edge, edge[1:], edge[2:]):
            rise = sum(power[k] * (k - a) / (b - a) for k in range(a, b)) if b > a else 0
            fall = sum(power[k] * (c - k) / (c - b) for k in range(b, c + 1)) if c > b else (power[b] if b > a else 0)
            logs.append(math.log(rise + fall + 1e-8))
        out.append([math.sqrt((1 if k == 0 else 2) / 40) * sum(v * math.cos(math.pi / 40 * (i + 0.5) * k) for i, v in enumerate(logs)) for k in range(13)])
    return np.array(out)


def test_speech(spark):
    given = {"3": S.pulsing(200, 3.0, 3.0), "4": S.pulsing(200, 4.0, 3.0), "5": S.pulsing(200, 5.0, 3.0), "half": np.concatenate((np.zeros(RATE), S.sine(180, 1.0, level=0.2))), "voice": S.harmonic(150, 1.0), "noise": S.white(2.0, 0.1), "loud": S.white(1.0, 0.2)}
    got = facts(spark, given, "speech")
    for rate in "345":
        assert got[rate]["Estimated Speaking Rate"] == pytest.approx(float(rate), abs=0.35)
    assert got["half"]["Active Speech Level (ASL)"] == pytest.approx(20 * math.log10(0.2) - 3.01, abs=1.0)
    assert got["voice"]["Voiced/Unvoiced Ratio"] > 0.95 and got["loud"]["Voiced/Unvoiced Ratio"] < 0.05
    assert got["noise"]["Speech-Band SNR (300 Hz – 3.4 kHz)"] == pytest.approx(0.0, abs=0.5)
    assert got["noise"]["F2-Region Energy (1–2.5 kHz)"] == pytest.approx(100 * 1500 / 8000, abs=1.0)
    assert sum(k.startswith("MFCC-") for k in got["voice"]) == 26
    want = plain_cepstra(np.asarray(given["noise"], np.float32).astype(float))
    assert [got["noise"][f"MFCC-{i + 1} Mean"] for i in range(13)] == pytest.approx(want.mean(axis=0).tolist(), abs=1e-9)
    assert [got["noise"][f"MFCC-{i + 1} Std"] for i in range(13)] == pytest.approx(want.std(axis=0).tolist(), abs=1e-9)


# Prosody -------------------------------------------------------------------------------------------------------------


def test_pitch(spark):
    given = {f"{f:g}": S.harmonic(f, 2.0) for f in (100, 120, 150, 220, 300)}
    got = facts(spark, given | {"s120": S.sine(120, 2.0, level=0.5), "s220": S.sine(220, 2.0, level=0.5), "noise": S.white(2.0, 0.1)}, "prosody")
    for k in given:
        assert got[k]["Voiced Frame Ratio"] > 95 and got[k]["F0 Mean"] == pytest.approx(float(k), rel=0.005) and got[k]["F0 Std"] < 0.5
    assert got["s120"]["F0 Mean"] == pytest.approx(120, abs=1) and got["s220"]["F0 Mean"] == pytest.approx(220, abs=1)
    assert got["noise"]["Voiced Frame Ratio"] < 5 and "F0 Mean" not in got["noise"] and "Jitter (Local)" not in got["noise"]


def test_moving_pitch(spark):
    t2, t3 = S.time(2.0), S.time(3.0)
    got = facts(spark, {"glide": S.gliding(150 + 50 * t2), "shake": S.gliding(200 + 10 * np.sin(2 * np.pi * 5 * t3)), "swell": S.pulsing(200, 4.0, 3.0)}, "prosody")
    assert got["glide"]["F0 Slope"] == pytest.approx(50, abs=2) and got["glide"]["F0 Mean"] == pytest.approx(200, abs=3)
    shake = got["shake"]
    assert shake["Tremor Rate"] == pytest.approx(5, abs=0.35) and shake["F0 Std"] == pytest.approx(10 / math.sqrt(2), abs=0.5)
    assert shake["F0 Range"] == pytest.approx(20, abs=2) and shake["F0 Mean"] == pytest.approx(200, abs=1)
    assert got["swell"]["Estimated Speech Rate"] == pytest.approx(4, abs=0.3)


def test_perturbation(spark):
    given = {f"f{f}": S.unsteady(f, 3.0) for f in (120, 150, 220)} | {f"j{j}": S.unsteady(150, 3.0, period=j) for j in (0.0, 0.01, 0.02, 0.04)} | {f"s{s}": S.unsteady(150, 3.0, level=s) for s in (0.0, 0.02, 0.05, 0.1)} | {"both": S.unsteady(150, 3.0, 0.02, 0.05), "clean": S.harmonic(150, 2.0), "noisy": S.harmonic(150, 2.0) + S.white(2.0, 0.03)}
    got = facts(spark, given, "prosody")
    for f in (120, 150, 220):
        assert all(got[f"f{f}"][k] < 0.05 for k in ("Jitter (Local)", "Jitter (RAP)", "Shimmer (Local)", "Shimmer (APQ3)"))
    j = [got[f"j{v}"]["Jitter (Local)"] for v in (0.0, 0.01, 0.02, 0.04)]
    s = [got[f"s{v}"]["Shimmer (Local)"] for v in (0.0, 0.02, 0.05, 0.1)]
    assert j == sorted(set(j)) and j[-1] > 1 and s == sorted(set(s))
    assert got["both"]["Jitter (DDP)"] == pytest.approx(3 * got["both"]["Jitter (RAP)"], abs=5e-4)
    assert got["both"]["Shimmer (DDA)"] == pytest.approx(3 * got["both"]["Shimmer (APQ3)"], abs=5e-4)
    nhr = "NHR (Noise-to-Harmonics Ratio)"
    assert got["clean"][nhr] < 0.01 < got["noisy"][nhr]


# Hearing -------------------------------------------------------------------------------------------------------------


def test_psychoacoustics(spark):
    hz = [500, 1000, 2000, 2600, 2800, 3000, 3200, 3500, 5000, 7000]
    pair = lambda a, b: S.scaled(S.sine(a, 2.0) + S.sine(b, 2.0))
    given = {f"{f}": S.sine(f, 1.0, level=0.3) for f in hz} | {"tone": S.sine(1003, 2.0, level=0.3), "noise": S.white(2.0, 0.1, 4), "voice": S.harmonic(220, 2.0), "beat": pair(2000, 2055), "octave": pair(2000, 4000)}
    got = facts(spark, given, "psychoacoustic")
    assert got["1000"]["Sharpness"] == pytest.approx(0.11 * (26.81 * 1000 / 2960 - 0.53), abs=0.05)
    sharp = [got[str(f)]["Sharpness"] for f in hz]
    assert sharp == sorted(sharp)
    assert got["tone"]["Tonality"] > 0.99 and got["noise"]["Spectral Flatness (SFM)"] == pytest.approx(math.exp(-0.5772156649), abs=0.03)
    assert got["voice"]["Harmonicity"] > 0.95 and got["voice"]["F0 (cepstral estimate)"] == pytest.approx(220, abs=3)
    for name in ("Roughness", "Sensory Dissonance"):
        assert got["tone"][name] == pytest.approx(0, abs=1e-3) and got["octave"][name] == pytest.approx(0, abs=1e-3)
        assert got["beat"][name] > 10 * max(got["tone"][name], got["octave"][name], 1e-4)
    f0, covered, bins = got["noise"]["F0 (cepstral estimate)"], np.zeros(2049, bool), np.arange(2049) * RATE / 4096
    for k in range(1, 20):
        reach = max(3 * RATE / 4096, 0.03 * k * f0)
        covered |= (k * f0 <= RATE / 2) & (np.abs(bins - k * f0) <= reach)
    assert got["noise"]["Harmonicity"] == pytest.approx(covered[1:].mean(), abs=0.05)


# Speaker -------------------------------------------------------------------------------------------------------------


def aspirated(hnr, seed=3):
    voice = S.harmonic(150, 2.0)
    noise = np.random.default_rng(seed).normal(size=len(voice))
    return voice + noise * math.sqrt((voice**2).mean() / (noise**2).mean()) * 10 ** (-hnr / 20)


def test_speaker(spark):
    given = {f"tilt{e}": S.coloured(e, 8.0) for e in (0, 1, 2)} | {"vowel": S.vowel([700, 1220, 2600, 3500], [80, 90, 120, 150])} | {f"v{f}": S.harmonic(f, 2.0) for f in (50, 65, 120, 220, 300)} | {"noise": S.white(2.0, 0.1)}
    got = facts(spark, given, "speaker")
    for e, want in ((0, 0.0), (1, -3.01), (2, -6.02)):
        assert got[f"tilt{e}"]["Spectral Tilt"] == pytest.approx(want, abs=0.3)
    f = [got["vowel"][f"F{k} (Formant Frequency)"] for k in range(1, 5)]
    assert f == sorted(f) and f[0] == pytest.approx(700, rel=0.15)
    assert f[1:] == pytest.approx([1220, 2600, 3500], rel=0.05)
    creak = {k: v["Creakiness (Vocal Fry) Ratio"] for k, v in got.items()}
    assert creak["v50"] > 90 and creak["v65"] > 90 and max(creak[k] for k in ("v120", "v220", "v300", "noise")) < 5


def test_prominence(spark):
    given = {f"a{h}": aspirated(h) for h in (30, 20, 10, 5, 0, -5)} | {"v16": S.harmonic(150, 2.0), "v48": (S.harmonic(150, 2.0, 48000), 48000)}
    got = facts(spark, given, "speaker")
    cpp = {k: v["Cepstral Peak Prominence (CPP)"] for k, v in got.items()}
    falling = [cpp[f"a{h}"] for h in (30, 20, 10, 5, 0)]
    assert falling == sorted(falling, reverse=True) and falling[0] - falling[-1] > 5
    assert 17 <= cpp["v16"] <= 35 and abs(cpp["v16"] - cpp["v48"]) < 1
    breath = {k: v["Breathiness Index"] for k, v in got.items()}
    assert breath["v16"] == 0 and breath["a-5"] > 0.6 and breath["a5"] == pytest.approx(min(1, max(0, (21 - cpp["a5"]) / 8)), abs=1e-3)


# Opinion -------------------------------------------------------------------------------------------------------------


def test_opinions(spark):
    t = S.time(3.0)
    clean = np.clip(np.sin(2 * np.pi * 2 * t), 0, None) * S.harmonic(150, 3.0)
    spoken = S.spoken() * np.clip(np.sin(2 * np.pi * 2 * t), 0.02, None)
    given = {f"n{std}": clean + S.white(3.0, std) for std in (0.0, 1e-3, 1e-2, 3e-2)} | {"spoken": spoken, "rumble": spoken + 0.3 * np.sin(2 * np.pi * 40 * t), "white": S.white(3.0, 0.1), "delayed": S.white(3.0, 0.1) + np.roll(S.white(3.0, 0.1), 1600), "short": S.sine(200, 0.01)}
    got = facts(spark, given, "perceptual")
    for name in ("DNSMOS P.835 SIG (proxy)", "DNSMOS P.835 BAK (proxy)", "DNSMOS P.835 OVRL (proxy)", "Estimated MOS (non-intrusive proxy)"):
        scores = [got[f"n{std}"][name] for std in (0.0, 1e-3, 1e-2, 3e-2)]
        assert scores == sorted(scores, reverse=True), (name, scores)
    mos = "Estimated MOS (non-intrusive proxy)"
    assert got["n0.0"][mos] > got["n0.03"][mos]
    narrow = "P.563 Proxy (NB Quality Estimate)"
    assert got["spoken"][narrow] >= 3 and got["rumble"][narrow] < got["spoken"][narrow] - 0.3
    for v in got.values():
        if mos in v:
            assert v["UTMOS (proxy)"] == pytest.approx(min(5, max(1, 0.75 * v[mos] + 0.25 * v[narrow] / 4.5 * 5)), abs=0.011)
    assert got["white"]["AECMOS (proxy)"] > 4.5 and got["delayed"]["AECMOS (proxy)"] == pytest.approx(5 - 8 * 0.5, abs=0.2)
    assert not any(k.startswith(("DNSMOS", "Codec", "AECMOS")) for k in got["short"])


def test_codec_artifacts(spark):
    noise = S.white(2.0, 0.1)
    spectrum, hz = np.fft.rfft(noise), np.fft.rfftfreq(len(noise), 1 / RATE)
    low = np.fft.irfft(spectrum * (hz < 4000), len(noise))
    holed = np.fft.irfft(spectrum * ~((hz > 2000) & (hz < 7000) & (hz // 60 % 6 == 0)), len(noise))
    got = facts(spark, {"noise": noise, "low": low, "holed": holed}, "perceptual")
    assert got["noise"]["Estimated Codec Bandwidth Cutoff"] == pytest.approx(8000, abs=20) and got["low"]["Estimated Codec Bandwidth Cutoff"] == pytest.approx(4000, abs=200)
    assert got["noise"]["Spectral Hole Ratio"] < 1 and got["holed"]["Spectral Hole Ratio"] > 5
    assert got["low"]["Codec Artifact Risk"] > got["noise"]["Codec Artifact Risk"] + 15
    assert all(0 <= v["Pre-echo Risk"] <= 1 for v in got.values())


# Content -------------------------------------------------------------------------------------------------------------


def test_content_vote(spark):
    other = {"s120": S.sine(120, 3.0, level=0.5), "s220": S.sine(220, 3.0, level=0.5), "s1000": S.sine(1000, 3.0, level=0.5), "white": S.white(3.0, 0.1), "pink": S.coloured(1, 3.0), "brown": S.coloured(2, 3.0), "silence": np.zeros(3 * RATE), "clipped": np.clip(1.4 * S.sine(440, 3.0), -1, 1)}
    got = {r.path: r for r in groups.content(S.audio(spark, other | {"spoken": S.spoken()})).collect()}
    for k in other:
        assert not got[k].is_speech and got[k].content_type != "speech" and 0 <= got[k].confidence <= 1, (k, got[k])
    assert got["silence"].content_type == "silence" and got["silence"].confidence == 0
    assert got["spoken"].is_speech and got["spoken"].content_type == "speech" and got["spoken"].f0_hz == pytest.approx(120, rel=0.02)


@pytest.mark.parametrize("rate", [4000, 16000])
def test_short_and_silent_recordings_have_no_nan(spark, rate):
    given = {"silence": np.zeros(rate), "short": S.sine(200, 0.01, rate, 0.5), "one": np.array([0.5]), "tone": S.sine(200, 1.0, rate, 0.5), "half": S.sine(200, 0.05, rate, 0.5)}
    audio = S.audio(spark, given, rate)
    rows = groups.metric_facts(audio).collect()
    assert all(math.isfinite(r.value) for r in rows)
    assert {r.grp for r in rows if r.path == "tone"} == set(groups.GROUPS)
    assert groups.content(audio).count() == 5
    with pytest.raises(ValueError):
        groups.metric_facts(audio, ["nothing"])
    with pytest.raises(ValueError):
        frames.measured(audio, ["nothing"])


def test_recordings_without_samples_have_no_row(spark):
    df = spark.createDataFrame([("a", 16000, None), ("b", None, [[0.1]]), ("c", 16000, []), ("d", 16000, [[]])], "path string, sample_rate int, samples array<array<float>>")
    assert groups.metric_facts(df).count() == 0 and groups.content(df).count() == 0
