"""Metric groups and the content vote over frame measures: column expressions on the rows of `frames.measured`.

Each group gives an array of metrics; a metric whose measure is missing (a recording too short or too quiet for it) is left
out, as is everything of a group that rests on a pitch if fewer than four frames are voiced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import voice
from .frames import KERNELS, TRACKS, measured
from .signal import bound, centred, dot, gated_lufs, longest_run, lufs, mean, power_db, total
from .voice import clip, percentile, slope

EPS64 = 2.0**-52
METRIC = "struct<grp:string,name:string,value:double,unit:string,higher_is_better:boolean,ref_lo:double,ref_hi:double,warning:string>"


class Metric(NamedTuple):
    """A metric of a group; `warning` makes its text of the metric's own value."""

    name: str
    value: Column
    unit: str = ""
    higher: bool | None = None
    bounds: tuple[float | None, float | None] = (None, None)
    warning: Callable[[Column], Column] | None = None

    def row(self, group: str, value: Column) -> Column:
        """The metric with an own column's value, or null if that is missing."""
        warning = F.lit(None) if self.warning is None else self.warning(value)
        own = F.struct(F.lit(group).alias("grp"), F.lit(self.name).alias("name"), value.alias("value"), F.lit(self.unit).alias("unit"), F.lit(self.higher).cast("boolean").alias("higher_is_better"), F.lit(self.bounds[0]).cast("double").alias("ref_lo"), F.lit(self.bounds[1]).cast("double").alias("ref_hi"), warning.cast("string").alias("warning"))
        return F.when(value.isNotNull() & ~F.isnan(value), own)


def rounded(x: Column, digits: int) -> Column:
    return F.round(x, digits)


def bin_sum(spectrum: Column, size: int | Column, low: float, high: float | Column, closed: bool = False) -> Column:
    """Sum of the bins of a spectrum of `size` points whose frequencies lie from `low` to `high`, the latter included if `closed`."""
    step = F.col("sample_rate") / size

    def inside(_: Column, i: Column) -> Column:
        hz = i * step
        return (hz >= low) & ((hz <= high) if closed else (hz < high))

    return total(F.filter(spectrum, inside))


def around(spectrum: Column, first: Column, last: Column) -> Column:
    """Sum of the bins from `first` to `last`, as far as they exist."""
    low = F.greatest(first, F.lit(0))
    return F.when(last >= low, total(F.slice(spectrum, low.cast("int") + 1, (last - low + 1).cast("int")))).otherwise(0.0)


def share_of(flags: Column) -> Column:
    return F.try_divide(F.size(F.filter(flags, lambda f: f)).cast("double"), F.size(flags).cast("double"))


def decibels(x: Column) -> Column:
    return F.when(x > 0, 20 * F.log10(x))


# Groups --------------------------------------------------------------------------------------------------------------


def basic() -> list[Metric]:
    peak, level = decibels(F.col("peak")), decibels(F.col("rms"))
    return [
        Metric("Duration", F.col("seconds"), "s"),
        Metric("Sample Rate", F.col("sample_rate"), "Hz"),
        Metric("Channels", F.col("channels")),
        Metric("Peak Amplitude", F.col("peak"), higher=False, bounds=(0.0, 0.99)),
        Metric("Peak Level", peak, "dBFS", higher=False, bounds=(-3.0, 0.0), warning=lambda v: F.when(v >= 20 * math.log10(0.999), "Clipping risk").when(v < -18, "Low level")),
        Metric("RMS Level", level, "dBFS", bounds=(-20.0, -9.0)),
        Metric("Crest Factor", peak - level, "dB"),
        Metric("DC Offset", F.col("offset"), higher=False, warning=lambda v: F.when(F.abs(v) > 0.01, "DC offset")),
        Metric("Silence Ratio", 100 * F.col("quiet"), "%", warning=lambda v: F.when(v > 50, "Mostly silence")),
        Metric("Dynamic Range (simple)", peak - level, "dB"),
        Metric("Clipping Detected", F.col("clipped"), higher=False, warning=lambda v: F.when(v > 0, "Clipping")),
        Metric("Zero Crossing Rate", F.col("crossing_rate"), "crossings/sample"),
        Metric("Stereo Phase Correlation", F.col("correlation"), bounds=(-0.2, 1.0), warning=lambda v: F.when(v < 0, "Phase problems")),
        Metric("Stereo Width", F.col("width"), bounds=(0.1, 0.8)),
        Metric("Interaural Level Difference (ILD)", F.col("level_difference"), "dB", higher=False, warning=lambda v: F.when(F.abs(v) > 6, "Unequal channels")),
        Metric("Interaural Time Difference (ITD)", F.col("time_difference"), "ms", higher=False),
    ]


def channel_levels() -> Column:
    """An array of metrics, two levels for each channel of several; empty for a single one."""

    def one(kind: str, column: str) -> Column:
        none = F.lit(None)
        name = lambda i: F.concat(F.lit("Channel "), (i + 1).cast("string"), F.lit(f" {kind} Level"))
        several = F.when(F.size(column) > 1, F.col(column)).otherwise(F.array().cast("array<double>"))
        return F.transform(several, lambda v, i: F.struct(F.lit("basic").alias("grp"), name(i).alias("name"), decibels(v).alias("value"), F.lit("dBFS").alias("unit"), none.cast("boolean").alias("higher_is_better"), none.cast("double").alias("ref_lo"), none.cast("double").alias("ref_hi"), none.cast("string").alias("warning")))

    return F.filter(F.concat(one("RMS", "channel_rms"), one("Peak", "channel_peak")).cast(f"array<{METRIC}>"), lambda m: m["value"].isNotNull())


def above_gates(blocks: Column, relative: float) -> Column:
    """Loudness of the blocks above -70 LUFS and, of these, above their mean less a relative gate."""
    loud = F.filter(blocks, lambda z: (z > 0) & (lufs(z) > -70.0))
    return bound(loud, lambda a: bound(lufs(mean(a)) + relative, lambda gate: F.filter(F.transform(a, lufs), lambda v: v > gate)))


def loudness() -> list[Metric]:
    level = F.col("gated_level")
    wide = above_gates(F.col("blocks_3000"), -20.0)
    spread = bound(wide, lambda v: F.when(F.size(v) >= 2, percentile(v, 0.95) - percentile(v, 0.1)))
    peak = decibels(F.col("true_peak"))
    beyond = lambda platform, tolerance: lambda d: F.when(F.abs(d) > tolerance, F.concat(F.format_string("%.1f", F.abs(d)), F.lit(" LU "), F.when(d > 0, "above").otherwise("below"), F.lit(f" {platform} target")))
    deltas = [Metric(f"Loudness Delta vs {platform}", F.round(level - target, 2), "LU", bounds=(-tolerance, tolerance), warning=beyond(platform, tolerance)) for platform, target, tolerance in voice.LOUDNESS_TARGETS]
    return [
        Metric("Integrated Loudness (LUFS)", level, "LUFS", bounds=(-16.0, -14.0), warning=lambda v: F.when(v > -14, "Above streaming targets").when(v < -18, "Below streaming targets")),
        Metric("Loudness Range (LRA)", spread, "LU", bounds=(5.0, 15.0)),
        Metric("Max Short-Term Loudness", lufs(F.array_max("blocks_3000")), "LUFS"),
        Metric("True Peak", peak, "dBTP", higher=False, warning=lambda v: F.when(v > -1, "True peak above -1 dBTP")),
        *deltas,
    ]


def spectral() -> list[Metric]:
    bands = [("Sub-Bass (20–80 Hz)", 20, 80), ("Bass (80–300 Hz)", 80, 300), ("Low-Mid (300–2000 Hz)", 300, 2000), ("Presence (2–6 kHz)", 2000, 6000), ("Air (6–20 kHz)", 6000, 20000)]
    return [
        Metric("Spectral Centroid", mean(F.col("centroid")), "Hz"),
        Metric("Spectral Bandwidth", mean(F.col("spread")), "Hz"),
        Metric("Spectral Rolloff (95%)", mean(F.col("rolloff")), "Hz"),
        Metric("Spectral Flatness", power_db(mean(F.col("flat"))), "dB"),
        Metric("Spectral Flux", F.coalesce(mean(F.col("flux")), F.lit(0.0))),
        Metric("Spectral Skewness", mean(F.col("skewness"))),
        Metric("Spectral Entropy", mean(F.col("entropy")), "bits"),
        Metric("Effective Bandwidth", F.col("span"), "Hz"),
        Metric("Estimated Fundamental (F0)", F.col("middle_f0"), "Hz"),
        *(Metric(f"Band Energy: {name}", 100 * bin_sum(F.col("share_2048"), F.col("size_2048"), low, high), "%") for name, low, high in bands),
        Metric("High-Frequency Content (HFC)", mean(F.col("content"))),
    ]


def pauses(active: Column, hop: Column) -> Column:
    """struct<n, total, longest> of the inactive runs of over 100 ms that an active frame ends."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("longest"))

    def step(s: Column, a: Column) -> Column:
        seconds = s["run"] * hop
        long = a & (seconds > 0.1)
        return F.struct(F.when(a, 0).otherwise(s["run"] + 1).alias("run"), (s["n"] + long.cast("int")).alias("n"), (s["total"] + F.when(long, seconds).otherwise(0.0)).alias("total"), F.when(long, F.greatest(s["longest"], seconds)).otherwise(s["longest"]).alias("longest"))

    return F.aggregate(active, start, step)


def temporal() -> list[Metric]:
    any_frame = F.size("energy") > 0
    hop = F.floor(F.col("sample_rate") * 0.01) / F.col("sample_rate")
    active, rest = F.col("active"), F.col("rests")
    attack = bound(F.array_max("energy"), lambda p: F.array_position(F.transform("energy", lambda e: e >= 0.9 * p), True) - 1)
    variance = lambda x: bound(centred(x), lambda c: F.try_divide(dot(c, c), F.size(c).cast("double")))
    centre = F.coalesce(F.try_divide(total(F.transform("energy", lambda e, i: e * i * hop)), total(F.col("energy"))), F.lit(0.0))
    only = lambda c: F.when(any_frame, c)
    return [
        Metric("Speech/Activity Ratio", only(100 * share_of(active)), "%", bounds=(30.0, 80.0)),
        Metric("Attack Time", only(1000 * attack * hop), "ms"),
        Metric("Temporal Centroid", only(centre), "s"),
        Metric("Num Pauses (>100ms)", only(rest["n"])),
        Metric("Mean Pause Duration", only(F.coalesce(F.try_divide(rest["total"], rest["n"].cast("double")), F.lit(0.0))), "s"),
        Metric("Max Pause Duration", only(rest["longest"]), "s"),
        Metric("Energy Variance", only(variance(F.col("frame_level"))), "dB²"),
        Metric("ZCR Mean", only(mean(F.col("crossings"))), "crossings/sample"),
        Metric("ZCR Variance", only(variance(F.col("crossings")))),
    ]


def noise() -> list[Metric]:
    any_frame = F.size("energy") > 0
    only = lambda c: F.when(any_frame, c)
    floor, signal = F.col("floor_energy"), F.col("loud_energy")
    snr = F.when(signal > 0, ratio_db(signal, floor))
    hnr = percentile(F.transform("periodic", lambda r: 10 * F.log10(r / (1 - r))), 0.5)
    return [
        Metric("Estimated Noise Floor", power_db(floor), "dBFS", higher=False),
        Metric("Estimated SNR", snr, "dB", higher=True, bounds=(20.0, 40.0), warning=lambda v: F.when(v < 15, "Low SNR")),
        Metric("Spectral SNR", only(F.col("spectral_snr")), "dB", higher=True),
        Metric("Harmonic-to-Noise Ratio (HNR)", only(hnr), "dB", higher=True, bounds=(15.0, 30.0), warning=lambda v: F.when(v < 10, "Noisy voice")),
        Metric("Near-Clipped Samples", only(F.col("near_clipped")), "samples", higher=False, warning=lambda v: F.when(v > 5, "Clipping")),
        Metric("Detected Dropouts", only(F.col("dropouts")), higher=False, warning=lambda v: F.when(v > 0, "Dropouts")),
    ]


def voiced_share() -> Column:
    """Of the frames with energy, those with few sign changes."""
    pairs = F.filter(F.arrays_zip(F.col("energy").alias("e"), F.col("crossings").alias("z")), lambda p: p["e"] > 1e-4)
    return bound(pairs, lambda loud: F.when(F.size(loud) > 0, share_of(F.transform(loud, lambda p: p["z"] < 0.15))))


def band_snr() -> Column:
    """Mean power within 300 to 3400 Hz against that outside, in dB."""
    step = F.col("sample_rate") / 512
    inside = lambda i: (i * step >= 300) & (i * step <= 3400)
    own, other = F.filter("power_512", lambda _, i: inside(i)), F.filter("power_512", lambda _, i: ~inside(i))
    return power_db(F.try_divide(mean(own), mean(other)))


def speech() -> list[Metric]:
    level = voice.active_level_of(F.col("energy_30"), 20)
    regions = [("F1-Region Energy (300–1000 Hz)", 300, 1000), ("F2-Region Energy (1–2.5 kHz)", 1000, 2500), ("F3-Region Energy (2.5–3.5 kHz)", 2500, 3500)]
    return [
        *(Metric(f"MFCC-{i + 1} {kind}", F.get(f"mfcc_{kind.lower()}", F.lit(i))) for kind in ("Mean", "Std") for i in range(13)),
        *(Metric(name, 100 * bin_sum(F.col("share_1024"), 1024, low, high), "%") for name, low, high in regions),
        Metric("Voiced/Unvoiced Ratio", voiced_share()),
        Metric("Estimated Speaking Rate", F.col("speaking_rate"), "syllables/s"),
        Metric("Active Speech Level (ASL)", level, "dBFS", warning=lambda v: F.when(v < -30, "Quiet speech").when(v > -14, "Loud speech")),
        Metric("Speech-Band SNR (300 Hz – 3.4 kHz)", band_snr(), "dB", higher=True, bounds=(15.0, 35.0)),
    ]


def noise_to_harmonics(f0: Column) -> Column:
    """Power outside the bins around the first nineteen harmonics of a pitch against that inside."""

    def own(power: Column) -> Column:
        step = F.col("sample_rate") / 1024
        count = F.least(F.floor(F.col("sample_rate") / 2 / f0), F.lit(19)).cast("int")
        inside = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda h: bound(F.rint(h * f0 / step), lambda c: F.when(h <= count, around(power, c - 2, c + 2)).otherwise(0.0)))
        every = total(power) + 1e-14
        return bound(F.least(total(inside), every), lambda kept: (every - kept) / (kept + 1e-14))

    return bound(F.col("power_1024"), own)


def prosody() -> list[Metric]:
    f0, average, spread = F.col("voiced_f0"), F.col("f0_mean"), F.col("f0_std")
    enough = F.size(f0) >= 4
    only = lambda c: F.when(enough, c)
    hop = F.floor(F.col("sample_rate") * 0.01) / F.col("sample_rate")
    times = F.filter(F.transform("f0", lambda f, i: F.when(f > 0, i * hop)), lambda t: t.isNotNull())
    j, s = voice.jitter(F.col("f0")), voice.shimmer(F.col("levels"))
    out = [
        Metric("Voiced Frame Ratio", F.coalesce(rounded(100 * F.try_divide(F.size(f0).cast("double"), F.size("f0").cast("double")), 2), F.lit(0.0)), "%"),
        Metric("F0 Mean", only(rounded(average, 2)), "Hz"),
        Metric("F0 Std", only(rounded(spread, 2)), "Hz"),
        Metric("F0 Min", only(rounded(F.array_min(f0), 2)), "Hz"),
        Metric("F0 Max", only(rounded(F.array_max(f0), 2)), "Hz"),
        Metric("F0 Range", only(rounded(F.array_max(f0) - F.array_min(f0), 2)), "Hz"),
        Metric("Pitch Variability (CV)", only(rounded(100 * spread / average, 2)), "%", bounds=(10.0, 40.0)),
        Metric("F0 Slope", only(rounded(slope(times, f0), 3)), "Hz/s"),
    ]
    for label, key, values, limit in [("Jitter (Local)", "local", j, 1.0), ("Jitter (RAP)", "rap", j, 0.68), ("Jitter (PPQ5)", "ppq5", j, 0.84), ("Jitter (DDP)", "ddp", j, 2.0), ("Shimmer (Local)", "local", s, 3.0), ("Shimmer (APQ3)", "apq3", s, 3.07), ("Shimmer (APQ5)", "apq5", s, 4.23), ("Shimmer (DDA)", "dda", s, 9.0)]:
        value = only(100 * values[key])
        out.append(Metric(label, rounded(value, 4), "%", higher=False, bounds=(0.0, limit), warning=(lambda v, limit=limit: F.when(v > limit, f"Above {limit:g} %")) if key == "local" else None))
    nhr = only(noise_to_harmonics(average))
    rate = F.when(F.size(f0) >= 20, F.col("tremor_rate"))
    return [
        *out,
        Metric("NHR (Noise-to-Harmonics Ratio)", rounded(nhr, 6), higher=False, bounds=(0.0, 0.19), warning=lambda v: F.when(v > 0.19, "Noisy voice")),
        Metric("Tremor Rate", rounded(rate, 2), "Hz", warning=lambda v: F.when(v.between(4.0, 7.0), "Tremor")),
        Metric("Tremor Depth", rounded(F.when(rate.isNotNull(), F.col("tremor_depth")), 4), "Hz²"),
        Metric("Estimated Speech Rate", rounded(F.col("speech_rate"), 2), "syll/s", bounds=(3.0, 7.0)),
    ]


def top_partials(spectrum: Column, size: int, count: int) -> Column:
    """The `count` largest maxima of a spectrum as array<struct<amp, hz>>, quietest first, amplitudes as shares of the largest."""

    def own(y: Column) -> Column:
        most = F.array_max(y)
        at = F.filter(F.sequence(F.lit(1), F.size(y) - 2), lambda i: (F.get(y, i) > F.get(y, i - 1)) & (F.get(y, i) > F.get(y, i + 1)) & (F.get(y, i) >= most * 0.015))
        found = F.array_sort(F.transform(at, lambda i: F.struct((F.get(y, i) / (most + 1e-14)).alias("amp"), (i * F.col("sample_rate") / size).alias("hz"))))
        return F.when(most < 1e-12, F.array().cast("array<struct<amp:double,hz:double>>")).otherwise(F.slice(found, F.greatest(F.size(found) - count + 1, F.lit(1)), F.lit(count)))

    return bound(spectrum, own)


def pair_sum(partials: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Sum over all pairs of partials, the quieter one first; 0 for fewer than two."""

    def own(p: Column) -> Column:
        inner = lambda a, i: total(F.transform(F.slice(p, i + 2, F.size(p)), lambda b: f(a, b)))
        return F.when(F.size(p) < 2, 0.0).otherwise(total(F.transform(p, inner)))

    return F.when(partials.isNotNull(), bound(partials, own))


def sharpness() -> Column:
    """Centre of gravity of the levels of half-Bark bands, weighted above 16 Bark."""

    def own(power: Column) -> Column:
        step = F.col("sample_rate") / 4096
        bins = F.filter(F.transform(power, lambda p, i: F.struct(F.floor(voice.bark(i * step) * 2).alias("band"), p.alias("power"), i.alias("i"))), lambda b: (b["i"] > 0) & b["band"].between(0, 47))

        def level(bins: Column, band: Column) -> Column:
            inside = F.transform(F.filter(bins, lambda v: v["band"] == band), lambda v: v["power"])
            return F.coalesce(F.sqrt(mean(inside)), F.lit(0.0))

        levels = bound(bins, lambda held: F.transform(F.sequence(F.lit(0), F.lit(47)), lambda b: F.struct(level(held, b).alias("n"), ((b + 0.5) / 2).alias("z"))))
        weight = lambda z: F.when(z <= 16.0, 1.0).otherwise(0.066 * F.exp(0.171 * z))
        return bound(levels, lambda l: 0.11 * total(F.transform(l, lambda v: v["n"] * weight(v["z"]) * v["z"])) / (total(F.transform(l, lambda v: v["n"])) + 1e-14))

    return F.when(F.col("power_4096").isNotNull(), bound(F.col("power_4096"), own))


def cepstral_pitch() -> Column:
    """The rate over the first largest place of the cepstrum from a six-hundredth of a second on; null outside 50 to 700 Hz."""
    first = F.greatest(F.lit(1), F.floor(F.col("sample_rate") / 600)).cast("int")
    part = F.slice("cepstrum", first + 1, F.greatest(F.size("cepstrum") - first, F.lit(0)))
    place = bound(part, lambda c: F.array_position(c, F.array_max(c)) - 1 + first)
    return bound(F.col("sample_rate") / place, lambda hz: F.when(hz.between(50, 700), hz))


def harmonicity(f0: Column) -> Column:
    """Share of the power (without the constant) within 3 %, three bins at least, of the first nineteen harmonics."""

    def own(power: Column) -> Column:
        step = F.col("sample_rate") / 4096

        def near(k: Column) -> Column:
            hz = k * f0
            reach = F.greatest(step * 3, hz * 0.03)
            return F.when(hz <= F.col("sample_rate") / 2, around(power, F.ceil((hz - reach) / step), F.least(F.floor((hz + reach) / step), F.lit(2048)))).otherwise(0.0)

        every = total(F.slice(power, F.lit(2), F.lit(2048)))
        return F.when(every >= 1e-14, F.least(F.lit(1.0), total(F.transform(F.sequence(F.lit(1), F.lit(19)), near)) / every))

    return bound(F.transform("mag_4096", lambda v: v * v), own)


def psychoacoustic() -> list[Metric]:
    partials = F.col("top_partials")
    rough = pair_sum(partials, lambda a, b: voice.roughness(a["hz"], b["hz"], a["amp"], b["amp"]))
    clash = pair_sum(F.slice(partials, F.greatest(F.size(partials) - 29, F.lit(1)), F.lit(30)), lambda a, b: voice.dissonance(F.least(a["hz"], b["hz"]), F.greatest(a["hz"], b["hz"]), a["amp"], b["amp"]))
    flat, f0 = F.col("mean_flatness"), F.col("cepstral_f0")
    return [
        Metric("Roughness", rounded(rough, 4), "asper (rel.)", higher=False),
        Metric("Sensory Dissonance", rounded(F.greatest(clash, F.lit(0.0)), 4), "(rel.)", higher=False),
        Metric("Sharpness", rounded(sharpness(), 4), "acum"),
        Metric("Spectral Flatness (SFM)", rounded(flat, 4), "0–1"),
        Metric("Tonality", rounded(F.greatest(F.lit(0.0), 1 - flat), 4), "0–1"),
        Metric("F0 (cepstral estimate)", rounded(f0, 2), "Hz"),
        Metric("Harmonicity", rounded(F.when(f0.isNotNull(), harmonicity(f0)), 4), "0–1", higher=True),
    ]


def ratio_db(signal: Column, noise: Column) -> Column:
    """Of two powers, 100 dB at most; 0 for a silent signal."""
    return F.when(signal <= 0, 0.0).when(noise <= 0, 100.0).when(signal.isNotNull() & noise.isNotNull(), F.least(F.lit(100.0), 10 * F.log10(signal / noise)))


def spectral_flatness(power: Column) -> Column:
    """The geometric as a share of the arithmetic mean of a spectrum."""
    return F.exp(mean(F.transform(power, lambda p: F.log(p + EPS64)))) / (mean(power) + EPS64)


def log_slope(power: Column, size: int, low: float, high: Column) -> Column:
    """Slope of log power over log frequency between two frequencies; null for five bins or fewer."""
    rate = F.lit(16000)
    at = F.filter(F.transform(power, lambda p, i: F.struct((i * rate / size).alias("hz"), p.alias("p"))), lambda b: (b["hz"] > low) & (b["hz"] < high))
    return bound(at, lambda b: F.when(F.size(b) > 5, slope(F.transform(b, lambda v: F.log10(v["hz"])), F.transform(b, lambda v: F.log10(v["p"] + EPS64)))))


def signal_score() -> Column:
    """An opinion of the signal from loud against quiet frames and from a slope like that of speech."""
    snr = ratio_db(percentile(F.col("level_16k"), 0.9), percentile(F.col("level_16k"), 0.1))
    tilted = F.coalesce(clip(1 - F.abs(log_slope(F.col("power_16k"), 512, 100.0, F.lit(6400.0)) + 1.2) / 2.5, 0.0, 1.0), F.lit(0.5))
    return clip(1.5 + snr / 12 * 2.5 + tilted * 0.5, 1.0, 5.0)


def background_score() -> Column:
    return clip(4.5 - spectral_flatness(F.col("power_16k")) * 10 - F.col("variation_16k") * 5, 1.0, 5.0)


def plain_opinion() -> Column:
    """An opinion from loud against quiet frames, less for a flat spectrum."""
    snr = ratio_db(percentile(F.col("level_512"), 0.85), percentile(F.col("level_512"), 0.15))
    flat = bound(spectral_flatness(F.col("power_512")), lambda f: F.greatest(F.lit(0.0), (F.when(f > 0, 10 * F.log10(f)) + 10) / 20))
    return F.when(F.col("power_512").isNotNull(), clip(clip(1 + snr / 10, 1.0, 4.5) - flat * 0.5, 1.0, 5.0))


def narrowband_opinion() -> dict[str, Column]:
    """Which frames are active, and an opinion of seven cues of a telephone band, weighted (fixed values): balance, activity, flatness, rumble, hiss, jumps, full scale."""

    def share(low: float, high: float) -> Column:
        inside = F.filter("power_8k", lambda _, i: (i * 31.25 >= low) & (i * 31.25 <= high))
        return total(inside) / (total(F.col("power_8k")) + EPS64)

    quiet = percentile(F.col("energy_8k"), 0.2)
    active = bound(quiet, lambda q: F.transform("energy_8k", lambda e: e > q))
    flat = mean(F.filter(F.zip_with("flatness_8k", F.col("active_8k"), lambda f, a: F.when(a, f)), lambda f: f.isNotNull()))
    return {
        "active_8k": active,
        "opinion_8k": F.when(
            F.exists("active_8k", lambda a: a),
            clip(
                1.0 + 2.4 * clip((share(80.0, 3400.0) - 0.35) / 0.45, 0.0, 1.0) + 0.8 * clip(1 - F.greatest(F.lit(0.0), (1 - share_of(F.col("active_8k"))) - 0.15) / 0.55, 0.0, 1.0) - 0.9 * clip(F.greatest(F.lit(0.0), flat - 0.22) / 0.38, 0.0, 1.0)
                - 0.6 * clip(F.greatest(F.lit(0.0), share(0.0, 79.999) - 0.08) / 0.22, 0.0, 1.0) - 0.8 * clip(F.greatest(F.lit(0.0), share(3400.001, 4000.0) - 0.10) / 0.25, 0.0, 1.0) - 0.8 * clip(F.col("jumps") / 12, 0.0, 1.0) - 1.1 * clip(F.col("full_scale") * 30, 0.0, 1.0),
                1.0,
                4.5,
            ),
        ),
    }


def cutoff() -> Column:
    """The highest frequency whose mean power is within 45 dB of the strongest."""
    return bound(F.col("mean_db_1024"), lambda d: bound(F.array_max(d), lambda top: F.array_max(F.filter(F.transform(d, lambda v, i: F.when(v >= top - 45, i * F.col("sample_rate") / 1024)), lambda hz: hz.isNotNull()))))


def holes() -> Column:
    """Share in % of bins from 1 to 8 kHz that lie over 12 dB below the mean of the nine around them."""

    def own(d: Column) -> Column:
        around_nine = lambda i: total(F.slice(d, F.greatest(i - 4, F.lit(0)) + 1, F.least(i, F.lit(4)) + 5)) / 9
        inside = F.filter(F.transform(d, lambda v, i: F.when((i * F.col("sample_rate") / 1024).between(1000.0, 8000.0), around_nine(i) - v > 12)), lambda f: f.isNotNull())
        return F.coalesce(100 * share_of(inside), F.lit(0.0))

    return F.when(F.col("mean_db_1024").isNotNull(), bound(F.col("mean_db_1024"), own))


def pre_echo() -> Column:
    """Mean energy before against after the steepest tenth of rises; 0 for fewer than six frames."""

    def own(e: Column) -> Column:
        rises = F.zip_with(F.slice(e, F.lit(2), F.size(e)), F.slice(e, F.lit(1), F.size(e) - 1), lambda b, a: b - a)
        onset = bound(rises, lambda d: bound(percentile(d, 0.9), lambda p: F.filter(F.transform(d, lambda v, i: F.when(v > p, i + 1)), lambda i: i.isNotNull())))
        before = lambda i: mean(F.slice(e, F.greatest(i - 2, F.lit(0)) + 1, F.least(i, F.lit(2))))
        after = lambda i: mean(F.slice(e, i + 1, F.lit(2)))
        ratios = F.filter(F.transform(onset, lambda i: F.when(after(i) > 0, before(i) / (after(i) + EPS64))), lambda r: r.isNotNull())
        return F.when(F.size(e) < 6, 0.0).otherwise(F.coalesce(clip(mean(ratios), 0.0, 1.0), F.lit(0.0)))

    return bound(F.col("energy_1024"), own)


def perceptual() -> list[Metric]:
    cut, hole, smear = F.col("cutoff"), F.col("holes"), F.col("pre_echo")
    expected = F.least(F.col("sample_rate") / 2, F.lit(16000.0))
    risk = clip(100 * (0.45 * clip((expected - cut) / F.greatest(expected, F.lit(1.0)), 0.0, 1.0) + 0.35 * hole / 100 + 0.20 * smear), 0.0, 100.0)
    sig, bak, mos, narrow = F.col("signal_score"), F.col("background_score"), F.col("plain_opinion"), F.col("opinion_8k")
    blends = voice.blended_mos(F.round(mos, 2), F.round(narrow, 2))
    scale = {"unit": "MOS [1–5]", "higher": True, "bounds": (3.5, 5.0)}
    return [
        Metric("DNSMOS P.835 SIG (proxy)", F.round(sig, 2), **scale),
        Metric("DNSMOS P.835 BAK (proxy)", F.round(bak, 2), **scale),
        Metric("DNSMOS P.835 OVRL (proxy)", F.round(clip(sig * 0.46 + bak * 0.23 + 0.93, 1.0, 5.0), 2), **scale),
        Metric("AECMOS (proxy)", F.round(clip(5 - F.col("echo") * 8, 1.0, 5.0), 2), **scale),
        Metric("Estimated MOS (non-intrusive proxy)", F.round(mos, 2), **scale),
        Metric("UTMOS (proxy)", F.when(mos.isNotNull(), blends["utmos"]), **scale),
        Metric("SHEET MOS (proxy)", F.when(mos.isNotNull(), blends["sheet"]), **scale),
        Metric("Estimated Codec Bandwidth Cutoff", F.round(cut, 1), "Hz", higher=True),
        Metric("Spectral Hole Ratio", F.round(hole, 2), "%", higher=False),
        Metric("Pre-echo Risk", F.when(cut.isNotNull(), F.round(smear, 3)), higher=False),
        Metric("Codec Artifact Risk", F.round(risk, 2), "%", higher=False, warning=lambda v: F.when(v >= 40, "Codec artifacts")),
        Metric("P.563 Proxy (NB Quality Estimate)", F.round(narrow, 2), "MOS [1–4.5]", higher=True, bounds=(3.0, 4.5)),
    ]


def tilt() -> Column:
    """Slope in dB an octave of mean power from 100 Hz on."""
    step = F.col("sample_rate") / 4096
    at = F.filter(F.transform("power_4096", lambda p, i: F.struct((i * step).alias("hz"), p.alias("p"))), lambda b: b["hz"] >= 100)
    return bound(at, lambda b: F.when((F.size(b) >= 4) & (total(F.transform(b, lambda v: v["p"])) >= 1e-14), slope(F.transform(b, lambda v: F.log2(v["hz"] + 1e-14)), F.transform(b, lambda v: 10 * F.log10(v["p"] + 1e-14)))))


def speaker() -> list[Metric]:
    cpp = F.col("mean_prominence")
    breath = voice.breathiness(cpp)
    creak = F.try_divide(F.size(F.filter("slow_f0", lambda f: (f > 0) & (f < 80))).cast("double"), F.size("slow_f0").cast("double"))
    return [
        *(Metric(f"F{k} (Formant Frequency)", rounded(F.when(F.size(f"f{k}") >= 5, percentile(F.col(f"f{k}"), 0.5)), 1), "Hz") for k in range(1, 5)),
        Metric("Spectral Tilt", rounded(tilt(), 2), "dB/oct"),
        Metric("Cepstral Peak Prominence (CPP)", rounded(cpp, 4), "dB", higher=True, bounds=(17.0, 35.0), warning=lambda v: F.when(v < 16, "Breathy or noisy voice")),
        Metric("Breathiness Index", rounded(F.when(cpp.isNotNull(), breath), 4), "0–1", higher=False, warning=lambda v: F.when(v > 0.6, "Breathy voice")),
        Metric("Creakiness (Vocal Fry) Ratio", rounded(100 * creak, 2), "%", higher=False),
    ]


def prepared() -> list[dict[str, Column]]:
    """Values that several metrics share, in the order in which they rest on each other."""
    hop = F.floor(F.col("sample_rate") * 0.01) / F.col("sample_rate")
    voiced = F.filter("f0", lambda f: f > 0)
    spread = lambda f: F.sqrt(F.greatest(F.lit(0.0), mean(F.transform(f, lambda v: (v - F.col("f0_mean")) * (v - F.col("f0_mean"))))))
    beside = lambda share, keep: bound(percentile(F.col("energy"), share), lambda p: mean(F.filter("energy", lambda e: keep(e, p))))
    return [
        {
            "gated_level": gated_lufs(F.col("blocks_400")),
            "frame_level": F.transform("energy", lambda e: F.when(e > 0, 10 * F.log10(e + 2.0**-52)).otherwise(-120.0)),
            "floor_energy": beside(0.1, lambda e, p: e <= p),
            "loud_energy": beside(0.5, lambda e, p: e >= p),
            "voiced_f0": voiced,
            "top_partials": top_partials(F.col("partials"), 2048, 50),
            "mean_flatness": mean(F.col("flatness")),
            "cepstral_f0": F.when(F.col("mag_4096").isNotNull(), cepstral_pitch()),
            "mean_prominence": mean(F.col("prominence")),
            "signal_score": signal_score(),
            "background_score": background_score(),
            "plain_opinion": plain_opinion(),
            "active_8k": narrowband_opinion()["active_8k"],
            "mean_db_1024": F.transform("power_1024", lambda p: 10 * F.log10(p + EPS64)),
            "pre_echo": pre_echo(),
        },
        {"opinion_8k": narrowband_opinion()["opinion_8k"], "cutoff": cutoff(), "holes": holes(), "active_from": F.greatest(percentile(F.col("frame_level"), 0.3), F.lit(-50.0)), "f0_mean": mean(F.col("voiced_f0"))},
        {"active": F.transform("frame_level", lambda v: v > F.col("active_from")), "f0_std": spread(F.col("voiced_f0"))},
        {"rests": pauses(F.col("active"), hop)},
    ]


#: What each shared value rests on.
RESTS_ON = {"gated_level": "blocks_400", "frame_level": "energy", "floor_energy": "energy", "loud_energy": "energy", "voiced_f0": "f0", "top_partials": "partials", "mean_flatness": "flatness", "cepstral_f0": "cepstrum", "mean_prominence": "prominence", "active_from": "frame_level", "f0_mean": "voiced_f0", "active": "active_from", "f0_std": "f0_mean", "rests": "active", "signal_score": "level_16k", "background_score": "power_16k", "plain_opinion": "level_512", "active_8k": "energy_8k", "mean_db_1024": "energy_1024", "pre_echo": "energy_1024", "opinion_8k": "active_8k", "cutoff": "mean_db_1024", "holes": "mean_db_1024"}

#: Groups with the measures that they need.
GROUPS: dict[str, tuple[Callable[[], list[Metric]], tuple[str, ...]]] = {
    "basic": (basic, KERNELS[0][1]),
    "loudness": (loudness, ("blocks_400", "blocks_3000", "true_peak")),
    "spectral": (spectral, (*TRACKS, "flux", "span", "share_2048", "size_2048", "middle_f0")),
    "temporal": (temporal, ("energy", "crossings")),
    "noise": (noise, ("energy", "spectral_snr", "periodic", "near_clipped", "dropouts")),
    "speech": (speech, ("mfcc_mean", "mfcc_std", "share_1024", "energy", "crossings", "speaking_rate", "energy_30", "power_512")),
    "prosody": (prosody, ("f0", "levels", "power_1024", "tremor_rate", "tremor_depth", "speech_rate")),
    "psychoacoustic": (psychoacoustic, ("partials", "power_4096", "flatness", "mag_4096", "cepstrum")),
    "perceptual": (perceptual, ("level_16k", "power_16k", "variation_16k", "echo", "level_512", "power_512", "energy_8k", "flatness_8k", "power_8k", "jumps", "full_scale", "power_1024", "energy_1024")),
    "speaker": (speaker, ("f1", "f2", "f3", "f4", "power_4096", "prominence", "slow_f0")),
}


def metrics(audio: DataFrame, groups: Iterable[str] = tuple(GROUPS)) -> DataFrame:
    """path, metrics (array) of the chosen groups for audio rows (path, sample_rate, samples by channel)."""
    wanted = list(dict.fromkeys(groups))
    if unknown := set(wanted) - set(GROUPS):
        raise ValueError(f"unknown groups {sorted(unknown)}; choose from {sorted(GROUPS)}")
    m = measured(audio, [c for g in wanted for c in GROUPS[g][1]])
    for step in prepared():
        m = m.withColumns({k: c for k, c in step.items() if RESTS_ON[k] in m.columns})
    own = [(g, k, one) for g in wanted for k, one in enumerate(GROUPS[g][0]())]
    levels = [channel_levels().alias("channel_levels")] if "basic" in wanted else []
    values = m.select("path", *levels, *(one.value.cast("double").alias(f"{g}_{k}") for g, k, one in own))  # columns, as a struct's fields would be written out at each use
    rows = F.array_compact(F.array(*(one.row(g, F.col(f"{g}_{k}")) for g, k, one in own))).cast(f"array<{METRIC}>")
    return values.select("path", (F.concat(rows, "channel_levels") if levels else rows).alias("metrics"))


def metric_facts(audio: DataFrame, groups: Iterable[str] = tuple(GROUPS)) -> DataFrame:
    """A row a metric: path, pos, grp, name, value, unit, higher_is_better, ref_lo, ref_hi, warning."""
    own = metrics(audio, groups).select("path", F.posexplode("metrics").alias("pos", "m"))
    return own.select("path", "pos", "m.*")


# Content -------------------------------------------------------------------------------------------------------------

CONTENT = ("share_512", "plain_f0", "plain_frames", "crossings", "energy", "syllabic_share", "syllabic_depth", "mag_1024", "power_1024", "share_1024", "flux_1024", "mean_square")


def _voiced(crossing: float) -> Column:
    return F.zip_with("energy", "crossings", lambda e, z: (e > 1e-4) & (z < crossing))


def _tone_share() -> Column:
    """Power within three bins of the strongest one."""
    own = lambda p: bound(F.array_position(p, F.array_max(p)) - 1, lambda k: F.try_divide(around(p, k - 3, k + 3), total(p)))
    return F.coalesce(bound(F.col("power_1024"), own), F.lit(0.0))


def _tilt_cue() -> Column:
    step = F.col("sample_rate") / 1024
    at = F.filter(F.transform("mag_1024", lambda v, i: F.struct((i * step).alias("hz"), (v * v).alias("p"))), lambda b: (b["hz"] > 100) & (b["hz"] < F.col("sample_rate") / 2.5))
    fit = lambda b: F.when(F.size(b) >= 5, slope(F.transform(b, lambda v: F.log10(v["hz"] + 1e-10)), F.transform(b, lambda v: F.log10(v["p"] + 1e-10))))
    cue = lambda s: F.when(s.isNull(), 0.5).when(s.between(-3.5, -0.3), clip(1 - F.abs(s + 1.2) / 2, 0.0, 1.0)).otherwise(0.1)
    return bound(bound(at, fit), cue)


def content_cues() -> dict[str, Column]:
    """The seven cues, before a lone tone takes back what speaks for a pitch."""
    pitch = percentile(F.col("plain_f0"), 0.5)
    voiced = F.try_divide(F.size("plain_f0").cast("double"), F.col("plain_frames"))
    music = F.least(bin_sum(F.col("share_1024"), 1024, 0.0, 80.0) / 0.05, F.lit(1.0)) * 0.3 + F.least(bin_sum(F.col("share_1024"), 1024, 6000.0000001, 1e9) / 0.15, F.lit(1.0)) * 0.4 + F.least(F.col("flux_1024") / 0.05, F.lit(1.0)) * 0.3
    return {
        "speech_band_energy": F.coalesce(clip(1 - F.abs(bin_sum(F.col("share_512"), 512, 300.0, 3400.0, closed=True) - 0.72) / 0.4, 0.0, 1.0), F.lit(0.5)),
        "f0_in_speech_range": F.when(pitch.isNull(), 0.0).when(pitch.between(80, 320), clip(2 * voiced, 0.0, 1.0)).when(pitch.between(50, 500), 0.25).otherwise(0.0),
        "zcr_bimodality": voice.crossing_cue_of(F.col("crossings")),
        "syllabic_modulation": F.coalesce(clip((F.col("syllabic_share") - 0.1) / 0.4, 0.0, 1.0) * clip(F.col("syllabic_depth") / 0.15, 0.0, 1.0), F.lit(0.5)),
        "spectral_tilt": _tilt_cue(),
        "voicing_continuity": F.when(F.size("energy") < 5, 0.3).otherwise(clip(longest_run(_voiced(0.12)) * 10 / 300.0, 0.0, 1.0)),
        "not_music": F.when(F.col("share_1024").isNull(), 0.7).otherwise(clip(1 - 0.7 * music, 0.0, 1.0)),
    }


def content(audio: DataFrame, threshold: float = 0.45) -> DataFrame:
    """path, cues, confidence, is_speech, content_type, f0_hz, speech_fraction of audio rows: seven cues vote, unless nearly all is silent."""
    m = measured(audio, CONTENT)
    audible = share_of(F.transform("energy", lambda e: F.sqrt(e) > 0.005))
    silence = F.when(F.sqrt("mean_square") < 0.001, 0.0).otherwise(F.coalesce(clip(2 * audible, 0.0, 1.0), F.lit(0.0)))
    own = m.select("path", silence.alias("silence"), (_tone_share() >= 0.8).alias("tone"), F.struct(*(c.alias(k) for k, c in content_cues().items())).alias("raw"), F.coalesce(share_of(_voiced(0.15)), F.lit(0.0)).alias("fraction"), percentile(F.col("plain_f0"), 0.5).alias("pitch"))
    vetoed = ("f0_in_speech_range", "voicing_continuity")
    cues = {k: F.when(F.col("tone") & F.lit(k in vetoed), 0.0).otherwise(F.col("raw")[k]) for k in voice.CUE_WEIGHTS}
    own = own.withColumn("cues", F.struct(*(c.alias(k) for k, c in cues.items())))
    own = own.withColumn("confidence", F.when(F.col("silence") < 0.1, 0.0).otherwise(voice.confidence({k: F.col("cues")[k] for k in voice.CUE_WEIGHTS})))
    kind = F.when(F.col("silence") < 0.1, "silence").otherwise(voice.content_type(F.col("confidence"), F.col("cues")["not_music"], F.col("silence"), threshold))
    heard = (F.col("silence") >= 0.1) & ~F.col("tone")
    return own.select("path", "cues", "confidence", (F.col("confidence") >= threshold).alias("is_speech"), kind.alias("content_type"), F.when(heard & F.col("pitch").between(80, 320), F.col("pitch")).alias("f0_hz"), F.when(heard, F.col("fraction")).otherwise(0.0).alias("speech_fraction"))
