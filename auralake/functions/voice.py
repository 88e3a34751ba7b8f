"""Voice and content measures as column expressions over arrays: perturbation, activity, roughness, content cues and blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signal import bound, centred, dot, frames, longest_run, mean, power_db, rms, total, zero_crossings

#: Loudness targets: platform, LUFS, tolerance (fixed values).
LOUDNESS_TARGETS = [
    ("Spotify", -14.0, 1.0),
    ("Apple Music", -16.0, 1.0),
    ("YouTube", -14.0, 2.0),
    ("Amazon Music", -14.0, 1.0),
    ("Tidal", -14.0, 1.0),
    ("Podcast (AES)", -16.0, 1.0),
    ("EBU R128", -23.0, 1.0),
    ("ATSC A/85", -24.0, 2.0),
]
#: Weights of the content cues (fixed values).
CUE_WEIGHTS = {
    "speech_band_energy": 1.5,
    "f0_in_speech_range": 2.5,
    "zcr_bimodality": 1.5,
    "syllabic_modulation": 1.5,
    "spectral_tilt": 1.0,
    "voicing_continuity": 2.0,
    "not_music": 1.0,
}


def clip(x: Column, low: float, high: float) -> Column:
    """x within its bounds; null stays null, which `greatest` and `least` pass over."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def _share(flags: Column) -> Column:
    return F.try_divide(F.size(F.filter(flags, lambda f: f)).cast("double"), F.size(flags).cast("double"))


def crossing_share(frame: Column) -> Column:
    """Share of neighbours in a frame whose signs differ, of all neighbours."""
    n = F.size(frame).cast("double")
    return zero_crossings(frame) * n / (n - 1)


def voiced_periods(f0: Column) -> Column:
    return F.transform(F.filter(f0, lambda f: f > 0), lambda f: 1.0 / f)


def perturbation(x: Column, width: int, least: int) -> Column:
    """Mean distance of values from the mean of the `width` around them (2: from the one before), as a share of the mean; null for fewer than `least` values."""

    def own(a: Column) -> Column:
        n = F.size(a)
        if width == 2:
            away = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.get(a, i) - F.get(a, i - 1)))
        else:
            half = width // 2
            away = F.transform(F.sequence(F.lit(half), n - 1 - half), lambda i: F.abs(F.get(a, i) - total(F.slice(a, i - half + 1, F.lit(width))) / width))
        return F.when(n >= least, mean(away) / (mean(a) + 1e-14))

    return bound(x, own)


def second_difference(x: Column, least: int = 5) -> Column:
    """Mean absolute second difference as a share of the mean."""

    def own(a: Column) -> Column:
        away = F.transform(F.sequence(F.lit(2), F.size(a) - 1), lambda i: F.abs(F.get(a, i) - 2 * F.get(a, i - 1) + F.get(a, i - 2)))
        return F.when(F.size(a) >= least, mean(away) / (mean(a) + 1e-14))

    return bound(x, own)


def jitter(f0: Column) -> dict[str, Column]:
    """Local, RAP, PPQ5 and DDP jitter of a pitch track, unvoiced frames as 0."""
    p = voiced_periods(f0)
    return {"local": perturbation(p, 2, 4), "rap": perturbation(p, 3, 5), "ppq5": perturbation(p, 5, 7), "ddp": second_difference(p)}


def shimmer(amplitude: Column) -> dict[str, Column]:
    """Local, APQ3, APQ5 and DDA shimmer of amplitudes of voiced frames."""
    return {"local": perturbation(amplitude, 2, 4), "apq3": perturbation(amplitude, 3, 5), "apq5": perturbation(amplitude, 5, 7), "dda": second_difference(amplitude)}


def voiced_ratio(x: Column, size: int, hop: int, energy: float = 1e-4, crossing: float = 0.15) -> Column:
    """Share of frames with few sign changes among those with energy; null without any."""
    loud = F.filter(frames(x, size, hop, inclusive=False), lambda f: dot(f, f) / size > energy)
    return bound(loud, lambda l: F.when(F.size(l) > 0, _share(F.transform(l, lambda f: crossing_share(f) < crossing))))


def active_level_of(energy: Column, hangover: int) -> Column:
    """Level in dB of the frames above the larger of their 30th percentile and -50 dB, and of those within a hangover around them."""

    def own(e: Column) -> Column:
        levels = F.transform(e, power_db)
        gate = F.greatest(percentile(F.array_compact(levels), 0.3), F.lit(-50.0))
        active = bound(gate, lambda g: F.transform(levels, lambda l: F.coalesce(l > g, F.lit(False))))
        back, ahead = hangover // 2, (hangover - 1) // 2

        def level(a: Column) -> Column:
            wide = F.transform(a, lambda _, i: F.exists(F.slice(a, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)) + ahead + 1), lambda v: v))
            kept = F.filter(F.zip_with(e, wide, lambda v, w: F.when(w, v)), lambda v: v.isNotNull())
            return power_db(mean(kept))

        return bound(active, level)

    return bound(energy, own)


def active_level(x: Column, size: int, hop: int, hangover: int) -> Column:
    return active_level_of(F.transform(frames(x, size, hop), lambda f: dot(f, f) / size), hangover)


def percentile(x: Column, share: float) -> Column:
    """Interpolated between neighbours; null of an empty array."""

    def own(s: Column) -> Column:
        at = (F.size(s) - 1) * F.lit(share)
        low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return bound(F.array_sort(x), own)


def slope(x: Column, y: Column) -> Column:
    """Of the least-squares line; null for fewer than two places."""
    return bound(centred(x), lambda c: F.try_divide(dot(c, y), dot(c, c)))


def bark(hz: Column) -> Column:
    return 26.81 * hz / (1960.0 + hz) - 0.53


def critical_bandwidth(hz: Column) -> Column:
    return 25.0 + 75.0 * F.pow(1.0 + 1.4 * F.pow(hz / 1000.0, F.lit(2.0)), F.lit(0.69))


def mel(hz: Column, slaney: bool = False) -> Column:
    """The logarithmic mel scale, or with `slaney` the one that is linear below 1000 Hz."""
    if not slaney:
        return 2595.0 * F.log10(1.0 + hz / 700.0)
    return F.when(hz >= 1000.0, 15.0 + F.log(F.greatest(hz, F.lit(1000.0)) / 1000.0) / (F.log(F.lit(6.4)) / 27.0)).otherwise(hz * 3 / 200.0)


def roughness(low_hz: Column, high_hz: Column, low_amp: Column, high_amp: Column) -> Column:
    """The roughness of a pair of partials, the lower one first; sum over pairs."""
    x = F.abs(high_hz - low_hz) / (critical_bandwidth(low_hz) + 1e-14)
    weight = F.pow(low_amp * high_amp, F.lit(0.1)) * F.pow(2 * low_amp * high_amp / (low_amp * low_amp + high_amp * high_amp + 1e-14), F.lit(3.11))
    return F.when((low_hz > 0) & (x > 0), weight * x * x * F.exp(-F.pow(x / 0.25, F.lit(2.0)))).otherwise(0.0)


def dissonance(low_hz: Column, high_hz: Column, low_amp: Column, high_amp: Column) -> Column:
    s = 0.24 / (0.0207 * low_hz + 18.96)
    d = F.abs(high_hz - low_hz)
    return F.when(low_hz > 0, low_amp * high_amp * (F.exp(-3.5 * s * d) - F.exp(-5.75 * s * d))).otherwise(0.0)


def breathiness(cpp: Column) -> Column:
    """0 from a cepstral peak prominence of 21 dB on, 1 from 13 dB down."""
    return clip((21.0 - cpp) / 8.0, 0.0, 1.0)


def loudness_deltas(lufs: Column) -> Column:
    """array<struct<platform, delta, warning>> against each platform's target; a warning beyond its tolerance."""
    out = []
    for name, target, tolerance in LOUDNESS_TARGETS:
        d = F.round(lufs - target, 2)
        side = F.when(d > 0, "above").otherwise("below")
        out.append(F.struct(F.lit(name).alias("platform"), d.alias("delta"), F.when(F.abs(d) > tolerance, F.concat(F.format_string("%.1f", F.abs(d)), F.lit(" LU "), side, F.lit(f" {name} target"))).alias("warning")))
    return F.array(*out)


def blended_mos(mos: Column, p563: Column) -> dict[str, Column]:
    """Two blends of opinion proxies; missing ones count as 3."""
    m, p = F.coalesce(mos, F.lit(3.0)), F.coalesce(p563, F.lit(3.0)) / 4.5 * 5.0
    return {"utmos": F.round(clip(0.75 * m + 0.25 * p, 1.0, 5.0), 2), "sheet": F.round(clip(0.60 * m + 0.40 * p, 1.0, 5.0), 2)}


def pesq_proxy(distance: Column) -> Column:
    """An opinion score from a log-spectral distance."""
    return F.round(clip(4.5 - distance / 5.0, 1.0, 4.5), 3)


def silence_score(x: Column, size: int, hop: int) -> Column:
    """0 for a nearly silent signal, else twice the share of audible frames, 1 at most."""
    audible = _share(F.transform(frames(x, size, hop, inclusive=False), lambda f: rms(f) > 0.005))
    return F.when(rms(x) < 0.001, 0.0).otherwise(clip(2.0 * audible, 0.0, 1.0))


def crossing_cue_of(crossings: Column) -> Column:
    """Whether frames divide into voiced ones with few sign changes and unvoiced ones with many; a half for fewer than ten frames."""

    def own(z: Column) -> Column:
        voiced, unvoiced = _between(z, 0.01, 0.10), _between(z, 0.15, 0.45)
        return F.when(F.size(z) < 10, 0.5).otherwise(clip(0.6 * F.least(2.0 * voiced, F.lit(1.0)) + 0.4 * F.least(3.0 * unvoiced, F.lit(1.0)), 0.0, 1.0))

    return bound(crossings, own)


def crossing_cue(x: Column, size: int, hop: int) -> Column:
    return crossing_cue_of(F.transform(frames(x, size, hop, inclusive=False), crossing_share))


def _between(z: Column, low: float, high: float) -> Column:
    return _share(F.transform(z, lambda v: (v > low) & (v < high)))


def _voiced(x: Column, size: int, hop: int, crossing: float) -> Column:
    return F.transform(frames(x, size, hop, inclusive=False), lambda f: (dot(f, f) / size > 1e-4) & (crossing_share(f) < crossing))


def continuity_cue(x: Column, size: int, hop: int, hop_ms: float = 10.0) -> Column:
    """The longest run of voiced frames as a share of 300 ms, 1 at most."""
    return clip(longest_run(_voiced(x, size, hop, 0.12)) * hop_ms / 300.0, 0.0, 1.0)


def speech_fraction(x: Column, size: int, hop: int) -> Column:
    return F.coalesce(_share(_voiced(x, size, hop, 0.15)), F.lit(0.0))


def confidence(cues: dict[str, Column]) -> Column:
    """The weighted mean of the seven content cues."""
    return clip(sum(cues[k] * w for k, w in CUE_WEIGHTS.items()) / sum(CUE_WEIGHTS.values()), 0.0, 1.0)


def content_type(confident: Column, not_music: Column, silence: Column, threshold: float = 0.45) -> Column:
    return F.when(confident >= threshold, "speech").when((not_music < 0.4) & (confident < 0.35), "music").when(silence < 0.4, "silence").when(confident < 0.25, "noise").otherwise("mixed")
