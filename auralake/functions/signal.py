"""Array kernels as built-in higher-order functions over `array<double>` columns; no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    return F.try_divide(total(x), F.size(x).cast("double"))


def centred(x: Column) -> Column:
    return bound(x, lambda a: bound(mean(a), lambda m: F.transform(a, lambda v: v - m)))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def rms(x: Column) -> Column:
    return F.sqrt(F.try_divide(dot(x, x), F.size(x).cast("double")))


def db(x: Column) -> Column:
    """20 log10; null for values that aren't positive."""
    return F.when(x > 0, 20 * F.log10(x))


def power_db(x: Column) -> Column:
    return F.when(x > 0, 10 * F.log10(x))


def lufs(energy: Column) -> Column:
    return F.when(energy > 0, -0.691 + 10 * F.log10(energy))


def silence_ratio(x: Column, floor: float = 0.001) -> Column:
    return F.size(F.filter(x, lambda v: F.abs(v) < floor)) / F.size(x).cast("double")


def zero_crossings(x: Column) -> Column:
    """Share of neighbours whose signs differ."""
    n = F.size(x)
    signs = F.transform(x, F.signum)
    pairs = F.zip_with(F.slice(signs, F.lit(1), n - 1), F.slice(signs, F.lit(2), n - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
    return F.when(n > 1, total(pairs) / n.cast("double"))


def frames(x: Column, size: int, hop: int, inclusive: bool = True) -> Column:
    """Frames of `size` samples each `hop`; the last full one only if `inclusive`."""
    last = F.size(x) - size - (0 if inclusive else 1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(x, s + 1, F.lit(size)))


def frame_energy(x: Column, size: int, hop: int) -> Column:
    return F.transform(frames(x, size, hop), lambda f: dot(f, f) / size)


def autocorrelation(x: Column, lag: int) -> Column:
    """Mean-removed, as a share of lag 0."""
    n = F.size(x)
    return bound(centred(x), lambda c: F.try_divide(dot(F.slice(c, F.lit(1), n - lag), F.slice(c, F.lit(lag + 1), n - lag)), dot(c, c)))


def gated_lufs(blocks: Column, absolute: float = -70.0, relative: float = -10.0) -> Column:
    """Integrated loudness of block energies: an absolute gate, then one relative to the mean of what passes."""
    loud = F.filter(blocks, lambda z: (z > 0) & (lufs(z) > absolute))

    def own(a: Column) -> Column:
        return bound(lufs(mean(a)) + relative, lambda gate: bound(F.filter(a, lambda z: lufs(z) > gate), lambda kept: lufs(mean(kept))))

    return bound(loud, own)


def si_sdr(reference: Column, estimate: Column) -> Column:
    """Scale-invariant distortion ratio in dB of mean-removed signals."""

    def own(r: Column, e: Column) -> Column:
        return bound(F.try_divide(dot(r, e), dot(r, r)), lambda k: bound(F.zip_with(e, r, lambda a, b: a - k * b), lambda noise: power_db(F.try_divide(k * k * dot(r, r), dot(noise, noise)))))

    return bound(centred(reference), lambda r: bound(centred(estimate), lambda e: own(r, e)))


def sdr(reference: Column, estimate: Column) -> Column:
    """Distortion ratio in dB, without rescaling."""
    eps = 2.0**-52
    return bound(F.zip_with(estimate, reference, lambda a, b: a - b), lambda noise: 10 * F.log10((dot(reference, reference) + eps) / (dot(noise, noise) + eps)))


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, f):
        run = F.when(f, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(flags, start, step, lambda s: s["best"])


def segment_bounds(samples: Column, rate: Column, seconds: float) -> Column:
    """Index from 1, first sample and end of each segment of `seconds`; the last may be short."""
    size = F.greatest(F.lit(1), F.rint(rate * F.lit(float(seconds))).cast("int"))
    starts = F.when(samples > 0, F.sequence(F.lit(0), samples - 1, size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct((i + 1).alias("index"), s.alias("start"), F.least(s + size, samples).alias("end")))
