"""Test signals whose measures are known."""

import numpy as np

RATE = 16_000


def time(seconds, rate=RATE):
    return np.arange(int(round(seconds * rate))) / rate


def sine(hz, seconds, rate=RATE, level=1.0):
    return level * np.sin(2 * np.pi * hz * time(seconds, rate))


def scaled(y, level=0.3):
    return level * y / np.abs(y).max()


def harmonic(hz, seconds, rate=RATE, count=12):
    """Partials of falling strength."""
    return scaled(sum(np.sin(2 * np.pi * k * hz * time(seconds, rate)) / k for k in range(1, count + 1) if k * hz < rate / 2))


def gliding(hz_at):
    """A voice of seven partials whose pitch is given sample by sample."""
    phase = 2 * np.pi * np.cumsum(hz_at) / RATE
    return 0.3 * sum(np.sin(k * phase) / k for k in range(1, 8))


def unsteady(hz, seconds, period=0.0, level=0.0, seed=1):
    """A voice whose cycles vary in length and in level by given standard deviations."""
    rng = np.random.default_rng(seed)
    cycles = int((seconds + 1) * hz * 1.5)
    lengths = (1 + period * rng.standard_normal(cycles)) / hz
    gains = 1 + level * rng.standard_normal(cycles)
    edge = np.concatenate(([0], np.cumsum(lengths)))
    t = time(seconds)
    at = np.searchsorted(edge, t, "right") - 1
    phase = (t - edge[at]) / lengths[at]
    return scaled(gains[at] * sum(np.sin(2 * np.pi * k * phase) / k for k in range(1, 11)))


def white(seconds, std=0.1, seed=0, rate=RATE):
    return std * np.random.default_rng(seed).standard_normal(int(round(seconds * rate)))


def coloured(power, seconds, std=0.1, seed=0):
    """Noise whose power falls with frequency to a power."""
    n = int(seconds * RATE)
    spectrum = np.fft.rfft(np.random.default_rng(seed).standard_normal(n))
    hz = np.fft.rfftfreq(n, 1 / RATE)
    hz[0] = hz[1]
    y = np.fft.irfft(spectrum / hz ** (power / 2), n)
    return std * y / y.std()


def pulsing(hz, rate_hz, seconds):
    """A tone that swells and fades so many times a second."""
    t = time(seconds)
    return 0.15 * (1 - np.cos(2 * np.pi * rate_hz * t)) * np.sin(2 * np.pi * hz * t)


def resonated(source, hz, width):
    """Through one two-pole resonance."""
    r = np.exp(-np.pi * width / RATE)
    a, b = 2 * r * np.cos(2 * np.pi * hz / RATE), -r * r
    out, y1, y2 = [], 0.0, 0.0
    for v in source.tolist():
        y1, y2 = (1 - r) * v + a * y1 + b * y2, y1
        out.append(y1)
    return np.array(out)


def vowel(formants, widths, hz=120.0, seconds=1.0):
    y = np.zeros(int(seconds * RATE))
    y[:: int(round(RATE / hz))] = 1
    for f, w in zip(formants, widths, strict=True):
        y = resonated(y, f, w)
    return scaled(y)


def spoken(seconds=3.0, seed=2):
    """Uneven glottal pulses through three resonances."""
    rng = np.random.default_rng(seed)
    y, at = np.zeros(int(seconds * RATE)), 0.0
    while at < len(y):
        y[int(at)] = 1 + 0.05 * rng.standard_normal()
        at += RATE / 120 * (1 + 0.01 * rng.standard_normal())
    for f, w in zip((700, 1220, 2600), (80, 90, 120), strict=True):
        y = resonated(y, f, w)
    return scaled(y)


def audio(spark, signals, rate=RATE):
    """Audio rows of named signals, one channel each."""
    rows = [(k, rate if not isinstance(v, tuple) else v[1], [np.asarray(v if not isinstance(v, tuple) else v[0], np.float32).tolist()]) for k, v in signals.items()]
    return spark.createDataFrame(rows, "path string, sample_rate int, samples array<array<float>>").repartition(min(8, len(rows)))
