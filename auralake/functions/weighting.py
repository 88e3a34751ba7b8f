"""K-weighting of samples and block energies, as loudness is measured."""

from __future__ import annotations

import numpy as np


def k_weighting(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two biquads of loudness measurement for a rate, from their analogue prototypes (fixed values)."""
    k = np.tan(np.pi * 1681.974450955533 / rate)
    gain, q = 10 ** (3.999843853973347 / 20), 0.7071752369554196
    vb = gain**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([gain + vb * k / q + k * k, 2 * (k * k - gain), gain - vb * k / q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0]))]


def biquads(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Filtering through the sections' response, on a transform long enough for their decay."""
    n = 1 << int(np.ceil(np.log2(2 * len(x) + 1)))
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    h = np.ones(len(z), complex)
    for b, a in sections:
        h *= (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)
    return np.fft.irfft(np.fft.rfft(x, n) * h, n)[: len(x)]


def block_energies(channels: np.ndarray, rate: int, seconds: float, hop: float = 0.1) -> np.ndarray:
    size, step = int(round(seconds * rate)), int(round(hop * rate))
    power = np.concatenate(([0], np.cumsum((channels**2).sum(axis=0))))
    at = np.arange(0, len(power) - size, step)
    return (power[at + size] - power[at]) / size
