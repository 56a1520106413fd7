"""Spectral features of the windows of one chunk; Spark has no Fourier transform of its own."""

from __future__ import annotations

import numpy as np

SPECTRAL = (
    "spectral_energy", "dominant_frequency", "spectral_entropy", "spectral_centroid", "band_energy", "harmonic_ratio",
)
ENTROPY_BINS = 10
TINY = 1e-12
BLOCK = 4_096
POWER_DIGITS = 10


def power_spectrum(windows: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(windows, axis=1)) ** 2


def dominant_bin(power: np.ndarray) -> np.ndarray:
    """Strongest bin above DC; powers equal up to float noise count as ties, won by the lowest bin."""
    body = power[:, 1:]
    scale = np.maximum(power.sum(axis=1, keepdims=True), TINY)
    return np.argmax(np.round(body / scale, POWER_DIGITS), axis=1) + 1.0


def value_entropy(windows: np.ndarray, bins: int = ENTROPY_BINS) -> np.ndarray:
    """Entropy in nats of the equal-width histogram of each window's values."""
    low = windows.min(axis=1)
    width = (windows.max(axis=1) - low) / bins
    above = [(windows >= (low + k * width)[:, None]).sum(axis=1) for k in range(1, bins)]
    edges = np.stack([np.full(len(windows), windows.shape[1]), *above, np.zeros(len(windows), int)], axis=1)
    share = (edges[:, :-1] - edges[:, 1:]) + TINY
    share = share / share.sum(axis=1, keepdims=True)
    return -(share * np.log(share)).sum(axis=1)


def window_features(windows: np.ndarray, wanted: tuple[str, ...] = SPECTRAL) -> dict[str, np.ndarray]:
    out = {}
    if "spectral_entropy" in wanted:
        out["spectral_entropy"] = value_entropy(windows)
    if set(wanted) <= set(out):
        return out
    power = power_spectrum(windows)
    total = power.sum(axis=1)
    bins = np.arange(power.shape[1])
    out["spectral_energy"] = total
    out["dominant_frequency"] = dominant_bin(power)
    out["spectral_centroid"] = power @ bins / np.maximum(total, TINY)
    out["band_energy"] = power[:, : power.shape[1] // 2].sum(axis=1)
    out["harmonic_ratio"] = power[:, ::2].sum(axis=1) / np.maximum(power[:, 1::2].sum(axis=1), TINY)
    return {k: out[k] for k in wanted}


def spectral_features(values: np.ndarray, seq: np.ndarray, size: int, wanted: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Features at every row of one chunk. Rows before the first full window of the series repeat its
    value; a series shorter than a window is all zero."""
    n = len(values)
    out = {k: np.zeros(n) for k in wanted}
    if n < size:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(values, size)
    for start in range(0, len(windows), BLOCK):
        for k, x in window_features(windows[start : start + BLOCK], wanted).items():
            out[k][start + size - 1 : start + size - 1 + len(x)] = x
    if seq[0] == 0:
        for x in out.values():
            x[: size - 1] = x[size - 1]
    return out
