"""Sliding-window features of one bounded chunk of a series, as an Arrow batch function.

A sliding frame in Spark re-evaluates each aggregate for every row of the frame, one row object at a
time; for 50-row windows that costs some hundred times more CPU than the same sums over an Arrow
column. So each chunk is handed over once (8 bytes per row and signal, never a window per row).
``functions.trailing`` holds the same features as built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tribospark.functions.spectral import SPECTRAL, spectral_features
from tribospark.functions.trailing import KURTOSIS_ROWS, SKEW_ROWS

BLOCK = 4_096


def ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    return np.divide(top, bottom, out=np.zeros(len(top)), where=bottom != 0)


def reduce_windows(values: np.ndarray, size: int, pad: float, reduce) -> np.ndarray:
    """``reduce`` over the last ``size`` values at every row; ``pad`` stands in before the start."""
    padded = np.concatenate([np.full(size - 1, pad), values])
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)
    return np.concatenate([reduce(windows[i : i + BLOCK], i) for i in range(0, len(values), BLOCK)])


def trailing_sum(values: np.ndarray, size: int) -> np.ndarray:
    return reduce_windows(values, size, 0.0, lambda w, _: w.sum(axis=1))


def trailing_variance(values: np.ndarray, size: int, mean: np.ndarray, n: np.ndarray) -> np.ndarray:
    def squares(w, start):
        d = w - mean[start : start + len(w), None]
        for i in range(min(len(w), size - 1 - start)):
            d[i, : size - 1 - start - i] = 0.0
        return (d * d).sum(axis=1)

    return reduce_windows(values, size, 0.0, squares) / np.maximum(n - 1, 1)


def trailing_features(v: np.ndarray, seq: np.ndarray, size: int, wanted: set[str]) -> dict[str, np.ndarray]:
    n = np.minimum(np.arange(len(v)) + 1, size).astype(float)
    low = reduce_windows(v, size, np.inf, lambda w, _: w.min(axis=1))
    high = reduce_windows(v, size, -np.inf, lambda w, _: w.max(axis=1))
    peak = np.maximum(np.abs(low), np.abs(high))
    mean = trailing_sum(v, size) / n
    energy = trailing_sum(v * v, size)
    rms = np.sqrt(energy / n)
    step = np.diff(v, prepend=v[:1])
    out = {"mean": mean, "rms": rms, "peak_to_peak": high - low, "jerk": np.abs(step), "energy": energy,
           "thermal_drift": v - mean, "thermal_rate": step, "thermal_acceleration": np.diff(step, prepend=step[:1]),
           "crest_factor": ratio(peak, rms)}
    if wanted & {"std", "variance", "skewness", "kurtosis"}:
        variance = np.where(low == high, 0.0, trailing_variance(v, size, mean, n))
        sigma = np.sqrt(variance)
        out.update(std=sigma, variance=variance)
        for stat, power, least, shift in (("skewness", 3, SKEW_ROWS, 0.0), ("kurtosis", 4, KURTOSIS_ROWS, 3.0)):
            deviations = (v - mean) ** power
            deviations[: least - 1] = 0.0
            count = np.minimum(np.arange(len(v)) - (least - 2), size)
            defined = (count >= least) & (sigma > 0)
            moment = ratio(trailing_sum(deviations, size), np.maximum(count, 1)) - shift * sigma**power
            out[stat] = np.where(defined, ratio(moment, sigma**power), 0.0)
    if wanted & {"impulse_factor", "shape_factor", "clearance_factor"}:
        mean_abs = trailing_sum(np.abs(v), size) / n
        root = trailing_sum(np.sqrt(np.abs(v)), size) / n
        out.update(impulse_factor=ratio(peak, mean_abs), shape_factor=ratio(rms, mean_abs),
                   clearance_factor=ratio(peak, root * root))
    return out


def feature_batch(signals: dict[str, list[str]], size: int, chunk_rows: int, kept: list[str]):
    """Function for ``groupBy(joint, chunk).applyInArrow``: computes the features, drops the halo."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        seq = table["seq"].to_numpy()
        own = seq // chunk_rows == table["chunk"][0].as_py()
        mask = pa.array(own)
        out = {c: table[c].filter(mask) for c in kept}
        for name, wanted in signals.items():
            v = table[name].to_numpy()
            spectral = tuple(s for s in wanted if s in SPECTRAL)
            found = spectral_features(v, seq, size, spectral) if spectral else {}
            if len(spectral) < len(wanted):
                found.update(trailing_features(v, seq, size, set(wanted)))
            out.update({f"{name}_{s}": pa.array(found[s][own]) for s in wanted})
        return pa.table(out)

    return run
