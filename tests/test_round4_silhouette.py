"""Distances of all pairs by matrix products."""

import numpy as np
import pytest

from tribospark.operators import evaluation


def test_plain_distances_do_not_cancel():
    """Equal points are at distance zero and near ones keep their digits, far from the origin and beside others."""
    rng = np.random.default_rng(5)
    a = np.concatenate([rng.normal(size=(90, 6)) + 1e6, rng.normal(size=(40, 6)) * 1e-6 + 1e6, np.full((2, 6), 3.0)])
    got, want = evaluation.plain_distances(a, a[::-1]), np.sqrt(((a[:, None] - a[::-1][None]) ** 2).sum(axis=2))
    assert (got[np.arange(132), 131 - np.arange(132)] == 0).all() and np.allclose(got, want, rtol=1e-9, atol=0)
    a[0, 0] = np.inf
    with np.errstate(invalid="ignore"):
        assert np.isinf(evaluation.plain_distances(a[1:], a)[:, 0]).all()
        assert np.allclose(evaluation.plain_distances(a[1:], a)[:, 1:], want[1:, ::-1][:, 1:], rtol=1e-9, atol=0)


def test_exact_silhouette_takes_matrix_products(spark, monkeypatch):
    """All pairs, in pieces that end anywhere, as from every difference."""
    rng = np.random.default_rng(6)
    label = rng.integers(0, 3, 211)
    x = rng.normal(size=(211, 5)) + label[:, None] * 2
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    mean = np.stack([d[:, label == k].sum(axis=1) / np.maximum((label == k).sum() - (label == k), 1) for k in range(3)], axis=1)
    a, b = mean[np.arange(211), label], np.where(np.arange(3) == label[:, None], np.inf, mean).min(axis=1)
    want = float(((b - a) / np.maximum(a, b)).mean())
    monkeypatch.setattr(evaluation, "PIECE", 16)
    monkeypatch.setattr(evaluation, "REFERENCE_PIECE", 23)
    calls, real = spark.sparkContext.accumulator(0), evaluation.plain_distances
    monkeypatch.setattr(evaluation, "plain_distances", lambda p, q, calls=calls, real=real: (calls.add(len(p) * len(q)), real(p, q))[1])
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(label, x)], "anomaly int, x array<double>")
    assert evaluation.euclidean_silhouette(rows).first()[0] == pytest.approx(want, abs=6e-5)
    assert calls.value == 211 * 211
