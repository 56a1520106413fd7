import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tribospark.functions.batch import trailing_features
from tribospark.functions.spectral import dominant_bin, power_spectrum, spectral_features, value_entropy
from tribospark.operators import features, selection
from tribospark.operators.mapping import SignalTable

W = 10


def rolled(x, size):
    """The features by pandas rolling windows."""
    x = pd.Series(x)
    r = x.rolling(size, min_periods=1)
    rms = np.sqrt((x**2).rolling(size, min_periods=1).mean())
    peak, mean_abs = x.abs().rolling(size, min_periods=1).max(), x.abs().rolling(size, min_periods=1).mean()
    root = np.sqrt(x.abs()).rolling(size, min_periods=1).mean() ** 2
    out = {"mean": r.mean(), "std": r.std(), "variance": r.var(), "rms": rms, "peak_to_peak": r.max() - r.min(), "jerk": x.diff().abs(),
           "energy": (x**2).rolling(size, min_periods=1).sum(), "crest_factor": peak / rms.replace(0, np.nan), "impulse_factor": peak / mean_abs.replace(0, np.nan),
           "clearance_factor": peak / root.replace(0, np.nan), "shape_factor": rms / mean_abs.replace(0, np.nan), "thermal_drift": x - r.mean(),
           "thermal_rate": x.diff(), "thermal_acceleration": x.diff().fillna(0).diff()}
    for name, power, least, minus in (("skewness", 3, 3, 0), ("kurtosis", 4, 4, 3)):
        rr = x.rolling(size, min_periods=least)
        sigma = rr.std().replace(0, np.nan)
        out[name] = ((x - rr.mean()) ** power).rolling(size, min_periods=least).mean() / sigma**power - minus
    return {k: v.fillna(0).to_numpy() for k, v in out.items()}


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for joint, n in (("hot", 300), ("cold", 40), ("short", 7), ("one", 1)):
        x = rng.normal(3, 2, n)
        if joint == "hot":
            x[100:130] = 4.0
        rows += [(joint, i, float(i), float(v), float(rng.normal())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "joint_id string, seq long, t double, accelerometer_x double, accelerometer_y double")
    return SignalTable(df, dict.fromkeys(["accelerometer_x", "accelerometer_y"], "accelerometer")), pd.DataFrame(rows, columns=["j", "seq", "t", "x", "y"])


def frame(df):
    return df.orderBy("joint_id", "seq").toPandas()


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 32}, {"engine": "builtin"}, {"engine": "builtin", "chunk_rows": 20}])
def test_against_pandas(series, options):
    table, raw = series
    got = frame(features.extract_features(table, W, **options))
    raw = raw.assign(m=np.sqrt(raw.x**2 + raw.y**2)).sort_values(["j", "seq"])
    for column, name in (("x", "accelerometer_x"), ("m", "accelerometer_magnitude")):
        parts = [rolled(g[column].to_numpy(), W) for _, g in raw.groupby("j")]
        for stat in parts[0]:
            if f"{name}_{stat}" in got:
                want = np.concatenate([p[stat] for p in parts])
                # pandas keeps noise in the variance of a constant stretch inside a varying series
                steady = np.concatenate([pd.Series(g[column]).rolling(W, min_periods=1).apply(np.ptp).to_numpy() for _, g in raw.groupby("j")]) > 0
                mask = steady if stat in ("skewness", "kurtosis", "std", "variance") else np.full(len(want), True)
                assert np.allclose(got[f"{name}_{stat}"][mask], want[mask], atol=1e-8), (name, stat)
    assert list(got.columns[:3]) == ["joint_id", "seq", "timestamp"] and len(got) == len(raw)
    assert set(got.columns[3:]) == set(features.feature_names(table))


def test_constant_stretch_has_no_moments(series):
    got = frame(features.extract_features(series[0], W))
    flat = got[(got.joint_id == "hot") & (got.seq == 125)].iloc[0]
    assert flat["accelerometer_x_skewness"] == 0 and flat["accelerometer_x_kurtosis"] == 0 and flat["accelerometer_x_std"] == 0


def test_spectra_leading_edge_and_short_joints(series):
    got = frame(features.extract_features(series[0], W, chunk_rows=32))
    hot = got[got.joint_id == "hot"].reset_index(drop=True)
    x = series[1][series[1].j == "hot"].x.to_numpy()
    windows = np.lib.stride_tricks.sliding_window_view(x, W)
    power = np.abs(np.fft.rfft(windows, axis=1)) ** 2
    assert np.allclose(hot["accelerometer_x_spectral_energy"][W - 1 :], power.sum(axis=1))
    assert np.allclose(hot["accelerometer_x_band_energy"][W - 1 :], power[:, : (W // 2 + 1) // 2].sum(axis=1))
    assert (hot["accelerometer_x_spectral_energy"][: W - 1] == hot["accelerometer_x_spectral_energy"][W - 1]).all()
    short = got[got.joint_id.isin(["short", "one"])]
    assert (short[[c for c in got if "spectral" in c or "dominant" in c]] == 0).all(axis=None)
    counts = np.histogram(windows[50], 10)[0] + 1e-12
    assert np.isclose(hot["accelerometer_x_spectral_entropy"][50 + W - 1], -(counts / counts.sum() * np.log(counts / counts.sum())).sum())


def test_energy_and_ratio_closed_forms():
    rng = np.random.default_rng(0)
    for size in (48, 50):
        v = rng.normal(size=(20, size))
        p = power_spectrum(v)
        alternating = (v * (-1.0) ** np.arange(size)).sum(axis=1)
        assert np.allclose(p.sum(axis=1), (size * (v**2).sum(axis=1) + v.sum(axis=1) ** 2 + alternating**2) / 2)


def test_flat_window_ties_go_to_the_first_bin():
    assert dominant_bin(power_spectrum(np.full((1, 50), 0.1)))[0] == 1
    k = np.arange(50)
    assert dominant_bin(power_spectrum(np.sin(2 * np.pi * 7 * k / 50)[None, :]))[0] == 7
    one_bin = np.array([50 + 1e-12] + [1e-12] * 9)
    one_bin /= one_bin.sum()
    assert np.isclose(value_entropy(np.full((1, 50), 3.0))[0], -(one_bin * np.log(one_bin)).sum())


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=12, max_size=60), st.floats(0.5, 20), st.floats(-50, 50))
def test_scale_and_shift(values, scale, shift):
    v, seq = np.array(values), np.arange(len(values))
    wanted = {"std", "impulse_factor"}
    a, b, c = (trailing_features(x, seq, 10, wanted) for x in (v, v * scale, v + shift))
    assert np.allclose(a["std"] * scale, b["std"], atol=1e-6) and np.allclose(a["std"], c["std"], atol=1e-6)
    assert np.allclose(a["rms"] * scale, b["rms"], atol=1e-6) and np.allclose(a["peak_to_peak"], c["peak_to_peak"], atol=1e-9)
    full = spectral_features(v, seq, 10, ("spectral_energy", "band_energy"))
    assert (full["band_energy"] <= full["spectral_energy"] * (1 + 1e-9)).all()


def test_missing_axis_makes_the_magnitude_zero(spark):
    rows = [("a", i, float(i), 3.0 if i else None, 4.0, float("inf") if i == 2 else 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "joint_id string, seq long, t double, gyroscope_x double, gyroscope_y double, strain double")
    table = SignalTable(df, {"gyroscope_x": "gyroscope", "gyroscope_y": "gyroscope", "strain": "strain"})
    got = frame(features.extract_features(table, 4))
    assert got["gyroscope_magnitude_peak_to_peak"].tolist() == [0, 5, 5, 5, 0]
    assert got["strain_jerk"].tolist() == [0, 0, 1, 1, 0]
    assert not any(c.startswith("strain") and "spectral" in c for c in got) and "gyroscope_x_crest_factor" not in got


def test_absent_text_signal_gives_nulls(spark):
    rows = [(j, i, float(i), None if j == "b" else float(i), 1.0) for j in "ab" for i in range(6)]
    df = spark.createDataFrame(rows, "joint_id string, seq long, t double, force_x double, force_y double")
    table = SignalTable(df, {"force_x": "force", "force_y": "force"}, optional=("force_x",))
    got = frame(features.extract_features(table, 4))
    b = got[got.joint_id == "b"]
    assert b["force_x_mean"].isna().all() and b["force_magnitude_mean"].isna().all() and (b["force_y_mean"] == 1).all()
    assert got[got.joint_id == "a"]["force_magnitude_mean"].notna().all()


def test_strict_names_follow_the_last_underscore(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0)], "joint_id string, seq long, t double, temperature_temperature_c double")
    table = SignalTable(df, {"temperature_temperature_c": "temperature"})
    assert any("thermal" in n for n in features.feature_names(table))
    assert not any("thermal" in n for n in features.feature_names(table, strict_names=True))


def test_windows_with_step(series):
    got = features.sliding_windows(series[0], "accelerometer_x", 10, 4, chunk_rows=16).filter("joint_id = 'cold'").orderBy("seq").collect()
    x = series[1][series[1].j == "cold"].x.tolist()
    assert [r["seq"] for r in got] == list(range(9, 40, 4)) and got[3]["window"] == x[12:22]
    with pytest.raises(ValueError):
        features.sliding_windows(series[0], "accelerometer_x", 10, 0)


def test_input_order_does_not_matter(series):
    table = series[0]
    a = frame(features.extract_features(table, W, selected=["accelerometer_x_std", "accelerometer_x_dominant_frequency"]))
    b = frame(features.extract_features(table.with_rows(table.rows.orderBy(F.hash("seq"))), W, selected=["accelerometer_x_std", "accelerometer_x_dominant_frequency"]))
    assert a.equals(b)


def test_selection(series):
    matrix = features.extract_features(series[0], W)
    picked = selection.select_features(matrix, selection.FeatureSelection(("accelerometer_y_rms", "accelerometer_x_rms", "none"), ("accelerometer_x_rms",)))
    assert picked.columns == ["joint_id", "seq", "timestamp", "accelerometer_y_rms"]
    assert selection.selection_counts(matrix, selection.FeatureSelection()) == {"available": 57, "active": 57}
    assert "timestamp" in selection.drop_features(matrix, ["timestamp", "accelerometer_x_rms"]).columns
    steady = matrix.withColumn("still", F.lit(1.0))
    assert "still" not in selection.select_features(steady, selection.FeatureSelection(min_variance=1e-6)).columns
    profile = {r["name"]: r for r in selection.profile_features(steady.select("joint_id", "still", "accelerometer_x_jerk")).collect()}
    assert profile["still"]["n_unique"] == 1 and profile["still"]["pct_zero"] == 0 and profile["accelerometer_x_jerk"]["pct_zero"] > 0
    assert selection.category_counts(selection.profile_features(matrix)).filter("category = 'statistical'").first()["features"] == 33


def test_registered_spectra_of_every_window(spark):
    """One query has the power of all windows, each as by a plain transform."""
    from checks import features as registered
    from checks.fixtures import event_series

    sf = "/root/testdata/sf0.001"
    got = {(r["joint_id"], r["seq"], r["bin"]): r["power"] for r in registered.QUERIES["features_spectrum_bins_all"][0](spark, sf).collect()}
    series = {}
    for r in event_series(spark, sf).rows.orderBy("joint_id", "seq").collect():
        series.setdefault(r["joint_id"], []).append(r["vibration"])
    want = {}
    for joint, values in series.items():
        for seq in range(49, len(values)):
            for bin_, power in enumerate(np.abs(np.fft.rfft(values[seq - 49 : seq + 1])) ** 2):
                want[joint, seq, bin_] = power
    assert set(got) == set(want) and all(abs(got[k] - w) <= 1e-4 + 1e-9 * w for k, w in want.items())


def test_magnetometer_set_shuffles_once(spark):
    """The field strength travels with its row: the features are not joined back to it."""
    rows = [("a", i, float(i), float(i % 5), None if i == 7 else 1.0, 2.0) for i in range(80)]
    series = spark.createDataFrame(rows, "joint_id string, seq long, timestamp double, mx double, my double, mz double")
    out = features.magnetometer_features(series)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    got = {r["seq"]: r["mag"] for r in out.collect()}
    assert len(got) == 80 and got[7] == 0 and got[3] == pytest.approx((9 + 1 + 4) ** 0.5)
