"""Window features, their selection and profile, and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import (ACCEL, EVENTS, LINES, P, R, SPECTRAL_SQL, STAT_SQL, USERS, W, event_series, lead_sql,
                             line_features, line_series, moment_sql, r, rounded, spectrum_sql, table)
from checks.ingest import magnetometer
from tribospark.functions.spectral import SPECTRAL
from tribospark.functions.trailing import THERMAL, VIBRATION
from tribospark.operators import features, mapping, selection
from tribospark.operators.detect.common import standardise
from tribospark.operators.mapping import SignalTable, joint_series


def exact(name, column):
    """Spectral energy of two-decimal values has at most five decimals; single precision would cut ties."""
    return F.round(column, 5) if name == "spectral_energy" else r(column)


def exact_sql(name, expression):
    return f"round({expression}, 5)" if name == "spectral_energy" else R(expression)


def of_events(*stats, modality="vibration", **options):
    def run(spark, d):
        names = [f"{modality}_{s}" for s in stats]
        out = features.extract_features(event_series(spark, d, modality), selected=names, **options)
        return out.select("joint_id", "seq", *[exact(s, F.col(n)).alias(s) for n, s in zip(names, stats)])

    return run


def of_lines(stats, signals, **options):
    def run(spark, d):
        names = [f"{a}_{s}" for a in signals for s in stats]
        out = features.extract_features(line_series(spark, d), selected=names, **options)
        return out.select("joint_id", "seq", *[r(n).alias(n) for n in names])

    return run


def stat_sql(*stats):
    return f"WITH {EVENTS} SELECT joint_id, seq, {', '.join(f'{R(STAT_SQL[s])} AS {s}' for s in stats)} FROM s"


def moments_sql(stat, power, least):
    return f"WITH {EVENTS}, {moment_sql('s', power, least)} SELECT joint_id, seq, {R('moment')} AS {stat} FROM mo"


def lines_sql(stats, column, name):
    parts = ", ".join(f"{R(STAT_SQL[s])} AS {name}_{s}" for s in stats)
    return f"WITH {LINES}, g AS (SELECT joint_id, seq, {column} AS v FROM m) SELECT joint_id, seq, {parts} FROM g"


def users_short(spark, d):
    """Users have 49 rows and more: some joints are shorter than a window."""
    rows = joint_series(table(spark, d, "events"), "user_id", "ts", {"vibration": "value"}, ["event_id"])
    out = features.extract_features(SignalTable(rows, {"vibration": "vibration"}),
                                    selected=["vibration_mean", "vibration_dominant_frequency", "vibration_spectral_energy"])
    return out.select("joint_id", "seq", r("vibration_mean").alias("mean"), r("vibration_dominant_frequency").alias("dominant_frequency"),
                      exact("spectral_energy", F.col("vibration_spectral_energy")).alias("spectral_energy"))


def spectral_sql(source, names):
    outer = ", ".join(f"{exact_sql(n, lead_sql(n))} AS {n}" for n in names)
    inner = ", ".join(f"{SPECTRAL_SQL[n]} AS {n}" for n in names)
    return f"WITH {source}, {spectrum_sql('s')}, sp AS (SELECT joint_id, seq, n, {inner} FROM pw) SELECT joint_id, seq, {outer} FROM sp"


_EDGES = ", ".join(f"len(list_filter(w, lambda q: q >= lo + {k} * bw))" for k in range(1, 10))
ENTROPY = f"""WITH {EVENTS}, ls AS (SELECT joint_id, seq, count(*) OVER (PARTITION BY joint_id) AS n, list(v) OVER {W} AS w FROM s),
  ed AS (SELECT *, list_min(w) AS lo, (list_max(w) - list_min(w)) / 10 AS bw FROM ls),
  ge AS (SELECT *, list_concat([len(w)], [{_EDGES}], [0]) AS ge FROM ed),
  en AS (SELECT joint_id, seq, n, list_sum(list_transform(range(1, 11), lambda i: -((ge[i] - ge[i + 1] + 1e-12::DOUBLE) / (50 + 1e-11::DOUBLE))
    * ln((ge[i] - ge[i + 1] + 1e-12::DOUBLE) / (50 + 1e-11::DOUBLE)))) AS h FROM ge)
  SELECT joint_id, seq, {R(lead_sql('h'))} AS spectral_entropy FROM en"""


def windows(spark, d):
    out = features.sliding_windows(event_series(spark, d), "vibration", 50, 7)
    first, last = F.element_at("window", 1), F.element_at("window", -1)
    return out.select("joint_id", "seq", F.size("window").cast("long").alias("n"), r(first).alias("first"), r(last).alias("last"),
                      r(F.aggregate("window", F.lit(0.0), lambda a, x: a + x)).alias("total"))


WINDOWS_SQL = f"""WITH {EVENTS} SELECT joint_id, seq, CAST(50 AS BIGINT) AS n, {R(f'lag(v, 49) OVER {P}')} AS first, {R('v')} AS last,
  {R(f'sum(v) OVER {W}')} AS total FROM s QUALIFY seq >= 49 AND (seq - 49) % 7 = 0"""


def magnitude(spark, d):
    out = features.add_magnitudes(line_series(spark, d))
    return out.rows.select("joint_id", "seq", r("accelerometer_magnitude").alias("magnitude"))


def magnetometer_set(spark, d):
    series = mapping.magnetometer_series(magnetometer(spark, d), ["event_id"])
    out = features.magnetometer_features(series.withColumn("timestamp", F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6))
    return rounded(out.drop("timestamp"), [c for c in out.columns if c not in ("joint_id", "seq", "timestamp")])


_MAG = """s AS (SELECT event_type AS joint_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
  sqrt(value * value + user_id * user_id + CAST(json_extract_string(props, '$.k') AS DOUBLE) * CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events)"""
MAGNETOMETER_SQL = ENTROPY.replace(EVENTS, f"{_MAG}, {spectrum_sql('s')}, sp AS (SELECT joint_id, seq, n, {SPECTRAL_SQL['spectral_energy']} AS spectral_energy, "
                                   f"{SPECTRAL_SQL['dominant_frequency']} AS dominant_frequency FROM pw), sl AS (SELECT joint_id, seq, "
                                   f"{lead_sql('spectral_energy')} AS spectral_energy, {lead_sql('dominant_frequency')} AS dominant_frequency FROM sp), "
                                   f"st AS (SELECT joint_id, seq, v AS mag, {STAT_SQL['mean']} AS mag_mean, {STAT_SQL['std']} AS mag_std, {STAT_SQL['jerk']} AS jerk, "
                                   f"{STAT_SQL['energy']} AS energy FROM s)")
MAGNETOMETER_SQL = MAGNETOMETER_SQL.replace("SELECT joint_id, seq, " + R(lead_sql("h")) + " AS spectral_entropy FROM en",
                                            f", el AS (SELECT joint_id, seq, {lead_sql('h')} AS entropy FROM en) SELECT joint_id, seq, {R('mag')} AS mag, "
                                            f"{R('mag_mean')} AS mag_mean, {R('mag_std')} AS mag_std, {R('mag_std')} AS rolling_std, {R('jerk')} AS jerk, {R('energy')} AS energy, "
                                            f"{R('spectral_energy')} AS spectral_energy, {R('dominant_frequency')} AS dominant_frequency, {R('entropy')} AS entropy "
                                            "FROM st JOIN sl USING (joint_id, seq) JOIN el USING (joint_id, seq)")


def chosen(spark, d):
    picked = selection.FeatureSelection(selected=("accelerometer_x_rms", "accelerometer_magnitude_mean", "no_such"), excluded=("accelerometer_x_rms",))
    out = selection.select_features(line_features(spark, d), picked)
    return out.select("joint_id", "seq", r("accelerometer_magnitude_mean").alias("accelerometer_magnitude_mean"))


def by_variance(spark, d):
    """Names of the features whose variance reaches 5."""
    out = selection.select_features(line_features(spark, d), selection.FeatureSelection(min_variance=5.0))
    names = [c for c in out.columns if c not in selection.META]
    return out.agg(*[F.round(F.var_samp(n), 3).alias(n) for n in names]).unpivot([], names, "feature", "variance")


_LF = f"""f AS (SELECT joint_id, seq, sqrt(avg(x * x) OVER {W}) AS accelerometer_x_rms, sqrt(avg(y * y) OVER {W}) AS accelerometer_y_rms,
  sqrt(avg(z * z) OVER {W}) AS accelerometer_z_rms, sqrt(avg(v * v) OVER {W}) AS accelerometer_magnitude_rms, avg(v) OVER {W} AS accelerometer_magnitude_mean,
  sum(v * v) OVER {W} AS accelerometer_magnitude_energy FROM m)"""
_NAMES = [*[f"{a}_rms" for a in [*ACCEL, "accelerometer_magnitude"]], "accelerometer_magnitude_mean", "accelerometer_magnitude_energy"]
VARIANCE_SQL = f"WITH {LINES}, {_LF}, q AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS feature, round(var_samp({n}), 3) AS variance FROM f' for n in _NAMES)}) SELECT * FROM q WHERE variance >= 5"


def dropped(spark, d):
    out = selection.drop_features(line_features(spark, d), ["accelerometer_x_rms", "accelerometer_y_rms", "joint_id", "missing"])
    return out.select([c for c in out.columns if c not in ("timestamp",)]).groupBy("joint_id").agg(
        *[r(F.avg(c)).alias(c) for c in out.columns if c not in selection.META])


DROPPED_SQL = f"WITH {LINES}, {_LF} SELECT joint_id, {', '.join(f'{R(f'avg({n})')} AS {n}' for n in _NAMES[2:])} FROM f GROUP BY joint_id"


def profile(spark, d):
    """Raw values of three channels as features, so distinct counts are those of the table."""
    rows = line_series(spark, d).rows.withColumnsRenamed({"t": "timestamp", **{a: f"{a}_mean" for a in ACCEL}})
    out = selection.profile_features(rows)
    return rounded(out, ["mean", "std", "min", "max"])


PROFILE_SQL = f"WITH {LINES} " + " UNION ALL ".join(
    f"SELECT 'accelerometer_{a}_mean' AS name, 'double' AS dtype, {R(f'round(avg({a}), 4)')} AS mean, {R(f'round(stddev_samp({a}), 4)')} AS std, "
    f"{R(f'round(min({a}), 4)')} AS min, {R(f'round(max({a}), 4)')} AS max, count(DISTINCT {a}) AS n_unique, "
    f"round(avg(CASE WHEN {a} = 0 THEN 1.0::DOUBLE ELSE 0 END) * 100, 2) AS pct_zero FROM m" for a in "xyz")


def categories(spark, d):
    """Features of every event by category, with the cells each category fills."""
    out = features.extract_features(event_series(spark, d))
    names = [c for c in out.columns if c not in selection.META]
    cells = out.unpivot(["joint_id", "seq"], names, "name", "value").filter(F.col("value").isNotNull())
    counted = selection.category_counts(cells.select("name").distinct())
    filled = cells.groupBy(selection.feature_category(F.col("name")).alias("category")).agg(F.count("*").alias("cells"))
    return counted.join(filled, "category")


CATEGORY_SQL = """SELECT category, n AS features, n * (SELECT count(*) FROM events) AS cells
  FROM (VALUES ('statistical', CAST(11 AS BIGINT)), ('spectral', CAST(4 AS BIGINT)), ('vibration', CAST(4 AS BIGINT))) AS c(category, n)"""


def scaled(spark, d):
    out = standardise(line_features(spark, d), ["accelerometer_x_rms", "accelerometer_magnitude_energy"])
    return out.select("joint_id", "seq", F.round(F.col("x")[0], 6).alias("x_rms"), F.round(F.col("x")[1], 6).alias("energy"))


SCALED_SQL = f"""WITH {LINES}, {_LF} SELECT joint_id, seq, round((accelerometer_x_rms - avg(accelerometer_x_rms) OVER j) / stddev_pop(accelerometer_x_rms) OVER j, 6) AS x_rms,
  round((accelerometer_magnitude_energy - avg(accelerometer_magnitude_energy) OVER j) / stddev_pop(accelerometer_magnitude_energy) OVER j, 6) AS energy
  FROM f WINDOW j AS (PARTITION BY joint_id)"""
def together(*queries):
    """Rows of several SQL texts side by side."""
    parts = [f"({q}) p{i}" for i, q in enumerate(queries)]
    return f"SELECT * FROM {parts[0]} " + " ".join(f"JOIN {p} USING (joint_id, seq)" for p in parts[1:])


def spectra(spark, d, step=1):
    """Every ``step``-th window's power in every bin."""
    out = features.power_spectra(event_series(spark, d), "vibration", 50, step)
    return out.select("joint_id", "seq", F.posexplode("power").alias("bin", "power")).select("joint_id", "seq", F.col("bin").cast("long").alias("bin"), F.round("power", 4).alias("power"))


SPECTRA_ALL_SQL = f"""WITH {EVENTS}, {spectrum_sql('s')} SELECT joint_id, seq, generate_subscripts(p, 1) - 1 AS bin, round(unnest(p), 4) AS power FROM pw
  WHERE seq >= 49"""
THERMAL_ACCELERATION_SQL = (f"WITH {EVENTS}, k AS (SELECT *, {STAT_SQL['thermal_rate']} AS a FROM s) "
                            f"SELECT joint_id, seq, {R(f'a - coalesce(lag(a) OVER {P}, a)')} AS thermal_acceleration FROM k")
ALL_STATS = ["mean", "std", "variance", "rms", "peak_to_peak", "jerk", "energy"]

QUERIES = {
    "features_sliding_windows": (windows, WINDOWS_SQL),
    "features_magnitude": (magnitude, f"WITH {LINES} SELECT joint_id, seq, {R('v')} AS magnitude FROM m"),
    **{f"features_{s}": (of_events(s), stat_sql(s)) for s in ("mean", "std", "variance", "rms", "peak_to_peak", "jerk", "energy")},
    "features_skewness": (of_events("skewness"), moments_sql("skewness", 3, 3)),
    "features_kurtosis": (of_events("kurtosis"), moments_sql("kurtosis", 4, 4)),
    "features_statistical_all_axes": (of_lines(ALL_STATS, ["accelerometer_magnitude"]), lines_sql(ALL_STATS, "v", "accelerometer_magnitude")),
    "features_statistical_every_axis": (of_lines(ALL_STATS, [*ACCEL, "accelerometer_magnitude"]),
        together(*[lines_sql(ALL_STATS, c, a) for c, a in zip("xyzv", [*ACCEL, "accelerometer_magnitude"])])),
    "features_statistical_builtin": (of_lines(ALL_STATS, ["accelerometer_y"], engine="builtin"), lines_sql(ALL_STATS, "y", "accelerometer_y")),
    "features_statistical_small_chunks": (of_lines(ALL_STATS, ["accelerometer_x"], chunk_rows=512), lines_sql(ALL_STATS, "x", "accelerometer_x")),
    "features_power_spectrum": (of_events("spectral_energy", "band_energy"), spectral_sql(EVENTS, ["spectral_energy", "band_energy"])),
    **{f"features_{s}": (of_events(s), spectral_sql(EVENTS, [s])) for s in ("spectral_energy", "dominant_frequency", "spectral_centroid", "band_energy", "harmonic_ratio")},
    "features_spectral_entropy": (of_events("spectral_entropy"), ENTROPY),
    "features_spectral_all": (of_events(*SPECTRAL), together(spectral_sql(EVENTS, [s for s in SPECTRAL if s != "spectral_entropy"]), ENTROPY)),
    "features_spectrum_bins": (spectra, SPECTRA_ALL_SQL),
    "features_spectrum_bins_all": (lambda s, d: spectra(s, d, 1), SPECTRA_ALL_SQL),
    "features_statistical_set": (of_events(*ALL_STATS, "skewness", "kurtosis"),
        together(stat_sql(*ALL_STATS), moments_sql("skewness", 3, 3), moments_sql("kurtosis", 4, 4))),
    "features_statistical_set_builtin": (of_events(*ALL_STATS, "skewness", "kurtosis", engine="builtin"),
        together(stat_sql(*ALL_STATS), moments_sql("skewness", 3, 3), moments_sql("kurtosis", 4, 4))),
    "features_leading_edge_short_joints": (users_short, f"WITH {USERS}, {spectrum_sql('s')}, mm AS (SELECT joint_id, seq, {STAT_SQL['mean']} AS mean FROM s), "
        f"sp AS (SELECT joint_id, seq, n, {SPECTRAL_SQL['dominant_frequency']} AS df, {SPECTRAL_SQL['spectral_energy']} AS se FROM pw), "
        f"q AS (SELECT joint_id, seq, {R(lead_sql('df'))} AS dominant_frequency, {exact_sql('spectral_energy', lead_sql('se'))} AS spectral_energy FROM sp) "
        f"SELECT joint_id, seq, {R('mean')} AS mean, dominant_frequency, spectral_energy FROM q JOIN mm USING (joint_id, seq)"),
    **{f"features_{s}": (of_events(s), stat_sql(s)) for s in VIBRATION},
    "features_vibration_all": (of_events(*VIBRATION), stat_sql(*VIBRATION)),
    "features_thermal_drift": (of_events("thermal_drift", modality="temperature"), stat_sql("thermal_drift")),
    "features_thermal_rate": (of_events("thermal_rate", modality="temperature"), stat_sql("thermal_rate")),
    "features_thermal_acceleration": (of_events("thermal_acceleration", modality="temperature"), THERMAL_ACCELERATION_SQL),
    "features_thermal_all": (of_events(*THERMAL, modality="temperature"), together(stat_sql(*THERMAL[:2]), THERMAL_ACCELERATION_SQL)),
    "features_magnetometer_set": (magnetometer_set, MAGNETOMETER_SQL),
    "select_whitelist_blacklist": (chosen, f"WITH {LINES}, {_LF} SELECT joint_id, seq, {R('accelerometer_magnitude_mean')} AS accelerometer_magnitude_mean FROM f"),
    "select_by_variance": (by_variance, VARIANCE_SQL),
    "select_drop": (dropped, DROPPED_SQL),
    "profile_features": (profile, PROFILE_SQL),
    "profile_categories": (categories, CATEGORY_SQL),
    "detect_standardise": (scaled, SCALED_SQL),
}
