"""How the given tables play sensor logs, once in Spark and once in SQL.

Floats are compared after ``r``: nine decimals, then single precision, so that the last bits of sums
taken in another order do not matter.
"""

from __future__ import annotations

from contextvars import Context

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tribospark.operators.detect.common import label_errors, standardise
from tribospark.operators.features import extract_features
from tribospark.operators.mapping import SignalTable, joint_series
from tribospark.session import settled

LINE_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_ORDER = ["l_shipdate", *LINE_TIES]
ACCEL = ["accelerometer_x", "accelerometer_y", "accelerometer_z"]
CONTAMINATION = 0.1
_made: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 9).cast("float").cast("double")


def rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: r(n) for n in names})


def R(expression: str) -> str:
    return f"CAST(CAST(round({expression}, 9) AS FLOAT) AS DOUBLE)"


def once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table several later queries start from, written once per session; what was written on the way to it is dropped."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _made:
        _made[key] = Context().run(settled, make)  # stays, also where it is first asked for on the way to another
    return _made[key]


# --- events: one channel per event type -------------------------------------------------------
def event_series(spark: SparkSession, sf_dir: str, modality: str = "vibration", joint: str | Column | None = "event_type") -> SignalTable:
    rows = joint_series(table(spark, sf_dir, "events"), joint, "ts", {modality: "value"}, ["event_id"])
    return SignalTable(rows, {modality: modality})


EVENTS = """s AS (SELECT event_type AS joint_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq,
  epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type) AS t, value AS v FROM events)"""
USERS = """s AS (SELECT CAST(user_id AS VARCHAR) AS joint_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  value AS v FROM events)"""


# --- lineitem: three axes per flag and status -------------------------------------------------
def line_series(spark: SparkSession, sf_dir: str) -> SignalTable:
    channels = {"accelerometer_x": F.col("l_quantity"), "accelerometer_y": F.col("l_extendedprice") / 1000,
                "accelerometer_z": F.col("l_discount") * 100}
    rows = joint_series(table(spark, sf_dir, "lineitem"), F.concat("l_returnflag", "l_linestatus"), "l_shipdate", channels, LINE_TIES)
    return SignalTable(rows, dict.fromkeys(ACCEL, "accelerometer"))


LINES = f"""l AS (SELECT *, l_returnflag || l_linestatus AS joint_id,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {', '.join(LINE_ORDER)}) - 1 AS seq,
  epoch_us(l_shipdate) / 1e6 - min(epoch_us(l_shipdate) / 1e6) OVER (PARTITION BY l_returnflag, l_linestatus) AS t,
  l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem),
m AS (SELECT joint_id, seq, t, x, y, z, sqrt(x * x + y * y + z * z) AS v, l_linestatus FROM l)"""

W = "(PARTITION BY joint_id ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"
P = "(PARTITION BY joint_id ORDER BY seq)"

STAT_SQL = {
    "mean": f"avg(v) OVER {W}",
    "std": f"coalesce(stddev_samp(v) OVER {W}, 0)",
    "variance": f"coalesce(var_samp(v) OVER {W}, 0)",
    "rms": f"sqrt(avg(v * v) OVER {W})",
    "peak_to_peak": f"max(v) OVER {W} - min(v) OVER {W}",
    "jerk": f"abs(v - coalesce(lag(v) OVER {P}, v))",
    "energy": f"sum(v * v) OVER {W}",
    "crest_factor": f"coalesce(max(abs(v)) OVER {W} / nullif(sqrt(avg(v * v) OVER {W}), 0), 0)",
    "impulse_factor": f"coalesce(max(abs(v)) OVER {W} / nullif(avg(abs(v)) OVER {W}, 0), 0)",
    "clearance_factor": f"coalesce(max(abs(v)) OVER {W} / nullif(pow(avg(sqrt(abs(v))) OVER {W}, 2), 0), 0)",
    "shape_factor": f"coalesce(sqrt(avg(v * v) OVER {W}) / nullif(avg(abs(v)) OVER {W}, 0), 0)",
    "thermal_drift": f"v - avg(v) OVER {W}",
    "thermal_rate": f"v - coalesce(lag(v) OVER {P}, v)",
}


def moment_sql(source: str, power: int, least: int) -> str:
    """Rolling third or fourth moment: each deviation is taken from the mean of its own window."""
    minus = " - 3" if power == 4 else ""
    return f"""mu AS (SELECT *, CASE WHEN count(v) OVER {W} >= {least} THEN avg(v) OVER {W} END AS mu,
    nullif(CASE WHEN min(v) OVER {W} = max(v) OVER {W} THEN 0 ELSE stddev_samp(v) OVER {W} END, 0) AS sigma FROM {source}),
  dv AS (SELECT *, pow(v - mu, {power}) AS d FROM mu),
  mo AS (SELECT *, coalesce(CASE WHEN count(d) OVER {W} >= {least} THEN avg(d) OVER {W} END / pow(sigma, {power}){minus}, 0) AS moment FROM dv)"""


def spectrum_sql(source: str) -> str:
    """Power of each bin as two sliding sums; the window's own phase does not matter."""
    import math

    sums = []
    for k in range(26):
        w = 2 * math.pi * k / 50
        sums.append(f"pow(sum(v * cos({w!r} * (seq % 50))) OVER {W}, 2) + pow(sum(v * sin({w!r} * (seq % 50))) OVER {W}, 2)")
    return f"""pw AS (SELECT joint_id, seq, count(*) OVER (PARTITION BY joint_id) AS n, count(*) OVER {W} AS c,
    [{', '.join(sums)}] AS p FROM {source})"""


SPECTRAL_SQL = {
    "spectral_energy": "list_sum(p)",
    "dominant_frequency": "list_position(list_transform(p[2:], lambda q: round(q / greatest(list_sum(p), 1e-12), 10)), "
                          "list_max(list_transform(p[2:], lambda q: round(q / greatest(list_sum(p), 1e-12), 10))))",
    "spectral_centroid": "list_sum(list_transform(p, lambda q, i: q * (i - 1))) / greatest(list_sum(p), 1e-12)",
    "band_energy": "list_sum(p[1:13])",
    "harmonic_ratio": "list_sum(list_filter(p, lambda q, i: i % 2 = 1)) / greatest(list_sum(list_filter(p, lambda q, i: i % 2 = 0)), 1e-12)",
}

def lead_sql(value: str) -> str:
    """First full window's value for the rows before it; zero for series shorter than a window."""
    return f"CASE WHEN n < 50 THEN 0 WHEN seq < 49 THEN max(CASE WHEN seq = 49 THEN {value} END) OVER (PARTITION BY joint_id) ELSE {value} END"


# --- scored rows: distance of the window energy from its joint's mean, cut at a quantile -------
def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"{a}_rms" for a in [*ACCEL, "accelerometer_magnitude"]] + ["accelerometer_magnitude_mean", "accelerometer_magnitude_energy"]
    return once(spark, sf_dir, "line_features", lambda: extract_features(line_series(spark, sf_dir), selected=names))


def distance_labels(features: DataFrame, column: str) -> DataFrame:
    """The features with the labels of one column's distance from its joint's mean; they travel along and are not joined back."""
    carry = [c for c in features.columns if c not in ("joint_id", "seq")]
    scaled = standardise(features, [column], carry=carry)
    return label_errors(scaled.select("joint_id", "seq", *carry, F.abs(F.col("x")[0]).alias("value")), CONTAMINATION)


def line_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        return distance_labels(line_features(spark, sf_dir), "accelerometer_magnitude_energy")

    return once(spark, sf_dir, "line_scored", make)


SCORED = f"""{LINES},
f AS (SELECT *, sqrt(avg(x * x) OVER {W}) AS rx, sqrt(avg(y * y) OVER {W}) AS ry, sqrt(avg(z * z) OVER {W}) AS rz,
  sqrt(avg(v * v) OVER {W}) AS rv, avg(v) OVER {W} AS mean, sum(v * v) OVER {W} AS energy FROM m),
e AS (SELECT *, abs((energy - avg(energy) OVER (PARTITION BY joint_id)) / stddev_pop(energy) OVER (PARTITION BY joint_id)) AS err FROM f),
sc AS (SELECT e.*, -err AS anomaly_score, CASE WHEN err > cut THEN -1 ELSE 1 END AS anomaly FROM e
  JOIN (SELECT joint_id, quantile_cont(err, 0.9) AS cut FROM e GROUP BY joint_id) q USING (joint_id))"""

# --- part as the materials catalogue -----------------------------------------------------------
def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("material_name"), (F.col("p_size") * 20.0).alias("hardness"),
        ((F.col("p_retailprice") - 899) / 10000).alias("wear_coefficient"), (1 + F.col("p_partkey") % 8).cast("double").alias("density"),
        (0.05 + (F.col("p_partkey") % 10) / 20).alias("friction_coefficient"), (1 + F.col("p_partkey") % 9).alias("cost_factor"),
        F.col("p_partkey").alias("position"))


CATALOGUE = """cat AS (SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS material_name, p_size * 20.0::DOUBLE AS hardness,
  (p_retailprice - 899) / 10000 AS wear_coefficient, CAST(1 + p_partkey % 8 AS DOUBLE) AS density,
  0.05::DOUBLE + (p_partkey % 10) / 20.0::DOUBLE AS friction_coefficient, 1 + p_partkey % 9 AS cost_factor, p_partkey AS position FROM part)"""
