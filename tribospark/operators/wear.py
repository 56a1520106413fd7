"""Wear index per joint from anomaly rate, motion and physical parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tribospark.session import materialise

PARAMETER_SCHEMA = (
    "joint_id string, load_force double, joint_radius double, material string, lubrication_coefficient double, "
    "contact_area double, hardness double, sliding_velocity double"
)
# Generic joint, then load, radius and contact area of the named arm joints.
GENERIC_JOINT = {
    "load_force": 50.0, "joint_radius": 0.04, "material": "Hardened Steel", "lubrication_coefficient": 0.5,
    "contact_area": 1e-4,
}
ARM_PARAMETERS = (
    ("base", 120.0, 0.06, 2.0e-4),
    ("shoulder", 100.0, 0.055, 1.8e-4),
    ("elbow", 70.0, 0.045, 1.2e-4),
    ("wrist_1", 40.0, 0.035, 8.0e-5),
    ("wrist_2", 30.0, 0.030, 6.0e-5),
    ("wrist_3", 20.0, 0.025, 4.0e-5),
)
# Constants of the wear law.
BASE_WEAR_COEFFICIENT = 1e-4
ANOMALY_GAIN = 10.0
DEFAULT_HARDNESS = 600.0
DEFAULT_RATE_HZ = 10.0


def anomaly_rates(scored: DataFrame) -> DataFrame:
    return scored.groupBy("joint_id").agg(
        F.count("anomaly").alias("total_readings"), F.count_if(F.col("anomaly") == -1).alias("anomaly_count"),
    ).withColumn("anomaly_rate", F.col("anomaly_count") / F.col("total_readings"))


def energy_column(df: DataFrame) -> str:
    """Which feature stands for signal energy."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    tests = (
        (df.columns, lambda c: "magnitude_energy" in c),
        (df.columns, lambda c: c.endswith("_energy") and "spectral" not in c and "band" not in c),
        (df.columns, lambda c: c == "energy"),
        (numeric, lambda c: c.endswith("_rms")),
        (numeric, lambda c: c not in ("seq", "timestamp")),
    )
    for columns, test in tests:
        hit = next((c for c in columns if test(c)), None)
        if hit:
            return hit
    return "timestamp"


def mean_energy(features: DataFrame, column: str | None = None) -> DataFrame:
    return features.groupBy("joint_id").agg(F.avg(column or energy_column(features)).alias("signal_energy"))


def default_parameters(joints: DataFrame) -> DataFrame:
    """Physical parameters for each ``joint_id``: named arm joints have their own, others the generic ones."""
    named = joints.sparkSession.createDataFrame(
        list(ARM_PARAMETERS), "joint_id string, load_force double, joint_radius double, contact_area double")
    out = joints.select("joint_id").join(named, "joint_id", "left")
    for name in ("load_force", "joint_radius", "contact_area"):
        out = out.withColumn(name, F.coalesce(name, F.lit(GENERIC_JOINT[name])))
    return out.select(
        "joint_id", "load_force", "joint_radius", F.lit(GENERIC_JOINT["material"]).alias("material"),
        F.lit(GENERIC_JOINT["lubrication_coefficient"]).alias("lubrication_coefficient"), "contact_area",
        F.lit(None).cast("double").alias("hardness"), F.lit(None).cast("double").alias("sliding_velocity"))


def merge_parameters(defaults: DataFrame, user: DataFrame) -> DataFrame:
    """User fields that are not null win; joints known to either side are kept."""
    fields = [c for c in defaults.columns if c != "joint_id"]
    given = user.filter(F.col("joint_id").isNotNull() & (F.col("joint_id") != ""))
    given = given.select("joint_id", *[
        (F.col(c) if c in user.columns else F.lit(None)).cast(defaults.schema[c].dataType).alias(f"_{c}") for c in fields])
    merged = defaults.join(given, "joint_id", "full_outer")
    return merged.select("joint_id", *[
        F.coalesce(f"_{c}", c, F.lit(GENERIC_JOINT.get(c))).cast(defaults.schema[c].dataType).alias(c) for c in fields])


def effective_k(rate: Column, lubrication: Column) -> Column:
    film = F.least(F.greatest(lubrication, F.lit(0.0)), F.lit(1.0))
    return BASE_WEAR_COEFFICIENT * (1 + ANOMALY_GAIN * rate) * (1 - 0.5 * film)


def resolve_hardness(parameters: DataFrame, catalogue: DataFrame | None) -> DataFrame:
    """Fill ``hardness`` from the first catalogue row whose name contains the joint's material."""
    if catalogue is None:
        return parameters.withColumn("hardness", F.coalesce("hardness", F.lit(DEFAULT_HARDNESS)))
    # Looked up once per distinct material, so the substring join has a handful of rows on the left.
    wanted = parameters.select("material").distinct()
    order = "position" if "position" in catalogue.columns else "material_name"
    rows = catalogue.select(F.col(order).alias("_position"), F.col("material_name").alias("_name"), F.col("hardness").alias("_hardness"))
    found = wanted.join(rows, F.contains(F.lower("_name"), F.lower("material"))).groupBy("material").agg(
        F.min_by("_hardness", "_position").alias("_found"))
    return parameters.join(found, "material", "left").withColumn(
        "hardness", F.coalesce("hardness", "_found", F.lit(DEFAULT_HARDNESS)).cast("double")).select(parameters.columns)


def _row_mean(columns: list[str]) -> Column:
    """Mean over the columns that have a value in the row."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.try_divide(total, present)


def motion_summary(features: DataFrame) -> DataFrame:
    """Per joint: rows, and the mean motion level used to estimate how far its surfaces slide."""
    groups = {
        "gyroscope": [c for c in features.columns if "gyroscope" in c and c.endswith("_rms")],
        "accelerometer": [c for c in features.columns if "accelerometer" in c and c.endswith("_rms")],
        "energy": [c for c in features.columns if c.endswith("_energy") and "spectral" not in c and "band" not in c],
    }
    kind = next((k for k, columns in groups.items() if columns), "none")
    level = F.avg(_row_mean(groups[kind])) if kind != "none" else F.lit(None).cast("double")
    return features.groupBy("joint_id").agg(F.count("*").alias("rows"), level.alias("level")).withColumn("kind", F.lit(kind))


def sliding_distance(rate_hz: float | None) -> Column:
    """Metres slid, from the columns of ``motion_summary`` and the joint parameters."""
    dt = F.lit(1.0 / (rate_hz or DEFAULT_RATE_HZ))
    n, level, radius, kind = F.col("rows"), F.col("level"), F.col("joint_radius"), F.col("kind")
    return (
        F.when(F.col("sliding_velocity").isNotNull(), F.col("sliding_velocity") * dt * n)
        .when(n == 0, 0.0)
        .when(kind == "gyroscope", level * radius * dt * n)
        .when(kind == "accelerometer", level * dt * dt * n * radius)
        .when(kind == "energy", F.sqrt(level) * radius * 0.01)
        .otherwise(1.0)
    )


def archard_volume(load: Column, distance: Column, hardness: Column, k: Column) -> Column:
    return k * load * distance / F.when(hardness < 1e-6, DEFAULT_HARDNESS).otherwise(hardness)


def wear_status(index: Column) -> Column:
    return F.when(index < 0.3, "healthy").when(index < 0.7, "moderate").otherwise("severe")


def _indexed(rows: DataFrame, amount: str, least_spread: float) -> DataFrame:
    """Min-max index over all joints, 0.5 for everyone when they hardly differ."""
    # One row per joint; computed once, since the range and the index both read it.
    rows = materialise(rows)
    span = rows.agg(F.struct(F.min(amount).alias("lo"), F.max(amount).alias("hi"))).scalar()
    rows = rows.withColumn("_span", span)
    width = F.col("_span.hi") - F.col("_span.lo")
    index = F.when(width < least_spread, 0.5).otherwise(F.round((F.col(amount) - F.col("_span.lo")) / width, 4))
    return rows.withColumn("wear_index", index).drop("_span").withColumn("wear_status", wear_status(F.col("wear_index")))


def simple_wear(rates: DataFrame, energy: DataFrame) -> DataFrame:
    """Anomaly rate times energy, when no physical parameters are known."""
    rows = rates.select("joint_id", "anomaly_rate").join(energy.select("joint_id", "signal_energy"), "joint_id")
    return _indexed(rows.withColumn("wear_rate", F.col("anomaly_rate") * F.col("signal_energy")), "wear_rate", 1e-12)


def physics_wear(
    rates: DataFrame,
    energy: DataFrame,
    features: DataFrame,
    parameters: DataFrame,
    catalogue: DataFrame | None = None,
    rate_hz: float | None = None,
) -> DataFrame:
    """Archard wear volume and index per joint. Joints without parameters use the generic ones."""
    rows = rates.select("joint_id", "anomaly_rate").join(energy.select("joint_id", "signal_energy"), "joint_id")
    known = parameters
    missing = rows.select("joint_id").join(known, "joint_id", "left_anti")
    known = resolve_hardness(known.unionByName(default_generic(missing)), catalogue)
    rows = rows.join(known, "joint_id", "left").join(motion_summary(features), "joint_id", "left").fillna(0, ["rows"])
    k = effective_k(F.col("anomaly_rate"), F.col("lubrication_coefficient"))
    rows = rows.withColumns({"_k": k, "_s": sliding_distance(rate_hz)})
    volume = archard_volume(F.col("load_force"), F.col("_s"), F.col("hardness"), F.col("_k"))
    rows = rows.select(
        "joint_id", "anomaly_rate", "signal_energy", "load_force", F.round("_s", 6).alias("sliding_distance"), "hardness",
        F.round("_k", 8).alias("k_eff"), volume.alias("wear_volume"))
    return _indexed(rows, "wear_volume", 1e-18).withColumn("wear_rate", F.col("wear_volume"))


def default_generic(joints: DataFrame) -> DataFrame:
    """Generic parameters whatever the joint's name."""
    fields = [f.split()[0] for f in PARAMETER_SCHEMA.split(", ")]
    kinds = dict(f.split() for f in PARAMETER_SCHEMA.split(", "))
    return joints.select("joint_id", *[F.lit(GENERIC_JOINT.get(c)).cast(kinds[c]).alias(c) for c in fields[1:]])


def user_parameters(spark: SparkSession, entries: list[dict]) -> DataFrame:
    fields = [f.split()[0] for f in PARAMETER_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(e.get(f) for f in fields) for e in entries], PARAMETER_SCHEMA)


def compute_wear(rates, energy, features=None, parameters=None, catalogue=None, rate_hz=None) -> DataFrame:
    """Physics model when features and parameters are given, else the simple product."""
    if features is not None and parameters is not None:
        return physics_wear(rates, energy, features, parameters, catalogue, rate_hz)
    return simple_wear(rates, energy)
