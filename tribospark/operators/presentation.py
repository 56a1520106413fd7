"""Result tables in the shapes reports and charts read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tribospark.operators.mapping import SignalTable
from tribospark.session import materialise

TIMELINE_ROWS = 1_000
CHART_POINTS = 500


def magnitude_column(features: DataFrame) -> str:
    """Which feature draws the timeline when there is no raw signal."""
    numeric = [f.name for f in features.schema.fields if isinstance(f.dataType, NumericType)
               and f.name not in ("seq", "timestamp", "anomaly", "anomaly_score")]
    tests = (
        (features.columns, lambda c: "magnitude_mean" in c),
        (features.columns, lambda c: "magnitude" in c),
        (features.columns, lambda c: c.endswith("_rms")),
        (numeric, lambda c: True),
    )
    for columns, test in tests:
        hit = next((c for c in columns if test(c)), None)
        if hit:
            return hit
    return "timestamp"


def timeline(scored: DataFrame, table: SignalTable | None = None, joint: str | None = None, rows: int = TIMELINE_ROWS) -> DataFrame:
    """First rows of one joint: timestamp, magnitude, anomaly. Empty if there is nothing but zeros.

    Raw values of the first signal are preferred, with the row number as time.
    """
    joint = joint or scored.agg(F.min("joint_id")).first()[0]
    head = scored.filter((F.col("joint_id") == joint) & (F.col("seq") < rows))
    if table is not None and table.signals:
        signal = next(iter(table.signals))
        raw = table.rows.filter((F.col("joint_id") == joint) & (F.col("seq") < rows)).select("seq", F.round(signal, 4).alias("magnitude"))
        raw = raw.join(head.select("seq", "anomaly"), "seq", "left").select(
            F.col("seq").cast("double").alias("timestamp"), "magnitude", F.coalesce("anomaly", F.lit(0)).alias("anomaly"), "seq")
        raw = materialise(raw)
        if not raw.filter("magnitude <> 0").isEmpty():
            return raw
    out = head.select("timestamp", F.round(magnitude_column(scored), 4).alias("magnitude"), "anomaly", "seq")
    top = head.agg(F.max(F.abs(F.round(magnitude_column(scored), 4)))).scalar()
    return out.withColumn("_top", top).filter("_top > 0").drop("_top")


def thinned(line: DataFrame, points: int = CHART_POINTS) -> DataFrame:
    """Every n-th timeline row, so that about ``points`` remain, with a flag for anomalies."""
    total = line.agg(F.count("*")).scalar()
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    return line.withColumn("_n", total).filter(F.col("seq") % step == 0).select(
        F.col("seq").alias("index"), "magnitude", (F.col("anomaly") == -1).alias("is_anomaly"))


def fleet_summary(wear: DataFrame, materials: DataFrame | None = None) -> DataFrame:
    out = wear.agg(F.count("*").alias("joints"), F.count_if(F.col("wear_status") == "severe").alias("severe_joints"),
                   F.avg("wear_index").alias("mean_wear"))
    return out if materials is None else out.withColumn("materials", materials.agg(F.count("*")).scalar())


def by_wear(wear: DataFrame) -> DataFrame:
    return wear.orderBy(F.desc("wear_index"), "joint_id")


def wear_view(wear: DataFrame) -> DataFrame:
    return wear.select(
        "joint_id", F.round("anomaly_rate", 4).alias("anomaly_rate"), F.round("signal_energy", 2).alias("signal_energy"),
        F.round("wear_index", 3).alias("wear_index"), "wear_status")


def nested_trajectories(points: DataFrame, keys: tuple[str, ...] = ("joint_id",)) -> DataFrame:
    """One row per joint (and material) with its points in time order."""
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("time", "projected_wear"))).alias("trajectory"))


def report_tables(wear: DataFrame, ranked: DataFrame, trajectories: DataFrame, joints: list[str]) -> dict[str, DataFrame]:
    """The three sections of the text report, as formatted text columns."""

    def fixed(c, digits):
        return F.format_string(f"%.{digits}f", c.cast("double"))

    # Exponents are written without padding: 1.234e-5
    exponent = F.regexp_replace(F.format_string("%.3e", F.col("wear_coefficient").cast("double")), r"e([+-])0(\d)", "e$1$2")
    wide = trajectories.groupBy("time").pivot("joint_id", joints).agg(F.first("projected_wear"))
    return {
        "joints": wear.select(
            F.col("joint_id").alias("joint"), fixed(F.col("wear_index") * 100, 2).alias("wear_index_pct"),
            F.col("wear_status").alias("status"), fixed(F.col("anomaly_rate") * 100, 2).alias("anomaly_rate_pct"),
            fixed(F.col("signal_energy"), 2).alias("signal_energy")),
        "materials": ranked.select(
            F.col("material_name").alias("material"), fixed(F.col("wear_reduction_pct"), 2).alias("wear_reduction_pct"),
            fixed(F.col("hardness"), 1).alias("hardness"), "friction_coefficient", exponent.alias("wear_coefficient")),
        "trajectories": wide.select("time", *[F.format_string("%.4f", F.coalesce(F.col(f"`{j}`"), F.lit(0.0))).alias(j) for j in joints]).orderBy("time"),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One headered CSV folder per section."""
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
