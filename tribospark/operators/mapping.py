"""From a raw table to the canonical per-joint series."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tribospark.operators.ordering import number_rows
from tribospark.operators.quality import epoch_divisor, sampling_rate, time_value
from tribospark.operators.roles import DatasetSchema
from tribospark.session import materialise
from tribospark.sources.readers import magnetometer_rows

# Labels of the six segments a single-joint log is cut into.
ARM_JOINTS = ("base", "shoulder", "elbow", "wrist_1", "wrist_2", "wrist_3")
MIN_SPLIT_ROWS = 100


@dataclass(frozen=True)
class SignalTable:
    """``rows``: joint_id, seq, t and one double column per signal. ``signals``: key -> modality.

    ``optional`` names signals that came from text and may be absent from some joints.
    """

    rows: DataFrame
    signals: dict[str, str]
    sampling_rate_hz: float | None = None
    optional: tuple[str, ...] = ()

    def with_rows(self, rows: DataFrame) -> SignalTable:
        return replace(self, rows=rows)


def joint_series(
    df: DataFrame,
    joint: str | Column | None,
    timestamp: str | None,
    channels: dict[str, Column | str],
    tie_break: list[str],
    **numbering,
) -> DataFrame:
    """Select joint, time and channels, drop rows without a joint, number rows and start time at zero.

    Rows are ordered by time and then by ``tie_break``, which must make the order total.
    """
    joint_col = F.lit("default") if joint is None else (F.col(joint) if isinstance(joint, str) else joint)
    raw_time = time_value(df, timestamp) if timestamp else F.lit(None).cast("double")
    numeric_time = bool(timestamp) and isinstance(df.schema[timestamp].dataType, NumericType)
    ties = {f"_tie{i}": F.col(c) for i, c in enumerate(tie_break)}
    picked = df.select(
        joint_col.cast("string").alias("joint_id"), raw_time.alias("_time"),
        *[c.alias(k) for k, c in ties.items()],
        *[as_double(df, c).alias(k) for k, c in channels.items()],
    ).filter(F.col("joint_id").isNotNull())
    numbered = number_rows(picked, ["joint_id"], ["_time", *ties], without=tuple(ties), **numbering)
    starts = materialise(numbered.groupBy("joint_id").agg(F.min("_time").alias("_start")))
    unit = epoch_divisor(F.col("_start")) if numeric_time else F.lit(1.0)
    # A joint without any readable time falls back to its row numbers; a single bad cell stays null.
    t = F.when(F.col("_start").isNull(), F.col("seq").cast("double")).otherwise((F.col("_time") - F.col("_start")) / unit)
    return numbered.join(starts, "joint_id").select("joint_id", "seq", t.alias("t"), *channels)


def as_double(df: DataFrame, column: Column | str) -> Column:
    if isinstance(column, str) and not isinstance(df.schema[column].dataType, NumericType):
        return F.expr(f"try_cast(trim(`{column}`) as double)")
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def map_dataset(df: DataFrame, schema: DatasetSchema, tie_break: list[str], facts: DataFrame | None = None, **numbering) -> SignalTable:
    """Apply a column-role schema: canonical signal names, per-joint order, time from zero.

    ``facts`` is the ``sampling_summary`` of the whole table, if the caller has it already.
    """
    channels = [(column, key, modality) for column, key, modality in schema.channels() if column in df.columns]
    timestamp = schema.timestamp if schema.timestamp in df.columns else None
    joint = schema.joint if schema.joint in df.columns else None
    text = [key for column, key, _ in channels if not isinstance(df.schema[column].dataType, NumericType)]
    rows = joint_series(df, joint, timestamp, {key: column for column, key, _ in channels}, tie_break, **numbering)
    dropped = []
    if text:
        seen = rows.agg(*[F.count(k).alias(k) for k in text]).first()
        dropped = [k for k in text if not seen[k]]
    rate = None
    if timestamp:
        rate = (sampling_rate(df, timestamp, tie_break) if facts is None else facts.select("sampling_rate_hz")).first()
    return SignalTable(
        rows.drop(*dropped),
        {key: modality for _, key, modality in channels if key not in dropped},
        rate[0] if rate else None,
        tuple(k for k in text if k not in dropped),
    )


def to_long(table: SignalTable) -> DataFrame:
    """Unpivot to one row per joint, position and signal; a signal with no number in a joint is left out."""
    long = table.rows.unpivot(["joint_id", "seq", "t"], list(table.signals), "signal", "value")
    modality = F.create_map(*[F.lit(x) for pair in table.signals.items() for x in pair])[F.col("signal")]
    long = long.withColumn("modality", modality)
    if table.optional:
        present = long.filter(F.col("value").isNotNull()).select("joint_id", "signal").distinct()
        checked = long.filter(F.col("signal").isin(*table.optional)).join(present, ["joint_id", "signal"], "left_semi")
        long = long.filter(~F.col("signal").isin(*table.optional)).unionByName(checked)
    return long.select("joint_id", "seq", "t", "signal", "modality", "value")


def split_single_joint(rows: DataFrame, total: int, parts: int = 6, min_rows: int = MIN_SPLIT_ROWS) -> DataFrame:
    """Cut a single joint's ``total`` rows into equal consecutive segments; the last takes the rest."""
    if total <= min_rows:
        return rows
    size = total // parts
    segment = F.least(F.floor(F.col("seq") / size), F.lit(parts - 1)).cast("int")
    labels = [ARM_JOINTS[i] if i < len(ARM_JOINTS) else f"joint_{i}" for i in range(parts)]
    return rows.withColumns({
        "joint_id": F.element_at(F.array(*[F.lit(x) for x in labels]), segment + 1),
        "seq": F.col("seq") - segment * size,
    })


def with_synthetic_joints(table: SignalTable) -> SignalTable:
    """Six-way split when the table holds exactly one joint with more than 100 rows."""
    joints = table.rows.groupBy("joint_id").count().limit(2).collect()
    if len(joints) != 1:
        return table
    return table.with_rows(split_single_joint(table.rows, joints[0]["count"]))


def magnetometer_series(df: DataFrame, tie_break: list[str], target_joints: int = 6, **numbering) -> DataFrame:
    """Magnetometer-only log: joint_id, seq, timestamp, mx, my, mz in time order.

    A single joint is cut into ``target_joints`` segments whatever its length.
    """
    rows = magnetometer_rows(df).withColumn("joint_id", F.col("joint_id").cast("string"))
    picked = rows.select("joint_id", "timestamp", "mx", "my", "mz", *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie_break)])
    order = ["timestamp", *[f"_tie{i}" for i in range(len(tie_break))]]
    joints = picked.groupBy("joint_id").count().limit(2).collect()
    numbered = number_rows(picked, ["joint_id"], order, **numbering).select("joint_id", "seq", "timestamp", "mx", "my", "mz")
    if len(joints) == 1 and target_joints > 1 and joints[0]["count"] >= target_joints:
        return split_single_joint(numbered, joints[0]["count"], target_joints, min_rows=0)
    return numbered


def dataset_summary(table: SignalTable) -> DataFrame:
    """One row per joint: samples and the modalities present."""
    modalities = F.array(*[F.lit(m) for m in sorted(set(table.signals.values()))])
    return table.rows.groupBy("joint_id").agg(F.count("*").alias("samples")).withColumns({
        "modalities": modalities, "sampling_rate_hz": F.lit(table.sampling_rate_hz).cast("double")})
