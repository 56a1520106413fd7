"""Reading sensor logs and material catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Required columns of a materials catalogue, and the cost factor of a missing one.
MATERIAL_COLUMNS = ("material_name", "hardness", "wear_coefficient", "density", "friction_coefficient")
DEFAULT_COST_FACTOR = 3

# Raw header -> canonical name of the magnetometer-only log.
MAGNETOMETER_HEADERS = {"name": "joint_id", "time": "timestamp", "magX": "mx", "magY": "my", "magZ": "mz"}


def read_sensor_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Headered CSV. Give a schema for large inputs: inference costs one extra pass over the files."""
    reader = spark.read.option("header", True)
    return plain_names((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def plain_names(df: DataFrame) -> DataFrame:
    """Dots and backticks in headers become underscores, since column expressions read them as syntax."""
    return df.withColumnsRenamed({c: re.sub(r"[.`]", "_", c) for c in df.columns if re.search(r"[.`]", c)})


def read_sensor_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_file_position(df: DataFrame, prefix: str = "_file") -> tuple[DataFrame, list[str]]:
    """Add columns whose order is the order of rows in the input files, and return their names."""
    names = [f"{prefix}_path", f"{prefix}_block", f"{prefix}_row"]
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias(names[0]),
        F.col("_metadata.file_block_start").alias(names[1]),
        F.monotonically_increasing_id().alias(names[2]),
    )
    return placed, names


def materials(df: DataFrame) -> DataFrame:
    """Check the catalogue's required columns and fill in a missing cost factor."""
    missing = sorted(set(MATERIAL_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"materials table lacks columns: {', '.join(missing)}")
    if "cost_factor" not in df.columns:
        df = df.withColumn("cost_factor", F.lit(DEFAULT_COST_FACTOR))
    return df


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue from a headered CSV; ``position`` keeps the file order for first-match lookups."""
    raw, order = with_file_position(read_sensor_csv(spark, path))
    ranked = materials(raw)
    return ranked.withColumn("position", F.struct(*order)).drop(*order)


def magnetometer_rows(df: DataFrame) -> DataFrame:
    """The fixed five-column magnetometer layout, from either header style."""
    renamed = df.withColumnsRenamed({k: v for k, v in MAGNETOMETER_HEADERS.items() if k in df.columns})
    needed = list(MAGNETOMETER_HEADERS.values())
    missing = [c for c in needed if c not in renamed.columns]
    if missing:
        raise ValueError(f"magnetometer table lacks columns: {', '.join(missing)}")
    return renamed
