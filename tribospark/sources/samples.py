"""Bounded samples with a reproducible choice of rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ROW_CAP = 20_000
SCHEMA_SAMPLE_ROWS = 2_000
DISCOVERY_ROWS = 500


def sample_key(cols: list[str], seed: int) -> Column:
    """Uniform text key from the row's identity; the same on every run and every cluster."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def fixed_size_sample(df: DataFrame, n: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, uniform without replacement.

    Rows whose key is far above the n-th smallest are dropped before the top-n, so each task hands
    over about its share of n rows. The margin is ten standard deviations of the kept count.
    """
    total = df.count()
    if total <= n:
        return df
    keep = min(1.0, (n + 10 * math.sqrt(n) + 100) / total)
    keyed = df.withColumn("_key", sample_key(id_cols, seed))
    if keep < 1.0:
        keyed = keyed.filter(F.col("_key") < F.lit(f"{int(keep * 16**8):08x}"))
    return keyed.orderBy("_key", *id_cols).limit(n).drop("_key")


def cap_rows(df: DataFrame, order_cols: list[str], max_rows: int = DEFAULT_ROW_CAP, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``max_rows`` rows, in the original row order."""
    return fixed_size_sample(df, max_rows, order_cols, seed).orderBy(*order_cols)


def head_rows(df: DataFrame, order_cols: list[str], n: int = SCHEMA_SAMPLE_ROWS) -> DataFrame:
    return df.orderBy(*order_cols).limit(n)


def discovery_rows(signals: DataFrame, n: int = DISCOVERY_ROWS, order_cols: tuple[str, ...] = ("joint_id",)) -> DataFrame:
    """First ``n`` rows of the first joint, used to list the features a dataset would have."""
    first = signals.agg(F.min_by("joint_id", F.struct(*order_cols))).scalar()
    return signals.filter((F.col("joint_id") == first) & (F.col("seq") < n))
