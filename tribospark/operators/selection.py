"""Choosing, profiling and classifying feature columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

META = ("joint_id", "seq", "timestamp")
RESERVED = (*META, "anomaly", "anomaly_score")

# Name endings per category, tested in this order. The first list ends with "_energy",
# so spectral and band energies count as statistical.
CATEGORY_ENDINGS = {
    "statistical": ("_mean", "_std", "_variance", "_skewness", "_kurtosis", "_rms", "_peak_to_peak", "_jerk", "_energy"),
    "spectral": ("_spectral_energy", "_dominant_frequency", "_spectral_entropy", "_spectral_centroid", "_band_energy",
                 "_harmonic_ratio"),
    "vibration": ("_crest_factor", "_impulse_factor", "_clearance_factor", "_shape_factor"),
    "thermal": ("_thermal_drift", "_thermal_rate", "_thermal_acceleration"),
}


@dataclass(frozen=True)
class FeatureSelection:
    selected: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    min_variance: float = 0.0
    labels: tuple[str, ...] = field(default=())


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are neither metadata, results nor listed in ``exclude`` (labels)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in RESERVED and f.name not in exclude]


def select_features(features: DataFrame, selection: FeatureSelection) -> DataFrame:
    """Metadata first, then the chosen features by name. A variance threshold costs one aggregate."""
    names = [c for c in features.columns if c not in META]
    keep = [c for c in names if c in selection.selected] if selection.selected else names
    keep = [c for c in keep if c not in selection.excluded]
    if selection.min_variance > 0 and keep:
        spread = features.agg(*[F.var_samp(c).alias(c) for c in keep]).first()
        keep = [c for c in keep if not (spread[c] is not None and spread[c] < selection.min_variance)]
    return features.select(*[c for c in sorted(META) if c in features.columns], *sorted(keep))


def drop_features(features: DataFrame, names: list[str]) -> DataFrame:
    return features.drop(*[n for n in names if n not in META])


def selection_counts(features: DataFrame, selection: FeatureSelection) -> dict[str, int]:
    available = [c for c in features.columns if c not in META]
    chosen = select_features(features, selection)
    return {"available": len(available), "active": len([c for c in chosen.columns if c not in META])}


def profile_features(features: DataFrame) -> DataFrame:
    """One row per feature: type, moments and range (4 digits), distinct values and share of zeros."""
    names = sorted(c for c in features.columns if c not in META)
    types = dict(features.dtypes)
    numeric = [c for c in names if isinstance(features.schema[c].dataType, NumericType)]
    none = F.lit(None).cast("double")
    rows = []
    for n in names:
        is_number = n in numeric
        v = F.col(n).cast("double") if is_number else none
        zero = F.avg((v == 0).cast("double")) * 100
        rows.append(F.struct(
            F.lit(n).alias("name"), F.lit(types[n]).alias("dtype"), F.round(F.avg(v), 4).alias("mean"),
            F.round(F.stddev_samp(v), 4).alias("std"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"),
            F.round(zero, 2).alias("pct_zero")))
    stats = features.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    # Distinct counts as two plain group-bys: the first one spreads a hot value's copies before the shuffle.
    cells = features.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("cell")) for n in names])).alias("c"))
    distinct = cells.select("c.*").filter("cell is not null").groupBy("name", "cell").count().groupBy("name").agg(
        F.count("*").alias("n_unique"))
    return stats.join(distinct, "name", "left").select(
        "name", "dtype", "mean", "std", "min", "max", F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "pct_zero")


def feature_category(name: Column) -> Column:
    out = None
    for category, endings in CATEGORY_ENDINGS.items():
        hit = F.lit(False)
        for ending in endings:
            hit = hit | name.endswith(ending)
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")


def category_counts(profile: DataFrame) -> DataFrame:
    return profile.groupBy(feature_category(F.col("name")).alias("category")).agg(F.count("*").alias("features"))
