"""Ranking replacement materials for the observed operating conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BONUS = 0.35
WEAR_POWER = 1.5
FULL_ANOMALY_RATE = 0.3


def condition_weights(wear: DataFrame) -> DataFrame:
    """One row: how much low friction and high hardness should count, each at most 1."""
    if "signal_energy" in wear.columns:
        energy = F.coalesce(F.avg("signal_energy") / F.greatest(F.max("signal_energy"), F.lit(1e-9)), F.lit(0.3))
    else:
        energy = F.lit(0.3)
    rate = F.avg("anomaly_rate") if "anomaly_rate" in wear.columns else F.lit(0.1)
    one = F.lit(1.0)
    return wear.agg(
        F.count("*").alias("_joints"), F.least(energy, one).alias("friction_weight"),
        F.least(rate / FULL_ANOMALY_RATE, one).alias("hardness_weight")).drop("_joints")


def worst_joint(wear: DataFrame) -> DataFrame:
    """The joint with the largest wear index; the first by name on ties."""
    return wear.orderBy(F.desc("wear_index"), "joint_id").limit(1).select("joint_id", "wear_index", "wear_rate")


def rank_materials(wear: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue with wear reduction and practicality score, best first.

    Reduction against the softest material gates the score; density and the root of cost divide it.
    The worst joint's rate cancels out of the reduction, so a zero rate is harmless.
    """
    limits = catalogue.agg(F.struct(
        F.max("wear_coefficient").alias("coefficient"), F.max("friction_coefficient").alias("friction"),
        F.max("hardness").alias("hardness"), F.min("density").alias("density"),
        F.min("cost_factor").cast("double").alias("cost"))).scalar()
    weights = condition_weights(wear).select(F.struct("*")).scalar()

    def share(value: Column, of: Column, default: float) -> Column:
        return F.when(of > 0, value / of).otherwise(default)

    m = catalogue.withColumns({"_max": limits, "_w": weights})
    reduction = F.greatest(F.round((1 - share(F.col("wear_coefficient"), F.col("_max.coefficient"), 1.0)) * 100, 2), F.lit(0.0))
    slick = F.when(F.col("_max.friction") > 0, 1 - F.col("friction_coefficient") / F.col("_max.friction")).otherwise(0.0)
    hard = share(F.col("hardness"), F.col("_max.hardness"), 0.0)
    bonus = BONUS * F.col("_w.friction_weight") * slick + BONUS * F.col("_w.hardness_weight") * hard
    score = F.pow(F.col("wear_reduction_pct") / 100, WEAR_POWER) * (1 + bonus) * 100
    burden = share(F.col("density"), F.col("_max.density"), 1.0) * F.sqrt(share(F.col("cost_factor"), F.col("_max.cost"), 1.0))
    ranked = m.withColumn("wear_reduction_pct", reduction).withColumn("practicality_score", F.round(score / burden, 2))
    return ranked.select(
        "material_name", "wear_coefficient", "hardness", "friction_coefficient", "density", "wear_reduction_pct",
        "practicality_score").orderBy(F.desc("practicality_score"), "material_name")


def by_wear_reduction(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy(F.desc("wear_reduction_pct"), "material_name")


def relative_score(ranked: DataFrame, metric: str = "practicality_score") -> DataFrame:
    """Score as a share of the best material's."""
    best = ranked.agg(F.max(metric)).scalar()
    return ranked.withColumn("_best", best).withColumn(
        "relative_score", F.when(F.col("_best") > 0, F.col(metric) / F.col("_best")).otherwise(0.0)).drop("_best")
