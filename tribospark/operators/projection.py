"""Wear trajectories as a set-based generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEEDBACK = 1.5
# Fixed value: the label of the unchanged scenario.
CURRENT_MATERIAL = "Current Material (assumed worst-case)"


def projected_wear(current: Column, rate: Column, steps: Column, horizon: int, step: int, alpha: float = FEEDBACK) -> Column:
    """Wear after ``steps`` steps of w <- min(w + rate/horizon * (1 + alpha*w) * step, 1), in closed form.

    The recurrence is affine, so n steps give (w + 1/alpha) * q^n - 1/alpha; growth never turns, so
    capping once at the end equals capping at every step.
    """
    growth = 1 + alpha * step * rate / horizon
    grown = (current + 1 / alpha) * F.pow(growth, steps) - 1 / alpha
    return F.when(steps == 0, current).otherwise(F.least(grown, F.lit(1.0)))


def _points(rows: DataFrame, rate: Column, horizon: int, step: int) -> DataFrame:
    timed = rows.withColumn("_rate", rate).withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(step))))
    wear = projected_wear(F.col("wear_index"), F.col("_rate"), F.col("time") / step, horizon, step)
    return timed.withColumn("projected_wear", F.round(wear, 4))


def _relative_rate(wear: DataFrame) -> DataFrame:
    top = wear.agg(F.max("wear_rate")).scalar()
    wear = wear.withColumn("_top", top)
    return wear.withColumn("_share", F.col("wear_rate") / F.when(F.col("_top") < 1e-12, 1.0).otherwise(F.col("_top"))).drop("_top")


def project_wear(wear: DataFrame, horizon: int = 100, step: int = 5) -> DataFrame:
    """joint_id, time, projected_wear with the current material."""
    return _points(_relative_rate(wear), F.col("_share"), horizon, step).select("joint_id", "time", "projected_wear")


def project_materials(wear: DataFrame, materials: DataFrame, baseline: Column, horizon: int = 100, step: int = 5) -> DataFrame:
    """The same for every joint with every given material; its coefficient scales the rate."""
    # every joint with every material is what is asked for; the optimiser sizes both sides
    chosen = materials.select("material_name", F.col("wear_coefficient").alias("_coefficient"))
    both = _relative_rate(wear).withColumn("_baseline", baseline).crossJoin(chosen)
    rate = F.col("_share") * F.coalesce(F.try_divide(F.col("_coefficient"), F.col("_baseline")), F.lit(1.0))
    return _points(both, rate, horizon, step).select("joint_id", "time", "projected_wear", "material_name")


def material_scenarios(
    wear: DataFrame,
    catalogue: DataFrame,
    top_n: int = 3,
    horizon: int = 100,
    step: int = 5,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Current material and the ``top_n`` best ones: by rank if given, else by smallest coefficient."""
    if ranked is not None:
        names = ranked.orderBy(F.desc("practicality_score"), "material_name").limit(top_n).select("material_name")
        best = catalogue.join(names, "material_name", "left_semi")
    else:
        best = catalogue.orderBy("wear_coefficient", "material_name").limit(top_n)
    baseline = catalogue.agg(F.max("wear_coefficient")).scalar()
    current = project_wear(wear, horizon, step).withColumn("material_name", F.lit(CURRENT_MATERIAL))
    return current.unionByName(project_materials(wear, best, baseline, horizon, step))


def wide_by_joint(trajectories: DataFrame, joints: list[str]) -> DataFrame:
    """One row per time, one column per joint."""
    return trajectories.groupBy("time").pivot("joint_id", joints).agg(F.first("projected_wear"))


def wide_by_material(scenarios: DataFrame, joint: str, materials: list[str] | None = None) -> DataFrame:
    """One joint's scenarios: one row per time, one column per material."""
    grouped = scenarios.filter(F.col("joint_id") == joint).groupBy("time")
    return grouped.pivot("material_name", materials).agg(F.first("projected_wear"))


def padded_range(trajectories: DataFrame, value: str = "projected_wear", share: float = 0.15) -> DataFrame:
    """Axis range of the values with a margin on both sides."""
    lo, hi = F.min(value), F.max(value)
    pad = F.when(hi > lo, (hi - lo) * share).otherwise(0.01)
    return trajectories.agg(F.greatest(lo - pad, F.lit(0.0)).alias("low"), (hi + pad).alias("high"))
