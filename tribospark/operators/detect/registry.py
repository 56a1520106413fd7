"""Choosing, checking and running a detector."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribospark.operators.detect.autoencoder import autoencoder
from tribospark.operators.detect.common import scaling_stats, standardise
from tribospark.operators.detect.forest import isolation_forest
from tribospark.operators.detect.lof import local_outlier_factor
from tribospark.operators.detect.svm import one_class_svm
from tribospark.operators.selection import feature_columns
from tribospark.session import materialise


@dataclass(frozen=True)
class Model:
    title: str
    run: Any
    # parameter -> (default, smallest, largest); None where there is no range
    parameters: dict[str, tuple]


# Model ids, parameters, defaults and ranges.
MODELS = {
    "isolation_forest": Model("Isolation Forest", isolation_forest, {
        "contamination": (0.05, 0.001, 0.5), "n_estimators": (100, 10, 500), "max_samples": ("auto", None, None)}),
    "local_outlier_factor": Model("Local Outlier Factor", local_outlier_factor, {
        "contamination": (0.05, 0.001, 0.5), "n_neighbors": (20, 2, 100), "metric": ("minkowski", None, None),
        "p": (2, 1, 100), "method": ("exact", None, None)}),
    "one_class_svm": Model("One-Class SVM", one_class_svm, {
        "kernel": ("rbf", None, None), "nu": (0.05, 0.001, 0.5), "gamma": ("scale", None, None)}),
    "autoencoder": Model("Autoencoder (Neural Network)", autoencoder, {
        "encoding_dim_ratio": (0.5, 0.1, 0.9), "epochs": (50, 10, 200), "contamination": (0.05, 0.001, 0.5),
        "learning_rate": (0.001, 0.0001, 0.1)}),
}
CONTAMINATION_RANGE = (0.01, 0.5)
#: Detectors that read the scaled matrix once for a sample and once for the scores.
FEW_PASSES = ("isolation_forest",)
#: Numbers of a matrix that is written with all that travels along; a larger one is scaled, and scored, as it is read.
WIDE_NUMBERS = 2**27


@dataclass(frozen=True)
class ModelConfig:
    model_id: str = "isolation_forest"
    params: dict[str, Any] = field(default_factory=dict)
    seed: int = 42


def default_config(model_id: str = "isolation_forest") -> ModelConfig:
    return ModelConfig(model_id, {k: v[0] for k, v in MODELS[model_id].parameters.items()})


def check_config(config: ModelConfig) -> str | None:
    """What is wrong with the configuration, or None."""
    model = MODELS.get(config.model_id)
    if model is None:
        return f"unknown model {config.model_id!r}; known: {', '.join(MODELS)}"
    unknown = sorted(set(config.params) - set(model.parameters))
    if unknown:
        return f"{config.model_id} has no parameter {', '.join(unknown)}"
    for name, value in config.params.items():
        _, low, high = model.parameters[name]
        if isinstance(value, (int, float)) and low is not None and not low <= value <= high:
            return f"{name} = {value} is outside {low} to {high}"
    return None


def with_contamination(config: ModelConfig | None, contamination: float) -> ModelConfig:
    """The analysis-wide share replaces the model's own, except for a model that has none (SVM)."""
    low, high = CONTAMINATION_RANGE
    share = min(max(contamination, low), high)
    config = config or ModelConfig()
    if "contamination" in config.params or config.model_id in ("isolation_forest", "local_outlier_factor"):
        return replace(config, params={**config.params, "contamination": share})
    return config


def detect_anomalies(
    features: DataFrame,
    config: ModelConfig | None = None,
    columns: list[str] | None = None,
    exclude: tuple[str, ...] = (),
) -> DataFrame:
    """The feature matrix with ``anomaly`` (1 or -1) and ``anomaly_score`` (lower is worse), fitted per joint.

    The matrix travels through scaling and scoring, so the labels need no join back on row numbers (but those of the local
    outlier factor). Where it has WIDE_NUMBERS at most it is written on the way: scored by a detector that reads it twice, else
    scaled. A larger one never is; only its scaled columns are, while a detector learns in rounds.
    """
    config = config or default_config()
    problem = check_config(config)
    if problem:
        raise ValueError(problem)
    features = features.drop("anomaly", "anomaly_score")
    columns = columns or feature_columns(features, exclude)
    if not columns:
        raise ValueError("no numeric feature column to fit a detector on")
    carry = [c for c in features.columns if c not in ("joint_id", "seq")]
    stats = materialise(scaling_stats(features, columns, ["joint_id"]))
    wide = (stats.agg(F.sum("n")).first()[0] or 0) * (len(carry) + len(columns)) <= WIDE_NUMBERS
    scaled = standardise(features, columns, carry=carry, stats=stats)
    if wide and config.model_id not in FEW_PASSES:
        scaled = materialise(scaled)
    return MODELS[config.model_id].run(scaled, config.params, config.seed, wide=wide)
