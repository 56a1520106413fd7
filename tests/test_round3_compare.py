"""Comparing detectors: what is read once, and what runs side by side."""

import threading

from pyspark.sql import functions as F

from tribospark.operators import evaluation
from tribospark.plans import analysis


def test_detectors_are_compared_side_by_side(spark, monkeypatch):
    """Both must have begun before either goes on, and the rows keep the order of the models."""
    features = spark.range(400).select(F.lit("a").alias("joint_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("timestamp"),
                                       F.sin("id").alias("vibration_mean"), F.cos("id").alias("vibration_rms"))
    both, real = threading.Barrier(2, timeout=60), analysis.detect_anomalies

    def waiting(*args):
        both.wait()
        return real(*args)

    monkeypatch.setattr(analysis, "features_of", lambda *_: features)
    monkeypatch.setattr(analysis, "detect_anomalies", waiting)
    rows, best = analysis.compare_models(None, analysis.Options(), ("local_outlier_factor", "isolation_forest"))
    assert [r["model_id"] for r in rows.collect()] == ["local_outlier_factor", "isolation_forest"] and best.count() == 1


def test_label_groups_are_found_once(spark, monkeypatch):
    scored = spark.range(60).select(F.lit("a").alias("joint_id"), F.col("id").alias("seq"), F.sin("id").alias("vibration_mean"),
                                    F.when(F.col("id") % 9 == 0, -1).otherwise(1).alias("anomaly"), F.cos("id").alias("anomaly_score"))
    calls, real = [], evaluation.label_groups
    monkeypatch.setattr(evaluation, "label_groups", lambda points: calls.append(1) or real(points))
    report = evaluation.diagnostics(scored, importance=False)
    got = report["totals"].first()
    assert len(calls) == 1
    points = evaluation.cluster_points(scored, ["vibration_mean"])
    assert got["silhouette_score"] == evaluation.silhouette(points).first()[0]
    assert got["calinski_harabasz_score"] == evaluation.calinski_harabasz(points).first()[0]
