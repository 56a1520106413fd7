"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores.

Each figure is one run written to Spark's ``noop`` sink (or collected where the result is tiny). A
query starts from a written table where the library would, so that figures do not include each other.
"""

from __future__ import annotations

import json
import os
import time

from checks.fixtures import catalogue, line_series, table
from tribospark.operators import evaluation, features, mapping, materials, projection, quality, selection, wear
from tribospark.operators.detect.common import standardise
from tribospark.operators.detect.forest import isolation_forest
from tribospark.operators.detect.lof import outlier_factors
from tribospark.operators.detect.registry import ModelConfig, detect_anomalies
from tribospark.session import local_session, materialise


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, shuffle_partitions=2 * int(cpus), driver_memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def run(name, make):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    # Start the Python workers once; every figure below is then a warm one.
    spark.range(64).repartition(int(cpus)).mapInArrow(lambda b: b, "id long").count()

    lines = table(spark, sf_dir, "lineitem")
    run("quality_profile", lambda: quality.profile_columns(lines))
    run("quality_time_steps", lambda: quality.sampling_summary(quality.time_steps(table(spark, sf_dir, "events"), "ts", ["event_id"])))
    run("map_joint_series", lambda: line_series(spark, sf_dir).rows)
    series = line_series(spark, sf_dir)
    series = series.with_rows(materialise(series.rows))
    run("map_long_signals", lambda: mapping.to_long(series))
    run("features_two_selected", lambda: features.extract_features(series, selected=["accelerometer_x_mean", "accelerometer_magnitude_rms"]))
    run("features_all", lambda: features.extract_features(series))
    matrix = materialise(features.extract_features(series))
    run("features_profile", lambda: selection.profile_features(matrix.select("joint_id", "seq", "accelerometer_x_mean", "accelerometer_magnitude_rms")))
    run("detect_standardise", lambda: standardise(matrix, selection.feature_columns(matrix)))
    scaled = materialise(standardise(matrix, selection.feature_columns(matrix)))
    run("detect_isolation_forest", lambda: isolation_forest(scaled, {"contamination": 0.1}))
    vectors = table(spark, sf_dir, "embeddings").selectExpr("cast(label as string) joint_id", "vec_id seq", "cast(embedding as array<double>) x")
    run("detect_local_outlier_factor", lambda: outlier_factors(vectors, 20))
    names = ["accelerometer_magnitude_rms", "accelerometer_magnitude_energy", "accelerometer_x_rms"]
    scored = materialise(detect_anomalies(matrix, ModelConfig("isolation_forest", {"contamination": 0.1}), names))
    run("evaluate_distribution", lambda: evaluation.score_distribution(scored))
    run("evaluate_histogram", lambda: evaluation.score_histogram(scored))
    run("evaluate_importance", lambda: evaluation.correlation_importance(scored))
    run("evaluate_silhouette", lambda: evaluation.silhouette(evaluation.cluster_points(scored, names)))
    parts = catalogue(spark, sf_dir)
    run("wear_physics", lambda: wear.physics_wear(
        wear.anomaly_rates(scored), wear.mean_energy(scored), scored,
        wear.default_parameters(scored.select("joint_id").distinct()), parts, 20.0))
    worn = materialise(wear.simple_wear(wear.anomaly_rates(scored), wear.mean_energy(scored)))
    run("materials_ranked", lambda: materials.rank_materials(worn, parts))
    run("project_scenarios", lambda: projection.material_scenarios(worn, parts))

    rows = lines.count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "lineitem_rows": rows,
        "features_all_rows_per_sec": round(rows / seconds["features_all"]),
    }))


if __name__ == "__main__":
    main()
