import math

from tribospark.operators.detect.registry import ModelConfig
from tribospark.operators.selection import FeatureSelection
from tribospark.operators.wear import user_parameters
from tribospark.plans.analysis import Options, analyse, features_of, ingest
from tribospark.sources.readers import read_materials, read_sensor_csv, with_file_position


def test_csv_to_wear(spark, tmp_path):
    rows = [(i / 20, f"j{i % 3}", math.sin(i / 5) + (9 if i % 97 == 0 else 0), math.cos(i / 7), i % 2) for i in range(600)]
    log = spark.createDataFrame(rows, "time double, name string, accX double, accY double, label int")
    log.coalesce(1).write.option("header", True).csv(str(tmp_path / "log"))
    catalogue = [("Hardened Steel", 700.0, 4e-4, 7.8, 0.5), ("Film", 2000.0, 1e-5, 3.0, 0.1)]
    spark.createDataFrame(catalogue, "material_name string, hardness double, wear_coefficient double, density double, friction_coefficient double").coalesce(1).write.option(
        "header", True).csv(str(tmp_path / "materials"))
    raw, order = with_file_position(read_sensor_csv(spark, str(tmp_path / "log"), log.schema))
    options = Options(window=20, model=ModelConfig("isolation_forest", {"n_estimators": 20}), deselected=("accelerometer_x_jerk",))
    data = ingest(raw, order, options)
    assert data.schema.timestamp == "time" and data.schema.joint == "name" and data.schema.unmapped == ("label",)
    assert data.table.sampling_rate_hz == 20.0 and data.quality.summary.first()["total_columns"] == 5
    assert data.quality.joints.count() == 3 and data.quality.columns.count() == 5
    result = analyse(data.table, read_materials(spark, str(tmp_path / "materials")), user_parameters(spark, [{"joint_id": "j1", "load_force": 500.0}]), options)
    assert result.scored.count() == 600 and "accelerometer_x_jerk" not in result.scored.columns and "accelerometer_magnitude_rms" in result.scored.columns
    wear = {r["joint_id"]: r for r in result.wear.collect()}
    assert set(wear) == {"j0", "j1", "j2"} and wear["j1"]["load_force"] == 500.0 and wear["j1"]["wear_index"] == 1.0
    assert all(abs(w["anomaly_rate"] - 0.1) < 0.01 and w["hardness"] == 700.0 for w in wear.values())
    assert [r["material_name"] for r in result.ranked.collect()] == ["Film", "Hardened Steel"]
    assert result.trajectories.count() == 63 and result.scenarios.count() == 63 * 3 and result.timeline.count() == 200
    assert result.reports["importance"].count() == result.reports["model"].first()["n_features_used"] == 56


def test_single_joint_is_split_and_selection_applies(spark):
    rows = [(float(i), math.sin(i), 1.0) for i in range(130)]
    df = spark.createDataFrame(rows, "t double, vib double, gyro_x double")
    options = Options(window=8, selection=FeatureSelection(("vibration_vib_rms",)))
    data = ingest(df, ["t"], options)
    features = features_of(data.table, options)
    assert features.columns == ["joint_id", "seq", "timestamp", "vibration_vib_rms"]
    assert {r["joint_id"]: r["count"] for r in features.groupBy("joint_id").count().collect()} == {
        "base": 21, "shoulder": 21, "elbow": 21, "wrist_1": 21, "wrist_2": 21, "wrist_3": 25}


def test_scope_drops_its_tables(spark):
    from pathlib import Path

    from tribospark.session import materialise, scratch_root, scratch_scope

    root = Path(scratch_root(spark).removeprefix("file:"))
    kept = materialise(spark.range(3))
    with scratch_scope(spark):
        assert materialise(spark.range(5)).count() == 5 and len(list(root.glob("scope-*/*"))) == 1
    assert not list(root.glob("scope-*")) and kept.count() == 3 and materialise(spark.range(2)).count() == 2
