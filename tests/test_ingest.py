import numpy as np
import pytest
from pyspark.sql import functions as F

from tribospark.operators import mapping, quality, roles
from tribospark.sources import readers, samples


@pytest.mark.parametrize("name,want", [
    ("accX", ("accelerometer", "x")), ("acceleration-y", ("accelerometer", "y")), ("a_z", ("accelerometer", "z")), ("acc3", ("accelerometer", "ch3")),
    ("linear_acc_1", ("accelerometer", "ch1")), ("gyro_x", ("gyroscope", "x")), ("angular_velocity", ("gyroscope", "y")), ("magZ", ("magnetometer", "z")),
    ("magnetometer_x", ("magnetometer", "x")), ("vib2", ("vibration", "ch2")), ("temperature_c", ("temperature", "temperature_c")), ("tau1", ("torque", "ch1")),
    ("motor_current", ("motor_current", "motor_current")), ("current", ("motor_current", "current")), ("i_q", ("motor_current", "i_q")), ("stress", ("strain", "stress")),
    ("fx", ("force", "x")), ("load", ("force", "load")), ("q1", ("position", "ch1")), ("velocity", ("velocity", "y")), ("omega", ("velocity", "omega")),
    ("distance_sensor", ("proximity", "distance_sensor")), ("bogus", None), ("acc", None),
])
def test_sensor_names(name, want):
    assert roles.sensor_by_name(name) == want


NAMES = {
    "time": "Timestamp time time_ms time_s Time-Sec timestamp t ts TS epoch_s epoch date date_utc sample_idx samplenumber sample_time sample_index",
    "joint": "joint joint_id Joint-ID name sensor sensor_id sensor_name link link_id link_name axis_id id component segment robot_part robot_joint robotLink",
    "ignored": "img_feat_1 img-feat-22 embedding_3 embed7 feat7 feature_12 pca-1 dim2 label target class category image_id file_path file_name index Unnamed: 0",
    "none": "timer joint_angle bogus acc mag m f q sampler naming identity classy embedding feature labels",
}


@pytest.mark.parametrize("role", NAMES)
def test_time_joint_and_ignored_names(role):
    tests = {"time": roles.is_time, "joint": roles.is_joint, "ignored": roles.is_ignored}
    for column in (["Unnamed: 0"] if role == "ignored" else []) + [c for c in NAMES[role].split() if c not in ("Unnamed:", "0")]:
        assert {r for r, test in tests.items() if test(column)} == ({role} - {"none"}), column


def test_roles_and_overrides(spark):
    rows = [(float(i) / 20, f"j{i % 3}", float(i % 17), float((i * 7) % 11), i % 2, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "time double, name string, accX double, wobble double, label int, note string")
    schema = roles.infer_schema(df, ["time"])
    assert (schema.timestamp, schema.joint) == ("time", "name")
    assert schema.groups["accelerometer"].axes == ("x",) and schema.groups[roles.UNKNOWN].columns == ("wobble",)
    assert schema.unmapped == ("note", "label") and abs(schema.confidence - (4 / 6 + 0.2)) < 1e-12
    changed = roles.override_schema(schema, {"sensors": {"vibration": ["note", "wobble"]}, "joint": ""})
    assert changed.joint == "name" and not changed.inferred and changed.unmapped == ("label",)
    assert ("wobble", "vibration_wobble", "vibration") in changed.channels()


def test_every_unknown_signal_is_mapped(spark):
    df = spark.range(100).select("id", *[(F.hash("id", F.lit(i)) % 100).cast("double").alias(f"w{i}") for i in range(30)])
    schema = roles.infer_schema(df, ["id"])
    assert len(schema.groups[roles.UNKNOWN].columns) == 30 and schema.joint == "id"


def test_scores_use_all_rows_and_steps_over_partitions(spark):
    df = spark.range(5000).select("id", (F.col("id") * 2.0).alias("up"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("holes"),
                                  F.when(F.col("id") < 4000, 1.0).otherwise(F.hash("id").cast("double")).alias("late")).repartition(7)
    got = {r["column"]: r for r in roles.column_scores(df, ["id"], ["up", "holes", "late"]).collect()}
    assert got["up"]["time_score"] == pytest.approx(0.9) and got["holes"]["time_score"] == pytest.approx(0.9)
    assert got["late"]["sensor_score"] == pytest.approx(0.5)


def test_key_clash_last_column_wins(spark):
    schema = roles.DatasetSchema(groups={"force": roles.SensorGroup("force", ("fx", "force_x"), ("x", "x"))})
    assert schema.channels() == [("force_x", "force_x", "force")]


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(float(i), "a" if i % 2 else None, None if i % 4 == 0 else float(i % 5), float("nan") if i < 3 else 1.0, None, "7" if i else "bad") for i in range(40)]
    df = spark.createDataFrame(rows, "t double, joint string, v double, c double, gone double, txt string")
    return df.unionByName(df.filter("t < 20"))


def test_profile(messy):
    got = {r["column"]: r for r in quality.profile_columns(messy).collect()}
    assert got["v"]["missing_count"] == 15 and got["v"]["unique_count"] == 5
    assert got["c"]["missing_count"] == 6 and got["c"]["std_val"] == 0 and got["c"]["unique_count"] == 1
    assert got["gone"]["missing_pct"] == 100 and got["gone"]["min_val"] is None and got["joint"]["unique_count"] == 1
    want = messy.toPandas()["v"]
    assert got["v"]["q1"] == want.quantile(0.25) and got["v"]["q3"] == want.quantile(0.75) and abs(got["v"]["std_val"] - want.std()) < 1e-12
    fast = {r["column"]: r for r in quality.profile_columns(messy, exact=False).collect()}
    assert fast["v"]["unique_count"] == 5 and fast["v"]["missing_count"] == 15


def test_outliers_need_rows_and_spread(spark):
    df = spark.createDataFrame([(float(i % 4), 1.0) for i in range(60)] + [(1000.0, 9.0)], "a double, b double")
    got = {r["column"]: r["outlier_count"] for r in quality.profile_columns(df).collect()}
    assert got == {"a": 1, "b": 0}
    assert quality.profile_columns(df.limit(10)).agg(F.sum("outlier_count")).first()[0] == 0


def test_report(messy):
    schema = roles.DatasetSchema("t", "joint")
    r = quality.validate_dataset(messy, schema, ["t", "v"]).summary.first()
    assert r["total_rows"] == 60 and r["duplicate_rows"] == 20 and r["joint_count"] == 1
    assert r["fully_null_columns"] == ["gone"] and r["is_valid"] and any("gone" in w for w in r["warnings"])
    small = quality.validate_dataset(messy.filter("t < 3"), schema, ["t"]).summary.first()
    assert not small["is_valid"] and any("ten rows" in w for w in small["warnings"])
    none = quality.validate_dataset(messy.filter("t < 0"), schema, ["t"]).summary.first()
    assert not none["is_valid"] and len(none["warnings"]) == 1
    assert quality.profile_columns(messy.filter("t < 0")).agg(F.sum("missing_pct")).first()[0] == 0


def test_verdict_counts_before_the_short_warning(spark):
    df = spark.createDataFrame([(50, [f"w{i}" for i in range(n)]) for n in (5, 6)], "total_rows long, warnings array<string>")
    assert [r["is_valid"] for r in quality.verdict(df).orderBy(F.size("warnings")).collect()] == [True, False]


def test_time_steps_reversals_and_gaps(spark):
    times = [0, 1, 2, 3, 2, 3, 4, 5, 50, 51, None, 52]
    df = spark.createDataFrame([(i, None if t is None else float(t) * 1e3 + 1.7e12) for i, t in enumerate(times)], "i long, ts double")
    for limits in ({}, {"max_window_rows": 1, "chunk_rows": 4}):
        r = quality.sampling_summary(quality.time_steps(df, "ts", ["i"], **limits)).first()
        assert (r["reversals"], r["non_monotonic"], r["timestamp_gaps"], r["sampling_rate_hz"]) == (1, True, 1, 1.0)
        assert r["sampling_rate_std"] > 1000  # stays in milliseconds


def test_time_normalisation(spark):
    for unit, size in (("s", 1), ("ms", 1e3), ("us", 1e6), ("ns", 1e9)):
        df = spark.createDataFrame([(float((1.7e9 + i / 2) * size), float(i)) for i in range(6)], "ts double, v double")
        rows = mapping.joint_series(df, None, "ts", {"v": "v"}, ["v"]).orderBy("seq").collect()
        assert [round(r["t"], 3) for r in rows] == [0, 0.5, 1, 1.5, 2, 2.5], unit
        assert rows[0]["joint_id"] == "default"
    text = spark.createDataFrame([("2024-01-01 00:00:02", 2.0), ("junk", 9.0), ("2024-01-01 00:00:01", 1.0)], "ts string, v double")
    rows = mapping.joint_series(text, None, "ts", {"v": "v"}, ["v"]).orderBy("seq").collect()
    assert [(r["t"], r["v"]) for r in rows] == [(0.0, 1.0), (1.0, 2.0), (None, 9.0)]
    bad = spark.createDataFrame([("junk", 5.0), ("x", 4.0)], "ts string, v double")
    assert [r["t"] for r in mapping.joint_series(bad, None, "ts", {"v": "v"}, ["v"]).orderBy("seq").collect()] == [0.0, 1.0]


def test_null_joints_are_dropped_and_text_is_coerced(messy):
    schema = roles.override_schema(roles.DatasetSchema("t", "joint"), {"sensors": {"force": ["txt"], "strain": ["v"]}})
    table = mapping.map_dataset(messy, schema, ["v"])
    assert table.rows.select("joint_id").distinct().count() == 1 and table.rows.count() == 30
    assert table.rows.agg(F.sum("force_txt")).first()[0] == 7 * 30
    assert table.signals == {"force_txt": "force", "strain_v": "strain"} and table.sampling_rate_hz is not None


def test_six_way_split(spark):
    for n, want in ((100, {"default": 100}), (101, {"base": 16, "shoulder": 16, "elbow": 16, "wrist_1": 16, "wrist_2": 16, "wrist_3": 21})):
        df = spark.range(n).select(F.col("id").cast("double").alias("time"), F.col("id").cast("double").alias("vib"))
        rows = mapping.joint_series(df, None, "time", {"vibration": "vib"}, ["vib"])
        split = mapping.with_synthetic_joints(mapping.SignalTable(rows, {"vibration": "vibration"}))
        assert {r["joint_id"]: r["count"] for r in split.rows.groupBy("joint_id").count().collect()} == want
    last = split.rows.filter("joint_id = 'wrist_3'").agg(F.min("seq"), F.max("seq"), F.min("t")).first()
    assert tuple(last) == (0, 20, 80.0)


def test_materials_and_magnetometer_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)], "material_name string, hardness double, wear_coefficient double, density double, friction_coefficient double")
    assert readers.materials(df).first()["cost_factor"] == 3
    with pytest.raises(ValueError, match="density"):
        readers.materials(df.drop("density"))
    df.write.option("header", True).csv(str(tmp_path / "m"))
    assert readers.read_materials(spark, str(tmp_path / "m")).first()["position"] is not None
    with pytest.raises(ValueError, match="magX|mx"):
        readers.magnetometer_rows(spark.createDataFrame([(1, 2)], "name int, time int"))


def test_samples(spark):
    df = spark.range(3000).withColumn("j", F.lit("a"))
    a = samples.cap_rows(df, ["id"], 700)
    assert a.count() == 700 and a.select("id").collect() == samples.cap_rows(df, ["id"], 700).select("id").collect()
    assert [r["id"] for r in a.collect()] == sorted(r["id"] for r in a.collect())
    assert samples.cap_rows(df, ["id"], 5).count() == 5 and samples.fixed_size_sample(df, 9999, ["id"]).count() == 3000
    placed, order = readers.with_file_position(_written(spark, df))
    assert [r["id"] for r in samples.head_rows(placed, order, 5).collect()] == [0, 1, 2, 3, 4]


def _written(spark, df):
    import tempfile

    path = tempfile.mkdtemp(prefix="tribospark-test-", dir="/tmp") + "/t"
    df.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_headers_with_dots_keep_their_file_order(spark, tmp_path):
    spark.range(5).selectExpr("id as `acc.x`", "id as `time`").coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    placed, order = readers.with_file_position(readers.read_sensor_csv(spark, str(tmp_path / "c")))
    assert placed.columns == ["acc_x", "time", *order] and [r["acc_x"] for r in placed.orderBy(*order).collect()] == [0, 1, 2, 3, 4]


def test_time_facts_of_a_null_joint(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else "a", i) for i in range(40)], "t double, joint string, n int")
    got = {r["joint"]: r["sampling_rate_hz"] for r in quality.sampling_summary(quality.time_steps(df, "t", ["n"], ["joint"]), ["joint"]).collect()}
    assert got == {None: 0.5, "a": 0.5}
    far = {r["joint"]: r["sampling_rate_hz"] for r in quality.sampling_summary(quality.time_steps(df, "t", ["n"], ["joint"], max_window_rows=1), ["joint"]).collect()}
    assert far == got


def test_sketches_of_parts_add_up(spark):
    """Kept sketches of two files, with those of a third added later, tell what one scan of all three tells."""
    rng = np.random.default_rng(4)
    rows = [("abc"[i % 3], i, None if i % 11 == 0 else float(rng.normal()) * 10 ** (i % 3), float("nan") if i % 7 == 0 else 1.0, f"t{i % 500}") for i in range(6000)]
    df = spark.createDataFrame(rows, "file string, whole long, v double, one double, name string")
    columns = ["whole", "v", "one", "name"]
    kept = quality.column_sketches(df.where("file <> 'c'"), columns, F.col("file"))
    assert kept.count() == 8
    both = kept.unionByName(quality.column_sketches(df.where("file = 'c'"), columns, F.lit("c")))
    whole = {r["column"]: r for r in quality.column_sketches(df, columns).collect()}
    marks = F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("values", F.array(F.lit(0.25), F.lit(0.75)))).alias("marks")
    got = {r["column"]: r for r in quality.merged_sketches(both).select("*", F.hll_sketch_estimate("distinct").alias("unique"), marks).collect()}
    for c in columns:
        a, b = got[c], whole[c]
        assert [a[k] for k in ("n", "present", "lo", "hi")] == [b[k] for k in ("n", "present", "lo", "hi")]
        if c != "name":
            assert a["mean"] == pytest.approx(b["mean"]) and a["m2"] == pytest.approx(b["m2"], rel=1e-9, abs=1e-9)
    assert got["whole"]["unique"] == pytest.approx(6000, rel=0.03) and got["name"]["unique"] == pytest.approx(500, rel=0.03) and got["one"]["unique"] == 1
    v = sorted(r[2] for r in rows if r[2] is not None)
    for q, mark in zip((0.25, 0.75), got["v"]["marks"]):
        assert abs(np.searchsorted(v, mark) / len(v) - q) < 0.002
    assert got["name"]["lo"] is None and got["one"]["present"] == sum(i % 7 > 0 for i in range(6000))


def test_profile_of_chosen_exact_columns(spark):
    rows = [(i, float(i % 50) if i % 9 else 1e6, str(i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b double, c string")
    full, some, none = (({r["column"]: r for r in quality.profile_columns(df, exact).collect()}) for exact in (True, ["b"], False))
    assert some["b"].asDict() == full["b"].asDict()
    for c in "abc":
        for k in ("missing_count", "min_val", "max_val", "mean_val", "outlier_count", "total_rows", "dtype", "position"):
            assert none[c][k] == pytest.approx(full[c][k]) if isinstance(full[c][k], float) else none[c][k] == full[c][k], (c, k)
    assert none["a"]["std_val"] == pytest.approx(full["a"]["std_val"]) and none["a"]["unique_count"] == pytest.approx(2000, rel=0.03)
