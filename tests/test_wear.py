import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tribospark.operators import materials, presentation, projection, wear


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [("Hardened Steel A", 700.0, 4e-4, 7.8, 0.5, 2, 1), ("hardened steel B", 800.0, 3e-4, 7.8, 0.4, 3, 2), ("Polymer", 80.0, 8e-4, 1.2, 0.2, 1, 3), ("Film", 2000.0, 1e-5, 3.0, 0.1, 9, 4)]
    return table(spark, rows, "material_name string, hardness double, wear_coefficient double, density double, friction_coefficient double, cost_factor int, position int")


@pytest.fixture(scope="module")
def worn(spark):
    rows = [("a", 0.1, 5.0, 0.2, 0.0, "healthy"), ("b", 0.3, 10.0, 0.8, 1.0, "severe"), ("c", 0.2, 2.0, 0.4, 0.5, "moderate")]
    return table(spark, rows, "joint_id string, anomaly_rate double, signal_energy double, wear_rate double, wear_index double, wear_status string")


def test_energy_column_order(spark):
    def pick(*names):
        return wear.energy_column(spark.createDataFrame([], ", ".join(f"{n} double" for n in ("joint_id", "timestamp", *names))))

    assert pick("x_energy", "gyroscope_magnitude_energy") == "gyroscope_magnitude_energy"
    assert pick("x_spectral_energy", "x_band_energy", "x_energy") == "x_energy"
    assert pick("x_band_energy", "energy") == "energy" and pick("x_band_energy", "x_rms") == "x_rms"


def test_parameters(spark):
    defaults = wear.default_parameters(table(spark, [("base",), ("other",)], "joint_id string"))
    user = wear.user_parameters(spark, [{"joint_id": "base", "load_force": 1.0, "hardness": 9.0}, {"joint_id": "new", "material": "Film"}, {"joint_id": ""}])
    got = {r["joint_id"]: r for r in wear.merge_parameters(defaults, user).collect()}
    assert set(got) == {"base", "other", "new"}
    assert (got["base"]["load_force"], got["base"]["joint_radius"], got["base"]["hardness"]) == (1.0, 0.06, 9.0)
    assert (got["other"]["load_force"], got["new"]["load_force"], got["new"]["material"]) == (50.0, 50.0, "Film")


def test_hardness_lookup(spark, catalogue):
    rows = wear.user_parameters(spark, [{"joint_id": j, "material": m, "hardness": h} for j, m, h in
                                        (("a", "Hardened Steel", None), ("b", "STEEL B", None), ("c", "wood", None), ("d", "Film", 5.0), ("e", "A.*B", None))])
    got = {r["joint_id"]: r["hardness"] for r in wear.resolve_hardness(rows, catalogue).collect()}
    assert got == {"a": 700.0, "b": 800.0, "c": 600.0, "d": 5.0, "e": 600.0}
    assert {r["hardness"] for r in wear.resolve_hardness(rows, None).collect()} == {600.0, 5.0}


def test_sliding_distance_fallbacks(spark):
    p = wear.user_parameters(spark, [{"joint_id": "a", "joint_radius": 0.5}, {"joint_id": "b", "joint_radius": 0.5, "sliding_velocity": 2.0}])

    def s(columns, values):
        f = table(spark, [("a", *values), ("b", *values)], "joint_id string, " + ", ".join(f"{c} double" for c in columns))
        rows = wear.motion_summary(f).join(p, "joint_id").withColumn("s", wear.sliding_distance(None)).orderBy("joint_id").collect()
        return [round(r["s"], 9) for r in rows]

    assert s(["gyroscope_x_rms", "accelerometer_x_rms"], [4.0, 9.0]) == [4 * 0.5 * 0.1, 0.2]
    assert s(["accelerometer_x_rms", "accelerometer_magnitude_rms"], [4.0, 6.0]) == [round(5 * 0.01 * 0.5, 9), 0.2]
    assert s(["v_energy", "v_spectral_energy"], [16.0, 1e9]) == [4 * 0.5 * 0.01, 0.2]
    assert s(["v_mean"], [16.0]) == [1.0, 0.2]


def test_physics_and_index(spark, catalogue):
    rates = table(spark, [("a", 0.0), ("b", 0.5), ("only_rate", 1.0)], "joint_id string, anomaly_rate double")
    energy = table(spark, [("a", 1.0), ("b", 2.0)], "joint_id string, signal_energy double")
    features = table(spark, [("a", 2.0), ("b", 2.0)], "joint_id string, gyroscope_x_rms double")
    params = wear.user_parameters(spark, [{"joint_id": "a", "load_force": 10.0, "joint_radius": 1.0, "material": "x", "lubrication_coefficient": 7.0, "hardness": 0.0}])
    got = {r["joint_id"]: r for r in wear.compute_wear(rates, energy, features, params, catalogue, 20.0).collect()}
    assert set(got) == {"a", "b"}
    assert abs(got["a"]["wear_volume"] - 0.5e-4 * 10 * 0.1 / 600) < 1e-18  # lubrication clamps at 1, hardness falls back
    assert abs(got["b"]["wear_volume"] - 6e-4 * 0.75 * 50 * (2 * 0.04 * 0.05) / 700) < 1e-18  # generic parameters
    assert {got[j]["wear_index"] for j in got} == {0.0, 1.0} and got["b"]["k_eff"] == 0.00045


def test_equal_joints_are_moderate(spark):
    rates = table(spark, [("a", 0.5), ("b", 0.5)], "joint_id string, anomaly_rate double")
    energy = table(spark, [("a", 2.0), ("b", 2.0)], "joint_id string, signal_energy double")
    got = wear.compute_wear(rates, energy).collect()
    assert {(r["wear_index"], r["wear_status"]) for r in got} == {(0.5, "moderate")}
    none = wear.compute_wear(rates.limit(0), energy)
    assert none.count() == 0 and "wear_status" in none.columns


def test_ranking(spark, worn, catalogue):
    got = materials.rank_materials(worn, catalogue).collect()
    fw, hw = (17 / 3) / 10, min(0.2 / 0.3, 1)
    want = {}
    for name, h, k, density, mu, cost, _ in (tuple(r) for r in catalogue.collect()):
        red = round((1 - k / 8e-4) * 100, 2)
        want[name] = round((red / 100) ** 1.5 * (1 + 0.35 * fw * (1 - mu / 0.5) + 0.35 * hw * h / 2000) * 100 / (density / 1.2 * cost**0.5), 2)
    assert {r["material_name"]: r["practicality_score"] for r in got} == want
    assert [r["practicality_score"] for r in got] == sorted(want.values(), reverse=True)
    assert materials.by_wear_reduction(materials.rank_materials(worn, catalogue)).first()["material_name"] == "Film"
    assert materials.worst_joint(worn).first()["joint_id"] == "b"
    assert materials.relative_score(materials.rank_materials(worn, catalogue)).first()["relative_score"] == 1.0
    bare = materials.condition_weights(worn.select("joint_id")).first()
    assert abs(bare["friction_weight"] - 0.3) < 1e-12 and abs(bare["hardness_weight"] - 1 / 3) < 1e-12


def step_by_step(w, rate, horizon, step):
    out = [w]
    for _ in range(step, horizon + 1, step):
        w = min(w + rate / horizon * (1 + 1.5 * w) * step, 1.0)
        out.append(w)
    return out


@settings(max_examples=15, deadline=None)
@given(st.floats(0, 1), st.floats(0, 1), st.sampled_from([(100, 5), (30, 7), (10, 10)]))
def test_closed_form_equals_recurrence(spark, w, rate, grid):
    horizon, step = grid
    df = spark.createDataFrame([(w, rate)], "wear_index double, r double").withColumn("time", F.explode(F.sequence(F.lit(0), F.lit(horizon), F.lit(step))))
    value = projection.projected_wear(F.col("wear_index"), F.col("r"), F.col("time") / step, horizon, step)
    got = [r[0] for r in df.orderBy("time").select(value).collect()]
    assert max(abs(a - b) for a, b in zip(got, step_by_step(w, rate, horizon, step))) < 1e-12


def test_projection_views(worn, catalogue):
    points = projection.project_wear(worn)
    assert points.count() == 63 and points.filter("time = 0 and joint_id = 'b'").first()["projected_wear"] == 1.0
    ranked = materials.rank_materials(worn, catalogue)
    rows = projection.material_scenarios(worn, catalogue, 2, ranked=ranked)
    names = {r[0] for r in rows.select("material_name").distinct().collect()}
    assert names == {projection.CURRENT_MATERIAL, *[r["material_name"] for r in ranked.limit(2).collect()]}
    assert projection.material_scenarios(worn, catalogue, 1).filter("material_name = 'Film'").count() == 63
    wide = projection.wide_by_joint(points, ["a", "b", "c"])
    assert wide.columns == ["time", "a", "b", "c"] and wide.count() == 21
    assert len(projection.wide_by_material(rows, "a").columns) == 4
    low, high = projection.padded_range(points).first()
    assert low == 0.0 and 1.0 < high <= 1.15
    nested = presentation.nested_trajectories(points).filter("joint_id = 'a'").first()["trajectory"]
    assert [p["time"] for p in nested] == list(range(0, 101, 5))


def test_report(spark, worn, catalogue, tmp_path):
    tables = presentation.report_tables(worn, materials.rank_materials(worn, catalogue), projection.project_wear(worn), ["a", "b"])
    assert tables["joints"].filter("joint = 'b'").first().asDict() == {"joint": "b", "wear_index_pct": "100.00", "status": "severe", "anomaly_rate_pct": "30.00", "signal_energy": "10.00"}
    assert tables["materials"].filter("material = 'Film'").first()["wear_coefficient"] == "1.000e-5"
    presentation.write_report(tables, str(tmp_path))
    assert spark.read.option("header", True).csv(str(tmp_path / "trajectories")).count() == 21
    fleet = presentation.fleet_summary(worn, catalogue).first()
    assert (fleet["joints"], fleet["severe_joints"], fleet["materials"]) == (3, 1, 4)
    assert [r["joint_id"] for r in presentation.by_wear(worn).collect()] == ["b", "c", "a"]
