"""Detectors, wear, materials and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import CATALOGUE, EVENTS, R, SCORED, W, catalogue, distance_labels, event_series, line_features, line_scored, line_series, once, r, rounded, table
from tribospark.operators import materials, presentation, projection, wear
from tribospark.operators.detect import registry
from tribospark.operators.detect.autoencoder import autoencoder, autoencoder_errors, component_errors
from tribospark.operators.detect.common import apply_models, label_below, label_errors, standardise
from tribospark.operators.detect.forest import fit_forest, forest_score, isolation_forest
from tribospark.operators.detect.lof import found_share, neighbour_edges, outlier_factors, projected_edges
from tribospark.operators.detect.svm import GAP_AT, KERNELS, SCALE, one_class_svm
from tribospark.operators.detect.svm import fit as fit_svm
from tribospark.operators.features import extract_features, spared
from tribospark.session import materialise

RATE_HZ = 20.0


# --- detectors ---------------------------------------------------------------------------------
def event_matrix(spark, d):
    def make():
        names = [f"vibration_{s}" for s in ("mean", "std", "rms", "peak_to_peak", "jerk", "crest_factor")]
        return standardise(extract_features(event_series(spark, d), selected=names), names)

    return once(spark, d, "event_matrix", make)


def vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("label").cast("string").alias("joint_id"), F.col("vec_id").alias("seq"), F.col("embedding").cast("array<double>").alias("x"))


def lof(spark, d):
    return outlier_factors(vectors(spark, d), 20).select("joint_id", "seq", r("value").alias("value"))


def lof_blocks(spark, d):
    return outlier_factors(vectors(spark, d), 20, block_points=16).select("joint_id", "seq", r("value").alias("value"))


def lof_manhattan(spark, d):
    return outlier_factors(vectors(spark, d), 5, "manhattan").select("joint_id", "seq", r("value").alias("value"))


def lof_cosine(spark, d):
    return outlier_factors(vectors(spark, d), 10, "cosine").select("joint_id", "seq", r("value").alias("value"))


def lof_cubic(spark, d):
    return outlier_factors(vectors(spark, d), 10, "minkowski", p=3).select("joint_id", "seq", r("value").alias("value"))


def lof_projected(spark, d):
    """All vectors as one joint in blocks of 64: do projections find nine in ten of the 20 nearest of all pairs?"""
    rows = vectors(spark, d).groupBy("x").agg(F.min("seq").alias("point"), F.count("*").alias("copies"))
    points = materialise(rows.select(F.lit("all").alias("joint_id"), "point", "copies", "x"))
    true = materialise(neighbour_edges(points, 20, 2, 1 << 20))
    share = found_share(projected_edges(points, 20, 2, 64), true)
    sizes = points.groupBy("joint_id").agg(F.sum("copies").alias("vectors"))
    return share.join(sizes, "joint_id").select("joint_id", "vectors", (F.col("recall") >= 0.9).alias("found"))


LOF_DISTANCES = {
    "l2": "list_distance(a.x, b.x)",
    "l1": "list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))",
    "l3": "pow(list_sum(list_transform(list_zip(a.x, b.x), lambda p: pow(abs(p[1] - p[2]), 3))), 1 / 3.0::DOUBLE)",
    "cosine": "list_cosine_distance(a.x, b.x)",
}


def _lof_sql(k, metric):
    dist = LOF_DISTANCES[metric]
    return f"""WITH v AS (SELECT CAST(label AS VARCHAR) AS joint_id, vec_id AS seq, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  d AS (SELECT a.joint_id, a.seq AS p, b.seq AS q, {dist} AS dist FROM v a JOIN v b ON a.joint_id = b.joint_id AND a.seq <> b.seq),
  nn AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY joint_id, p ORDER BY dist, q) <= {k}),
  kd AS (SELECT joint_id, p, max(dist) AS kd FROM nn GROUP BY ALL),
  lrd AS (SELECT nn.joint_id, nn.p, 1 / (avg(greatest(nn.dist, kd.kd)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.joint_id = nn.joint_id AND kd.p = nn.q GROUP BY ALL),
  lf AS (SELECT nn.joint_id, nn.p AS seq, -avg(b.lrd) / any_value(a.lrd) AS value FROM nn JOIN lrd a ON a.joint_id = nn.joint_id AND a.p = nn.p
    JOIN lrd b ON b.joint_id = nn.joint_id AND b.p = nn.q GROUP BY nn.joint_id, nn.p)"""


def lof_labels(spark, d):
    return label_below(materialise(outlier_factors(vectors(spark, d), 20)), 0.1, shift=False).select("joint_id", "seq", "anomaly")


LOF_LABEL_SQL = f"""{_lof_sql(20, 'l2')}, c AS (SELECT joint_id, quantile_cont(value, 0.1) AS cut FROM lf GROUP BY joint_id)
  SELECT lf.joint_id, seq, CASE WHEN value < cut THEN -1 ELSE 1 END AS anomaly FROM lf JOIN c USING (joint_id)"""


def forest(spark, d):
    return once(spark, d, "forest", lambda: isolation_forest(event_matrix(spark, d), {"contamination": 0.1}))


def svm(spark, d):
    return once(spark, d, "svm", lambda: one_class_svm(event_matrix(spark, d), {"nu": 0.05}))


def neural(spark, d):
    def make():
        return label_errors(materialise(autoencoder_errors(event_matrix(spark, d), {"epochs": 50})), 0.1)

    return once(spark, d, "neural", make)


def flagged(make):
    """Rows and flagged share per joint: what every detector must reproduce whatever its random choices."""
    return lambda spark, d: wear.anomaly_rates(make(spark, d)).select("joint_id", "total_readings", F.round("anomaly_rate", 2).alias("anomaly_rate"))


def flagged_sql(share):
    return f"SELECT event_type AS joint_id, count(*) AS total_readings, {share}::DOUBLE AS anomaly_rate FROM events GROUP BY event_type"


def svm_gaps(spark, d):
    """Whether each kernel's boundary has a duality gap below a thousandth, per type."""
    out = None
    for kernel in KERNELS:
        fit_ = fit_svm(event_matrix(spark, d), kernel, 0.05, "scale", 42)
        closed = F.get("numbers", F.lit(GAP_AT)) <= 1e-3 * F.get("numbers", F.lit(SCALE))
        rows = fit_.select(F.lit(kernel).alias("kernel"), "joint_id", closed.alias("closed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def planted(spark, d):
    """The event matrix with every 40th row of a type moved ten units away from all others."""
    far = F.col("seq") % 40 == 7
    moved = F.transform("x", lambda v: F.when(far, F.when(v < 0, v - 10).otherwise(v + 10)).otherwise(v))
    return once(spark, d, "planted", lambda: event_matrix(spark, d).withColumn("x", moved))


def finds_planted(run):
    """Planted rows per type, and whether nine in ten of them are flagged by a detector that flags one row in twenty.
    A score without regard to the data finds about one in twenty."""

    def make(spark, d):
        found = run(planted(spark, d)).where("seq % 40 = 7").groupBy("joint_id").agg(
            F.count("*").alias("planted"), F.avg((F.col("anomaly") == -1).cast("double")).alias("share"))
        return found.select("joint_id", "planted", (F.col("share") >= 0.9).alias("found"))

    return make


PLANTED_SQL = f"""WITH {EVENTS} SELECT joint_id, count(*) AS planted, true AS found FROM s WHERE seq % 40 = 7 GROUP BY joint_id"""


def tree_depths(spark, d):
    """The forest's own measure against the same trees followed in SQL: no row may differ."""
    rows = event_matrix(spark, d)
    models = materialise(fit_forest(rows, 10))
    scores = apply_models(rows, models, forest_score).select("joint_id", "seq", "value")
    trees = models.select("joint_id", "samples", F.posexplode("trees").alias("tree", "t"))
    at = rows.join(trees, "joint_id").select("joint_id", "seq", "samples", "tree", "t", "x", F.lit(0).alias("node"))
    for _ in range(9):  # ceil(log2(256)) levels and the root
        feature = F.get("t.feature", F.col("node"))
        left = F.get("x", F.greatest(feature, F.lit(0))) <= F.get("t.threshold", F.col("node"))
        step = F.when(feature < 0, F.col("node")).when(left, F.get("t.left", F.col("node"))).otherwise(F.get("t.right", F.col("node")))
        at = at.withColumn("node", step)
    depth = at.groupBy("joint_id", "seq", "samples").agg(F.avg(F.get("t.path", F.col("node"))).alias("depth"))
    n = F.col("samples")
    expected = 2 * (F.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    both = scores.join(depth.select("joint_id", "seq", (-F.pow(F.lit(2.0), -F.col("depth") / expected)).alias("want")), ["joint_id", "seq"])
    return both.groupBy("joint_id").agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("value") - F.col("want")) > 1e-9).cast("int").alias("differing"))


def reconstruction(spark, d):
    """The trained autoencoder beats predicting the mean, whose mean squared error is one for scaled columns; an untrained one does not."""
    errors = once(spark, d, "neural_errors", lambda: autoencoder_errors(event_matrix(spark, d), {"epochs": 50}))
    return errors.groupBy("joint_id").agg(F.count("*").alias("rows"), (F.avg("value") < 0.9).alias("better"))


def components(spark, d):
    """Projection on one of two axes (window energy and magnitude mean, both scaled)."""
    scaled = standardise(line_features(spark, d), ["accelerometer_magnitude_energy", "accelerometer_x_rms"])
    return component_errors(scaled, 0.5).select("joint_id", "seq", F.round("value", 6).alias("value"))


# Two standardised columns: the leading axis is (1, s)/sqrt(2) with s the sign of their correlation.
COMPONENTS_SQL = f"""WITH {{lines}} z AS (SELECT joint_id, seq, (energy - avg(energy) OVER j) / stddev_pop(energy) OVER j AS a,
    (rx - avg(rx) OVER j) / stddev_pop(rx) OVER j AS b FROM f WINDOW j AS (PARTITION BY joint_id)),
  c AS (SELECT joint_id, sign(sum(a * b)) AS s FROM z GROUP BY joint_id)
  SELECT joint_id, seq, round(pow(a - s * b, 2) / 4, 6) AS value FROM z JOIN c USING (joint_id)""".replace("{lines}", SCORED[: SCORED.index("e AS (SELECT")])


def scored_labels(spark, d):
    return line_scored(spark, d).select("joint_id", "seq", "anomaly", F.round("anomaly_score", 6).alias("anomaly_score"))


def detect_whole(spark, d):
    """Feature matrix with labels from the default detector at the analysis-wide share."""
    config = registry.with_contamination(None, 0.1)
    series = line_series(spark, d)
    series = series.with_rows(once(spark, d, "line_rows", lambda: series.rows))
    out = registry.detect_anomalies(spared(extract_features(series), series.rows), config)
    return wear.anomaly_rates(out).select("joint_id", "total_readings", F.round("anomaly_rate", 2).alias("anomaly_rate"))


# --- wear --------------------------------------------------------------------------------------
def minimal_chain(spark, d):
    """Events to wear: window energy, distance from its joint's mean, rate, index, status."""
    features = materialise(extract_features(event_series(spark, d), selected=["vibration_energy"]))
    scored = materialise(distance_labels(features, "vibration_energy"))
    out = wear.simple_wear(wear.anomaly_rates(scored), wear.mean_energy(scored))
    return out.select("joint_id", r("anomaly_rate").alias("anomaly_rate"), r("signal_energy").alias("signal_energy"), r("wear_rate").alias("wear_rate"),
                      "wear_index", "wear_status")


STATUS = "CASE WHEN wear_index < 0.3 THEN 'healthy' WHEN wear_index < 0.7 THEN 'moderate' ELSE 'severe' END"
MINIMAL_SQL = f"""WITH {EVENTS}, f AS (SELECT joint_id, sum(v * v) OVER {W} AS energy FROM s),
  e AS (SELECT *, abs(energy - avg(energy) OVER j) / stddev_pop(energy) OVER j AS err FROM f WINDOW j AS (PARTITION BY joint_id)),
  c AS (SELECT joint_id, quantile_cont(err, 0.9) AS cut FROM e GROUP BY joint_id),
  a AS (SELECT joint_id, count(*) FILTER (err > cut) / count(*) AS anomaly_rate, avg(energy) AS signal_energy FROM e JOIN c USING (joint_id) GROUP BY joint_id),
  w AS (SELECT *, anomaly_rate * signal_energy AS wear_rate FROM a),
  i AS (SELECT *, round((wear_rate - min(wear_rate) OVER ()) / (max(wear_rate) OVER () - min(wear_rate) OVER ()), 4) AS wear_index FROM w)
  SELECT joint_id, {R('anomaly_rate')} AS anomaly_rate, {R('signal_energy')} AS signal_energy, {R('wear_rate')} AS wear_rate, wear_index, {STATUS} AS wear_status FROM i"""


def rates(spark, d):
    return wear.anomaly_rates(line_scored(spark, d)).select("joint_id", "total_readings", "anomaly_count", r("anomaly_rate").alias("anomaly_rate"))


def energies(spark, d):
    return wear.mean_energy(line_scored(spark, d)).select("joint_id", r("signal_energy").alias("signal_energy"))


def parameters(spark, d):
    """User values per flag and status, derived from the table; some fields stay open."""
    joints = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("joint_id")).agg(F.max("l_quantity").alias("q"))
    first = F.col("joint_id") < "B"
    return joints.select(
        "joint_id", (F.col("q") + 10).alias("load_force"), F.lit(None).cast("double").alias("joint_radius"),
        F.when(first, "red ring").otherwise("no such").alias("material"), F.lit(0.25).alias("lubrication_coefficient"),
        F.lit(None).cast("double").alias("contact_area"), F.when(F.col("joint_id") > "R", 450.0).alias("hardness"),
        F.when(F.col("joint_id") < "AF~", 0.5).alias("sliding_velocity"))


def merged(spark, d):
    joints = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("joint_id")).distinct()
    defaults = wear.default_parameters(joints.unionByName(spark.createDataFrame([("base",), ("wrist_3",)], "joint_id string")))
    return wear.merge_parameters(defaults, parameters(spark, d))


PARAMS = """dp AS (SELECT DISTINCT l_returnflag || l_linestatus AS joint_id FROM lineitem UNION ALL VALUES ('base'), ('wrist_3')),
  up AS (SELECT l_returnflag || l_linestatus AS joint_id, max(l_quantity) + 10 AS load_force FROM lineitem GROUP BY ALL),
  pr AS (SELECT dp.joint_id, CAST(coalesce(up.load_force, CASE dp.joint_id WHEN 'base' THEN 120 WHEN 'wrist_3' THEN 20 ELSE 50 END) AS DOUBLE) AS load_force,
    CAST(CASE dp.joint_id WHEN 'base' THEN 0.06 WHEN 'wrist_3' THEN 0.025 ELSE 0.04 END AS DOUBLE) AS joint_radius,
    CASE WHEN up.joint_id IS NULL THEN 'Hardened Steel' WHEN dp.joint_id < 'B' THEN 'red ring' ELSE 'no such' END AS material,
    CAST(CASE WHEN up.joint_id IS NULL THEN 0.5 ELSE 0.25 END AS DOUBLE) AS lubrication_coefficient,
    CAST(CASE dp.joint_id WHEN 'base' THEN 2e-4 WHEN 'wrist_3' THEN 4e-5 ELSE 1e-4 END AS DOUBLE) AS contact_area,
    CAST(CASE WHEN up.joint_id > 'R' THEN 450 END AS DOUBLE) AS hardness, CAST(CASE WHEN up.joint_id < 'AF~' THEN 0.5 END AS DOUBLE) AS sliding_velocity
    FROM dp LEFT JOIN up USING (joint_id))"""


def defaults_only(spark, d):
    joints = table(spark, d, "events").select(F.col("event_type").alias("joint_id")).distinct()
    return wear.default_parameters(joints).drop("hardness", "sliding_velocity")


def k_effective(spark, d):
    rows = wear.anomaly_rates(line_scored(spark, d)).join(merged(spark, d), "joint_id")
    return rows.select("joint_id", F.round(wear.effective_k(F.col("anomaly_rate"), F.col("lubrication_coefficient")), 8).alias("k_eff"))


def hardness(spark, d):
    return wear.resolve_hardness(merged(spark, d), catalogue(spark, d)).select("joint_id", "material", "hardness")


HARD = """hd AS (SELECT pr.*, coalesce(pr.hardness, (SELECT min_by(cat.hardness, cat.position) FROM cat WHERE contains(lower(cat.material_name), lower(pr.material))), 600.0)::DOUBLE AS h FROM pr)"""


def distance(spark, d):
    rows = wear.motion_summary(line_scored(spark, d)).join(merged(spark, d), "joint_id")
    return rows.select("joint_id", F.round(wear.sliding_distance(RATE_HZ), 6).alias("sliding_distance"))


DIST = """mo AS (SELECT joint_id, count(*) AS n, avg((rx + ry + rz + rv) / 4) AS level FROM sc GROUP BY joint_id),
  ds AS (SELECT mo.joint_id, CASE WHEN hd.sliding_velocity IS NOT NULL THEN hd.sliding_velocity * 0.05 * n ELSE level * 0.05 * 0.05 * n * hd.joint_radius END AS s
    FROM mo JOIN hd USING (joint_id))"""


def distance_by(kind, keep, rename=None):
    """The same motion as another kind of signal."""

    def make(spark, d):
        scored_ = line_scored(spark, d)
        names = [c for c in scored_.columns if c.endswith(keep)] if keep else []
        rows = scored_.select("joint_id", *[F.col(c).alias(c.replace("accelerometer", rename) if rename else c) for c in names])
        out = wear.motion_summary(rows).join(merged(spark, d), "joint_id")
        return out.select("joint_id", "kind", F.round(wear.sliding_distance(RATE_HZ), 6).alias("sliding_distance")).where(F.col("kind") == kind)

    return make


def distance_sql(kind, level, s):
    return f"""WITH {SCORED}, {CATALOGUE}, {PARAMS}, mo AS (SELECT joint_id, count(*) AS n, {level} AS level FROM sc GROUP BY joint_id)
  SELECT mo.joint_id, '{kind}' AS kind, round(CASE WHEN pr.sliding_velocity IS NOT NULL THEN pr.sliding_velocity * 0.05 * n ELSE {s} END, 6) AS sliding_distance
  FROM mo JOIN pr USING (joint_id)"""


def physics(spark, d):
    scored = line_scored(spark, d)
    return wear.physics_wear(wear.anomaly_rates(scored), wear.mean_energy(scored), scored, merged(spark, d), catalogue(spark, d), RATE_HZ)


def line_wear(spark, d):
    return once(spark, d, "line_wear", lambda: physics(spark, d))


def physics_view(spark, d):
    return physics(spark, d).select("joint_id", r("anomaly_rate").alias("anomaly_rate"), r("signal_energy").alias("signal_energy"), "load_force", "sliding_distance",
                                    "hardness", "k_eff", r(F.col("wear_volume") * 1e3).alias("wear_volume"), "wear_index", "wear_status")


PHYSICS = f"""WITH {SCORED}, {CATALOGUE}, {PARAMS}, {HARD}, {DIST},
  ra AS (SELECT joint_id, count(*) FILTER (anomaly = -1) / count(*) AS anomaly_rate, avg(energy) AS signal_energy FROM sc GROUP BY joint_id),
  ph AS (SELECT ra.*, hd.load_force, ds.s, hd.h, 1e-4::DOUBLE * (1 + 10 * ra.anomaly_rate) * (1 - 0.5 * hd.lubrication_coefficient) AS k
    FROM ra JOIN hd USING (joint_id) JOIN ds USING (joint_id)),
  vo AS (SELECT *, k * load_force * s / h AS wear_volume FROM ph),
  wr AS (SELECT *, wear_volume AS wear_rate, CASE WHEN max(wear_volume) OVER () - min(wear_volume) OVER () < 1e-18 THEN 0.5::DOUBLE ELSE
    round((wear_volume - min(wear_volume) OVER ()) / (max(wear_volume) OVER () - min(wear_volume) OVER ()), 4) END AS wear_index FROM vo)"""


def volume_only(spark, d):
    """Archard volume of every line: load from quantity, distance from price, hardness zero on some rows."""
    rows = table(spark, d, "lineitem")
    v = wear.archard_volume(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_suppkey") + 100.0), F.lit(1e-4))
    return rows.groupBy("l_linenumber").agg(r(F.sum(v)).alias("volume"))


# --- materials and projections ------------------------------------------------------------------
def ranked(spark, d):
    return materials.rank_materials(line_wear(spark, d), catalogue(spark, d))


RANK = f"""{PHYSICS}, cw AS (SELECT least(avg(signal_energy) / greatest(max(signal_energy), 1e-9), 1) AS fw, least(avg(anomaly_rate) / 0.3, 1) AS hw FROM wr),
  mx AS (SELECT max(wear_coefficient) AS c, max(friction_coefficient) AS f, max(hardness) AS h, min(density) AS dn, min(cost_factor) AS co FROM cat),
  r1 AS (SELECT cat.*, greatest(round((1 - wear_coefficient / c) * 100, 2), 0) AS wear_reduction_pct, fw, hw, mx.c AS mc, mx.f AS mf, mx.h AS mh, mx.dn AS md, mx.co AS mk FROM cat, mx, cw),
  rk AS (SELECT *, round(pow(wear_reduction_pct / 100, 1.5) * (1 + 0.35 * fw * (1 - friction_coefficient / mf) + 0.35 * hw * (hardness / mh)) * 100
    / (density / md * sqrt(cost_factor / mk)), 2) AS practicality_score FROM r1)"""
RANK_OUT = f"material_name, {R('wear_coefficient')} AS wear_coefficient, hardness, {R('friction_coefficient')} AS friction_coefficient, density, wear_reduction_pct, practicality_score"


def ranked_view(df):
    return df.withColumns({"wear_coefficient": r("wear_coefficient"), "friction_coefficient": r("friction_coefficient")})


def by_reduction(spark, d):
    out = materials.by_wear_reduction(ranked(spark, d))
    return out.select("material_name", "wear_reduction_pct")


def trajectories(spark, d):
    return projection.project_wear(line_wear(spark, d))


def _points_sql(source, rate, extra=""):
    grow = f"pow(1 + 1.5 * 5 * ({rate}) / 100, time / 5)"
    return (f"SELECT joint_id, CAST(time AS INTEGER) AS time, round(CASE WHEN time = 0 THEN wear_index ELSE least((wear_index + 1 / 1.5::DOUBLE) * {grow} - 1 / 1.5::DOUBLE, 1) END, 4) "
            f"AS projected_wear{extra} FROM {source}, (SELECT unnest(range(0, 101, 5)) AS time)")


TOP_RATE = "wear_rate / (SELECT CASE WHEN max(wear_rate) < 1e-12 THEN 1 ELSE max(wear_rate) END FROM wr)"
PROJECT = f"{PHYSICS}, tr AS ({_points_sql('wr', TOP_RATE)})"
CURRENT = "Current Material (assumed worst-case)"
SCENARIOS = f"""{RANK}, tr AS ({_points_sql('wr', TOP_RATE)}), b3 AS (SELECT material_name FROM rk ORDER BY practicality_score DESC, material_name LIMIT 3),
  wm AS (SELECT wr.joint_id, wr.wear_index, wr.wear_rate, cat.material_name, cat.wear_coefficient / mx.c AS ratio FROM wr, cat, mx WHERE cat.material_name IN (SELECT material_name FROM b3)),
  scn AS (SELECT *, '{CURRENT}' AS material_name FROM tr UNION ALL SELECT joint_id, time, projected_wear, material_name FROM ({_points_sql('wm', f'{TOP_RATE} * ratio', ', material_name')}))"""


def every_material(spark, d):
    """All part brands as materials: the softest coefficient of each."""
    brands = table(spark, d, "part").groupBy(F.col("p_brand").alias("material_name")).agg((F.min((F.col("p_retailprice") - 899) / 10000)).alias("wear_coefficient"))
    baseline = brands.agg(F.max("wear_coefficient")).scalar()
    return projection.project_materials(line_wear(spark, d), brands, baseline)


EVERY_SQL = f"""{PHYSICS}, br AS (SELECT p_brand AS material_name, min((p_retailprice - 899) / 10000) AS c FROM part GROUP BY p_brand),
  wm AS (SELECT wr.joint_id, wear_index, wear_rate, material_name, c / (SELECT max(c) FROM br) AS ratio FROM wr, br)
  {_points_sql('wm', f'{TOP_RATE} * ratio', ', material_name')}"""


def scenarios(spark, d):
    return projection.material_scenarios(line_wear(spark, d), catalogue(spark, d), ranked=ranked(spark, d))


def scenarios_by_coefficient(spark, d):
    return projection.material_scenarios(line_wear(spark, d), catalogue(spark, d))


COEFFICIENT_SQL = SCENARIOS.replace("SELECT material_name FROM rk ORDER BY practicality_score DESC, material_name LIMIT 3",
                                    "SELECT material_name FROM cat ORDER BY wear_coefficient, material_name LIMIT 3")


def wide_joints(spark, d):
    joints = sorted(x[0] for x in line_wear(spark, d).select("joint_id").collect())
    out = projection.wide_by_joint(trajectories(spark, d), joints)
    return out.unpivot(["time"], joints, "joint_id", "wear")


def wide_materials(spark, d):
    first = line_wear(spark, d).agg(F.min("joint_id")).first()[0]
    wide = projection.wide_by_material(scenarios(spark, d), first)
    names = [c for c in wide.columns if c != "time"]
    return wide.select("time", F.col(f"`{CURRENT}`").alias("current"), F.least(*[F.col(f"`{n}`") for n in names]).alias("best"))


def value_range(spark, d):
    out = projection.padded_range(scenarios(spark, d))
    return out.select(r("low").alias("low"), r("high").alias("high"))


def nested(spark, d):
    text = F.transform("trajectory", lambda p: F.format_string("%d:%.4f", p["time"], p["projected_wear"]))
    return presentation.nested_trajectories(trajectories(spark, d)).select("joint_id", F.array_join(text, ",").alias("trajectory"))


def nested_scenarios(spark, d):
    text = F.transform("trajectory", lambda p: F.format_string("%d:%.4f", p["time"], p["projected_wear"]))
    return presentation.nested_trajectories(scenarios(spark, d), ("joint_id", "material_name")).select("joint_id", "material_name", F.array_join(text, ",").alias("trajectory"))


NEST = "string_agg(printf('%d:%.4f', time, projected_wear), ',' ORDER BY time) AS trajectory"


def report(spark, d, section):
    joints = sorted(x[0] for x in line_wear(spark, d).select("joint_id").collect())
    return presentation.report_tables(line_wear(spark, d), ranked(spark, d), trajectories(spark, d), joints)[section]


QUERIES = {
    "detect_local_outlier_factor": (lof, f"{_lof_sql(20, 'l2')} SELECT joint_id, seq, {R('value')} AS value FROM lf"),
    "detect_local_outlier_factor_blocks": (lof_blocks, f"{_lof_sql(20, 'l2')} SELECT joint_id, seq, {R('value')} AS value FROM lf"),
    "detect_local_outlier_factor_l1": (lof_manhattan, f"{_lof_sql(5, 'l1')} SELECT joint_id, seq, {R('value')} AS value FROM lf"),
    "detect_local_outlier_factor_cosine": (lof_cosine, f"{_lof_sql(10, 'cosine')} SELECT joint_id, seq, {R('value')} AS value FROM lf"),
    "detect_local_outlier_factor_l3": (lof_cubic, f"{_lof_sql(10, 'l3')} SELECT joint_id, seq, {R('value')} AS value FROM lf"),
    "detect_local_outlier_projected": (lof_projected, "SELECT 'all' AS joint_id, count(*) AS vectors, true AS found FROM embeddings"),
    "detect_local_outlier_labels": (lof_labels, LOF_LABEL_SQL),
    "detect_isolation_forest": (forest, None),
    "detect_one_class_svm": (svm, None),
    "detect_one_class_svm_gaps": (svm_gaps, "SELECT kernel, event_type AS joint_id, true AS closed FROM (SELECT DISTINCT event_type FROM events), "
                                  "(SELECT unnest(['rbf', 'linear', 'poly', 'sigmoid']) AS kernel)"),
    "detect_autoencoder": (neural, None),
    "detect_isolation_forest_planted": (finds_planted(lambda rows: isolation_forest(rows, {"contamination": 0.05})), PLANTED_SQL),
    "detect_one_class_svm_planted": (finds_planted(lambda rows: one_class_svm(rows, {"nu": 0.05})), PLANTED_SQL),
    "detect_autoencoder_planted": (finds_planted(lambda rows: autoencoder(rows, {"contamination": 0.05})), PLANTED_SQL),
    "detect_isolation_forest_depths": (tree_depths, "SELECT event_type AS joint_id, count(*) AS rows, 0 AS differing FROM events GROUP BY event_type"),
    "detect_autoencoder_reconstruction": (reconstruction, "SELECT event_type AS joint_id, count(*) AS rows, true AS better FROM events GROUP BY event_type"),
    "detect_isolation_forest_rates": (flagged(forest), flagged_sql(0.1)),
    "detect_one_class_svm_rates": (flagged(svm), flagged_sql(0.05)),
    "detect_autoencoder_rates": (flagged(neural), flagged_sql(0.1)),
    "detect_principal_components": (components, COMPONENTS_SQL),
    "detect_error_labels": (scored_labels, f"WITH {SCORED} SELECT joint_id, seq, anomaly, round(anomaly_score, 6) AS anomaly_score FROM sc"),
    "detect_default_model_rates": (detect_whole, "SELECT l_returnflag || l_linestatus AS joint_id, count(*) AS total_readings, 0.1::DOUBLE AS anomaly_rate FROM lineitem GROUP BY ALL"),
    "wear_minimal_chain": (minimal_chain, MINIMAL_SQL),
    "wear_anomaly_rates": (rates, f"WITH {SCORED} SELECT joint_id, count(*) AS total_readings, count(*) FILTER (anomaly = -1) AS anomaly_count, "
                           f"{R('count(*) FILTER (anomaly = -1) / count(*)')} AS anomaly_rate FROM sc GROUP BY joint_id"),
    "wear_mean_energy": (energies, f"WITH {SCORED} SELECT joint_id, {R('avg(energy)')} AS signal_energy FROM sc GROUP BY joint_id"),
    "wear_default_parameters": (defaults_only, "SELECT DISTINCT event_type AS joint_id, 50.0::DOUBLE AS load_force, 0.04::DOUBLE AS joint_radius, 'Hardened Steel' AS material, "
                                "0.5::DOUBLE AS lubrication_coefficient, 1e-4::DOUBLE AS contact_area FROM events"),
    "wear_merged_parameters": (merged, f"WITH {PARAMS} SELECT * FROM pr"),
    "wear_effective_k": (k_effective, f"{PHYSICS} SELECT joint_id, round(k, 8) AS k_eff FROM wr"),
    "wear_hardness_lookup": (hardness, f"WITH {CATALOGUE}, {PARAMS}, {HARD} SELECT joint_id, material, h AS hardness FROM hd"),
    "wear_sliding_distance": (distance, f"{PHYSICS} SELECT joint_id, round(s, 6) AS sliding_distance FROM ds"),
    "wear_sliding_distance_gyroscope": (distance_by("gyroscope", "_rms", "gyroscope"), distance_sql("gyroscope", "avg((rx + ry + rz + rv) / 4)", "level * joint_radius * 0.05 * n")),
    "wear_sliding_distance_energy": (distance_by("energy", "magnitude_energy"), distance_sql("energy", "avg(energy)", "sqrt(level) * joint_radius * 0.01")),
    "wear_sliding_distance_none": (distance_by("none", None), distance_sql("none", "NULL", "1.0")),
    "wear_archard_volume": (volume_only, f"SELECT l_linenumber, {R('sum(1e-4::DOUBLE * l_quantity * l_extendedprice / 1000 / CASE WHEN l_linenumber = 1 THEN 600 ELSE l_suppkey + 100 END)')} AS volume "
                            "FROM lineitem GROUP BY l_linenumber"),
    "wear_physics": (physics_view, f"{PHYSICS} SELECT joint_id, {R('anomaly_rate')} AS anomaly_rate, {R('signal_energy')} AS signal_energy, load_force, round(s, 6) AS sliding_distance, h AS hardness, "
                     f"round(k, 8) AS k_eff, {R('wear_volume * 1e3')} AS wear_volume, wear_index, {STATUS} AS wear_status FROM wr"),
    "materials_condition_weights": (lambda s, d: rounded(materials.condition_weights(line_wear(s, d)), ["friction_weight", "hardness_weight"]),
                                    f"{RANK} SELECT {R('fw')} AS friction_weight, {R('hw')} AS hardness_weight FROM cw"),
    "materials_worst_joint": (lambda s, d: materials.worst_joint(line_wear(s, d)).select("joint_id", "wear_index"),
                              f"{PHYSICS} SELECT joint_id, wear_index FROM wr ORDER BY wear_index DESC, joint_id LIMIT 1"),
    "materials_ranked": (lambda s, d: ranked_view(ranked(s, d)), f"{RANK} SELECT {RANK_OUT} FROM rk"),
    "materials_by_wear_reduction": (by_reduction, f"{RANK} SELECT material_name, wear_reduction_pct FROM rk"),
    "materials_relative_score": (lambda s, d: materials.relative_score(ranked(s, d)).select("material_name", r("relative_score").alias("relative_score")),
                                 f"{RANK} SELECT material_name, {R('practicality_score / max(practicality_score) OVER ()')} AS relative_score FROM rk"),
    "project_wear": (trajectories, f"{PROJECT} SELECT * FROM tr"),
    "project_every_material": (every_material, EVERY_SQL),
    "project_scenarios_ranked": (scenarios, f"{SCENARIOS} SELECT * FROM scn"),
    "project_scenarios_by_coefficient": (scenarios_by_coefficient, f"{COEFFICIENT_SQL} SELECT * FROM scn"),
    "project_wide_by_joint": (wide_joints, f"{PROJECT} SELECT time, joint_id, projected_wear AS wear FROM tr"),
    "project_wide_by_material": (wide_materials, f"{SCENARIOS} SELECT time, max(projected_wear) FILTER (material_name = '{CURRENT}') AS current, min(projected_wear) AS best "
                                 "FROM scn WHERE joint_id = (SELECT min(joint_id) FROM scn) GROUP BY time"),
    "project_value_range": (value_range, f"{SCENARIOS}, lh AS (SELECT min(projected_wear) AS lo, max(projected_wear) AS hi FROM scn) SELECT {R('greatest(lo - (hi - lo) * 0.15, 0)')} AS low, "
                            f"{R('hi + (hi - lo) * 0.15')} AS high FROM lh"),
    "report_wear_view": (lambda s, d: presentation.wear_view(line_wear(s, d)), f"{PHYSICS} SELECT joint_id, round(anomaly_rate, 4) AS anomaly_rate, round(signal_energy, 2) AS signal_energy, "
                         f"round(wear_index, 3) AS wear_index, {STATUS} AS wear_status FROM wr"),
    "report_nested_trajectories": (nested, f"{PROJECT} SELECT joint_id, {NEST} FROM tr GROUP BY joint_id"),
    "report_nested_scenarios": (nested_scenarios, f"{SCENARIOS} SELECT joint_id, material_name, {NEST} FROM scn GROUP BY ALL"),
    "report_joint_section": (lambda s, d: report(s, d, "joints"), f"{PHYSICS} SELECT joint_id AS joint, printf('%.2f', wear_index * 100) AS wear_index_pct, {STATUS} AS status, "
                             "printf('%.2f', anomaly_rate * 100) AS anomaly_rate_pct, printf('%.2f', signal_energy) AS signal_energy FROM wr"),
    "report_material_section": (lambda s, d: report(s, d, "materials").select("material", "wear_reduction_pct", "hardness", "wear_coefficient"),
                                f"{RANK} SELECT material_name AS material, printf('%.2f', wear_reduction_pct) AS wear_reduction_pct, printf('%.1f', hardness) AS hardness, "
                                "regexp_replace(printf('%.3e', wear_coefficient), 'e([+-])0(\\d)', 'e\\1\\2') AS wear_coefficient FROM rk"),
    "report_trajectory_section": (lambda s, d: report(s, d, "trajectories").unpivot(["time"], sorted(x[0] for x in line_wear(s, d).select("joint_id").collect()), "joint_id", "wear"),
                                  f"{PROJECT} SELECT time, joint_id, printf('%.4f', projected_wear) AS wear FROM tr"),
    "report_fleet_summary": (lambda s, d: presentation.fleet_summary(line_wear(s, d), catalogue(s, d)).withColumn("mean_wear", r("mean_wear")),
                             f"{PHYSICS} SELECT count(*) AS joints, count(*) FILTER (wear_index >= 0.7) AS severe_joints, {R('avg(wear_index)')} AS mean_wear, "
                             "(SELECT count(*) FROM cat) AS materials FROM wr"),
    "report_joints_by_wear": (lambda s, d: presentation.by_wear(line_wear(s, d)).select("joint_id", "wear_index", "wear_status"),
                              f"{PHYSICS} SELECT joint_id, wear_index, {STATUS} AS wear_status FROM wr"),
}
