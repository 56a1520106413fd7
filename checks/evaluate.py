"""Diagnostics and presentation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fixtures import LINE_TIES, R, SCORED, catalogue, event_series, line_features, line_scored, line_series, once, r, rounded, table
from tribospark.operators import evaluation, presentation
from tribospark.operators.detect import registry
from tribospark.operators.detect.registry import ModelConfig
from tribospark.operators.features import extract_features
from tribospark.plans import analysis
from tribospark.session import materialise


def labelled(spark, d):
    """Scored lines with the order status as ground truth, under an accepted label name."""
    return line_scored(spark, d).withColumn("fault", F.when(F.substring("joint_id", 2, 1) == "O", "fault").otherwise("OK"))


def by_flag(spark, d):
    rows = evaluation.with_truth(labelled(spark, d), "fault")
    return rows.withColumn("joint_id", F.substring("joint_id", 1, 1))


TRUTH = f"""{SCORED}, tr AS (SELECT substr(joint_id, 1, 1) AS joint_id, CASE WHEN substr(joint_id, 2, 1) = 'O' THEN 1 ELSE 0 END AS truth, anomaly, anomaly_score FROM sc)"""


def clusters(spark, d):
    """Embeddings as a scored matrix: the last two labels count as anomalous."""
    e = table(spark, d, "embeddings")
    return e.select(F.lit("all").alias("joint_id"), F.col("vec_id").alias("seq"), F.when(F.col("label") >= 8, -1).otherwise(1).alias("anomaly"),
                    F.col("embedding").cast("array<double>").alias("x"))


CLUSTERS = """cl AS (SELECT vec_id, CASE WHEN label >= 8 THEN -1 ELSE 1 END AS anomaly, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"""
SILHOUETTE_SQL = f"""WITH {CLUSTERS}, dd AS (SELECT a.vec_id, a.anomaly, b.anomaly AS other, sum(list_distance(a.x, b.x) ** 2) AS sd, count(*) AS n FROM cl a, cl b GROUP BY ALL),
  ab AS (SELECT vec_id, sum(CASE WHEN anomaly = other THEN sd / (n - 1) END) AS a, sum(CASE WHEN anomaly <> other THEN sd / n END) AS b FROM dd GROUP BY vec_id)
  SELECT round(avg((b - a) / greatest(a, b)), 4) AS silhouette_score FROM ab"""
EUCLIDEAN_SQL = SILHOUETTE_SQL.replace("list_distance(a.x, b.x) ** 2", "list_distance(a.x, b.x)")


def silhouette_bounds(spark, d):
    """With 64 references a label, do the bounds hold the silhouette that comparing all pairs gives?"""
    exact = evaluation.euclidean_silhouette(clusters(spark, d), 1 << 20).first()[0]
    return evaluation.reference_silhouette(clusters(spark, d), 64).select(
        ((F.col("low") <= exact + 1e-4) & (F.col("high") >= exact - 1e-4)).alias("holds"), (F.col("high") - F.col("low") < 0.1).alias("narrow"))


CH_SQL = f"""WITH {CLUSTERS}, ce AS (SELECT anomaly, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM cl), gm AS (SELECT i, avg(v) AS g FROM ce GROUP BY i),
  st AS (SELECT anomaly, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM ce GROUP BY ALL)
  SELECT round(sum(n * (m - g) * (m - g)) * ((SELECT count(*) FROM cl) - 2) / sum(n * s), 4) AS calinski_harabasz_score FROM st JOIN gm USING (i)"""

ALL = "al AS (SELECT joint_id, anomaly, anomaly_score AS v FROM sc UNION ALL SELECT 'all_joints', anomaly, anomaly_score FROM sc)"
DIST_COLUMNS = ["mean", "std", "min", "max", "median", "q25", "q75", "anomaly_rate"]


def distribution(spark, d):
    return rounded(evaluation.score_distribution(line_scored(spark, d)), DIST_COLUMNS)


DIST_SQL = f"""WITH {SCORED}, {ALL} SELECT joint_id, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std, {R('min(v)')} AS min, {R('max(v)')} AS max, {R('quantile_cont(v, 0.5)')} AS median,
  {R('quantile_cont(v, 0.25)')} AS q25, {R('quantile_cont(v, 0.75)')} AS q75, count(*) AS n_total, count(*) FILTER (anomaly = -1) AS n_anomalies,
  {R('count(*) FILTER (anomaly = -1) / count(*)')} AS anomaly_rate FROM al GROUP BY joint_id"""


def histogram(spark, d):
    return evaluation.score_histogram(line_scored(spark, d)).withColumn("count", F.col("count").cast("long"))


HIST_SQL = f"""WITH {SCORED}, {ALL}, sp AS (SELECT joint_id, min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM al GROUP BY joint_id),
  bn AS (SELECT joint_id, least(floor((v - lo) / w), 29) AS bin FROM al JOIN sp USING (joint_id)), ct AS (SELECT joint_id, bin, count(*) AS c FROM bn GROUP BY ALL)
  SELECT sp.joint_id, b.bin, round(lo + b.bin * w, 6) AS left_edge, round(lo + (b.bin + 1) * w, 6) AS right_edge, coalesce(c, 0) AS "count"
  FROM sp CROSS JOIN (SELECT unnest(range(0, 30)) AS bin) b LEFT JOIN ct ON ct.joint_id = sp.joint_id AND ct.bin = b.bin"""


def sweep(spark, d, direction="above"):
    return evaluation.threshold_sweep(line_scored(spark, d), direction=direction).select(F.col("point").cast("long").alias("point"), "threshold", "n_anomalies", "anomaly_rate")


def _sweep_sql(op):
    probs = ", ".join(repr(i / 49) for i in range(50))
    return f"""WITH {SCORED}, q AS (SELECT unnest(range(0, 50)) AS point, unnest(quantile_cont(anomaly_score, [{probs}])) AS cut_at FROM sc)
  SELECT point, round(cut_at, 6) AS threshold, (SELECT count(*) FROM sc WHERE anomaly_score {op} cut_at) AS n_anomalies,
    round((SELECT count(*) FROM sc WHERE anomaly_score {op} cut_at) / (SELECT count(*) FROM sc), 4) AS anomaly_rate FROM q"""


def truth_found(spark, d):
    rows = labelled(spark, d)
    name = evaluation.truth_column(rows)
    return rows.agg(F.count_distinct(name).alias("classes")).withColumn("label_column", F.lit(name))


def truth_values(spark, d):
    """Text labels and signed numbers (line number odd or even)."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_linenumber") % 2 * 2 - 1).alias("signed"), F.col("l_suppkey").alias("count"))
    text = lines.withColumn("status", F.when(F.col("l_returnflag") == "N", " Normal").when(F.col("l_returnflag") == "A", "FALSE").otherwise("broken"))
    out = evaluation.with_truth(evaluation.with_truth(evaluation.with_truth(text, "status", "by_text"), "signed", "by_sign"), "count", "by_number")
    return out.groupBy("l_returnflag", "l_linenumber").agg(F.sum("by_text").alias("by_text"), F.sum("by_sign").alias("by_sign"), F.sum("by_number").alias("by_number"))


TRUTH_SQL = """SELECT l_returnflag, l_linenumber, CAST(sum(CASE WHEN l_returnflag IN ('N', 'A') THEN 0 ELSE 1 END) AS BIGINT) AS by_text,
  CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS by_sign, CAST(sum(CASE WHEN l_suppkey <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS by_number FROM lineitem GROUP BY ALL"""
CM_SQL = f"""WITH {TRUTH}, ug AS (SELECT * FROM tr UNION ALL SELECT 'all_joints', truth, anomaly, anomaly_score FROM tr),
  c AS (SELECT joint_id, count(*) FILTER (truth = 1 AND anomaly = -1) AS tp, count(*) FILTER (truth = 0 AND anomaly = -1) AS fp, count(*) FILTER (truth = 0 AND anomaly = 1) AS tn,
    count(*) FILTER (truth = 1 AND anomaly = 1) AS fn FROM ug GROUP BY joint_id), p AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM c)
  SELECT joint_id, tp, fp, tn, fn, round(pr, 4) AS precision, round(rc, 4) AS recall, round(2 * pr * rc / greatest(pr + rc, 1e-9), 4) AS f1_score,
    round((tp + tn) / (tp + fp + tn + fn), 4) AS accuracy, tn + fp AS support_normal, tp + fn AS support_anomaly FROM p"""


ROC = f"""{TRUTH}, g AS (SELECT anomaly_score AS s, sum(truth) AS p, sum(1 - truth) AS n FROM tr GROUP BY ALL),
  cu AS (SELECT s, sum(p) OVER o AS tp, sum(n) OVER o AS fp, lead(p) OVER o AS p2, lead(n) OVER o AS n2, p, n, row_number() OVER o AS i, count(*) OVER () AS k FROM g WINDOW o AS (ORDER BY s)),
  pt AS (SELECT -s AS th, tp, fp FROM cu WHERE i = 1 OR i = k OR p2 <> p OR n2 <> n UNION ALL SELECT 'inf'::DOUBLE, 0, 0)"""
ROC_SQL = f"""WITH {ROC} SELECT row_number() OVER (ORDER BY th DESC) - 1 AS point, round(fp / (SELECT sum(1 - truth) FROM tr), 4) AS fpr, round(tp / (SELECT sum(truth) FROM tr), 4) AS tpr,
  round(th, 6) AS threshold FROM pt"""
AUC_SQL = f"""WITH {TRUTH}, g AS (SELECT anomaly_score AS s, sum(truth) AS p, sum(1 - truth) AS n FROM tr GROUP BY ALL), cu AS (SELECT *, sum(p) OVER (ORDER BY s) AS tp FROM g)
  SELECT round(sum(n * (2 * tp - p) / 2) / ((SELECT sum(truth) FROM tr) * (SELECT sum(1 - truth) FROM tr)), 4) AS auc FROM cu"""


def thinned_curve(spark, d):
    return evaluation.thinned_points(evaluation.roc_points(materialise(evaluation.roc_steps(by_flag(spark, d)))))


THIN_SQL = ROC_SQL.replace("SELECT row_number() OVER (ORDER BY th DESC) - 1 AS point", "SELECT * FROM (SELECT row_number() OVER (ORDER BY th DESC) - 1 AS point") + """)
  WHERE (SELECT count(*) FROM pt) <= 200 OR point IN (SELECT k * ((SELECT count(*) FROM pt) - 1) // 199 FROM range(200) t(k))"""


def importance(spark, d):
    out = evaluation.correlation_importance(line_scored(spark, d))
    return out.select("feature", "importance", F.col("rank").cast("long").alias("rank"))


_FEATURES = {"accelerometer_x_rms": "rx", "accelerometer_y_rms": "ry", "accelerometer_z_rms": "rz", "accelerometer_magnitude_rms": "rv",
             "accelerometer_magnitude_mean": "mean", "accelerometer_magnitude_energy": "energy"}
IMPORTANCE_SQL = f"""WITH {SCORED}, c AS ({' UNION ALL '.join(f"SELECT {i} AS place, '{n}' AS feature, abs(corr({c}, anomaly_score)) AS raw FROM sc" for i, (n, c) in enumerate(_FEATURES.items()))})
  SELECT feature, round(raw / max(raw) OVER (), 4) AS importance, row_number() OVER (ORDER BY raw DESC, place) AS rank FROM c"""


def permutation(spark, d):
    """All features of the events, 100 trees and five repeats: the operators' defaults."""
    features = once(spark, d, "event_features", lambda: extract_features(event_series(spark, d)))
    return evaluation.permutation_importance(features, registry.with_contamination(None, 0.1))


def permutation_planted(spark, d):
    """A column without any spread can't matter, so shuffling it changes no score; the other one then leads."""
    features = once(spark, d, "event_pair", lambda: extract_features(event_series(spark, d), selected=["vibration_rms", "vibration_jerk"]))
    pair = features.select("joint_id", "seq", "timestamp", F.lit(3.0).alias("vibration_still"), "vibration_rms")
    out = evaluation.permutation_importance(pair, ModelConfig("isolation_forest", {"contamination": 0.1, "n_estimators": 20}), repeats=2)
    return out.select("feature", "importance", F.col("rank").cast("long").alias("rank"))


def comparison_facts(spark, d):
    """Both detectors flag their share of all rows, and the best is the one of the highest silhouette."""
    rows = once(spark, d, "compared", lambda: comparison(spark, d))
    top = F.max_by("model_id", "silhouette_score")
    return rows.agg(F.count("*").alias("models"), F.count_if(F.abs(F.col("anomaly_rate") - 0.1) < 0.01).alias("of_share"),
                    (top == F.max_by("model_id", F.col("best").cast("int"))).alias("best_is_highest"))


def comparison_facts_all(spark, d):
    """As ``comparison_facts``, of all detectors."""
    rows = once(spark, d, "compared_all", lambda: comparison(spark, d, tuple(registry.MODELS)))
    top = F.max_by("model_id", "silhouette_score")
    return rows.agg(F.count("*").alias("models"), (top == F.max_by("model_id", F.col("best").cast("int"))).alias("best_is_highest"))


def report_tables(spark, d):
    """Row counts of every table in the combined report."""
    parts = evaluation.diagnostics(labelled(spark, d), truth="fault")
    out = None
    for name, part in parts.items():
        if name in ("roc", "importance", "histograms", "distributions", "thresholds", "confusion"):
            row = part.agg(F.count("*").alias("rows")).withColumn("part", F.lit(name))
            out = row if out is None else out.unionByName(row)
    return out


REPORT_SQL = f"""WITH {TRUTH}, j AS (SELECT count(DISTINCT joint_id) AS j FROM sc), g AS (SELECT anomaly_score AS s, sum(truth) AS p, sum(1 - truth) AS n FROM tr GROUP BY ALL),
  cu AS (SELECT *, lead(p) OVER o AS p2, lead(n) OVER o AS n2, row_number() OVER o AS i, count(*) OVER () AS k FROM g WINDOW o AS (ORDER BY s))
  SELECT 'histograms' AS part, 30 * (j + 1) AS "rows" FROM j UNION ALL SELECT 'distributions', j + 1 FROM j UNION ALL SELECT 'confusion', j + 1 FROM j
  UNION ALL SELECT 'thresholds', 50 FROM j UNION ALL SELECT 'importance', 6 FROM j
  UNION ALL SELECT 'roc', 1 + count(*) FILTER (i = 1 OR i = k OR p2 <> p OR n2 <> n) FROM cu"""


def comparison(spark, d, models=("isolation_forest", "local_outlier_factor")):
    options = analysis.Options(selection=None, deselected=())
    table_ = event_series(spark, d)
    rows, best = analysis.compare_models(table_, options, models)
    return rows.join(best.select("model_id", F.lit(True).alias("best")), "model_id", "left").fillna(False, ["best"])


def whole_analysis(spark, d):
    """From the table to wear: roles, quality, series, and all features of all axes."""
    rows = table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("joint_id"), F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("acc_x"),
        (F.col("l_extendedprice") / 1000).alias("acc_y"), (F.col("l_discount") * 100).alias("acc_z"), *[F.col(c).alias(f"_file_{c}") for c in LINE_TIES])
    options = analysis.Options(selection=None, deselected=(), overrides={
        "timestamp": "timestamp", "joint": "joint_id", "sensors": {"accelerometer": ["acc_x", "acc_y", "acc_z"]}})
    data = analysis.ingest(rows, ["timestamp", *[f"_file_{c}" for c in LINE_TIES]], options)
    done = analysis.analyse(data.table, catalogue(spark, d), options=options)
    return done.wear.select("joint_id", F.round("anomaly_rate", 2).alias("anomaly_rate"), "wear_index", "wear_status")


def timeline(spark, d):
    return presentation.timeline(line_scored(spark, d), line_series(spark, d)).drop("seq").withColumn("magnitude", r("magnitude"))


TIMELINE_SQL = f"""WITH {SCORED} SELECT CAST(seq AS DOUBLE) AS timestamp, {R('round(x, 4)')} AS magnitude, anomaly FROM sc WHERE joint_id = (SELECT min(joint_id) FROM sc) AND seq < 1000"""


def timeline_from_features(spark, d):
    return presentation.timeline(line_scored(spark, d)).select(r("timestamp").alias("timestamp"), r("magnitude").alias("magnitude"), "anomaly")


FEATURE_LINE_SQL = f"""WITH {SCORED} SELECT {R('t')} AS timestamp, {R('round(mean, 4)')} AS magnitude, anomaly FROM sc WHERE joint_id = (SELECT min(joint_id) FROM sc) AND seq < 1000"""


def thinned(spark, d):
    out = presentation.thinned(presentation.timeline(line_scored(spark, d), line_series(spark, d)))
    return out.withColumn("magnitude", r("magnitude"))


THINNED_SQL = f"""WITH {SCORED}, tl AS (SELECT seq, round(x, 4) AS magnitude, anomaly FROM sc WHERE joint_id = (SELECT min(joint_id) FROM sc) AND seq < 1000), n AS (SELECT count(*) AS n FROM tl)
  SELECT seq AS index, {R('magnitude')} AS magnitude, anomaly = -1 AS is_anomaly FROM tl, n WHERE seq % greatest(1, n // 500) = 0"""

QUERIES = {
    "evaluate_totals": (lambda s, d: rounded(evaluation.anomaly_totals(line_scored(s, d)), ["global_anomaly_rate"]),
                        f"WITH {SCORED} SELECT count(*) AS n_total, count(*) FILTER (anomaly = -1) AS n_anomalies, {R('count(*) FILTER (anomaly = -1) / count(*)')} AS global_anomaly_rate FROM sc"),
    "evaluate_silhouette_euclidean": (lambda s, d: evaluation.reference_silhouette(clusters(s, d), 1 << 20).select("silhouette_score"), EUCLIDEAN_SQL),
    "evaluate_silhouette_bounds": (silhouette_bounds, "SELECT true AS holds, true AS narrow"),
    "evaluate_silhouette": (lambda s, d: evaluation.silhouette(clusters(s, d)), SILHOUETTE_SQL),
    "evaluate_calinski_harabasz": (lambda s, d: evaluation.calinski_harabasz(clusters(s, d)), CH_SQL),
    "evaluate_score_distribution": (distribution, DIST_SQL),
    "evaluate_score_histogram": (histogram, HIST_SQL),
    "evaluate_threshold_sweep": (sweep, _sweep_sql(">")),
    "evaluate_threshold_sweep_below": (lambda s, d: sweep(s, d, "below"), _sweep_sql("<")),
    "evaluate_current_threshold": (lambda s, d: evaluation.current_threshold(line_scored(s, d)),
                                   f"WITH {SCORED} SELECT round(max(anomaly_score) FILTER (anomaly = 1), 6) AS current_threshold, count(*) FILTER (anomaly = -1) AS current_n_anomalies FROM sc"),
    "evaluate_truth_column": (truth_found, "SELECT count(DISTINCT l_linestatus) AS classes, 'fault' AS label_column FROM lineitem"),
    "evaluate_truth_values": (truth_values, TRUTH_SQL),
    "evaluate_confusion": (lambda s, d: evaluation.confusion(by_flag(s, d)), CM_SQL),
    "evaluate_roc_points": (lambda s, d: evaluation.roc_points(materialise(evaluation.roc_steps(by_flag(s, d)))), ROC_SQL),
    "evaluate_roc_thinned": (thinned_curve, THIN_SQL),
    "evaluate_roc_auc": (lambda s, d: evaluation.roc_auc(materialise(evaluation.roc_steps(by_flag(s, d)))), AUC_SQL),
    "evaluate_correlation_importance": (importance, IMPORTANCE_SQL),
    "evaluate_permutation_importance": (permutation, None),
    "evaluate_permutation_planted": (permutation_planted, "SELECT 'vibration_rms' AS feature, 1.0::DOUBLE AS importance, 1::BIGINT AS rank UNION ALL SELECT 'vibration_still', 0.0, 2"),
    "evaluate_comparison_facts": (comparison_facts, "SELECT 2::BIGINT AS models, 2::BIGINT AS of_share, true AS best_is_highest"),
    "evaluate_report_tables": (report_tables, REPORT_SQL),
    "evaluate_comparison_facts_all": (comparison_facts_all, "SELECT 4::BIGINT AS models, true AS best_is_highest"),
    "evaluate_model_comparison": (lambda s, d: once(s, d, "compared_all", lambda: comparison(s, d, tuple(registry.MODELS))), None),
    "analysis_whole": (whole_analysis, None),
    "report_timeline": (timeline, TIMELINE_SQL),
    "report_timeline_from_features": (timeline_from_features, FEATURE_LINE_SQL),
    "report_timeline_thinned": (thinned, THINNED_SQL),
}
