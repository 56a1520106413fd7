import numpy as np
import pytest
from pyspark.sql import functions as F

from tribospark.operators import evaluation, presentation
from tribospark.operators.mapping import SignalTable


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    rows = []
    for joint, n in (("a", 400), ("b", 60)):
        for i in range(n):
            s = float(rng.normal())
            truth = int(s + rng.normal() < -1)
            rows.append((joint, i, float(i), s * 2 + float(rng.normal()), float(rng.normal()), 1.0, -1 if s < -1.2 else 1, s, truth))
    return spark.createDataFrame(rows, "joint_id string, seq long, timestamp double, f double, g double, still double, anomaly int, anomaly_score double, fault int").cache()


def test_cluster_scores(spark, scored):
    sample = evaluation.cluster_points(scored, ["f", "g"])
    pdf = scored.toPandas()
    x, y = pdf[["f", "g"]].to_numpy(), pdf.anomaly.to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = y == y[i]
        a, b = d[i][own].sum() / (own.sum() - 1), d[i][~own].mean()
        s.append((b - a) / max(a, b))
    assert evaluation.euclidean_silhouette(sample).first()[0] == round(float(np.mean(s)), 4)
    s = []
    for i in range(len(x)):
        own = y == y[i]
        a, b = (d[i][own] ** 2).sum() / (own.sum() - 1), (d[i][~own] ** 2).mean()
        s.append((b - a) / max(a, b))
    assert evaluation.silhouette(sample).first()[0] == pytest.approx(float(np.mean(s)), abs=1e-4)
    with pytest.raises(ValueError):
        evaluation.euclidean_silhouette(sample, max_rows=100)
    groups = [x[y == v] for v in (-1, 1)]
    between = sum(len(g) * ((g.mean(0) - x.mean(0)) ** 2).sum() for g in groups)
    within = sum(((g - g.mean(0)) ** 2).sum() for g in groups)
    assert abs(evaluation.calinski_harabasz(sample).first()[0] - between * (len(x) - 2) / within) < 1e-3
    same = scored.withColumn("anomaly", F.lit(1))
    assert evaluation.silhouette(evaluation.cluster_points(same, ["f"])).first()[0] is None
    assert evaluation.calinski_harabasz(evaluation.cluster_points(same, ["f"])).first()[0] is None


def test_distribution_and_histogram(scored):
    got = {r["joint_id"]: r for r in evaluation.score_distribution(scored).collect()}
    values = scored.toPandas().anomaly_score
    everything = got["all_joints"]
    assert everything["n_total"] == 460 and np.isclose(everything["std"], values.std(ddof=0)) and np.isclose(everything["q25"], values.quantile(0.25))
    hist = evaluation.score_histogram(scored).filter("joint_id = 'all_joints'").orderBy("bin").collect()
    counts, edges = np.histogram(values, 30)
    assert [r["count"] for r in hist] == counts.tolist() and np.allclose([r["left_edge"] for r in hist], edges[:-1], atol=1e-6)
    flat = evaluation.score_histogram(scored.withColumn("anomaly_score", F.lit(2.0))).filter("joint_id = 'a'").orderBy("bin").collect()
    assert [r["count"] for r in flat] == np.histogram(np.full(400, 2.0), 30)[0].tolist() and flat[0]["left_edge"] == 1.5


def test_histogram_edges_follow_the_edges(spark):
    values = [float(v) / 10 for v in range(31)]
    df = spark.createDataFrame([("a", i, 1, v) for i, v in enumerate(values)], "joint_id string, seq long, anomaly int, anomaly_score double")
    got = [r["count"] for r in evaluation.score_histogram(df).filter("joint_id = 'a'").orderBy("bin").collect()]
    assert got == np.histogram(values, 30)[0].tolist()


def test_thresholds(scored):
    values = scored.toPandas()
    got = evaluation.threshold_sweep(scored).orderBy("point").collect()
    want = np.percentile(values.anomaly_score, np.linspace(0, 100, 50))
    assert np.allclose([r["threshold"] for r in got], want, atol=1e-6)
    assert [r["n_anomalies"] for r in got] == [int((values.anomaly_score > t).sum()) for t in want]
    below = evaluation.threshold_sweep(scored, direction="below").orderBy("point").collect()
    assert below[0]["n_anomalies"] == 0 and below[-1]["n_anomalies"] == 459
    now = evaluation.current_threshold(scored).first()
    assert now["current_n_anomalies"] == (values.anomaly == -1).sum() and now["current_threshold"] == round(values[values.anomaly == 1].anomaly_score.max(), 6)
    none = evaluation.current_threshold(scored.withColumn("anomaly", F.lit(-1))).first()
    assert np.isclose(none["current_threshold"], values.anomaly_score.median(), atol=1e-6)


def test_truth(spark, scored):
    assert evaluation.truth_column(scored) == "fault" and evaluation.truth_column(scored.drop("fault")) is None
    assert evaluation.truth_column(scored.withColumn("label", F.col("seq")).drop("fault")) is None
    words = spark.createDataFrame([(" OK ", 1, 2), ("broken", -1, 0), (None, 1, 5)], "w string, s int, n int")
    out = evaluation.with_truth(evaluation.with_truth(evaluation.with_truth(words, "w", "tw"), "s", "ts"), "n", "tn").collect()
    assert [(r["tw"], r["ts"], r["tn"]) for r in out] == [(0, 0, 1), (1, 1, 0), (1, 0, 1)]


def test_confusion(scored):
    pdf = scored.toPandas()
    got = {r["joint_id"]: r for r in evaluation.confusion(evaluation.with_truth(scored, "fault")).collect()}
    for joint, part in (("all_joints", pdf), ("a", pdf[pdf.joint_id == "a"]), ("b", pdf[pdf.joint_id == "b"])):
        p, t = part.anomaly == -1, part.fault == 1
        r = got[joint]
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == ((p & t).sum(), (p & ~t).sum(), (~p & ~t).sum(), (~p & t).sum())
        assert r["precision"] == round((p & t).sum() / max(p.sum(), 1), 4) and r["support_anomaly"] == t.sum()


def test_roc(scored):
    labelled = evaluation.with_truth(scored, "fault")
    for windowing in ({}, {"max_window_rows": 1, "range_rows": 50}):
        steps = evaluation.roc_steps(labelled, **windowing)
        pdf = scored.toPandas()
        pos, neg = pdf[pdf.fault == 1].anomaly_score.to_numpy(), pdf[pdf.fault == 0].anomaly_score.to_numpy()
        auc = ((pos[:, None] < neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
        assert evaluation.roc_auc(steps).first()[0] == round(auc, 4)
        points = evaluation.roc_points(steps, **windowing).orderBy("point").collect()
        assert (points[0]["fpr"], points[0]["tpr"], points[0]["threshold"]) == (0, 0, float("inf")) and (points[-1]["fpr"], points[-1]["tpr"]) == (1, 1)
        assert all(a["tpr"] <= b["tpr"] and a["fpr"] <= b["fpr"] for a, b in zip(points, points[1:]))
        few = evaluation.thinned_points(evaluation.roc_points(steps, **windowing), 10).orderBy("point").collect()
        assert len(few) == 10 and few[0]["point"] == 0 and few[-1]["tpr"] == 1
    one = evaluation.roc_steps(labelled.withColumn("truth", F.lit(0)))
    assert evaluation.roc_auc(one).first()[0] is None


def test_importance(scored):
    got = evaluation.correlation_importance(scored, exclude=("fault",)).collect()
    pdf = scored.toPandas()
    assert [r["feature"] for r in sorted(got, key=lambda r: r["rank"])] == ["f", "g", "still"]
    r = {r["feature"]: r["importance"] for r in got}
    assert r["f"] == 1 and r["still"] == 0 and np.isclose(r["g"], abs(pdf.g.corr(pdf.anomaly_score)) / abs(pdf.f.corr(pdf.anomaly_score)), atol=1e-4)
    assert {x["importance"] for x in evaluation.correlation_importance(scored.limit(5), ["f", "g"]).collect()} == {0.0}


def test_shuffle_is_a_permutation_of_one_column(spark):
    rows = spark.range(300).select(F.lit("p").alias("joint_id"), F.col("id").alias("seq"), F.lit(300).alias("n"), F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("x"))
    got = evaluation.shuffled(rows, 1, 7).orderBy("seq").collect()
    second = [r["x"][1] for r in got]
    assert [r["x"][0] for r in got] == [float(i) for i in range(300)]
    assert sorted(second) == [2.0 * i for i in range(300)] and second != sorted(second)


def test_report_and_comparison(scored):
    parts = evaluation.diagnostics(scored)
    assert set(parts) >= {"totals", "distributions", "histograms", "thresholds", "confusion", "roc", "auc", "importance"}
    assert parts["model"].first()["feature_names"] == ["f", "g", "still"]
    row = evaluation.comparison_row(parts)
    worse = row.withColumns({"model_id": F.lit("z"), "silhouette_score": F.lit(None).cast("double")})
    assert evaluation.best_model(worse.unionByName(row)).first()["model_id"] == "isolation_forest"


def test_timeline(spark, scored):
    raw = scored.select("joint_id", "seq", F.col("timestamp").alias("t"), F.col("f").alias("vibration"))
    line = presentation.timeline(scored, SignalTable(raw, {"vibration": "vibration"})).orderBy("seq").collect()
    assert len(line) == 400 and line[3]["timestamp"] == 3 and line[3]["magnitude"] == round(raw.filter("joint_id='a' and seq=3").first()["vibration"], 4)
    zero = SignalTable(raw.withColumn("vibration", F.lit(0.0)), {"vibration": "vibration"})
    assert presentation.timeline(scored.withColumnRenamed("f", "f_rms"), zero).count() == 400
    nothing = scored.select("joint_id", "seq", "timestamp", F.lit(0.0).alias("v_rms"), "anomaly", "anomaly_score")
    assert presentation.timeline(nothing, zero).count() == 0
    thin = presentation.thinned(presentation.timeline(scored, SignalTable(raw, {"vibration": "vibration"})), points=100).orderBy("index").collect()
    assert [r["index"] for r in thin] == list(range(0, 400, 4))
    assert presentation.magnitude_column(scored.withColumn("x_magnitude_mean", F.lit(1.0))) == "x_magnitude_mean"


def test_registered_queries_take_everything(spark, monkeypatch):
    """All detectors, all features of all axes, and the operators' own numbers of trees, repeats and epochs."""
    from checks import evaluate as registered
    from checks import wear
    from tribospark.operators.detect import registry

    class Stop(Exception):
        pass

    sf, seen = "/root/testdata/sf0.001", []

    def asked(*args, **options):
        seen.append((args, options))
        raise Stop

    def first_call(where, name, query):
        with monkeypatch.context() as patch, pytest.raises(Stop):
            patch.setattr(where, name, asked)
            query(spark, sf)
        return seen.pop()

    queries = {**registered.QUERIES, **wear.QUERIES}
    (features, _), _ = first_call(registered.analysis, "detect_anomalies", queries["analysis_whole"][0])
    assert len(features.columns) - 3 == 76
    (_, _, models), _ = first_call(registered.analysis, "compare_models", queries["evaluate_model_comparison"][0])
    assert set(models) == set(registry.MODELS)
    (features, config), options = first_call(registered.evaluation, "permutation_importance", queries["evaluate_permutation_importance"][0])
    assert len(features.columns) - 3 == 19 and config.params == {"contamination": 0.1} and options == {}
    (_, params), _ = first_call(wear, "autoencoder_errors", queries["detect_autoencoder"][0])
    assert params["epochs"] == 50


def test_co_moments_of_many_batches(spark):
    from tribospark.operators.detect.common import co_moments

    rng = np.random.default_rng(8)
    a, o = 1e6 + rng.normal(size=500), rng.normal(size=500)
    b = np.where(np.arange(500) % 5 == 0, np.nan, o * 2 + rng.normal(size=500))
    b[3], o[10] = np.inf, -np.inf
    df = spark.createDataFrame([(float(x), None if i % 50 == 7 else float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, o))], "a double, b double, o double").repartition(7)
    got = {r["i"]: r for r in co_moments(df, ["a", "b"], "o").collect()}
    for i, v in enumerate((a, b)):
        fine = np.isfinite(v) & np.isfinite(o) & ((np.arange(500) % 50 != 7) | (i == 0))
        r = got[i]
        assert r["c"] == fine.sum() and r["x"] / np.sqrt(r["s"] * r["so"]) == pytest.approx(np.corrcoef(v[fine], o[fine])[0, 1], rel=1e-6)


def brute_silhouette(x, y):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        same = (y == y[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = d[i][same].mean(), min(d[i][y == k].mean() for k in set(y.tolist()) - {y[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(out)


def test_silhouette_from_references(spark):
    rng = np.random.default_rng(10)
    y = np.where(rng.random(1500) < 0.1, -1, 1)
    x = rng.normal(size=(1500, 5)) + np.where(y < 0, 3.0, 0.0)[:, None]
    x[:200] = x[0]
    frame = lambda x, y: spark.createDataFrame([("ab"[i % 2], i // 2, int(k), v.tolist()) for i, (v, k) in enumerate(zip(x, y))], "joint_id string, seq long, anomaly int, x array<double>")
    want = brute_silhouette(x, y)
    exact = evaluation.reference_silhouette(frame(x, y).repartition(5), 5000).first()
    assert exact["silhouette_score"] == round(want, 4) and exact["low"] == exact["high"] == pytest.approx(want, abs=1e-9)
    rough = evaluation.reference_silhouette(frame(x, y), 120).first()
    assert rough["low"] - 1e-9 <= want <= rough["high"] + 1e-9 and 0 < rough["high"] - rough["low"] < 0.2
    lone = np.where(np.arange(1500) == 700, -1, 1)  # a label of one row scores zero
    assert evaluation.reference_silhouette(frame(x, lone), 5000).first()["low"] == pytest.approx(brute_silhouette(x, lone), abs=1e-9)
    assert evaluation.reference_silhouette(frame(x, np.ones(1500)), 50).first()["low"] is None


def test_labels_travel_with_the_features(spark):
    from checks.fixtures import distance_labels

    features = spark.createDataFrame([("a", i, float(i), float(i % 10)) for i in range(100)], "joint_id string, seq long, timestamp double, e double")
    out = distance_labels(features, "e")
    assert "SortMergeJoin" not in out._jdf.queryExecution().toString() and out.columns == ["joint_id", "seq", "timestamp", "e", "anomaly", "anomaly_score"]
    assert out.where("anomaly = -1").count() == 0 and out.count() == 100  # the largest distance comes in ties at the quantile


def test_silhouettes_in_pieces(spark, monkeypatch):
    """Neither silhouette holds the distances of a row to all references at once, and pieces give the same score."""
    rng = np.random.default_rng(6)
    rows = [("j", i, -1 if i % 5 == 0 else 1, rng.normal(size=3).tolist()) for i in range(700)]
    points = spark.createDataFrame(rows, "joint_id string, seq long, anomaly int, x array<double>")
    whole = evaluation.euclidean_silhouette(points).first()[0]
    monkeypatch.setattr(evaluation, "REFERENCE_PIECE", 64)
    monkeypatch.setattr(evaluation, "PIECE", 32)
    monkeypatch.setattr(evaluation, "PAIRS", 100_000)
    assert evaluation.dealt(points, 700, 700).rdd.getNumPartitions() == 5
    assert evaluation.euclidean_silhouette(points).first()[0] == whole == evaluation.reference_silhouette(points, 1000).first()[0]


def test_permutation_fits_run_side_by_side(spark, monkeypatch):
    """Two fits meet at a barrier that one after the other would never pass; every feature gets its own moves."""
    import threading
    from types import SimpleNamespace

    calls, meet = [], threading.Barrier(2, timeout=120)

    def run(rows, params, seed):
        calls.append(1)
        if len(calls) > 1:
            meet.wait()
        return rows.select(F.when(F.col("seq") % 2 == 0, F.col("x")[0]).otherwise(F.lit(0.0)).alias("anomaly_score"))

    monkeypatch.setitem(evaluation.MODELS, "isolation_forest", SimpleNamespace(run=run, parameters=evaluation.MODELS["isolation_forest"].parameters))
    df = spark.range(40).select(F.lit("a").alias("joint_id"), F.col("id").alias("seq"), F.col("id").cast("double").alias("timestamp"),
                                F.pow(F.col("id"), F.lit(2.0)).alias("vibration_rms"), F.col("id").cast("double").alias("vibration_mean"))
    got = {r["feature"]: r["importance"] for r in evaluation.permutation_importance(df, None, ["vibration_rms", "vibration_mean"], repeats=2).collect()}
    assert len(calls) == 5 and got == {"vibration_rms": 1.0, "vibration_mean": 0.0}
