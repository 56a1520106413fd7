import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tribospark.operators.detect import autoencoder, common, forest, lof, registry, svm
from tribospark.operators.wear import anomaly_rates

COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    rows = []
    for joint, n in (("hot", 500), ("cold", 150)):
        base = rng.normal(size=(n, 1))
        x = np.hstack([base, base * 2 + rng.normal(scale=0.1, size=(n, 1)), rng.normal(size=(n, 1))])
        x[:5] += [[9, -9, 9]]
        rows += [(joint, i, float(i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "joint_id string, seq long, timestamp double, a double, b double, c double").cache()


@pytest.mark.parametrize("model_id", list(registry.MODELS))
def test_planted_outliers_share_and_columns(matrix, model_id):
    config = registry.with_contamination(registry.default_config(model_id), 0.1)
    out = registry.detect_anomalies(matrix, config)
    assert out.columns == [*matrix.columns, "anomaly", "anomaly_score"]
    got = out.toPandas()
    assert len(got) == 650
    share = 0.05 if model_id == "one_class_svm" else 0.1
    for _, part in got.groupby("joint_id"):
        assert abs((part.anomaly == -1).mean() - share) < 0.02
        if model_id == "local_outlier_factor":  # five planted points are a cluster of their own, denser than k
            continue
        if model_id == "one_class_svm":  # five equal outliers carry much of the weight nu leaves to violators
            assert part[part.seq < 5].anomaly_score.mean() < part.anomaly_score.median()
            continue
        assert (part[part.seq < 5].anomaly == -1).all()
        assert part[part.seq < 5].anomaly_score.max() <= np.quantile(part.anomaly_score, share)


@pytest.mark.parametrize("run", [
    lambda rows: forest.isolation_forest(rows, {"n_estimators": 20}), lambda rows: autoencoder.autoencoder(rows, {"epochs": 10}),
    lambda rows: svm.one_class_svm(rows, {}, passes=2), lambda rows: autoencoder.component_detector(rows, {})])
def test_same_seed_same_scores(matrix, run):
    rows = common.standardise(matrix, COLUMNS)
    a, b = (run(r).orderBy("joint_id", "seq").toPandas() for r in (rows, rows.orderBy(F.hash("seq"))))
    assert np.allclose(a.anomaly_score, b.anomaly_score, rtol=1e-6, atol=1e-9)


def test_models_by_chunk_equal_shared_models(matrix):
    rows = common.standardise(matrix, COLUMNS, carry=["timestamp"])
    models = forest.fit_forest(rows, 10, 64)
    a = common.apply_models(rows, models, forest.forest_score).orderBy("joint_id", "seq").toPandas()
    b = common.apply_models(rows, models, forest.forest_score, max_shared_joints=1, chunk_rows=40).orderBy("joint_id", "seq").toPandas()
    c = common.apply_models(rows, models, forest.forest_score, max_shared_bytes=10).orderBy("joint_id", "seq").toPandas()
    assert a.equals(b) and a.equals(c) and a.columns.tolist() == ["joint_id", "seq", "timestamp", "value"]
    one = svm.one_class_svm(rows, {}, passes=1).orderBy("joint_id", "seq").toPandas()
    two = svm.one_class_svm(rows, {}, passes=1, max_shared_joints=1).orderBy("joint_id", "seq").toPandas()
    assert np.allclose(one.anomaly_score, two.anomaly_score)


def test_scaling(spark):
    rows = [("a", i, float(i), 5.0, None if i == 0 else float(i % 3), float("nan")) for i in range(9)] + [("b", 0, 2.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "joint_id string, seq long, p double, q double, r double, s double")
    x = {(r["joint_id"], r["seq"]): r["x"] for r in common.standardise(df, ["p", "q", "r", "s"]).collect()}
    p = np.arange(9.0)
    assert np.allclose([x["a", i][0] for i in range(9)], (p - p.mean()) / p.std())
    assert x["a", 3][1] == 0 and x["a", 0][2] == 0 and x["a", 4][3] == 0 and x["b", 0] == [0, 0, 0, 0]


def test_subsamples_are_bounded_and_drawn_alike(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("joint_id"), F.col("id").alias("seq"), F.lit(20_000).alias("n"), F.array(F.rand(1)).alias("x"))
    sizes = [r["count"] for r in forest.subsamples(rows, 20, 100, 1).groupBy("block").count().collect()]
    assert len(sizes) == 2 and all(1000 <= n <= 1000 + 20 * 1000**0.5 + 200 for n in sizes)
    for n in (50, 999, 1100):  # fewer rows than a block may take: all of them, for every block
        few = forest.subsamples(rows.filter(F.col("seq") < n).withColumn("n", F.lit(n)), 20, 100, 1)
        assert few.count() == 2 * n and few.select("size").distinct().count() == 1
    share = forest.subsamples(rows, 10, 0.01, 1)
    assert share.first()["size"] == 200 and 2000 <= share.count() <= 2000 + 20 * 2000**0.5 + 200


def test_numbers_or_words():
    words = {"auto": 256}
    assert [common.numeric_or(v, words) for v in ("auto", "64", "0.5", 0.25, 7, "many", " 1e-3 ")] == [256, 64, 0.5, 0.25, 7, 256, 0.001]


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    nd = np.take_along_axis(d, near, 1)
    kd = nd[:, -1]
    lrd = 1 / (np.maximum(nd, kd[near]).mean(1) + 1e-10)
    return -lrd[near].mean(1) / lrd


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_lof_matches_brute_force(spark, block):
    rng = np.random.default_rng(8)
    parts = {"hot": rng.normal(size=(90, 4)), "far": np.vstack([rng.normal(size=(40, 4)), rng.normal(50, 1, size=(30, 4))]), "tiny": rng.normal(size=(4, 4)), "one": np.ones((1, 4))}
    rows = [(j, i, r.tolist()) for j, x in parts.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "joint_id string, seq long, x array<double>")
    got = lof.outlier_factors(df, 6, block_points=block).orderBy("joint_id", "seq").toPandas()
    for joint, x in parts.items():
        want = brute_lof(x, 6) if len(x) > 1 else [-1.0]
        assert np.allclose(got[got.joint_id == joint].value, want), joint


def test_lof_blocks_meet_near_blocks_only(spark, monkeypatch):
    """On clusters the number of compared points must grow far less than with the square of all points."""
    compared = {}
    for n in (10, 40):
        rng = np.random.default_rng(5)
        centres = rng.normal(size=(n, 8)) * 100
        x = (centres[:, None, :] + rng.normal(size=(n, 64, 8))).reshape(-1, 8)
        df = spark.createDataFrame([("hot", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
        pairs = spark.sparkContext.accumulator(0)
        real = lof.nearest

        def counting(q, p, k, power, real=real, pairs=pairs):
            pairs.add(q.num_rows * p.num_rows)
            return real(q, p, k, power)

        monkeypatch.setattr(lof, "nearest", counting)
        got = lof.outlier_factors(df, 6, block_points=32).orderBy("seq").toPandas()
        monkeypatch.setattr(lof, "nearest", real)
        assert np.allclose(got.value, brute_lof(x, 6))
        compared[n] = pairs.value
    assert compared[40] < 8 * compared[10] and compared[40] < 0.25 * (40 * 64) ** 2


@pytest.mark.parametrize("block", [13, 4096])
@pytest.mark.parametrize("metric,power", [("chebyshev", np.inf), ("manhattan", 1), ("minkowski", 3), ("minkowski", 1.5), ("cosine", None)])
def test_lof_metrics(spark, metric, power, block):
    x = np.random.default_rng(9).normal(size=(60, 3))
    if metric == "cosine":
        x[7] = 0  # at right angles to all others
        unit = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
        d = 1 - unit @ unit.T
    else:
        d = (np.abs(x[:, None] - x[None]) ** power).sum(-1) ** (1 / power) if power != np.inf else np.abs(x[:, None] - x[None]).max(-1)
    df = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    nd = np.take_along_axis(d, near, 1)
    lrd = 1 / (np.maximum(nd, nd[:, -1][near]).mean(1) + 1e-10)
    got = lof.outlier_factors(df, 5, metric, block_points=block, p=power or 2).orderBy("seq").toPandas()
    want = -lrd[near].mean(1) / lrd
    if metric == "cosine":  # all others are as far from the zero vector, up to rounding
        assert got.value[7] < -2
        want[7] = got.value[7]
    assert np.allclose(got.value, want)


def test_lof_with_many_copies(spark):
    """A third of the rows is one point; all copies get the same factor, and nothing is dropped."""
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile([1.0, 1.0], (50, 1)), rng.normal(size=(100, 2))])
    df = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    got = lof.outlier_factors(df, 10, block_points=16).orderBy("seq").toPandas()
    assert len(got) == 150 and got.value[:50].nunique() == 1 and np.isclose(got.value[0], -1)
    for wrong in ({"metric": "hamming"}, {"method": "guess"}, {"p": 0.5}):
        with pytest.raises(ValueError):
            lof.outlier_factors(df, 5, **wrong)


def blobs(n, seed=5, width=12):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(25, width)) * 4)[rng.integers(25, size=n)] + rng.normal(size=(n, width))
    x[: n // 3] = x[0]  # a third are copies
    return x


def test_lof_of_projected_neighbours(spark):
    """Joints above a block by projections, the small one exactly; factors nearly those of all pairs."""
    x = blobs(1500)
    rows = [("hot", i, r.tolist()) for i, r in enumerate(x)] + [("small", i, r.tolist()) for i, r in enumerate(x[-40:])]
    df = spark.createDataFrame(rows, "joint_id string, seq long, x array<double>")
    exact = lof.outlier_factors(df, 10, block_points=4096).orderBy("joint_id", "seq").toPandas()
    got = lof.outlier_factors(df, 10, block_points=100, method="lsh").orderBy("joint_id", "seq").toPandas()
    again = lof.outlier_factors(df.repartition(3), 10, block_points=100, method="lsh").orderBy("joint_id", "seq").toPandas()
    assert np.array_equal(got.value, again.value) and len(got) == 1540
    assert np.allclose(got.value[1500:], exact.value[1500:])
    assert np.abs(got.value - exact.value).mean() < 0.02 and (np.isclose(got.value, exact.value)).mean() > 0.6


def test_projections_reach_the_wanted_share(spark):
    x = blobs(1200)[400:]
    points = spark.createDataFrame([("hot", i, 1, r.tolist()) for i, r in enumerate(x)], "joint_id string, point long, copies long, x array<double>")
    exact = lof.neighbour_edges(points, 10, 2, 4096)
    for wanted in (0.5, 0.97):
        found = lof.projected_edges(points, 10, 2, 64, wanted)
        assert lof.found_share(found, exact).first()["recall"] >= wanted - 0.03
        per = found.groupBy("point").agg(F.sum("copies").alias("n")).agg(F.min("n"), F.max("n"), F.count("*")).first()
        assert tuple(per) == (10, 10, 800)


def test_projected_meetings_grow_with_the_points(spark):
    """One round compares TABLES blocks' worth for each point, whatever the number of points."""
    for n in (600, 2400):
        x = blobs(n)[n // 3 :]
        points = spark.createDataFrame([("hot", i, 1, r.tolist()) for i, r in enumerate(x)], "joint_id string, point long, copies long, x array<double>")
        sizes = lof._table_blocks(points, 50, 0, 1).groupBy("table", "block").count().toPandas()
        assert (sizes["count"] <= 50).all() and sizes["count"].sum() == lof.TABLES * len(x)
        assert len(sizes) == lof.TABLES * -(-len(x) // 50)


def dual_optimum(k, nu, steps=200_000):
    """Least 1/2 a'Ka with a in [0, 1/(nu n)] that sums to one, by moving weight between the worst pair."""
    n = len(k)
    top = 1 / (nu * n)
    a = np.zeros(n)
    a[: int(1 / top)] = top
    a[int(1 / top)] = 1 - a.sum()
    g = k @ a
    for _ in range(steps):
        up, down = np.where(a < top - 1e-15)[0], np.where(a > 1e-15)[0]
        i, j = up[g[up].argmin()], down[g[down].argmax()]
        if g[j] - g[i] < 1e-9:
            break
        move = min((g[j] - g[i]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), top - a[i], a[j])
        a[i], a[j] = a[i] + move, a[j] - move
        g += move * (k[:, i] - k[:, j])
    return -0.5 * a @ k @ a


@pytest.mark.parametrize("kernel", svm.KERNELS)
def test_svm_reaches_the_optimum(spark, kernel):
    """The loss found is within the stated gap of the optimum of the same kernel matrix."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(180, 4)) + [1.5, 0, 0, 0]
    df = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    model = svm.fit(df, kernel, 0.1, 0.2, 42).first().asDict()
    phi = svm.feature_map(x, kernel, 0.2, 42, np.asarray(model["marks"]).reshape(-1, 4) if model["marks"] else None)
    if kernel in ("poly", "sigmoid"):  # all rows are landmarks: the features give back the positive part of the kernel
        values, vectors = np.linalg.eigh(svm.kernel(x, x, kernel, 0.2))
        assert np.allclose(phi @ phi.T, (vectors * np.maximum(values, 0)) @ vectors.T, atol=1e-5 * values[-1])
    w = np.asarray(model["w"])
    loss = 0.5 * w[:-1] @ w[:-1] - w[-1] + np.maximum(w[-1] - phi @ w[:-1], 0).sum() / (0.1 * len(x))
    gap, scale = model["numbers"][svm.GAP_AT], model["numbers"][svm.SCALE]
    assert gap <= svm.GAP * scale and scale == pytest.approx((phi**2).sum(1).mean())
    assert -1e-6 * scale <= loss - dual_optimum(phi @ phi.T, 0.1) <= gap + 1e-6 * scale


def test_barrier_terms():
    z, tau = np.linspace(-3, 3, 301), 0.05
    loss, slope, bend = svm.barrier_terms(z, tau)
    h = z[1] - z[0]
    assert np.allclose(np.gradient(loss, h)[1:-1], slope[1:-1], atol=0.02) and np.allclose(np.gradient(slope, h)[1:-1], bend[1:-1], atol=0.5)
    assert ((slope > 0) & (slope < 1)).all() and (bend > 0).all()
    assert np.isfinite(np.concatenate(svm.barrier_terms(np.array([-1e9, -1e-300, 0.0, 1e-300, 1e9]), 1e-12))).all()


def test_autoencoder_is_the_same_for_any_cut(spark):
    x = blobs(600, width=6)
    df = spark.createDataFrame([(("hot", "cold")[i % 3 == 0], i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    one, many, apart = (
        autoencoder.fit_autoencoder(d, {"epochs": 12}, **sharing).orderBy("joint_id").collect()
        for d, sharing in ((df.coalesce(1), {}), (df.repartition(50), {}), (df.repartition(3), {"max_shared_joints": 1, "chunk_rows": 37})))
    for a, b, c in zip(one, many, apart):
        assert a["rounds"] == b["rounds"] == c["rounds"] and a["loss"] == pytest.approx(b["loss"]) == pytest.approx(c["loss"])
        assert np.allclose(a["w"], b["w"], rtol=1e-5, atol=1e-8) and np.allclose(a["w"], c["w"], rtol=1e-5, atol=1e-8)


def test_autoencoder_nears_the_components(spark):
    """Data of two directions: four units that pass positive values only carry both signs of two."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 2)) @ rng.normal(size=(2, 8)) + 0.3 * rng.normal(size=(1500, 8))
    x = (x - x.mean(0)) / x.std(0)
    df = spark.createDataFrame([("a", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    got = autoencoder.autoencoder_errors(df, {"epochs": 200, "learning_rate": 0.01}).agg(F.avg("value")).first()[0]
    best = autoencoder.component_errors(df, 0.25).agg(F.avg("value")).first()[0]
    assert got <= 1.05 * best


def test_states_are_added_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN", 3)
    rows = [("ab"[i % 7 == 0], i, np.array([1.0, float(i)]).tobytes()) for i in range(100)]
    got = {r["joint_id"]: np.frombuffer(r["state"]).tolist() for r in common.add_states(spark.createDataFrame(rows, "joint_id string, part long, state binary"), 100).collect()}
    assert got == {"a": [85.0, float(sum(i for i in range(100) if i % 7))], "b": [15.0, float(sum(range(0, 100, 7)))]}


def test_a_task_sends_one_state_for_each_joint(spark, monkeypatch):
    """However many batches a task has; the sums are those of batches sent one by one."""
    sent, add = [], common.add_states
    monkeypatch.setattr(common, "add_states", lambda parts, widest: (sent.append(parts.count()), add(parts, widest))[1])
    rows = spark.range(0, 600, 1, 2).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("joint_id"), F.col("id").alias("seq"),
                                            F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    models = spark.createDataFrame([("a",), ("b",)], "joint_id string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        found = []
        for known in (common.shared_models(models), None):
            sharing = {"known": known} if known else {"max_shared_joints": 1, "chunk_rows": 50}
            sums = common.summed(rows, models, lambda model, x: x.sum(axis=0), common.parts_of(rows, **sharing), **sharing)
            found.append({r["joint_id"]: np.frombuffer(r["state"]).tolist() for r in sums.collect()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found[0] == found[1] == {"a": [float(sum(range(0, 600, 3))), 200.0], "b": [float(sum(i for i in range(600) if i % 3)), 400.0]}
    assert sent == [4, 24]


@pytest.mark.parametrize("kernel", svm.KERNELS)
def test_svm_maps_rows_in_pieces(monkeypatch, kernel):
    """The margins of many rows are those of the rows alone, and no more than a piece of them is mapped at once."""
    rng = np.random.default_rng(2)
    x, marks = rng.normal(size=(70, 3)), rng.normal(size=(9, 3))
    monkeypatch.setattr(svm, "PIECE", 16)
    assert [len(p) for p in svm.pieces(x)] == [16, 16, 16, 16, 6] and (np.concatenate(svm.pieces(x)) == x).all()
    model = {"spread": 1.0, "marks": marks.ravel().tolist() if kernel in ("poly", "sigmoid") else []}
    mapping = svm._mapping(model, 3, kernel, 0.3, 42)
    assert svm._mapping(model, 3, kernel, 0.3, 42) is mapping
    whole = svm.feature_map(x, kernel, 0.3, 42, marks)
    assert np.allclose(np.concatenate([mapping(p) for p in svm.pieces(x)]), whole, rtol=1e-12, atol=1e-12)
    if kernel in ("poly", "sigmoid"):
        dot = 0.3 * (x @ marks.T)
        assert np.allclose(svm.kernel(x, marks, kernel, 0.3), dot**3 if kernel == "poly" else np.tanh(dot), rtol=1e-12)


def test_forest_writes_the_matrix_once(matrix, monkeypatch):
    """Scaling, sampling and scoring write one table as wide as the features: the scored one."""
    wide = []
    for module in (registry, forest, common):
        monkeypatch.setattr(module, "materialise", lambda df, real=module.materialise: (set(COLUMNS) <= set(df.columns) and wide.append(1), real(df))[1])
    registry.detect_anomalies(matrix).count()
    assert len(wide) == 1
    registry.detect_anomalies(matrix, registry.default_config("local_outlier_factor")).count()
    assert len(wide) == 2


def test_registry_checks():
    Config = registry.ModelConfig
    assert registry.check_config(Config()) is None and "unknown model" in registry.check_config(Config("kmeans"))
    assert "no parameter" in registry.check_config(Config("one_class_svm", {"depth": 1}))
    assert "outside" in registry.check_config(Config("autoencoder", {"epochs": 5})) and registry.check_config(Config("autoencoder", {"epochs": 10})) is None
    assert registry.with_contamination(None, 0.9).params == {"contamination": 0.5}
    assert registry.with_contamination(Config("one_class_svm", {"nu": 0.1}), 0.2).params == {"nu": 0.1}
    assert registry.with_contamination(Config("autoencoder", {"contamination": 0.3}), 0.2).params == {"contamination": 0.2}


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([("a", 0, 0.0)], "joint_id string, seq long, timestamp double")
    with pytest.raises(ValueError, match="no numeric"):
        registry.detect_anomalies(df)
    with pytest.raises(ValueError, match="unknown"):
        registry.detect_anomalies(df, registry.ModelConfig("other"))


def test_rates(spark):
    df = spark.createDataFrame([("a", 1), ("a", -1), ("b", 1)], "joint_id string, anomaly int")
    assert [(r["total_readings"], r["anomaly_count"], r["anomaly_rate"]) for r in anomaly_rates(df).orderBy("joint_id").collect()] == [(2, 1, 0.5), (1, 0, 0.0)]


def test_small_blocks_meet_in_groups(spark, monkeypatch):
    """With small blocks a point is sent to a few groups, not to every block, and no more than k edges a point come back."""
    x = np.random.default_rng(3).normal(size=(600, 6))
    df = spark.createDataFrame([("hot", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    tasks = spark.sparkContext.accumulator(0)
    real = lof.cut_edges

    def counting(edges, k):
        tasks.add(1)
        out = real(edges, k)
        assert out.num_rows <= k * len(set(out["point"].to_pylist()))
        return out

    monkeypatch.setattr(lof, "cut_edges", counting)
    got = lof.outlier_factors(df, 6, block_points=8).orderBy("seq").toPandas()
    assert np.allclose(got.value, brute_lof(x, 6)) and 0 < tasks.value <= 4


def test_nearest_by_product_equals_differences():
    """Far from the origin and with copies and ties the matrix product alone would mix up neighbours."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 5)) * 1e-3 + 1e4, np.full((3, 5), 1e4), rng.integers(0, 2, (60, 5)) + 1e4])
    table = pa.table({"joint_id": ["a"] * len(x), "point": np.arange(len(x)), "copies": np.ones(len(x), int), "x": pa.chunked_array([pa.array(x.tolist())])})
    assert lof.rough_squares(x, x) is not None
    d = lof.distances(x, x, 2)
    for i, (ids, far, _) in enumerate(lof.nearest(table, table, 7, 2)):
        want = [j for j in np.lexsort((np.arange(len(x)), d[i])) if j != i][:7]
        assert ids.tolist() == want and (far == d[i][want]).all()
    assert np.allclose(lof.raised(np.abs(x[:5]), 3), np.abs(x[:5]) ** 3)


def test_forest_writes_scores_only(spark, monkeypatch):
    """Columns that travel along reach the result and are not written with the scores."""
    rows = spark.createDataFrame([("a", i, 200, [float(i % 7), float(i)], "t" * 50) for i in range(200)], "joint_id string, seq long, n long, x array<double>, note string")
    written, real = [], forest.materialise
    monkeypatch.setattr(forest, "materialise", lambda df: written.append(df.columns) or real(df))
    out = forest.isolation_forest(rows, {"n_estimators": 10, "contamination": 0.1})
    assert not any("note" in columns for columns in written) and out.where("note is null").count() == 0
    plain = forest.isolation_forest(rows.drop("note"), {"n_estimators": 10, "contamination": 0.1})
    assert out.drop("note").exceptAll(plain).isEmpty() and out.where("anomaly = -1").count() == 20


def test_a_point_is_sent_once_for_each_tile(spark, monkeypatch):
    """However many blocks a joint has, its points go to a few tiles, and a task compares near blocks only, tile or not."""
    monkeypatch.setattr(lof, "TILE_POINTS", 64)
    for n, block in ((8, 16), (24, 8)):
        rng = np.random.default_rng(6)
        centres = rng.normal(size=(n, 6)) * 100
        x = (centres[:, None, :] + rng.normal(size=(n, 64, 6))).reshape(-1, 6)
        x[:40] = x[0]  # copies count, and are not sent again
        df = spark.createDataFrame([("hot", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
        sent, tiles, pairs = (spark.sparkContext.accumulator(0) for _ in range(3))
        near_pairs, take, edges = lof.near_pairs, lof.Tile.take, lof.Tile.edges

        def counting(rows, own, bound, points, k, power, near_pairs=near_pairs, pairs=pairs):
            pairs.add(len(rows) * len(points[0]))
            return near_pairs(rows, own, bound, points, k, power)

        monkeypatch.setattr(lof, "near_pairs", counting)
        monkeypatch.setattr(lof.Tile, "take", lambda self, table, take=take, sent=sent: (sent.add(table.num_rows), take(self, table))[1])
        monkeypatch.setattr(lof.Tile, "edges", lambda self, edges=edges, tiles=tiles: (tiles.add(1), edges(self))[1])
        got = lof.outlier_factors(df, 5, block_points=block).orderBy("seq").toPandas()
        monkeypatch.setattr(lof, "near_pairs", near_pairs)
        monkeypatch.setattr(lof.Tile, "take", take)
        monkeypatch.setattr(lof.Tile, "edges", edges)
        points = len(x) - 39
        assert 1 < tiles.value <= lof.TILES and sent.value == tiles.value * points
        assert 0 < pairs.value < 0.5 * points**2
        assert np.allclose(got.value[40:], brute_lof(x, 5)[40:], rtol=1e-6) and got.value[:40].nunique() == 1


def test_tiles_over_several_joints_and_batches(spark, monkeypatch):
    """A tile's rows may end in any batch, a task may have several tiles, and a joint fewer points than neighbours asked for."""
    monkeypatch.setattr(lof, "TILE_POINTS", 16)
    monkeypatch.setattr(lof, "TILE_TASKS", 3)
    monkeypatch.setattr(lof, "PAIRS", 50)
    rng = np.random.default_rng(4)
    parts = {"a": rng.normal(size=(120, 3)), "b": rng.normal(size=(77, 3)) * 3, "c": rng.normal(size=(9, 3))}
    df = spark.createDataFrame([(j, i, r.tolist()) for j, x in parts.items() for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for power in (2, 3):
            got = lof.outlier_factors(df, 12, block_points=5, p=power).orderBy("joint_id", "seq").toPandas()
            whole = lof.outlier_factors(df, 12, p=power).orderBy("joint_id", "seq").toPandas()
            assert len(got) == 206 and np.allclose(got.value, whole.value)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
