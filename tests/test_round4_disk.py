"""What stays on disk: tables and shuffle files are dropped once nothing reads them, and wide tables are not written."""

from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import fixtures
from tribospark import session
from tribospark.operators import evaluation
from tribospark.operators import features as feature_module
from tribospark.operators.detect import common, lof, registry
from tribospark.operators.mapping import SignalTable
from tribospark.plans import analysis
from tribospark.session import materialise, settled, side_by_side


@pytest.fixture(autouse=True)
def own_folder(monkeypatch, tmp_path):
    """Tables of other tests and sessions are not counted."""
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))


def tables(spark):
    """Folders of written tables."""
    root = Path(session.scratch_root(spark))
    return {p.parent for p in root.rglob("_SUCCESS")}


def series(spark, n, joints=2):
    """Features of ``n`` rows a joint, some of them far off."""
    rng = np.random.default_rng(3)
    rows = [(f"j{j}", i, float(i), *map(float, rng.normal(size=3) * (9 if i % 40 == 0 else 1))) for j in range(joints) for i in range(n)]
    return spark.createDataFrame(rows, "joint_id string, seq long, timestamp double, vibration_mean double, vibration_rms double, vibration_energy double")


def test_settled_keeps_one_table(spark):
    """Also inside itself, in threads, and where the work fails; tables from before stay."""
    kept, before = materialise(spark.range(4)), tables(spark)

    def inner(n):
        return settled(lambda: materialise(spark.range(n)).union(materialise(kept.select("id"))))

    out = settled(lambda: side_by_side(inner, [1, 2, 3], 3)[2])
    assert out.count() == 7 and kept.count() == 4 and len(tables(spark) - before) == 1

    def fails():
        materialise(spark.range(3))
        raise ValueError("no result")

    with pytest.raises(ValueError, match="no result"):
        settled(fails)
    assert len(tables(spark) - before) == 1 and materialise(spark.range(2)).count() == 2


def test_shuffle_files_go_with_the_write(spark):
    setting = spark.conf.get(session.SHUFFLE_CLEANUP, None)
    drops, real = [], session._shuffles_dropped
    with real(spark), real(spark):
        drops.append(spark.conf.get(session.SHUFFLE_CLEANUP))
    assert drops == ["true"] and spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = store.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    before = files()
    materialise(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count())
    assert not {f for f in files() - before if f.startswith("shuffle_")}


def test_comparison_leaves_its_rows_only(spark, monkeypatch):
    features = materialise(series(spark, 300))
    monkeypatch.setattr(analysis, "features_of", lambda *_: features)
    before = tables(spark)
    rows, best = analysis.compare_models(None, analysis.Options(), ("local_outlier_factor", "autoencoder"))
    assert rows.count() == 2 and best.count() == 1 and len(tables(spark) - before) == 1


@pytest.mark.parametrize("model_id", list(registry.MODELS))
def test_a_large_matrix_is_not_written(spark, monkeypatch, model_id):
    """Neither scaled nor scored with what travels along, and with the same labels and scores as a small one."""
    features, config = materialise(series(spark, 250)), registry.default_config(model_id)
    small = registry.detect_anomalies(features, config).orderBy("joint_id", "seq").toPandas()
    before = tables(spark)
    monkeypatch.setattr(registry, "WIDE_NUMBERS", 100)
    large = registry.detect_anomalies(features, config)
    written = [spark.read.parquet(str(p)).columns for p in tables(spark) - before]
    assert written and not any({"timestamp", "vibration_mean"} & set(columns) for columns in written)
    large = large.orderBy("joint_id", "seq").toPandas()
    assert large.columns.tolist() == small.columns.tolist() and (large.anomaly == small.anomaly).all() and np.allclose(large.anomaly_score, small.anomaly_score)


def test_scaling_reads_the_rows_once(spark):
    """Also the count of rows; a group or column without values keeps its rows."""
    rows = spark.createDataFrame([("a", 0, 1.0, None), ("a", 1, 3.0, None), ("b", 0, None, None)], "joint_id string, seq long, p double, q double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    got = {r["joint_id"]: r for r in common.scaling_stats(rows.mapInArrow(counted, rows.schema), ["p", "q"], ["joint_id"]).collect()}
    assert read.value == 3 and {j: r["n"] for j, r in got.items()} == {"a": 2, "b": 1}
    assert got["a"]["means"] == [2.0, None] and got["a"]["units"] == [1.0, None] and got["b"]["means"] is None
    assert common.scaling_stats(rows.limit(0), ["p"], []).first()["n"] == 0


def test_tiles_take_turns(spark, monkeypatch):
    """A wave sends its own tiles' rows only; factors are those of all tiles at once."""
    monkeypatch.setattr(lof, "TILE_POINTS", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 4))
    x[:30] = x[30]
    df = spark.createDataFrame([(f"j{i % 2}", i, r.tolist()) for i, r in enumerate(x)], "joint_id string, seq long, x array<double>")
    once = lof.outlier_factors(df, 6, block_points=16).orderBy("seq").toPandas()
    parts, real = [], lof.edge_parts
    monkeypatch.setattr(lof, "edge_parts", lambda *args: parts.append(real(*args)) or parts[-1])
    monkeypatch.setattr(lof, "WAVE_NUMBERS", 1)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda _: 2))
    turns = lof.outlier_factors(df, 6, block_points=16).orderBy("seq").toPandas()
    assert len(parts[0]) > 2 and all(not part.isEmpty() for part in parts[0])
    assert len(turns) == 900 and np.allclose(turns.value, once.value)
    whole = lof.outlier_factors(df, 6, block_points=4096).orderBy("seq").toPandas()
    assert np.allclose(turns.value, whole.value)


@pytest.mark.parametrize("clash", [False, True])
def test_rows_meet_their_point_by_a_hash(spark, monkeypatch, clash):
    """Zero and minus zero are one point, and points that share a hash are told apart."""
    rows = spark.createDataFrame([("a", 0, [0.0, 1.0]), ("a", 1, [-0.0, 1.0]), ("a", 2, [2.0, 1.0]), ("b", 3, [0.0, 1.0]), (None, 4, [0.0, 1.0])],
                                 "joint_id string, seq long, x array<double>")
    points = materialise(rows.groupBy("joint_id", "x").agg(F.min("seq").alias("point"), F.count("*").alias("copies")))
    if clash:
        monkeypatch.setattr(lof.F, "xxhash64", lambda *_: F.lit(7))
    got = lof._of_rows(rows, points).orderBy("seq").collect()
    assert [tuple(r) for r in got] == [("a", 0, 0), ("a", 1, 0), ("a", 2, 2), ("b", 3, 3)]


def test_repeats_share_one_shuffle_and_get_the_same_values(spark, monkeypatch):
    rows = spark.range(300).select(F.lit("p").alias("joint_id"), F.col("id").alias("seq"), F.lit(300).alias("n"), F.array(F.col("id") * 1.0, F.sqrt("id")).alias("x"))
    got = {r["seq"]: r["_v"] for r in evaluation.shuffled_values(rows, 1, [42, 43, 44]).collect()}
    for i, seed in enumerate((42, 43, 44)):
        assert {r["seq"]: r["x"][1] for r in evaluation.shuffled(rows, 1, seed).collect()} == {seq: v[i] for seq, v in got.items()}
    real = evaluation.number_rows
    monkeypatch.setattr(evaluation, "number_rows", lambda *args, **more: real(*args, **more, max_window_rows=50, range_rows=40))
    assert {r["seq"]: r["_v"] for r in evaluation.shuffled_values(rows, 1, [42, 43, 44]).collect()} == got


def test_shuffled_matrices_do_not_pile_up(spark, monkeypatch):
    """Whatever the number of features, no more tables are there than those of the fits that run; only the result stays."""
    features, most, real = materialise(series(spark, 60)), [], evaluation.MODELS["isolation_forest"]
    before = tables(spark)

    def run(rows, params, seed):
        most.append(len(tables(spark) - before))
        return rows.select(F.col("x")[0].alias("anomaly_score"))

    monkeypatch.setitem(evaluation.MODELS, "isolation_forest", SimpleNamespace(run=run, parameters=real.parameters))
    wide = features.select("*", *[(F.col("vibration_mean") + i).alias(f"vibration_{i}") for i in range(5)])
    out = evaluation.permutation_importance(wide, repeats=3)
    assert out.count() == 8 and len(most) == 1 + 8 * 3 and max(most) <= 14 and len(tables(spark) - before) == 1


def test_many_features_are_made_again_and_not_written(spark, monkeypatch):
    """The default detector then writes nothing as wide as the features, and gives the same rows."""
    rows = spark.range(400).select(F.concat(F.lit("j"), F.col("id") % 2).alias("joint_id"), F.floor(F.col("id") / 2).alias("seq"),
                                   F.col("id").cast("double").alias("t"), F.sin(F.col("id") * F.col("id")).alias("vibration"))
    table = SignalTable(materialise(rows), {"vibration": "vibration"})
    config = registry.with_contamination(registry.default_config(), 0.1)
    written = registry.detect_anomalies(analysis.features_of(table), config).orderBy("joint_id", "seq").collect()
    before = tables(spark)
    monkeypatch.setattr(feature_module, "SPARE_NUMBERS", 1000)
    monkeypatch.setattr(registry, "WIDE_NUMBERS", 1000)
    scored = registry.detect_anomalies(analysis.features_of(table), config)
    assert not any("vibration_rms" in spark.read.parquet(str(p)).columns for p in tables(spark) - before)
    got = scored.orderBy("joint_id", "seq").collect()
    assert [(r["seq"], r["anomaly"]) for r in got] == [(r["seq"], r["anomaly"]) for r in written]
    assert np.allclose([r["anomaly_score"] for r in got], [r["anomaly_score"] for r in written])


def test_a_table_made_once_outlives_the_one_it_is_asked_for(spark):
    """Asked for first on the way to another table, it is still there for a third, and what led to it is not."""
    before = tables(spark)
    first = lambda: fixtures.once(spark, "here", "first", lambda: materialise(spark.range(6)).where("id > 1"))
    second = settled(lambda: fixtures.once(spark, "here", "second", lambda: first().where("id > 2")))
    assert second.count() == 3 and first().count() == 4 and fixtures.once(spark, "here", "second", None).count() == 3
    assert len(tables(spark) - before) == 3
