import numpy as np
import pytest
from pyspark.sql import functions as F

from tribospark.operators.ordering import chunked, number_rows, own_rows, running_totals, with_previous
from tribospark.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, and many equal times."""
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        (F.hash("id") % 50).alias("t"), F.col("id").alias("tie"))
    return rows.cache()


def test_range_numbering_equals_window(skewed):
    plain = number_rows(skewed, ["g"], ["t", "tie"])
    ranged = number_rows(skewed, ["g"], ["t", "tie"], max_window_rows=1, range_rows=500)
    assert plain.exceptAll(ranged.select(plain.columns)).isEmpty() and ranged.count() == 6000


def test_range_numbering_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None if i % 2 else "a", i % 4, i) for i in range(200)], "g string, t int, tie int")
    plain = number_rows(rows, ["g"], ["t", "tie"])
    ranged = number_rows(rows, ["g"], ["t", "tie"], max_window_rows=1, range_rows=30)
    assert ranged.count() == 200 and plain.exceptAll(ranged.select(plain.columns)).isEmpty()


def test_range_numbering_without_group_and_with_null_times(spark):
    rows = spark.createDataFrame([(None if i % 10 == 0 else float(i % 13), i) for i in range(500)], "t double, tie long")
    plain = number_rows(rows, [], ["t", "tie"])
    ranged = number_rows(rows, [], ["t", "tie"], max_window_rows=1, range_rows=60)
    assert plain.exceptAll(ranged.select(plain.columns)).isEmpty()
    assert plain.filter("t is null").agg(F.min("seq")).first()[0] == 450


def test_chunks_are_bounded_and_whole(skewed):
    pieces = chunked(number_rows(skewed, ["g"], ["t", "tie"]), ["g"], 20, chunk_rows=256)
    assert pieces.groupBy("g", "chunk").count().agg(F.max("count")).first()[0] <= 276
    assert pieces.filter(own_rows(chunk_rows=256)).count() == 6000
    with pytest.raises(ValueError):
        chunked(skewed, ["g"], 10, chunk_rows=5)


def test_previous_row_across_chunks(skewed):
    rows = number_rows(skewed, ["g"], ["t", "tie"])
    got = with_previous(rows, ["g"], {"before": "tie"}, chunk_rows=64).toPandas().sort_values(["g", "seq"])
    want = got.groupby("g")["tie"].shift()
    assert got["before"].fillna(-1).tolist() == want.fillna(-1).tolist()


def test_running_totals_both_ways(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    a = running_totals(rows, "k", {"s": "v"}).select("k", "s")
    b = running_totals(rows, "k", {"s": "v"}, max_window_rows=1, range_rows=90).select("k", "s")
    assert a.exceptAll(b).isEmpty() and b.count() == 1000


@pytest.mark.parametrize("limit", [10**6, 20])
def test_quantiles_match_numpy(spark, limit):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(400, 2.5), rng.normal(size=500), [1e300, -1e300, 5e-324]])
    cold = rng.integers(0, 9, 15).astype(float)
    rows = spark.createDataFrame([("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("hot", None), ("hot", float("nan"))], "g string, v double")
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(rows, ["g"], "v", probs, max_group_values=limit).collect()}
    for name, values in (("hot", hot), ("cold", cold)):
        assert np.allclose(got[name], np.percentile(values, np.array(probs) * 100), rtol=1e-12)


def test_weighted_and_ungrouped_quantiles(spark):
    rows = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4)], "v double, w long")
    want = np.percentile([1.0] * 5 + [2.0] + [9.0] * 4, [50, 60])
    for limit in (100, 1):
        got = exact_quantiles(rows, [], "v", [0.5, 0.6], weight="w", max_group_values=limit).first()[0]
        assert np.allclose(got, want)


@pytest.mark.parametrize("kind", ["infinities", "decades", "one infinity"])
def test_narrowing_ends_in_six_passes(spark, kind, monkeypatch):
    from tribospark.operators import quantiles

    passes = []
    real = quantiles._next_bounds
    monkeypatch.setattr(quantiles, "_next_bounds", lambda *a: passes.append(1) or real(*a))
    rng = np.random.default_rng(8)
    values = {
        "infinities": [float("inf")] * 5 + [float("-inf")] * 3 + rng.normal(size=50).tolist(),
        "decades": (10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300)).tolist(),
        "one infinity": [*range(50), float("inf")],
    }[kind]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    got = exact_quantiles(rows, [], "v", [0.0, 0.5, 1.0], max_group_values=10).first()[0]
    want = sorted(values)
    middle = (want[(len(want) - 1) // 2] + want[len(want) // 2]) / 2
    assert got[0] == want[0] and got[2] == want[-1] and got[1] == pytest.approx(middle, rel=1e-12)
    assert len(passes) <= 6


def test_columns_for_order_only_are_not_written(spark, monkeypatch):
    from tribospark.operators import ordering

    rows = spark.createDataFrame([("ab"[i % 2], i % 5, i, float(i)) for i in range(200)], "g string, t long, tie long, v double")
    written, real = [], ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df: written.append(df.columns) or real(df))
    ranged = number_rows(rows, ["g"], ["t", "tie"], max_window_rows=1, range_rows=30, without=("tie",))
    assert written and not any("tie" in columns for columns in written) and ranged.columns == ["g", "t", "v", "seq"]
    assert ranged.exceptAll(number_rows(rows, ["g"], ["t", "tie"]).drop("tie")).isEmpty()
