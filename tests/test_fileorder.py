"""Facts of rows in file order, found in place, against the same facts after a sort."""

import tempfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tribospark.operators import fileorder, mapping, quality, roles
from tribospark.sources.readers import with_file_position


def write(spark, parts):
    """One file for each list of rows, named in the order given."""
    path = tempfile.mkdtemp(prefix="tribospark-test-", dir="/tmp") + "/t"
    for rows in parts:
        spark.createDataFrame(rows, "n long, t double, joint string, v double, w int").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def log(n=400, parts=5, seed=3):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.choice([0.5, 0.5, 0.5, 4.0, -1.0], n))
    rows = [(i, None if i % 37 == 5 else float(t[i]), [None, "a", "b"][rng.integers(3)], None if i % 3 else float(i), int(rng.integers(5))) for i in range(n)]
    cuts = sorted(rng.choice(np.arange(1, n), parts - 1, replace=False).tolist())
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
    return rows, [pieces[i] for i in rng.permutation(parts)]


def collected(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("by", [[], ["joint"]])
def test_steps_of_files_in_any_order(spark, monkeypatch, by):
    _, parts = log()
    df = write(spark, parts)
    want = collected(quality.time_steps(df, "t", ["n"], by, by_runs=False))
    monkeypatch.setattr(quality, "number_rows", None)  # no sort
    got = quality.time_steps(df, "t", ["n"], by)
    assert collected(got) == want and len(want) == sum(r[1] is not None for part in parts for r in part)
    assert collected(quality.time_steps(df.coalesce(1), "t", ["n"], by)) == want  # several runs in a task
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert collected(quality.time_steps(df.coalesce(2), "t", ["n"], by)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_by_file_position(spark, monkeypatch):
    _, parts = log(200, 4)
    placed, order = with_file_position(write(spark, parts))
    placed = placed.where("t is not null")
    want = collected(quality.time_steps(placed, "t", order, by_runs=False))
    monkeypatch.setattr(quality, "number_rows", None)
    assert collected(quality.time_steps(placed, "t", order)) == want


def test_tables_out_of_order_are_sorted(spark, monkeypatch):
    rows, _ = log(300, 1)
    shuffled = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    df = write(spark, [shuffled])
    assert collected(quality.time_steps(df, "t", ["n"])) == collected(quality.time_steps(df, "t", ["n"], by_runs=False))
    times = df.withColumn("_time", F.col("t")).where("t is not null")
    monkeypatch.setattr(fileorder, "MAX_RUNS", 20)
    assert fileorder.steps_by_runs(times, [], ["n"]) is None  # given up
    monkeypatch.setattr(fileorder, "MAX_RUNS", 10**4)
    assert fileorder.steps_by_runs(times, [], ["n"]) is None  # runs overlap
    nulls = times.withColumn("n", F.when(F.col("n") != 9, F.col("n")))
    assert fileorder.steps_by_runs(nulls, [], ["n"]) is None
    assert fileorder.steps_by_runs(times, ["joint", "w"], ["n"]) is None and fileorder.column_steps(df, {"v": F.col("v")}, ["n"]) is None
    assert quality.time_steps(df.limit(0), "t", ["n"]).count() == 0


def test_column_scores_in_place(spark, monkeypatch):
    _, parts = log()
    df = write(spark, parts)
    want = roles.column_scores(df, ["n"], by_runs=False).orderBy("place").collect()
    monkeypatch.setattr(roles, "_sorted_steps", None)
    got = roles.column_scores(df, ["n"]).orderBy("place").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0]["time_score"] > 0.8
    steps = {r["place"]: r for r in fileorder.column_steps(df, {"v": F.col("v"), "none": F.lit(None)}, ["n"]).collect()}
    v = np.arange(0, 400, 3.0)
    assert steps[0]["rows"] == 400 and steps[0]["steps"] == len(v) - 1 == steps[0]["up"] and steps[0]["mean"] == pytest.approx(3) and steps[0]["first"] == 0
    assert steps[0]["spread"] == pytest.approx(0, abs=1e-9) and steps[1]["steps"] == 0 and steps[1]["first"] is None


def test_rows_of_two_sources(spark, monkeypatch):
    """Spark names no split then; each task's rows are one run as long as they ascend."""
    rows, _ = log(100, 2)
    df = write(spark, [rows[:60]]).unionByName(write(spark, [rows[60:]]))
    want = collected(quality.time_steps(df, "t", ["n"], by_runs=False))
    monkeypatch.setattr(quality, "number_rows", None)
    assert collected(quality.time_steps(df, "t", ["n"])) == want


def test_descents():
    a, b = pa.array([1, 1, 2, 2, 1]), pa.array(["a", "b", "a", "a", "z"])
    assert fileorder.descents([a, b]).tolist() == [False, False, False, True]
    assert fileorder.descents([a.slice(0, 1)]).tolist() == []


def test_facts_are_shared(spark, monkeypatch):
    """One pass over the times serves the report and the series."""
    from tribospark.plans import analysis

    calls, real = [], quality.time_steps
    for module in (analysis, quality):
        monkeypatch.setattr(module, "time_steps", lambda *a, **b: calls.append(1) or real(*a, **b))
    rows = [(float(i) / 10, "ab"[i % 2], float(i % 7), i) for i in range(300)]
    df = spark.createDataFrame(rows, "timestamp double, joint string, acc_x double, n int").coalesce(2)
    for first in (False, True):
        made = analysis.ingest(df, ["n"], analysis.Options(write_first=first))
        assert made.table.sampling_rate_hz == 10.0 and made.quality.summary.first()["sampling_rate_hz"] == 10.0
    assert len(calls) == 2
    alone = mapping.map_dataset(df, made.schema, ["n"])
    assert alone.sampling_rate_hz == 10.0
