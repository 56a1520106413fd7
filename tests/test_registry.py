"""The registered queries and their SQL. FULL_CHECKS=1 runs all of them, otherwise a cross-section."""

import os

import pytest

import __spark_entry__ as entry
from checks.verify import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ("roles_inferred", "quality_column_profile", "map_row_numbers_by_range", "map_six_segments", "features_statistical_small_chunks", "features_spectral_all",
        "features_magnetometer_set", "detect_local_outlier_factor_blocks", "wear_physics", "materials_ranked", "project_scenarios_ranked", "evaluate_confusion")


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 and {r["wear_status"] for r in rows} <= {"healthy", "moderate", "severe"}


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if os.environ.get("FULL_CHECKS") or n in SOME])
def test_same_as_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(entry.oracle_sql()[name]).df()) == "ok"
