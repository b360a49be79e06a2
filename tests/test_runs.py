import math

import pytest

from conftest import rows
from ledgerflow.operators import runs as rn

SCHEMA = ("engine string, workload string, sample_fraction double, data_size_mb double, "
          "wall_time_sec double, peak_memory_mb double, cpu_time_sec double, exit_code int")


def _runs(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_first_per_key_uses_explicit_order(spark):
    df = _runs(spark, [("spark", "w", 1.0, 10.0, 5.0, 1.0, 1.0, 0),
                       ("spark", "w", 1.0, 10.0, 3.0, 2.0, 1.0, 0),
                       ("hadoop", "w", 1.0, 10.0, 9.0, 3.0, 1.0, 0)])
    got = rows(rn.first_per_key(df, ["engine", "workload"], ["wall_time_sec"]),
               "engine", "wall_time_sec", "peak_memory_mb")
    assert got == [("hadoop", 9.0, 3.0), ("spark", 3.0, 2.0)]


def test_pivot_missing_cells_are_null_and_matrix_fills_zero(spark):
    df = _runs(spark, [("spark", "WL1_aggregation", 1.0, 1.0, 4.0, 1.0, 1.0, 0),
                       ("hadoop", "WL2_fraud", 1.0, 1.0, 8.0, 1.0, 1.0, 0)])
    piv = {r.engine: r for r in rn.pivot_metric(df, "wall_time_sec").collect()}
    assert piv["spark"].WL1_aggregation == 4.0 and piv["spark"].WL2_fraud is None
    mat = {r.engine: r for r in rn.time_matrix(df).collect()}
    assert mat["spark"].WL2_fraud == 0.0 and mat["hadoop"].WL2_fraud == 8.0


def test_fit_needs_two_points_and_matches_least_squares(spark):
    df = _runs(spark, [("spark", "w", 0.1, 1.0, 1.0, 10.0, 1.0, 0),
                       ("spark", "w", 0.5, math.e, 1.0, 12.0, 1.0, 0),
                       ("spark", "w", 1.0, math.e ** 2, 1.0, 14.0, 1.0, 0),
                       ("hadoop", "w", 1.0, 5.0, 1.0, 3.0, 1.0, 0)])
    fit = {r.engine: r for r in rn.fit_log(df).collect()}
    assert set(fit) == {"spark"}
    assert fit["spark"].slope == pytest.approx(2.0) and fit["spark"].intercept == pytest.approx(10.0)
    curve = rn.fit_curve(rn.fit_log(df), points=5).collect()
    by_i = {r.i: r.y for r in curve}
    assert len(curve) == 5 and by_i[0] == pytest.approx(10.0) and by_i[4] == pytest.approx(14.0)


def test_summary_skips_incomplete_rows_and_rounds(spark):
    df = _runs(spark, [("spark", "w", 1.0, 1.0, 12.25, 100.5, 1.0, 0),
                       ("spark", "w", 0.5, 1.0, None, 1.0, 1.0, 0)])
    assert rows(rn.summary(df), "time_sec", "memory_mb") == [("12.3", "101")]


def test_successful_excludes_failed_runs(spark):
    df = _runs(spark, [("spark", "w", 1.0, 1.0, 2.0, 1.0, 1.0, 1),
                       ("spark", "w", 1.0, 1.0, 0.0, 1.0, 1.0, 0),
                       ("spark", "w", 1.0, 1.0, 2.0, 1.0, 1.0, 0)])
    assert rn.successful(df).count() == 1


def test_near_fractions_match_by_tolerance(spark):
    df = _runs(spark, [("spark", "w", f, 1.0, 1.0, 1.0, 1.0, 0) for f in (0.104, 0.106, 0.25, 0.26, None)])
    got = {r.sample_fraction: r.fraction_key for r in rn.match_fractions(df).collect()}
    assert got == {0.104: 0.104, 0.106: 0.104, 0.25: 0.25, 0.26: 0.26, None: None}


def test_failed_and_untimed_runs_do_not_come_first(spark):
    df = _runs(spark, [("spark", "w", 1.0, 1.0, None, 1.0, 1.0, 0), ("spark", "w", 1.0, 1.0, 3.0, 1.0, 1.0, 0)])
    assert rows(rn.first_per_key(df, ["engine"], ["wall_time_sec"]), "wall_time_sec") == [(3.0,)]


def test_unlisted_workloads_are_not_lost(spark):
    df = _runs(spark, [("spark", "NEW", 1.0, 1.0, 4.0, 1.0, 1.0, 0), ("spark", None, 1.0, 1.0, 9.0, 1.0, 1.0, 0)])
    assert rows(rn.pivot_metric(df, "wall_time_sec"), "unlisted") == [(9.0,)]
    assert rows(rn.time_matrix(df), "unlisted") == [(4.0,)]
    assert rows(rn.metric_long(df, ["wall_time_sec"]), "workload", "value") == [("NEW", 4.0), (None, 9.0)]
