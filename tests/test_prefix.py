import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from ledgerflow.operators.prefix import exact_quantiles, ordered_prefix, skyline


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.exponential(50, 3000), 1)  # many duplicates
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(5)
    q = exact_quantiles(df, "x", [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0], n_ranges=7).collect()[0]
    for p, name in [(0.0, "q0"), (0.1, "q10"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"),
                    (0.999, "q99_9"), (1.0, "q100")]:
        assert q[name] == pytest.approx(float(np.quantile(vals, p)), abs=1e-9)


def test_grouped_quantiles(spark):
    data = [("a", float(i)) for i in range(11)] + [("b", 5.0), ("b", 7.0)]
    df = spark.createDataFrame(data, "g string, x double")
    out = {r["g"]: r["q50"] for r in exact_quantiles(df, "x", [0.5], by=["g"], n_ranges=3).collect()}
    assert out == {"a": 5.0, "b": 6.0}


def test_ordered_prefix_across_partitions(spark):
    df = spark.range(0, 500).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    out = ordered_prefix(df, "k", "v", how="sum", n_ranges=9)
    got = {r["k"]: (r["prefix_incl"], r["prefix_excl"]) for r in out.collect()}
    run = 0.0
    for k in range(500):
        v = k % 7
        assert got[k] == (run + v, run)
        run += v
    mins = ordered_prefix(df.withColumn("v", (1000 - F.col("k")) % 37 * 1.0), "k", "v",
                          how="min", n_ranges=4).collect()
    m = {r["k"]: r["prefix_excl"] for r in mins}
    best = None
    for k in range(500):
        assert m[k] == best
        v = float((1000 - k) % 37)
        best = v if best is None else min(best, v)


def test_skyline_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 30, (400, 2)))]
    df = spark.createDataFrame(pts, "id long, t double, m double")
    got = sorted(r["id"] for r in skyline(df, ("t", "m"), n_ranges=6).collect())
    want = sorted(i for i, a, b in pts
                  if not any(a2 <= a and b2 <= b and (a2 < a or b2 < b) for _, a2, b2 in pts))
    assert got == want


def test_skyline_per_group(spark):
    df = spark.createDataFrame([("x", 1.0, 5.0), ("x", 2.0, 1.0), ("x", 3.0, 3.0), ("y", 3.0, 3.0)],
                               "g string, t double, m double")
    assert rows(skyline(df, ("t", "m"), by=["g"])) == [("x", 1.0, 5.0), ("x", 2.0, 1.0), ("y", 3.0, 3.0)]


def test_range_id_counts_bounds_below(spark):
    from ledgerflow.operators.prefix import range_id
    bounds = [1.0, 2.0, 2.5, 7.0, 9.0]
    vals = [-5.0, 1.0, 1.5, 2.0, 2.2, 2.5, 3.0, 7.0, 8.0, 9.0, 100.0]
    df = spark.createDataFrame([(v, bounds, []) for v in vals], "v double, b array<double>, e array<double>")
    got = {r.v: r.rid for r in df.select("v", range_id(F.col("v"), F.col("b")).alias("rid")).collect()}
    assert got == {v: sum(b < v for b in bounds) for v in vals}
    assert {r.rid for r in df.select(range_id(F.col("v"), F.col("e")).alias("rid")).collect()} == {0}


def test_null_groups_and_values_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None), ("b", None)], "g string, x double")
    got = {r.g: r.q50 for r in exact_quantiles(df, "x", [0.5], by=["g"], n_ranges=3).collect()}
    assert got == {None: 2.0, "a": 2.0}
    pts = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 3.0), ("a", 1.0, None), ("a", 5.0, 5.0), ("a", 6.0, 6.0)],
                                "g string, t double, m double")
    assert rows(skyline(pts, ("t", "m"), by=["g"])) == rows(pts.filter("t not in (2.0, 6.0)"))


def test_skyline_of_large_longs(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(1, big + 1), (2, big), (3, big)], "t long, m long")
    assert rows(skyline(df, ("t", "m"))) == [(1, big + 1), (2, big)]


def test_no_job_runs_while_the_plan_is_built(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    exact_quantiles(spark.range(100).selectExpr("cast(id as double) x"), "x", [0.5])
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert before is not None
