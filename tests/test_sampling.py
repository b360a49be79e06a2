from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerflow import fixtures as fx
from ledgerflow.operators import runs as rn
from ledgerflow.operators import sampling as smp
from ledgerflow.session import scratch_path
from ledgerflow.sources.sinks import normalise_runs


def test_hash_sample_is_layout_independent(spark):
    ta = fx.ta(spark, SF_SMALL)
    a = {r.tx_id for r in smp.hash_sample(ta, ["tx_id"], 0.3).collect()}
    b = {r.tx_id for r in smp.hash_sample(ta.repartition(7), ["tx_id"], 0.3).collect()}
    assert a == b and 0 < len(a) < ta.count()


def test_ladder_is_nested_and_written_once(spark):
    ta = fx.ta(spark, SF_SMALL)
    path = scratch_path(spark, "ladder")
    smp.write_ladder(ta, ["tx_id"], path)
    sets = [{r.tx_id for r in smp.read_rung(spark, path, f).collect()} for f in smp.DEFAULT_FRACTIONS]
    assert all(a <= b for a, b in zip(sets, sets[1:]))
    assert len(sets[-1]) == ta.count()
    assert sets[0] == {r.tx_id for r in smp.hash_sample(ta, ["tx_id"], 0.1).collect()}
    counts = {r.fraction: r.sampled_rows for r in smp.ladder_counts(ta, ["tx_id"]).collect()}
    assert [counts[f] for f in smp.DEFAULT_FRACTIONS] == [len(s) for s in sets]
    # existing ladder is left as it is
    smp.write_ladder(ta.limit(1), ["tx_id"], path)
    assert smp.read_rung(spark, path, 1.0).count() == ta.count()


def test_full_size_fallback(spark):
    runs = normalise_runs(fx.runs(spark, SF_SMALL))
    ok = rn.successful(runs)
    # the fixture repeats each run at nearly the same fraction
    assert {r.sample_fraction for r in rn.full_size(ok).collect()} == {1.0, 1.004}
    part = ok.filter(F.col("sample_fraction") < 0.99)
    mx = part.agg(F.max("sample_fraction")).collect()[0][0]
    got = {r.sample_fraction for r in rn.full_size(part).collect()}
    assert got and all(f >= mx - 0.01 for f in got)


def test_speedup_guard(spark):
    df = spark.createDataFrame([("spark", "w", 0.0), ("hadoop", "w", 5.0), ("hadoop", "v", 3.0)],
                               "engine string, workload string, wall_time_sec double")
    out = {r.workload: r.speedup for r in rn.speedup(df, ["workload"]).collect()}
    assert out == {"w": None, "v": None}
    assert rn.speedup(df, ["workload"], require_both=True).count() == 0


def test_recommended_shuffle_partitions(spark):
    from ledgerflow.session import recommended_shuffle_partitions
    paths = [f"{SF_SMALL}/lineitem.parquet", f"{SF_SMALL}/events.parquet"]
    assert recommended_shuffle_partitions(spark, paths) == spark.sparkContext.defaultParallelism
    # a tiny target size asks for more partitions than cores
    assert recommended_shuffle_partitions(spark, paths, target_mb=0.01) > spark.sparkContext.defaultParallelism
