from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from ledgerflow import fixtures as fx
from ledgerflow.operators import runs as rn
from ledgerflow.plans import sweep as sw
from ledgerflow.plans import workloads as wl
from ledgerflow.session import scratch_path
from ledgerflow.streaming.incremental import start_daily_stream


def test_stream_emits_closed_days_like_batch(spark):
    ta = fx.ta(spark, SF_SMALL)
    src = scratch_path(spark, "stream_src")
    ta.write.parquet(src)
    sink, ckpt = scratch_path(spark, "stream_sink"), scratch_path(spark, "stream_ckpt")
    q = start_daily_stream(spark, src, ta.schema, fx.TA_LAYOUT, sink, ckpt, trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    max_day = ta.agg(F.max(F.floor(F.col("step") / 24))).collect()[0][0]
    batch = wl.workload1([(ta, fx.TA_LAYOUT)]).filter(F.col("day") < max_day - 1)
    got = out.filter(F.col("day") < max_day - 1)
    cols = ["account", "day", "type", "tx_count", "fraud_count"]
    assert rows(got, *cols) == rows(batch, *cols) and got.count() > 0


def test_sweep_feeds_run_analytics(spark):
    runs = sw.sweep(spark, SF_SMALL, fractions=(0.5, 1.0))
    assert runs.count() == 6 and runs.filter("exit_code = 0").count() == 6
    full = {r.workload: r.output_rows for r in runs.filter("sample_fraction = 1.0").collect()}
    assert full["WL2_fraud"] == fx.ta(spark, SF_SMALL).count() + fx.tb(spark, SF_SMALL).count()
    assert rn.scaling_curve(runs).count() == 6


def test_stream_restart_picks_up_new_files_once(spark):
    ta = fx.ta(spark, SF_SMALL)
    src = scratch_path(spark, "stream_src2")
    sink, ckpt = scratch_path(spark, "stream_sink2"), scratch_path(spark, "stream_ckpt2")
    ta.filter("step < 240").write.parquet(src + "/a")
    q = start_daily_stream(spark, src + "/*", ta.schema, fx.TA_LAYOUT, sink, ckpt, trigger_once=True)
    q.awaitTermination(120)
    first = spark.read.parquet(sink).count()
    ta.filter("step >= 240").write.parquet(src + "/b")
    q = start_daily_stream(spark, src + "/*", ta.schema, fx.TA_LAYOUT, sink, ckpt, trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    max_day = ta.agg(F.max(F.floor(F.col("step") / 24))).collect()[0][0]
    batch = wl.workload1([(ta, fx.TA_LAYOUT)]).filter(F.col("day") < max_day)
    cols = ["account", "day", "type", "tx_count", "fraud_count"]
    assert 0 < first < out.count()
    assert rows(out, *cols) == rows(batch, *cols)
