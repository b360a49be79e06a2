"""Scaling sweep: every workload at every sample fraction, one result row
per run, shaped like the run-result table the run analytics consume.

Samples are key-hash samples (the same rows whatever the layout, nested
across fractions); fact tables are sampled, dimension tables are not.  Each
run is timed around a ``noop`` write that consumes every output column, and
its row count comes from an ``Observation`` on that same write.
"""

from __future__ import annotations

import time
import traceback

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators.quality import footprint
from ..operators.sampling import hash_sample
from ..sources.sinks import RUNS_SCHEMA
from . import workloads as wl

WORKLOADS = {
    "WL1_aggregation": lambda a, b, net: wl.workload1([a, b]),
    "WL2_fraud": lambda a, b, net: wl.workload2([a, b]),
    "WL3_join_window": lambda a, b, net: wl.workload3(hourly=a, daily=b, edges=net,
                                                      network_key="Target"),
}


def _timed(df: DataFrame) -> tuple[float, int]:
    obs = Observation("rows")
    t0 = time.perf_counter()
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0, int(obs.get["n"])


def sweep(spark: SparkSession, sf_dir: str, fractions=(0.1, 0.25, 0.5, 1.0),
          workloads: dict | None = None) -> DataFrame:
    """Run each workload at each fraction; returns a run-result DataFrame."""
    workloads = workloads or WORKLOADS
    sizes = {r["table"]: r["size_mb"] for r in footprint(
        spark, {t: f"{sf_dir}/{t}.parquet" for t in ("events", "lineitem", "orders")}).collect()}
    full_mb = sum(sizes.values())
    ta, tb, net = fx.ta(spark, sf_dir), fx.tb(spark, sf_dir), fx.net(spark, sf_dir)
    out = []
    for f in fractions:
        a = (hash_sample(ta, fx.TA_LAYOUT.key, f), fx.TA_LAYOUT)
        b = (hash_sample(tb, fx.TB_LAYOUT.key, f), fx.TB_LAYOUT)
        for name, build in workloads.items():
            row = {"engine": "Spark_PySpark", "workload": name, "dataset": "ta+tb",
                   "data_size_mb": full_mb * f, "sample_fraction": float(f), "exit_code": 0}
            try:
                secs, n = _timed(build(a, b, net))
                row.update(wall_time_sec=secs, output_rows=n)
            except Exception as e:  # noqa: BLE001 - a failed run is a result row
                row.update(wall_time_sec=0.0, output_rows=0, exit_code=1,
                           error_msg=traceback.format_exception_only(e)[-1].strip()[:500])
            out.append(row)
    rows = [tuple(r.get(c) for c in RUNS_SCHEMA.fieldNames()) for r in out]
    return spark.createDataFrame(rows, RUNS_SCHEMA)
