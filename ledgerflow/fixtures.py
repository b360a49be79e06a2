"""Transaction-shaped views of the driver tables.

* ``ta``  - hourly-step transactions (PaySim roles) derived from ``events``;
* ``tb``  - daily-step transactions (BankSim roles) from ``lineitem`` x ``orders``;
* ``net`` - payment network edges derived from ``tb``;
* ``runs`` - a run-result table derived from ``lineitem``.

Every view is a lazy projection of Parquet scans, so column pruning and
filter pushdown reach the files.  The matching DuckDB text lives in
``ledgerflow.plans.oracle``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import Layout

TA_EPOCH = dt.date(2024, 1, 1)
TB_EPOCH = dt.date(1995, 1, 1)

TA_LAYOUT = Layout("PAYSIM", account="account", step="step", type_="type",
                   amount="amount", label="is_fraud", counterparty="counterparty",
                   steps_per_day=24, key=["tx_id"])
TB_LAYOUT = Layout("BANKSIM", account="customer", step="step", type_="category",
                   amount="amount", label="fraud", counterparty="merchant",
                   steps_per_day=1, key=["line_id", "part_id", "step"])

# Order that decides which edge of a (Source, Target) pair is the "last" one.
NET_EDGE_ORDER = ["step", "line_id", "part_id", "Weight"]


_SCHEMAS: dict[str, tuple] = {}


def _modified(spark: SparkSession, path: str) -> int:
    """Modification time of a file or folder on whatever file system has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table; its schema is read once per path and modification time
    and then passed to the reader, so later plans skip the footer-reading job
    and a rewritten table is read with its own schema."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    at = _modified(spark, path)
    known = _SCHEMAS.get(path)
    if known is None or known[0] != at:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = (at, df.schema)
        return df
    return spark.read.schema(known[1]).parquet(path)


def _hour_step(ts: str) -> F.Column:
    days = F.datediff(F.to_date(ts), F.lit(TA_EPOCH)).cast("long")
    return days * 24 + F.hour(ts)


def ta(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("tx_id"),
        _hour_step("ts").alias("step"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("account"),
        F.concat(F.lit("M"), F.get_json_object("props", "$.k")).alias("counterparty"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"),
    )


def ta_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ta`` with a double step: hours plus the minute as a fraction."""
    ev = table(spark, sf_dir, "events")
    step = _hour_step("ts").cast("double") + F.minute("ts").cast("double") / 60
    return ev.select(
        F.col("event_id").alias("tx_id"),
        step.alias("step"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("account"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"),
    )


def tb(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        F.col("l_partkey").alias("part_id"),
        F.datediff(F.col("l_shipdate"), F.lit(TB_EPOCH)).cast("long").alias("step"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("customer"),
        F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("merchant"),
        F.col("l_returnflag").alias("category"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("fraud"),
    )


def net(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net_of(tb(spark, sf_dir))


def net_of(t: DataFrame, order: tuple[str, ...] = ("line_id", "part_id", "step")) -> DataFrame:
    """``net`` out of ``tb``, e.g. one that was written and read again;
    ``order``: the columns that only the order of a pair's edges needs."""
    return t.filter(F.col("category") == "R").select(
        F.col("customer").alias("Source"), F.col("merchant").alias("Target"),
        F.col("amount").alias("Weight"), F.col("category").alias("typeTrans"),
        "fraud", *order)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    yr = F.year("l_shipdate")
    g = li.groupBy("l_linestatus", "l_returnflag", yr.alias("yr")).agg(
        F.round(F.sum("l_extendedprice") / 1000000, 4).alias("data_size_mb"),
        F.sum("l_quantity").cast("double").alias("wall_time_sec"),
        F.round(F.sum("l_tax"), 4).alias("cpu_time_sec"),
        F.round(F.avg("l_extendedprice"), 4).alias("peak_memory_mb"),
        F.count(F.lit(1)).cast("long").alias("output_rows"),
    )
    plain = g.select(
        F.when(F.col("l_linestatus") == "F", "Spark_PySpark")
         .otherwise("Hadoop_MapReduce").alias("engine"),
        F.when(F.col("l_returnflag") == "A", "WL1_aggregation")
         .when(F.col("l_returnflag") == "N", "WL2_fraud")
         .otherwise("WL3_join_window").alias("workload"),
        F.round((F.col("yr") - 1994).cast("double") / 7, 3).alias("sample_fraction"),
        "data_size_mb", "wall_time_sec", "cpu_time_sec", "peak_memory_mb", "output_rows",
        F.when((F.col("yr") == 1996) & (F.col("l_returnflag") == "R"), 1)
         .otherwise(0).cast("int").alias("exit_code"),
    )
    # of each run: a repeat at nearly the same fraction, a run of a workload
    # that no list names, and a failed run without a time
    kind = F.explode(F.array(*[F.lit(k) for k in ("plain", "near", "other", "failed")])).alias("kind")
    every = plain.select("*", kind)
    return every.select(
        "engine", F.when(F.col("kind") == "other", F.lit("WL9_custom")).otherwise(F.col("workload")).alias("workload"),
        F.when(F.col("kind") == "near", F.round(F.col("sample_fraction") + 0.004, 3))
         .otherwise(F.col("sample_fraction")).alias("sample_fraction"),
        "data_size_mb",
        F.when(F.col("kind") == "near", F.col("wall_time_sec") + 1)
         .when(F.col("kind") != "failed", F.col("wall_time_sec")).alias("wall_time_sec"),
        "cpu_time_sec", "peak_memory_mb", "output_rows",
        F.when(F.col("kind") == "failed", 1).otherwise(F.col("exit_code")).cast("int").alias("exit_code"))
