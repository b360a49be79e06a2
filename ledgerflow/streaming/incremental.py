"""Incremental form of the daily aggregation for files that keep arriving.

The reference only runs batch jobs; this module applies the same
``daily_agg`` operator to a file stream.  Steps are simulation hours or
days, not timestamps, so the day bucket is turned into an event time
(day ``d`` -> ``d + 1`` days after the epoch: an event time of exactly 0
would sit on the initial watermark) and a watermark of
``late_days`` closes a day once later days have arrived: in ``append`` mode
each (account, day, type) row is emitted once, and the state of closed
days is dropped, so the state stays bounded by the open days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import count_where, day_bucket
from ..schemas import Layout


def daily_agg_stream(stream: DataFrame, lay: Layout, late_days: int = 1) -> DataFrame:
    """Streaming daily aggregation per (account, day, type) with a watermark."""
    src = stream.withColumn("day", day_bucket(lay.step, lay.steps_per_day)) \
                .withColumn("__day_ts", F.timestamp_seconds((F.col("day") + 1) * 86400)) \
                .withWatermark("__day_ts", f"{late_days} days")
    # the condition names the event time, so it stays above the watermark: a
    # closing record (no account, see ``close_days``) moves the watermark
    src = src.filter(F.when(F.col("__day_ts").isNotNull(), F.col(lay.account).isNotNull()))
    agg = (src.groupBy(F.col(lay.account).alias("account"), "__day_ts", "day",
                    F.col(lay.type).alias("type"))
           .agg(F.sum(lay.amount).alias("total_amount"),
                F.count(F.lit(1)).alias("tx_count"),
                F.avg(lay.amount).alias("avg_amount"),
                F.max(lay.amount).alias("max_amount"),
                count_where(F.col(lay.label) == 1).alias("fraud_count")))
    return agg.select(F.lit(lay.dataset).alias("dataset"), "account", "day", "type",
                      "total_amount", "tx_count", "avg_amount", "max_amount", "fraud_count")


def start_daily_stream(spark: SparkSession, source_dir: str, schema: StructType, lay: Layout,
                       sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                       late_days: int = 1, trigger_once: bool = False,
                       state_partitions: int | None = None):
    """Read new files of ``source_dir`` as they land and append closed days
    to ``sink_dir`` (exactly once through the checkpoint).

    ``state_partitions`` fixes the number of state-store partitions when the
    checkpoint is first created (default: the shuffle width); a restarted
    query keeps the number its checkpoint holds.  Late records of closed days
    are counted by ``late_rows``."""
    if state_partitions:
        spark = spark.newSession()  # the setting is this query's own
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    stream = spark.readStream.schema(schema).format(fmt).load(source_dir)
    writer = (daily_agg_stream(stream, lay, late_days).writeStream
              .format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def close_days(spark: SparkSession, source_dir: str, schema: StructType, lay: Layout, last_step: int,
               late_days: int = 1, fmt: str = "parquet") -> None:
    """Write a closing record: no account, and a step far enough after
    ``last_step`` that every day up to it is closed and emitted."""
    step = int(last_step) + (late_days + 2) * lay.steps_per_day
    row = [F.lit(step if f.name == lay.step else None).cast(f.dataType).alias(f.name) for f in schema.fields]
    spark.range(1).select(*row).write.mode("append").format(fmt).save(source_dir)


def late_rows(query) -> int:
    """Records that came after their day was closed, over the query's recent
    progress (they are not in the sink)."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
