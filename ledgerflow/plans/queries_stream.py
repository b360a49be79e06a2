"""Registered query for the streaming form of the daily aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..session import scratch_path
from ..streaming.incremental import close_days, start_daily_stream
from .oracle import r, with_
from .registry import FINE, MONEY, present, query


@query("daily_agg_streaming", with_("ta", f"""
select 'PAYSIM' as dataset, account, cast(trunc(step / 24) as bigint) as day, "type",
       {r('sum(amount)', MONEY)} as total_amount, count(*) as tx_count,
       {r('avg(amount)', FINE)} as avg_amount, max(amount) as max_amount,
       cast(count_if(is_fraud = 1) as bigint) as fraud_count
  from ta
 where step is not null and account is not null
 group by all"""))
def daily_agg_streaming(spark, d):
    """``ta`` lands as files, then a closing record; the stream emits every
    day once."""
    src = scratch_path(spark, "stream_src")
    ta = fx.ta(spark, d)
    ta.write.parquet(src)
    close_days(spark, src, ta.schema, fx.TA_LAYOUT, ta.agg(F.max("step")).first()[0] or 0)
    sink, ckpt = scratch_path(spark, "stream_sink"), scratch_path(spark, "stream_ckpt")
    q = start_daily_stream(spark, src, ta.schema, fx.TA_LAYOUT, sink, ckpt,
                           trigger_once=True)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return present(out, {"total_amount": MONEY, "avg_amount": FINE}).select(
        "dataset", "account", "day", "type", "total_amount", "tx_count", "avg_amount",
        "max_amount", "fraud_count").filter(F.col("day").isNotNull())
