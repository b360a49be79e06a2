"""Group-by operators: daily aggregation, dimensions, global statistics,
precision/recall and sample-series summaries.

All of them are single ``groupBy().agg()`` plans, so Spark runs a partial
(map-side) aggregation before the shuffle: a hot key is reduced to one row
per map task before it reaches the reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, count_where, day_bucket, guarded_ratio


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows where every named column is non-NULL (pushed to the scan)."""
    cond = None
    for c in cols:
        p = col(c).isNotNull()
        cond = p if cond is None else cond & p
    return df if cond is None else df.filter(cond)


def daily_agg(df: DataFrame, account: str, step: str, type_col: str, amount: str,
              label: str, steps_per_day: int = 24) -> DataFrame:
    """Sum, count, mean, max and labelled count per (account, day, type).

    Rows with a NULL step or account are dropped first.  ``steps_per_day``
    is 24 for hourly steps and 1 when a step already is a day.
    """
    src = require(df, step, account)
    return (src.groupBy(col(account).alias("account"),
                        day_bucket(step, steps_per_day).alias("day"),
                        col(type_col).alias("type"))
            .agg(F.sum(amount).alias("total_amount"),
                 F.count(F.lit(1)).alias("tx_count"),
                 F.avg(amount).alias("avg_amount"),
                 F.max(amount).alias("max_amount"),
                 count_where(col(label) == 1).alias("fraud_count")))


def step_agg(df: DataFrame, account: str, step: str, type_col: str, amount: str,
             digits: int = 2) -> DataFrame:
    """Sum (rounded to ``digits``) and count per (account, raw step, type)."""
    src = require(df, step, account)
    return (src.groupBy(col(account).alias("account"), col(step).alias("step"),
                        col(type_col).alias("type"))
            .agg(F.round(F.sum(amount), digits).alias("total_amount"),
                 F.count(F.lit(1)).alias("tx_count")))


def build_dimension(df: DataFrame, key: str, amount: str, label: str,
                    key_alias: str = "dim_account") -> DataFrame:
    """One row per non-NULL ``key``: count, sum, mean and labelled count."""
    return (df.filter(col(key).isNotNull())
            .groupBy(col(key).alias(key_alias))
            .agg(F.count(F.lit(1)).alias("total_received_tx"),
                 F.sum(amount).alias("total_received_amount"),
                 F.avg(amount).alias("avg_received_amount"),
                 count_where(col(label) == 1).alias("fraud_received_count")))


def global_stats(df: DataFrame, x: str, ddof: int = 1, by: list[str] | None = None,
                 mean_alias: str = "global_mean", std_alias: str = "global_std") -> DataFrame:
    """Mean and standard deviation of ``x`` (sample for ddof=1, population
    for ddof=0), over the whole frame or per ``by`` group.  Lazy: the result
    is a tiny frame to be joined back, never collected."""
    std = F.stddev_samp(x) if ddof == 1 else F.stddev_pop(x)
    aggs = [F.avg(x).alias(mean_alias), std.alias(std_alias)]
    if by:
        return df.groupBy(*by).agg(*aggs)
    return df.agg(*aggs)


def merged_stats(parts: DataFrame, ddof: int = 1, mean_alias: str = "global_mean",
                 std_alias: str = "global_std", rows: str = "hourly_tx_count") -> DataFrame:
    """Global mean and deviation out of per-group moments (``n`` values among
    ``rows`` rows, ``mean``, ``m2`` = sum of squared deviations): one row,
    without reading the facts again."""
    # a group has no more values than rows; naming both leaves the groups'
    # aggregate one and the same for this reader and for one of the row counts
    parts = parts.withColumn("n", F.least(rows, "n"))
    # first the mean (one row, so it may be broadcast), then the deviations from
    # it: no difference of large sums, however far the mean lies from zero.  Both
    # read every moment, so the groups' aggregate is one exchange for both
    total = parts.agg(F.sum("n").alias("__n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__mean"),
                      F.sum("m2").alias("__within"))
    apart = F.col("mean") - F.col("__mean")
    spread = (parts.crossJoin(F.broadcast(total))
              .agg(F.max("__n").alias("n"), F.max("__mean").alias("mean"), F.max("__within").alias("within"),
                   F.sum(F.col("m2") + F.col("n") * apart * apart).alias("spread")))
    # as stddev_samp / stddev_pop: NULL where there are too few values
    std = F.when(F.col("n") > ddof, F.sqrt(F.greatest("spread", "within") / (F.col("n") - ddof)))
    return spread.select(F.col("mean").alias(mean_alias), std.alias(std_alias))


def attach_stats(df: DataFrame, stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Put the statistics next to every row.

    Global statistics are one row (a proven bound), so they travel as a
    broadcast; per-group statistics are joined on the group keys and AQE
    picks the strategy from their runtime size.
    """
    if by:
        return df.join(stats, on=by, how="left")
    return df.crossJoin(F.broadcast(stats))


def precision_recall(df: DataFrame, pred: str, label: str,
                     by: list[str] | None = None) -> DataFrame:
    """Flagged, true positives, actual positives, precision and recall in one
    pass (one aggregation instead of three counts)."""
    aggs = [count_where(col(pred) == 1).alias("total_flagged"),
            count_where((col(pred) == 1) & (col(label) == 1)).alias("true_positives"),
            count_where(col(label) == 1).alias("total_actual")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return (g.withColumn("precision", guarded_ratio("true_positives", "total_flagged"))
             .withColumn("recall", guarded_ratio("true_positives", "total_actual")))


def series_summary(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Max and mean of each sample series per group; an empty series gives 0.0."""
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for v in values:
        aggs.append(F.coalesce(F.max(v).cast("double"), F.lit(0.0)).alias(f"peak_{v}"))
        aggs.append(F.coalesce(F.avg(v), F.lit(0.0)).alias(f"avg_{v}"))
    return df.groupBy(*by).agg(*aggs)
