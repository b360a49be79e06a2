"""Composed workloads: daily aggregation (W1), fraud proxy (W2) and
enrichment + trailing window (W3), each over any number of sources.

Sources are (DataFrame, Layout) pairs; a Layout names the column roles, so
the same plan serves PaySim- and BankSim-shaped tables.  Every function
returns a lazy DataFrame; W3 counts rows (``rolling``, ``deals_by_account``) and writes its dimensions
while its plan is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.columns import col, fixed, flag_or, log_amount, zscore
from ..operators.aggregate import (attach_stats, build_dimension, daily_agg, merged_stats,
                                   precision_recall, require)
from ..operators.enrich import enrich, enrich_pair, lookup_by_account, network_dimension
from ..operators.windows import HOT_STEPS, attach_velocity, rolling, velocity_moments
from ..schemas import (AMOUNT_Z_THRESHOLD, VELOCITY_THRESHOLD, WINDOW_SIZE_STEPS,
                       W1_COLUMNS, Layout)
from ..session import scratch_path
from ..sources.sinks import stored

FEW_EDGES = 100_000  # edges that are joined to the facts as they come

def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; no input is an error."""
    if not frames:
        raise RuntimeError("no input data")
    return reduce(lambda a, b: a.unionByName(b), frames)


# ---------------------------------------------------------------- W1

def daily_for(df: DataFrame, lay: Layout) -> DataFrame:
    agg = daily_agg(df, lay.account, lay.step, lay.type, lay.amount, lay.label,
                    lay.steps_per_day)
    return agg.select(F.lit(lay.dataset).alias("dataset"), *W1_COLUMNS[1:])


def workload1(sources: list[tuple[DataFrame, Layout]]) -> DataFrame:
    return union_all([daily_for(df, lay) for df, lay in sources])


# ---------------------------------------------------------------- W2

def fraud_source(df: DataFrame, lay: Layout, clamp_nonpositive: bool = False) -> DataFrame:
    src = require(df, lay.step, lay.amount)
    return src.withColumn("log_amount", log_amount(lay.amount, clamp_nonpositive))


def fraud_moments(df: DataFrame, lay: Layout, clamp_nonpositive: bool = False,
                  keys: list[str] | None = None) -> DataFrame:
    return velocity_moments(fraud_source(df, lay, clamp_nonpositive), lay.account, lay.step, "log_amount",
                            keys=keys)


def fraud_flags(df: DataFrame, lay: Layout, velocity_threshold: int = VELOCITY_THRESHOLD,
                z_threshold: float = AMOUNT_Z_THRESHOLD, ddof: int = 1,
                clamp_nonpositive: bool = False, stats: DataFrame | None = None,
                keys: list[str] | None = None) -> DataFrame:
    """Velocity flag (rows per account and hour of day >= threshold) OR
    amount flag (z-score of log amount > threshold) -> ``fraud_proxy`` 0/1.

    ``stats`` overrides the per-frame statistics (pooled scope): a frame with
    ``global_mean``/``global_std`` (of several rows, the largest count).

    The facts are read twice: for the rows, and for one aggregate per account
    and hour that gives both the counts and the statistics.
    """
    moments = fraud_moments(df, lay, clamp_nonpositive, keys)
    stats = merged_stats(moments, ddof) if stats is None else stats.agg(
        F.max("global_mean").alias("global_mean"), F.max("global_std").alias("global_std"))
    # the logarithm is taken after the join: it need not be shuffled
    src = attach_velocity(require(df, lay.step, lay.amount), moments, lay.account, lay.step, keys=keys)
    src = attach_stats(src.withColumn("log_amount", log_amount(lay.amount, clamp_nonpositive)), stats)
    # one projection for the dependent columns (the z expression is shared)
    vel = F.col("hourly_tx_count") >= velocity_threshold
    z = zscore("log_amount", "global_mean", "global_std")
    amt = z > F.lit(float(z_threshold))
    return src.withColumns({"velocity_flag": vel, "amount_z_score": z,
                            "amount_flag": amt, "fraud_proxy": flag_or(vel, amt)})


def fraud_output(flagged: DataFrame, lay: Layout) -> DataFrame:
    return flagged.select(
        F.lit(lay.dataset).alias("dataset"), col(lay.account).alias("account"),
        col(lay.step).cast("long").alias("step"), col(lay.type).alias("type"),
        col(lay.amount).alias("amount"), "hourly_tx_count", "amount_z_score",
        "velocity_flag", "amount_flag", "fraud_proxy", col(lay.label).alias("isFraud"))


def workload2(sources: list[tuple[DataFrame, Layout]], **kw) -> DataFrame:
    return union_all([fraud_output(fraud_flags(df, lay, **kw), lay) for df, lay in sources])


def observed_scores(sources: list[tuple[DataFrame, Layout]], **kw):
    """(frame, scores): the fraud proxy of every source, and a function that
    gives each dataset's precision and recall after one action on the frame
    (observed on the rows as they pass)."""
    frames, seen = [], []
    for i, (df, lay) in enumerate(sources):
        out = fraud_output(fraud_flags(df, lay, **kw), lay)
        obs = Observation(f"scores{i}")
        hit = (F.col("fraud_proxy") == 1) & (F.col("isFraud") == 1)
        frames.append(out.observe(obs, F.count_if(F.col("fraud_proxy") == 1).alias("total_flagged"),
                                  F.count_if(hit).alias("true_positives"),
                                  F.count_if(F.col("isFraud") == 1).alias("total_actual")))
        seen.append((lay.dataset, obs))

    def scores() -> list[dict]:
        out = []
        for dataset, obs in seen:
            r = {k: int(v) for k, v in obs.get.items()}
            out.append({"dataset": dataset, **r,
                        "precision": r["true_positives"] / r["total_flagged"] if r["total_flagged"] else 0.0,
                        "recall": r["true_positives"] / r["total_actual"] if r["total_actual"] else 0.0})
        return out
    return union_all(frames), scores


def workload2_scores(sources: list[tuple[DataFrame, Layout]],
                     z_thresholds: tuple[float, ...] = (AMOUNT_Z_THRESHOLD,), **kw) -> DataFrame:
    """Precision/recall of the proxy per dataset and amount threshold.  The
    flags are computed once per dataset; every threshold is scored in the
    same aggregation pass."""
    parts = []
    for df, lay in sources:
        f = fraud_flags(df, lay, **kw)
        ts = F.explode(F.array(*[F.lit(float(t)) for t in z_thresholds])).alias("z_threshold")
        per_t = f.select(ts, "velocity_flag", "amount_z_score", col(lay.label).alias("__label"))
        stacked = per_t.select("z_threshold", "__label", flag_or(
            "velocity_flag", F.col("amount_z_score") > F.col("z_threshold")).alias("__pred"))
        pr = precision_recall(stacked, "__pred", "__label", by=["z_threshold"])
        parts.append(pr.select(F.lit(lay.dataset).alias("dataset"), *pr.columns))
    return union_all(parts)


def pooled_log_stats(sources: list[tuple[DataFrame, Layout]], ddof: int = 0,
                     clamp_nonpositive: bool = True) -> DataFrame:
    """Statistics of the log amount over all sources together (one row), out
    of the sources' moments per account and hour."""
    return merged_stats(union_all([
        fraud_moments(df, lay, clamp_nonpositive).select("hourly_tx_count", "n", "mean", "m2")
        for df, lay in sources]), ddof)


def workload2_pooled(sources: list[tuple[DataFrame, Layout]],
                     z_threshold: float = AMOUNT_Z_THRESHOLD,
                     velocity_threshold: int = VELOCITY_THRESHOLD) -> DataFrame:
    """Fraud proxy with pooled population statistics of the clamped log
    amount, exported with fixed precision (amount %.2f, z %.4f)."""
    stats = pooled_log_stats(sources)
    parts = []
    for df, lay in sources:
        f = fraud_flags(df, lay, velocity_threshold=velocity_threshold,
                        z_threshold=z_threshold, clamp_nonpositive=True, stats=stats)
        parts.append(f.select(
            F.lit(lay.dataset).alias("dataset"), col(lay.account).alias("account"),
            col(lay.step).alias("step"), col(lay.type).alias("type"),
            fixed(lay.amount, 2).alias("amount"), "hourly_tx_count",
            fixed("amount_z_score", 4).alias("amount_z_score"), "fraud_proxy",
            col(lay.label).alias("isFraud")))
    return union_all(parts)


# ---------------------------------------------------------------- W3

def enriched_rolling(facts: DataFrame, dim: DataFrame, lay: Layout,
                     order_type: str | None = None, size: int = WINDOW_SIZE_STEPS,
                     method: str = "skew_safe") -> DataFrame:
    src = require(facts, lay.step, lay.amount)
    # the dimension is written first, so that its size is known when the join is
    # planned: a small one is broadcast without the facts being shuffled for it
    dim = stored(dim, scratch_path(dim.sparkSession, "dimension"))
    rolled = rolling(src, [lay.account], lay.step, lay.amount, size=size,
                     order_type=order_type, method=method)
    return enrich(rolled, dim, lay.counterparty).select(
        F.lit(lay.dataset).alias("dataset"), col(lay.account).alias("account"),
        col(lay.step).cast("long").alias("step"), col(lay.type).alias("type"),
        col(lay.amount).alias("amount"), "rolling_24h_sum", "rolling_24h_count",
        "rolling_24h_max", "total_received_tx", "total_received_amount",
        "fraud_received_count", col(lay.label).alias("isFraud"))


def counterparty_dimension(facts: DataFrame, lay: Layout) -> DataFrame:
    src = require(facts, lay.step, lay.amount)
    return build_dimension(src, lay.counterparty, lay.amount, lay.label)


def workload3(hourly: tuple[DataFrame, Layout] | None = None,
              daily: tuple[DataFrame, Layout] | None = None,
              edges: DataFrame | None = None, network_key: str = "Source",
              method: str = "skew_safe") -> DataFrame:
    """Hourly source: dimension of received transactions from the same
    facts.  Daily source: dimension from the network edges keyed on
    ``network_key``.  Trailing 24-step window per account on both."""
    parts = []
    if hourly is not None:
        df, lay = hourly
        parts.append(enriched_rolling(df, counterparty_dimension(df, lay), lay,
                                      method=method))
    if daily is not None and edges is not None:
        df, lay = daily
        dim = network_dimension(edges, key=network_key)
        parts.append(enriched_rolling(df, dim, lay, order_type="long", method=method))
    return union_all(parts)


def deals_by_account(src: DataFrame, edges: DataFrame, lay: Layout) -> bool:
    """Whether there are many edges and no account is too dense for one task:
    one narrow job over the keys alone, counted before they are shuffled."""
    def kinds(df, *keys):
        return [f.dataType for f in df.select(*map(col, keys)).schema]

    if kinds(src, lay.account, lay.counterparty) != kinds(edges, "Source", "Target"):
        return False
    rows = src.select(col(lay.account).alias("__a"), F.lit(0).alias("__e")).unionAll(
        edges.select(F.col("Source").alias("__a"), F.lit(1).alias("__e")))
    most, many = (rows.groupBy("__a").agg(F.count(F.lit(1)).alias("__n"), F.sum("__e").alias("__e"))
                  .agg(F.max("__n"), F.sum("__e")).first())
    return (many or 0) > FEW_EDGES and most <= HOT_STEPS


def workload3_pair(facts: DataFrame, lay: Layout, edges: DataFrame,
                   edge_order: list[str], size: int = WINDOW_SIZE_STEPS,
                   method: str = "skew_safe") -> DataFrame:
    """Pair lookup (account = Source, counterparty = Target, latest edge
    wins, 'NONE'/0.0 on a miss) then a trailing sum/count over the raw
    (double) step; amounts exported with two decimals.

    Facts and more than ``FEW_EDGES`` edges are dealt together by account, in
    one exchange for both steps, as long as no account has more than
    ``HOT_STEPS`` of them.  Fewer edges are joined as they come (broadcast, as
    a rule), and with a denser account facts are dealt by time bucket, then by
    pair."""
    src = require(facts, lay.step, lay.amount)
    window = dict(size=size, order_type="double", measures=("sum", "count"))
    if method == "skew_safe" and deals_by_account(src, edges, lay):
        # rows travel as structs, which nothing prunes: only the columns of the result
        needed = [lay.account, lay.counterparty, lay.step, lay.type, lay.amount, lay.label]
        found = lookup_by_account(src.select(*needed), edges, lay.account, lay.counterparty, order=edge_order)
        out = rolling(found, [lay.account], lay.step, lay.amount, method="window", **window)
    else:
        rolled = rolling(src, [lay.account], lay.step, lay.amount, method=method, **window)
        out = enrich_pair(rolled, edges, lay.account, lay.counterparty, order=edge_order)
    return out.select(
        col(lay.account).alias("account"), F.lit(lay.dataset).alias("dataset"),
        col(lay.step).cast("double").alias("step"), col(lay.type).alias("type"),
        fixed(lay.amount, 2).alias("amount"),
        fixed("rolling_24h_sum", 2).alias("rolling_24h_sum"), "rolling_24h_count",
        col(lay.counterparty).alias("counterparty"), "dim_type", "dim_weight",
        col(lay.label).alias("isFraud"))
