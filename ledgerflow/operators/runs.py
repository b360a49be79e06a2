"""Analytics over run-result tables (one row per engine x workload x sample
fraction): success filter, full-size selection, first match per key,
speedups, scaling curves, metric pivots, log-linear fits, time/memory
frontier, comparison matrix and summary text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fixed, round_half_up
from .enrich import join_back
from .prefix import ordered_prefix, skyline

PIECE = 100_000  # equal points that one row stands for

# Workload names of the result table, in display order.
WORKLOADS = ("WL1_aggregation", "WL2_fraud", "WL3_join_window")


def successful(runs: DataFrame) -> DataFrame:
    """Exit code 0 and a positive wall time."""
    return runs.filter((F.col("exit_code") == 0) & (F.col("wall_time_sec") > 0))


def full_size(runs: DataFrame, threshold: float = 0.99, tolerance: float = 0.01) -> DataFrame:
    """Rows at sample fraction >= threshold; if there are none, rows within
    ``tolerance`` of the largest fraction.  The decision uses a one-row
    aggregate next to every row, no driver round trip."""
    stats = runs.agg(F.max("sample_fraction").alias("__max"),
                     F.count_if(F.col("sample_fraction") >= threshold).alias("__nfull"))
    j = runs.crossJoin(F.broadcast(stats))
    cond = F.when(F.col("__nfull") > 0, F.col("sample_fraction") >= threshold) \
            .otherwise(F.col("sample_fraction") >= F.col("__max") - tolerance)
    return j.filter(cond).drop("__max", "__nfull")


def match_fractions(runs: DataFrame, c: str = "sample_fraction", out: str = "fraction_key",
                    tolerance: float = 0.01) -> DataFrame:
    """Adds ``out``: fractions less than ``tolerance`` apart get the same key,
    the smallest of them (a chain of near-equal fractions is one key).

    Two running maxima over value ranges, no window over all values: the
    greatest smaller fraction is a fraction's neighbour, which tells where a
    key starts; the greatest start so far is the fraction's key."""
    distinct = runs.select(F.col(c).alias("__f")).filter(F.col(c).isNotNull()).distinct()
    beside = ordered_prefix(distinct.withColumn("__x", F.col("__f")), "__f", "__x", how="max")
    # a difference of exactly the tolerance, up to rounding, is not near
    starts = F.coalesce(F.col("__f") - F.col("prefix_excl") > tolerance - 1e-9, F.lit(True))
    started = beside.select("__f", F.when(starts, F.col("__f")).alias("__x"))
    keys = ordered_prefix(started, "__f", "__x", how="max", bounds_from=distinct).select("__f", F.col("prefix_incl").alias(out))
    return runs.join(keys, runs[c] == keys["__f"], "left").drop("__f")


def first_per_key(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the least by ``order`` (an explicit, deterministic
    "first"; a NULL sorts last).  ``min_by`` aggregates partially, so a key
    with many rows does not land whole in one task."""
    payload = F.struct(*[F.col(c) for c in runs.columns if c not in keys])
    least = F.struct(*[x for i, c in enumerate(order) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}"))])
    g = runs.groupBy(*keys).agg(F.min_by(payload, least).alias("__r"))
    return g.select(*keys, "__r.*")


def speedup(runs: DataFrame, by: list[str], baseline: str = "hadoop",
            candidate: str = "spark", value: str = "wall_time_sec",
            order: list[str] | None = None, require_both: bool = False) -> DataFrame:
    """baseline value / candidate value per ``by`` key (first match per
    engine by ``order``); NULL when a side is missing or the candidate's
    value is not positive.  ``require_both`` drops such keys."""
    order = order or [value]
    firsts = first_per_key(runs.filter(F.col("engine").isin(baseline, candidate)),
                           [*by, "engine"], order)
    g = firsts.groupBy(*by).agg(
        F.max(F.when(F.col("engine") == candidate, F.col(value))).alias(f"{candidate}_{value}"),
        F.max(F.when(F.col("engine") == baseline, F.col(value))).alias(f"{baseline}_{value}"))
    cand, base = F.col(f"{candidate}_{value}"), F.col(f"{baseline}_{value}")
    out = g.withColumn("speedup", F.when(cand > 0, base / cand))
    if require_both:
        out = out.filter(cand.isNotNull() & base.isNotNull() & (cand > 0) & (base > 0))
    return out


def scaling_curve(runs: DataFrame, x: str = "data_size_mb", y: str = "wall_time_sec") -> DataFrame:
    """Points per (workload, engine) ordered by ``x`` (then ``y``, NULL first)
    with their position.  Equal points are counted first; the positions are a
    prefix scan over ``x`` plus one over ``y`` among the points of an x, both
    over value ranges, so neither a group nor one x of any size is in one task.
    Equal points are counted out again in pieces of ``PIECE`` points."""
    by = ["workload", "engine"]
    pts = (successful(runs).filter(F.col(x).isNotNull()).select(*by, x, y)
           .withColumn("__y", F.coalesce(F.col(y).cast("double"), F.lit(float("-inf")))))
    counts = pts.groupBy(*by, x, y, "__y").agg(F.count(F.lit(1)).alias("__c"))
    of_x = counts.groupBy(*by, x).agg(F.sum("__c").alias("__c"))
    before_x = ordered_prefix(of_x, x, "__c", by=by, bounds_from=pts).select(*by, x, F.col("prefix_excl").alias("__bx"))
    before_y = ordered_prefix(counts, "__y", "__c", by=[*by, x], bounds_from=pts).select(
        *by, x, y, "__c", F.col("prefix_excl").alias("__by"))
    placed = join_back(before_y, before_x, [*by, x])
    last = F.floor((F.col("__c") - 1) / PIECE)
    pieces = placed.withColumn("__p", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition(*by, x, y, "__p")
    first = F.col("__p") * PIECE
    each = pieces.withColumn("__k", F.explode(F.sequence(first + 1, F.least(first + PIECE, F.col("__c")))))
    return each.select(*by, x, y, (F.col("__bx") + F.col("__by") + F.col("__k")).cast("int").alias("position"))


def metric_long(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """(engine, fraction_key, workload, metric, value): the largest value of
    each metric of the successful runs, for every workload there is, in one
    aggregate."""
    g = (match_fractions(successful(runs)).groupBy("engine", "fraction_key", "workload")
         .agg(*[F.max(m).alias(m) for m in metrics]))
    pairs = ", ".join(f"'{m}', {m}" for m in metrics)
    return g.selectExpr("engine", "fraction_key", "workload",
                        f"stack({len(metrics)}, {pairs}) as (metric, value)")


def pivot_metric(runs: DataFrame, metrics: str | list[str], workloads=WORKLOADS) -> DataFrame:
    """(engine, fraction) x the named workloads, one row per metric; missing
    -> NULL.  ``unlisted`` has the largest value of workloads that were not
    named, so nothing is lost unseen."""
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    long = metric_long(runs, metrics)
    cells = [F.max(F.when(F.col("workload") == w, F.col("value"))).alias(w) for w in workloads]
    rest = F.max(F.when(~F.coalesce(F.col("workload").isin(list(workloads)), F.lit(False)), F.col("value")))
    return (long.groupBy("engine", F.col("fraction_key").alias("sample_fraction"), "metric")
            .agg(*cells, rest.alias("unlisted"))
            .select("engine", "sample_fraction", *workloads, "unlisted", "metric"))


def fit_log(runs: DataFrame, x: str = "data_size_mb", y: str = "peak_memory_mb",
            by: list[str] | None = None, floor: float = 1e-6) -> DataFrame:
    """Least-squares fit y = slope * ln(max(x, floor)) + intercept per group,
    groups with at least two points."""
    by = by or ["engine"]
    lx = F.ln(F.greatest(F.col(x), F.lit(floor)))
    g = successful(runs).groupBy(*by).agg(
        F.regr_slope(F.col(y), lx).alias("slope"), F.regr_intercept(F.col(y), lx).alias("intercept"),
        F.regr_count(F.col(y), lx).alias("n_points"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    return g.filter(F.col("n_points") >= 2)


def fit_curve(fit: DataFrame, points: int = 100, floor: float = 1e-6,
              by: list[str] | None = None) -> DataFrame:
    """``points`` evenly spaced x values between each group's min and max x
    with the fitted y."""
    by = by or ["engine"]
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    pts = fit.select(*by, "slope", "intercept", "x_min", "x_max", i)
    xv = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    return pts.withColumn("x", xv).select(
        *by, "i", "x", (F.col("slope") * F.ln(F.greatest(F.col("x"), F.lit(floor))) + F.col("intercept")).alias("y"))


def frontier(runs: DataFrame, minimise=("wall_time_sec", "peak_memory_mb"),
             by: list[str] | None = None) -> DataFrame:
    """Non-dominated runs in (time, memory)."""
    return skyline(runs, tuple(minimise), by=by)


def time_long(runs: DataFrame, value: str = "wall_time_sec") -> DataFrame:
    """(engine, workload, value) at full size: the least value per pair."""
    full = full_size(successful(runs))
    return full.groupBy("engine", "workload").agg(F.min(value).alias(value))


def time_matrix(runs: DataFrame, workloads=WORKLOADS, value: str = "wall_time_sec") -> DataFrame:
    """engine x the named workloads at full size, missing -> 0; ``unlisted``
    has the least value of workloads that were not named (``time_long`` has
    them all)."""
    t = time_long(runs, value)
    cells = [F.coalesce(F.min(F.when(F.col("workload") == w, F.col(value))), F.lit(0.0)).alias(w) for w in workloads]
    rest = F.min(F.when(~F.coalesce(F.col("workload").isin(list(workloads)), F.lit(False)), F.col(value)))
    return t.groupBy("engine").agg(*cells, F.coalesce(rest, F.lit(0.0)).alias("unlisted"))


def summary(runs: DataFrame) -> DataFrame:
    """Engine, workload, fraction, time (1 dp), memory (0 dp), exit code;
    rows missing any of them are skipped."""
    need = ["engine", "workload", "sample_fraction", "wall_time_sec", "peak_memory_mb",
            "exit_code"]
    ok = runs.dropna(subset=need)
    return ok.select("engine", "workload", "sample_fraction",
                     fixed(round_half_up("wall_time_sec", 1), 1).alias("time_sec"),
                     fixed(round_half_up("peak_memory_mb", 0), 0).alias("memory_mb"),
                     "exit_code")
