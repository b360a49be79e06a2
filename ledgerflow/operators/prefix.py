"""Ordered prefix aggregates without a global window.

``Window.orderBy(x)`` with no partition key moves every row to one task.
Here the order key is cut into value ranges: approximate quantiles of the
column (an ordinary one-row aggregate inside the plan, no job while the plan
is built) bound them, a binary search gives each row its range, a window per
(group, range) computes the running aggregate, and the per-range totals get a
prefix of their own.  Ranges outnumber the shuffle partitions, so that hashing
them evens out, and their number follows the shuffle width, so a range's rows
do not grow with the data when the width does.  Everything runs in the JVM
and in the columns' own types.

Callers pass rows that are unique on (by, order) - they pre-aggregate
duplicates first - so a repeated key cannot unbalance a range.  NULL is a
group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES_PER_PARTITION = 4


def range_id(c: Column, bounds: Column) -> Column:
    """Number of ``bounds`` (a sorted array) below the value, by binary
    search; ``bounds`` has at most 2^20 entries."""
    jumps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(jumps, F.lit(0), lambda lo, jump: F.when(
        (lo + jump <= F.size(bounds)) & (F.get(bounds, lo + jump - 1) < c), lo + jump).otherwise(lo))


def same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality of column pairs (a hashable join condition)."""
    return reduce(lambda x, y: x & y, [a[p].eqNullSafe(b[q]) for p, q in pairs])


def ordered_prefix(df: DataFrame, order: str, value: str, by: list[str] | None = None,
                   how: str = "sum", n_ranges: int | None = None,
                   bounds_from: DataFrame | None = None) -> DataFrame:
    """Adds ``prefix_incl`` / ``prefix_excl``: the sum (or min, or max) of ``value``
    over rows of the same ``by`` group whose ``order`` is <= / < the row's
    (for a group's first row ``prefix_excl`` is 0 for a sum, else NULL).
    ``df`` must be unique on (by, order); ``order`` must be numeric and
    non-NULL.  ``bounds_from`` (a frame with an ``order`` column, e.g. the
    rows before they were de-duplicated) gives the range bounds without
    computing ``df`` an extra time."""
    by = list(by or [])
    n = n_ranges or RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / n for i in range(1, n)] or [0.5]
    source = bounds_from if bounds_from is not None else df
    bounds = source.agg(F.sort_array(F.array_distinct(F.coalesce(
        F.percentile_approx(order, probs, 4 * n), F.array()))).alias("__bounds"))  # one row
    rid = range_id(F.col(order), F.col("__bounds"))
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("__rid", rid).drop("__bounds")
    keys = [*by, "__rid"]
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    w = Window.partitionBy(*keys).orderBy(order)
    local = (ranged.withColumn("__incl", agg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("__excl", agg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    # per group one row per range; a window without keys holds one row per range
    totals = ranged.groupBy(*keys).agg(agg(value).alias("__total"))
    earlier = Window.partitionBy(*by).orderBy("__rid").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           agg("__total").over(earlier).alias("__before"))
    joined = local.join(before, same(local, before, [(k, f"__k{i}") for i, k in enumerate(keys)]))
    if how == "sum":
        zero = F.lit(0)
        incl = F.coalesce("__before", zero) + F.col("__incl")
        excl = F.coalesce("__before", zero) + F.coalesce("__excl", zero)
    else:
        pick = F.least if how == "min" else F.greatest  # NULLs do not count
        incl, excl = pick("__before", "__incl"), pick("__before", "__excl")
    return joined.select(*df.columns, incl.alias("prefix_incl"), excl.alias("prefix_excl"))


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    n_ranges: int | None = None, prefix: str = "q") -> DataFrame:
    """Exact continuous quantiles (linear interpolation between the order
    statistics at floor/ceil of p*(n-1)), one row per ``by`` group (NULL
    included), columns ``{prefix}{p*100}`` (``q25``, ``q99_9``).  NULL values
    do not count.  Distinct values are counted first (partial aggregation),
    so repeated values cost one row each."""
    by = list(by or [])
    v = df.select(*by, F.col(value).alias("__v")).filter(F.col("__v").isNotNull())
    counts = v.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    ranked = ordered_prefix(counts, "__v", "__c", by=by, how="sum", n_ranges=n_ranges, bounds_from=v)
    if by:
        sizes = counts.groupBy(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(by)]).agg(
            F.sum("__c").alias("__n"))
        ranked = ranked.join(sizes, same(ranked, sizes, [(k, f"__s{i}") for i, k in enumerate(by)]))
    else:
        # one row: a proven broadcast bound
        ranked = ranked.crossJoin(F.broadcast(counts.agg(F.sum("__c").alias("__n"))))
    aggs, names = [], []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("__n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        hit_lo = (F.col("prefix_excl") <= lo) & (lo < F.col("prefix_incl"))
        hit_hi = (F.col("prefix_excl") <= hi) & (hi < F.col("prefix_incl"))
        name = prefix + format(p * 100, "g").replace(".", "_")
        names.append(name)
        aggs += [F.max(F.when(hit_lo, F.col("__v"))).alias(f"{name}__lo"),
                 F.max(F.when(hit_hi, F.col("__v"))).alias(f"{name}__hi"),
                 F.max(pos - F.floor(pos)).alias(f"{name}__f")]
    g = ranked.groupBy(*by).agg(*aggs)
    outs = [(F.col(f"{nm}__lo") + F.col(f"{nm}__f") * (F.col(f"{nm}__hi") - F.col(f"{nm}__lo")))
            .alias(nm) for nm in names]
    return g.select(*by, *outs)


def skyline(df: DataFrame, minimise: tuple[str, str], by: list[str] | None = None,
            n_ranges: int | None = None) -> DataFrame:
    """Rows not dominated in the two ``minimise`` columns (another row at
    most as large in both and smaller in one), per ``by`` group.  A row that
    is NULL in a measure compares with nothing: it dominates no row and is
    kept.  Sort-based: a row survives when its second value is the least among
    rows with the same first value and below the least second value of every
    row with a smaller first value - no pairwise comparison."""
    a, b = minimise
    by = list(by or [])
    whole = F.col(a).isNotNull() & F.col(b).isNotNull()
    base = df.filter(whole)
    best = base.groupBy(*by, a).agg(F.min(b).alias("__m"))
    pref = ordered_prefix(best, a, "__m", by=by, how="min", n_ranges=n_ranges, bounds_from=base)
    keys = [*by, a]
    keep = pref.select(*[F.col(k).alias(f"__j{i}") for i, k in enumerate(keys)], "__m",
                       F.col("prefix_excl").alias("__pm"))
    j = base.join(keep, same(base, keep, [(k, f"__j{i}") for i, k in enumerate(keys)]))
    undominated = (F.col(b) == F.col("__m")) & (F.col("__pm").isNull() | (F.col("__pm") > F.col(b)))
    return j.filter(undominated).select(*[base[c] for c in df.columns]).unionByName(df.filter(~whole))
