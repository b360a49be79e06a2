"""Window operators: velocity count per (account, hour-of-day) and trailing
range windows per account.

Both are written so that no single key can pin a third of the data to one
task:

* the velocity count is a ``groupBy`` (partial aggregation before the
  shuffle) joined back to the rows, instead of a whole-partition window that
  would move every row of a hot account to one task;
* the trailing window is a range window over (account, time bucket)
  partitions.  Each bucket also receives a copy of the last ``size`` steps of
  the previous bucket (a halo), so a frame never needs a row from another
  partition; halo rows are dropped after the window.  As long as no account
  has more than ``HOT_ROWS`` rows in a bucket (``HOT_STEPS`` if steps are
  fractional), the rows themselves go through it, in one exchange.  Otherwise
  rows sharing (account, step) are aggregated first - peers of a range frame
  always see each other, so the frame result depends only on (account, step) -
  and the per-(account, step) results are joined back to the rows.  A
  fractional step can hold any number of distinct steps inside one window
  length; accounts that have more than ``HOT_STEPS`` of them in a time bucket
  are split by position instead (``split_rolling``), inside a window length too.

``method="window"`` runs the plain ``Window.partitionBy(account)`` form; it
gives the same result and is kept for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.columns import col, hour_of_day
from .enrich import join_back
from .prefix import ordered_prefix, same

HOT_ROWS = 1 << 17  # rows of an account in one time bucket of whole steps
HOT_STEPS = 4096  # distinct fractional steps of an account in one time bucket
BLOCK_STEPS = 256  # distinct steps in a block of a split account
SUPER_BLOCKS = 64  # blocks whose totals are added up once more


def velocity_count(df: DataFrame, account: str, step: str, keys: list[str] | None = None,
                   steps_per_day: int = 24, hour_col: str = "hour_bucket",
                   out: str = "hourly_tx_count") -> DataFrame:
    """Rows per (keys..., account, hour of day), attached to every row."""
    with_hour = df.withColumn(hour_col, hour_of_day(step, steps_per_day))
    group = [*(keys or []), account, hour_col]
    counts = with_hour.groupBy(*group).agg(F.count(F.lit(1)).alias(out))
    return join_back(with_hour, counts, group)


def velocity_moments(df: DataFrame, account: str, step: str, x: str, keys: list[str] | None = None,
                     steps_per_day: int = 24, hour_col: str = "hour_bucket",
                     out: str = "hourly_tx_count") -> DataFrame:
    """Per (keys..., account, hour of day): the row count (``out``) and the
    moments of ``x`` (``n``, ``mean``, ``m2``), in one aggregate, so that the
    velocity count and global statistics share one pass and one exchange."""
    group = [*(keys or []), account, hour_col]
    return (df.withColumn(hour_col, hour_of_day(step, steps_per_day)).groupBy(*group)
            .agg(F.count(F.lit(1)).alias(out), F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
                 F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2")))


def attach_velocity(df: DataFrame, moments: DataFrame, account: str, step: str,
                    keys: list[str] | None = None, steps_per_day: int = 24,
                    hour_col: str = "hour_bucket", out: str = "hourly_tx_count") -> DataFrame:
    """Every row with its group's count out of ``velocity_moments``."""
    # the count names the moments (no group has fewer rows than values), so
    # that column pruning leaves one aggregate for both of its readers
    whole = F.when((F.least("n", out) < 0) & (F.col("mean") > F.col("m2")), F.lit(0)).otherwise(F.col(out))
    counts = moments.select(*(keys or []), account, hour_col, whole.cast("long").alias(out))
    return join_back(df.withColumn(hour_col, hour_of_day(step, steps_per_day)), counts,
                     [*(keys or []), account, hour_col])


def velocity_count_window(df: DataFrame, account: str, step: str,
                          keys: list[str] | None = None, steps_per_day: int = 24,
                          hour_col: str = "hour_bucket",
                          out: str = "hourly_tx_count") -> DataFrame:
    """Same as ``velocity_count`` as an un-ordered window (reference form)."""
    with_hour = df.withColumn(hour_col, hour_of_day(step, steps_per_day))
    w = Window.partitionBy(*(keys or []), account, hour_col)
    return with_hour.withColumn(out, F.count(F.lit(1)).over(w))


def _order_expr(order: str, order_type: str | None):
    c = col(order)
    if order_type == "long":
        return c.cast("long")
    if order_type == "double":
        return c.cast("double")
    return c


def rolling(df: DataFrame, partition: list[str], order: str, value: str,
            size: int = 24, order_type: str | None = None,
            measures: tuple[str, ...] = ("sum", "count", "max"),
            prefix: str = "rolling_24h", method: str = "skew_safe",
            bucket_width: int | None = None, emit_from: float | None = None) -> DataFrame:
    """Trailing window over ``[order - size, order]`` (both ends inclusive,
    ties included both ways) per ``partition``: sum and max of ``value`` and
    the row count, as ``{prefix}_sum``, ``{prefix}_count``, ``{prefix}_max``.

    ``order_type``: None keeps the order column as is, ``"long"`` truncates it
    (a fractional step orders by its integer part), ``"double"`` uses it raw.
    ``emit_from``: only rows with order >= emit_from are returned, and only
    rows with order >= emit_from - size are read (a filter on the order key
    is not pushed through a window by the optimizer, so it is applied here).
    """
    if emit_from is not None:
        o = _order_expr(order, order_type)
        df = df.filter(o >= F.lit(emit_from - size))
        out = rolling(df, partition, order, value, size, order_type, measures, prefix,
                      method, bucket_width)
        return out.filter(_order_expr(order, order_type) >= F.lit(emit_from))
    if method == "window":
        return _rolling_window(df, partition, order, value, size, order_type, measures, prefix)
    ord_col = "__ord"
    base = df.withColumn(ord_col, _order_expr(order, order_type))
    integral = isinstance(base.schema[ord_col].dataType, IntegralType)
    keys = [*partition, ord_col]

    # one narrow job (row counts, added up before the shuffle) tells whether any
    # account is too dense for one bucket; most tables have none, and their rows
    # go through the window as they are: one exchange, nothing to join back
    width = max(int(bucket_width or 32 * size), size)
    many = F.count(F.lit(1)).alias("__n")
    if (base.groupBy(*partition, F.floor(F.col(ord_col) / F.lit(width)).alias("__bucket")).agg(many)
            .filter(F.col("__n") > (HOT_ROWS if integral else HOT_STEPS)).isEmpty()):
        aggs = {"sum": F.sum(value), "count": F.count(F.lit(1)), "max": F.max(value)}
        return _halo_window(base, partition, ord_col, size, width,
                            {f"{prefix}_{m}": aggs[m] for m in measures}).drop(ord_col)

    if bucket_width is None and not integral:
        # whole steps: at most ``width`` distinct steps per (account, bucket)
        # after the peer collapse, so wide buckets are cheap; a fractional
        # order key can have a row per value, so keep buckets narrower (more
        # splitting, a larger halo share)
        width = 4 * size

    # 1. peers collapse: one row per (partition, step), partial agg first.
    per_step = base.groupBy(*keys).agg(
        F.sum(value).alias("__s"), F.count(F.lit(1)).alias("__c"), F.max(value).alias("__m"))

    # 2. frames over time buckets; accounts too dense for one bucket by position
    bucket = F.floor(F.col(ord_col) / F.lit(width)).alias("__bucket")
    # a job as above, for the narrower buckets
    if (integral
            or base.groupBy(*partition, bucket).agg(many).filter(F.col("__n") > HOT_STEPS).isEmpty()):
        rolled = _halo_rolling(per_step, partition, ord_col, size, width)
    else:
        dense = (per_step.groupBy(*partition, bucket).agg(many).filter(F.col("__n") > HOT_STEPS)
                 .select(*partition).distinct().withColumn("__dense", F.lit(True)))
        tagged = join_back(per_step, dense, partition)
        rolled = (_halo_rolling(tagged.filter(F.col("__dense").isNull()), partition, ord_col, size, width)
                  .unionByName(split_rolling(tagged.filter("__dense").drop("__dense"), partition, ord_col, size)))
    rolled = rolled.select(*keys, *[F.col(_PARTS[m]).alias(f"{prefix}_{m}") for m in measures])

    # 3. back to the rows.
    return join_back(base, rolled, keys).drop(ord_col)


_PARTS = {"sum": "__s", "count": "__c", "max": "__m"}


def _halo_rolling(per_step: DataFrame, partition: list[str], ord_col: str, size: int, width: int) -> DataFrame:
    """Trailing sums, counts and maxima (``__s``, ``__c``, ``__m``) of rows
    unique on (partition, order)."""
    return _halo_window(per_step.select(*partition, ord_col, "__s", "__c", "__m"), partition, ord_col, size, width,
                        {c: f(c) for f, c in _MEASURES})


def _halo_window(df: DataFrame, partition: list[str], ord_col: str, size: int, width: int,
                 aggs: dict[str, F.Column]) -> DataFrame:
    """``df`` with the aggregates of each row's trailing frame, in place of
    columns of the same names: a range window per time bucket, which also
    receives the last ``size`` steps of the bucket before (the halo)."""
    b = F.floor(F.col(ord_col) / F.lit(width)).cast("long")
    edge = (b + 1) * F.lit(width) - F.lit(size)
    halo = F.col(ord_col) >= edge
    with_bucket = df.select(
        "*", b.alias("__home"),
        F.explode_outer(F.sequence(b, F.when(halo, b + 1).otherwise(b))).alias("__bucket"))
    w = (Window.partitionBy(*partition, "__bucket").orderBy(ord_col)
         .rangeBetween(-size, 0))
    framed = with_bucket.select(*[c for c in df.columns if c not in aggs], "__home", "__bucket",
                                *[a.over(w).alias(c) for c, a in aggs.items()])
    return framed.filter(F.col("__bucket").eqNullSafe(F.col("__home"))).drop("__home", "__bucket")


def split_rolling(per_step: DataFrame, partition: list[str], ord_col: str, size: int,
                  block: int = BLOCK_STEPS, group: int = SUPER_BLOCKS) -> DataFrame:
    """The same frames with one account's steps split by position, so that a
    window length may hold any number of them.

    A prefix scan over value ranges counts, for every step x, the account's
    steps before x (its position) and before x - size (the first position of
    its frame).  Positions are cut into blocks of ``block`` steps.  A frame is
    then the part of x's own block (a range window in the block), the end of
    the frame's first block (a running aggregate from the block's end, looked
    up at the first position), and whole blocks between, whose totals are
    looked up once for every pair of blocks that some frame begins and ends in:
    block by block at the ends, by ``group`` blocks in the middle.  Frames move
    forward with x, so an account has at most two such pairs a block.  Nothing
    is subtracted: sums keep the precision of a sum."""
    unknown = per_step.filter(F.col(ord_col).isNull())  # a frame of its own
    known = per_step.filter(F.col(ord_col).isNotNull()).withColumn("__low", F.col(ord_col) - F.lit(size))
    points = (known.select(*partition, F.col(ord_col).alias("__v"), F.lit(1).alias("__k"))
              .unionByName(known.select(*partition, F.col("__low").alias("__v"), F.lit(0).alias("__k")))
              .groupBy(*partition, "__v").agg(F.sum("__k").alias("__k")))
    at = ordered_prefix(points, "__v", "__k", by=partition,
                        bounds_from=known.select(F.col(ord_col).alias("__v"))).select(
        *partition, "__v", F.col("prefix_excl").alias("__at"))
    placed = join_back(known, at.withColumnsRenamed({"__v": ord_col, "__at": "__pos"}), [*partition, ord_col])
    placed = join_back(placed, at.withColumnsRenamed({"__v": "__low", "__at": "__first"}), [*partition, "__low"])
    placed = (placed.withColumn("__own", F.floor(F.col("__pos") / block))
              .withColumn("__begin", F.floor(F.col("__first") / block)))

    in_block = Window.partitionBy(*partition, "__own")
    frame = in_block.orderBy(ord_col).rangeBetween(-size, 0)
    ending = in_block.orderBy(F.desc("__pos")).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select(
        *partition, ord_col, "__pos", "__first", "__own", "__begin",
        *[f(c).over(frame).alias(f"{c}_own") for f, c in _MEASURES],
        *[f(c).over(ending).alias(f"{c}_end") for f, c in _MEASURES])
    ends = local.select(*partition, F.col("__pos").alias("__first"), *[f"{c}_end" for _, c in _MEASURES])
    rows = join_back(local.drop(*[f"{c}_end" for _, c in _MEASURES]), ends, [*partition, "__first"])

    def totals(df: DataFrame, level: int, number) -> DataFrame:
        return (df.groupBy(*partition, number.alias("__id")).agg(*[f(c).alias(c) for f, c in _MEASURES])
                .withColumn("__level", F.lit(level)))

    blocks = totals(placed, 0, F.col("__own"))
    nodes = blocks.unionByName(totals(blocks, 1, F.floor(F.col("__id") / group)))
    pairs = placed.select(*partition, "__begin", "__own").filter("__own - __begin > 1").distinct()
    # whole blocks lo .. hi between, of which super blocks a .. b lie inside
    lo, hi = F.col("__begin") + 1, F.col("__own") - 1
    a, b = F.ceil(lo / group), F.floor((hi + 1) / group) - 1

    def named(level: int, x, y):
        ids = F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(ids, lambda i: F.struct(F.lit(level).alias("__level"), i.alias("__id")))

    parts = F.when(a <= b, F.concat(named(0, lo, a * group - 1), named(1, a, b), named(0, (b + 1) * group, hi))
                   ).otherwise(named(0, lo, hi))
    wanted = pairs.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(partition)], "__begin", "__own",
                          F.explode(parts).alias("__n")).select("*", "__n.__level", "__n.__id").drop("__n")
    wanted = wanted.withColumnsRenamed({"__level": "__wl", "__id": "__wi"})
    on = same(wanted, nodes, [(f"__p{i}", c) for i, c in enumerate(partition)] + [("__wl", "__level"), ("__wi", "__id")])
    between = (wanted.join(nodes, on).groupBy(*[f"__p{i}" for i in range(len(partition))], "__begin", "__own")
               .agg(*[f(c).alias(f"{c}_mid") for f, c in _MEASURES])
               .withColumnsRenamed({f"__p{i}": c for i, c in enumerate(partition)}))
    rows = join_back(rows, between, [*partition, "__begin", "__own"])

    later = F.col("__begin") < F.col("__own")

    def whole(c: str, how) -> F.Column:
        parts = [F.col(f"{c}_own"), F.when(later, F.col(f"{c}_end")), F.col(f"{c}_mid")]
        if how is F.max:
            return F.greatest(*parts)
        some = F.coalesce(*parts).isNotNull()
        return F.when(some, sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))

    out = rows.select(*partition, ord_col, *[whole(c, f).alias(c) for f, c in _MEASURES])
    return out.unionByName(unknown.select(*partition, ord_col, *[c for _, c in _MEASURES]))


_MEASURES = [(F.sum, "__s"), (F.sum, "__c"), (F.max, "__m")]


def _rolling_window(df, partition, order, value, size, order_type, measures, prefix):
    w = Window.partitionBy(*partition).orderBy("__ord").rangeBetween(-size, 0)
    out = df.withColumn("__ord", _order_expr(order, order_type))  # one sort for all measures
    if "sum" in measures:
        out = out.withColumn(f"{prefix}_sum", F.sum(value).over(w))
    if "count" in measures:
        out = out.withColumn(f"{prefix}_count", F.count(F.lit(1)).over(w))
    if "max" in measures:
        out = out.withColumn(f"{prefix}_max", F.max(value).over(w))
    return out.drop("__ord")
