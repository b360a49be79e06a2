"""Reproducible sampling: a hash of the row key decides membership, so the
same rows are drawn whatever the partitioning, and rungs of a ladder are
nested by construction.  ``bernoulli`` is Spark's own random sample (its
rows depend on the layout)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE = float(2 ** 32)
# Default seed and ladder rungs.
DEFAULT_SEED = 42
DEFAULT_FRACTIONS = (0.1, 0.25, 0.5, 1.0)


def key_hash(keys: list[str], seed: int = DEFAULT_SEED) -> F.Column:
    """32-bit unsigned hash of ``seed:key`` (first 8 hex digits of md5)."""
    # a NULL holds its place, so ("a", NULL) and (NULL, "a") differ
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, keys: list[str], fraction: float,
                seed: int = DEFAULT_SEED) -> DataFrame:
    """Rows whose key hash falls below ``fraction`` of the hash range
    (fraction >= 1 keeps every row)."""
    if fraction >= 1:
        return df
    return df.filter(key_hash(keys, seed) < F.lit(fraction * SCALE))


def with_rung(df: DataFrame, keys: list[str], fractions=DEFAULT_FRACTIONS,
              seed: int = DEFAULT_SEED, col: str = "rung") -> DataFrame:
    """Smallest ladder fraction whose sample holds the row (NULL if none):
    rung f's sample is every row with ``rung <= f``."""
    h = key_hash(keys, seed)
    expr = None
    for f in sorted(fractions):
        cond = h < F.lit(f * SCALE) if f < 1 else F.lit(True)
        expr = F.when(cond, F.lit(float(f))) if expr is None else expr.when(cond, F.lit(float(f)))
    return df.withColumn(col, expr)


def ladder_counts(df: DataFrame, keys: list[str], fractions=DEFAULT_FRACTIONS,
                  seed: int = DEFAULT_SEED) -> DataFrame:
    """Sampled and total rows per rung in one pass."""
    h = key_hash(keys, seed)
    fr = sorted(fractions)
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for i, f in enumerate(fr):
        cond = h < F.lit(f * SCALE) if f < 1 else F.lit(True)
        aggs.append(F.count_if(cond).alias(f"n{i}"))
    g = df.agg(*aggs)
    stack = ", ".join(f"cast({f} as double), n{i}" for i, f in enumerate(fr))
    return g.selectExpr(f"stack({len(fr)}, {stack}) as (fraction, sampled_rows)", "total_rows") \
        .withColumn("sampled_ratio", F.col("sampled_rows") / F.col("total_rows"))


def _description(spark: SparkSession, path: str):
    """(seed, fractions) that a ladder was written with; None without one."""
    try:
        r = spark.read.schema("seed long, fractions array<double>").json(f"{path.rstrip('/')}/_ladder").first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return (r.seed, tuple(r.fractions)) if r else None


def write_ladder(df: DataFrame, keys: list[str], path: str, fractions=DEFAULT_FRACTIONS,
                 seed: int = DEFAULT_SEED) -> None:
    """Write every row once, partitioned by its rung, and the seed and rungs
    beside it.  A ladder that exists with the same seed and rungs is left as
    it is; with others it is an error."""
    spark = df.sparkSession
    want = (seed, tuple(sorted(float(f) for f in fractions)))
    have = _description(spark, path)
    if have is not None:
        if have != want:
            raise ValueError(f"{path} holds a ladder of seed and rungs {have}, not {want}")
        return
    with_rung(df, keys, fractions, seed).filter(F.col("rung").isNotNull()) \
        .write.mode("overwrite").partitionBy("rung").parquet(path)
    # last, so that a ladder with a description is whole
    spark.createDataFrame([(seed, list(want[1]))], "seed long, fractions array<double>") \
        .coalesce(1).write.json(f"{path.rstrip('/')}/_ladder")


def read_rung(spark: SparkSession, path: str, fraction: float) -> DataFrame:
    """The sample at ``fraction``, which must be a rung of the ladder:
    partitions with rung <= fraction (pruned)."""
    have = _description(spark, path)
    if have is None or float(fraction) not in have[1]:
        raise ValueError(f"{fraction} is no rung of {path}: {have and have[1]}")
    return spark.read.parquet(path).filter(F.col("rung") <= F.lit(float(fraction))).drop("rung")


def bernoulli(df: DataFrame, fraction: float, seed: int = DEFAULT_SEED) -> DataFrame:
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
