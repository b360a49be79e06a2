"""Sinks: delimited text with header, fixed-precision text export, run-result
tables, and row counts that do not execute the plan twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import fixed
from ..schemas import BENCH_RUNS


def write_csv(df: DataFrame, path: str, quote: str = '"', quote_all: bool = False,
              files: int | None = None, mode: str = "overwrite") -> None:
    """Header + delimited text.  ``files`` coalesces the output (``1`` makes
    the last stage single-task: only on request)."""
    out = df.coalesce(files) if files else df
    (out.write.mode(mode).option("header", True).option("quote", quote)
        .option("quoteAll", quote_all).csv(path))


def write_counted(df: DataFrame, path: str, fmt: str = "parquet",
                  mode: str = "overwrite", **options) -> int:
    """Write and return the row count from the same execution (an
    ``Observation`` on the write instead of a second ``count()``)."""
    obs = Observation("rows")
    (df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode(mode).format(fmt)
       .options(**options).save(path))
    return int(obs.get["n"])


def stored(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet and read again: readers of the result share
    one execution of what made it, and read only the columns they need."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def format_lines(df: DataFrame, spec: list[tuple[str, int | None]], sep: str = ",") -> DataFrame:
    """One text column ``line``: the listed columns joined by ``sep``; a
    column with digits is written with that many decimals (``%.Nf``)."""
    parts = [fixed(c, d) if d is not None else F.col(c).cast("string") for c, d in spec]
    return df.select(F.concat_ws(sep, *parts).alias("line"))


# Engine and workload labels used by result files.
ENGINE_LABELS = {"Spark_PySpark": "spark", "Hadoop_MapReduce": "hadoop"}
WORKLOAD_LABELS = {
    "WL1_aggregation": "WL1: Daily Aggregation",
    "WL2_fraud": "WL2: Fraud Proxy",
    "WL3_join_window": "WL3: Join + Window",
}
# the numeric fields of the run layout; the exit code has rules of its own
RUN_NUMERIC = [f.name for f in BENCH_RUNS.fields
               if f.dataType.simpleString() in ("double", "bigint") and f.name != "exit_code"]


def save_runs(df: DataFrame, path: str) -> None:
    write_csv(df, path)


def _label_map(m: dict[str, str]) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def normalise_runs(raw: DataFrame) -> DataFrame:
    """Typed run table from text columns: engine labels normalised, numeric
    fields missing/blank/unparseable -> 0.0, exit code missing -> 0 and
    unparseable -> 1, workload display label with fallback to the raw value."""
    cols = set(raw.columns)

    def num(c):
        if c not in cols:
            return F.lit(0.0).alias(c)
        return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c)

    eng = F.col("engine")
    engine = F.coalesce(_label_map(ENGINE_LABELS)[eng], eng).alias("engine")
    wl = F.col("workload")
    label = F.coalesce(_label_map(WORKLOAD_LABELS)[wl], wl).alias("workload_label")
    if "exit_code" in cols:
        ec_txt = F.btrim(F.col("exit_code").cast("string"))
        exit_code = (F.when(ec_txt.isNull() | (ec_txt == ""), F.lit(0))
                     .otherwise(F.coalesce(ec_txt.try_cast("int"), F.lit(1)))).alias("exit_code")
    else:
        exit_code = F.lit(0).alias("exit_code")
    keep = [F.col(c) for c in ("dataset", "error_msg", "notes") if c in cols]
    return raw.select(engine, wl.alias("workload"), label, *[num(c) for c in RUN_NUMERIC],
                      exit_code, *keep)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read a run-result CSV written with a header (any subset of the
    result columns) and normalise it.  All fields are read as text first so
    a bad value becomes a default instead of failing the scan."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return normalise_runs(raw)


RUNS_SCHEMA = BENCH_RUNS
