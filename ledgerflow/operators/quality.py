"""Data quality: table profile of raw delimited text, header check against
an expected layout, numeric column summary, and input footprint."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import count_where, guarded_ratio, strip_quotes
from ..sources.delimited import FILE, HEAD, field_count, is_header, split_fields
from .prefix import exact_quantiles

# Label column names recognised by the profile, and the
# label texts counted as positive.
LABEL_NAMES = ("fraud", "isfraud")
POSITIVE_LABELS = ("1", "1.0")


def read_header(spark: SparkSession, path: str, quote: str = '"') -> list[str]:
    """Column names from the header line (trimmed, ``'`` stripped)."""
    cols = spark.read.option("header", True).option("quote", quote).csv(path).columns
    return [c.strip().strip("'") for c in cols]


def profile_text(lines: DataFrame, columns: list[str], expected: list[str] | None = None,
                 value: str = "value", quote: str = "'") -> DataFrame:
    """One-row profile of raw delimited lines (header lines excluded):
    rows, positive labels and their rate in percent, amount sum and mean over
    *all* rows, unparseable amounts, and the column-count check.  The label
    is counted before the amount is parsed; an empty amount is an error; a row
    too short to hold a field is neither counted nor an error for it."""
    low = [c.lower() for c in columns]
    label_idx = max((i for i, c in enumerate(low) if c in LABEL_NAMES), default=None)
    amount_idx = max((i for i, c in enumerate(low) if c == "amount"), default=None)
    body = lines.filter(~is_header(lines, columns, value)) if columns else lines
    # quote-aware split by the CSV parser: every field as text; a short row
    # has NULLs past its end, a long row's extra fields are ignored
    text_schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    rec = F.from_csv(F.col(value), text_schema, {"quote": quote, "mode": "PERMISSIVE"})
    body = body.select(rec.alias("__f"), field_count(value, quote).alias("__nf"))

    def field(i):
        return strip_quotes(F.col(f"__f.c{i}"))

    if label_idx is not None:
        positive = count_where(field(label_idx).isin(*POSITIVE_LABELS))
    else:
        positive = F.lit(0).cast("long")
    if amount_idx is not None:
        amt_txt = field(amount_idx)
        amt = amt_txt.try_cast("double")
        amount_sum = F.coalesce(F.sum(amt), F.lit(0.0))
        errors = count_where((F.col("__nf") > amount_idx) & amt.isNull())
    else:
        amount_sum, errors = F.lit(0.0), F.lit(0).cast("long")
    g = body.agg(F.count(F.lit(1)).alias("row_count"), positive.alias("fraud_count"),
                 amount_sum.alias("amount_sum"), errors.alias("parse_errors"))
    n_expected = len(expected) if expected is not None else len(columns)
    return g.select(
        "row_count", "fraud_count",
        (guarded_ratio("fraud_count", "row_count") * 100).alias("fraud_rate_pct"),
        "amount_sum", guarded_ratio("amount_sum", "row_count").alias("avg_amount"),
        "parse_errors", F.lit(len(columns)).alias("n_columns"),
        F.lit(n_expected).alias("expected_columns"),
        (F.lit(len(columns)) == F.lit(n_expected)).alias("column_count_ok"))


def profile_file(spark: SparkSession, path: str, expected: list[str] | None = None,
                 quote: str = "'") -> DataFrame:
    """``profile_text`` of a delimited file or folder plus its size in MB
    (both one-row frames)."""
    from ..sources.delimited import read_lines
    cols = read_header(spark, path, quote=quote)
    prof = profile_text(read_lines(spark, path), cols, expected=expected, quote=quote)
    size = footprint(spark, {"input": path}, glob="*").select("size_mb")
    return size.crossJoin(F.broadcast(prof))


def header_check(lines: DataFrame, expected: list[str], value: str = "value") -> DataFrame:
    """Compare the first line of each file (``lines`` from ``read_lines``)
    with the expected column list: one row per file and name with
    expected/found position and a status of ``ok``, ``moved``, ``missing`` or
    ``unexpected``.  Only lines of a file's first split are looked at; the
    first of them is picked by its place, whatever it holds."""
    spark = lines.sparkSession
    first = (lines.filter(F.col(HEAD)).withColumn("__at", F.monotonically_increasing_id())
             .groupBy(FILE).agg(F.min_by(value, "__at").alias(value)))
    found = (first.select(F.col(FILE).alias("file"), F.posexplode(split_fields(value)).alias("pos", "raw"))
             .select("file", strip_quotes("raw").alias("column"), F.col("pos").alias("found_position")))
    exp = spark.createDataFrame([(c, i) for i, c in enumerate(expected)],
                                "column string, expected_position int")
    wanted = first.select(F.col(FILE).alias("file")).crossJoin(F.broadcast(exp))  # the layout: a few names
    j = wanted.join(found, on=["file", "column"], how="full_outer")
    status = (F.when(F.col("found_position").isNull(), "missing")
               .when(F.col("expected_position").isNull(), "unexpected")
               .when(F.col("found_position") == F.col("expected_position"), "ok")
               .otherwise("moved"))
    return j.select("file", "column", "expected_position", "found_position", status.alias("status"))


def numeric_summary(df: DataFrame, c: str,
                    probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample stddev, min, exact quartiles, max of one column
    (the whole table, not a preview).  Both parts are one-row frames."""
    moments = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"),
                     F.stddev_samp(c).alias("stddev"), F.min(c).alias("min"),
                     F.max(c).alias("max"))
    quant = exact_quantiles(df, c, list(probs), prefix="p")
    return moments.crossJoin(F.broadcast(quant)).select(
        "count", "mean", "stddev", "min", *quant.columns, "max")


def footprint(spark: SparkSession, tables: dict[str, str], glob: str = "*.parquet") -> DataFrame:
    """Files, bytes and MB feeding each named table (0 files where a folder
    holds none), in one listing of all of them.  The ``binaryFile`` source
    lists the files with their length (one row per file; the file content is
    never read because it is not selected); a file belongs to the longest of
    the paths that it is or lies below."""
    names = {n: re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", p).rstrip("/") for n, p in tables.items()}
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", True).load(list(dict.fromkeys(tables.values()))).select("path", "length"))
    wanted = spark.createDataFrame(list(names.items()), "table string, root string")  # as many as are named
    below = F.col("path").endswith(F.col("root")) | F.contains(F.col("path"), F.concat("root", F.lit("/")))
    owned = files.join(F.broadcast(wanted), below).groupBy("path").agg(
        F.max("length").alias("length"), F.max_by("root", F.length("root")).alias("root"))
    sums = owned.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    n, size = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "bytes"))
    return F.broadcast(wanted).join(sums, "root", "left").select(
        "table", n.alias("n_files"), size.alias("total_bytes"), (size / (1024 * 1024)).alias("size_mb"))
