import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from ledgerflow import fixtures as fx
from ledgerflow.operators import windows as win

METHODS = ["skew_safe", "window"]


@pytest.mark.parametrize("method", METHODS)
def test_trailing_window_inclusive_bounds_and_ties(spark, method):
    # M1: (step, amount) = (1,1) (1,2) (25,4) (26,8)
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("a", 25, 4.0), ("a", 26, 8.0)],
                               "acct string, step long, amount double")
    out = win.rolling(df, ["acct"], "step", "amount", method=method)
    got = rows(out, "step", "amount", "rolling_24h_sum", "rolling_24h_count", "rolling_24h_max")
    assert got == [(1, 1.0, 3.0, 2, 2.0), (1, 2.0, 3.0, 2, 2.0),
                   (25, 4.0, 7.0, 3, 4.0), (26, 8.0, 12.0, 2, 8.0)]


@pytest.mark.parametrize("method", METHODS)
def test_fractional_steps(spark, method):
    # M2: long-truncated order 1, 14, 14; raw double order 1, 10, 13
    df = spark.createDataFrame([("a", 1.9, 1.0), ("a", 25.5, 9.0), ("a", 25.95, 4.0)],
                               "acct string, step double, amount double")
    as_long = win.rolling(df, ["acct"], "step", "amount", order_type="long", method=method)
    as_double = win.rolling(df, ["acct"], "step", "amount", order_type="double", method=method)
    assert rows(as_long, "step", "rolling_24h_sum") == [(1.9, 1.0), (25.5, 14.0), (25.95, 14.0)]
    assert rows(as_double, "step", "rolling_24h_sum") == [(1.9, 1.0), (25.5, 10.0), (25.95, 13.0)]


def test_skew_safe_equals_window_with_many_buckets(spark):
    # tiny buckets force halo copies across bucket edges
    src = fx.ta(spark, SF_SMALL).select("account", "step", "amount")
    a = win.rolling(src, ["account"], "step", "amount", bucket_width=30)
    b = win.rolling(src, ["account"], "step", "amount", method="window")
    cols = ["account", "step", "amount", "rolling_24h_count", "rolling_24h_max"]
    ra = rows(a.withColumn("s", F.round("rolling_24h_sum", 6)), *cols, "s")
    rb = rows(b.withColumn("s", F.round("rolling_24h_sum", 6)), *cols, "s")
    assert ra == rb and len(ra) == src.count()


def test_hot_account_split_over_buckets(spark):
    # one account holding most rows, spread over time: same result both ways
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 7, F.lit("hot")).otherwise(F.concat(F.lit("c"), (F.col("id") % 13).cast("string"))).alias("acct"),
        (F.col("id") % 500).alias("step"), (F.col("id") % 97).cast("double").alias("amount"))
    a = win.rolling(df, ["acct"], "step", "amount", bucket_width=48)
    b = win.rolling(df, ["acct"], "step", "amount", method="window")
    assert rows(a) == rows(b)


def test_null_order_keys_frame_together(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("a", 5, 4.0)],
                               "acct string, step long, amount double")
    a = rows(win.rolling(df, ["acct"], "step", "amount"), "step", "rolling_24h_sum")
    b = rows(win.rolling(df, ["acct"], "step", "amount", method="window"), "step", "rolling_24h_sum")
    assert a == b


def test_velocity_count_matches_window_form(spark):
    src = fx.ta(spark, SF_SMALL)
    a = win.velocity_count(src, "account", "step")
    b = win.velocity_count_window(src, "account", "step")
    assert rows(a, "tx_id", "hourly_tx_count") == rows(b, "tx_id", "hourly_tx_count")


def test_emit_from_reads_only_the_needed_history(spark):
    src = fx.ta(spark, SF_SMALL).select("account", "step", "amount")
    full = win.rolling(src, ["account"], "step", "amount").filter("step >= 300")
    part = win.rolling(src, ["account"], "step", "amount", emit_from=300)
    cols = ["account", "step", "amount", "rolling_24h_count", "rolling_24h_max"]
    assert rows(part, *cols) == rows(full, *cols)


def test_velocity_count_with_hot_account(spark):
    # one account holds most rows: the grouped form equals the window form
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(
            F.concat(F.lit("c"), (F.col("id") % 17).cast("string"))).alias("acct"),
        (F.col("id") % 300).alias("step"), F.col("id").alias("rid"))
    a = win.velocity_count(df, "acct", "step")
    b = win.velocity_count_window(df, "acct", "step")
    assert rows(a, "rid", "hourly_tx_count") == rows(b, "rid", "hourly_tx_count")


def _dense(spark, n, seed=3):
    """Rows of two accounts (one of them NULL), most in the first, with
    fractional steps, repeated steps, NULL steps and NULL amounts."""
    import random
    rng = random.Random(seed)
    out = []
    for i in range(n):
        step = None if i % 97 == 0 else round(rng.random() * 90, 3) if i % 3 else float(rng.randrange(90))
        out.append((i, None if i % 11 == 0 else "hot", step, None if i % 13 == 0 else round(rng.random() * 100, 2)))
    return spark.createDataFrame(out, "id long, acct string, step double, amount double")


@pytest.mark.parametrize("block, group", [(4, 2), (7, 64), (256, 64)])
def test_split_account_equals_window(spark, monkeypatch, block, group):
    monkeypatch.setattr(win, "HOT_STEPS", 10)
    monkeypatch.setattr(win.split_rolling, "__defaults__", (block, group))
    df = _dense(spark, 1500)
    got = win.rolling(df, ["acct"], "step", "amount", order_type="double")
    want = win.rolling(df, ["acct"], "step", "amount", order_type="double", method="window")
    cols = ["id", "acct", "step", "amount", "rolling_24h_count", "rolling_24h_max", "s"]
    a, b = (rows(x.withColumn("s", F.round("rolling_24h_sum", 6)), *cols) for x in (got, want))
    assert a == b and len(a) == 1500


def test_split_account_without_partition_columns_or_rows(spark, monkeypatch):
    monkeypatch.setattr(win, "HOT_STEPS", 10)
    df = _dense(spark, 400).withColumn("kind", F.col("id") % 2)
    for keys in (["kind"], ["acct", "kind"]):
        got = win.rolling(df, keys, "step", "amount", size=3, order_type="double", measures=("sum", "count", "max"))
        want = win.rolling(df, keys, "step", "amount", size=3, order_type="double", method="window")
        assert rows(got, "id", "rolling_24h_count", "rolling_24h_max") == rows(want, "id", "rolling_24h_count", "rolling_24h_max")
    assert win.rolling(df.limit(0), ["acct"], "step", "amount", order_type="double").count() == 0


def test_sums_of_a_split_account_do_not_cancel(spark, monkeypatch):
    """A huge early amount leaves the precision of later frames alone."""
    monkeypatch.setattr(win, "HOT_STEPS", 10)
    df = spark.range(2000).selectExpr("'a' as acct", "id / 10.0D as step", "if(id = 0, 1e18D, 0.01D) as amount")
    got = win.rolling(df, ["acct"], "step", "amount", size=5, order_type="double").filter("step > 10")
    assert got.filter("abs(rolling_24h_sum - 0.01 * rolling_24h_count) > 1e-12").count() == 0 and got.count() > 1800


def test_one_account_is_spread_over_tasks(spark):
    """All rows in one account and one window length: no partition of the
    block windows holds more than a few blocks."""
    df = spark.range(60_000).selectExpr("'a' as acct", "id / 5000.0D as __ord", "1.0D as __s", "1L as __c", "1.0D as __m")
    out = win.split_rolling(df, ["acct"], "__ord", 24)
    assert out.filter("__c <> round(__ord * 5000) + 1").count() == 0
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions stay apart, as large ones do
    spark.conf.set(key, "false")
    try:
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set(key, "true")
    assert len(sizes) > 4 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("order_type, limit", [("long", "HOT_ROWS"), ("double", "HOT_STEPS")])
def test_rows_pass_the_window_in_one_exchange(spark, monkeypatch, order_type, limit):
    """Rows of accounts that fit a bucket are shuffled once and joined with
    nothing; dense accounts still take the collapsed form, with equal results."""
    df = _dense(spark, 1500)
    want = win.rolling(df, ["acct"], "step", "amount", size=7, order_type=order_type, method="window")
    cols = ["id", "acct", "step", "amount", "rolling_24h_count", "rolling_24h_max", "s"]
    want = rows(want.withColumn("s", F.round("rolling_24h_sum", 6)), *cols)
    whole = win.rolling(df, ["acct"], "step", "amount", size=7, order_type=order_type)
    plan = whole._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("Window [") == 1
    assert rows(whole.withColumn("s", F.round("rolling_24h_sum", 6)), *cols) == want
    monkeypatch.setattr(win, limit, 10)
    dense = win.rolling(df, ["acct"], "step", "amount", size=7, order_type=order_type)
    assert "Join" in dense._jdf.queryExecution().sparkPlan().toString()
    assert rows(dense.withColumn("s", F.round("rolling_24h_sum", 6)), *cols) == want
