import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerflow import fixtures as fx
from ledgerflow.operators import aggregate as agg
from ledgerflow.plans import workloads as wl
from ledgerflow.schemas import Layout

LAY = Layout("T", account="acct", step="step", type_="type", amount="amount", label="label")


def _m3(spark):
    data = [(i, "a", i, "x", 100.0, 0) for i in range(1, 13)]
    data += [(13, "b", 13, "x", 1_000_000.0, 1), (14, "c", 14, "x", -2.0, 0),
             (15, "d", 15, "x", None, 0)]
    return spark.createDataFrame(data, "id long, acct string, step long, type string, amount double, label int")


def test_zscore_micro_fixture(spark):
    # M3: stats over 13 values (log1p(-2) is NULL, NULL amount filtered)
    f = wl.fraud_flags(_m3(spark), LAY, z_threshold=2.5)
    by_id = {r["id"]: r for r in f.collect()}
    assert 15 not in by_id
    assert by_id[1]["global_mean"] == pytest.approx(5.322843, abs=1e-6)
    assert by_id[1]["global_std"] == pytest.approx(2.551729, abs=1e-6)
    assert by_id[1]["amount_z_score"] == pytest.approx(-0.27735, abs=1e-5)
    assert by_id[13]["amount_z_score"] == pytest.approx(3.32820, abs=1e-5)
    assert by_id[13]["amount_flag"] is True and by_id[1]["amount_flag"] is False
    assert by_id[14]["amount_z_score"] is None and by_id[14]["fraud_proxy"] == 0
    # velocity: 12 rows of account a in different hours -> no velocity flag
    assert all(r["fraud_proxy"] == (1 if r["id"] == 13 else 0) for r in by_id.values())


@pytest.mark.parametrize("n", [1, 3])
def test_degenerate_stats(spark, n):
    # M4: one row -> std NULL -> 1.0; equal rows -> std 0 -> 1.0; z = 0
    df = spark.createDataFrame([(i, "a", i, "x", 50.0, 0) for i in range(n)],
                               "id long, acct string, step long, type string, amount double, label int")
    z = [r["amount_z_score"] for r in wl.fraud_flags(df, LAY).collect()]
    assert z == [0.0] * n


def test_empty_input_gives_empty_output(spark):
    df = _m3(spark).filter(F.lit(False))
    assert wl.fraud_flags(df, LAY).count() == 0


def test_precision_recall_guards(spark):
    # M7: nothing flagged -> precision 0; no positives -> recall 0
    df = spark.createDataFrame([(0, 0), (0, 0)], "pred int, label int")
    r = agg.precision_recall(df, "pred", "label").collect()[0]
    assert (r["precision"], r["recall"], r["total_flagged"]) == (0.0, 0.0, 0)


def test_proxy_is_zero_iff_no_flag(spark):
    f = wl.fraud_flags(fx.ta(spark, SF_SMALL), fx.TA_LAYOUT, z_threshold=1.5)
    bad = f.filter((F.col("fraud_proxy") == 1) !=
                   (F.coalesce("velocity_flag", F.lit(False)) | F.coalesce("amount_flag", F.lit(False))))
    assert bad.count() == 0


def test_scores_in_unit_interval(spark):
    s = wl.workload2_scores([(fx.ta(spark, SF_SMALL), fx.TA_LAYOUT)], z_thresholds=(1.5,)).collect()[0]
    assert 0 <= s["precision"] <= 1 and 0 <= s["recall"] <= 1
    assert s["true_positives"] <= min(s["total_flagged"], s["total_actual"])


def test_pooled_population_stats(spark):
    a = spark.createDataFrame([("a", 1, "x", 1.0, 0), ("a", 2, "x", -5.0, 0)],
                              "acct string, step long, type string, amount double, label int")
    stats = wl.pooled_log_stats([(a, LAY), (a, LAY)]).collect()[0]
    vals = [math.log1p(1.0), 0.0, math.log1p(1.0), 0.0]
    mean = sum(vals) / 4
    assert stats["global_mean"] == pytest.approx(mean)
    assert stats["global_std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vals) / 4))


def test_facts_are_read_twice(spark):
    """Once for the rows, once for the aggregate that gives counts and statistics."""
    import re
    from ledgerflow.plans.catalog import QUERIES
    qe = QUERIES["union_fraud"](spark, SF_SMALL)._jdf.queryExecution()
    qe.toRdd().count()
    plan = qe.executedPlan().toString()
    assert "isFinalPlan=true" in plan
    plan = plan.split("+- == Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet .*events.parquet", plan)) == 2
    assert len(re.findall(r"FileScan parquet .*lineitem.parquet", plan)) <= 2


def test_merged_statistics_equal_the_plain_ones(spark):
    import math
    a = fx.ta(spark, SF_SMALL)
    for ddof in (0, 1):
        r = wl.pooled_log_stats([(a, fx.TA_LAYOUT)], ddof=ddof, clamp_nonpositive=False).first()
        x = [math.log1p(v.amount) for v in a.where("amount is not null and step is not null").collect()]
        m = sum(x) / len(x)
        sd = math.sqrt(sum((v - m) ** 2 for v in x) / (len(x) - ddof))
        assert abs(r.global_mean - m) < 1e-9 and abs(r.global_std - sd) < 1e-9
