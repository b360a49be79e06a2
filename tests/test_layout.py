"""Results do not depend on how the inputs are partitioned."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from ledgerflow import fixtures as fx
from ledgerflow.plans import workloads as wl


def _round(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def test_workloads_independent_of_partitioning(spark):
    ta, tb, net = fx.ta(spark, SF_SMALL), fx.tb(spark, SF_SMALL), fx.net(spark, SF_SMALL)
    a1, b1 = (ta, fx.TA_LAYOUT), (tb, fx.TB_LAYOUT)
    a2, b2 = (ta.repartition(7), fx.TA_LAYOUT), (tb.repartition(5, "customer"), fx.TB_LAYOUT)
    for build in (lambda a, b, n: wl.workload1([a, b]),
                  lambda a, b, n: wl.workload2([a, b], z_threshold=1.5),
                  lambda a, b, n: wl.workload3(hourly=a, daily=b, edges=n, network_key="Target")):
        assert rows(_round(build(a1, b1, net))) == rows(_round(build(a2, b2, net.repartition(3))))


def test_projection_does_not_change_row_set(spark):
    out = wl.workload3(hourly=(fx.ta(spark, SF_SMALL), fx.TA_LAYOUT))
    n = out.count()
    assert out.select("account").count() == n
    assert out.groupBy("account").count().agg(F.sum("count")).collect()[0][0] == n


def test_a_rewritten_table_is_read_with_its_own_schema(spark, tmp_path):
    import time
    from ledgerflow import fixtures as fx
    path = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(path)
    assert fx.table(spark, str(tmp_path), "t").columns == ["id"]
    time.sleep(1.1)
    spark.range(3).selectExpr("id", "id * 2 as two").write.mode("overwrite").parquet(path)
    assert fx.table(spark, str(tmp_path), "t").columns == ["id", "two"]
