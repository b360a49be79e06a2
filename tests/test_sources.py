import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from conftest import rows
from ledgerflow.session import scratch_path
from ledgerflow.sources import delimited as dl
from ledgerflow.sources import sinks

M5 = """step,customer,amount,fraud
0,'C1',4.55,0
'1','C1','5.0','1'
2,'C2',abc,0
3,'C3',1.0
4,'C4',1.0,0,9
5,,2.0,1
"""
M5_SCHEMA = StructType([StructField("step", LongType()), StructField("customer", StringType()),
                        StructField("amount", DoubleType()), StructField("fraud", IntegerType())])


def _write(spark, name, text):
    path = scratch_path(spark, name)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.csv"), "w") as f:
        f.write(text)
    return path


def test_dirty_csv_good_rows_and_quarantine(spark):
    path = _write(spark, "m5", M5)
    lines = dl.drop_headers(dl.read_lines(spark, path), [M5_SCHEMA.fieldNames()])
    good, bad = dl.split_malformed(lines, M5_SCHEMA, quote="'")
    assert rows(good) == [(0, "C1", 4.55, 0), (1, "C1", 5.0, 1), (5, None, 2.0, 1)]
    assert rows(bad, "reason") == [("bad_value",), ("too_few_fields",), ("too_many_fields",)]
    # the kept set does not depend on the projection above it
    assert good.count() == 3
    assert good.select("customer").count() == 3
    assert good.groupBy("fraud").count().agg(F.sum("count")).collect()[0][0] == 3
    assert rows(dl.quarantine_summary(bad)) == [("bad_value", 1), ("too_few_fields", 1),
                                                ("too_many_fields", 1)]


def test_mixed_layout_router(spark):
    # M6: one 11-field, one 10-field (quoted), one 5-field line, a header, junk
    text = ("step,type,amount,nameOrig,oldbalanceOrg,newbalanceOrig,nameDest,oldbalanceDest,"
            "newbalanceDest,isFraud,isFlaggedFraud\n"
            "1,PAYMENT,9.5,C1,10.0,0.5,M1,0.0,0.0,0,0\n"
            "'2','C2','3','M','28007','M2','28007','es_food','12.5','0'\n"
            "'C3','M3','7.0','es_bar','1'\n"
            "junk\n")
    routed = dl.route_records(dl.read_lines(spark, _write(spark, "m6", text)), dl.default_layouts())
    assert rows(routed["paysim"], "step", "nameOrig", "amount") == [(1, "C1", 9.5)]
    assert rows(routed["banksim_tx"], "step", "customer", "amount") == [(2.0, "C2", 12.5)]
    assert rows(routed["banksim_net"], "Source", "Target", "Weight") == [("C3", "M3", 7.0)]


def test_router_counts_fields_outside_quotes(spark):
    text = ("'2','C2','3','M','28007','M2','28007','es_food, bar','12.5','0'\n"
            "'C3','M3','7.0','es_bar, x','1'\n")
    routed = dl.route_records(dl.read_lines(spark, _write(spark, "m6q", text)), dl.default_layouts())
    assert rows(routed["banksim_tx"], "category") == [("es_food, bar",)]
    assert rows(routed["banksim_net"], "typeTrans") == [("es_bar, x",)]
    assert routed["paysim"].count() == 0


def test_missing_sources(spark):
    # M10: one of two present -> only its rows; none -> error
    present = _write(spark, "m10", "step,customer,amount,fraud\n1,'C1',2.0,0\n")
    absent = scratch_path(spark, "absent")

    def reader(s, p):
        return dl.read_typed(s, p, M5_SCHEMA, quote="'")
    frames = dl.load_available(spark, [present, absent], reader)
    assert len(frames) == 1 and frames[0].count() == 1
    with pytest.raises(RuntimeError):
        dl.load_available(spark, [absent], reader)


def test_csv_sink_roundtrip_nulls_and_counts(spark):
    df = spark.createDataFrame([("a", 1.5, 1), (None, None, 2)], "s string, x double, n long")
    path = scratch_path(spark, "sink")
    assert sinks.write_counted(df, path) == 2
    sinks.write_csv(df, path + "_csv")
    back = dl.read_typed(spark, path + "_csv", StructType(
        [StructField("s", StringType()), StructField("x", DoubleType()), StructField("n", LongType())]))
    assert rows(back) == [("a", 1.5, 1), (None, None, 2)]


def test_runs_loader_defaults(spark):
    text = ("engine,workload,wall_time_sec,exit_code\n"
            "Spark_PySpark,WL1_aggregation,12.5,0\n"
            "Hadoop_MapReduce,custom,,oops\n")
    out = sinks.load_runs(spark, _write(spark, "runs", text))
    got = rows(out, "engine", "workload_label", "wall_time_sec", "cpu_time_sec", "exit_code")
    assert got == [("hadoop", "custom", 0.0, 0.0, 1),
                   ("spark", "WL1: Daily Aggregation", 12.5, 0.0, 0)]


def test_profile_file_counts_and_size(spark):
    from ledgerflow.operators.quality import profile_file
    text = "step,amount,isFraud\n1,2.5,1\n2,bad,1.0\n3,4.0,0\n4\n"
    r = profile_file(spark, _write(spark, "prof", text), expected=["step", "amount", "isFraud"]).collect()[0]
    assert (r.row_count, r.fraud_count, r.parse_errors) == (4, 2, 1)
    assert r.amount_sum == 6.5 and r.avg_amount == 6.5 / 4 and r.column_count_ok
    assert r.size_mb == pytest.approx(len(text) / (1024 * 1024))


def test_records_that_read_like_headers_are_kept(spark):
    text = ("Source,Target,Weight,typeTrans,fraud\n'C1','M1','1.0','x','0'\n'step','M2','2.0','x','1'\n"
            "'source','M3','3.0','x','0'\n'Source',''\n")
    path = _write(spark, "net_odd", text)
    assert rows(dl.read_banksim_net(spark, path), "Source", "Weight") == [("C1", 1.0), ("source", 3.0), ("step", 2.0)]
    from ledgerflow.schemas import BANKSIM_NET
    c = dl.ingest_counts(spark, path, BANKSIM_NET, quote="'").collect()[0]
    assert (c.n_good, c.n_dropped, c.too_few_fields) == (3, 1, 1)
    routed = dl.route_records(dl.read_lines(spark, path), dl.default_layouts())
    assert routed["banksim_net"].count() == 3


def test_a_file_without_header_loses_nothing(spark):
    path = _write(spark, "net_bare", "'step','M2','2.0','x','1'\n'C1','M1','1.0','x','0'\n")
    assert dl.read_banksim_net(spark, path).count() == 2
