import os

from conftest import SF_SMALL
from ledgerflow import fixtures as fx
from ledgerflow.plans import queries_io as qio
from ledgerflow.plans import runners
from ledgerflow.session import scratch_path


def _data_dir(spark, with_bank=True):
    d = scratch_path(spark, "data")
    os.makedirs(d, exist_ok=True)
    for name, writer in [(runners.PAYSIM_FILE, qio.write_paysim_csv),
                         (runners.BANKSIM_FILE, qio.write_banksim_csv),
                         (runners.NETWORK_FILE, qio.write_network_csv)]:
        if name != runners.PAYSIM_FILE and not with_bank:
            continue
        os.rename(writer(spark, SF_SMALL), os.path.join(d, name))
    return d


def test_runners_end_to_end(spark):
    d, out = _data_dir(spark), scratch_path(spark, "out")
    n_ta, n_tb = fx.ta(spark, SF_SMALL).count(), fx.tb(spark, SF_SMALL).count()
    n1 = runners.run_workload1(spark, d, out)
    assert n1 == spark.read.option("header", True).csv(os.path.join(out, "workload1_aggregation")).count()
    n2, scores = runners.run_workload2(spark, d, out, z_threshold=1.5)
    assert n2 == n_ta + n_tb and {s["dataset"] for s in scores} == {"PAYSIM", "BANKSIM"}
    assert runners.run_workload3(spark, d, out) == n_ta + n_tb


def test_runner_with_one_source(spark):
    d, out = _data_dir(spark, with_bank=False), scratch_path(spark, "out1")
    assert runners.run_workload3(spark, d, out) == fx.ta(spark, SF_SMALL).count()


def test_observed_scores_equal_the_scoring_pass(spark):
    from ledgerflow.plans import workloads as wl
    parts = [(fx.ta(spark, SF_SMALL), fx.TA_LAYOUT), (fx.tb(spark, SF_SMALL), fx.TB_LAYOUT)]
    out, scores = wl.observed_scores(parts, z_threshold=1.5)
    out.write.format("noop").mode("overwrite").save()
    want = {r.dataset: r for r in wl.workload2_scores(parts, z_thresholds=(1.5,)).collect()}
    for got in scores():
        w = want[got["dataset"]]
        assert (got["total_flagged"], got["true_positives"], got["total_actual"]) == (
            w.total_flagged, w.true_positives, w.total_actual)
        assert abs(got["precision"] - w.precision) < 1e-12 and abs(got["recall"] - w.recall) < 1e-12


def test_ingest_report_counts_what_is_dropped(spark):
    d = scratch_path(spark, "report")
    os.makedirs(d)
    os.rename(qio.write_damaged(spark, SF_SMALL), os.path.join(d, runners.PAYSIM_FILE))
    r = runners.ingest_report(spark, d).collect()
    n = fx.ta(spark, SF_SMALL).count()
    assert len(r) == 1 and r[0].source == "paysim" and r[0].n_good + r[0].n_dropped == n
    assert r[0].n_dropped == r[0].too_few_fields + r[0].too_many_fields + r[0].bad_value > 0


def test_row_counts_join_their_sources_once(spark, monkeypatch):
    read, table = [], fx.table
    monkeypatch.setattr(fx, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    got = {r.workload: r.output_rows for r in qio.workload_row_counts(spark, SF_SMALL).collect()}
    assert read.count("lineitem") == 1
    n = sum(f(spark, SF_SMALL).filter("step is not null and amount is not null").count() for f in (fx.ta, fx.tb))
    assert got["WL2_fraud"] == got["WL3_join_window"] == n and 0 < got["WL1_aggregation"] <= n


def test_enriched_csv_parses_each_line_once(spark, monkeypatch):
    from ledgerflow.plans import workloads as wl
    given, workload3 = [], wl.workload3
    monkeypatch.setattr(wl, "workload3", lambda **kw: given.append(kw) or workload3(**kw))
    n = qio.union_enriched_csv(spark, SF_SMALL).count()
    facts = [given[0][k][0] for k in ("hourly", "daily")]
    assert all("from_csv" not in f._jdf.queryExecution().optimizedPlan().toString() for f in facts)
    assert n == sum(f.filter("step is not null and amount is not null").count() for f in facts)
