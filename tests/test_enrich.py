from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from ledgerflow import fixtures as fx
from ledgerflow.operators import aggregate as agg
from ledgerflow.operators import enrich as en
from ledgerflow.plans import workloads as wl


def test_pair_lookup_last_wins_and_defaults(spark):
    # M8
    facts = spark.createDataFrame([("C1", "M1"), ("C1", "M2"), ("C2", "M1")], "c string, m string")
    edges = spark.createDataFrame([("C1", "M1", "x", 1.0, 1), ("C1", "M1", "y", 2.0, 2),
                                   ("C3", "M1", "z", 9.0, 3)],
                                  "Source string, Target string, typeTrans string, Weight double, seq int")
    out = en.enrich_pair(facts, edges, "c", "m", order=["seq"])
    assert rows(out) == [("C1", "M1", "y", 2.0), ("C1", "M2", "NONE", 0.0), ("C2", "M1", "NONE", 0.0)]


def test_dimension_with_null_key_keeps_fact(spark):
    # M9
    facts = spark.createDataFrame([("a", "M1", 1.0, 0), ("b", None, 2.0, 1), ("c", "M1", 3.0, 1)],
                                  "acct string, cp string, amount double, label int")
    dim = agg.build_dimension(facts, "cp", "amount", "label")
    out = en.enrich(facts, dim, "cp")
    got = rows(out, "acct", "total_received_tx", "total_received_amount", "fraud_received_count")
    assert got == [("a", 2, 4.0, 1), ("b", None, None, None), ("c", 2, 4.0, 1)]


def test_enrichment_preserves_row_count(spark):
    ta = fx.ta(spark, SF_SMALL)
    out = wl.workload3(hourly=(ta, fx.TA_LAYOUT), daily=(fx.tb(spark, SF_SMALL), fx.TB_LAYOUT),
                       edges=fx.net(spark, SF_SMALL), network_key="Target")
    assert out.count() == ta.count() + fx.tb(spark, SF_SMALL).count()
    assert out.filter("rolling_24h_count < 1").count() == 0


def test_daily_counts_add_up(spark):
    ta, tb = fx.ta(spark, SF_SMALL), fx.tb(spark, SF_SMALL)
    w1 = wl.workload1([(ta, fx.TA_LAYOUT), (tb, fx.TB_LAYOUT)])
    total = w1.agg({"tx_count": "sum"}).collect()[0][0]
    assert total == ta.count() + tb.count()
    parts = [wl.workload1([(ta, fx.TA_LAYOUT)]).count(), wl.workload1([(tb, fx.TB_LAYOUT)]).count()]
    assert w1.count() == sum(parts)


def test_pair_workload_reads_its_facts_once(spark):
    """Facts, edges and their lookup: three joins, none back to the facts."""
    from conftest import SF_SMALL
    from ledgerflow import fixtures as fx
    from ledgerflow.plans import workloads as wl
    out = wl.workload3_pair(fx.tb(spark, SF_SMALL), fx.TB_LAYOUT, fx.net(spark, SF_SMALL), fx.NET_EDGE_ORDER)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3
    assert out.count() == fx.tb(spark, SF_SMALL).filter("step is not null and amount is not null").count()


def test_dimension_is_written_before_its_join_is_planned(spark):
    from conftest import SF_SMALL
    from ledgerflow import fixtures as fx
    from ledgerflow.plans import workloads as wl
    out = wl.workload3(hourly=(fx.ta(spark, SF_SMALL), fx.TA_LAYOUT))
    plan = out._jdf.queryExecution()
    assert "Aggregate" not in plan.optimizedPlan().toString() and "BroadcastHashJoin" in plan.sparkPlan().toString()
    assert out.filter("total_received_tx is not null").count() == fx.ta(spark, SF_SMALL).filter(
        "step is not null and amount is not null and counterparty is not null").count()


def _pairs(spark):
    """Facts with NULL and repeated keys, tied and NULL steps; edges of pairs
    that are missing, repeated, NULL or without a fact."""
    facts = spark.range(600).selectExpr(
        "id as line_id", "if(id % 11 = 0, null, concat('C', id % 7)) as customer",
        "if(id % 13 = 0, null, concat('M', id % 5)) as merchant", "if(id % 17 = 0, null, id % 90) as step",
        "if(id % 2 = 0, 'R', 'N') as category", "if(id % 19 = 0, null, id * 0.25D) as amount",
        "cast(id % 3 = 0 as int) as fraud")
    edges = spark.range(200).selectExpr(
        "if(id % 9 = 0, null, concat('C', id % 9)) as Source", "if(id % 8 = 0, null, concat('M', id % 4)) as Target",
        "if(id % 6 = 0, null, id * 1.5D) as Weight", "if(id % 10 = 0, null, concat('T', id % 3)) as typeTrans",
        "1 as fraud", "id as line_id", "id as part_id", "if(id % 7 = 0, null, id % 30) as step")
    return facts.unionAll(facts.limit(50)), edges


def test_pair_workload_shuffles_its_facts_once(spark, monkeypatch):
    """Many edges: facts and edges are dealt by account in one exchange for the
    lookup and the window, with the rows of the joined form."""
    facts, edges = _pairs(spark)
    joined = wl.workload3_pair(facts, fx.TB_LAYOUT, edges, fx.NET_EDGE_ORDER)
    monkeypatch.setattr(wl, "FEW_EDGES", 0)
    dealt = wl.workload3_pair(facts, fx.TB_LAYOUT, edges, fx.NET_EDGE_ORDER)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert dealt.schema.simpleString() == joined.schema.simpleString()
    assert rows(dealt) == rows(joined) and dealt.filter("dim_type <> 'NONE'").count() > 50
    # a dense account, or keys that have to be cast, take the joined form
    monkeypatch.setattr(wl, "HOT_STEPS", 20)
    assert not wl.deals_by_account(facts, edges, fx.TB_LAYOUT)
    monkeypatch.setattr(wl, "HOT_STEPS", 4096)
    assert wl.deals_by_account(facts, edges, fx.TB_LAYOUT)
    assert not wl.deals_by_account(facts, edges.withColumn("Source", F.lit(1)), fx.TB_LAYOUT)
    assert not wl.deals_by_account(facts.limit(0), edges.limit(0), fx.TB_LAYOUT)
