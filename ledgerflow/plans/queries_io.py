"""Registered queries for sources and sinks: typed delimited scans,
malformed-record quarantine, layout routing, optional sources, text
export, and text cleaning.

Each query first writes delimited text derived from the driver tables
into the session's shared scratch folder (below ``spark.checkpoint.dir``),
then reads it back with the operator under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField,
                               StructType)

from .. import fixtures as fx
from ..functions import columns as C
from ..session import scratch_path
from ..sources import delimited as dl
from ..sources import sinks
from . import workloads as wl
from .oracle import r, with_
from .queries import _W3_ROUND as W3_ROUND
from .registry import FINE, MONEY, ORACLE, present, query

W1_ROUND = {"total_amount": MONEY, "avg_amount": FINE}


# ------------------------------------------------------------ text fixtures

def paysim_frame(spark, d) -> DataFrame:
    """``ta`` in the 11-field PaySim layout (balances derived from amount)."""
    t = fx.ta(spark, d)
    return t.select(
        "step", "type", "amount", F.col("account").alias("nameOrig"),
        (F.col("amount") * 3).alias("oldbalanceOrg"), (F.col("amount") * 2).alias("newbalanceOrig"),
        F.col("counterparty").alias("nameDest"), (F.col("amount") * 4).alias("oldbalanceDest"),
        (F.col("amount") * 5).alias("newbalanceDest"), F.col("is_fraud").alias("isFraud"),
        F.when(F.col("amount") > 400, 1).otherwise(0).alias("isFlaggedFraud"))


_PAYSIM_SQL = """select step, "type", amount, account as nameOrig, amount*3 as oldbalanceOrg,
       amount*2 as newbalanceOrig, counterparty as nameDest, amount*4 as oldbalanceDest,
       amount*5 as newbalanceDest, is_fraud as isFraud,
       case when amount > 400 then 1 else 0 end as isFlaggedFraud
  from ta"""


def banksim_frame(spark, d) -> DataFrame:
    """``tb`` in the 10-field BankSim layout."""
    t = fx.tb(spark, d)
    return t.select(
        "step", "customer", (F.col("part_id") % 7).cast("string").alias("age"),
        F.when(F.col("fraud") == 1, "F").otherwise("M").alias("gender"),
        F.lit("28007").alias("zipcodeOri"), "merchant", F.lit("28007").alias("zipMerchant"),
        "category", "amount", "fraud")


_BANKSIM_SQL = """select cast(step as double) as step, customer, cast(part_id % 7 as varchar) as age,
       case when fraud = 1 then 'F' else 'M' end as gender, '28007' as zipcodeOri, merchant,
       '28007' as zipMerchant, category, amount, fraud
  from tb"""

_NET_SQL = "select Source, Target, Weight, typeTrans, fraud from net"


def write_paysim_csv(spark, d) -> str:
    path = scratch_path(spark, "paysim_csv")
    sinks.write_csv(paysim_frame(spark, d), path)
    return path


def write_banksim_csv(spark, d) -> str:
    path = scratch_path(spark, "banksim_csv")
    sinks.write_csv(banksim_frame(spark, d), path, quote="'", quote_all=True)
    return path


def write_network_csv(spark, d) -> str:
    path = scratch_path(spark, "network_csv")
    edges = fx.net(spark, d).select("Source", "Target", "Weight", "typeTrans", "fraud")
    sinks.write_csv(edges, path, quote="'", quote_all=True)
    return path


# ------------------------------------------------------------ A1-A3, A9

@query("scan_paysim_csv", with_("ta", _PAYSIM_SQL))
def scan_paysim_csv(spark, d):
    return dl.read_paysim(spark, write_paysim_csv(spark, d))


@query("scan_banksim_csv", with_("tb", _BANKSIM_SQL))
def scan_banksim_csv(spark, d):
    return dl.read_banksim_tx(spark, write_banksim_csv(spark, d))


@query("scan_network_csv", with_("net", _NET_SQL))
def scan_network_csv(spark, d):
    return dl.read_banksim_net(spark, write_network_csv(spark, d))


W1_SCHEMA = StructType([StructField(n, t, True) for n, t in [
    ("dataset", StringType()), ("account", StringType()), ("day", LongType()),
    ("type", StringType()), ("total_amount", DoubleType()), ("tx_count", LongType()),
    ("avg_amount", DoubleType()), ("max_amount", DoubleType()), ("fraud_count", LongType())]])


def _w1_sql(src, acct, day, typ, lab, dataset):
    return f"""select '{dataset}' as dataset, {acct} as account, {day} as day, {typ} as "type",
       {r('sum(amount)', MONEY)} as total_amount, count(*) as tx_count,
       {r('avg(amount)', FINE)} as avg_amount, max(amount) as max_amount,
       cast(count_if({lab} = 1) as bigint) as fraud_count
  from {src} where step is not null and {acct} is not null group by all"""


_W1_TA = _w1_sql("ta", "account", "cast(trunc(step / 24) as bigint)", '"type"', "is_fraud", "PAYSIM")
_W1_TB = _w1_sql("tb", "customer", "cast(step as bigint)", "category", "fraud", "BANKSIM")


@query("csv_sink_roundtrip", with_(["ta", "tb"], _W1_TA + "\nunion all\n" + _W1_TB))
def csv_sink_roundtrip(spark, d):
    out = present(wl.workload1([(fx.ta(spark, d), fx.TA_LAYOUT), (fx.tb(spark, d), fx.TB_LAYOUT)]),
                  W1_ROUND)
    path = scratch_path(spark, "w1_csv")
    sinks.write_csv(out, path)
    return dl.read_typed(spark, path, W1_SCHEMA)


# ------------------------------------------------------------ A4, A5

def damaged_paysim_lines(spark, d) -> DataFrame:
    """PaySim-layout text lines of ``ta``; some records damaged on purpose:
    an unparseable amount, a missing last field or an extra field."""
    t = fx.ta(spark, d)
    amount_txt = F.when(F.col("tx_id") % 97 == 0, F.lit("bad")).otherwise(F.col("amount").cast("string"))
    fields = [F.col("step").cast("string"), F.col("type"), amount_txt, F.col("account"),
              (F.col("amount") * 3).cast("string"), (F.col("amount") * 2).cast("string"),
              F.col("counterparty"), (F.col("amount") * 4).cast("string"),
              (F.col("amount") * 5).cast("string"), F.col("is_fraud").cast("string")]
    flagged = F.when(F.col("amount") > 400, F.lit("1")).otherwise(F.lit("0"))
    base = F.concat_ws(",", *fields)
    line = (F.when(F.col("tx_id") % 97 == 0, F.concat_ws(",", base, flagged))
             .when(F.col("tx_id") % 89 == 0, base)
             .when(F.col("tx_id") % 83 == 0, F.concat_ws(",", base, flagged, F.lit("9")))
             .otherwise(F.concat_ws(",", base, flagged)))
    return t.select(line.alias("value"))


def write_damaged(spark, d) -> str:
    path = scratch_path(spark, "damaged_txt")
    damaged_paysim_lines(spark, d).write.mode("overwrite").text(path)
    return path


_DAMAGE = """case when tx_id % 97 = 0 then 'bad_value' when tx_id % 89 = 0 then 'too_few_fields'
            when tx_id % 83 = 0 then 'too_many_fields' end"""


@query("scan_drop_malformed", with_("ta", f"""
select step, "type", amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest, oldbalanceDest,
       newbalanceDest, isFraud, isFlaggedFraud
  from ({_PAYSIM_SQL.replace('from ta', ', tx_id from ta')}) where {_DAMAGE} is null"""))
def scan_drop_malformed(spark, d):
    from ..schemas import PAYSIM
    good, _ = dl.split_malformed(dl.read_lines(spark, write_damaged(spark, d)), PAYSIM)
    return good


@query("malformed_quarantine", with_("ta", f"""
select reason, count(*) as n_rows from (select {_DAMAGE} as reason from ta)
 where reason is not null group by reason"""))
def malformed_quarantine(spark, d):
    from ..schemas import PAYSIM
    _, bad = dl.split_malformed(dl.read_lines(spark, write_damaged(spark, d)), PAYSIM)
    return dl.quarantine_summary(bad)


@query("ingest_both_sides", with_("ta", """
select coalesce(reason, 'good') as outcome, case when reason is null then account end as account,
       case when reason is null then step end as step, case when reason is null then amount end as amount,
       case when reason is null then length(account) else null end as n_account,
       case when reason is not null then account end as line_account,
       (select cast(count(*) as bigint) from s x where x.reason is not distinct from s.reason) as n_counted from s""",
    extra={"s": f"select *, {_DAMAGE} as reason from ta"}))
def ingest_both_sides(spark, d):
    """Typed records and quarantined lines of one pass, with the counts that
    were observed on its write."""
    from ..schemas import PAYSIM
    got = dl.ingest(spark, write_damaged(spark, d), PAYSIM, scratch_path(spark, "ingest"))
    n = F.create_map(*[F.lit(x) for r in dl.REASONS for x in (r, got.counts[r])])
    text, number = F.lit(None).cast("string"), F.lit(got.counts["n_good"]).cast("long")
    good = got.good.select(F.lit("good").alias("outcome"), F.col("nameOrig").alias("account"), F.col("step").cast("long").alias("step"),
                           "amount", F.length("nameOrig").cast("long").alias("n_account"), text.alias("line_account"),
                           number.alias("n_counted"))
    bad = got.bad.select(F.col("reason").alias("outcome"), text.alias("account"), F.lit(None).cast("long").alias("step"),
                         F.lit(None).cast("double").alias("amount"), F.lit(None).cast("long").alias("n_account"),
                         F.get(dl.split_fields("raw", None), F.lit(3)).alias("line_account"),
                         n[F.col("reason")].cast("long").alias("n_counted"))
    return good.unionByName(bad)


# ------------------------------------------------------------ A6, A7, G4

@query("mixed_record_router", with_(["ta", "net"], f"""
select 'paysim' as layout, cast(step as double) as step, account, amount from ta
union all
select 'banksim_tx', cast(step as double), customer, amount from tb
union all
select 'banksim_net', cast(null as double), Source, Weight from net"""))
def mixed_record_router(spark, d):
    paths = [write_paysim_csv(spark, d), write_banksim_csv(spark, d), write_network_csv(spark, d)]
    tagged = dl.tag_records(dl.read_lines(spark, paths), dl.default_layouts())
    return tagged.filter(~F.col("malformed")).select(
        "layout", F.coalesce(F.col("paysim.step").cast("double"), "banksim_tx.step").alias("step"),
        F.coalesce("paysim.nameOrig", "banksim_tx.customer", "banksim_net.Source").alias("account"),
        F.coalesce("paysim.amount", "banksim_tx.amount", "banksim_net.Weight").alias("amount"))


def write_apostrophes(spark, d) -> str:
    """Two layouts in one folder, with apostrophes inside fields: plain
    ones in PaySim lines, escaped ones in the quoted fields of network lines,
    which hold a comma too."""
    path = scratch_path(spark, "apostrophes")
    t, n = fx.ta(spark, d), fx.net(spark, d)
    mark = F.when(F.col("tx_id") % 3 == 0, F.lit("O'")).when(F.col("tx_id") % 3 == 1, F.lit("x'y'")).otherwise(F.lit(""))
    money = F.col("amount").cast("string")
    pay = F.concat_ws(",", F.col("step").cast("string"), "type", money, F.concat(mark, F.col("account")), money, money,
                      F.concat(F.col("counterparty"), mark), money, money, F.col("is_fraud").cast("string"), F.lit("0"))
    q = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    net = F.concat_ws(",", q(F.concat(F.lit("d\\'A, "), F.col("Source"))), q(F.col("Target")), q(F.col("Weight").cast("string")),
                      q(F.col("typeTrans")), q(F.col("fraud").cast("string")))
    t.select(pay.alias("value")).unionByName(n.select(net.alias("value"))).write.mode("overwrite").text(path)
    return path


_MARK = "case when tx_id % 3 = 0 then 'O' || chr(39) when tx_id % 3 = 1 then 'x' || chr(39) || 'y' || chr(39) else '' end"


@query("router_apostrophes", with_(["ta", "net"], f"""
select 'paysim' as layout, {_MARK} || account as account, counterparty || {_MARK} as counterparty, amount from ta
union all
select 'banksim_net', 'd' || chr(39) || 'A, ' || Source, Target, Weight from net"""))
def router_apostrophes(spark, d):
    tagged = dl.tag_records(dl.read_lines(spark, write_apostrophes(spark, d)), dl.default_layouts())
    return tagged.filter(~F.col("malformed")).select(
        "layout", F.coalesce("paysim.nameOrig", "banksim_net.Source").alias("account"),
        F.coalesce("paysim.nameDest", "banksim_net.Target").alias("counterparty"),
        F.coalesce("paysim.amount", "banksim_net.Weight").alias("amount"))


# Sources named like header fields, and damaged records, per input file.
_ODD_NET = """select case when line_id % 5 = 0 then 'step' when line_id % 7 = 0 then 'source' else Source end as Source,
       Target, Weight, typeTrans, fraud, line_id from net"""


def write_odd_network(spark, d) -> str:
    path = scratch_path(spark, "odd_network")
    e = fx.net(spark, d)
    q = lambda c: F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'"))
    src = (F.when(F.col("line_id") % 5 == 0, "step").when(F.col("line_id") % 7 == 0, "source")
           .otherwise(F.col("Source")))
    full = F.concat_ws(",", F.concat(F.lit("'"), src, F.lit("'")), q("Target"), q("Weight"), q("typeTrans"), q("fraud"))
    line = F.when(F.col("line_id") % 11 == 0, F.concat_ws(",", q("Source"), q("Target"))).otherwise(full)
    e.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


@query("network_odd_sources", with_("net", f"""
select Source, Target, Weight, typeTrans, fraud from ({_ODD_NET}) where line_id % 11 <> 0"""))
def network_odd_sources(spark, d):
    return dl.read_banksim_net(spark, write_odd_network(spark, d))


@query("ingest_accounting", with_(["ta", "net"], f"""
select 'paysim' as source, cast(count_if({_DAMAGE} is null) as bigint) as n_good,
       cast(count_if({_DAMAGE} is not null) as bigint) as n_dropped,
       cast(count_if({_DAMAGE} = 'too_few_fields') as bigint) as too_few_fields,
       cast(count_if({_DAMAGE} = 'too_many_fields') as bigint) as too_many_fields,
       cast(count_if({_DAMAGE} = 'bad_value') as bigint) as bad_value from ta
union all
select 'banksim_net', cast(count_if(line_id % 11 <> 0) as bigint), cast(count_if(line_id % 11 = 0) as bigint),
       cast(count_if(line_id % 11 = 0) as bigint), 0, 0 from net"""))
def ingest_accounting(spark, d):
    from ..schemas import BANKSIM_NET, PAYSIM
    parts = [dl.ingest_counts(spark, write_damaged(spark, d), PAYSIM).select(F.lit("paysim").alias("source"), "*"),
             dl.ingest_counts(spark, write_odd_network(spark, d), BANKSIM_NET, quote="'").select(
                 F.lit("banksim_net").alias("source"), "*")]
    return wl.union_all(parts)


# ------------------------------------------------------------ A8, A13

@query("union_available_sources", with_("ta", _W1_TA))
def union_available_sources(spark, d):
    from ..schemas import PAYSIM_LAYOUT
    present_path = write_paysim_csv(spark, d)
    missing_path = scratch_path(spark, "absent_banksim_csv")
    frames = dl.load_available(spark, [present_path, missing_path], dl.read_paysim)
    return present(wl.workload1([(f, PAYSIM_LAYOUT) for f in frames]), W1_ROUND)


@query("workload_row_counts", with_(["ta", "net"], """
select 'WL1_aggregation' as workload, cast(count(*) as bigint) as output_rows from (
    select account, trunc(step / 24), "type" from ta where step is not null and account is not null group by all
    union all
    select customer, step, category from tb where step is not null and customer is not null group by all)
union all
select 'WL2_fraud', cast(count(*) as bigint) from (
    select step from ta where step is not null and amount is not null
    union all select step from tb where step is not null and amount is not null)
union all
select 'WL3_join_window', cast(count(*) as bigint) from (
    select step from ta where step is not null and amount is not null
    union all select step from tb where step is not null and amount is not null)"""))
def workload_row_counts(spark, d):
    # the three workloads read the facts nine times: their source joins run once
    tb = sinks.stored(fx.tb(spark, d).drop("line_id", "part_id"), scratch_path(spark, "tb"))
    a, b = (fx.ta(spark, d), fx.TA_LAYOUT), (tb, fx.TB_LAYOUT)
    outs = {"WL1_aggregation": wl.workload1([a, b]),
            "WL2_fraud": wl.workload2([a, b]),
            "WL3_join_window": wl.workload3(hourly=a, daily=b, edges=fx.net_of(tb, ()))}
    # counted on a write of all columns: nothing of a workload is pruned away
    counted = [(k, sinks.write_counted(o, scratch_path(spark, k), fmt="noop")) for k, o in outs.items()]
    return spark.createDataFrame(counted, "workload string, output_rows long")


# ------------------------------------------------------------ W2 and W3 over the delimited files

def _csv_sources(spark, d):
    from ..schemas import BANKSIM_LAYOUT, PAYSIM_LAYOUT
    return ((dl.read_paysim(spark, write_paysim_csv(spark, d)), PAYSIM_LAYOUT),
            (dl.read_banksim_tx(spark, write_banksim_csv(spark, d)), BANKSIM_LAYOUT))


@query("union_fraud_csv", ORACLE["union_fraud"])
def union_fraud_csv(spark, d):
    return present(wl.workload2(list(_csv_sources(spark, d))), {"amount_z_score": FINE})


@query("union_enriched_csv", ORACLE["union_enriched"])
def union_enriched_csv(spark, d):
    # every line is parsed once, though a workload reads its facts several times
    pay, bank = [(sinks.stored(df.select(lay.account, lay.step, lay.type, lay.amount, lay.label, lay.counterparty),
                               scratch_path(spark, lay.dataset)), lay) for df, lay in _csv_sources(spark, d)]
    net = dl.read_banksim_net(spark, write_network_csv(spark, d))
    out = wl.workload3(hourly=pay, daily=bank, edges=net, network_key="Target")
    return present(out, W3_ROUND)


# ------------------------------------------------------------ A10

@query("formatted_export", with_("ta", """
select concat_ws(',', 'PAYSIM', account, cast(trunc(step / 24) as bigint), "type",
                 printf('%.2f', sum(amount)), count(*)) as line
  from ta where step is not null and account is not null
 group by account, trunc(step / 24), "type" """))
def formatted_export(spark, d):
    out = wl.workload1([(fx.ta(spark, d), fx.TA_LAYOUT)])
    return sinks.format_lines(out, [("dataset", None), ("account", None), ("day", None),
                                    ("type", None), ("total_amount", 2), ("tx_count", None)])


# ------------------------------------------------------------ B18-B20

def raw_text_fields(spark, d) -> DataFrame:
    """Quoted, padded and partly unparseable text fields built from ``ta``."""
    t = fx.ta(spark, d)
    q = F.lit("'")
    return t.select(
        "tx_id",
        F.concat(F.lit("  "), q, F.col("account"), q, F.lit(" ")).alias("raw_account"),
        F.when(F.col("tx_id") % 13 == 0, F.lit("n/a"))
         .otherwise(F.concat(q, F.col("amount").cast("string"), q)).alias("raw_amount"),
        F.when(F.col("tx_id") % 17 == 0, F.concat(F.col("step").cast("string"), F.lit(".5")))
         .when(F.col("tx_id") % 19 == 0, F.concat(F.lit("-"), F.col("step").cast("string")))
         .otherwise(F.col("step").cast("string")).alias("raw_step"),
        F.when(F.col("tx_id") % 23 == 0, F.lit("1.0"))
         .otherwise(F.col("is_fraud").cast("string")).alias("raw_label"))


@query("clean_text_fields", with_("ta", """
select tx_id, trim(trim(raw_account), '''') as account,
       coalesce(try_cast(trim(trim(raw_amount), '''') as double), 0.0) as amount,
       try_cast(trim(trim(raw_amount), '''') as double) is not null as amount_ok,
       regexp_matches(raw_step, '^-*[0-9]+$') as step_is_int,
       regexp_matches(replace(raw_step, '.', ''), '^-*[0-9]+$') as step_is_number,
       case when regexp_matches(raw_step, '^-*[0-9]+$') then try_cast(raw_step as bigint) end as step,
       cast(cast(try_cast(raw_label as double) as bigint) as integer) as label
  from (select tx_id, '  ''' || account || ''' ' as raw_account,
               case when tx_id % 13 = 0 then 'n/a' else '''' || cast(amount as varchar) || '''' end as raw_amount,
               case when tx_id % 17 = 0 then cast(step as varchar) || '.5'
                    when tx_id % 19 = 0 then '-' || cast(step as varchar)
                    else cast(step as varchar) end as raw_step,
               case when tx_id % 23 = 0 then '1.0' else cast(is_fraud as varchar) end as raw_label
          from ta)"""))
def clean_text_fields(spark, d):
    raw = raw_text_fields(spark, d)
    return raw.select(
        "tx_id", C.strip_quotes("raw_account").alias("account"),
        C.tolerant_double(C.strip_quotes("raw_amount"), 0.0).alias("amount"),
        C.tolerant_double(C.strip_quotes("raw_amount")).isNotNull().alias("amount_ok"),
        C.is_integer_text("raw_step").alias("step_is_int"),
        C.is_decimal_text("raw_step").alias("step_is_number"),
        F.when(C.is_integer_text("raw_step"), F.col("raw_step").try_cast("long")).alias("step"),
        C.tolerant_int_label("raw_label").alias("label"))

