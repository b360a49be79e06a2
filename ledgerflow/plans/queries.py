"""Registered queries: one per operator row of the inventory, each a
``(spark, sf_dir) -> DataFrame`` over the whole driver tables, plus the
DuckDB text that computes the same rows.

Doubles whose last bits depend on summation order are presented with
``round_half_up`` (same formula on both sides); operators themselves keep
full precision.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.columns import day_bucket, hour_of_day
from ..operators import aggregate as agg
from ..operators import enrich as en
from ..operators import windows as win
from . import workloads as wl
from .oracle import r, with_, z

from .registry import FINE, MONEY, ORACLE, QUERIES, present, query  # noqa: F401

W1_ROUND = {"total_amount": MONEY, "avg_amount": FINE}
DIM_ROUND = {"total_received_amount": MONEY, "avg_received_amount": FINE}


def _ta(spark, d):
    return fx.ta(spark, d), fx.TA_LAYOUT


def _tb(spark, d):
    return fx.tb(spark, d), fx.TB_LAYOUT


# ------------------------------------------------------------------ W1 / C

_C1_SQL_BODY = """select {acct} as account, {day} as day, {typ} as "type",
       {sum_} as total_amount, count(*) as tx_count, {avg_} as avg_amount,
       max(amount) as max_amount, cast(count_if({lab} = 1) as bigint) as fraud_count
  from {src} where step is not null and {acct} is not null
 group by all"""


def _c1_sql(src, acct, day, typ, lab, dataset=None):
    body = _C1_SQL_BODY.format(acct=acct, day=day, typ=typ, lab=lab, src=src,
                               sum_=r("sum(amount)", MONEY), avg_=r("avg(amount)", FINE))
    if dataset:
        body = body.replace("select ", f"select '{dataset}' as dataset, ", 1)
    return body


_TA_DAY = "cast(trunc(step / 24) as bigint)"
_TB_DAY = "cast(step as bigint)"


@query("daily_agg_hourly", with_("ta", _c1_sql("ta", "account", _TA_DAY, '"type"', "is_fraud")))
def daily_agg_hourly(spark, d):
    df, lay = _ta(spark, d)
    out = agg.daily_agg(df, lay.account, lay.step, lay.type, lay.amount, lay.label, 24)
    return present(out, W1_ROUND)


@query("daily_agg_daily", with_("tb", _c1_sql("tb", "customer", _TB_DAY, "category", "fraud")))
def daily_agg_daily(spark, d):
    df, lay = _tb(spark, d)
    out = agg.daily_agg(df, lay.account, lay.step, lay.type, lay.amount, lay.label, 1)
    return present(out, W1_ROUND)


@query("step_agg_hourly", with_("ta", """
select account, step, "type", round(sum(amount), 2) as total_amount, count(*) as tx_count
  from ta where step is not null and account is not null group by 1, 2, 3"""))
def step_agg_hourly(spark, d):
    df, lay = _ta(spark, d)
    return agg.step_agg(df, lay.account, lay.step, lay.type, lay.amount, 2)


@query("union_daily", with_(["ta", "tb"],
       _c1_sql("ta", "account", _TA_DAY, '"type"', "is_fraud", "PAYSIM")
       + "\nunion all\n"
       + _c1_sql("tb", "customer", _TB_DAY, "category", "fraud", "BANKSIM")))
def union_daily(spark, d):
    return present(wl.workload1([_ta(spark, d), _tb(spark, d)]), W1_ROUND)


@query("time_buckets", with_(["ta", "tb"], f"""
select 'PAYSIM' as dataset, step, {_TA_DAY} as day, ((step % 24) + 24) % 24 as hour_of_day from ta
union all
select 'BANKSIM' as dataset, step, {_TB_DAY} as day, ((step % 24) + 24) % 24 as hour_of_day from tb"""))
def time_buckets(spark, d):
    a = fx.ta(spark, d).select(F.lit("PAYSIM").alias("dataset"), "step",
                               day_bucket("step", 24).alias("day"),
                               hour_of_day("step").alias("hour_of_day"))
    b = fx.tb(spark, d).select(F.lit("BANKSIM").alias("dataset"), "step",
                               day_bucket("step", 1).alias("day"),
                               hour_of_day("step").alias("hour_of_day"))
    return a.unionByName(b)


def _ta_with_nulls(spark, d):
    t = fx.ta(spark, d)
    return t.select(
        "tx_id",
        F.when(F.col("tx_id") % 11 == 0, F.lit(None)).otherwise(F.col("step")).alias("step"),
        F.when(F.col("tx_id") % 7 == 0, F.lit(None)).otherwise(F.col("account")).alias("account"),
        F.when(F.col("tx_id") % 13 == 0, F.lit(None)).otherwise(F.col("amount")).alias("amount"))


@query("filter_required", with_("ta", """
select tx_id, step, account, amount,
       (step is not null and amount is not null) as passes_step_amount
  from (select tx_id,
               case when tx_id % 11 = 0 then null else step end as step,
               case when tx_id % 7 = 0 then null else account end as account,
               case when tx_id % 13 = 0 then null else amount end as amount
          from ta)
 where step is not null and account is not null"""))
def filter_required(spark, d):
    t = _ta_with_nulls(spark, d)
    kept = agg.require(t, "step", "account")
    return kept.withColumn("passes_step_amount",
                           F.col("step").isNotNull() & F.col("amount").isNotNull())


# ------------------------------------------------------------------ W2

@query("velocity_flag", with_("ta", """
select tx_id, account, hour_bucket, account || '_' || hour_bucket as account_hour,
       hourly_tx_count, hourly_tx_count >= 5 as velocity_flag
  from (select *, count(*) over (partition by account, hour_bucket) as hourly_tx_count
          from (select tx_id, account, ((step % 24) + 24) % 24 as hour_bucket
                  from ta where step is not null and amount is not null))"""))
def velocity_flag(spark, d):
    df, lay = _ta(spark, d)
    src = agg.require(df, lay.step, lay.amount).select("tx_id", "account", "step")
    v = win.velocity_count(src, "account", "step")
    return v.select("tx_id", "account", "hour_bucket",
                    F.concat_ws("_", "account", F.col("hour_bucket").cast("string"))
                    .alias("account_hour"),
                    "hourly_tx_count", (F.col("hourly_tx_count") >= 5).alias("velocity_flag"))


_ZSTATS = "(select avg(ln(1 + amount)) as m, stddev_samp(ln(1 + amount)) as s from {src} where step is not null and amount is not null)"


@query("amount_zscore", with_("ta", f"""
select tx_id, {r('l', FINE)} as log_amount, {r('zz', FINE)} as amount_z_score,
       zz > 1.5 as amount_flag_15, zz > 2.5 as amount_flag_25
  from (select tx_id, l, {z('l', 'm', 's')} as zz
          from (select tx_id, ln(1 + amount) as l from ta
                 where step is not null and amount is not null)
          cross join {_ZSTATS.format(src='ta')})"""))
def amount_zscore(spark, d):
    df, lay = _ta(spark, d)
    f = wl.fraud_flags(df, lay, z_threshold=1.5)
    out = f.select("tx_id", "log_amount", "amount_z_score",
                   (F.col("amount_z_score") > 1.5).alias("amount_flag_15"),
                   (F.col("amount_z_score") > 2.5).alias("amount_flag_25"))
    return present(out, {"log_amount": FINE, "amount_z_score": FINE})


_POOLED_LOG = "case when amount > 0 then ln(1 + amount) else 0.0 end"


@query("amount_zscore_population", with_(["ta", "tb"], f"""
select dataset, step, account, amount, {r('zz', FINE)} as amount_z_score, zz > 0.5 as amount_flag_05
  from (select dataset, step, account, amount, {z('l', 'm', 's')} as zz
          from (select 'PAYSIM' as dataset, step, account, amount, {_POOLED_LOG} as l
                  from ta where step is not null and amount is not null
                union all
                select 'BANKSIM', step, customer, amount, {_POOLED_LOG}
                  from tb where step is not null and amount is not null) u
          cross join (select avg(l) as m, stddev_pop(l) as s from (
                select {_POOLED_LOG} as l from ta where step is not null and amount is not null
                union all
                select {_POOLED_LOG} from tb where step is not null and amount is not null)))"""))
def amount_zscore_population(spark, d):
    sources = [_ta(spark, d), _tb(spark, d)]
    stats = wl.pooled_log_stats(sources, ddof=0, clamp_nonpositive=True)
    parts = []
    for df, lay in sources:
        f = wl.fraud_flags(df, lay, z_threshold=0.5, clamp_nonpositive=True, stats=stats)
        parts.append(f.select(F.lit(lay.dataset).alias("dataset"), F.col(lay.step).alias("step"),
                              F.col(lay.account).alias("account"), F.col(lay.amount).alias("amount"),
                              "amount_z_score", F.col("amount_flag").alias("amount_flag_05")))
    return present(wl.union_all(parts), {"amount_z_score": FINE})


def _w2_sql(dataset, thr, src="p", vel=5):
    return f"""select '{dataset}' as dataset, account, cast(step as bigint) as step, "type", amount,
       hourly_tx_count, {r('zz', FINE)} as amount_z_score,
       hourly_tx_count >= {vel} as velocity_flag, zz > {thr} as amount_flag,
       case when hourly_tx_count >= {vel} or zz > {thr} then 1 else 0 end as fraud_proxy,
       isFraud
  from (select *, {z('l', 'm', 's')} as zz from (
          select *, count(*) over (partition by account, ((step % 24) + 24) % 24) as hourly_tx_count
            from {src}) cross join (select avg(l) as m, stddev_samp(l) as s from {src}))"""


def _w2_src(src, acct, typ, lab, log="ln(1 + amount)"):
    return (f"select step, {acct} as account, {typ} as \"type\", amount, {lab} as isFraud, "
            f"{log} as l from {src} where step is not null and amount is not null")


@query("fraud_proxy", with_("ta", _w2_sql("PAYSIM", 1.5),
                            extra={"p": _w2_src("ta", "account", '"type"', "is_fraud")}))
def fraud_proxy(spark, d):
    return present(wl.workload2([_ta(spark, d)], z_threshold=1.5), {"amount_z_score": FINE})


@query("fraud_proxy_day", with_("tb", _w2_sql("BANKSIM", 2.5),
                                extra={"p": _w2_src("tb", "customer", "category", "fraud")}))
def fraud_proxy_day(spark, d):
    return present(wl.workload2([_tb(spark, d)]), {"amount_z_score": FINE})


@query("union_fraud", with_(["ta", "tb"],
       _w2_sql("PAYSIM", 2.5, "pa") + "\nunion all\n" + _w2_sql("BANKSIM", 2.5, "pb"),
       extra={"pa": _w2_src("ta", "account", '"type"', "is_fraud"),
              "pb": _w2_src("tb", "customer", "category", "fraud")}))
def union_fraud(spark, d):
    return present(wl.workload2([_ta(spark, d), _tb(spark, d)]), {"amount_z_score": FINE})


_POOLED_STATS = "(select avg(l) as m, stddev_pop(l) as s from (select l from pa union all select l from pb))"


def _pooled_sql(dataset, src):
    return f"""select '{dataset}' as dataset, account, step, "type", printf('%.2f', amount) as amount,
       hourly_tx_count, printf('%.4f', zz) as amount_z_score,
       case when hourly_tx_count >= 5 or zz > 0.5 then 1 else 0 end as fraud_proxy, isFraud
  from (select *, {z('l', 'm', 's')} as zz from (
          select *, count(*) over (partition by account, ((step % 24) + 24) % 24) as hourly_tx_count
            from {src}) cross join {_POOLED_STATS})"""


@query("fraud_proxy_pooled", with_(["ta", "tb"],
       _pooled_sql("PAYSIM", "pa") + "\nunion all\n" + _pooled_sql("BANKSIM", "pb"),
       extra={"pa": _w2_src("ta", "account", '"type"', "is_fraud", _POOLED_LOG),
              "pb": _w2_src("tb", "customer", "category", "fraud", _POOLED_LOG)}))
def fraud_proxy_pooled(spark, d):
    return wl.workload2_pooled([_ta(spark, d), _tb(spark, d)], z_threshold=0.5)


def _pr_sql(dataset, src, thr):
    return f"""select '{dataset}' as dataset, cast({thr} as double) as z_threshold,
       cast(count_if(fp = 1) as bigint) as total_flagged,
       cast(count_if(fp = 1 and isFraud = 1) as bigint) as true_positives,
       cast(count_if(isFraud = 1) as bigint) as total_actual
  from (select isFraud, case when hourly_tx_count >= 5 or {z('l', 'm', 's')} > {thr} then 1 else 0 end as fp
          from (select *, count(*) over (partition by account, ((step % 24) + 24) % 24) as hourly_tx_count
                  from {src}) cross join (select avg(l) as m, stddev_samp(l) as s from {src}))"""


_PR_PARTS = [("PAYSIM", "pa", 1.5), ("PAYSIM", "pa", 2.5), ("BANKSIM", "pb", 1.5), ("BANKSIM", "pb", 2.5)]


@query("proxy_precision_recall", with_(["ta", "tb"], f"""
select *, {r("case when total_flagged > 0 then true_positives / total_flagged else 0.0 end", FINE)} as precision,
          {r("case when total_actual > 0 then true_positives / total_actual else 0.0 end", FINE)} as recall
  from (""" + "\nunion all\n".join(_pr_sql(ds, s, t) for ds, s, t in _PR_PARTS) + ")",
       extra={"pa": _w2_src("ta", "account", '"type"', "is_fraud"),
              "pb": _w2_src("tb", "customer", "category", "fraud")}))
def proxy_precision_recall(spark, d):
    out = wl.workload2_scores([_ta(spark, d), _tb(spark, d)], z_thresholds=(1.5, 2.5))
    return present(out.select("dataset", "z_threshold", "total_flagged", "true_positives",
                              "total_actual", "precision", "recall"),
                   {"precision": FINE, "recall": FINE})


# ------------------------------------------------------------------ W3 / E / D

def _dim_sql(src, key, amount, label):
    return f"""select {key} as dim_account, count(*) as total_received_tx,
       {r(f'sum({amount})', MONEY)} as total_received_amount,
       {r(f'avg({amount})', FINE)} as avg_received_amount,
       cast(count_if({label} = 1) as bigint) as fraud_received_count
  from {src} where {key} is not null group by 1"""


@query("dim_counterparty", with_("ta", _dim_sql(
    "(select * from ta where step is not null and amount is not null)", "counterparty", "amount", "is_fraud")))
def dim_counterparty(spark, d):
    df, lay = _ta(spark, d)
    return present(wl.counterparty_dimension(df, lay), DIM_ROUND)


def _dim_raw_sql(src, key, amount, label):
    return f"""select {key} as dim_account, count(*) as total_received_tx,
       sum({amount}) as total_received_amount, avg({amount}) as avg_received_amount,
       cast(count_if({label} = 1) as bigint) as fraud_received_count
  from {src} where {key} is not null group by 1"""


@query("enrich_counterparty", with_("ta", f"""
select tx_id, account, counterparty, amount, total_received_tx,
       {r('total_received_amount', MONEY)} as total_received_amount,
       {r('avg_received_amount', FINE)} as avg_received_amount, fraud_received_count
  from f left join dim on f.counterparty = dim.dim_account""",
    extra={"f": "select * from ta where step is not null and amount is not null",
           "dim": _dim_raw_sql("f", "counterparty", "amount", "is_fraud")}))
def enrich_counterparty(spark, d):
    df, lay = _ta(spark, d)
    src = agg.require(df, lay.step, lay.amount)
    dim = agg.build_dimension(src, lay.counterparty, lay.amount, lay.label)
    out = en.enrich(src, dim, lay.counterparty).select(
        "tx_id", "account", "counterparty", "amount", "total_received_tx",
        "total_received_amount", "avg_received_amount", "fraud_received_count")
    return present(out, DIM_ROUND)


@query("dim_network", with_("net", _dim_sql("net", "Target", "Weight", "fraud")))
def dim_network(spark, d):
    return present(en.network_dimension(fx.net(spark, d), key="Target"), DIM_ROUND)


@query("dim_network_source", with_("net", _dim_sql("net", "Source", "Weight", "fraud")))
def dim_network_source(spark, d):
    return present(en.network_dimension(fx.net(spark, d), key="Source"), DIM_ROUND)


def _enrich_net_sql(key):
    return with_("net", f"""
select line_id, part_id, f.step, customer, merchant, amount, total_received_tx,
       {r('total_received_amount', MONEY)} as total_received_amount,
       {r('avg_received_amount', FINE)} as avg_received_amount, fraud_received_count
  from (select * from tb where step is not null and amount is not null) f
  left join dim on f.merchant = dim.dim_account""",
                 extra={"dim": _dim_raw_sql("net", key, "Weight", "fraud")})


def _enrich_net(spark, d, key):
    df, lay = _tb(spark, d)
    src = agg.require(df, lay.step, lay.amount)
    dim = en.network_dimension(fx.net(spark, d), key=key)
    out = en.enrich(src, dim, lay.counterparty).select(
        "line_id", "part_id", "step", "customer", "merchant", "amount", "total_received_tx",
        "total_received_amount", "avg_received_amount", "fraud_received_count")
    return present(out, DIM_ROUND)


@query("enrich_network", _enrich_net_sql("Target"))
def enrich_network(spark, d):
    return _enrich_net(spark, d, "Target")


@query("enrich_network_source", _enrich_net_sql("Source"))
def enrich_network_source(spark, d):
    return _enrich_net(spark, d, "Source")


_LATEST_EDGE = """select Source, Target, typeTrans, Weight from (
    select *, row_number() over (partition by Source, Target
                                 order by step desc, line_id desc, part_id desc, Weight desc) as rn
      from net) where rn = 1"""


@query("enrich_pair_lookup", with_("net", """
select line_id, part_id, f.step, customer, merchant, amount,
       coalesce(e.typeTrans, 'NONE') as dim_type, coalesce(e.Weight, 0.0) as dim_weight
  from (select * from tb where step is not null and amount is not null) f
  left join e on f.customer = e.Source and f.merchant = e.Target""", extra={"e": _LATEST_EDGE}))
def enrich_pair_lookup(spark, d):
    df, lay = _tb(spark, d)
    src = agg.require(df, lay.step, lay.amount).select(
        "line_id", "part_id", "step", "customer", "merchant", "amount")
    return en.enrich_pair(src, fx.net(spark, d), "customer", "merchant",
                          order=fx.NET_EDGE_ORDER)


_ROLL_ROUND = {"rolling_24h_sum": MONEY}


def _roll_sql(cols, acct, order, src, with_max=True):
    mx = f", max(amount) over w as rolling_24h_max" if with_max else ""
    return f"""select {cols}, {r('sum(amount) over w', MONEY)} as rolling_24h_sum,
       count(*) over w as rolling_24h_count{mx}
  from {src} where step is not null and amount is not null
window w as (partition by {acct} order by {order} range between 24 preceding and current row)"""


@query("rolling_24_step", with_("ta", _roll_sql("tx_id, account, step, amount", "account", "step", "ta")))
def rolling_24_step(spark, d):
    df, lay = _ta(spark, d)
    src = agg.require(df, lay.step, lay.amount).select("tx_id", "account", "step", "amount")
    return present(win.rolling(src, ["account"], "step", "amount"), _ROLL_ROUND)


@query("rolling_24_day", with_("tb", _roll_sql("line_id, part_id, step, customer, amount",
                                               "customer", "cast(step as bigint)", "tb")))
def rolling_24_day(spark, d):
    df, lay = _tb(spark, d)
    src = agg.require(df, lay.step, lay.amount).select("line_id", "part_id", "step", "customer", "amount")
    return present(win.rolling(src, ["customer"], "step", "amount", order_type="long"), _ROLL_ROUND)


@query("rolling_24_fractional", with_("ta_frac", _roll_sql("tx_id, account, step, amount", "account",
                                                           "step", "ta_frac", with_max=False)))
def rolling_24_fractional(spark, d):
    src = agg.require(fx.ta_fractional(spark, d), "step", "amount").select(
        "tx_id", "account", "step", "amount")
    out = win.rolling(src, ["account"], "step", "amount", order_type="double",
                      measures=("sum", "count"))
    return present(out, _ROLL_ROUND)


@query("rolling_24_one_account", with_("ta", f"""
select tx_id, step + tx_id % 1000 / 1000.0::double as step, amount, {r('sum(amount) over w', MONEY)} as rolling_24h_sum,
       count(*) over w as rolling_24h_count, max(amount) over w as rolling_24h_max
  from ta where step is not null and amount is not null
window w as (order by step + tx_id % 1000 / 1000.0::double range between 24 preceding and current row)"""))
def rolling_24_one_account(spark, d):
    """All transactions as one account's, with fractional steps: the trailing
    window is split inside the account and inside a window length."""
    src = agg.require(fx.ta(spark, d), "step", "amount").select(
        "tx_id", (F.col("step") + F.col("tx_id") % 1000 / F.lit(1000.0)).alias("step"), "amount", F.lit("all").alias("account"))
    out = win.rolling(src, ["account"], "step", "amount", order_type="double")
    return present(out.drop("account"), {"rolling_24h_sum": MONEY})


_W3_ROUND = {"rolling_24h_sum": MONEY, "total_received_amount": MONEY}


@query("union_enriched", with_(["ta", "net"], f"""
select 'PAYSIM' as dataset, account, step, "type", amount,
       {r('sum(amount) over w', MONEY)} as rolling_24h_sum, count(*) over w as rolling_24h_count,
       max(amount) over w as rolling_24h_max, total_received_tx,
       {r('total_received_amount', MONEY)} as total_received_amount, fraud_received_count,
       is_fraud as isFraud
  from fa left join da on fa.counterparty = da.dim_account
window w as (partition by account order by step range between 24 preceding and current row)
union all
select 'BANKSIM', customer, cast(step as bigint), category, amount,
       {r('sum(amount) over w', MONEY)}, count(*) over w, max(amount) over w, total_received_tx,
       {r('total_received_amount', MONEY)}, fraud_received_count, fraud
  from fb left join db on fb.merchant = db.dim_account
window w as (partition by customer order by cast(step as bigint) range between 24 preceding and current row)""",
    extra={"fa": "select * from ta where step is not null and amount is not null",
           "da": _dim_raw_sql("fa", "counterparty", "amount", "is_fraud"),
           "fb": "select * from tb where step is not null and amount is not null",
           "db": _dim_raw_sql("net", "Target", "Weight", "fraud")}))
def union_enriched(spark, d):
    out = wl.workload3(hourly=_ta(spark, d), daily=_tb(spark, d), edges=fx.net(spark, d),
                       network_key="Target")
    return present(out, _W3_ROUND)


@query("enriched_pair_rolling", with_("net", f"""
select customer as account, 'BANKSIM' as dataset, cast(step as double) as step, category as "type",
       printf('%.2f', amount) as amount, printf('%.2f', sum(amount) over w) as rolling_24h_sum,
       count(*) over w as rolling_24h_count, merchant as counterparty,
       coalesce(e.typeTrans, 'NONE') as dim_type, coalesce(e.Weight, 0.0) as dim_weight,
       fraud as isFraud
  from (select * from tb where step is not null and amount is not null) f
  left join e on f.customer = e.Source and f.merchant = e.Target
window w as (partition by customer order by cast(step as double) range between 24 preceding and current row)""",
    extra={"e": _LATEST_EDGE}))
def enriched_pair_rolling(spark, d):
    df, lay = _tb(spark, d)
    return wl.workload3_pair(df, lay, fx.net(spark, d), fx.NET_EDGE_ORDER)


@query("velocity_flag_pooled", with_(["ta", "tb"], """
select dataset, account, hour_bucket, hourly_tx_count, hourly_tx_count >= 5 as velocity_flag
  from (select *, count(*) over (partition by account, hour_bucket) as hourly_tx_count
          from (select 'PAYSIM' as dataset, account, ((step % 24) + 24) % 24 as hour_bucket
                  from ta where step is not null and amount is not null
                union all
                select 'BANKSIM', customer, ((step % 24) + 24) % 24
                  from tb where step is not null and amount is not null))"""))
def velocity_flag_pooled(spark, d):
    """Velocity buckets shared by both sources (an account id seen in both
    datasets counts its rows together) - the alternative to per-dataset
    buckets."""
    parts = []
    for df, lay in (_ta(spark, d), _tb(spark, d)):
        parts.append(agg.require(df, lay.step, lay.amount).select(
            F.lit(lay.dataset).alias("dataset"), F.col(lay.account).alias("account"),
            F.col(lay.step).alias("step")))
    v = win.velocity_count(wl.union_all(parts), "account", "step")
    return v.select("dataset", "account", "hour_bucket", "hourly_tx_count",
                    (F.col("hourly_tx_count") >= 5).alias("velocity_flag"))


@query("rolling_24_step_emit", with_("ta", "select * from (" + _roll_sql(
    "tx_id, account, step, amount", "account", "step", "ta") + ") where step >= 300"))
def rolling_24_step_emit(spark, d):
    """Trailing window emitted from step 300 on; only steps >= 276 are read."""
    df, lay = _ta(spark, d)
    src = agg.require(df, lay.step, lay.amount).select("tx_id", "account", "step", "amount")
    return present(win.rolling(src, ["account"], "step", "amount", emit_from=300), _ROLL_ROUND)
