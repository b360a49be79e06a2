"""Registered queries for data quality, sampling, sample-series summaries and
run-result analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import aggregate as agg
from ..operators import quality as qa
from ..operators import runs as rn
from ..operators import sampling as smp
from ..operators.prefix import exact_quantiles, skyline
from ..schemas import BANKSIM_NET, BANKSIM_TX, PAYSIM
from ..session import scratch_path
from ..sources import delimited as dl
from ..sources import sinks
from .oracle import r, with_
from .queries_io import write_banksim_csv, write_network_csv
from .registry import FINE, MONEY, present, query

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# ------------------------------------------------------------ A14, C10, C11, A12

@query("amount_summary", with_("ta", f"""
select count(amount) as count, {r('avg(amount)', FINE)} as mean,
       {r('stddev_samp(amount)', FINE)} as stddev, min(amount) as min,
       {r('quantile_cont(amount, 0.25)', FINE)} as p25, {r('quantile_cont(amount, 0.5)', FINE)} as p50,
       {r('quantile_cont(amount, 0.75)', FINE)} as p75, max(amount) as max
  from ta"""))
def amount_summary(spark, d):
    out = qa.numeric_summary(fx.ta(spark, d), "amount")
    return present(out, {c: FINE for c in ("mean", "stddev", "p25", "p50", "p75")})


def write_profile_csv(spark, d) -> str:
    """PaySim-layout CSV of ``ta`` with an unparseable or empty amount on some rows."""
    t = fx.ta(spark, d)
    amount_txt = (F.when(F.col("tx_id") % 97 == 0, F.lit("bad")).when(F.col("tx_id") % 89 == 0, F.lit(None))
                  .otherwise(F.col("amount").cast("string")))
    df = t.select("step", "type", amount_txt.alias("amount"), F.col("account").alias("nameOrig"),
                  (F.col("amount") * 3).alias("oldbalanceOrg"), (F.col("amount") * 2).alias("newbalanceOrig"),
                  F.col("counterparty").alias("nameDest"), (F.col("amount") * 4).alias("oldbalanceDest"),
                  (F.col("amount") * 5).alias("newbalanceDest"), F.col("is_fraud").alias("isFraud"),
                  F.when(F.col("amount") > 400, 1).otherwise(0).alias("isFlaggedFraud"))
    path = scratch_path(spark, "profile_csv")
    sinks.write_csv(df, path)
    return path


_GOOD_AMOUNT = "case when tx_id % 97 = 0 or tx_id % 89 = 0 then null else amount end"


@query("table_profile", with_("ta", f"""
select count(*) as row_count, cast(count_if(is_fraud = 1) as bigint) as fraud_count,
       {r('(cast(count_if(is_fraud = 1) as double) / count(*)) * 100', FINE)} as fraud_rate_pct,
       {r(f'sum({_GOOD_AMOUNT})', MONEY)} as amount_sum,
       {r(f'sum({_GOOD_AMOUNT}) / count(*)', FINE)} as avg_amount,
       cast(count_if(tx_id % 97 = 0 or tx_id % 89 = 0) as bigint) as parse_errors,
       11 as n_columns, 11 as expected_columns, true as column_count_ok
  from ta"""))
def table_profile(spark, d):
    path = write_profile_csv(spark, d)
    cols = qa.read_header(spark, path)
    out = qa.profile_text(dl.read_lines(spark, path), cols, expected=PAYSIM.fieldNames())
    return present(out, {"fraud_rate_pct": FINE, "amount_sum": MONEY, "avg_amount": FINE})


def _profile_sql(source: str, table: str, amount: str, n: int) -> str:
    total = f"sum({amount})" if amount else "0.0"
    return f"""select '{source}' as source, count(*) as row_count, cast(count_if(fraud = 1) as bigint) as fraud_count,
       {r('(cast(count_if(fraud = 1) as double) / count(*)) * 100', FINE)} as fraud_rate_pct,
       {r(total, MONEY)} as amount_sum, {r(f'{total} / count(*)', FINE)} as avg_amount, cast(0 as bigint) as parse_errors,
       {n} as n_columns, {n} as expected_columns, true as column_count_ok from {table}"""


@query("table_profile_quoted", with_("net", _profile_sql("banksim_tx", "tb", "amount", 10) + "\nunion all\n"
                                     + _profile_sql("banksim_net", "net", "", 5)))
def table_profile_quoted(spark, d):
    """Profiles of the two quoted layouts: label column ``fraud``; the network
    file has no amount."""
    parts = []
    for name, write, schema in (("banksim_tx", write_banksim_csv, BANKSIM_TX), ("banksim_net", write_network_csv, BANKSIM_NET)):
        path = write(spark, d)
        cols = qa.read_header(spark, path, quote="'")
        prof = qa.profile_text(dl.read_lines(spark, path), cols, expected=schema.fieldNames())
        parts.append(present(prof, {"fraud_rate_pct": FINE, "amount_sum": MONEY, "avg_amount": FINE})
                     .select(F.lit(name).alias("source"), "*"))
    return parts[0].unionByName(parts[1])


def _schema_check_sql(found: list[str], layouts: dict[str, list[str]]) -> str:
    fv = ", ".join(f"('{c}', {i})" for i, c in enumerate(found))
    parts = []
    for name, exp in layouts.items():
        ev = ", ".join(f"('{c}', {i})" for i, c in enumerate(exp))
        parts.append(f"""select '{name}' as expected_layout, coalesce(e.c, f.c) as "column",
       e.p as expected_position, f.p as found_position,
       case when f.p is null then 'missing' when e.p is null then 'unexpected'
            when f.p = e.p then 'ok' else 'moved' end as status
  from (select c, cast(p as integer) as p from (values {ev}) t(c, p)) e
  full outer join (select c, cast(p as integer) as p from (values {fv}) t(c, p)) f on e.c = f.c""")
    return "\nunion all\n".join(parts)


_LAYOUTS = {"paysim": PAYSIM.fieldNames(), "banksim_tx": BANKSIM_TX.fieldNames()}


@query("schema_check", _schema_check_sql(PAYSIM.fieldNames(), _LAYOUTS))
def schema_check(spark, d):
    lines = dl.read_lines(spark, write_profile_csv(spark, d))
    # the sink writes the same header into each of its files
    parts = [qa.header_check(lines, exp).drop("file").distinct().select(F.lit(name).alias("expected_layout"), "*")
             for name, exp in _LAYOUTS.items()]
    return parts[0].unionByName(parts[1])


_GOOD = ["r0", "r1", "r2", "r3", "r4"]


@query("header_check_files", """
with f as (select 'good' as file, 'r' || r_regionkey as "column", r_regionkey as p from region
           union all select 'turned', 'r' || r_regionkey, 4 - r_regionkey from region
           union all select 'renamed', case when r_regionkey = 0 then r_name else 'r' || r_regionkey end, r_regionkey
             from region),
e as (select file, 'r' || i as "column", i as p from (select distinct file from f) cross join range(0, 5) t(i))
select coalesce(e.file, f.file) as file, coalesce(e."column", f."column") as "column",
       cast(e.p as integer) as expected_position, cast(f.p as integer) as found_position,
       case when f.p is null then 'missing' when e.p is null then 'unexpected' when e.p = f.p then 'ok'
            else 'moved' end as status
  from e full outer join f on e.file = f.file and e."column" = f."column" """)
def header_check_files(spark, d):
    """Three folders of files that hold all transactions below their headers:
    the header as expected, in reverse order, and with the first column renamed
    to a region's name.  Some data rows read like headers on purpose."""
    root = scratch_path(spark, "headers")
    name = fx.table(spark, d, "region").where("r_regionkey = 0").select("r_name").first()[0]
    odd = F.col("tx_id") % 5
    rows = fx.ta(spark, d).select(*[F.when(odd == 0, F.lit(c)).otherwise(F.col("tx_id").cast("string")) for c in _GOOD])
    variants = {"good": _GOOD, "turned": _GOOD[::-1], "renamed": [name, *_GOOD[1:]]}
    for variant, names in variants.items():
        rows.toDF(*names).write.option("header", True).csv(f"{root}/{variant}")
    got = qa.header_check(dl.read_lines(spark, [f"{root}/{v}" for v in variants]), _GOOD)
    return got.withColumn("file", F.element_at(F.split("file", "/"), -2)).distinct()


_TYPE_OR_NULL = "case when tx_id % 7 = 0 then null else \"type\" end"


@query("amount_quantiles_by_type", with_("ta", f"""
select {_TYPE_OR_NULL} as type, {r('quantile_cont(amount, 0.1)', FINE)} as p10,
       {r('quantile_cont(amount, 0.5)', FINE)} as p50, {r('quantile_cont(amount, 0.99)', FINE)} as p99
  from ta group by 1"""))
def amount_quantiles_by_type(spark, d):
    t = fx.ta(spark, d).withColumn("type", F.when(F.col("tx_id") % 7 != 0, F.col("type")))
    out = exact_quantiles(t, "amount", [0.1, 0.5, 0.99], by=["type"], prefix="p")
    return present(out, {c: FINE for c in ("p10", "p50", "p99")})


_BIG = "9007199254740993 + (tx_id * 7919) % 100003"


@query("skyline_large_longs", with_("ta", f"""
select tx_id, t, m from (select tx_id, tx_id % 1009 as t, case when tx_id % 501 = 0 then null else {_BIG} end as m from ta) a
 where not exists (select 1 from (select tx_id % 1009 as t, case when tx_id % 501 = 0 then null else {_BIG} end as m from ta) b
                    where b.t <= a.t and b.m <= a.m and (b.t < a.t or b.m < a.m))"""))
def skyline_large_longs(spark, d):
    """Two long measures beyond the range that doubles hold exactly; some
    rows have no second measure."""
    t = fx.ta(spark, d).select("tx_id", (F.col("tx_id") % 1009).alias("t"), F.expr(
        f"case when tx_id % 501 = 0 then null else {_BIG} end").alias("m"))
    return skyline(t, ("t", "m"))


@query("written_footprint", with_(["ta", "net"], """
select 'ta_lines' as "table", count(distinct step % 7) as n_files, cast(16 * count(*) as bigint) as total_bytes,
       16 * count(*) / 1048576.0::double as size_mb from ta where step is not null
union all
select 'net_lines', count(distinct line_id % 3), cast(16 * count(*) as bigint), 16 * count(*) / 1048576.0::double from net"""))
def written_footprint(spark, d):
    """Footprint of files that the query writes itself: lines of 16 bytes, one
    file per value of a bucket."""
    root = scratch_path(spark, "footprint")
    t, n = fx.ta(spark, d).filter(F.col("step").isNotNull()), fx.net(spark, d)
    for name, df, key, bucket in (("ta_lines", t, "tx_id", F.col("step") % 7), ("net_lines", n, "line_id", F.col("line_id") % 3)):
        (df.select(F.lpad(F.col(key).cast("string"), 15, "0").alias("value"), bucket.alias("bucket")).repartition("bucket")
         .write.partitionBy("bucket").text(f"{root}/{name}"))
    return qa.footprint(spark, {x: f"{root}/{x}" for x in ("ta_lines", "net_lines")}, glob="*.txt")


@query("source_footprint")
def source_footprint(spark, d):
    return qa.footprint(spark, {t: f"{d.rstrip('/')}/{t}.parquet" for t in TABLES})


# ------------------------------------------------------------ H1-H4

_HASH = "cast(('0x' || substr(md5('42:' || tx_id), 1, 8)) as bigint)"


@query("hash_sample", with_("ta", f"""
select tx_id, account, step, amount from ta where {_HASH} < 429496729.6"""))
def hash_sample(spark, d):
    return smp.hash_sample(fx.ta(spark, d), ["tx_id"], 0.1).select("tx_id", "account", "step", "amount")


@query("scaling_ladder", with_("ta", f"""
select cast(f as double) as fraction, cast(count_if(h < f * 4294967296) as bigint) as sampled_rows,
       count(*) as total_rows,
       {r('cast(count_if(h < f * 4294967296) as double) / count(*)', FINE)} as sampled_ratio
  from (select {_HASH} as h from ta) cross join (values (0.1), (0.25), (0.5), (1.0)) v(f)
 group by f"""))
def scaling_ladder(spark, d):
    out = smp.ladder_counts(fx.ta(spark, d), ["tx_id"])
    return present(out, {"sampled_ratio": FINE})


@query("bernoulli_sample")
def bernoulli_sample(spark, d):
    return smp.bernoulli(fx.ta(spark, d), 0.1).select("tx_id", "account", "step", "amount")


@query("bernoulli_sample_check", with_("ta", """
select count(*) as total_rows, cast(0 as bigint) as foreign_rows, cast(0 as bigint) as repeated_rows,
       true as size_within_bounds from ta"""))
def bernoulli_sample_check(spark, d):
    """The random sample holds rows of the table only, each once, and as many
    as the fraction allows (within 6 standard deviations)."""
    t = fx.ta(spark, d).select("tx_id", "account", "step", "amount")
    s = smp.bernoulli(fx.ta(spark, d), 0.1).select("tx_id", "account", "step", "amount")
    both = (t.withColumn("side", F.lit("t")).unionByName(s.withColumn("side", F.lit("s")))
            .groupBy("tx_id", "account", "step", "amount")
            .agg(F.count_if(F.col("side") == "t").alias("t"), F.count_if(F.col("side") == "s").alias("s")))
    g = both.agg(F.sum("t").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("t") == 0, F.col("s"))), F.lit(0)).alias(
        "foreign_rows"), F.coalesce(F.sum(F.greatest(F.col("s") - F.col("t"), F.lit(0))), F.lit(0)).alias("repeated_rows"),
        F.sum("s").alias("n"))
    within = F.abs(F.col("n") - 0.1 * F.col("total_rows")) <= 6 * F.sqrt(0.09 * F.col("total_rows")) + 1
    return g.select("total_rows", "foreign_rows", "repeated_rows", within.alias("size_within_bounds"))


# ------------------------------------------------------------ C12

@query("sample_series_summary", f"""
select user_id, count(*) as n_samples, coalesce(max(value), 0.0) as peak_value,
       {r('coalesce(avg(value), 0.0)', FINE)} as avg_value
  from events group by user_id""")
def sample_series_summary(spark, d):
    ev = fx.table(spark, d, "events")
    return present(agg.series_summary(ev, ["user_id"], ["value"]), {"avg_value": FINE})


# ------------------------------------------------------------ I1-I11, A11, B23, B24

_NRUNS = """select case engine when 'Spark_PySpark' then 'spark' when 'Hadoop_MapReduce' then 'hadoop'
                   else engine end as engine,
       workload,
       case workload when 'WL1_aggregation' then 'WL1: Daily Aggregation'
                     when 'WL2_fraud' then 'WL2: Fraud Proxy'
                     when 'WL3_join_window' then 'WL3: Join + Window' else workload end as workload_label,
       coalesce(wall_time_sec, 0.0) as wall_time_sec, cpu_time_sec, peak_memory_mb, cast(0 as double) as avg_memory_mb, data_size_mb,
       cast(output_rows as double) as output_rows, sample_fraction,
       cast(0 as double) as tracemalloc_peak_mb, cast(0 as double) as peak_cpu_pct,
       cast(0 as double) as avg_cpu_pct, exit_code
  from runs"""
_OK = "select * from nruns where exit_code = 0 and wall_time_sec > 0"
# near-equal fractions share the least of their chain
_KEYED = """select ok.*, k.fraction_key from ok left join (
    select f, min(f) over (partition by g) as fraction_key from (
      select f, sum(n) over (order by f) as g from (
        select f, case when f - lag(f) over (order by f) <= 0.01 - 1e-9 then 0 else 1 end as n
          from (select distinct sample_fraction as f from ok)))) k on ok.sample_fraction = k.f"""


def _runs_sql(body: str, extra: dict | None = None) -> str:
    ctes = {"nruns": _NRUNS, "ok": _OK, "keyed": _KEYED}
    ctes.update(extra or {})
    return with_("runs", body, extra=ctes)


def _nruns(spark, d):
    return sinks.normalise_runs(fx.runs(spark, d))


@query("runs_load_normalised", _runs_sql("select * from nruns"))
def runs_load_normalised(spark, d):
    path = scratch_path(spark, "runs_csv")
    sinks.save_runs(fx.runs(spark, d), path)
    return sinks.load_runs(spark, path)


@query("runs_successful", _runs_sql("select * from ok"))
def runs_successful(spark, d):
    return rn.successful(_nruns(spark, d))


def _full_sql(src: str, branch: str) -> str:
    return f"""select '{branch}' as branch, engine, workload, sample_fraction, wall_time_sec from {src}
 where case when (select count_if(sample_fraction >= 0.99) from {src}) > 0 then sample_fraction >= 0.99
            else sample_fraction >= (select max(sample_fraction) from {src}) - 0.01 end"""


@query("runs_full_size", _runs_sql(_full_sql("ok", "default") + "\nunion all\n" + _full_sql("ok2", "fallback"),
                                   {"ok2": "select * from ok where sample_fraction < 0.99"}))
def runs_full_size(spark, d):
    ok = rn.successful(_nruns(spark, d))
    cols = ["engine", "workload", "sample_fraction", "wall_time_sec"]
    a = rn.full_size(ok).select(F.lit("default").alias("branch"), *cols)
    b = rn.full_size(ok.filter(F.col("sample_fraction") < 0.99)).select(
        F.lit("fallback").alias("branch"), *cols)
    return a.unionByName(b)


@query("runs_first_per_key", _runs_sql("""
select engine, workload, fraction_key, wall_time_sec, peak_memory_mb from (
  select *, row_number() over (partition by engine, workload, fraction_key
                               order by wall_time_sec, data_size_mb) as rn
    from keyed) where rn = 1"""))
def runs_first_per_key(spark, d):
    runs = rn.match_fractions(rn.successful(_nruns(spark, d)))
    first = rn.first_per_key(runs, ["engine", "workload", "fraction_key"],
                             ["wall_time_sec", "data_size_mb"])
    return first.select("engine", "workload", "fraction_key", "wall_time_sec", "peak_memory_mb")


def _speedup_sql(src: str, keys: str, require_both: bool) -> str:
    where = ("where spark_wall_time_sec > 0 and hadoop_wall_time_sec > 0" if require_both else "")
    return f"""select *, {r('case when spark_wall_time_sec > 0 then hadoop_wall_time_sec / spark_wall_time_sec end', FINE)} as speedup
  from (select {keys}, min(case when engine = 'spark' then wall_time_sec end) as spark_wall_time_sec,
               min(case when engine = 'hadoop' then wall_time_sec end) as hadoop_wall_time_sec
          from {src} group by all) {where}"""


@query("runs_speedup_full", _runs_sql(_speedup_sql("fullsz", "workload", False),
                                      {"fullsz": _full_sql("ok", "default")}))
def runs_speedup_full(spark, d):
    full = rn.full_size(rn.successful(_nruns(spark, d)))
    return present(rn.speedup(full, ["workload"]), {"speedup": FINE})


@query("runs_speedup_by_fraction", _runs_sql(_speedup_sql("keyed", "workload, fraction_key", True)))
def runs_speedup_by_fraction(spark, d):
    ok = rn.match_fractions(rn.successful(_nruns(spark, d)))
    out = rn.speedup(ok, ["workload", "fraction_key"], require_both=True)
    return present(out, {"speedup": FINE})


@query("runs_scaling_curve", _runs_sql("""
select workload, engine, data_size_mb, wall_time_sec,
       cast(row_number() over (partition by workload, engine order by data_size_mb, wall_time_sec) as integer) as position
  from ok"""))
def runs_scaling_curve(spark, d):
    return rn.scaling_curve(_nruns(spark, d))


_METRICS = ["wall_time_sec", "peak_memory_mb", "cpu_time_sec"]


_LISTED = ", ".join(f"'{w}'" for w in rn.WORKLOADS)


def _pivot_sql(metric: str) -> str:
    cols = ", ".join(f"max(case when workload = '{w}' then {metric} end) as {w}" for w in rn.WORKLOADS)
    return (f"select engine, fraction_key as sample_fraction, {cols}, "
            f"max(case when workload not in ({_LISTED}) then {metric} end) as unlisted, '{metric}' as metric "
            f"from keyed group by engine, fraction_key")


@query("runs_metric_pivot", _runs_sql("\nunion all\n".join(_pivot_sql(m) for m in _METRICS)))
def runs_metric_pivot(spark, d):
    return rn.pivot_metric(_nruns(spark, d), _METRICS)


@query("runs_metric_long", _runs_sql("\nunion all\n".join(
    f"select engine, fraction_key, workload, '{m}' as metric, max({m}) as value from keyed group by all" for m in _METRICS)))
def runs_metric_long(spark, d):
    return rn.metric_long(_nruns(spark, d), _METRICS)


_FIT = """select engine, regr_slope(peak_memory_mb, ln(greatest(data_size_mb, 1e-6))) as slope,
       regr_intercept(peak_memory_mb, ln(greatest(data_size_mb, 1e-6))) as intercept,
       cast(regr_count(peak_memory_mb, ln(greatest(data_size_mb, 1e-6))) as bigint) as n_points,
       min(data_size_mb) as x_min, max(data_size_mb) as x_max
  from ok group by engine having regr_count(peak_memory_mb, ln(greatest(data_size_mb, 1e-6))) >= 2"""


@query("runs_memory_fit", _runs_sql(f"""
select engine, {r('slope', FINE)} as slope, {r('intercept', FINE)} as intercept, n_points, x_min, x_max
  from fit""", {"fit": _FIT}))
def runs_memory_fit(spark, d):
    return present(rn.fit_log(_nruns(spark, d)), {"slope": FINE, "intercept": FINE})


@query("runs_memory_fit_curve", _runs_sql(f"""
select engine, cast(i as integer) as i, {r('x', FINE)} as x,
       {r('slope * ln(greatest(x, 1e-6)) + intercept', 4)} as y
  from (select engine, i, slope, intercept, x_min + i * (x_max - x_min) / 99 as x
          from fit cross join range(0, 100) t(i))""", {"fit": _FIT}))
def runs_memory_fit_curve(spark, d):
    return present(rn.fit_curve(rn.fit_log(_nruns(spark, d))), {"x": FINE, "y": 4})


@query("runs_pareto_frontier", _runs_sql("""
select engine, workload, sample_fraction, wall_time_sec, peak_memory_mb from ok a
 where not exists (select 1 from ok b
                    where b.wall_time_sec <= a.wall_time_sec and b.peak_memory_mb <= a.peak_memory_mb
                      and (b.wall_time_sec < a.wall_time_sec or b.peak_memory_mb < a.peak_memory_mb))"""))
def runs_pareto_frontier(spark, d):
    front = rn.frontier(rn.successful(_nruns(spark, d)))
    return front.select("engine", "workload", "sample_fraction", "wall_time_sec", "peak_memory_mb")


@query("runs_time_matrix", _runs_sql(
    "select engine, " + ", ".join(f"coalesce(min(case when workload = '{w}' then wall_time_sec end), 0.0) as {w}"
                                   for w in rn.WORKLOADS)
    + f", coalesce(min(case when workload not in ({_LISTED}) then wall_time_sec end), 0.0) as unlisted"
    + " from fullsz group by engine",
    {"fullsz": "select * from ok where case when (select count_if(sample_fraction >= 0.99) from ok) > 0 "
             "then sample_fraction >= 0.99 else sample_fraction >= (select max(sample_fraction) from ok) - 0.01 end"}))
def runs_time_matrix(spark, d):
    return rn.time_matrix(_nruns(spark, d))


@query("runs_summary", _runs_sql("""
select engine, workload, sample_fraction, printf('%.1f', floor(wall_time_sec * 10 + 0.5) / 10) as time_sec,
       printf('%.0f', floor(peak_memory_mb + 0.5)) as memory_mb, exit_code
  from nruns"""))
def runs_summary(spark, d):
    return rn.summary(_nruns(spark, d))


# ------------------------------------------------------------ H3 written ladder

@query("scaling_ladder_written", with_("ta", f"""
select cast(f as double) as fraction, cast(count_if(h < f * 4294967296) as bigint) as sampled_rows
  from (select {_HASH} as h from ta) cross join (values (0.1), (0.25), (0.5), (1.0)) v(f)
 group by f"""))
def scaling_ladder_written(spark, d):
    """Write the ladder once (partitioned by rung), read each rung back
    through partition pruning and count it."""
    path = scratch_path(spark, "ladder")
    smp.write_ladder(fx.ta(spark, d), ["tx_id"], path)
    parts = [smp.read_rung(spark, path, f).agg(F.count(F.lit(1)).alias("sampled_rows"))
             .select(F.lit(float(f)).alias("fraction"), "sampled_rows")
             for f in smp.DEFAULT_FRACTIONS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
