"""DuckDB text of the fixtures and helpers for oracle SQL.

These strings are the independent check of the Spark queries: the driver
runs them on the raw Parquet tables (registered as views), so every oracle
query starts from the fixture CTEs below.
"""

from __future__ import annotations

CTES = {
    "ta": """select event_id as tx_id,
       datediff('day', timestamp '2024-01-01', ts)*24 + hour(ts) as step,
       event_type as "type", value as amount,
       'C'||user_id as account,
       'M'||json_extract_string(props,'$.k') as counterparty,
       case when event_type='error' then 1 else 0 end as is_fraud
  from events""",
    "ta_frac": """select event_id as tx_id,
       cast(datediff('day', timestamp '2024-01-01', ts)*24 + hour(ts) as double)
         + cast(minute(ts) as double)/60 as step,
       event_type as "type", value as amount,
       'C'||user_id as account,
       case when event_type='error' then 1 else 0 end as is_fraud
  from events""",
    "tb": """select l_orderkey*10 + l_linenumber as line_id, l_partkey as part_id,
       datediff('day', timestamp '1995-01-01', l_shipdate) as step,
       'C'||o_custkey as customer, 'M'||l_suppkey as merchant,
       l_returnflag as category, l_extendedprice as amount,
       case when l_linestatus='F' then 1 else 0 end as fraud
  from lineitem join orders on l_orderkey = o_orderkey""",
    "net": """select customer as Source, merchant as Target, amount as Weight,
       category as typeTrans, fraud, line_id, part_id, step
  from tb where category = 'R'""",
    "plain_runs": """select case when l_linestatus='F' then 'Spark_PySpark' else 'Hadoop_MapReduce' end as engine,
       case l_returnflag when 'A' then 'WL1_aggregation' when 'N' then 'WL2_fraud'
                         else 'WL3_join_window' end as workload,
       round(cast(year(l_shipdate)-1994 as double)/7, 3) as sample_fraction,
       round(sum(l_extendedprice)/1000000, 4) as data_size_mb,
       cast(sum(l_quantity) as double) as wall_time_sec,
       round(sum(l_tax), 4) as cpu_time_sec,
       round(avg(l_extendedprice), 4) as peak_memory_mb,
       cast(count(*) as bigint) as output_rows,
       cast(case when year(l_shipdate)=1996 and l_returnflag='R' then 1 else 0 end as int) as exit_code
  from lineitem group by l_linestatus, l_returnflag, year(l_shipdate)""",
    "runs": """select engine, case when kind = 'other' then 'WL9_custom' else workload end as workload,
       case when kind = 'near' then round(sample_fraction + 0.004, 3) else sample_fraction end as sample_fraction,
       data_size_mb, case when kind = 'near' then wall_time_sec + 1 when kind <> 'failed' then wall_time_sec end as wall_time_sec,
       cpu_time_sec, peak_memory_mb, output_rows,
       cast(case when kind = 'failed' then 1 else exit_code end as int) as exit_code
  from plain_runs cross join (values ('plain'), ('near'), ('other'), ('failed')) k(kind)""",
}

_DEPS = {"net": ["tb"], "runs": ["plain_runs"]}


def with_(names: list[str] | str, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the named fixtures (and their dependencies)
    followed by ``extra`` CTEs, then ``body``."""
    if isinstance(names, str):
        names = [names]
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({CTES[n]})" for n in order]
    parts += [f"{k} as ({v})" for k, v in (extra or {}).items()]
    return "with " + ",\n".join(parts) + "\n" + body


def r(expr: str, digits: int) -> str:
    """DuckDB twin of ``functions.columns.round_half_up``."""
    s = f"cast({10 ** digits} as double)"
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


def z(log_expr: str, mean: str, std: str) -> str:
    return (f"(({log_expr}) - coalesce({mean}, 0.0)) / "
            f"(case when {std} is null or {std} = 0 then 1.0 else {std} end)")
