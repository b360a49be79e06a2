"""End-to-end pipelines over a data folder: read whichever of the source
files exist, run a workload, write the result as delimited text with a
header, return the row count (observed on the write itself - the plan runs
once).

Every source is read and parsed once, into ``<output>/ingest/<source>``: a
Parquet table partitioned by outcome.  Its partition ``good`` feeds the
workload (typed columns, so a workload that reads a source twice does not parse
it twice); the other partitions are the quarantine, one per reason, with the
raw lines.

Fixed values: the source file names of the three inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..schemas import BANKSIM_LAYOUT, BANKSIM_NET, BANKSIM_TX, PAYSIM, PAYSIM_LAYOUT
from ..sources import delimited as dl
from ..sources.sinks import write_counted
from . import workloads as wl

PAYSIM_FILE = "paysim_transactions.csv"
BANKSIM_FILE = "banksim_transactions.csv"
NETWORK_FILE = "banksim_network.csv"


def _path(data_dir: str, name: str) -> str:
    return data_dir.rstrip("/") + "/" + name


# source -> file, layout, quote
SOURCES = {"paysim": (PAYSIM_FILE, PAYSIM, '"'), "banksim_tx": (BANKSIM_FILE, BANKSIM_TX, "'"),
           "banksim_net": (NETWORK_FILE, BANKSIM_NET, "'")}


def ingest_sources(spark: SparkSession, data_dir: str, output_dir: str,
                   names: tuple[str, ...] = tuple(SOURCES)) -> dict[str, dl.Ingested]:
    """The named sources whose files exist, each parsed in one pass into typed
    records and quarantined lines below ``output_dir``."""
    out = {}
    for name in names:
        file, schema, quote = SOURCES[name]
        found = dl.load_available_or_none(
            spark, [_path(data_dir, file)],
            lambda s, p: dl.ingest(s, p, schema, _path(output_dir, f"ingest/{name}"), quote))
        out |= {name: x for x in found}
    if not out:
        raise dl.NoInput(f"no input data found in {data_dir}")
    return out


def _facts(sources: dict[str, dl.Ingested]):
    layouts = {"paysim": PAYSIM_LAYOUT, "banksim_tx": BANKSIM_LAYOUT}
    return [(sources[n].good, lay) for n, lay in layouts.items() if n in sources]


def ingest_report(spark: SparkSession, data_dir: str):
    """(source, n_good, n_dropped, one count per reason) of every source file
    that exists: which records the workloads do not see."""
    parts = []
    for name, (file, schema, quote) in SOURCES.items():
        def count(s, p, schema=schema, quote=quote):
            return dl.ingest_counts(s, p, schema, quote)
        parts += [c.select(F.lit(name).alias("source"), "*")
                  for c in dl.load_available_or_none(spark, [_path(data_dir, file)], count)]
    if not parts:
        raise dl.NoInput(f"no input data found in {data_dir}")
    return wl.union_all(parts)


def _write(df, output_dir: str, name: str, files: int | None) -> int:
    out = df.coalesce(files) if files else df
    return write_counted(out, os.path.join(output_dir, name), fmt="csv", header=True)


def run_workload1(spark: SparkSession, data_dir: str, output_dir: str,
                  files: int | None = None) -> int:
    """Daily aggregation over every available source."""
    parts = _facts(ingest_sources(spark, data_dir, output_dir, ("paysim", "banksim_tx")))
    return _write(wl.workload1(parts), output_dir, "workload1_aggregation", files)


def run_workload2(spark: SparkSession, data_dir: str, output_dir: str,
                  files: int | None = None, **kw) -> tuple[int, list[dict]]:
    """Fraud proxy over every available source; returns the row count and
    the precision/recall of each dataset, all observed on the one write."""
    parts = _facts(ingest_sources(spark, data_dir, output_dir, ("paysim", "banksim_tx")))
    out, scores = wl.observed_scores(parts, **kw)
    n = _write(out, output_dir, "workload2_fraud", files)
    return n, scores()


def run_workload3(spark: SparkSession, data_dir: str, output_dir: str,
                  files: int | None = None, network_key: str = "Source") -> int:
    """Enrichment + trailing window: PaySim with its own counterparty
    dimension; BankSim only when both its transactions and network exist."""
    found = {n: x.good for n, x in ingest_sources(spark, data_dir, output_dir).items()}
    parts = []
    if "paysim" in found:
        parts.append(wl.workload3(hourly=(found["paysim"], PAYSIM_LAYOUT)))
    if "banksim_tx" in found and "banksim_net" in found:
        parts.append(wl.workload3(daily=(found["banksim_tx"], BANKSIM_LAYOUT), edges=found["banksim_net"],
                                  network_key=network_key))
    if not parts:
        raise dl.NoInput(f"{BANKSIM_FILE} and {NETWORK_FILE} go together")
    return _write(wl.union_all(parts), output_dir, "workload3_join_window", files)

