"""Typed layouts of the transaction, network and run-result tables.

Fixed values: the column names and types below are the published layouts of
the PaySim and BankSim transaction files, the BankSim network file and the
benchmark result file.  Every field is nullable.
"""

from __future__ import annotations

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,
                               StructField, StructType)


def _schema(spec: list[tuple[str, object]]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in spec])


# PaySim transaction layout (11 fields).
PAYSIM = _schema([
    ("step", LongType()), ("type", StringType()), ("amount", DoubleType()),
    ("nameOrig", StringType()), ("oldbalanceOrg", DoubleType()),
    ("newbalanceOrig", DoubleType()), ("nameDest", StringType()),
    ("oldbalanceDest", DoubleType()), ("newbalanceDest", DoubleType()),
    ("isFraud", IntegerType()), ("isFlaggedFraud", IntegerType()),
])

# BankSim transaction layout (10 fields).
BANKSIM_TX = _schema([
    ("step", DoubleType()), ("customer", StringType()), ("age", StringType()),
    ("gender", StringType()), ("zipcodeOri", StringType()), ("merchant", StringType()),
    ("zipMerchant", StringType()), ("category", StringType()), ("amount", DoubleType()),
    ("fraud", IntegerType()),
])

# BankSim network (edge list) layout (5 fields).
BANKSIM_NET = _schema([
    ("Source", StringType()), ("Target", StringType()), ("Weight", DoubleType()),
    ("typeTrans", StringType()), ("fraud", IntegerType()),
])

# Benchmark result record (16 fields).
BENCH_RUNS = _schema([
    ("engine", StringType()), ("workload", StringType()), ("dataset", StringType()),
    ("data_size_mb", DoubleType()), ("wall_time_sec", DoubleType()),
    ("cpu_time_sec", DoubleType()), ("peak_memory_mb", DoubleType()),
    ("avg_memory_mb", DoubleType()), ("peak_cpu_pct", DoubleType()),
    ("avg_cpu_pct", DoubleType()), ("tracemalloc_peak_mb", DoubleType()),
    ("output_rows", LongType()), ("exit_code", IntegerType()),
    ("error_msg", StringType()), ("sample_fraction", DoubleType()),
    ("notes", StringType()),
])

# Columns of the daily aggregation's published output.
W1_COLUMNS = ["dataset", "account", "day", "type", "total_amount", "tx_count",
              "avg_amount", "max_amount", "fraud_count"]

# Workload tuning constants.
VELOCITY_THRESHOLD = 5
AMOUNT_Z_THRESHOLD = 2.5
WINDOW_SIZE_STEPS = 24
STEPS_PER_DAY = 24


class Layout:
    """Column roles of a transaction table, so operators stay name-free."""

    def __init__(self, dataset: str, account: str, step: str, type_: str,
                 amount: str, label: str, counterparty: str | None = None,
                 steps_per_day: int = STEPS_PER_DAY, key: list[str] | None = None):
        self.dataset = dataset
        self.account = account
        self.step = step
        self.type = type_
        self.amount = amount
        self.label = label
        self.counterparty = counterparty
        self.steps_per_day = steps_per_day
        self.key = key or []


# Role maps for the two reference sources.
PAYSIM_LAYOUT = Layout("PAYSIM", "nameOrig", "step", "type", "amount", "isFraud",
                       counterparty="nameDest", steps_per_day=24)
BANKSIM_LAYOUT = Layout("BANKSIM", "customer", "step", "category", "amount", "fraud",
                        counterparty="merchant", steps_per_day=1)
