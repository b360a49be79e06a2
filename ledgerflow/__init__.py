"""ledgerflow: transaction analytics as Spark DataFrame operators.

Subpackages: ``sources`` (readers, quarantine, routing, sinks),
``functions`` (column helpers), ``operators`` (aggregation, windows, joins,
sampling, quality, run-result analytics), ``plans`` (composed workloads and
the registered queries), ``streaming`` (incremental form of the workloads).
"""

__version__ = "0.1.0"
