"""Session construction and shared-folder helpers.

Operators never build sessions; callers (tests, bench, scripts) do.  On a
cluster the session is created by the platform and ``spark.checkpoint.dir``
names a shared folder; we only fill it in when it is unset (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of ours uses.  Shuffle width is left to AQE: the
# initial number is an upper bound that AQE coalesces at runtime.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime-checked broadcast: AQE converts a join to a broadcast only when
    # the materialised side is below this size
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "ledgerflow",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    The cluster names its shared folder in ``spark.checkpoint.dir``; we read
    it from the session.  Only when nothing is configured (local tests) do we
    create a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="ledgerflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder (never machine-local
    on a cluster, because the folder is the cluster's)."""
    # the folder may be a URI of any file system: its scheme stays
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def recommended_shuffle_partitions(spark: SparkSession, paths: list[str],
                                   target_mb: float = 256, glob: str = "*") -> int:
    """Shuffle width for inputs of this size: total input MB / ``target_mb``,
    at least the number of cores.  Set ``spark.sql.shuffle.partitions`` to it
    and let AQE coalesce what turns out smaller.  Only the file listing is
    read (one row per file)."""
    from .operators.quality import footprint

    sizes = footprint(spark, {str(i): p for i, p in enumerate(paths)}, glob=glob)
    total_mb = sizes.agg({"size_mb": "sum"}).collect()[0][0] or 0.0
    return max(spark.sparkContext.defaultParallelism, int(total_mb // target_mb) + 1)
