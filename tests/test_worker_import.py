"""Python shipped to executors must not need this package importable there
(the driver may import it from a path the workers do not have)."""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_prefix_scan_runs_from_another_working_directory(tmp_path):
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {REPO!r})
        from pyspark.sql import SparkSession
        from ledgerflow.operators.prefix import exact_quantiles
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        df = spark.range(0, 101).selectExpr("cast(id as double) as x")
        print("RESULT", exact_quantiles(df, "x", [0.5]).collect()[0]["q50"])
        spark.stop()
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "RESULT 50.0" in out.stdout, out.stderr[-2000:]
