import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerflow.session import get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="ledgerflow-tests", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="lf-test-ckpt-")})
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    key = lambda t: [(v is None, 0 if v is None else v) for v in t]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key)
