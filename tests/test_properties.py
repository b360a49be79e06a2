"""Randomised equivalence checks of the skew-safe operators against their
direct (single-partition-per-key) forms."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from ledgerflow.operators import windows as win
from ledgerflow.operators.prefix import skyline

ROW = st.tuples(st.sampled_from(["a", "b", "c"]),
                st.one_of(st.none(), st.integers(min_value=-30, max_value=150)),
                st.one_of(st.none(), st.integers(min_value=0, max_value=50).map(float)))
SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(data=st.lists(ROW, min_size=1, max_size=60), width=st.integers(min_value=24, max_value=70))
def test_rolling_forms_agree(spark, data, width):
    df = spark.createDataFrame(data, "acct string, step long, amount double")
    a = win.rolling(df, ["acct"], "step", "amount", bucket_width=width)
    b = win.rolling(df, ["acct"], "step", "amount", method="window")
    assert rows(a) == rows(b)


@SETTINGS
@given(data=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=80))
def test_skyline_agrees_with_definition(spark, data):
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(data)]
    df = spark.createDataFrame(pts, "id long, t double, m double")
    got = sorted(r["id"] for r in skyline(df, ("t", "m"), n_ranges=3).collect())
    want = sorted(i for i, a, b in pts
                  if not any(a2 <= a and b2 <= b and (a2 < a or b2 < b) for _, a2, b2 in pts))
    assert got == want
