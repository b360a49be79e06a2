"""Column -> Column helpers.  All built from ``pyspark.sql.functions`` so they
stay inside whole-stage codegen; none of them needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_bucket(step: str | Column, steps_per_day: int = 24) -> Column:
    """Day index of a step.  ``steps_per_day=24`` for hourly steps (truncating
    division, as a cast of the quotient does), 1 when the step is a day."""
    s = col(step)
    if steps_per_day == 1:
        return s.cast("long")
    return (s / F.lit(steps_per_day)).cast("long")


def hour_of_day(step: str | Column, steps_per_day: int = 24) -> Column:
    """Hour-of-day bucket, non-negative for negative steps too."""
    return F.pmod(col(step).cast("long"), F.lit(steps_per_day).cast("long"))


def log_amount(amount: str | Column, clamp_nonpositive: bool = False) -> Column:
    """``log1p(amount)``; NULL for amount <= -1.  With ``clamp_nonpositive``
    amounts <= 0 map to 0.0 instead."""
    a = col(amount)
    if clamp_nonpositive:
        return F.when(a > 0, F.log1p(a)).otherwise(F.lit(0.0))
    return F.log1p(a)


def safe_mean(c: str | Column) -> Column:
    """Mean with a missing value mapped to 0.0."""
    return F.coalesce(col(c), F.lit(0.0))


def safe_std(c: str | Column) -> Column:
    """Standard deviation with NULL or 0.0 mapped to 1.0."""
    s = col(c)
    return F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)


def zscore(x: str | Column, mean: str | Column, std: str | Column) -> Column:
    return (col(x) - safe_mean(mean)) / safe_std(std)


def flag_or(*flags: str | Column) -> Column:
    """1 when any flag is true, 0 otherwise (NULL counts as not true)."""
    cond = col(flags[0])
    for f in flags[1:]:
        cond = cond | col(f)
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_where(cond: Column) -> Column:
    """Conditional count as a bigint (``sum(case when ... then 1 else 0)``)."""
    return F.count_if(cond).cast("long")


def guarded_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` when ``den > 0`` else 0.0 (no division by zero under ANSI)."""
    d = col(den)
    return F.when(d > 0, col(num).cast("double") / d).otherwise(F.lit(0.0))


def strip_quotes(c: str | Column, quote: str = "'") -> Column:
    """Trim blanks, then strip the quote character from both ends."""
    return F.btrim(F.btrim(col(c)), F.lit(quote))


def tolerant_double(c: str | Column, default: float | None = None) -> Column:
    """Parse text as double; unparseable -> NULL (or ``default``)."""
    v = col(c).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def tolerant_int_label(c: str | Column) -> Column:
    """Parse a 0/1 label written as ``1`` or ``1.0``: int(float(x))."""
    return col(c).try_cast("double").try_cast("long").cast("int")


def is_integer_text(c: str | Column) -> Column:
    """True when the text is an optionally negative run of digits."""
    return col(c).rlike(r"^-*[0-9]+$")


def is_decimal_text(c: str | Column) -> Column:
    """Same as ``is_integer_text`` with decimal points removed first."""
    return F.regexp_replace(col(c), r"\.", "").rlike(r"^-*[0-9]+$")


def fixed(c: str | Column, digits: int) -> Column:
    """Fixed-precision text, e.g. ``%.2f``."""
    return F.format_string(f"%.{digits}f", col(c))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Rounding that two engines agree on bit for bit: floor(x*10^d + 0.5)/10^d.

    Used only to present doubles for cross-engine comparison; operators keep
    full precision."""
    scale = float(10 ** digits)
    x = col(c).cast("double")
    # beyond 2^53 / scale a double has no such digits; floor() returns a long
    # and would saturate there, and turn NaN into 0
    plain = F.isnan(x) | (F.abs(x) >= F.lit(2.0 ** 53 / scale))
    return F.when(plain, x).otherwise(F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")
