"""Date functions with the reference's semantics (fn_year, fn_month_diff,
fn_days_diff, fn_add_days, fn_month_end, fn_date_text)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_date(x) -> Column:
    return _c(x).cast("date")


def month_diff(start, end) -> Column:
    """Month *boundaries crossed* from start to end (Jan 31 -> Feb 1 is 1).

    Not ``months_between``/``timestampdiff(MONTH)``, which count whole months."""
    s, e = _c(start), _c(end)
    return (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))


def in_year(col, year: int) -> Column:
    """Calendar-year filter as a half-open range so both bounds push down to
    the Parquet scan (``year(col) = y`` only pushes ``IsNotNull``)."""
    c = _c(col)
    lo, hi = _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)
    return (c >= F.lit(lo)) & (c < F.lit(hi))


def in_range(col, start, end_exclusive) -> Column:
    c = _c(col)
    return (c >= F.lit(start)) & (c < F.lit(end_exclusive))


def month_end(col) -> Column:
    return F.last_day(_c(col))


def month_end_spine(first, last) -> Column:
    """Array of month-end dates from the month of ``first`` to that of ``last``.

    Built from month starts (always valid) and mapped to ``last_day``, so no
    day-of-month drift; empty when last < first."""
    f, l_ = F.trunc(_c(first), "MM"), F.trunc(_c(last), "MM")
    seq = F.when(l_ >= f, F.sequence(f, l_, F.expr("interval 1 month")))
    return F.transform(F.coalesce(seq, F.array().cast("array<date>")), lambda d: F.last_day(d))


def add_days(col, n) -> Column:
    return F.date_add(_c(col), n)


def days_diff(end, start) -> Column:
    return F.datediff(_c(end), _c(start))


def date_text(col) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd")
