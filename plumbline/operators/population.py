"""Populations and predicate operators (§2.2)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Population:
    """A named segment: row predicate + the key that counts one unit + text.

    Passed to every metric and echoed in its output so a figure always carries
    the population it was computed on."""
    predicate: Column | None
    key: str
    text: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df if self.predicate is None else df.where(self.predicate)


def population_predicate(as_of_col: str | None = None, as_of: dt.date | None = None,
                         type_col: str | None = None, types: Sequence[str] = (),
                         status_col: str | None = None, statuses: Sequence[str] = ()) -> Column:
    """flt_population: as-of date + type + status IN-list, pushed to the scan."""
    c = F.lit(True)
    if as_of_col and as_of is not None:
        c = c & (F.col(as_of_col) == F.lit(as_of))
    if type_col and types:
        c = c & F.col(type_col).isin(list(types))
    if status_col and statuses:
        c = c & F.col(status_col).isin(list(statuses))
    return c


def flt_population(df: DataFrame, pop: Population) -> DataFrame:
    return pop.apply(df)


def flt_effective(df: DataFrame, start: str, end: str, as_of: dt.date) -> DataFrame:
    """Rows of an effective-dated table in force on ``as_of`` (closed interval)."""
    d = F.lit(as_of)
    return df.where((F.col(start) <= d) & (F.col(end) >= d))


def flt_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def tenure_band(months: Column, cuts: Sequence[int] = (12, 36),
                labels: Sequence[str] = ("0-1yr", "1-3yr", "3yr+")) -> Column:
    """prj_case_band: ``months < cuts[0]`` -> labels[0], ... else last label."""
    expr = None
    for cut, lab in zip(cuts, labels):
        expr = F.when(months < cut, lab) if expr is None else expr.when(months < cut, lab)
    return expr.otherwise(labels[len(cuts)])


def flag(col: str | Column) -> Column:
    """prj_flag: 0/1 from a nullable join key."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull().cast("int")


def clip(col: str | Column, lo, hi) -> Column:
    """prj_clip: bound a value to [lo, hi]."""
    c = F.col(col) if isinstance(col, str) else col
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def switch(pairs: Sequence[tuple[Column, object]], otherwise) -> Column:
    """prj_switch: nested conditional as one CASE WHEN chain."""
    expr = None
    for cond, val in pairs:
        v = val if isinstance(val, Column) else F.lit(val)
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    o = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return expr.otherwise(o)


def map_codes(df: DataFrame, col: str, mapping: DataFrame, code: str, label: str,
              out: str) -> DataFrame:
    """prj_map: code -> label through a (small, size-checked) mapping frame;
    unknown codes stay null rather than dropping the row."""
    from plumbline.operators.joins import broadcast_bounded
    m = mapping.select(F.col(code).alias("__code"), F.col(label).alias(out))
    return (df.join(broadcast_bounded(m, 1_000_000), F.col(col) == F.col("__code"), "left")
            .drop("__code"))
