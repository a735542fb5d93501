"""ETL derivations of the warehouse tables (§2.15) as DataFrame transforms."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sequence import keyed_window

OPEN_END = dt.date(9999, 12, 31)


def etl_snapshot(spells: DataFrame, key: str, entry: str, exit_: str, first: dt.date,
                 last: dt.date, name: str = "month_end") -> DataFrame:
    """Spells -> one row per entity per month-end in [first, last] while live.

    Each spell generates only its own month-ends (``explode(sequence)``), so the
    work is linear in output rows and no theta join against a calendar is
    planned. Live at m: entry <= m and not exit <= m."""
    lo = F.greatest(F.col(entry), F.lit(first))
    hi = F.least(F.coalesce(F.date_sub(F.col(exit_), 1), F.lit(last)), F.lit(last))
    f, l_ = F.trunc(lo, "MM"), F.trunc(hi, "MM")
    starts = F.when(l_ >= f, F.sequence(f, l_, F.expr("interval 1 month"))) \
        .otherwise(F.array().cast("array<date>"))
    # explode month starts, then last_day as a plain (codegen'd) expression
    return (spells.withColumn("__m0", F.explode(starts)).withColumn(name, F.last_day("__m0")).drop("__m0")
            .where((F.col(name) >= F.col(entry)) & (F.col(name) <= hi)
                   & (F.col(name) >= F.lit(first))))


def etl_history(changes: DataFrame, key: str, start: str, tiebreak: str,
                reason_first: str = "Hire", reason_other: str = "Change") -> DataFrame:
    """Dated changes -> effective-dated rows.

    end = next start - 1 day (9999-12-31 when open), ``is_current`` on the open
    row, change reason 'Hire' on the first row of each key. Ties on the start
    date are ordered by ``tiebreak``; a later same-day change closes the earlier
    one on the day before (a zero-length row, which a_effective reports).
    The per-key ordering is skew-safe (:func:`keyed_window`)."""
    h = keyed_window(changes, key, [start, tiebreak], lead=[start], row_number="entry_no")
    nxt = F.col(f"next_{start}")
    return (h.withColumn("effective_end", F.coalesce(F.date_sub(nxt, 1), F.lit(OPEN_END)))
            .withColumn("is_current", nxt.isNull())
            .withColumn("change_reason", F.when(F.col("entry_no") == 1, reason_first).otherwise(reason_other))
            .drop(f"next_{start}", "entry_no"))


def etl_status(df: DataFrame, exit_: str, leave: Column, as_of: dt.date,
               name: str = "employment_status") -> DataFrame:
    """Status as of a date: Terminated once the exit date has passed, On Leave
    when the leave flag holds, else Active."""
    d = F.lit(as_of)
    st = (F.when(F.col(exit_).isNotNull() & (F.col(exit_) <= d), "Terminated")
          .when(leave, "On Leave").otherwise("Active"))
    return df.withColumn(name, st)


def etl_person_link(events: DataFrame, person: str, start: str, tiebreak: str,
                    gap_days: int) -> DataFrame:
    """Group one person's dated rows into spells: a gap of more than
    ``gap_days`` starts a new spell. Adds spell_no, gap_days, returner flag.
    Two skew-safe ordered passes: the previous date, then a running count of
    spell starts."""
    x = keyed_window(events, person, [start, tiebreak], lag=[start])
    gap = F.datediff(F.col(start), F.col(f"prev_{start}"))
    x = x.withColumn("gap_days", gap) \
        .withColumn("new_spell", F.when(gap.isNull() | (gap > gap_days), 1).otherwise(0)) \
        .drop(f"prev_{start}")
    x = keyed_window(x, person, [start, tiebreak], running_sum={"spell_no": "new_spell"})
    return x.withColumn("returner", F.col("spell_no") > 1).drop("new_spell")


def etl_eligibility(spells: DataFrame, entry: str, exit_: str, days: int,
                    as_of: dt.date, name: str = "eligible_date") -> DataFrame:
    """Entities reaching ``days`` of tenure by ``as_of``, and the date they do;
    an exit before that date disqualifies."""
    reach = F.date_add(F.col(entry), days)
    ok = (reach <= F.lit(as_of)) & (F.col(exit_).isNull() | (F.col(exit_) > reach))
    return spells.where(ok).withColumn(name, reach)


def etl_regrettable(exits: DataFrame, type_col: str, tier: str, voluntary: str = "Voluntary",
                    min_tier: int = 3, name: str = "is_regrettable") -> DataFrame:
    """Voluntary exit of a tier >= min_tier performer; null when no exit type."""
    v = F.when(F.col(type_col).isNull(), F.lit(None).cast("boolean")) \
        .otherwise((F.col(type_col) == voluntary) & (F.col(tier) >= min_tier))
    return exits.withColumn(name, v)


def etl_eligible_pool(spells: DataFrame, entry: str, exit_: str,
                      waves: Sequence[tuple[str, dt.date]]) -> DataFrame:
    """(entity, wave) for every wave at which the entity was hired and not yet
    out; the wave list is exploded per row (a Generate), no theta join."""
    arr = F.array(*[F.struct(F.lit(n).alias("wave"), F.lit(d).alias("wave_date"))
                    for n, d in waves])
    x = spells.withColumn("__w", F.explode(arr)).select("*", "__w.*").drop("__w")
    return x.where((F.col(entry) <= F.col("wave_date"))
                   & (F.col(exit_).isNull() | (F.col(exit_) > F.col("wave_date"))))


def etl_current_view(snapshot: DataFrame, date: str, status: str,
                     statuses: Sequence[str]) -> DataFrame:
    """Rows at the latest snapshot date with the given statuses; the max date is
    a scalar subquery, so the equality pushes into the scan."""
    latest = snapshot.select(F.max(date)).scalar()
    return snapshot.where((F.col(date) == latest) & F.col(status).isin(list(statuses)))


def etl_rollup(snapshot: DataFrame, date: str, dims: Sequence[str], until: dt.date,
               name: str = "headcount") -> DataFrame:
    """Pre-aggregated date x dims counts up to a cut date (possibly stale)."""
    return (snapshot.where(F.col(date) <= F.lit(until)).groupBy(date, *dims)
            .agg(F.count("*").alias(name)))
