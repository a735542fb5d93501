"""Rehearsal views: give the driver's star tables the roles the operators need.

One person = one customer; a spell runs from the first to the last order up to
the as-of date; a spell whose last order is a year or more before the as-of
date is "separated" on that last order date. Unit = nation, location = region,
worker type = market segment, leave flag = negative account balance, FTE =
0.5 for the HOUSEHOLD segment, stratum ("tier") = priority of the first order,
"program" = an urgent order in 1996.

Each Spark builder has its DuckDB twin (``*_SQL``) used by the oracles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.dates import in_year
from plumbline.operators.joins import broadcast_bounded
from plumbline.sources.tables import Tables

# Fixed values of the rehearsal mapping.
AS_OF = dt.date(2001, 6, 30)
SEP_CUT = dt.date(2000, 6, 30)
AS_OF_SQL = "DATE '2001-06-30'"


def spells(t: Tables) -> DataFrame:
    """(k, wtype, unit, loc, hire, last, sep, prio, treated) -- one row per person.

    Orders are aggregated to the customer grain *before* the customer join, so
    the large side is reduced map-side (partial aggregation) and the join runs
    at customer grain; nation/region are broadcast behind a row-count check."""
    o = (t.orders.where(F.col("o_orderdate") <= F.lit(dt.date(2001, 6, 30)))
         .select("o_custkey", "o_orderkey", "o_orderpriority",
                 F.col("o_orderdate").cast("date").alias("d")))
    per_cust = o.groupBy("o_custkey").agg(
        F.min("d").alias("hire"), F.max("d").alias("last"),
        F.min_by("o_orderpriority", "o_orderkey").alias("prio"),
        F.max(F.when((F.col("o_orderpriority") == "1-URGENT") & in_year("d", 1996), 1)
              .otherwise(0)).alias("treated"))
    geo = (broadcast_bounded(t.nation, 10_000)
           .join(broadcast_bounded(t.region, 10_000),
                 F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", F.col("n_name").alias("unit"), F.col("r_name").alias("loc")))
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("wtype"),
                          "c_nationkey", F.col("c_acctbal").alias("bal"))
    return (c.join(per_cust, c.k == per_cust.o_custkey)
            .join(broadcast_bounded(geo, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("k", "wtype", "unit", "loc", "hire", "last",
                    F.when(F.col("last") < F.lit(SEP_CUT), F.col("last")).alias("sep"),
                    "prio", "treated", "bal",
                    F.when(F.col("wtype") == "HOUSEHOLD", 0.5).otherwise(1.0).alias("fte")))


SPELL_SQL = """spell AS (
  SELECT c_custkey AS k, c_mktsegment AS wtype, n_name AS unit, r_name AS loc,
         CAST(min(o_orderdate) AS DATE) AS hire, CAST(max(o_orderdate) AS DATE) AS last,
         CASE WHEN CAST(max(o_orderdate) AS DATE) < DATE '2000-06-30'
              THEN CAST(max(o_orderdate) AS DATE) END AS sep,
         min_by(o_orderpriority, o_orderkey) AS prio,
         max(CASE WHEN o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996
                  THEN 1 ELSE 0 END) AS treated,
         c_acctbal AS bal,
         CAST(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS fte
  FROM customer JOIN orders ON o_custkey = c_custkey
       JOIN nation ON n_nationkey = c_nationkey
       JOIN region ON r_regionkey = n_regionkey
  WHERE o_orderdate <= TIMESTAMP '2001-06-30'
  GROUP BY c_custkey, c_mktsegment, n_name, r_name, c_acctbal)"""


def status_at(d: dt.date):
    """etl_status on the rehearsal spells: Terminated once out, On Leave for a
    negative balance (the rehearsal's leave flag), else Active."""
    return (F.when(F.col("sep").isNotNull() & (F.col("sep") <= F.lit(d)), "Terminated")
            .when(F.col("bal") < 0, "On Leave").otherwise("Active"))


def status_sql(d: str) -> str:
    return (f"CASE WHEN sep IS NOT NULL AND sep <= DATE '{d}' THEN 'Terminated' "
            f"WHEN bal < 0 THEN 'On Leave' ELSE 'Active' END")


def alive_at(d: dt.date, hire: str = "hire", sep: str = "sep"):
    """Spell covers month-end/date ``d``: entered on or before it, not yet out."""
    return (F.col(hire) <= F.lit(d)) & (F.col(sep).isNull() | (F.col(sep) > F.lit(d)))


def alive_sql(d: str, hire: str = "hire", sep: str = "sep") -> str:
    return f"({hire} <= DATE '{d}' AND ({sep} IS NULL OR {sep} > DATE '{d}'))"


def job_changes(t: Tables) -> DataFrame:
    """Orders as job-change records: (k, start, ref, unit_code, amount).

    ``unit_code`` (the order priority) plays the changing organisational unit;
    ties on date are broken by ``ref`` (the order key)."""
    return t.orders.select(F.col("o_custkey").alias("k"),
                           F.col("o_orderdate").cast("date").alias("start"),
                           F.col("o_orderkey").alias("ref"),
                           F.col("o_orderpriority").alias("unit_code"),
                           F.col("o_totalprice").alias("amount"))


JOB_SQL = """jobs AS (
  SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS start, o_orderkey AS ref,
         o_orderpriority AS unit_code, o_totalprice AS amount FROM orders)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# The survey rehearsal switches from a 5-point to a 7-point scale
# on 2024-01-16; the response is 1 + (k mod scale) with k from the event props.
SCALE_BREAK = dt.date(2024, 1, 16)


def survey(t: Tables) -> DataFrame:
    """Events as survey responses: (user_id, item, wave, scale_max, value, ts)."""
    e = t.events
    late = F.col("ts") >= F.lit(SCALE_BREAK)
    scale = F.when(late, 7).otherwise(5)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("user_id", F.col("event_type").alias("item"),
                    F.when(late, "W2").otherwise("W1").alias("wave"),
                    scale.alias("scale_max"), (1 + k % scale).alias("value"), "ts")


SURVEY_SQL = """survey AS (
  SELECT user_id, event_type AS item,
         CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 'W2' ELSE 'W1' END AS wave,
         CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 7 ELSE 5 END AS scale_max,
         1 + CAST(json_extract_string(props, '$.k') AS INTEGER)
             % (CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN 7 ELSE 5 END) AS value, ts
  FROM events)"""


def snapshot(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """etl_snapshot on the rehearsal spells: one row per spell per month-end in
    [first, last] while the spell is live (hire <= m and not sep <= m)."""
    from plumbline.operators.etl import etl_snapshot
    return etl_snapshot(spells(t), "k", "hire", "sep", first, last)


def snapshot_sql(first: str, last: str) -> str:
    return f"""months AS (
  SELECT last_day(CAST(m AS DATE)) AS month_end
  FROM generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH) g(m)),
snap AS (
  SELECT s.*, month_end FROM spell s JOIN months
    ON s.hire <= month_end AND (s.sep IS NULL OR s.sep > month_end))"""
