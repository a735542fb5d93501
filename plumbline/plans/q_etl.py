"""§2.15 ETL derivations of warehouse-style tables from the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import etl as T
from plumbline.plans.rehearsal import AS_OF, JOB_SQL, SPELL_SQL, job_changes, snapshot_sql, spells, with_sql
from plumbline.plans.registry import query
from plumbline.session import scratch_path
from plumbline.sources.tables import Tables, write_table

FIRST, LAST = dt.date(1996, 1, 1), dt.date(2000, 12, 31)


@query("etl_snapshot", with_sql(SPELL_SQL, snapshot_sql("1996-01-01", "2000-12-01")) + """
SELECT month_end, unit, count(*) AS n_rows FROM snap GROUP BY month_end, unit""")
def etl_snapshot(spark, sf):
    """Spells -> month-end snapshot rows, written partitioned by month-end
    (so a point-in-time read is partition pruning) and read back."""
    snap = T.etl_snapshot(spells(Tables(spark, sf)), "k", "hire", "sep", FIRST, LAST) \
        .select("k", "unit", "wtype", "month_end")
    path = scratch_path(spark, "snapshot")
    write_table(snap.repartition("month_end"), path, partition_by=("month_end",))
    back = spark.read.parquet(path)
    return back.groupBy(F.col("month_end").cast("date").alias("month_end"), "unit").agg(F.count("*").alias("n_rows"))


@query("etl_history", with_sql(JOB_SQL) + """
SELECT k, ref, start, coalesce(CAST(lead(start) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end,
       lead(start) OVER w IS NULL AS is_current,
       CASE WHEN row_number() OVER w = 1 THEN 'Hire' ELSE 'Change' END AS change_reason, unit_code
FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref)""")
def etl_history(spark, sf):
    h = T.etl_history(job_changes(Tables(spark, sf)), "k", "start", "ref")
    return h.select("k", "ref", "start", "effective_end", "is_current", "change_reason", "unit_code")


@query("etl_status", with_sql(SPELL_SQL) + """
SELECT k, CASE WHEN sep IS NOT NULL AND sep <= DATE '2000-12-31' THEN 'Terminated'
               WHEN bal < 0 THEN 'On Leave' ELSE 'Active' END AS employment_status FROM spell""")
def etl_status(spark, sf):
    s = spells(Tables(spark, sf))
    return T.etl_status(s, "sep", F.col("bal") < 0, dt.date(2000, 12, 31)).select("k", "employment_status")


@query("etl_person_link", with_sql(JOB_SQL) + """
, g AS (SELECT *, date_diff('day', lag(start) OVER w, start) AS gap_days FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref))
SELECT k, ref, gap_days, sum(CASE WHEN gap_days IS NULL OR gap_days > 365 THEN 1 ELSE 0 END)
         OVER (PARTITION BY k ORDER BY start, ref ROWS UNBOUNDED PRECEDING) AS spell_no,
       sum(CASE WHEN gap_days IS NULL OR gap_days > 365 THEN 1 ELSE 0 END)
         OVER (PARTITION BY k ORDER BY start, ref ROWS UNBOUNDED PRECEDING) > 1 AS returner FROM g""")
def etl_person_link(spark, sf):
    """Orders of one customer grouped into spells (a gap over 365 days opens a
    new spell): spell number, gap days, returner flag."""
    j = T.etl_person_link(job_changes(Tables(spark, sf)), "k", "start", "ref", 365)
    return j.select("k", "ref", F.col("gap_days").cast("long").alias("gap_days"), "spell_no", "returner")


@query("etl_eligibility", with_sql(SPELL_SQL) + """
SELECT k, CAST(hire + INTERVAL 1095 DAY AS DATE) AS eligible_date FROM spell
WHERE hire + INTERVAL 1095 DAY <= DATE '2001-06-30' AND (sep IS NULL OR sep > hire + INTERVAL 1095 DAY)""")
def etl_eligibility(spark, sf):
    return T.etl_eligibility(spells(Tables(spark, sf)), "hire", "sep", 1095, AS_OF).select("k", "eligible_date")


@query("etl_regrettable", with_sql(SPELL_SQL) + """
SELECT k, CASE WHEN sep IS NULL THEN NULL ELSE (bal >= 0 AND CAST(substr(prio, 1, 1) AS INTEGER) >= 3) END AS is_regrettable
FROM spell""")
def etl_regrettable(spark, sf):
    """Regrettable = voluntary exit (rehearsal: non-negative balance) of a
    tier >= 3 performer (tier = first digit of the priority); null when no exit."""
    s = spells(Tables(spark, sf)).withColumn(
        "sep_type", F.when(F.col("sep").isNotNull(), F.when(F.col("bal") >= 0, "Voluntary").otherwise("Involuntary"))) \
        .withColumn("tier", F.substring("prio", 1, 1).cast("int"))
    return T.etl_regrettable(s, "sep_type", "tier").select("k", "is_regrettable")


WAVES = [("W1997", dt.date(1997, 6, 30)), ("W1998", dt.date(1998, 6, 30)), ("W1999", dt.date(1999, 6, 30)),
         ("W2000", dt.date(2000, 6, 30))]


@query("etl_eligible_pool", with_sql(SPELL_SQL) + """
, w AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', DATE '{d}')" for n, d in WAVES) + """) v(wave, wave_date))
SELECT wave, count(*) AS eligible FROM spell, w
WHERE hire <= wave_date AND (sep IS NULL OR sep > wave_date) GROUP BY wave""")
def etl_eligible_pool(spark, sf):
    """Who could respond at each survey wave (hired before, not yet out); the
    wave list is exploded per spell (a Generate), no theta join."""
    p = T.etl_eligible_pool(spells(Tables(spark, sf)), "hire", "sep", WAVES)
    return p.groupBy("wave").agg(F.count("*").alias("eligible"))


@query("etl_current_view", with_sql(SPELL_SQL, snapshot_sql("1996-01-01", "2000-12-01")) + """
, s AS (SELECT *, CASE WHEN bal < 0 THEN 'On Leave' ELSE 'Active' END AS status FROM snap)
SELECT k, unit, status FROM s WHERE month_end = (SELECT max(month_end) FROM s) AND status IN ('Active', 'On Leave')""")
def etl_current_view(spark, sf):
    snap = T.etl_snapshot(spells(Tables(spark, sf)), "k", "hire", "sep", FIRST, LAST) \
        .withColumn("status", F.when(F.col("bal") < 0, "On Leave").otherwise("Active"))
    return T.etl_current_view(snap, "month_end", "status", ["Active", "On Leave"]).select("k", "unit", "status")


@query("etl_rollup", with_sql(SPELL_SQL, snapshot_sql("1996-01-01", "2000-12-01")) + """
SELECT month_end, unit, count(*) AS headcount FROM snap WHERE month_end <= DATE '2000-06-30' GROUP BY 1, 2""")
def etl_rollup(spark, sf):
    """A date x unit rollup that stops at a cut date (the stale rollup)."""
    snap = T.etl_snapshot(spells(Tables(spark, sf)), "k", "hire", "sep", FIRST, LAST)
    return T.etl_rollup(snap, "month_end", ["unit"], dt.date(2000, 6, 30))
