"""§2.8 core metrics on the rehearsal views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions.dates import in_year
from plumbline.functions.stats import safe_div
from plumbline.operators import metrics as M
from plumbline.operators.etl import etl_person_link
from plumbline.operators.population import Population
from plumbline.plans.rehearsal import (AS_OF, SPELL_SQL, SURVEY_SQL, alive_at, alive_sql,
                                       job_changes, snapshot, snapshot_sql, spells,
                                       status_at, status_sql, survey, with_sql)
from plumbline.plans.registry import query
from plumbline.session import materialize_small
from plumbline.sources.tables import Tables

D = dt.date(2000, 12, 31)
DS = "2000-12-31"
POP_TEXT = "alive at 2000-12-31; all segments; unit = customer"


@query("m_headcount", with_sql(SPELL_SQL) + f"""
SELECT count(DISTINCT k) AS headcount, sum(fte) AS weighted_headcount,
       '{POP_TEXT}' AS population
FROM spell WHERE {alive_sql(DS)}""")
def m_headcount(spark, sf):
    s = spells(Tables(spark, sf))
    return M.m_headcount(s, Population(alive_at(D), "k", POP_TEXT), weight="fte")


def _variants():
    alive, st = alive_at(D), status_at(D)
    return {"canonical": alive & (F.col("wtype") == "BUILDING") & st.isin("Active", "On Leave"),
            "canonical_excl_leave": alive & (F.col("wtype") == "BUILDING") & (st == "Active"),
            "all_types": alive}


_VAR_SQL = with_sql(SPELL_SQL, f"s2 AS (SELECT *, {status_sql(DS)} AS st FROM spell)") + f"""
SELECT 'canonical' AS variant,
       count(DISTINCT CASE WHEN {alive_sql(DS)} AND wtype = 'BUILDING' AND st IN ('Active','On Leave') THEN k END) AS headcount,
       CAST(sum(CASE WHEN {alive_sql(DS)} AND wtype = 'BUILDING' AND st IN ('Active','On Leave') THEN fte END) AS DOUBLE) AS weighted_headcount
FROM s2
UNION ALL
SELECT 'canonical_excl_leave',
       count(DISTINCT CASE WHEN {alive_sql(DS)} AND wtype = 'BUILDING' AND st = 'Active' THEN k END),
       CAST(sum(CASE WHEN {alive_sql(DS)} AND wtype = 'BUILDING' AND st = 'Active' THEN fte END) AS DOUBLE)
FROM s2
UNION ALL
SELECT 'all_types', count(DISTINCT CASE WHEN {alive_sql(DS)} THEN k END),
       CAST(sum(CASE WHEN {alive_sql(DS)} THEN fte END) AS DOUBLE)
FROM s2"""



@query("m_headcount_variants", _VAR_SQL)
def m_headcount_variants(spark, sf):
    return M.m_headcount_variants(spells(Tables(spark, sf)), "k", _variants(), weight="fte")


@query("m_headcount_by", with_sql(SPELL_SQL) + f"""
SELECT unit, count(DISTINCT k) AS headcount,
       (SELECT count(DISTINCT k) FROM spell WHERE {alive_sql(DS)}) AS total_headcount,
       n_nationkey
FROM spell JOIN nation ON n_name = unit
WHERE {alive_sql(DS)} GROUP BY unit, n_nationkey""")
def m_headcount_by(spark, sf):
    t = Tables(spark, sf)
    return M.m_headcount_by(spells(t), Population(alive_at(D), "k", POP_TEXT), "unit",
                            dim=t.nation, dim_key="n_name", label="n_nationkey")


@query("m_headcount_trend", with_sql(SPELL_SQL, snapshot_sql("1996-01-01", "2000-12-01")) + """
SELECT month_end, count(DISTINCT k) AS headcount FROM snap GROUP BY month_end""")
def m_headcount_trend(spark, sf):
    snap = snapshot(Tables(spark, sf), dt.date(1996, 1, 1), dt.date(2000, 12, 31))
    return M.m_headcount_trend(snap, "month_end", "k")


@query("m_avg_headcount", with_sql(SPELL_SQL, snapshot_sql("1998-12-01", "1999-12-01")) + """
SELECT count(DISTINCT CASE WHEN month_end = DATE '1998-12-31' THEN k END) AS begin_headcount,
       count(DISTINCT CASE WHEN month_end = DATE '1999-12-31' THEN k END) AS end_headcount,
       (count(DISTINCT CASE WHEN month_end = DATE '1998-12-31' THEN k END)
        + count(DISTINCT CASE WHEN month_end = DATE '1999-12-31' THEN k END)) / 2.0 AS avg_begin_end,
       round(CAST(count(CASE WHEN month_end > DATE '1998-12-31' THEN 1 END) AS DOUBLE)
             / count(DISTINCT CASE WHEN month_end > DATE '1998-12-31' THEN month_end END), 6)
         AS avg_month_ends,
       count(DISTINCT CASE WHEN month_end > DATE '1998-12-31' THEN month_end END) AS n_month_ends
FROM snap""")
def m_avg_headcount(spark, sf):
    """Average headcount for 1999 under both definitions, named: (begin+end)/2
    and the mean of the twelve month-end counts."""
    snap = snapshot(Tables(spark, sf), dt.date(1998, 12, 1), dt.date(1999, 12, 31))
    b, e = F.lit(dt.date(1998, 12, 31)), F.lit(dt.date(1999, 12, 31))
    inyr = F.col("month_end") > b
    return snap.agg(
        F.count_distinct(F.when(F.col("month_end") == b, F.col("k"))).alias("begin_headcount"),
        F.count_distinct(F.when(F.col("month_end") == e, F.col("k"))).alias("end_headcount"),
        F.count_if(inyr).alias("__rows"),
        F.count_distinct(F.when(inyr, F.col("month_end"))).alias("n_month_ends"),
    ).select("begin_headcount", "end_headcount",
             ((F.col("begin_headcount") + F.col("end_headcount")) / 2.0).alias("avg_begin_end"),
             F.round(safe_div("__rows", "n_month_ends"), 6).alias("avg_month_ends"),
             "n_month_ends")


STALE = dt.date(2000, 6, 30)


@query("m_source_panel", with_sql(SPELL_SQL, f"s2 AS (SELECT *, {status_sql(DS)} AS st FROM spell)") + f"""
, c AS (SELECT count(DISTINCT k) AS v FROM s2
        WHERE {alive_sql(DS)} AND wtype = 'BUILDING' AND st IN ('Active','On Leave'))
SELECT source, value, (SELECT v FROM c) AS canonical_value,
       value - (SELECT v FROM c) AS difference, reason FROM (
  SELECT 'canonical' AS source, (SELECT v FROM c) AS value,
         'distinct persons, BUILDING, Active or On Leave, alive at 2000-12-31' AS reason
  UNION ALL
  SELECT 'all_types', (SELECT count(*) FROM spell WHERE {alive_sql(DS)}),
         'every segment counted, not only BUILDING'
  UNION ALL
  SELECT 'stale_rollup', (SELECT count(*) FROM spell WHERE {alive_sql('2000-06-30')}),
         'rollup last refreshed 2000-06-30'
  UNION ALL
  SELECT 'job_rows', (SELECT count(*) FROM orders WHERE o_orderdate <= TIMESTAMP '2000-12-31'),
         'change records, not persons') x""")
def m_source_panel(spark, sf):
    """The same concept from four sources: three read the spell view, so they
    are computed in one conditional aggregate (materialised once, then each
    candidate is a projection of it); the change-record count scans orders."""
    t = Tables(spark, sf)
    s = spells(t)
    canon = alive_at(D) & (F.col("wtype") == "BUILDING") & status_at(D).isin("Active", "On Leave")
    one = materialize_small(s.agg(F.count_distinct(F.when(canon, F.col("k"))).alias("canonical"),
                                  F.count_if(alive_at(D)).alias("all_types"),
                                  F.count_if(alive_at(STALE)).alias("stale_rollup")))
    cands = [
        ("canonical", one.select("canonical"),
         "distinct persons, BUILDING, Active or On Leave, alive at 2000-12-31"),
        ("all_types", one.select("all_types"), "every segment counted, not only BUILDING"),
        ("stale_rollup", one.select("stale_rollup"), "rollup last refreshed 2000-06-30"),
        ("job_rows", t.orders.where(F.col("o_orderdate") <= F.lit(dt.date(2000, 12, 31)))
         .select(F.count("*")), "change records, not persons"),
    ]
    return M.m_source_panel(cands, "canonical")


@query("m_attrition", with_sql(SPELL_SQL) + f"""
SELECT count(DISTINCT CASE WHEN sep >= DATE '1999-01-01' AND sep < DATE '2000-01-01' THEN k END) AS separations,
       count(DISTINCT CASE WHEN {alive_sql('1998-12-31')} THEN k END) AS beginning_headcount,
       count(DISTINCT CASE WHEN {alive_sql('1999-12-31')} THEN k END) AS ending_headcount,
       (count(DISTINCT CASE WHEN {alive_sql('1998-12-31')} THEN k END)
        + count(DISTINCT CASE WHEN {alive_sql('1999-12-31')} THEN k END)) / 2.0 AS average_headcount,
       round(100.0 * count(DISTINCT CASE WHEN sep >= DATE '1999-01-01' AND sep < DATE '2000-01-01' THEN k END)
             / count(DISTINCT CASE WHEN {alive_sql('1998-12-31')} THEN k END), 6) AS rate_on_beginning_pct,
       round(100.0 * count(DISTINCT CASE WHEN sep >= DATE '1999-01-01' AND sep < DATE '2000-01-01' THEN k END)
             / ((count(DISTINCT CASE WHEN {alive_sql('1998-12-31')} THEN k END)
                 + count(DISTINCT CASE WHEN {alive_sql('1999-12-31')} THEN k END)) / 2.0), 6) AS rate_on_average_pct,
       round(100.0 * count(DISTINCT CASE WHEN sep >= DATE '1999-01-01' AND sep < DATE '2000-01-01' THEN k END)
             / count(DISTINCT CASE WHEN {alive_sql('1999-12-31')} THEN k END), 6) AS rate_on_ending_pct
FROM spell""")
def m_attrition(spark, sf):
    s = spells(Tables(spark, sf))
    return M.m_attrition(s, "k", "sep", (dt.date(1999, 1, 1), dt.date(2000, 1, 1)),
                         alive_at(dt.date(1998, 12, 31)), alive_at(dt.date(1999, 12, 31)))


def _sep_type():
    return F.when(F.col("bal") >= 0, "Voluntary").otherwise("Involuntary")


@query("m_attrition_defs", with_sql(SPELL_SQL) + f"""
, base AS (
  SELECT *, CASE WHEN bal >= 0 THEN 'Voluntary' ELSE 'Involuntary' END AS sep_type,
         CAST(substr(prio, 1, 1) AS INTEGER) AS tier,
         sep >= DATE '2000-01-01' AND sep < DATE '2000-07-01' AS in_period FROM spell),
den AS (SELECT (count(CASE WHEN {alive_sql('1999-12-31')} THEN 1 END)
               + count(CASE WHEN {alive_sql('2000-06-30')} THEN 1 END)) / 2.0 AS avg_hc FROM spell),
d AS (
  SELECT 'all' AS definition, count(CASE WHEN in_period THEN 1 END) AS separations FROM base
  UNION ALL SELECT 'voluntary', count(CASE WHEN in_period AND sep_type = 'Voluntary' THEN 1 END) FROM base
  UNION ALL SELECT 'involuntary', count(CASE WHEN in_period AND sep_type = 'Involuntary' THEN 1 END) FROM base
  UNION ALL SELECT 'regrettable', count(CASE WHEN in_period AND sep_type = 'Voluntary' AND tier >= 3 THEN 1 END) FROM base)
SELECT definition, separations, avg_hc AS average_headcount, 182 AS period_days,
       round(100.0 * separations / avg_hc, 6) AS period_rate_pct,
       round(100.0 * separations / avg_hc * 365.0 / 182, 6) AS annualised_rate_pct
FROM d, den""")
def m_attrition_defs(spark, sf):
    s = spells(Tables(spark, sf)).withColumn("sep_type", _sep_type()) \
        .withColumn("tier", F.substring("prio", 1, 1).cast("int"))
    return M.m_attrition_defs(
        s, "sep", {"all": F.lit(True),
                   "voluntary": F.col("sep_type") == "Voluntary",
                   "involuntary": F.col("sep_type") == "Involuntary",
                   "regrettable": (F.col("sep_type") == "Voluntary") & (F.col("tier") >= 3)},
        (dt.date(2000, 1, 1), dt.date(2000, 7, 1)),
        begin=alive_at(dt.date(1999, 12, 31)), end=alive_at(dt.date(2000, 6, 30)))


@query("m_attrition_month", with_sql(SPELL_SQL, snapshot_sql("1995-01-01", "2000-06-01")) + """
, seps AS (SELECT last_day(sep) AS month_end, unit, count(*) AS separations
           FROM spell WHERE sep IS NOT NULL GROUP BY 1, 2),
hc AS (SELECT month_end, unit, count(*) AS hc FROM snap GROUP BY 1, 2)
SELECT s.month_end, s.unit, s.separations, h.hc AS start_headcount,
       round(100.0 * s.separations / NULLIF(h.hc, 0), 6) AS rate_pct
FROM seps s LEFT JOIN hc h
  ON h.unit = s.unit AND h.month_end = last_day(s.month_end - INTERVAL 1 MONTH)""")
def m_attrition_month(spark, sf):
    t = Tables(spark, sf)
    s = spells(t)
    snap = snapshot(t, dt.date(1995, 1, 1), dt.date(2000, 6, 30))
    return M.m_attrition_month(s.where(F.col("sep").isNotNull()), "sep", snap, "month_end", ["unit"])


@query("m_people_ever", """
SELECT count(DISTINCT o_orderkey) AS distinct_records, count(DISTINCT o_custkey) AS distinct_persons,
       count(DISTINCT o_orderkey) - count(DISTINCT o_custkey) AS duplicates FROM orders""")
def m_people_ever(spark, sf):
    j = job_changes(Tables(spark, sf))
    return M.m_people_ever(j, "ref", "k")


@query("m_tenure", """
WITH o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS start, o_orderkey AS ref
           FROM orders WHERE o_orderdate <= TIMESTAMP '2001-06-30'),
g AS (SELECT *, date_diff('day', lag(start) OVER w, start) AS gap
      FROM o WINDOW w AS (PARTITION BY k ORDER BY start, ref)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 365 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY k ORDER BY start, ref ROWS UNBOUNDED PRECEDING) AS spell_no FROM g),
p AS (SELECT k, spell_no, min(start) AS s0 FROM s GROUP BY k, spell_no)
SELECT k, CAST(max(spell_no) AS BIGINT) AS n_spells,
       date_diff('day', max(s0), DATE '2001-06-30') AS current_spell_days,
       date_diff('day', min(s0), DATE '2001-06-30') AS service_days,
       max(spell_no) > 1 AS returner
FROM p GROUP BY k""")
def m_tenure(spark, sf):
    j = job_changes(Tables(spark, sf)).where(F.col("start") <= F.lit(AS_OF))
    linked = etl_person_link(j, "k", "start", "ref", 365)
    return M.m_tenure(linked, "k", "start", "spell_no", AS_OF)


@query("m_dist", """
SELECT o_orderstatus, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean,
       CASE WHEN count(o_totalprice) >= 5 THEN round(quantile_cont(o_totalprice, 0.5), 6) END AS median,
       CASE WHEN count(o_totalprice) >= 5 THEN round(quantile_cont(o_totalprice, 0.25), 6) END AS p25,
       CASE WHEN count(o_totalprice) >= 5 THEN round(quantile_cont(o_totalprice, 0.75), 6) END AS p75,
       round(stddev_samp(o_totalprice), 6) AS sd,
       round(avg(o_totalprice) - quantile_cont(o_totalprice, 0.5), 6) AS mean_minus_median
FROM orders GROUP BY o_orderstatus""")
def m_dist(spark, sf):
    return M.m_dist(Tables(spark, sf).orders, "o_totalprice", ["o_orderstatus"])


def currency_of(region_col: str = "r_name"):
    """Fixed rehearsal values: the region decides the pay currency."""
    r = F.col(region_col)
    return F.when(r == "EUROPE", "EUR").when(r == "ASIA", "SGD").otherwise("USD")


CURRENCY_SQL = "CASE WHEN r_name = 'EUROPE' THEN 'EUR' WHEN r_name = 'ASIA' THEN 'SGD' ELSE 'USD' END"


@query("m_comp_by_currency", f"""
SELECT {CURRENCY_SQL} AS currency_code, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean,
       CASE WHEN count(c_acctbal) >= 5 THEN round(quantile_cont(c_acctbal, 0.5), 6) END AS median,
       CASE WHEN count(c_acctbal) >= 5 THEN round(quantile_cont(c_acctbal, 0.25), 6) END AS p25,
       CASE WHEN count(c_acctbal) >= 5 THEN round(quantile_cont(c_acctbal, 0.75), 6) END AS p75,
       round(stddev_samp(c_acctbal), 6) AS sd,
       round(avg(c_acctbal) - quantile_cont(c_acctbal, 0.5), 6) AS mean_minus_median
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
GROUP BY 1""")
def m_comp_by_currency(spark, sf):
    """Pay-like amounts summarised per currency, never pooled across them."""
    from plumbline.operators.joins import broadcast_bounded
    t = Tables(spark, sf)
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = (t.customer.join(broadcast_bounded(geo, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
         .withColumn("currency_code", currency_of()))
    return M.m_dist(c, "c_acctbal", ["currency_code"])


@query("m_share", """
SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS num,
       count(*) AS den,
       round(100.0 * sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) / count(*), 6) AS share_pct
FROM orders GROUP BY o_orderstatus""")
def m_share(spark, sf):
    return M.m_share(Tables(spark, sf).orders, F.col("o_orderpriority") == "1-URGENT", ["o_orderstatus"])


@query("m_wave", with_sql(SURVEY_SQL) + """
SELECT item, wave, scale_max, round(avg(value), 6) AS mean, count(*) AS n
FROM survey GROUP BY item, wave, scale_max""")
def m_wave(spark, sf):
    return M.m_wave(survey(Tables(spark, sf)), "item", "value", "scale_max", "wave")


@query("m_wave_rescaled", with_sql(SURVEY_SQL) + """
, g AS (SELECT item, wave, scale_max, round(avg(value), 6) AS raw_mean,
               round(avg((value - 1.0) / (scale_max - 1)), 6) AS rescaled_mean, count(*) AS n
        FROM survey GROUP BY item, wave, scale_max)
SELECT g.*, count(DISTINCT scale_max) OVER (PARTITION BY item) AS scales_in_item,
       count(DISTINCT scale_max) OVER (PARTITION BY item) = 1 AS raw_trend_valid FROM g""")
def m_wave_rescaled(spark, sf):
    return M.m_wave_rescaled(survey(Tables(spark, sf)), "item", "value", "scale_max", "wave")


WAVES_SQL = """waves AS (SELECT * FROM (VALUES ('W1', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16'),
                                  ('W2', TIMESTAMP '2024-01-16', TIMESTAMP '2024-02-01')) w(wave, w_lo, w_hi)),
users AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id)"""


@query("m_response_rate", with_sql(SURVEY_SQL, WAVES_SQL) + """
, el AS (SELECT wave, count(DISTINCT user_id) AS eligible FROM users, waves
         WHERE first_ts < w_hi AND last_ts >= w_lo GROUP BY wave),
r AS (SELECT wave, count(DISTINCT user_id) AS respondents FROM survey GROUP BY wave)
SELECT coalesce(el.wave, r.wave) AS wave, coalesce(respondents, 0) AS respondents,
       coalesce(eligible, 0) AS eligible,
       round(100.0 * coalesce(respondents, 0) / NULLIF(coalesce(eligible, 0), 0), 6) AS response_rate_pct
FROM el FULL OUTER JOIN r ON el.wave = r.wave""")
def m_response_rate(spark, sf):
    """Respondents per wave over those eligible: users whose activity span
    (first to last event) overlaps the wave window."""
    t = Tables(spark, sf)
    resp = survey(t)
    users = t.events.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    waves = [("W1", dt.date(2024, 1, 1), dt.date(2024, 1, 16)),
             ("W2", dt.date(2024, 1, 16), dt.date(2024, 2, 1))]
    arr = F.array(*[F.struct(F.lit(w).alias("wave"), F.lit(lo).alias("w_lo"), F.lit(hi).alias("w_hi"))
                    for w, lo, hi in waves])
    elig = (users.withColumn("__w", F.explode(arr)).select("user_id", "__w.*")
            .where((F.col("first_ts") < F.col("w_hi")) & (F.col("last_ts") >= F.col("w_lo"))))
    return M.m_response_rate(resp, elig, "wave", "user_id")


@query("m_composite", with_sql(SURVEY_SQL) + """
, im AS (SELECT user_id, wave, item, avg(value) AS m FROM survey GROUP BY ALL)
SELECT user_id, wave, count(*) AS n_items,
       CASE WHEN count(*) >= 3 THEN round(avg(m), 6) END AS composite
FROM im GROUP BY user_id, wave""")
def m_composite(spark, sf):
    return M.m_composite(survey(Tables(spark, sf)), "user_id", "wave", "item", "value", 3)


@query("m_representativeness", """
WITH s AS (SELECT c_mktsegment, count(*) AS n_sample FROM customer
           WHERE c_custkey IN (SELECT o_custkey FROM orders
                               WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2001-01-01')
           GROUP BY 1),
p AS (SELECT c_mktsegment, count(*) AS n_population FROM customer GROUP BY 1),
j AS (SELECT coalesce(p.c_mktsegment, s.c_mktsegment) AS c_mktsegment,
             coalesce(n_sample, 0) AS n_sample, coalesce(n_population, 0) AS n_population
      FROM p FULL OUTER JOIN s ON p.c_mktsegment = s.c_mktsegment)
SELECT c_mktsegment, n_sample, n_population,
       round(100.0 * n_sample / (SELECT sum(n_sample) FROM j), 6) AS sample_share_pct,
       round(100.0 * n_population / (SELECT sum(n_population) FROM j), 6) AS population_share_pct,
       round(100.0 * n_sample / (SELECT sum(n_sample) FROM j)
             - 100.0 * n_population / (SELECT sum(n_population) FROM j), 6) AS share_gap_pts
FROM j""")
def m_representativeness(spark, sf):
    """Customers active in 2000 (the 'respondents') vs all customers, by segment."""
    t = Tables(spark, sf)
    active = t.orders.where(in_year(F.col("o_orderdate").cast("date"), 2000)).select(
        F.col("o_custkey").alias("c_custkey"))
    sample = t.customer.join(active, "c_custkey", "left_semi")
    return M.m_representativeness(sample, t.customer, "c_mktsegment")


@query("m_outliers", """
WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
f AS (SELECT o_orderpriority, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT o.o_orderpriority, round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence,
       count(o_totalprice) AS n,
       count(CASE WHEN NOT (o_totalprice >= lo_fence AND o_totalprice <= hi_fence) THEN 1 END) AS n_outside,
       round(avg(o_totalprice), 6) AS mean_all,
       round(avg(CASE WHEN o_totalprice >= lo_fence AND o_totalprice <= hi_fence THEN o_totalprice END), 6) AS mean_trimmed
FROM orders o JOIN f ON f.o_orderpriority = o.o_orderpriority GROUP BY ALL""")
def m_outliers(spark, sf):
    return M.m_outliers(Tables(spark, sf).orders, "o_totalprice", ["o_orderpriority"])
