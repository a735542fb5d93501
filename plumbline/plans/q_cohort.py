"""§2.9 cohorts, retention, decomposition, funnel on the rehearsal views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions.dates import in_range, in_year
from plumbline.operators import cohort as C
from plumbline.plans.rehearsal import AS_OF, AS_OF_SQL, SPELL_SQL, spells, with_sql
from plumbline.plans.registry import query
from plumbline.plans.sqlfrag import hidden_sql
from plumbline.sources.tables import Tables

HORIZONS = [0, 12, 24, 36, 48, 60, 72]
H_SQL = "(SELECT unnest([0, 12, 24, 36, 48, 60, 72]) AS m)"
STAGES = ["view", "click", "signup", "purchase"]


def _cohort_1995(spark, sf):
    people = C.first_spell(spells(Tables(spark, sf)), "k", "hire", "sep")
    return people.where(in_year("hire", 1995))


@query("c_cohort", with_sql(SPELL_SQL) + """
SELECT cohort_year, cohort_size, make_date(CAST(cohort_year AS INTEGER), 12, 31) > DATE '2001-06-30' AS partial
FROM (SELECT CAST(year(hire) AS BIGINT) AS cohort_year, count(DISTINCT k) AS cohort_size
      FROM spell GROUP BY 1) x""")
def c_cohort(spark, sf):
    return C.c_cohort(spells(Tables(spark, sf)), "hire", "k", AS_OF)


@query("c_retention", with_sql(SPELL_SQL) + f"""
, hist AS (SELECT datediff('month', hire, coalesce(sep, {AS_OF_SQL})) AS mo, count(*) AS people, count(sep) AS gone
           FROM spell WHERE hire BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' GROUP BY mo),
cum AS (SELECT mo, sum(gone) OVER (ORDER BY mo) AS gone_by, sum(people) OVER (ORDER BY mo DESC) AS still FROM hist)
SELECT m AS horizon, CAST(coalesce(max(CASE WHEN mo >= m THEN still END), 0) AS BIGINT) AS at_risk,
       CAST(coalesce(max(CASE WHEN mo < m THEN gone_by END), 0) AS BIGINT) AS cumulative_events
FROM {H_SQL} h LEFT JOIN cum ON true GROUP BY m""")
def c_retention(spark, sf):
    return C.c_retention(_cohort_1995(spark, sf), "hire", "sep", AS_OF, HORIZONS)


@query("c_censor_flag", with_sql(SPELL_SQL) + f"""
, base AS (SELECT datediff('month', hire, DATE '2001-06-30') AS potential,
                  datediff('month', hire, coalesce(sep, DATE '2001-06-30')) AS months
           FROM spell WHERE year(hire) = 1995),
g AS (SELECT m AS horizon, count(*) AS cohort_size,
             count(CASE WHEN potential >= m THEN 1 END) AS n_could_reach,
             count(CASE WHEN months >= m THEN 1 END) AS at_risk
      FROM base, {H_SQL} h GROUP BY m)
SELECT *, n_could_reach < cohort_size AS censored,
       coalesce(at_risk < lag(at_risk) OVER (ORDER BY horizon) * 0.8, false) AS sharp_drop
FROM g""")
def c_censor_flag(spark, sf):
    return C.c_censor_flag(_cohort_1995(spark, sf), "hire", "sep", AS_OF, HORIZONS)


@query("c_competing", with_sql(SPELL_SQL) + f"""
, obs AS (SELECT datediff('month', hire, coalesce(sep, DATE '2001-06-30')) AS months,
                 sep IS NOT NULL AS separated,
                 CASE WHEN bal >= 0 THEN 'Voluntary' ELSE 'Involuntary' END AS t
          FROM spell WHERE year(hire) = 1995)
SELECT m AS horizon,
       count(CASE WHEN months >= m THEN 1 END) AS at_risk,
       count(CASE WHEN months < m AND separated AND t = 'Voluntary' THEN 1 END) AS events_voluntary,
       count(CASE WHEN months < m AND separated AND t = 'Involuntary' THEN 1 END) AS events_involuntary
FROM obs, {H_SQL} h GROUP BY m""")
def c_competing(spark, sf):
    s = spells(Tables(spark, sf)).where(in_year("hire", 1995)) \
        .withColumn("sep_type", F.when(F.col("bal") >= 0, "Voluntary").otherwise("Involuntary"))
    return C.c_competing(s, "hire", "sep", AS_OF, "sep_type", ["Voluntary", "Involuntary"], HORIZONS)


@query("c_km", with_sql(SPELL_SQL) + """
, p AS (SELECT CAST(year(hire) AS BIGINT) AS cohort_year,
               datediff('month', hire, coalesce(sep, DATE '2001-06-30')) AS months,
               CASE WHEN sep IS NOT NULL THEN 1 ELSE 0 END AS separated FROM spell),
h AS (SELECT cohort_year, months, count(*) AS n_exit_or_censor, sum(separated) AS events FROM p GROUP BY 1, 2),
h2 AS (SELECT *, sum(n_exit_or_censor) OVER (PARTITION BY cohort_year ORDER BY months DESC
                                             ROWS UNBOUNDED PRECEDING) AS n_at_risk FROM h),
h3 AS (SELECT *, 1 - events / n_at_risk AS q FROM h2)
SELECT cohort_year, CAST(months AS BIGINT) AS months, CAST(n_at_risk AS BIGINT) AS n_at_risk,
       CAST(events AS BIGINT) AS events,
       CASE WHEN max(CASE WHEN q <= 0 THEN 1 ELSE 0 END) OVER w = 1 THEN 0.0
            ELSE round(exp(sum(CASE WHEN q > 0 THEN ln(q) ELSE 0 END) OVER w), 6) END AS survival
FROM h3 WINDOW w AS (PARTITION BY cohort_year ORDER BY months ROWS UNBOUNDED PRECEDING)""")
def c_km(spark, sf):
    s = spells(Tables(spark, sf)).withColumn("cohort_year", F.year("hire").cast("long"))
    return C.c_km(s, "hire", "sep", AS_OF, group="cohort_year")


def _orders_9899(spark, sf):
    o = Tables(spark, sf).orders
    o = o.where(in_range("o_orderdate", dt.date(1998, 1, 1), dt.date(2000, 1, 1)))
    return o, F.year("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderstatus") == "F"


DECOMP_BASE_SQL = """WITH j AS (
  SELECT o_orderpriority AS stratum,
         count(CASE WHEN year(o_orderdate) = 1998 THEN 1 END) AS n0,
         count(CASE WHEN year(o_orderdate) = 1998 AND o_orderstatus = 'F' THEN 1 END) AS e0,
         count(CASE WHEN year(o_orderdate) = 1999 THEN 1 END) AS n1,
         count(CASE WHEN year(o_orderdate) = 1999 AND o_orderstatus = 'F' THEN 1 END) AS e1
  FROM orders WHERE year(o_orderdate) IN (1998, 1999) GROUP BY 1),
m AS (SELECT *, n0 / (SELECT sum(n0) FROM j) AS s0, n1 / (SELECT sum(n1) FROM j) AS s1,
             e0 / NULLIF(n0, 0) AS r0, e1 / NULLIF(n1, 0) AS r1 FROM j)
"""


@query("c_decompose", DECOMP_BASE_SQL + """
SELECT round(100 * sum(s0 * coalesce(r0, 0)), 6) AS base_pct,
       round(100 * sum(s1 * coalesce(r1, 0)), 6) AS actual_pct,
       round(100 * (sum(s1 * coalesce(r1, 0)) - sum(s0 * coalesce(r0, 0))), 6) AS change_pts,
       round(100 * sum(s0 * (coalesce(r1, 0) - coalesce(r0, 0))), 6) AS rate_effect,
       round(100 * sum((s1 - s0) * coalesce(r0, 0)), 6) AS mix_effect,
       round(100 * sum((s1 - s0) * (coalesce(r1, 0) - coalesce(r0, 0))), 6) AS interaction,
       count(*) AS strata, count(CASE WHEN n0 = 0 OR n1 = 0 THEN 1 END) AS strata_one_period_only
FROM m""")
def c_decompose(spark, sf):
    o, period, stratum, event = _orders_9899(spark, sf)
    return C.c_decompose(o, period, 1998, 1999, stratum, event)


@query("c_decompose_strata", DECOMP_BASE_SQL + hidden_sql("""
SELECT stratum, n0, n1, e0, e1, round(s0 * 100, 6) AS share0_pct, round(s1 * 100, 6) AS share1_pct,
       round(r0 * 100, 6) AS rate0_pct, round(r1 * 100, 6) AS rate1_pct,
       round(s0 * (coalesce(r1, 0) - coalesce(r0, 0)) * 100, 6) AS rate_contrib,
       round((s1 - s0) * coalesce(r0, 0) * 100, 6) AS mix_contrib,
       CASE WHEN least(n0, n1) < 5 THEN 'suppressed' WHEN least(n0, n1) < 30 THEN 'unstable'
            ELSE 'stable' END AS stability
FROM m""", ["stratum"], ["n0", "n1", "e0", "e1", "share0_pct", "share1_pct", "rate0_pct", "rate1_pct",
                                                                    "rate_contrib", "mix_contrib"]))
def c_decompose_strata(spark, sf):
    o, period, stratum, event = _orders_9899(spark, sf)
    return C.c_decompose_strata(o, period, 1998, 1999, stratum, event)


def _stage_sql(cut: bool) -> str:
    having = "HAVING min(ts) <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)" if cut else ""
    parts = [f"t1 AS (SELECT user_id, min(ts) AS t_1 FROM events WHERE event_type = 'view' "
             f"GROUP BY user_id {having})"]
    for i, s in enumerate(STAGES[1:], start=2):
        parts.append(f"t{i} AS (SELECT e.user_id, min(ts) AS t_{i} FROM events e "
                     f"JOIN t{i-1} p ON e.user_id = p.user_id "
                     f"WHERE event_type = '{s}' AND ts > t_{i-1} GROUP BY e.user_id)")
    parts.append("c AS (SELECT (SELECT count(*) FROM t1) AS n_1, (SELECT count(*) FROM t2) AS n_2, "
                 "(SELECT count(*) FROM t3) AS n_3, (SELECT count(*) FROM t4) AS n_4)")
    return "WITH " + ",\n".join(parts) + "\n"


@query("c_funnel", _stage_sql(True) + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS stage_order, '{s}' AS stage, n_{i} AS entered, "
    f"round(100.0 * n_{i} / NULLIF(n_{max(i-1, 1)}, 0), 6) AS stage_to_stage_pct, "
    f"round(100.0 * n_{i} / NULLIF(n_1, 0), 6) AS cumulative_pct FROM c"
    for i, s in enumerate(STAGES, start=1)))
def c_funnel(spark, sf):
    e = Tables(spark, sf).events
    return C.c_funnel(e, "user_id", "ts", "event_type", STAGES, window_days=7)


@query("c_funnel_checks", _stage_sql(False) + """
, a AS (SELECT """ + ", ".join(
    f"count(DISTINCT CASE WHEN event_type = '{s}' THEN user_id END) AS a_{i}"
    for i, s in enumerate(STAGES, start=1)) + " FROM events)\n" + "\nUNION ALL\n".join(
    f"SELECT CAST({i} AS BIGINT) AS stage_order, '{s}' AS stage, a_{i} AS with_event, "
    f"n_{i} AS reached_in_order, a_{i} - n_{i} AS out_of_order, n_{i} <= n_{max(i-1, 1)} AS monotone "
    f"FROM c, a" for i, s in enumerate(STAGES, start=1)))
def c_funnel_checks(spark, sf):
    e = Tables(spark, sf).events
    return C.c_funnel_checks(e, "user_id", "ts", "event_type", STAGES)


@query("c_period_complete", """
WITH mx AS (SELECT CAST(max(o_orderdate) AS DATE) AS m FROM orders)
SELECT CAST(year(o_orderdate) AS BIGINT) AS period, count(*) AS n,
       max(make_date(year(o_orderdate), 12, 31)) AS period_end,
       max(CAST(o_orderdate AS DATE)) AS last_date,
       max(make_date(year(o_orderdate), 12, 31)) <= (SELECT m FROM mx) AS complete
FROM orders GROUP BY 1""")
def c_period_complete(spark, sf):
    return C.c_period_complete(Tables(spark, sf).orders, "o_orderdate", "year")
