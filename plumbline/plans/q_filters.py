"""§2.2 projection, filter and predicate primitives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions.dates import in_year, month_diff
from plumbline.operators import population as P
from plumbline.operators.etl import etl_history
from plumbline.plans.q_metrics import CURRENCY_SQL
from plumbline.plans.rehearsal import (AS_OF, JOB_SQL, SPELL_SQL, alive_at, alive_sql, job_changes,
                                       spells, status_at, status_sql, with_sql)
from plumbline.plans.registry import query
from plumbline.sources.tables import Tables

D = dt.date(2000, 12, 31)


@query("flt_population", with_sql(SPELL_SQL) + f"""
SELECT k, unit FROM spell WHERE wtype = 'BUILDING' AND {status_sql('2000-12-31')} IN ('Active', 'On Leave')
  AND {alive_sql('2000-12-31')}""")
def flt_population(spark, sf):
    s = spells(Tables(spark, sf))
    pop = P.Population(alive_at(D) & P.population_predicate(type_col="wtype", types=["BUILDING"])
                       & status_at(D).isin("Active", "On Leave"), "k", "BUILDING, Active/On Leave, 2000-12-31")
    return P.flt_population(s, pop).select("k", "unit")


@query("flt_effective", with_sql(JOB_SQL) + """
, h AS (SELECT *, coalesce(CAST(lead(start) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end
        FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref))
SELECT k, ref, start, effective_end, unit_code FROM h
WHERE start <= DATE '1999-06-30' AND effective_end >= DATE '1999-06-30'""")
def flt_effective(spark, sf):
    h = etl_history(job_changes(Tables(spark, sf)), "k", "start", "ref")
    return P.flt_effective(h, "start", "effective_end", dt.date(1999, 6, 30)) \
        .select("k", "ref", "start", "effective_end", "unit_code")


@query("flt_null", "SELECT doc_id, lang FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def flt_null(spark, sf):
    t = Tables(spark, sf)
    return P.flt_null(t.documents.join(t.labels, "doc_id", "left"), "quality").select("doc_id", "lang")


@query("flt_year", """
SELECT o_orderstatus, count(*) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1""")
def flt_year(spark, sf):
    """Calendar year as a half-open range: both bounds push into the scan."""
    o = Tables(spark, sf).orders
    return o.where(in_year("o_orderdate", 1998)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("flt_range_scan", """
SELECT l_linestatus, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1997-12-31' GROUP BY 1""")
def flt_range_scan(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.where(F.col("l_shipdate") <= F.lit(dt.date(1997, 12, 31))) \
        .groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("prj_case_band", with_sql(SPELL_SQL) + """
SELECT CASE WHEN datediff('month', hire, DATE '2001-06-30') < 12 THEN '0-1yr'
            WHEN datediff('month', hire, DATE '2001-06-30') < 36 THEN '1-3yr' ELSE '3yr+' END AS band,
       count(*) AS n FROM spell WHERE sep IS NULL GROUP BY 1""")
def prj_case_band(spark, sf):
    s = spells(Tables(spark, sf)).where(F.col("sep").isNull())
    return s.groupBy(P.tenure_band(month_diff("hire", F.lit(AS_OF))).alias("band")).agg(F.count("*").alias("n"))


@query("prj_flag", with_sql(SPELL_SQL) + "SELECT k, CASE WHEN sep IS NOT NULL THEN 1 ELSE 0 END AS separated FROM spell")
def prj_flag(spark, sf):
    return spells(Tables(spark, sf)).select("k", P.flag("sep").alias("separated"))


@query("prj_coalesce", with_sql(SPELL_SQL) + "SELECT k, coalesce(sep, DATE '2001-06-30') AS observed_until FROM spell")
def prj_coalesce(spark, sf):
    return spells(Tables(spark, sf)).select("k", F.coalesce("sep", F.lit(AS_OF)).alias("observed_until"))


@query("prj_distinct", "SELECT DISTINCT o_custkey FROM orders")
def prj_distinct(spark, sf):
    return Tables(spark, sf).orders.select("o_custkey").distinct()


@query("prj_rename", "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment FROM customer")
def prj_rename(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", "c_name", "c_mktsegment").withColumnsRenamed(
        {"c_custkey": "customer_id", "c_name": "name", "c_mktsegment": "segment"})


@query("prj_map", """
SELECT c_custkey, n_name AS nation_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def prj_map(spark, sf):
    t = Tables(spark, sf)
    return P.map_codes(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.nation,
                       "n_nationkey", "n_name", "nation_name").select("c_custkey", "nation_name")


@query("prj_switch", f"""
SELECT c_custkey, {CURRENCY_SQL} AS currency_code
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def prj_switch(spark, sf):
    from plumbline.operators.joins import broadcast_bounded
    t = Tables(spark, sf)
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(broadcast_bounded(geo, 10_000), F.col("c_nationkey") == F.col("n_nationkey"))
    r = F.col("r_name")
    return c.select("c_custkey", P.switch([(r == "EUROPE", "EUR"), (r == "ASIA", "SGD")], "USD")
                    .alias("currency_code"))


@query("prj_clip", "SELECT o_orderkey, greatest(least(o_totalprice, 300000.0), 50000.0) AS clipped FROM orders")
def prj_clip(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", P.clip("o_totalprice", 50000.0, 300000.0).alias("clipped"))
