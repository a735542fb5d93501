"""§2.4 aggregation primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.dates import month_diff
from plumbline.functions.stats import safe_div
from plumbline.operators.metrics import m_dist
from plumbline.plans.rehearsal import AS_OF, SPELL_SQL, alive_at, spells, with_sql
from plumbline.plans.registry import query
from plumbline.sources.tables import Tables


@query("agg_count", """
SELECT lang, count(*) AS n_rows, count(quality) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def agg_count(spark, sf):
    t = Tables(spark, sf)
    return t.documents.join(t.labels, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.count("quality").alias("n_labelled"))


@query("agg_count_distinct", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY 1""")
def agg_count_distinct(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(
        F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("orders"))


@query("agg_sum_avg_minmax", """
SELECT o_orderstatus, round(sum(o_totalprice), 6) AS total, round(avg(o_totalprice), 6) AS mean,
       min(o_totalprice) AS min_price, max(o_totalprice) AS max_price,
       CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date
FROM orders GROUP BY 1""")
def agg_sum_avg_minmax(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy("o_orderstatus").agg(
        F.round(F.sum("o_totalprice"), 6).alias("total"), F.round(F.avg("o_totalprice"), 6).alias("mean"),
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price"),
        F.min("o_orderdate").cast("date").alias("first_date"), F.max("o_orderdate").cast("date").alias("last_date"))


@query("agg_rate", with_sql(SPELL_SQL) + """
SELECT wtype, count(sep) AS num, count(*) AS den, round(100.0 * avg(CASE WHEN sep IS NOT NULL THEN 1 ELSE 0 END), 6) AS rate_pct
FROM spell GROUP BY 1""")
def agg_rate(spark, sf):
    s = spells(Tables(spark, sf))
    f = F.col("sep").isNotNull().cast("int")
    return s.groupBy("wtype").agg(F.count("sep").alias("num"), F.count("*").alias("den"),
                                  F.round(F.avg(f) * 100, 6).alias("rate_pct"))


@query("agg_cond_sum", with_sql(SPELL_SQL) + """
, m AS (SELECT datediff('month', hire, coalesce(sep, DATE '2001-06-30')) AS months, sep IS NOT NULL AS s FROM spell)
SELECT count(CASE WHEN months >= 12 THEN 1 END) AS at_risk_12, count(CASE WHEN months >= 24 THEN 1 END) AS at_risk_24,
       count(CASE WHEN months >= 36 THEN 1 END) AS at_risk_36,
       count(CASE WHEN months < 36 AND s THEN 1 END) AS events_before_36 FROM m""")
def agg_cond_sum(spark, sf):
    s = spells(Tables(spark, sf)).select(month_diff("hire", F.coalesce("sep", F.lit(AS_OF))).alias("months"),
                                         F.col("sep").isNotNull().alias("s"))
    return s.agg(F.count_if(F.col("months") >= 12).alias("at_risk_12"),
                 F.count_if(F.col("months") >= 24).alias("at_risk_24"),
                 F.count_if(F.col("months") >= 36).alias("at_risk_36"),
                 F.count_if((F.col("months") < 36) & F.col("s")).alias("events_before_36"))


@query("agg_quantile", """
SELECT o_orderpriority, count(o_totalprice) AS n, round(avg(o_totalprice), 6) AS mean,
       CASE WHEN count(o_totalprice) >= 5 THEN round(quantile_cont(o_totalprice, 0.5), 6) END AS median,
       CASE WHEN count(o_totalprice) >= 5 THEN round(quantile_cont(o_totalprice, 0.25), 6) END AS p25,
       CASE WHEN count(o_totalprice) >= 5 THEN round(quantile_cont(o_totalprice, 0.75), 6) END AS p75,
       round(stddev_samp(o_totalprice), 6) AS sd,
       round(avg(o_totalprice) - quantile_cont(o_totalprice, 0.5), 6) AS mean_minus_median
FROM orders GROUP BY 1""")
def agg_quantile(spark, sf):
    """Exact grouped quantiles on a (group, value) -> frequency pre-aggregate."""
    return m_dist(Tables(spark, sf).orders, "o_totalprice", ["o_orderpriority"])


@query("agg_stddev", """
SELECT l_returnflag, round(stddev_samp(l_extendedprice), 6) AS sd_price, round(var_samp(l_quantity), 6) AS var_qty
FROM lineitem GROUP BY 1""")
def agg_stddev(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_extendedprice"), 6).alias("sd_price"),
                                          F.round(F.var_samp("l_quantity"), 6).alias("var_qty"))


@query("agg_group_having", with_sql(SPELL_SQL) + """
SELECT unit, wtype, count(*) AS n FROM spell WHERE sep IS NULL GROUP BY 1, 2 HAVING count(*) < 5""")
def agg_group_having(spark, sf):
    s = spells(Tables(spark, sf)).where(alive_at(AS_OF))
    return s.groupBy("unit", "wtype").agg(F.count("*").alias("n")).where(F.col("n") < 5) \
        .orderBy(F.col("n"), F.col("unit"), F.col("wtype"))


@query("agg_rollup_daily", """
SELECT CAST(o_orderdate AS DATE) AS as_of_date, c_nationkey, count(*) AS orders
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def agg_rollup_daily(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("o_orderdate").cast("date").alias("as_of_date"), "c_nationkey") \
        .agg(F.count("*").alias("orders"))


@query("agg_rollup_month", """
SELECT last_day(CAST(o_orderdate AS DATE)) AS month, o_orderpriority, count(*) AS orders FROM orders GROUP BY 1, 2""")
def agg_rollup_month(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("month"), "o_orderpriority") \
        .agg(F.count("*").alias("orders"))


@query("agg_scalar_sub", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def agg_scalar_sub(spark, sf):
    """Filter by a scalar subquery (pushed into the scan as an EqualTo)."""
    o = Tables(spark, sf).orders
    return o.where(F.col("o_orderdate") == o.select(F.max("o_orderdate")).scalar()) \
        .select("o_orderkey", "o_totalprice")


@query("agg_weighted", """
WITH g AS (SELECT l_returnflag, avg(CASE WHEN l_linestatus = 'O' THEN l_extendedprice END) AS mo,
                  avg(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS mf, count(*) AS w
           FROM lineitem GROUP BY 1)
SELECT round(sum(CASE WHEN mo IS NOT NULL AND mf IS NOT NULL THEN (mo - mf) * w END)
             / sum(CASE WHEN mo IS NOT NULL AND mf IS NOT NULL THEN w END), 6) AS weighted_diff,
       count(CASE WHEN mo IS NOT NULL AND mf IS NOT NULL THEN 1 END) AS strata_used, count(*) AS strata
FROM g""")
def agg_weighted(spark, sf):
    """Stratum-size-weighted mean of within-stratum differences."""
    li = Tables(spark, sf).lineitem
    g = li.groupBy("l_returnflag").agg(
        F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice"))).alias("mo"),
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice"))).alias("mf"),
        F.count("*").alias("w"))
    ok = F.col("mo").isNotNull() & F.col("mf").isNotNull()
    return g.agg(F.round(safe_div(F.sum(F.when(ok, (F.col("mo") - F.col("mf")) * F.col("w"))),
                                  F.sum(F.when(ok, F.col("w")))), 6).alias("weighted_diff"),
                 F.count_if(ok).alias("strata_used"), F.count("*").alias("strata"))
