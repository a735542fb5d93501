"""§2.5 windows and §2.6 sort, limit, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.dates import in_year
from plumbline.functions.text import format_id
from plumbline.operators import windows as W
from plumbline.operators.etl import etl_history
from plumbline.plans.rehearsal import AS_OF, JOB_SQL, SPELL_SQL, alive_at, job_changes, spells, with_sql
from plumbline.plans.registry import query
from plumbline.sources.tables import Tables


@query("win_share", """
WITH g AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT yr, o_orderpriority, n, round(n * 1.0 / sum(n) OVER (PARTITION BY yr), 6) AS share FROM g""")
def win_share(spark, sf):
    o = Tables(spark, sf).orders
    g = o.groupBy(F.year("o_orderdate").cast("long").alias("yr"), "o_orderpriority").agg(F.count("*").alias("n"))
    return W.win_share(g, "n", ["yr"]).withColumn("share", F.round("share", 6))


@query("win_effective_end", with_sql(JOB_SQL) + """
SELECT k, ref, start, coalesce(CAST(lead(start) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end,
       lead(start) OVER w IS NULL AS is_current,
       CASE WHEN row_number() OVER w = 1 THEN 'Hire' ELSE 'Change' END AS change_reason
FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref)""")
def win_effective_end(spark, sf):
    h = etl_history(job_changes(Tables(spark, sf)), "k", "start", "ref")
    return h.select("k", "ref", "start", "effective_end", "is_current", "change_reason")


@query("win_first_spell", with_sql(JOB_SQL) + """
SELECT k, ref, row_number() OVER w AS entry_no, row_number() OVER w = 1 AS is_first
FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref)""")
def win_first_spell(spark, sf):
    return W.win_first_spell(job_changes(Tables(spark, sf)), "k", ["start", "ref"]).select(
        "k", "ref", "entry_no", "is_first")


@query("win_quantile_bin", """
WITH q AS (SELECT quantile_cont(c_acctbal, 0.15) AS c1, quantile_cont(c_acctbal, 0.5) AS c2,
                  quantile_cont(c_acctbal, 0.85) AS c3 FROM customer),
t AS (SELECT c_acctbal, 1 + (c_acctbal >= c1)::INT + (c_acctbal >= c2)::INT + (c_acctbal >= c3)::INT AS tier
      FROM customer, q)
SELECT tier, count(*) AS n, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value FROM t GROUP BY tier""")
def win_quantile_bin(spark, sf):
    c = Tables(spark, sf).customer
    b = W.win_quantile_bin(c, "c_acctbal")
    return b.groupBy("tier").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("min_value"),
                                 F.max("c_acctbal").alias("max_value"))


@query("win_seq_id", "SELECT o_orderkey, printf('JR%07d', o_orderkey) AS job_record_id FROM orders")
def win_seq_id(spark, sf):
    """Key-derived formatted ids: no global row_number (single partition)."""
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", format_id("JR", "o_orderkey").alias("job_record_id"))


@query("ord_sort", "SELECT o_orderpriority, o_totalprice, o_orderkey FROM orders ORDER BY 1 ASC, 2 DESC NULLS LAST, 3")
def ord_sort(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderpriority", "o_totalprice", "o_orderkey").orderBy(
        F.col("o_orderpriority").asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey"))


@query("ord_topk", with_sql(SPELL_SQL) + """
SELECT unit, wtype, count(*) AS n FROM spell WHERE sep IS NULL GROUP BY 1, 2 ORDER BY n, unit, wtype LIMIT 6""")
def ord_topk(spark, sf):
    """The six smallest cells, with a deterministic tiebreak (the limit is
    the feature: a top-k report via TakeOrderedAndProject)."""
    s = spells(Tables(spark, sf)).where(alive_at(AS_OF))
    return s.groupBy("unit", "wtype").agg(F.count("*").alias("n")).orderBy("n", "unit", "wtype").limit(6)


@query("set_concat", """
SELECT kind, nk, count(*) AS n FROM (
  SELECT 'customer' AS kind, c_nationkey AS nk FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier) x
GROUP BY 1, 2""")
def set_concat(spark, sf):
    t = Tables(spark, sf)
    u = t.customer.select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nk")).unionByName(
        t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nk")))
    return u.groupBy("kind", "nk").agg(F.count("*").alias("n"))


@query("set_diff", """
SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1998
EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1999""")
def set_diff(spark, sf):
    """Customers active in 1998 but not in 1999 (anti join on distinct keys)."""
    o = Tables(spark, sf).orders
    a = o.where(in_year("o_orderdate", 1998)).select("o_custkey").distinct()
    b = o.where(in_year("o_orderdate", 1999)).select("o_custkey")
    return a.join(b, "o_custkey", "left_anti")


@query("set_sample", f"""
SELECT c_custkey FROM customer
WHERE CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 15) AS BIGINT) < {round(0.83 * 2**60)}""")
def set_sample(spark, sf):
    return W.set_sample(Tables(spark, sf).customer, "c_custkey", 0.83).select("c_custkey")
