"""§2.3 join primitives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions.dates import in_year, month_diff
from plumbline.operators import joins as J
from plumbline.operators.etl import etl_history
from plumbline.plans.rehearsal import AS_OF, JOB_SQL, SPELL_SQL, job_changes, spells, with_sql
from plumbline.plans.registry import query
from plumbline.sources.tables import Tables


@query("join_inner", """
SELECT o_orderstatus, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def join_inner(spark, sf):
    t = Tables(spark, sf)
    j = J.join_inner(t.orders.select(F.col("o_orderkey").alias("key"), "o_orderstatus"),
                     t.lineitem.select(F.col("l_orderkey").alias("key")), "key")
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("n_lines"))


@query("join_dim", """
SELECT n_name, count(*) AS n_customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def join_dim(spark, sf):
    t = Tables(spark, sf)
    j = J.join_dim(t.customer.select(F.col("c_nationkey").alias("n_nationkey")),
                   t.nation.select("n_nationkey", "n_name"), "n_nationkey", max_dim_rows=10_000)
    return j.groupBy("n_name").agg(F.count("*").alias("n_customers"))


@query("join_left_flag", """
WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderstatus, CASE WHEN r.l_orderkey IS NOT NULL THEN 1 ELSE 0 END AS has_return, count(*) AS n
FROM orders LEFT JOIN r ON r.l_orderkey = o_orderkey GROUP BY ALL""")
def join_left_flag(spark, sf):
    """Orders flagged for having a returned line; the lineitem side is
    reduced to distinct keys first, so an order never fans out."""
    t = Tables(spark, sf)
    ret = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    j = J.join_left_flag(t.orders.select("o_orderkey", "o_orderstatus"), ret, "o_orderkey", "has_return")
    return j.groupBy("o_orderstatus", "has_return").agg(F.count("*").alias("n"))


@query("join_composite", with_sql(SPELL_SQL) + """
, oy AS (SELECT o_custkey AS k, year(o_orderdate) AS yr, count(*) AS n FROM orders GROUP BY 1, 2),
sy AS (SELECT DISTINCT k, year(sep) AS yr FROM spell WHERE sep IS NOT NULL)
SELECT CAST(oy.yr AS BIGINT) AS yr, CAST(sum(n) AS BIGINT) AS orders,
       CAST(sum(CASE WHEN sy.k IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS orders_in_exit_year
FROM oy LEFT JOIN sy ON sy.k = oy.k AND sy.yr = oy.yr GROUP BY 1""")
def join_composite(spark, sf):
    """Left join on (person, year): orders placed in the year the customer
    separated. The event side is distinct on its keys (no fan-out)."""
    t = Tables(spark, sf)
    oy = t.orders.groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("yr")) \
        .agg(F.count("*").alias("n"))
    sy = spells(t).where(F.col("sep").isNotNull()).select("k", F.year("sep").alias("yr")).distinct() \
        .withColumn("hit", F.lit(True))
    j = oy.join(sy, ["k", "yr"], "left")
    return j.groupBy(F.col("yr").cast("long").alias("yr")).agg(
        F.sum("n").cast("long").alias("orders"),
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).cast("long").alias("orders_in_exit_year"))


@query("join_self_period", """
SELECT o_orderpriority AS band, count(CASE WHEN year(o_orderdate) = 1998 THEN 1 END) AS n0,
       count(CASE WHEN year(o_orderdate) = 1999 THEN 1 END) AS n1,
       count(CASE WHEN year(o_orderdate) = 1998 THEN 1 END) > 0
         AND count(CASE WHEN year(o_orderdate) = 1999 THEN 1 END) > 0 AS in_both_periods
FROM orders WHERE year(o_orderdate) IN (1998, 1999) GROUP BY 1""")
def join_self_period(spark, sf):
    """Period 0 paired with period 1 by conditional aggregation in one scan
    (the full-outer-with-zero-fill result without a self-join); strata seen
    in one period only are kept and flagged."""
    o = Tables(spark, sf).orders.where((F.col("o_orderdate") >= F.lit(dt.date(1998, 1, 1)))
                                       & (F.col("o_orderdate") < F.lit(dt.date(2000, 1, 1))))
    y = F.year("o_orderdate")
    g = o.groupBy(F.col("o_orderpriority").alias("band")).agg(
        F.count_if(y == 1998).alias("n0"), F.count_if(y == 1999).alias("n1"))
    return g.withColumn("in_both_periods", (F.col("n0") > 0) & (F.col("n1") > 0))


@query("join_cross_list", with_sql(SPELL_SQL) + """
SELECT m AS horizon, count(CASE WHEN datediff('month', hire, coalesce(sep, DATE '2001-06-30')) >= m THEN 1 END) AS at_risk
FROM spell, (SELECT unnest([0, 12, 24, 36]) AS m) h GROUP BY m""")
def join_cross_list(spark, sf):
    """Rows paired with a literal horizon list through explode (a Generate
    on the scan), not a nested-loop join."""
    s = spells(Tables(spark, sf)).withColumn("months", month_diff("hire", F.coalesce("sep", F.lit(AS_OF))))
    x = J.explode_list(s.select("months"), "horizon", [0, 12, 24, 36])
    return x.groupBy("horizon").agg(F.count_if(F.col("months") >= F.col("horizon")).alias("at_risk"))


@query("join_range_spine", with_sql(SPELL_SQL) + """
, months AS (SELECT last_day(CAST(m AS DATE)) AS month_end
             FROM generate_series(DATE '1996-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) g(m))
SELECT CAST(year(month_end) AS BIGINT) AS yr, count(*) AS person_months
FROM spell JOIN months ON hire <= month_end AND (sep IS NULL OR sep > month_end) GROUP BY 1""")
def join_range_spine(spark, sf):
    """Person interval x month-end spine via explode(sequence) per spell."""
    from plumbline.operators.etl import etl_snapshot
    snap = etl_snapshot(spells(Tables(spark, sf)), "k", "hire", "sep", dt.date(1996, 1, 1), dt.date(2000, 12, 31))
    return snap.groupBy(F.year("month_end").cast("long").alias("yr")).agg(F.count("*").alias("person_months"))


@query("join_semi_anti", """
SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)) AS with_orders,
       (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2000)) AS without_orders""")
def join_semi_anti(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.where(in_year(F.col("o_orderdate"), 2000)).select(F.col("o_custkey").alias("c_custkey"))
    c = t.customer.select("c_custkey")
    semi = J.join_semi(c, o, "c_custkey").select(F.count("*")).scalar()
    anti = J.join_anti(c, o, "c_custkey").select(F.count("*")).scalar()
    return spark.range(1).select(semi.alias("with_orders"), anti.alias("without_orders"))


@query("join_matched_ids", """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998),
b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1999)
SELECT CASE WHEN a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL THEN 'both'
            WHEN a.o_custkey IS NOT NULL THEN 'a_only' ELSE 'b_only' END AS side, count(*) AS n
FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey GROUP BY 1""")
def join_matched_ids(spark, sf):
    o = Tables(spark, sf).orders
    a = o.where(in_year("o_orderdate", 1998))
    b = o.where(in_year("o_orderdate", 1999))
    return J.join_matched_ids(a, b, "o_custkey").groupBy("side").agg(F.count("*").alias("n"))


@query("join_full_drift", """
WITH a AS (SELECT c_nationkey AS nk, count(*) AS v FROM customer GROUP BY 1),
b AS (SELECT s_nationkey AS nk, count(*) AS v FROM supplier GROUP BY 1)
SELECT coalesce(a.nk, b.nk) AS nk, CASE WHEN a.nk IS NULL THEN '<missing>' ELSE CAST(a.v AS VARCHAR) END AS value_a,
       CASE WHEN b.nk IS NULL THEN '<missing>' ELSE CAST(b.v AS VARCHAR) END AS value_b
FROM a FULL OUTER JOIN b ON a.nk = b.nk
WHERE (CASE WHEN a.nk IS NULL THEN '<missing>' ELSE CAST(a.v AS VARCHAR) END)
      IS DISTINCT FROM (CASE WHEN b.nk IS NULL THEN '<missing>' ELSE CAST(b.v AS VARCHAR) END)""")
def join_full_drift(spark, sf):
    """Customers vs suppliers per nation: keys on either side whose values differ."""
    t = Tables(spark, sf)
    a = t.customer.groupBy(F.col("c_nationkey").alias("nk")).agg(F.count("*").alias("v"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("nk")).agg(F.count("*").alias("v"))
    return J.join_full_drift(a, b, "nk", "v")


@query("join_asof_dim", with_sql(JOB_SQL) + """
, h AS (SELECT *, coalesce(CAST(lead(start) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end,
               lead(start) OVER w IS NULL AS is_current
        FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref)),
f AS (SELECT o_custkey AS k, CAST(l_shipdate AS DATE) AS ship FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT f.k, f.ship, h.unit_code AS asof_unit FROM f LEFT JOIN h ON h.k = f.k AND f.ship >= h.start AND f.ship <= h.effective_end),
c AS (SELECT k, unit_code AS current_unit FROM h WHERE is_current)
SELECT coalesce(asof_unit, '<none>') AS asof_unit, count(*) AS n_lines,
       count(CASE WHEN asof_unit IS DISTINCT FROM current_unit THEN 1 END) AS n_restated
FROM a LEFT JOIN c USING (k) GROUP BY 1""")
def join_asof_dim(spark, sf):
    """Each shipped line cut by the 'unit' (order priority) in force for its
    customer on the ship date, versus the current (restated) unit: equi join
    on the customer plus a range predicate on the effective dates."""
    t = Tables(spark, sf)
    h = etl_history(job_changes(t), "k", "start", "ref")
    f = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")) \
        .select(F.col("o_custkey").alias("k"), F.col("l_shipdate").cast("date").alias("ship"))
    a = J.join_asof_dim(f, h, "k", "ship", "start", "effective_end", ["unit_code"]) \
        .withColumnRenamed("unit_code", "asof_unit")
    cur = h.where("is_current").select("k", F.col("unit_code").alias("current_unit"))
    j = a.join(cur, "k", "left")
    return j.groupBy(F.coalesce("asof_unit", F.lit("<none>")).alias("asof_unit")).agg(
        F.count("*").alias("n_lines"),
        F.count_if(~F.col("asof_unit").eqNullSafe(F.col("current_unit"))).alias("n_restated"))
