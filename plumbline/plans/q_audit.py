"""§2.12 table and query-result audits, and provenance, on the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.operators import audit as A
from plumbline.operators import provenance as P
from plumbline.operators.cohort import c_period_complete
from plumbline.operators.etl import etl_history
from plumbline.plans.rehearsal import (AS_OF, JOB_SQL, SPELL_SQL, SURVEY_SQL, alive_at, alive_sql,
                                       job_changes, spells, status_at, status_sql, survey, with_sql)
from plumbline.plans.registry import query
from plumbline.plans.sqlfrag import wilson_sql
from plumbline.sources.tables import TABLE_NAMES, Tables

D = dt.date(2000, 12, 31)
DL_SQL = "dl AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _dl(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left")


@query("a_fanout", """
SELECT (SELECT count(*) FROM orders) AS left_rows, (SELECT count(*) FROM lineitem) AS right_rows,
       (SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS joined_rows,
       round((SELECT count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
             / (SELECT count(*) FROM orders), 6) AS inflation_factor""")
def a_fanout(spark, sf):
    t = Tables(spark, sf)
    return A.a_fanout(t.orders.select("o_orderkey"),
                      t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("a_unique", """
WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_keys, count(CASE WHEN c > 1 THEN 1 END) AS duplicated_keys,
       max(c) AS max_rows_per_key, sum(c) = count(*) AS is_unique FROM g""")
def a_unique(spark, sf):
    return A.a_unique(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@query("a_record_person", """
WITH g AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS r FROM orders GROUP BY 1)
SELECT count(*) AS persons, CAST(sum(r) AS BIGINT) AS records,
       count(CASE WHEN r > 1 THEN 1 END) AS persons_with_multiple_records, max(r) AS max_records_per_person FROM g""")
def a_record_person(spark, sf):
    return A.a_record_person(Tables(spark, sf).orders, "o_orderkey", "o_custkey")


@query("a_coverage", with_sql(DL_SQL) + """
SELECT lang, count(*) AS rows_total, count(quality) AS rows_populated, count(*) - count(quality) AS rows_dropped,
       round(100.0 * count(quality) / count(*), 6) AS pct_populated FROM dl GROUP BY lang""")
def a_coverage(spark, sf):
    return A.a_coverage(_dl(Tables(spark, sf)), "quality", by=["lang"])


@query("a_superseded", with_sql(DL_SQL) + """
SELECT source, count(*) AS rows, count(quality) AS rows_with_old, count(*) - count(quality) AS rows_lost,
       count(quality) = 0 AS vanishes FROM dl GROUP BY source""")
def a_superseded(spark, sf):
    return A.a_superseded(_dl(Tables(spark, sf)), "quality", "source")


@query("a_nulls", with_sql(DL_SQL) + """
SELECT 'lang' AS "column", count(*) AS rows, count(*) - count(lang) AS n_null FROM dl
UNION ALL SELECT 'source', count(*), count(*) - count(source) FROM dl
UNION ALL SELECT 'quality', count(*), count(*) - count(quality) FROM dl
UNION ALL SELECT 'toxic', count(*), count(*) - count(toxic) FROM dl""")
def a_nulls(spark, sf):
    return A.a_nulls(_dl(Tables(spark, sf)), ["lang", "source", "quality", "toxic"])


@query("a_null_drop", with_sql(DL_SQL) + """
SELECT count(*) AS left_rows, count(CASE WHEN doc_id IS NULL THEN 1 END) AS null_key_rows,
       count(CASE WHEN (quality = 1) IS NULL THEN 1 END) AS predicate_unknown_rows,
       count(CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 1 END) AS dropped_by_inner_join,
       count(*) - count(CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 1 END) AS matched_rows
FROM dl""")
def a_null_drop(spark, sf):
    t = Tables(spark, sf)
    return A.a_null_drop(_dl(t), t.labels, "doc_id", F.col("quality") == 1)


@query("a_fresh", """
WITH r AS (SELECT 'orders' AS table_name, CAST(max(o_orderdate) AS DATE) AS max_date FROM orders
           UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE) FROM lineitem
           UNION ALL SELECT 'events', CAST(max(ts) AS DATE) FROM events)
SELECT table_name, max_date, date_diff('day', max_date, (SELECT max(max_date) FROM r)) AS lag_days,
       date_diff('day', max_date, (SELECT max(max_date) FROM r)) > 30 AS stale FROM r""")
def a_fresh(spark, sf):
    t = Tables(spark, sf)
    return A.a_fresh({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate"),
                      "events": (t.events, "ts")}, 30)


@query("a_future_partial", """
WITH mx AS (SELECT CAST(max(o_orderdate) AS DATE) AS m FROM orders)
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n,
       max(last_day(CAST(o_orderdate AS DATE))) AS period_end, max(CAST(o_orderdate AS DATE)) AS last_date,
       max(last_day(CAST(o_orderdate AS DATE))) <= (SELECT m FROM mx) AS complete
FROM orders GROUP BY 1""")
def a_future_partial(spark, sf):
    return c_period_complete(Tables(spark, sf).orders, "o_orderdate", "month")


@query("a_value_set", with_sql(SPELL_SQL) + f"""
, s AS (SELECT *, {status_sql(AS_OF.isoformat())} AS status FROM spell),
c AS (SELECT count(CASE WHEN wtype IN ('BUILDING') AND status IN ('Active', 'On Leave') THEN 1 END) AS n_all,
             count(CASE WHEN status IN ('Active', 'On Leave') THEN 1 END) AS loo_segment,
             count(CASE WHEN wtype IN ('BUILDING') THEN 1 END) AS loo_status FROM s)
SELECT 'segment' AS filter, wtype AS value, count(*) AS n, wtype IN ('BUILDING') AS passes,
       any_value(n_all) AS n_all_filters, any_value(loo_segment) AS n_without_this_filter FROM s, c GROUP BY wtype
UNION ALL
SELECT 'status', status, count(*), status IN ('Active', 'On Leave'), any_value(n_all), any_value(loo_status)
FROM s, c GROUP BY status""")
def a_value_set(spark, sf):
    s = spells(Tables(spark, sf)).withColumn("status", status_at(AS_OF))
    return A.a_value_set(s, {"segment": ("wtype", ["BUILDING"]),
                             "status": ("status", ["Active", "On Leave"])})


@query("a_population_match", with_sql(SPELL_SQL) + f"""
, num AS (SELECT DISTINCT k FROM spell WHERE sep >= DATE '1999-01-01' AND sep < DATE '2000-01-01'),
den AS (SELECT DISTINCT k FROM spell WHERE wtype = 'BUILDING' AND {alive_sql('1998-12-31')})
SELECT count(*) AS numerator_keys, count(CASE WHEN k NOT IN (SELECT k FROM den) THEN 1 END) AS not_in_denominator,
       count(CASE WHEN k IN (SELECT k FROM den) THEN 1 END) AS in_denominator,
       round(100.0 * count(CASE WHEN k NOT IN (SELECT k FROM den) THEN 1 END) / count(*), 6) AS pct_outside
FROM num""")
def a_population_match(spark, sf):
    """1999 leavers of every segment against a BUILDING-only denominator."""
    s = spells(Tables(spark, sf))
    num = s.where((F.col("sep") >= F.lit(dt.date(1999, 1, 1))) & (F.col("sep") < F.lit(dt.date(2000, 1, 1))))
    den = s.where((F.col("wtype") == "BUILDING") & alive_at(dt.date(1998, 12, 31)))
    return A.a_population_match(num, den, "k")


HIST_SQL = """hist AS (
  SELECT *, coalesce(CAST(lead(start) OVER w - INTERVAL 1 DAY AS DATE), DATE '9999-12-31') AS effective_end,
         lead(start) OVER w IS NULL AS is_current
  FROM jobs WINDOW w AS (PARTITION BY k ORDER BY start, ref))"""


@query("a_effective", with_sql(JOB_SQL, HIST_SQL) + """
, x AS (SELECT k, effective_end < start AS bad,
               start <= lag(effective_end) OVER w AS ov,
               start > lag(effective_end) OVER w + INTERVAL 1 DAY AS gap, is_current
        FROM hist WINDOW w AS (PARTITION BY k ORDER BY start, ref)),
pk AS (SELECT k, count(*) AS rows, count(CASE WHEN bad THEN 1 END) AS bad, count(CASE WHEN ov THEN 1 END) AS ov,
              count(CASE WHEN gap THEN 1 END) AS gap, count(CASE WHEN is_current THEN 1 END) AS cur
       FROM x GROUP BY k)
SELECT CAST(sum(rows) AS BIGINT) AS rows, count(*) AS keys, CAST(sum(bad) AS BIGINT) AS end_before_start,
       CAST(sum(ov) AS BIGINT) AS overlaps, CAST(sum(gap) AS BIGINT) AS gaps,
       count(CASE WHEN cur > 1 THEN 1 END) AS keys_multi_current,
       count(CASE WHEN cur = 0 THEN 1 END) AS keys_no_current FROM pk""")
def a_effective(spark, sf):
    """Orders as job-change history: same-day changes give zero-length rows
    (end before start), which the audit reports."""
    h = etl_history(job_changes(Tables(spark, sf)), "k", "start", "ref")
    return A.a_effective(h, "k", "start", "effective_end", "is_current", order=["ref"])


@query("a_orphans", with_sql(SPELL_SQL) + """
SELECT count(*) AS orphan_rows, count(DISTINCT o_custkey) AS orphan_keys, (SELECT count(*) FROM orders) AS fact_rows
FROM orders WHERE o_custkey NOT IN (SELECT k FROM spell)""")
def a_orphans(spark, sf):
    """Orders whose customer has no spell as of 2001-06-30 (first order later)."""
    t = Tables(spark, sf)
    return A.a_orphans(t.orders, spells(t), "o_custkey", "k")


@query("a_reconcile", with_sql(SPELL_SQL) + f"""
, o AS (SELECT unit, count(*) AS v FROM spell WHERE {alive_sql('2000-12-31')} GROUP BY unit),
g AS (SELECT unit, count(*) AS v FROM spell WHERE {alive_sql('2000-06-30')} GROUP BY unit)
SELECT coalesce(o.unit, g.unit) AS unit, o.v AS ours, g.v AS governed, o.v - g.v AS difference,
       round(100.0 * (o.v - g.v) / NULLIF(g.v, 0), 6) AS pct_difference,
       coalesce(abs(100.0 * (o.v - g.v) / NULLIF(g.v, 0)) <= 5.0, false) AS passes
FROM o FULL OUTER JOIN g ON o.unit = g.unit""")
def a_reconcile(spark, sf):
    """Our headcount by unit at 2000-12-31 vs a rollup last refreshed
    2000-06-30, 5% tolerance."""
    s = spells(Tables(spark, sf))
    ours = s.where(alive_at(D)).groupBy("unit").agg(F.count("*").alias("v"))
    gov = s.where(alive_at(dt.date(2000, 6, 30))).groupBy("unit").agg(F.count("*").alias("v"))
    return A.a_reconcile(ours, gov, "unit", "v", 5.0)


@query("a_breakdown_total", with_sql(SPELL_SQL) + f"""
, p AS (SELECT unit, count(DISTINCT k) AS hc FROM spell WHERE {alive_sql('2000-12-31')} GROUP BY unit)
SELECT CAST(sum(hc) AS BIGINT) AS sum_of_parts,
       (SELECT count(DISTINCT k) FROM spell WHERE {alive_sql('2000-12-31')}) AS total,
       CAST(sum(hc) AS BIGINT) - (SELECT count(DISTINCT k) FROM spell WHERE {alive_sql('2000-12-31')}) AS difference,
       sum(hc) = (SELECT count(DISTINCT k) FROM spell WHERE {alive_sql('2000-12-31')}) AS reconciles FROM p""")
def a_breakdown_total(spark, sf):
    s = spells(Tables(spark, sf)).where(alive_at(D))
    parts = s.groupBy("unit").agg(F.count_distinct("k").alias("hc"))
    total = s.agg(F.count_distinct("k").alias("t"))
    return A.a_breakdown_total(parts, "hc", total, "t")


@query("a_magnitude", """
WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n FROM orders GROUP BY 1),
e AS (SELECT yr, n, lag(n) OVER (ORDER BY yr) AS expected FROM y)
SELECT yr, n, expected, round(CASE WHEN n / expected > 0 THEN log10(n / expected) END, 6) AS log10_ratio,
       abs(CASE WHEN n / expected > 0 THEN log10(n / expected) END) < 1 AS within_order_of_magnitude FROM e""")
def a_magnitude(spark, sf):
    """Each year's order count against the previous year's as expectation."""
    y = Tables(spark, sf).orders.groupBy(F.year("o_orderdate").cast("long").alias("yr")) \
        .agg(F.count("*").alias("n"))
    y = y.withColumn("expected", F.lag("n").over(Window.orderBy("yr")))  # one row per year
    return A.a_magnitude(y, "n", "expected")


@query("a_trend_break", """
WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1),
d AS (SELECT *, n - lag(n) OVER (ORDER BY month) AS step FROM m),
fa AS (SELECT min(month) AS f FROM m WHERE month >= DATE '1998-01-01')
SELECT count(CASE WHEN month < DATE '1998-01-01' THEN 1 END) AS n_before,
       count(CASE WHEN month >= DATE '1998-01-01' THEN 1 END) AS n_after,
       round(avg(CASE WHEN month < DATE '1998-01-01' THEN n END), 6) AS mean_before,
       round(avg(CASE WHEN month >= DATE '1998-01-01' THEN n END), 6) AS mean_after,
       round(max(abs(step)), 6) AS max_abs_step,
       round(max(CASE WHEN month = (SELECT f FROM fa) THEN step END), 6) AS step_at_break,
       round(round(avg(CASE WHEN month >= DATE '1998-01-01' THEN n END), 6)
             - round(avg(CASE WHEN month < DATE '1998-01-01' THEN n END), 6), 6) AS shift
FROM d""")
def a_trend_break(spark, sf):
    o = Tables(spark, sf).orders
    m = o.groupBy(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month")).agg(F.count("*").alias("n"))
    return A.a_trend_break(m, "month", "n", dt.date(1998, 1, 1))


_mlo, _mhi = wilson_sql("n_null", "n")
_rlo, _rhi = wilson_sql("(tx - n_null)", "(tn - n)")


@query("a_missing_by_group", with_sql(DL_SQL) + f"""
, w AS (SELECT lang, count(*) AS n, count(*) - count(quality) AS nq, count(*) - count(toxic) AS nt FROM dl GROUP BY lang),
l AS (SELECT lang, 'quality' AS "column", n, nq AS n_null FROM w UNION ALL SELECT lang, 'toxic', n, nt FROM w),
t AS (SELECT "column", sum(n) AS tn, sum(n_null) AS tx FROM l GROUP BY 1),
j AS (SELECT l.*, tn, tx, n_null / NULLIF(n, 0) AS p1, (tx - n_null) / NULLIF(tn - n, 0) AS p0 FROM l JOIN t USING ("column"))
SELECT lang, "column", n, n_null, round(100.0 * n_null / n, 6) AS null_rate_pct,
       round({_mlo} * 100, 6) AS lower_pct, round({_mhi} * 100, 6) AS upper_pct,
       round((p1 - p0) * 100, 6) AS diff_vs_rest_pts,
       round((p1 - p0 - sqrt(pow(p1 - {_mlo}, 2) + pow({_rhi} - p0, 2))) * 100, 6) AS diff_lower_pts,
       round((p1 - p0 + sqrt(pow({_mhi} - p1, 2) + pow(p0 - {_rlo}, 2))) * 100, 6) AS diff_upper_pts
FROM j""")
def a_missing_by_group(spark, sf):
    return A.a_missing_by_group(_dl(Tables(spark, sf)), ["quality", "toxic"], "lang")


@query("a_units", with_sql(SURVEY_SQL) + """
SELECT s.item, CAST(s.scale_max AS VARCHAR) AS unit, count(*) AS n_rows, any_value(g.n_units) AS n_units,
       any_value(g.n_units) > 1 AS mixed
FROM survey s JOIN (SELECT item, count(DISTINCT scale_max) AS n_units FROM survey GROUP BY item) g
  ON g.item IS NOT DISTINCT FROM s.item
GROUP BY s.item, s.scale_max""")
def a_units(spark, sf):
    return A.a_units(survey(Tables(spark, sf)), "scale_max", ["item"])


@query("a_distinct_mask", """
SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_keys,
       round(count(*) / count(DISTINCT o_orderkey), 6) AS ratio
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def a_distinct_mask(spark, sf):
    t = Tables(spark, sf)
    return A.a_distinct_mask_join(t.orders, t.lineitem, "o_orderkey", "l_orderkey")


# The documented schema of two tables, as a reference doc
# would state it (standard order/line-item columns).
DOCUMENTED = [("orders", "o_orderkey", "BIGINT"), ("orders", "o_custkey", "BIGINT"),
              ("orders", "o_orderstatus", "VARCHAR"), ("orders", "o_totalprice", "DOUBLE"),
              ("orders", "o_orderdate", "DATE"), ("orders", "o_orderpriority", "VARCHAR"),
              ("orders", "o_clerk", "VARCHAR"), ("orders", "o_shippriority", "INTEGER"),
              ("lineitem", "l_orderkey", "BIGINT"), ("lineitem", "l_partkey", "BIGINT"),
              ("lineitem", "l_suppkey", "BIGINT"), ("lineitem", "l_linenumber", "INTEGER"),
              ("lineitem", "l_quantity", "DOUBLE"), ("lineitem", "l_extendedprice", "DOUBLE"),
              ("lineitem", "l_discount", "DOUBLE"), ("lineitem", "l_tax", "DOUBLE"),
              ("lineitem", "l_returnflag", "VARCHAR"), ("lineitem", "l_linestatus", "VARCHAR"),
              ("lineitem", "l_shipdate", "DATE"), ("lineitem", "l_commitdate", "DATE")]

_FAM_SQL = """CASE WHEN regexp_matches(upper({c}), '^ARRAY|\\[\\]$') THEN 'array'
     WHEN regexp_matches(upper({c}), '^(TINYINT|SMALLINT|INT|INTEGER|BIGINT|LONG|SHORT|BYTE|HUGEINT)') THEN 'integer'
     WHEN regexp_matches(upper({c}), '^(FLOAT|DOUBLE|REAL|DECIMAL)') THEN 'floating'
     WHEN regexp_matches(upper({c}), '^(STRING|VARCHAR|TEXT)') THEN 'string'
     WHEN regexp_matches(upper({c}), '^TIMESTAMP') THEN 'timestamp' WHEN regexp_matches(upper({c}), '^DATE') THEN 'date'
     WHEN regexp_matches(upper({c}), '^(BOOLEAN|BOOL)') THEN 'boolean' ELSE 'other' END"""


#: Documented columns that the driver tables do not have.
ABSENT = ("o_clerk", "o_shippriority", "l_commitdate")


def _facts_sql() -> str:
    """(table_name, column_name, n_rows, n_filled) of every table, column by column."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, n_rows, n_filled FROM (SELECT count(*) AS n_rows FROM {t}) r, "
        f"(UNPIVOT (SELECT count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE n_filled) u" for t in TABLE_NAMES)


def _castable_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(TRY_CAST({c} AS {ty})) AS n_castable FROM {t}"
                              for t, c, ty in DOCUMENTED if c not in ABSENT)


@query("a_schema_drift", "WITH doc(table_name, column_name, data_type) AS (VALUES " + ", ".join(
    f"('{a}', '{b}', '{c}')" for a, b, c in DOCUMENTED) + f"""),
facts AS ({_facts_sql()}),
castable AS ({_castable_sql()}),
act AS (SELECT f.table_name, f.column_name, n_rows, n_filled, n_castable, c.data_type FROM facts f
        JOIN (SELECT DISTINCT table_name, column_name, data_type FROM information_schema.columns) c USING (table_name, column_name)
        LEFT JOIN castable USING (table_name, column_name)),
k AS (SELECT coalesce(d.table_name, a.table_name) AS table_name, coalesce(d.column_name, a.column_name) AS column_name,
             CASE WHEN d.data_type IS NOT NULL THEN """ + _FAM_SQL.format(c="d.data_type") + """ END AS documented_type,
             CASE WHEN a.data_type IS NOT NULL THEN """ + _FAM_SQL.format(c="a.data_type") + """ END AS actual_type,
             n_rows, n_filled, n_filled - n_castable AS n_not_castable
      FROM doc d FULL OUTER JOIN act a ON d.table_name = a.table_name AND d.column_name = a.column_name)
SELECT table_name, column_name, documented_type, actual_type,
       CASE WHEN actual_type IS NULL THEN 'missing_in_data' WHEN documented_type IS NULL THEN 'undocumented'
            WHEN n_not_castable > 0 THEN 'values_do_not_cast'
            WHEN documented_type <> actual_type THEN 'type_changed' ELSE 'as_documented' END AS status,
       n_rows, round((n_rows - n_filled) / NULLIF(n_rows, 0), 6) AS null_share, n_not_castable
FROM k""")
def a_schema_drift(spark, sf):
    """Documented columns of orders and lineitem vs what the rows of all tables
    hold: one aggregate per table over its columns."""
    t = Tables(spark, sf)
    facts = None
    for n in TABLE_NAMES:
        types = {c: ty.replace("VARCHAR", "STRING") for table, c, ty in DOCUMENTED if table == n}
        f = A.column_facts(n, getattr(t, n), types)
        facts = f if facts is None else facts.unionByName(f)
    doc = spark.createDataFrame(DOCUMENTED, "table_name string, column_name string, data_type string")
    return A.a_schema_drift(doc, facts)


def inventory(t: Tables):
    """cat_inventory: one union of count(*) per table (Parquet footers)."""
    rows = None
    for n in TABLE_NAMES:
        r = getattr(t, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        rows = r if rows is None else rows.unionByName(r)
    return rows.withColumn("is_empty", F.col("n_rows") == 0)


INVENTORY_SQL = "inv AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLE_NAMES) + ")"


@query("a_empty", with_sql(INVENTORY_SQL) + "SELECT table_name, n_rows, n_rows = 0 AS is_empty FROM inv WHERE n_rows = 0")
def a_empty(spark, sf):
    """Documented-but-empty tables: the inventory filtered to zero rows
    (a negative control here: every driver table is populated)."""
    return inventory(Tables(spark, sf)).where(F.col("n_rows") == 0)


def ground_truth(s, as_of: dt.date):
    """A pinned-values panel as long (path, value) rows from one aggregate."""
    w = s.agg(F.count_if(alive_at(as_of)).alias("a"),
              F.count_if(alive_at(as_of) & (F.col("wtype") == "BUILDING")).alias("b"),
              F.count_if(F.col("sep") <= F.lit(as_of)).alias("c"),
              F.count_if(F.col("hire") <= F.lit(as_of)).alias("d"))
    return w.select(F.explode(F.array(
        F.struct(F.lit("_meta.as_of").alias("path"), F.lit(as_of.isoformat()).alias("value")),
        F.struct(F.lit("headcount.alive").alias("path"), F.col("a").cast("string").alias("value")),
        F.struct(F.lit("headcount.building").alias("path"), F.col("b").cast("string").alias("value")),
        F.struct(F.lit("separations.to_date").alias("path"), F.col("c").cast("string").alias("value")),
        F.struct(F.lit("entrants.to_date").alias("path"), F.col("d").cast("string").alias("value")))).alias("r")) \
        .select("r.*")


def _gt_sql(d: str, name: str) -> str:
    return f"""{name} AS (
  SELECT '_meta.as_of' AS path, '{d}' AS value
  UNION ALL SELECT 'headcount.alive', CAST(count(CASE WHEN {alive_sql(d)} THEN 1 END) AS VARCHAR) FROM spell
  UNION ALL SELECT 'headcount.building', CAST(count(CASE WHEN {alive_sql(d)} AND wtype = 'BUILDING' THEN 1 END) AS VARCHAR) FROM spell
  UNION ALL SELECT 'separations.to_date', CAST(count(CASE WHEN sep <= DATE '{d}' THEN 1 END) AS VARCHAR) FROM spell
  UNION ALL SELECT 'entrants.to_date', CAST(count(CASE WHEN hire <= DATE '{d}' THEN 1 END) AS VARCHAR) FROM spell)"""


@query("a_gt_drift", with_sql(SPELL_SQL, _gt_sql("2000-12-31", "pinned"), _gt_sql("2001-06-30", "fresh")) + """
SELECT coalesce(p.path, f.path) AS path, coalesce(p.value, '<missing>') AS pinned,
       coalesce(f.value, '<missing>') AS current
FROM (SELECT * FROM pinned WHERE NOT starts_with(path, '_meta')) p
FULL OUTER JOIN (SELECT * FROM fresh WHERE NOT starts_with(path, '_meta')) f ON p.path = f.path
WHERE coalesce(p.value, '<missing>') IS DISTINCT FROM coalesce(f.value, '<missing>')""")
def a_gt_drift(spark, sf):
    """Values pinned at 2000-12-31 vs recomputed at 2001-06-30."""
    s = spells(Tables(spark, sf))
    return A.a_gt_drift(ground_truth(s, D), ground_truth(s, AS_OF))


# Fixed rehearsal values: tier of each event type when events are read as
# answers and event types as the sources those answers touched.
EVENT_TIERS = [("view", 1), ("click", 2), ("signup", 2), ("purchase", 2), ("error", 3)]
TIERS_SQL = "tiers(src, tier) AS (VALUES " + ", ".join(f"('{a}', {b})" for a, b in EVENT_TIERS) + ")"
ANSWERS_SQL = """ans AS (
  SELECT user_id, CAST(ts AS DATE) AS day, max(coalesce(tier, 3)) AS tier, count(DISTINCT event_type) AS n_sources
  FROM events LEFT JOIN tiers ON src = event_type GROUP BY user_id, CAST(ts AS DATE))"""


def _answers(spark, sf):
    e = Tables(spark, sf).events.select("user_id", F.col("ts").cast("date").alias("day"),
                                        F.col("event_type").alias("src"))
    tiers = spark.createDataFrame(EVENT_TIERS, "src string, tier int")
    return P.a_source_tier(e, ["user_id", "day"], "src", tiers, "src", "tier")


@query("a_source_tier", with_sql(TIERS_SQL, ANSWERS_SQL) + """
SELECT user_id, day, tier, n_sources,
       CASE tier WHEN 1 THEN 'semantic layer' WHEN 2 THEN 'governed table' WHEN 3 THEN 'raw exploration' END AS source_label,
       CASE tier WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Low' END AS confidence FROM ans""")
def a_source_tier(spark, sf):
    return _answers(spark, sf)


@query("a_tier_share", with_sql(TIERS_SQL, ANSWERS_SQL) + """
SELECT day, count(*) AS answers, count(CASE WHEN tier = 1 THEN 1 END) AS tier1,
       count(CASE WHEN tier = 2 THEN 1 END) AS tier2, count(CASE WHEN tier = 3 THEN 1 END) AS tier3,
       round(100.0 * count(CASE WHEN tier = 1 THEN 1 END) / count(*), 6) AS tier1_pct,
       round(100.0 * count(CASE WHEN tier = 2 THEN 1 END) / count(*), 6) AS tier2_pct,
       round(100.0 * count(CASE WHEN tier = 3 THEN 1 END) / count(*), 6) AS tier3_pct
FROM ans GROUP BY day""")
def a_tier_share(spark, sf):
    return P.a_tier_share(_answers(spark, sf), "day")


FOOTER_POP = "customers with orders up to 2001-06-30, by nation x segment"


@query("a_footer", with_sql(SPELL_SQL) + f"""
, g AS (SELECT unit, wtype, count(*) AS n FROM spell GROUP BY unit, wtype)
SELECT 'governed table - spells(customer, orders, nation, region)' AS source, 'Medium' AS confidence,
       'not reviewed' AS reviewed,
       'data through ' || strftime((SELECT max(last) FROM spell), '%Y-%m-%d') AS freshness,
       'rehearsal owner' AS owner, '{FOOTER_POP}' AS population, 'none' AS open_assumptions,
       CASE WHEN (SELECT count(*) FROM g WHERE n < 5) > 0
            THEN printf('%d suppressed cell(s) (n < 5)', (SELECT count(*) FROM g WHERE n < 5)) ELSE 'none' END AS caveats,
       (SELECT count(*) FROM g) AS result_rows""")
def a_footer(spark, sf):
    """Footer of the suppressed separation table (u_suppress): tier from the
    sources' tiers, freshness = max date in the result's input, caveat =
    number of suppressed cells, all computed."""
    from plumbline.operators.uncertainty import u_suppress
    s = spells(Tables(spark, sf))
    res = u_suppress(s.groupBy("unit", "wtype").agg(F.count("*").alias("n")), "n", [], 5)
    tiers = spark.createDataFrame([("customer", 2), ("orders", 2), ("nation", 2), ("region", 2)],
                                  "src string, tier int")
    tier = tiers.select(F.max("tier")).scalar()
    label = F.when(tier == 1, "semantic layer").when(tier == 2, "governed table").otherwise("raw exploration")
    conf = F.when(tier == 1, "High").when(tier == 2, "Medium").otherwise("Low")
    fresh = s.select(F.max("last")).scalar()
    supp = res.select(F.count_if(F.col("n").isNull())).scalar()
    return P.a_footer(label, "spells(customer, orders, nation, region)", conf, "not reviewed", fresh,
                      "rehearsal owner", FOOTER_POP, "none", supp, res)


@query("a_fresh_stream", """
SELECT CAST(ts AS DATE) AS day, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1""")
def a_fresh_stream(spark, sf):
    """Freshness as a Structured Streaming job over arriving events: daily
    arrivals and latest event time, partial rows per batch, no watermark."""
    from plumbline.streaming import run_freshness_stream
    t = Tables(spark, sf)
    return run_freshness_stream(spark, f"{sf.rstrip('/')}/events.parquet", t.events.schema, "ts")
