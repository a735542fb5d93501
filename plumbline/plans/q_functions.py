"""§2.7 scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import dates as Dt
from plumbline.functions import text as Tx
from plumbline.functions.stats import safe_div
from plumbline.plans.rehearsal import AS_OF, SPELL_SQL, spells, with_sql
from plumbline.plans.registry import query
from plumbline.plans.sqlfrag import ASCII_WORDS, FIGURE_RE2
from plumbline.sources.tables import Tables


@query("fn_year", "SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, count(*) AS n FROM lineitem GROUP BY 1")
def fn_year(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.groupBy(F.year("l_shipdate").cast("long").alias("yr")).agg(F.count("*").alias("n"))


@query("fn_month_diff", with_sql(SPELL_SQL) + """
SELECT k, datediff('month', hire, coalesce(sep, DATE '2001-06-30')) AS months FROM spell""")
def fn_month_diff(spark, sf):
    """Month boundaries crossed (Jan 31 -> Feb 1 counts one)."""
    s = spells(Tables(spark, sf))
    return s.select("k", Dt.month_diff("hire", F.coalesce("sep", F.lit(AS_OF))).cast("long").alias("months"))


@query("fn_days_diff", with_sql(SPELL_SQL) + "SELECT k, date_diff('day', hire, last) AS active_days FROM spell")
def fn_days_diff(spark, sf):
    s = spells(Tables(spark, sf))
    return s.select("k", Dt.days_diff("last", "hire").cast("long").alias("active_days"))


@query("fn_add_days", with_sql(SPELL_SQL) + "SELECT k, CAST(hire + INTERVAL 1095 DAY AS DATE) AS award_date FROM spell")
def fn_add_days(spark, sf):
    s = spells(Tables(spark, sf))
    return s.select("k", Dt.add_days("hire", 1095).alias("award_date"))


@query("fn_month_end", "SELECT last_day(CAST(l_shipdate AS DATE)) AS month_end, count(*) AS n FROM lineitem GROUP BY 1")
def fn_month_end(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.groupBy(Dt.month_end(F.col("l_shipdate").cast("date")).alias("month_end")).agg(F.count("*").alias("n"))


@query("fn_round", "SELECT o_orderpriority, round(avg(o_totalprice), 1) AS mean_1dp, round(avg(o_totalprice)) AS mean_0dp FROM orders GROUP BY 1")
def fn_round(spark, sf):
    o = Tables(spark, sf).orders
    return o.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 1).alias("mean_1dp"),
                                            F.round(F.avg("o_totalprice"), 0).alias("mean_0dp"))


@query("fn_safe_div", """
SELECT o_orderstatus, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS num,
       count(CASE WHEN o_totalprice > 500000 THEN 1 END) AS den,
       count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) / NULLIF(count(CASE WHEN o_totalprice > 500000 THEN 1 END), 0) AS ratio
FROM orders GROUP BY 1""")
def fn_safe_div(spark, sf):
    """Zero denominators give null (undefined), never 0 and never an error."""
    o = Tables(spark, sf).orders
    g = o.groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("num"),
                                       F.count_if(F.col("o_totalprice") > 500000).alias("den"))
    return g.withColumn("ratio", safe_div("num", "den"))


@query("fn_format_id", "SELECT c_custkey, 'W' || CAST(100000 + c_custkey AS VARCHAR) AS worker_id FROM customer")
def fn_format_id(spark, sf):
    c = Tables(spark, sf).customer
    return c.select("c_custkey", F.format_string("W%d", F.col("c_custkey") + 100000).alias("worker_id"))


@query("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def fn_sha256(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("fn_regex_numbers", f"""
SELECT doc_id, CAST(replace(f, ',', '') AS DOUBLE) AS figure
FROM (SELECT doc_id, unnest(regexp_extract_all({ASCII_WORDS}, '{FIGURE_RE2}', 1)) AS f FROM documents) x""")
def fn_regex_numbers(spark, sf):
    """Every figure quoted in every whole document, commas stripped."""
    from plumbline.session import spread_small_scan
    d = Tables(spark, sf).documents.where(Tx.may_hold_figures("text"))
    return spread_small_scan(d).select("doc_id", F.explode(Tx.number_figures("text")).alias("figure"))


@query("fn_flatten_path", """
SELECT event_id, path, json_extract_string(props, '$."' || path || '"') AS value
FROM (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events) x""")
def fn_flatten_path(spark, sf):
    from plumbline.functions.json import flatten_json
    e = Tables(spark, sf).events
    return flatten_json(e, "event_id", "props", "map<string,string>")


@query("fn_date_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_day FROM orders")
def fn_date_text(spark, sf):
    o = Tables(spark, sf).orders
    return o.select("o_orderkey", Dt.date_text("o_orderdate").alias("order_day"))


@query("fn_ratio_label", """
SELECT o_orderstatus, printf('%.1f%% (%d / %d)', round(100.0 * count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) / count(*), 1),
                             count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END), count(*)) AS urgent_share
FROM orders GROUP BY 1""")
def fn_ratio_label(spark, sf):
    o = Tables(spark, sf).orders
    g = o.groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n"),
                                       F.count("*").alias("d"))
    return g.select("o_orderstatus", Tx.ratio_label("n", "d").alias("urgent_share"))
