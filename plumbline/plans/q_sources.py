"""§2.1 sources, sinks and catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.q_audit import INVENTORY_SQL, ground_truth, inventory
from plumbline.plans.rehearsal import SPELL_SQL, spells, with_sql
from plumbline.plans.registry import query
from plumbline.session import scratch_path
from plumbline.sources import tables as S
from plumbline.sources.tables import Tables


@query("src_table", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def src_table(spark, sf):
    """Read-only scan; only the three projected columns reach ReadSchema."""
    return S.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("src_view", """
SELECT r_name, count(*) AS n_nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def src_view(spark, sf):
    t = Tables(spark, sf)
    S.register_views(spark, {"pl_geo": t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))})
    return spark.sql("SELECT r_name, count(*) AS n_nations FROM pl_geo GROUP BY r_name")


@query("snk_ctas", """
SELECT o_orderstatus, count(*) AS n, CAST(year(o_orderdate) AS BIGINT) AS yr FROM orders GROUP BY ALL""")
def snk_ctas(spark, sf):
    """Materialise a rollup as Parquet partitioned by year under the shared
    checkpoint folder, then read the table back (partition pruning ready)."""
    o = Tables(spark, sf).orders
    roll = o.groupBy(F.year("o_orderdate").alias("yr"), "o_orderstatus").agg(F.count("*").alias("n"))
    path = scratch_path(spark, "snk_ctas")
    S.write_table(roll, path, partition_by=("yr",))
    back = spark.read.parquet(path)
    return back.select("o_orderstatus", "n", F.col("yr").cast("long").alias("yr"))


DECOY_DDL = "exit_id string, worker_id string, survey_date date, reason string, score int"


@query("snk_empty", with_sql(INVENTORY_SQL) + """
SELECT table_name, n_rows, n_rows = 0 AS is_empty FROM inv
UNION ALL SELECT 'fct_exit_survey', 0, true""")
def snk_empty(spark, sf):
    """Create a typed, empty decoy table next to the populated ones and
    inventory all of them: the decoy must report empty, never filled."""
    path = scratch_path(spark, "fct_exit_survey")
    empty = S.create_empty_table(spark, DECOY_DDL, path)
    decoy = empty.agg(F.count("*").alias("n_rows")).select(F.lit("fct_exit_survey").alias("table_name"), "n_rows") \
        .withColumn("is_empty", F.col("n_rows") == 0)
    return inventory(Tables(spark, sf)).unionByName(decoy)


@query("cat_inventory", with_sql(INVENTORY_SQL) + "SELECT table_name, n_rows, n_rows = 0 AS is_empty FROM inv")
def cat_inventory(spark, sf):
    return inventory(Tables(spark, sf))


EVENT_JSON_SCHEMA = "event_id long, event_type string, value double, props struct<k: int>"


@query("src_json", """
SELECT event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 6) AS mean_k,
       round(sum(value), 6) AS total_value FROM events GROUP BY event_type""")
def src_json(spark, sf):
    """Events written as JSON objects (props nested), read back with an
    explicit schema (no inference), then aggregated."""
    e = Tables(spark, sf).events.select("event_id", "event_type", "value",
                                        F.from_json("props", "k int").alias("props"))
    path = scratch_path(spark, "events_json")
    S.write_json(e, path)
    back = S.read_json(spark, path, EVENT_JSON_SCHEMA)
    return back.groupBy("event_type").agg(F.count("*").alias("n"),
                                          F.round(F.avg("props.k"), 6).alias("mean_k"),
                                          F.round(F.sum("value"), 6).alias("total_value"))


@query("snk_json", with_sql(SPELL_SQL) + """
SELECT '_meta.as_of' AS path, '2000-12-31' AS value
UNION ALL SELECT 'headcount.alive', CAST(count(CASE WHEN hire <= DATE '2000-12-31' AND (sep IS NULL OR sep > DATE '2000-12-31') THEN 1 END) AS VARCHAR) FROM spell
UNION ALL SELECT 'headcount.building', CAST(count(CASE WHEN hire <= DATE '2000-12-31' AND (sep IS NULL OR sep > DATE '2000-12-31') AND wtype = 'BUILDING' THEN 1 END) AS VARCHAR) FROM spell
UNION ALL SELECT 'separations.to_date', CAST(count(CASE WHEN sep <= DATE '2000-12-31' THEN 1 END) AS VARCHAR) FROM spell
UNION ALL SELECT 'entrants.to_date', CAST(count(CASE WHEN hire <= DATE '2000-12-31' THEN 1 END) AS VARCHAR) FROM spell""")
def snk_json(spark, sf):
    """A pinned-values panel written as long-form JSON and read back."""
    import datetime as dt
    gt = ground_truth(spells(Tables(spark, sf)), dt.date(2000, 12, 31))
    path = scratch_path(spark, "ground_truth_json")
    S.write_json(gt, path)
    return S.read_json(spark, path, "path string, value string")


@query("src_docs", """
SELECT doc_id, length(text) AS n_chars, len(string_split(text, chr(10))) AS n_lines, md5(text) AS text_md5,
       true AS has_path, true AS has_time FROM documents""")
def src_docs(spark, sf):
    """Every document as a text file of a folder, read back whole with its path and
    modification time: characters, lines and digest of the text."""
    path = scratch_path(spark, "docs-folder")
    S.write_docs(Tables(spark, sf).documents, path, "doc_id", "text")
    d = S.split_docs(S.read_docs(spark, path))
    return d.select(F.col("id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
                    F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.md5("text").alias("text_md5"),
                    (F.length("path") > 0).alias("has_path"), F.col("modified").isNotNull().alias("has_time"))
