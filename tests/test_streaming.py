"""Streaming monitors over several arriving files, including late rows."""

import os

from pyspark.sql import functions as F

from plumbline.streaming import run_freshness_stream
from tests.conftest import SF_SMALL


def test_freshness_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = str(tmp_path / "events")
    # three arrivals: early days, later days, then a late batch of early rows
    day = F.dayofmonth("ts")
    ev.where(day <= 10).where(F.col("event_id") % 2 == 0).coalesce(1).write.parquet(f"{src}/p1")
    ev.where(day > 10).coalesce(1).write.parquet(f"{src}/p2")
    ev.where(day <= 10).where(F.col("event_id") % 2 == 1).coalesce(1).write.parquet(f"{src}/p3")
    files = sorted(os.path.join(r, f) for r, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    flat = str(tmp_path / "flat")
    os.makedirs(flat)
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"part-{i}.parquet"))
    got = run_freshness_stream(spark, flat, ev.schema, "ts")
    want = ev.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"),
                                                                  F.max("ts").alias("latest"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_files_count_and_an_empty_folder_gives_nothing(spark, tmp_path):
    """Two files of one day in separate batches add up; a folder without files has no day."""
    for hours in ((1, 2), (0,)):
        spark.sql(" UNION ALL ".join(f"SELECT timestamp_ntz'2024-01-05 0{h}:00:00' AS ts" for h in hours)) \
            .coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    schema = spark.read.parquet(f"file://{tmp_path}/in").schema
    got = [(str(r.day), r.n, str(r.latest)) for r in run_freshness_stream(spark, f"file://{tmp_path}/in", schema, "ts").collect()]
    assert got == [("2024-01-05", 3, "2024-01-05 02:00:00")]
    (tmp_path / "none").mkdir()
    assert run_freshness_stream(spark, f"file://{tmp_path}/none", schema, "ts").count() == 0
