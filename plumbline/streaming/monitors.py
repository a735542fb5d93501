"""Streaming monitors.

``run_freshness_stream``: per event-time day, how many rows arrived and the
latest timestamp, as partial rows per micro-batch that are summed when read.
``run_term_hits_stream``: the lexicon scan over arriving
texts, appended to a Parquet sink. Sinks and checkpoints live under the
shared checkpoint folder; ``availableNow`` processes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.compare import term_hits
from plumbline.session import scratch_path


def _read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int) -> DataFrame:
    """File stream over a directory of Parquet files (the production layout).
    A single file is turned into a glob that matches exactly that file, since
    file stream sources only list directories or globs."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet"):
        path = f"{path[:-1]}[{path[-1]}]"
    return r.parquet(path)


def run_freshness_stream(spark: SparkSession, path: str, schema: T.StructType, ts: str,
                         max_files_per_trigger: int = 1) -> DataFrame:
    """Rows and latest event time per day. Each batch writes its own partial
    rows under its batch id (a replayed batch overwrites them), without state
    and without a watermark, so a late file counts however late it is."""
    src = _read_stream(spark, path, schema, max_files_per_trigger)
    out = scratch_path(spark, "freshness_stream")

    # a folder without files starts no batch: the sink then holds this empty part only
    spark.createDataFrame([], "day date, n long, latest timestamp_ntz").write.parquet(f"{out}/sink/batch=-1")

    def partial(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(F.col(ts).cast("date").alias("day")).agg(
            F.count("*").alias("n"), F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{out}/sink/batch={batch_id}")

    q = (src.writeStream.foreachBatch(partial)
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    sink = spark.read.schema("day date, n long, latest timestamp_ntz, batch long").parquet(f"{out}/sink")
    return sink.groupBy("day").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))


def run_term_hits_stream(spark: SparkSession, path: str, schema: T.StructType, id_col: str,
                         text: str, lexicon: DataFrame, extra=(), where: Column | None = None,
                         max_files_per_trigger: int = 1) -> DataFrame:
    """Stateless lexicon scan of arriving texts; returns the sink's rows."""
    src = _read_stream(spark, path, schema, max_files_per_trigger)
    if where is not None:
        src = src.where(where)
    hits = term_hits(src, id_col, text, lexicon, extra=list(extra))
    out = scratch_path(spark, "term_hits_stream")
    q = (hits.writeStream.outputMode("append").format("parquet").option("path", f"{out}/sink")
         .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(hits.schema).parquet(f"{out}/sink")
