"""Session helpers: building a local session for tests/bench and locating the
shared checkpoint folder for lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "plumbline", extra: dict | None = None) -> SparkSession:
    """A session with AQE on, UI off, UTC clock. Used by tests and bench only;
    library code always takes the caller's session."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", (extra or {}).get("spark.sql.session.timeZone", "UTC"))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment and must be shared storage; an
    unset folder is an error there. Only in a single-process local session
    (tests, bench) do we create a private folder. The caller owns clean-up."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="plumbline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_CACHES: dict[str, dict] = {}


def app_cache(spark: SparkSession, name: str) -> dict:
    """A dictionary that lives as long as the session's application: what an
    earlier application of this process left behind is dropped."""
    app = spark.sparkContext.applicationId
    if app not in _CACHES:
        _CACHES.clear()
    return _CACHES.setdefault(app, {}).setdefault(name, {})


MAX_SMALL_CACHED = 64


def materialize_small(df: DataFrame) -> DataFrame:
    """Compute a small derived frame (one row per group, per horizon, per
    stratum) once and reuse it, so the several totals and windows computed
    from it do not each re-run the large scan that produced it. A lazy cache:
    the first job that needs it fills it (concurrent readers of a block wait
    for it), and lost blocks are recomputed from lineage. Iterative loops cut
    lineage with :func:`cut_lineage` instead. At most ``MAX_SMALL_CACHED``
    such frames stay cached per application; evicting an older one only means it
    is recomputed if still needed, never a different result."""
    out = df.cache()
    kept = app_cache(df.sparkSession, "small").setdefault("frames", [])
    kept.append(out)
    while len(kept) > MAX_SMALL_CACHED:
        kept.pop(0).unpersist(blocking=False)
    return out


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Give CPU-heavy per-row work (whole-text regex, tokenising) all cores
    when the input arrived in fewer partitions than the default parallelism
    (e.g. a file stored as one row group). Large inputs, which already have
    many splits, are left untouched: no shuffle of a big table."""
    if df.isStreaming:
        return df
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df
