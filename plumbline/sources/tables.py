"""Table sources and sinks (src_table, src_view, snk_ctas, snk_empty, src_json,
snk_json, src_docs)."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import app_cache, scratch_path, spread_small_scan

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """src_table: read-only scan of one named Parquet table.

    The scan handle (a logical plan: file listing and footer schema, no data)
    is reused per session and path; for local files the key includes the
    modification time, so a rewritten table is listed again."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        stamp = os.path.getmtime(path)
    except OSError:
        stamp = None
    key = (id(spark), path, stamp)
    handles = app_cache(spark, "handles")
    df = handles.get(key)
    if df is None:
        df = spark.read.parquet(path)
        handles[key] = df
    return df


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` is a Parquet scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def all(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLE_NAMES}


def register_views(spark: SparkSession, frames: dict[str, DataFrame]) -> None:
    """src_view: expose frames to SQL as temp views."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (),
                mode: str = "overwrite") -> None:
    """snk_ctas: materialise a frame as Parquet, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_empty_table(spark: SparkSession, ddl: str, path: str) -> DataFrame:
    """snk_empty: a typed, empty Parquet table from a DDL column list."""
    empty = spark.createDataFrame([], ddl)
    empty.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """snk_json: JSON lines, one object per row (long form)."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool = False) -> DataFrame:
    """src_json: read JSON with an explicit schema (no inference at scale)."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


#: Read partitions of a folder of small files that one task takes: each stands for few
#: files, as Spark counts the opening of a file like some MB of it.
SCANS_PER_TASK = 64
#: Files, and bytes of them, that one task reads with open().
FILES_PER_TASK = 2000
BYTES_PER_TASK = 32 << 20
#: Files that one read by Spark's reader takes, since the driver holds their list, and
#: those (a power of two) that Spark's writer puts into one folder.
FILES_PER_SCAN = 100_000
FILES_PER_FOLDER = 8192
#: Characters that make a path a pattern for Spark.
GLOB = r"[{}\[\]*?\\]"


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """src_docs: a folder of text files, one row per file: the whole text with its
    path and modification time. The driver holds no list of the files: tasks list and
    read a local (or mounted) folder; elsewhere the folders of :func:`write_docs` are
    read FILES_PER_SCAN files at a time into one Parquet table."""
    root = local_path(spark, path)
    docs = read_files(spark, root) if root else None
    if docs is not None:
        return docs
    groups = folder_groups(spark, path)
    if len(groups) < 2:
        return scan_docs(spark, path)
    out = scratch_path(spark, "docs-read")
    for group in groups:
        scan_docs(spark, path, group).write.mode("append").parquet(out)
    return spark.read.schema("path string, modified timestamp, text string").parquet(out)


def scan_docs(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """:func:`read_docs` by Spark's reader, of the whole path or of some of its folders."""
    reader = spark.read.option("basePath", path) if folders else spark.read
    docs = reader.text(folders or path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
        F.col("value").alias("text"))
    n = docs.rdd.getNumPartitions()
    return docs.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-n // SCANS_PER_TASK)))


def folder_groups(spark: SparkSession, path: str) -> list[list[str]]:
    """The folders ``part=N`` of ``path`` in groups of FILES_PER_SCAN files at most (or of
    one folder); none if there are fewer files or other folders."""
    fs_of = spark._jvm.org.apache.hadoop.fs
    top = fs_of.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if re.search(GLOB, path) or not fs.exists(top) or not fs.getFileStatus(top).isDirectory():
        return []
    whole = fs.getContentSummary(top)
    if whole.getFileCount() <= FILES_PER_SCAN:
        return []
    folders = [s.getPath() for s in fs.globStatus(fs_of.Path(top, "part=*")) if s.isDirectory()]
    if whole.getDirectoryCount() != len(folders) + 1:
        return []
    groups, held = [], FILES_PER_SCAN
    for folder in folders:
        n = fs.getContentSummary(folder).getFileCount()
        if held + n > FILES_PER_SCAN:
            groups.append([])
            held = 0
        groups[-1].append(folder.toString())
        held += n
    return groups


def read_files(spark: SparkSession, root: str) -> DataFrame | None:
    """:func:`read_docs` of a local folder of files, or of folders ``part=N`` of files
    (beside which Spark reads no files): tasks list the folders, the names are dealt
    out, tasks read the files. None for a folder of any other shape, and where names
    are not ASCII or are those of compressed files."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()

    def hidden(name: str) -> bool:  # to Spark's readers
        return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")

    if re.search(GLOB, root) or not os.path.isdir(root):
        return None
    with os.scandir(root) as entries:
        folders = [e.name for e in entries if e.is_dir() and not hidden(e.name)]
    if not all(re.fullmatch("part=[0-9]+", x) for x in folders):
        return None
    folders = [f"/{x}" for x in folders] or [""]
    top = hadoop.fs.Path(f"file:{root}").toUri()
    root, uri = top.getPath().rstrip("/"), top.toString().rstrip("/")
    packed = tuple({hadoop.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension()
                    for c in hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)})

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, os.DirEntry]]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                with os.scandir(root + folders[i]) as entries:
                    for e in entries:
                        if not hidden(e.name):
                            yield f"{folders[i]}/{e.name}", e

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = other = 0
        for _, e in entries_of(batches):
            if e.is_file() and e.name.isascii() and not e.name.endswith(packed):
                n, size = n + 1, size + e.stat().st_size
            else:
                other += 1
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (n, size, other)], ["n", "size", "other"])

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (name for name, _ in entries_of(batches))
        while some := [*islice(found, 10_000)]:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "ms": pa.int64(), "text": pa.binary()}
        held, size = [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(root + name, "rb") as f:
                    text, ms = f.read(), os.fstat(f.fileno()).st_mtime_ns // 1_000_000
                if text:  # Spark's reader passes over empty files
                    held.append((uri + quote(name, "/!$&'()*+,;:=@~"), ms, text))
                    size += len(text)
                if size > 4 << 20 or len(held) == 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], [*kinds])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds.values())], [*kinds])

    least = 4 * spark.sparkContext.defaultParallelism
    listing = spark.range(0, len(folders), 1, min(len(folders), least))
    n, size, other = listing.mapInArrow(measure, "n bigint, size bigint, other bigint").agg(
        F.sum("n"), F.sum("size"), F.sum("other")).first()
    if other:
        return None
    tasks = max(1, min(n, max(least, -(-n // FILES_PER_TASK), -(-size // BYTES_PER_TASK))))
    return listing.mapInArrow(names, "name string").repartition(tasks).mapInArrow(
        read, "path string, ms bigint, text binary").select(
        "path", F.timestamp_millis("ms").alias("modified"), F.col("text").cast("string").alias("text"))


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` for Python's open() if it is in the local (or a mounted) file system."""
    if path.startswith("/"):
        path = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + path
    m = re.fullmatch("file:(?://)?(/.*)", path)
    return m[1] if m else None


def write_docs(df: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """One text file per row: a heading line with the id, then the text and a line
    feed; a null text is empty. Each task fills a folder ``part=N`` (with Spark's writer
    one for each FILES_PER_FOLDER rows), which is renamed as a whole when the task is done."""
    whole = F.concat(F.col(id_col).cast("string"), F.lit("\n"), F.coalesce(text_col, F.lit("")))
    rows = spread_small_scan(df).select(whole.alias("value"))
    root = local_path(df.sparkSession, path)
    if root:
        write_files(rows, root)
    else:
        part = F.shiftright(F.monotonically_increasing_id(), FILES_PER_FOLDER.bit_length() - 1)
        rows.withColumn("part", part).write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)


def write_files(rows: DataFrame, root: str) -> None:
    """The rows (value) as files under a new local folder. Hadoop's local file system
    starts a process (chmod) for each file and each checksum file; open() does not."""
    os.makedirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = f"{root}/_temporary/{uuid.uuid4().hex}", 0
        os.makedirs(own)
        for batch in batches:
            for value in batch.column(0):
                with open(f"{own}/{n:09d}.txt", "xb") as f:
                    f.write((value.as_py() or b"") + b"\n")
                n += 1
        done = f"{root}/part={TaskContext.get().partitionId()}"
        try:
            if n:
                os.rename(own, done)
        except OSError:
            if not os.path.isdir(done):
                raise
        shutil.rmtree(own, ignore_errors=True)  # of no rows, or another attempt was first
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select(F.col("value").cast("binary")).mapInArrow(run, "n bigint").agg(F.sum("n")).collect()
    shutil.rmtree(f"{root}/_temporary", ignore_errors=True)


def split_docs(docs: DataFrame) -> DataFrame:
    """The documents of :func:`write_docs`: ``docs`` with the heading line as ``id``
    and the text after it, without the writer's line feed."""
    return docs.withColumn("id", F.substring_index("text", "\n", 1)).withColumn(
        "text", F.expr("substring(text, length(id) + 2, length(text) - length(id) - 2)"))
