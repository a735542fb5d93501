"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of a ``.warc.gz`` file in the shared
scratch folder. Of pages with equal payloads of MIN_REVISIT bytes or more the one
with the least id is a response record, the others are revisit records.

Index: the captures are range-partitioned and sorted by reversed-host URL key
and page id. Each partition writes its lines as compressed blocks of BLOCK_LINES
lines (``.idx``) and a sparse directory with the first key and the byte range of
each block (``.dir``). Above that stands one first key per shard.

Lookup: a key finds its shard among the shards' first keys, then its block in the
shard's directory, both by binary search; the block is read by its byte range and
searched in turn; the record found is read by its byte range from the archive.

Scale: pages are compressed in the first task that sees them and shuffled once in
that form. Only the duplicated payloads' digests are joined, the most frequent
by broadcast (``common.attach``). Files are named by a fresh id in every task
attempt and are known only through the rows that the attempt returns, so a lost
or repeated task leaves at most a file that nothing refers to. Executors reach
the shared folder through ``pyarrow.fs``.

Defined results: null html is an empty payload; a null url has the empty key; a
page without id is a response if it has no equal with one; repeated rows of one
page are equal captures and each row gets its result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import attach, store
from plumbline.session import scratch_path

#: Payload bytes from which an equal payload is a revisit.
MIN_REVISIT = 100
#: Lines of an index block.
BLOCK_LINES = 500
#: Archive bytes whose records are read by one group of lookups.
READ_SPAN = 16 << 20
#: Parts that the lookups of one shard are dealt to.
LOOKUP_SPREAD = 8
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed host, then the rest: ``com,example,www)/path?query``."""
    u = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _record(kind: str, page, url: str | None, digest: str, size: int, block: bytes, refers=None) -> bytes:
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:page:{page}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": size,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": len(block),
    }
    if refers is not None:
        head["WARC-Refers-To"] = f"<urn:page:{refers}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return _member(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _part(base: str, suffix: str) -> str:
    return f"{base}/{uuid.uuid4().hex}{suffix}"


def write_archives(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html") -> DataFrame:
    """Write the archives under ``base``; one row per record: page, key, file,
    offset and length."""
    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"),
                       F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    sized = src.select("page", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    first = sized.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page").alias("first"), F.count(F.lit(1)).alias("w")).where("w > 1")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, size, member = [], [], []
            for page, url, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                body = payload.as_py()
                digest.append(hashlib.sha256(body).hexdigest())
                size.append(len(body))
                member.append(_record("response", page.as_py(), url.as_py(), digest[-1], len(body), HTTP + body))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest), pa.array(size, pa.int64()), pa.array(member, pa.binary())],
                ["page", "url", "digest", "size", "member"])

    ready = src.mapInArrow(packed, f"page {kind}, url string, digest string, size bigint, member binary")
    told = attach(ready, store(first, "warc-first"), "digest", "page", "w").drop("w")
    told = told.withColumn("key", url_key(F.col("url")))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(base)
        name, out, at = None, None, 0
        for batch in batches:
            offsets, lengths = [], []
            if out is None and batch.num_rows:
                system.create_dir(root, recursive=True)
                name = _part(base, ".warc.gz")
                out = system.open_output_stream(_at(name)[1], compression=None)
            for page, url, digest, size, member, origin in zip(*(batch.column(c) for c in (
                    "page", "url", "digest", "size", "member", "first")), strict=True):
                data, refers = member.as_py(), origin.as_py()
                if refers is not None and refers != page.as_py():
                    data = _record("revisit", page.as_py(), url.as_py(), digest.as_py(), size.as_py(), HTTP, refers)
                out.write(data)
                offsets.append(at)
                lengths.append(len(data))
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("key"), pa.array([name] * batch.num_rows, pa.string()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["page", "key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return store(told.mapInArrow(written, f"page {kind}, key string, file string, offset bigint, length bigint"), "captures")


def _order(page) -> int:
    return -(1 << 63) if page is None else page


def build_index(captures: DataFrame, base: str) -> DataFrame:
    """Write blocks and directories under ``base``; one row per shard: its name,
    first key and page, and number of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(base)
        name, out, at, lines, directory = None, None, 0, [], []

        def flush() -> int:
            data = zlib.compress(json.dumps(lines).encode())
            out.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            lines.clear()
            return at + len(data)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page", "file", "offset", "length")), strict=True):
                if out is None:
                    system.create_dir(root, recursive=True)
                    name = _part(base, "")
                    out = system.open_output_stream(_at(name + ".idx")[1], compression=None)
                lines.append([row[0], _order(row[1]), *row[2:]])
                if len(lines) == BLOCK_LINES:
                    at = flush()
        if out is None:
            return
        if lines:
            at = flush()
        out.close()
        with system.open_output_stream(_at(name + ".dir")[1], compression=None) as f:
            f.write(zlib.compress(json.dumps(directory).encode()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()),
             pa.array([len(directory)], pa.int64())], ["shard", "key", "page", "blocks"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.repartitionByRange(parts, "key", "page").sortWithinPartitions("key", "page")
    return store(ranged.mapInArrow(run, "shard string, key string, page bigint, blocks bigint"), "shards")


def lookup(queries: DataFrame, shards: DataFrame) -> DataFrame:
    """For every (key, page) row: file, offset and length of its capture (null
    if there is none). The shards' first keys, one per shard, go to all tasks."""
    tops = sorted((r.key, r.page, r.shard) for r in shards.collect())
    firsts, names = [t[:2] for t in tops], [t[2] for t in tops]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(firsts, (k, _order(p))) - 1 for k, p in zip(
                batch.column("key").to_pylist(), batch.column("page").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "shard"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, directory, file, block, lines, keys, system = None, [], None, None, [], [], None
        for batch in batches:
            got: list[list] = []
            for key, page, s in zip(*(batch.column(c).to_pylist() for c in ("key", "page", "shard")), strict=True):
                want = (key, _order(page))
                if s < 0:
                    got.append([None] * 3)
                    continue
                if s != shard:
                    system, path = _at(names[s] + ".dir")
                    with system.open_input_stream(path, compression=None) as f:
                        directory = json.loads(zlib.decompress(f.read()))
                    if file is not None:
                        file.close()
                    file = system.open_input_file(_at(names[s] + ".idx")[1])
                    shard, block = s, None
                b = bisect_right(directory, want, key=lambda d: (d[0], d[1])) - 1
                if b != block:
                    file.seek(directory[b][2])
                    lines = json.loads(zlib.decompress(file.read(directory[b][3])))
                    keys, block = [(x[0], x[1]) for x in lines], b
                i = bisect_left(keys, want)
                got.append(lines[i][2:] if i < len(keys) and keys[i] == want else [None] * 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()),
                 pa.array([g[2] for g in got], pa.int64())], ["page", "file", "offset", "length"])
        if file is not None:
            file.close()

    rows = queries.select("key", "page").mapInArrow(dealt, "key string, page bigint, shard int")
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "shard", F.pmod(F.xxhash64("key", "page"), F.lit(LOOKUP_SPREAD)))
    return rows.sortWithinPartitions("shard", "key", "page").mapInArrow(
        found, "page bigint, file string, offset bigint, length bigint")


def read_records(places: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records by their byte ranges: page, ``payload_bytes``,
    ``payload_digest`` (recomputed where the record holds the payload),
    ``record_type``, ``refers_to`` and, if asked for, ``payload``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out: list[tuple] = []
            for page, path, offset, length in zip(*(batch.column(c).to_pylist() for c in (
                    "page", "file", "offset", "length")), strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    system, local = _at(path)
                    name, file = path, system.open_input_file(local)
                file.seek(offset)
                head, body = parse_record(file.read(length))
                refers = head.get("WARC-Refers-To")
                if refers is None:
                    out.append((page, len(body), hashlib.sha256(body).hexdigest(), "response", None, body))
                else:
                    out.append((page, int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"),
                                "revisit", int(refers[len("<urn:page:"):-1]), None))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            n = 6 if payloads else 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols[:n], kinds[:n], strict=True)], names[:n])
        if file is not None:
            file.close()

    parts = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = places.where(F.col("file").isNotNull()).repartition(
        parts, "file", F.floor(F.col("offset") / READ_SPAN)).sortWithinPartitions("file", "offset")
    schema = "page bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return near.mapInArrow(run, schema + ", payload binary" * payloads)


def archive_and_read(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                     html_col: str = "html") -> DataFrame:
    """Write all pages, index them, look every page up by its key and read its
    record back: one row per page row."""
    pages = pages.withColumn(id_col, F.col(id_col).cast("long"))
    base = scratch_path(spark, "warc")
    captures = write_archives(pages, f"{base}/archives", id_col, url_col, html_col)
    shards = build_index(captures, f"{base}/index")
    wanted = pages.select(url_key(F.col(url_col)).alias("key"), F.col(id_col).alias("page"))
    return read_records(lookup(wanted, shards)).withColumnRenamed("page", id_col)
