"""MinHash near-duplicates by a multi-index Hamming join.

A text's set is its distinct 5-word shingles (64-bit hashes). Its signature has
CHUNKS x WIDTH symbols of 8 bits, each the low bits of a minimum hash. Two sets of
similarity 0.85 differ in about 15 % of the symbols. If two signatures differ in
at most ``2 * CHUNKS - 1`` symbols, then by the pigeonhole principle some chunk
differs in at most one; so each chunk is indexed once for each symbol left out,
and all pairs under that distance meet under some key. Links at a larger distance
are not confirmed: by the binomial tail about 8e-5 of those at similarity 0.85, and
2e-5 at 0.86.

From keys to components, without all pairs of a group:

1. Equal sets are one class; only classes are compared.
2. Star round: in each bucket one member, the centre, is paired with the others;
   pairs are made distinct, filtered by signature distance and by a bound of the
   intersection (counts of the sets' hashes per bin), and confirmed on full sets. Confirmed links are contracted into components.
3. What is left of a bucket are pairs of members of different components, as
   copies of one text mostly fall together in the first rounds. Star rounds go on
   (each takes one more member out of every open bucket) while they pay, then
   the rest is compared directly, in tiles of two parts of a bucket.

No pair within that distance stays untested unless both ends are already in one
component, so the components are those of all links but that tail.

Scale: keys are 8-byte integers, pre-aggregated per bucket; hot buckets and hot
classes go through ``common.attach``; texts are shuffled once, keyed by class.
Every round's state is a written table in the shared folder.

Defined results: a null, empty or blank text has the empty set, is linked with
nothing and is its own component; rows with a null id are left out, as a
component is named by an id; repeated rows of one id and text get one result
each; an id names one text (of several texts under one id, each row is judged by
its own); other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import attach, store
from plumbline.llm.graph import components

SHINGLE = 5
CHUNKS, WIDTH = 12, 6
SYMBOLS = CHUNKS * WIDTH
#: Cells of a set's count vector, see :func:`counts`.
BINS = 256
#: Signatures further apart are not confirmed.
MAX_DISTANCE = 2 * CHUNKS - 1
#: Star rounds go on while more than PAIRS_PER_TEXT pairs per class are open and
#: the last round left at most GAIN of those before it.
PAIRS_PER_TEXT, GAIN = 1, 0.8
#: Members of a bucket's part in the direct comparison.
TILE = 512
#: Members of a tile's side whose sets are held together when pairs are confirmed.
CELL = 128
PERCENT = 85

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), applied to each element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FLIPS = _mix(_SEEDS)
_PLACES = _mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a UTF-8 text."""
    words = text.translate(FOLD).split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    w = _mix(np.array([digest(x) for x in words], dtype=np.uint64))
    n = w.size - SHINGLE + 1
    h = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        h = _mix(h ^ w[k:k + n]) * _PLACES[k]
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """SYMBOLS bytes: for each seed, bits of the least seeded hash."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, hashes.size, 4096):
        part = (hashes[a:a + 4096, None] ^ _FLIPS) * _SEEDS
        least = np.minimum(least, part.min(axis=0))
    return (_mix(least) >> np.uint64(40)).astype(np.uint8)


def counts(hashes: np.ndarray) -> np.ndarray:
    """BINS bytes: how many of a set's hashes fall into each bin, 255 at most."""
    return np.minimum(np.bincount((hashes & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def can_link(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``nx``, ``ny`` and counts ``x``, ``y`` (rows) may have
    the similarity. The smaller counts' sum, and what the larger of the two leaves
    uncounted, bound the intersection from above, so no link is lost."""
    past = np.minimum(nx - x.sum(axis=1, dtype=np.int64), ny - y.sum(axis=1, dtype=np.int64))
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64) + past
    return 100 * most >= percent * (nx + ny - most)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, SYMBOLS) int64: for every chunk and left-out symbol, the other
    five symbols (40 bits) with the number of the pair (7 bits)."""
    s = sig.reshape(-1, CHUNKS, WIDTH).astype(np.int64)
    out = []
    for c in range(CHUNKS):
        for gap in range(WIDTH):
            key = np.full(s.shape[0], c * WIDTH + gap, dtype=np.int64)
            for j in range(WIDTH):
                if j != gap:
                    key = key << 8 | s[:, c, j]
            out.append(key)
    return np.stack(out, axis=1)


def signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, cls, sig, cnt): set size, content hash of the set (null if empty), signature and counts."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sig, cnt = [], [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py())
                n.append(h.size)
                cls.append(hashlib.sha256(h.tobytes()).digest()[:16] if h.size else None)
                sig.append(signature(h).tobytes() if h.size else None)
                cnt.append(counts(h).tobytes() if h.size else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.binary()) for x in (cls, sig, cnt)]],
                ["id", "n", "cls", "sig", "cnt"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, f"id {kind}, n bigint, cls binary, sig binary, cnt binary")


def bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, id) of every class and each of its keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8)
                keys = chunk_keys(sig)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), SYMBOLS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1), pa.int64()), ids], ["key", "id"])

    kind = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "sig").mapInArrow(run, f"key bigint, id {kind}")


def near_signatures(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(cell, a, b) of the pairs whose signatures differ in at most MAX_DISTANCE
    symbols and whose set sizes and counts allow the similarity; each is a cell of
    its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SYMBOLS) for c in (2, 3))
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in (4, 5))
            near = ((x != y).sum(axis=1) <= MAX_DISTANCE) & can_link(
                u, v, batch.column(6).to_numpy(), batch.column(7).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    sigs = classes.select("id", "sig", "cnt", "n")
    both = pairs.join(sigs.toDF("a", "sa", "ca", "na"), "a").join(sigs.toDF("b", "sb", "cb", "nb"), "b")
    both = both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select(
        "a", "b", "sa", "sb", "ca", "cb", "na", "nb")
    return both.mapInArrow(run, pairs.schema).select(F.xxhash64("a", "b").alias("cell"), "a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of (cell, a, b) whose full sets have the similarity.

    A cell's texts come before its pairs, each once, so a set is made once for all
    pairs of the cell and no text is repeated for each pair. A task holds the sets
    of one cell: at most 2 * CELL."""
    ids = pairs.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        sets: dict[object, np.ndarray] = {}
        for batch in batches:
            left, right, text = [], [], batch.column(3)
            for at, (cell, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if cell != now:
                    now, sets = cell, {}
                if b is None:
                    sets[a] = shingle_set(text[at].as_py())
                    continue
                x, y = sets[a], sets[b]
                common = np.intersect1d(x, y, assume_unique=True).size
                if 100 * common >= percent * (x.size + y.size - common):
                    left.append(a)
                    right.append(b)
            kind = batch.column(1).type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind)], ["a", "b"])

    ends = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
    held = ends.join(texts, "id").select("cell", F.col("id").alias("a"), F.lit(None).cast(ids["b"].dataType).alias("b"), "text")
    asked = pairs.select("cell", "a", "b", F.lit(None).cast("binary").alias("text"))
    rows = held.union(asked).repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull(), "a")
    return rows.mapInArrow(run, ids)


def open_buckets(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, id, root) of the buckets whose members are in several components."""
    if labels is None:
        return rows
    plain = rows.select("key", "id") if "root" in rows.columns else rows
    out = plain.join(labels, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    several = out.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("w"))
    return attach(out, several.where("lo != hi").select("key", "w"), "key", "id", "w", keep_unmatched=False).drop("w")


def star_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (a, b) of each bucket's centre with its other members, and the
    rows without the centres. The centre is the least id of the bucket's
    smallest component."""
    if "root" in rows.columns:
        part = rows.groupBy("key", "root").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        centre = part.groupBy("key").agg(F.min_by("id", F.struct("n", "id")).alias("c"), F.sum("n").alias("w"))
    else:
        centre = rows.groupBy("key").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("w"))
    met = store(attach(rows, store(centre.where("w > 1"), "centres"), "key", "id", "w", keep_unmatched=False).drop("w"), "met")
    others = met.where("id != c")
    apart = others.join(met.where("id = c").select("key", F.col("root").alias("own")), "key").where("root != own") \
        if "root" in rows.columns else others
    pairs = apart.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
    return pairs, others.drop("c")


def first_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of the first key that two signatures share, for rows of ``x``
    and ``y``; SYMBOLS if they share none."""
    miss = (x != y).reshape(-1, CHUNKS, WIDTH)
    errors = miss.sum(axis=2)
    chunk = (errors <= 1).argmax(axis=1)
    row = np.arange(chunk.size)
    number = chunk * WIDTH + np.where(errors[row, chunk] == 1, miss[row, chunk].argmax(axis=1), 0)
    return np.where(errors[row, chunk] <= 1, number, SYMBOLS)


def direct_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct (cell, a, b) of one bucket, different components, near signatures,
    and sizes and counts that allow the similarity.

    A bucket is cut into parts of about TILE members and every two parts meet in
    one tile, whose members are compared in numpy; a pair comes out once, under
    the first key that its signatures share. No pair is a row before it is near.
    A cell is CELL by CELL members of a tile."""
    size = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("g"), F.count(F.lit(1)).alias("w"))
    cut = attach(rows, size, "key", "id", "w").join(classes.select("id", "sig", "cnt", "n"), "id")
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    tiled = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "root", "sig", "cnt", "n")
    kind = rows.schema["id"].dataType.simpleString()

    def near(tile: pd.DataFrame) -> pd.DataFrame:
        lo, hi, key = tile["lo"].iat[0], tile["hi"].iat[0], int(tile["key"].iat[0])
        number = key >> 40
        ids, roots, part, n = (tile[c].to_numpy() for c in ("id", "root", "mine", "n"))
        sig = np.frombuffer(b"".join(tile["sig"]), np.uint8).reshape(-1, SYMBOLS)
        cnt = np.frombuffer(b"".join(tile["cnt"]), np.uint8).reshape(-1, BINS)
        left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        place = np.zeros(ids.size, dtype=np.int64)
        place[right] = np.arange(right.size) // CELL
        out = []
        for p, i in enumerate(left):
            j = right[roots[right] != roots[i]]
            if lo == hi:
                j = j[j > i]
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            j = j[(sig[j] != sig[i]).sum(axis=1) <= MAX_DISTANCE]
            j = j[first_key(sig[j], np.broadcast_to(sig[i], (j.size, SYMBOLS))) == number]
            j = j[can_link(cnt[j], cnt[i:i + 1], n[j], n[i], percent)]
            if j.size:
                out.append(pd.DataFrame({"key": key, "lo": lo, "hi": hi, "row": p // CELL, "col": place[j],
                                         "a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])}))
        return pd.concat(out) if out else pd.DataFrame(
            {"key": [], "lo": [], "hi": [], "row": [], "col": [], "a": ids[:0], "b": ids[:0]})

    pairs = tiled.groupBy("key", "lo", "hi").applyInPandas(
        near, f"key bigint, lo int, hi int, row int, col int, a {kind}, b {kind}")
    return pairs.select(F.xxhash64("key", "lo", "hi", "row", "col").alias("cell"), "a", "b")


def open_pairs(rows: DataFrame) -> int:
    """Pairs of one bucket and different components, each bucket for itself."""
    part = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    each = part.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("p"))
    return int(each.agg(F.sum("p")).first()[0] or 0)


def class_texts(df: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the classes' own rows."""
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return texts.join(classes.select("id"), "id", "left_semi")


def class_links(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame | None:
    """(id, root) of all classes that are linked with others; None if none is."""
    texts = class_texts(df, classes, id_col, text_col)
    rows, labels = store(bucket_rows(classes), "buckets"), None
    budget = PAIRS_PER_TEXT * classes.count()
    left = math.inf
    while True:
        pairs, rest = star_pairs(rows)
        links = store(confirmed(store(near_signatures(pairs, classes, percent), "near"), texts, percent), "links")
        labels = components(links, labels)
        plain = rest.select("key", "id")
        rows = store(open_buckets(plain, labels), "open")
        before, left = left, open_pairs(rows)
        if left <= budget or left > GAIN * before:
            break
    if left:
        near = store(direct_pairs(rows, classes, percent), "near")
        labels = components(store(confirmed(near, texts, percent), "links"), labels)
    return labels


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """One row per input row with an id: ``id_col``, ``n_shingles`` and
    ``component_id``, the least id of all texts linked to it directly or by others."""
    df = df.where(F.col(id_col).isNotNull())
    docs = store(signed(df, id_col, text_col), "signed")
    classes = store(docs.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("cnt").alias("cnt"), F.first("n").alias("n"),
        F.count(F.lit(1)).alias("w")), "classes")
    labels = class_links(df, classes, id_col, text_col, percent)
    roots = classes.join(labels, "id", "left").select("cls", F.coalesce("root", "id").alias("root"), "w")
    out = attach(docs.select("id", "n", "cls"), store(roots, "roots"), "cls", "id", "w")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.coalesce("root", "id").alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each component, that of the least id; rows with a
    null id stay. Columns as in ``df``."""
    out = near_duplicates(df, id_col, text_col, percent)
    kept = out.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    first = df.join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return first.union(df.where(F.col(id_col).isNull()))
