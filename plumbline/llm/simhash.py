"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: bit j is 1 if it is set in over half of the
XXH64 values (seed 42) of its 3-word shingles, repeats included. Two fingerprints
link if they differ in at most RADIUS bits.

Covering masks (:func:`covering`): every bit place gets a non-zero vector of
RADIUS + 1 bits, and the mask of a non-zero vector v holds the places whose vector
has an odd product with v. Whatever RADIUS places two fingerprints differ in, some v
is orthogonal to all their vectors, so that mask holds none of them: every pair
within the radius has equal masked fingerprints in at least one of the 7 tables.
That is a guarantee, not a probability. A mask holds 36 or 37 of the 64 bits.

Buckets are bounded without dropping anything: the 27 or 28 places that a mask
leaves free are covered again by 7 masks, for the buckets above BUCKET fingerprints
only; 12 places stay free then, so such a bucket holds at most 4096 distinct
fingerprints. In a bucket all pairs are compared exactly, in numpy, and a spanning
forest of the links leaves the task: fewer links than members, equal components.

Scale: equal fingerprints are one class before any bucket is made, so a group of
copies is one row; seven 16-byte rows a class are shuffled, never a text; classes
with many documents are joined back by ``common.attach``.

Defined results: a null, empty or blank text has fingerprint zero and is linked like
any other; fewer than three words are one shingle; whole texts of any length are
read, in blocks of BLOCK shingles; rows with a null id are left out, as a component
is named by an id; repeated rows get one result each, and an id with several texts
one for each; ties do not arise (exactly half is not over half); an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import attach, store
from plumbline.llm.graph import components

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Members up to which a bucket is compared whole; at least 2 ** 12, see above.
BUCKET = 4096
#: Shingles hashed at once.
BLOCK = 1 << 15
#: Rows of buckets taken together in a task.
ROWS = 1 << 16
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.translate(FOLD).split() if text else []
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[SHINGLE - 1:].tolist() or [len(line)]
    n, total = len(stops), np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, BLOCK):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[a:a + BLOCK], stops[a:a + BLOCK], strict=False)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(sum(1 << j for j in np.flatnonzero(2 * total > n).tolist()))


def covering(places: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over ``places`` such that any ``radius`` of them lie outside of one."""
    top = 1 << (radius + 1)
    own = {p: 1 + k % (top - 1) for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (own[p] & v).bit_count() & 1) for v in range(1, top)]


MASKS = covering(list(range(BITS)))
#: For each mask, itself joined with the masks over the places that it leaves free.
FINER = [[m | x for x in covering([p for p in range(BITS) if not m >> p & 1])] for m in MASKS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(fp: Column, number: int, mask: int) -> Column:
    return F.struct(F.lit(number).alias("t"), F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(_signed(mask)))).alias("key"))


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): fp as the signed 64-bit integer of the same bits."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, f"id {kind}, fp bigint")


def forest(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between fingerprints."""
    root = list(range(fp.size))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i in range(fp.size - 1):
        near = np.flatnonzero(np.bitwise_count(fp[i + 1:] ^ fp[i]) <= radius)
        for j in (near + i + 1).tolist():
            x, y = find(i), find(j)
            if x != y:
                root[y] = x
                out.append((i, j))
    return out


def bucket_links(rows: DataFrame) -> DataFrame:
    """(a, b) of a spanning forest of each bucket's links, for rows (key, fp, id)."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            key, fp = table.column(0).to_numpy(), table.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.diff(key)) + 1
            first, last = np.append(0, cuts), np.append(cuts, key.size)
            a, b = [], []
            for s, e in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist(), strict=True):
                for i, j in forest(fp[s:e]):
                    a.append(s + i)
                    b.append(s + j)
            ids = table.column(2).combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
            if cut:
                yield links(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield links(pa.Table.from_batches(held).combine_chunks())

    sorted_rows = rows.select("key", "fp", "id").repartition("key").sortWithinPartitions("key", "fp")
    return sorted_rows.mapInArrow(run, f"a {kind}, b {kind}")


def near_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``classes`` (fp
    distinct, id) within the radius."""
    fp = F.col("fp")
    rows = classes.select("fp", "id", F.explode(F.array(*[_table(fp, t, m) for t, m in enumerate(MASKS)])).alias("x"))
    rows = store(rows.select("x.key", "x.t", "fp", "id"), "buckets")
    big = store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > BUCKET), "big-buckets")
    if big.isEmpty():
        return bucket_links(rows)
    marked = store(attach(rows, big, "key", "id", "w"), "marked")
    per_table = F.array(*[F.array(*[_table(fp, len(MASKS) * (t + 1) + k, m) for k, m in enumerate(ms)])
                          for t, ms in enumerate(FINER)])
    finer = marked.where("w is not null").select("fp", "id", F.explode(F.get(per_table, F.col("t"))).alias("x"))
    small = marked.where("w is null").select("key", "fp", "id")
    return bucket_links(small.union(finer.select("x.key", "fp", "id")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with an id: ``id_col``, ``fingerprint`` (16 hexadecimal
    digits) and ``component_id``, the least id of all texts linked to it directly or
    by others."""
    docs = store(fingerprints(df.where(F.col(id_col).isNotNull()), id_col, text_col), "fingerprints")
    classes = store(docs.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")), "classes")
    labels = components(store(near_links(classes.select("fp", "id")), "links"))
    roots = classes.join(labels, "id", "left").select("fp", F.coalesce("root", "id").alias("root"), "w")
    out = attach(docs, store(roots, "roots"), "fp", "id", "w")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("root").alias("component_id"))
