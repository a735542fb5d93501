"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the word windows of the benchmark items. For each pattern
length a block shift table says how far the search may jump when the last two
words of the current position are seen; most positions are never looked at. A
zero shift opens the bucket of that suffix block, whose patterns are compared
word by word.

Texts are read in place: one narrow pass and no shuffle. The patterns are
prepared in blocks of at most MAX_BLOCK_WORDS words (one item at least), so that
what a task holds is bounded however long the benchmark is. One block, the usual
case, is one pass. With more, the texts are written once, numbered; each block reads
them and writes only the numbers, spans and items of the texts that it hits, and
these meet the numbered rows in one join at the end.

Defined results: a null, empty or wordless text has no words and is clean; a very
long one is read whole; a null or wordless item has no window, and an item with a
null id is no item; equal items and repeated item rows all count by their distinct
id; repeated documents get one result each; an empty table of documents gives no
rows, an empty benchmark leaves all clean; other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ALNUM_GAP, split_words, store

#: Words of a window; an item with fewer is one window.
WINDOW = 13
#: Benchmark words searched for in one pass (about 60 MB of tables in a task).
MAX_BLOCK_WORDS = 200_000

#: A-Z to a-z, other ASCII characters that are no word characters to a space.
#: Bytes from 0x80 on belong to words, so UTF-8 can be split as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 after A-Z is lower-cased."""
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Word windows of some items, ready for search. ``items`` is (id, words)."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, words in items:
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words]
            size = min(window, len(codes))
            for i in range(len(codes) - size + 1 if size else 0):
                owners.setdefault(tuple(codes[i:i + size]), set()).add(item)
        self.owners = owners
        self.base = len(self.ids) + 1
        self.tables = {}
        for pattern in owners:
            size = len(pattern)
            block = min(2, size)
            shift, bucket = self.tables.setdefault(size, ({}, {}))
            for end in range(block, size + 1):
                key = self._block(pattern, end - 1, block)
                shift[key] = min(shift.get(key, size), size - end)
            bucket.setdefault(self._block(pattern, size - 1, block), []).append(pattern)

    def _block(self, codes, end: int, block: int) -> int:
        return codes[end] if block == 1 else codes[end - 1] * self.base + codes[end]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of words under any occurrence, and the items that occur."""
        code = self.ids.get
        codes = [code(w, 0) for w in words]
        n, spans, items = len(codes), [], set()
        for size, (shift, bucket) in self.tables.items():
            block = min(2, size)
            far = size - block + 1
            end = size - 1
            jump, base = shift.get, self.base
            while end < n:
                key = codes[end - 1] * base + codes[end] if block == 2 else codes[end]
                step = jump(key, far)
                if step:
                    end += step
                    continue
                here = codes[end - size + 1:end + 1]
                for pattern in bucket[key]:
                    if here == list(pattern):
                        spans.append((end - size + 1, end + 1))
                        items |= self.owners[pattern]
                        break
                end += 1
        merged: list[tuple[int, int]] = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        return merged, items


def item_blocks(bench: DataFrame, id_col: str, text_col: str, max_words: int) -> tuple[int, Iterator[list]]:
    """The items as (id, words): the number of blocks of about ``max_words`` words,
    and the blocks; each is collected by itself when its turn comes."""
    items = bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    items = items.where(F.col("id").isNotNull()).distinct()
    size = F.size(split_words(F.col("text").cast("string"), ALNUM_GAP))
    total = items.agg(F.sum(size.cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // max_words))

    def read() -> Iterator[list]:
        for b in range(blocks):
            mine = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
            yield [(r.id, words_of(bytes(r.text) if r.text is not None else None)) for r in mine]

    return blocks, read()


def search_pass(df: DataFrame, items: list, window: int) -> DataFrame:
    """Fill the columns n_words, spans and items of ``df`` (with a column text) for
    one block of patterns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = WuManber(items, window)
        for batch in batches:
            number, spans, found = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                merged, own = machine.search(words)
                number.append(len(words))
                spans.append([{"s": a, "e": b} for a, b in merged])
                found.append(sorted(own))
            cols = {"n_words": pa.array(number, pa.int64()), "items": pa.array(found, pa.list_(pa.string())),
                    "spans": pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))}
            yield pa.RecordBatch.from_arrays([cols.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def search_blocks(state: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """As one :func:`search_pass` over all blocks together."""
    rows = store(state.withColumn("row", F.monotonically_increasing_id()), "decontam-texts")
    number = F.size(split_words(F.col("text").cast("string"), ALNUM_GAP)).cast("long")
    hits = []
    for items in blocks:
        got = search_pass(rows.select("row", "text", "n_words", "spans", "items"), items, window)
        hits.append(store(got.where(F.size("items") > 0).select("row", "spans", "items"), "decontam-hits"))
    found = reduce(DataFrame.union, hits).groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    out = rows.select("id", "row", number.alias("n_words")).join(found, "row", "left")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return out.select("id", "n_words", none("spans"), F.array_sort(none("items")).alias("items"))


def hit_words(spans: Column) -> Column:
    """Words under sorted spans that may overlap."""
    end = F.aggregate(spans, F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s["to"], x["e"]).alias("to"),
        (s["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(s["to"], x["s"]))).cast("long").alias("n")))
    return end["n"]


def find_contamination(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                       percent: int = 5, max_block_words: int = MAX_BLOCK_WORDS,
                       carried: Column | None = None) -> DataFrame:
    """One row per input row: id, ``n_words``, ``spans`` (word positions under
    some occurrence), ``n_hit``, ``items`` (ids, as sorted strings) and
    ``contaminated``: at least ``percent`` of the words are hit, and one is.
    ``carried`` replaces the id by any column that is to stay with the row."""
    state = df.select((F.col(id_col) if carried is None else carried).alias("id"),
                      F.col(text_col).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"),
                      F.array().cast("array<struct<s:int,e:int>>").alias("spans"),
                      F.array().cast("array<string>").alias("items"))
    n, blocks = item_blocks(bench, item_id, item_text, max_block_words)
    state = search_pass(state, next(blocks), window) if n == 1 else search_blocks(state, blocks, window)
    out = state.withColumn("n_hit", hit_words(F.sort_array("spans")))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
    return out.select(F.col("id").alias(id_col if carried is None else "carried"),
                      "n_words", F.sort_array("spans").alias("spans"), "n_hit", "items", "contaminated")


def keep_clean(df: DataFrame, bench: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with ``df``'s own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = find_contamination(df, bench, text_col=text_col, carried=row, **options)
    return out.where(~F.col("contaminated")).select("carried.*")
