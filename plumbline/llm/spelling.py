"""Spelling variants by dynamic programming over sorted lists of the vocabulary.

Two words are near if one inserted, deleted or replaced code point makes one the
other. Pairs are found by scanning sorted word lists with the edit matrix: row d
holds the distances of the list word's first d code points from the prefixes of the
query word, and only its three cells next to the diagonal matter (:class:`SortedList`).
Words next to each other in the sorted list share the rows of their longest common
prefix (LCP), so a row is computed once for a whole range of words with that prefix,
and a range whose row has no cell of one or less is skipped whole. The ranges of one
depth are taken together in numpy, for all query words of many lists.

Which lists a word is scanned against follows from the edit's place. Cut the shorter
word, of m code points, into s segments: the edit lies in one of them, and what
stands before and after that segment is equal in both words. So words are grouped by
(m, segment, text before, text after), each word once as the shorter and once as the
longer one, for s = 2. A group above GROUP words is taken apart by s = 4, 8 and so
on, only inside its own segment. When segments are single code points, a group holds
at most 90 words of m and 90 * 90 of m + 1 code points, as the alphabet has 90
letters: below GROUP, so every word is compared with all of its near words and no
group is unbounded. A pair comes out once, in the segment of its first difference.

Scale: texts are counted per batch before the shuffle (word, n); the lists shuffle
at most four short rows a word; one task holds one group and CHUNK words; forms are
followed by pointer doubling (a form is five times as frequent as its word, so a
chain has at most log5 of the largest count links), with ``common.attach`` for roots
of many words.

Defined results: a null, empty or letterless text has no words; a null id is written
as nothing before the colon; repeated rows count again, and each row with its own id
and text counts for itself; of several nearest words of equal n the smallest in
code-point order is the form; words of any length are compared whole; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import attach, store

#: Fixed values of the contract: letters, the deletion's modulus, least length and
#: occurrences of a word, least ratio of a form's n to its word's.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOSS, LEAST_LENGTH, LEAST_N, RATIO = 199, 6, 5, 5
#: Words of a group that one task may hold; more than 90 + 90 * 90.
GROUP = 20_000
#: Words scanned at once.
CHUNK = 1 << 15
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def changed(run: str, doc: str) -> str:
    """``run`` of document ``doc``, less one code point where the hash asks for it."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % LOSS:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def vocabulary(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the words with the least length and occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py()
                if not data:
                    continue
                for word, n in Counter(RUN.findall(data.translate(FOLD).decode())).items():
                    if len(word) >= LEAST_LENGTH:
                        total[changed(word, doc)] += n
            words = [w for w in total if len(w) >= LEAST_LENGTH]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    src = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    counts = src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_N)


class SortedList:
    """Words of several groups one after the other, sorted within each, as a flat
    array of code points with the LCP of each word and the one before it."""

    def __init__(self, words: list[str], group: np.ndarray):
        data = [w.encode("latin-1") for w in words]
        self.length = np.array([len(w) for w in data], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(data) + b"\0", np.uint8)
        self.group = group
        self.lcp = self._lcp()
        order = np.argsort(self.lcp, kind="stable")
        self._by_lcp, self._lcp_sorted = order, self.lcp[order]

    def at(self, word: np.ndarray, d: np.ndarray | int) -> np.ndarray:
        """Code point d of each word; 0 before its start and past its end."""
        inside = (d >= 0) & (d < self.length[word])
        return self.flat[np.where(inside, self.start[word] + d, self.flat.size - 1)]

    def _lcp(self) -> np.ndarray:
        out = np.zeros(self.length.size, dtype=np.int64)
        live = np.flatnonzero(np.append(False, self.group[1:] == self.group[:-1]))
        out[0] = -1
        out[1:][self.group[1:] != self.group[:-1]] = -1
        d = 0
        while live.size:
            c = self.at(live, d)
            live = live[(c == self.at(live - 1, d)) & (c > 0)]
            d += 1
            out[live] = d
        return out

    def splits(self, d: int) -> np.ndarray:
        """Positions whose LCP is d, ascending: where ranges of depth d part."""
        a, b = np.searchsorted(self._lcp_sorted, [d, d + 1])
        return self._by_lcp[a:b]

    def near(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, word, place) of all pairs of one group at one edit, the query
        before the word; place is the length of their common prefix.

        A range (lo, hi) holds words that share their first d code points; ``row``
        are the three cells (d, d-1), (d, d), (d, d+1) of the matrix, capped at 2."""
        n = self.length.size
        ends = np.append(np.flatnonzero(np.diff(self.group)) + 1, n)
        query = np.arange(n)
        hi = ends[np.searchsorted(ends, query, "right")]
        lo = query + 1
        keep = lo < hi
        query, lo, hi = query[keep], lo[keep], hi[keep]
        row = np.tile(np.array([2, 0, 1], dtype=np.int8), (query.size, 1))
        place = np.zeros(query.size, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        d = 0
        while query.size:
            parts = self.splits(d)
            first = np.searchsorted(parts, lo, "right")
            count = np.maximum(np.searchsorted(parts, hi, "left") - first, 0) + 1
            owner = np.repeat(np.arange(query.size), count)
            nth = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count)
            begin = np.where(nth == 0, lo[owner], parts[np.minimum(first[owner] + nth - 1, parts.size - 1)] if parts.size else 0)
            end = np.where(nth + 1 == count[owner], hi[owner], np.append(begin[1:], 0))
            query, row, place = query[owner], row[owner], place[owner]
            c, more = self.at(begin, d), self.length[begin] > d
            # a word that ends here stands alone in its range
            done = ~more
            gap = self.length[query[done]] - d
            hit = (np.abs(gap) <= 1) & (row[done][np.arange(gap.size), np.clip(gap + 1, 0, 2)] == 1)
            found.append((query[done][hit], begin[done][hit], place[done][hit]))
            query, row, place, begin, end, c = (x[more] for x in (query, row, place, begin, end, c))
            new = np.empty_like(row)
            new[:, 0] = np.minimum(row[:, 0] + (c != self.at(query, d - 1)), row[:, 1] + 1)
            new[:, 1] = np.minimum(np.minimum(row[:, 1] + (c != self.at(query, d)), row[:, 2] + 1), new[:, 0] + 1)
            new[:, 2] = np.minimum(row[:, 2] + (c != self.at(query, d + 1)), new[:, 1] + 1)
            new = np.minimum(new, 2)
            place = np.where(new[:, 1] == 0, d + 1, place)
            live = new.min(axis=1) <= 1
            query, row, place, lo, hi = query[live], new[live], place[live], begin[live], end[live]
            d += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def _entry(word: Column, m: Column, i: Column, s: int) -> Column:
    """The list row of ``word`` for shorter length m and segment i of s; null for an
    empty segment."""
    lo, hi = F.floor(i * m / s).cast("int"), F.floor((i + 1) * m / s).cast("int")
    size = F.length(word)
    key = F.xxhash64(m, lo, hi, F.substring(word, F.lit(1), lo), F.substring(word, size - m + hi + 1, m - hi))
    return F.when(lo < hi, F.struct(key.alias("key"), m.alias("m"), i.alias("i"), lo.alias("lo"), hi.alias("hi")))


def list_rows(words: DataFrame) -> DataFrame:
    """(key, m, i, lo, hi, word, n) for s = 2."""
    m = F.explode(F.expr(f"filter(array(length(word), length(word) - 1), x -> x >= {LEAST_LENGTH})"))
    rows = words.select("word", "n", m.alias("m")).withColumn("i", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select(_entry(F.col("word"), F.col("m"), F.col("i"), 2).alias("x"), "word", "n").select("x.*", "word", "n")


def finer_rows(rows: DataFrame, s: int) -> DataFrame:
    """The rows of s / 2 segments, cut into s."""
    halves = rows.select("m", F.explode(F.array(F.col("i") * 2, F.col("i") * 2 + 1)).alias("i"), "word", "n")
    out = halves.select(_entry(F.col("word"), F.col("m"), F.col("i"), s).alias("x"), "word", "n")
    return out.where("x is not null").select("x.*", "word", "n")


def list_pairs(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n), in both directions, of the pairs within one group."""
    cols = ("key", "m", "lo", "hi", "word", "n")

    def pairs(table: pa.Table) -> pa.RecordBatch:
        key, m, lo, hi, n = (table.column(c).to_numpy() for c in ("key", "m", "lo", "hi", "n"))
        words = table.column("word").to_pylist()
        index = SortedList(words, np.append(0, np.cumsum(key[1:] != key[:-1])))
        a, b, place = index.near()
        short = np.minimum(index.length[a], index.length[b])
        own = (short == m[a]) & (m[a] == m[b]) & (lo[a] <= place) & ((place < hi[a]) | ((place >= hi[a]) & (hi[a] == m[a])))
        a, b = a[own], b[own]
        left, right = np.concatenate([a, b]), np.concatenate([b, a])
        text = table.column("word").combine_chunks()
        return pa.RecordBatch.from_arrays([text.take(pa.array(left)), pa.array(n[left]), text.take(pa.array(right)),
                                           pa.array(n[right])], ["word", "n", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield pairs(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield pairs(pa.Table.from_batches(held).combine_chunks())

    lists = rows.select(*cols).repartition("key").sortWithinPartitions("key", "word", "m", "lo")
    return lists.mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all near words of a table (word, n) of distinct words."""
    rows, s, out = store(list_rows(words), "lists"), 2, None
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("w"))
        big = store(sizes.where(F.col("w") > GROUP), "big-groups")
        if big.isEmpty():
            pairs = list_pairs(rows)
            return pairs if out is None else out.union(pairs)
        marked = store(attach(rows, big, "key", "word", "w"), "marked")
        pairs = store(list_pairs(marked.where("w is null")), "pairs")
        out = pairs if out is None else out.union(pairs)
        s *= 2
        rows = store(finer_rows(marked.where("w is not null"), s), "lists")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, by doubling."""
    at = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = at.groupBy(F.col("root").alias("mid")).agg(F.count(F.lit(1)).alias("w"))
        hop = store(ends.join(at.select(F.col("word").alias("mid"), F.col("root").alias("next")), "mid"), "hop")
        if hop.isEmpty():
            return at
        on = attach(at.withColumnRenamed("root", "mid"), hop, "mid", "word", "w")
        at = store(on.select("word", F.coalesce("next", "mid").alias("root")), "roots")


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word``, ``n`` (occurrences), ``n_near`` (near words),
    ``form`` (the near word of largest n, if at least RATIO times the word's), its
    ``form_n``, and ``root`` (forms followed from the word to the last)."""
    words = store(vocabulary(df, id_col, text_col), "vocabulary")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    best = best.select("word", "n_near", F.col("b.form").alias("best"), (-F.col("b.less")).alias("best_n"))
    fits = F.col("best_n") >= RATIO * F.col("n")
    out = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    roots = followed(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
