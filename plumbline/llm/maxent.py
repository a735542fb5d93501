"""A hashed maximum-entropy language model with a class-factored softmax.

Words are leaves of two levels of classes: P(word | history) = P(class | history)
P(leaf | class, history) P(word | leaf). Leaves hold equal shares of the training
tokens: the words are taken by falling count and a leaf is closed when its share is
full, so a frequent word has a leaf of its own. The last leaf is the tail: all words
outside the HOT_WORDS most frequent, those seen once, and every unknown word. Inside a leaf a word has
its relative frequency (smoothed in the tail), so the probabilities of all words sum
to one.

Both softmaxes add to the leaves' shares, which act as the bias, the weights of three
hashed features: the previous word, the two previous words, and the word before the
previous one (a skip). In the second level features are hashed inside the class.

The model is dealt to shards by history: all tokens after a word are in one shard, those
after a frequent word are dealt by the word before it. A shard has weights of its own, so
that a task holds the weights of one shard only, and learns from all training tokens of
its histories:

1. The observed count of every (feature row, class). The first weights are the mean
   of the three features' smoothed log-odds.
2. ROUNDS gradient updates. Observed less expected counts over all the shard's training
   tokens, less the Gaussian prior's pull, is the gradient of the log-likelihood, and
   each weight moves by it, divided by its own expected count (its curvature, by which
   the step does not depend on the number of tokens).

Tokens of equal history (and class, at the second level) have equal probabilities: a shard's
tokens are sorted, and each distinct history is computed once and weighted by its tokens.

Shards and their histories follow from the counts of words, so the weights depend on the
rows and not on how they are dealt to partitions (but for the rounding of sums).

What is gathered grows with the corpus: the counts of all words (a table, joined);
classes a level, 2 ** (log2(words) / 5); and the model: one feature row for each
ROW_TOKENS training tokens, for each of the three features and two levels, and one shard
for SHARD_TOKENS tokens. A shard's weights (3 * 2 * MAX_ROWS * classes floats, 25 MB at 32
classes) bound the memory of a task, not the model. One history (a pair of words, or
the start of a text) is never split.

Texts are split into words twice: to count them, and to write them as word numbers,
the table from which the shards' tokens are shuffled, once, as compressed arrays. The HOT_WORDS most frequent words, a fixed
bound, travel with the tasks; every other word of a text is looked up by a shuffle
join, so the vocabulary may grow without bound.

Defined results: a null or empty text is one end token; rows with a null id are held
out; repeated rows get one result each (and count each in training); words of equal
count go in byte order; very long texts are scored whole, in batches of tokens;
without training tokens all counts are 0, and the tail is the only leaf; an empty
table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import store

ROUNDS = 2
FEATURES = 3
#: Training tokens for one feature row, rows of each feature and level in a shard, and
#: training tokens of a shard.
ROW_TOKENS, MIN_ROWS, MAX_ROWS = 1 << 5, 1 << 10, 1 << 15
SHARD_TOKENS = ROW_TOKENS * MAX_ROWS
#: A previous word with more than this part of a shard's tokens is split by the word before it.
UNITS = 8
#: Counts by which a feature row's first weights are drawn to the leaves' shares, and
#: the inverse variance of the weights' Gaussian prior.
PRIOR, SPREAD = 50.0, 4.0
#: A gradient update's rate (the features move together) and largest change.
RATE, MOST = 1 / FEATURES, 1.0
#: Words whose counts every task holds.
HOT_WORDS = 1 << 18
#: Numbers of other words in histories.
OTHER_WORDS = 1 << 24
#: Tokens of one numpy batch, and of a batch that is dealt to the shards.
BATCH_TOKENS, DEAL_TOKENS = 1 << 14, 1 << 19
#: Tokens whose expected counts are summed at once.
SUM_TOKENS = 1 << 15
SMOOTH = 0.1
#: The end token: no word holds white space.
END = b"\n"
#: Text that is split into words at once.
SLICE_BYTES = 1 << 22


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with ``text`` in parts of some SLICE_BYTES of text, whole texts each."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(size) - size) // SLICE_BYTES
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), size.size] if size.size else []):
        yield batch.slice(a, b - a)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one text after the other, and each text's number."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # empty pieces at a text's ends
    words = split.flatten()
    real = pc.not_equal(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return words.filter(real), np.diff(before[split.offsets.to_numpy()])


def held_out(id_col: Column, fold: int = 10) -> Column:
    """True where crc32 of the id as text leaves no remainder; null ids too."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % fold == 0, F.lit(True))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) over ``texts`` (text binary), summed per batch before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                c = words_of(part.column(0))[0].value_counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([c.field("values").view(pa.binary()), pa.array([END], pa.binary())]),
                     pa.concat_arrays([c.field("counts"), pa.array([part.num_rows], pa.int64())])], ["word", "c"])

    return texts.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The hot words with their counts (most frequent first), totals, and leaves."""
    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}
        self.tail_total = self.total - int(self.counts.sum())
        self.tail_words = self.distinct - len(self.words)
        self.classes = max(4, 1 << int(math.log2(max(self.distinct, 1)) / 5))
        full = (self.classes ** 2 - 1) / max(int(self.counts.sum()), 1)
        share = ((np.cumsum(self.counts) - self.counts) * full).astype(np.int64)
        leaf = np.unique(share, return_inverse=True)[1].reshape(-1) if share.size else share
        self.tail_leaf = int(leaf.max()) + 1 if leaf.size else 0
        #: The leaf of every hot word, then that of all others.
        self.leaf = np.append(leaf, self.tail_leaf).astype(np.int64)
        mass = np.bincount(leaf, self.counts, self.classes ** 2) if leaf.size else np.zeros(self.classes ** 2)
        self.inside = np.append(np.log10(self.counts / mass[leaf]), 0.0) if leaf.size else np.zeros(1)
        mass[self.tail_leaf] = self.tail_total + SMOOTH * (self.tail_words + 1)
        by_class = mass.reshape(self.classes, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # no share: a leaf that holds no word
            first = np.log(by_class.sum(axis=1) / mass.sum())
            second = np.log(by_class / by_class.sum(axis=1, keepdims=True))
        self.bias = [np.where(np.isfinite(b), b, -40.0).astype(np.float32) for b in (first, second)]
        self.shards = max(1, -(-self.total // SHARD_TOKENS))
        #: Shards that a previous word's histories may go to: hot words, then all others.
        self.splits = np.append(-(-self.counts * UNITS // SHARD_TOKENS), 1).clip(1).astype(np.uint64)
        rows = 1 << max(self.total // self.shards // ROW_TOKENS, 1).bit_length() - 1
        self.rows = min(max(rows, MIN_ROWS), MAX_ROWS)

    def base(self, c):
        return np.log10((c + SMOOTH) / (self.total + SMOOTH * (self.distinct + 1)))

    def targets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class, and leaf in it, of word numbers."""
        leaf = self.leaf[np.minimum(ids, len(self.words))]
        return leaf // self.classes, leaf % self.classes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def histories(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The previous word of each token and the one before it, as number + 3 (1: none).
    ``ids`` are word numbers of texts one after the other, ``start`` the place of each
    token in its text."""
    w = ids.astype(np.uint64) + np.uint64(3)
    return (np.where(start >= 1, np.roll(w, 1), np.uint64(1)),
            np.where(start >= 2, np.roll(w, 2), np.uint64(1)))


def hashed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(tokens, FEATURES) hashes of the histories."""
    return _mixed(np.stack([one << np.uint64(2), (one << np.uint64(32)) ^ (two << np.uint64(2)) ^ np.uint64(1),
                            two << np.uint64(2) ^ np.uint64(2)], axis=1))


def features(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    return hashed(*histories(ids, start))


def shard_of(one: np.ndarray, two: np.ndarray, lex: Lexicon) -> np.ndarray:
    """The shard of a history: all of a previous word in one shard, a frequent one's
    dealt by the word before it, so that equal histories always meet."""
    if lex.shards == 1:
        return np.zeros(one.size, np.uint16)
    hot = np.uint64(len(lex.words))
    splits = lex.splits[np.where(one >= 3, np.minimum(one - np.uint64(3), hot), hot).astype(np.int64)]
    part = (_mixed(two) >> np.uint64(20)) % splits
    at = (_mixed(_mixed((one << np.uint64(24)) ^ part)) >> np.uint64(20)) % np.uint64(lex.shards)
    return at.astype(np.uint16 if lex.shards < 1 << 16 else np.int64)


def rows_at(level: int, f: np.ndarray, cls: np.ndarray, lex: Lexicon) -> np.ndarray:
    """Feature rows of the first level, or of the second inside the class."""
    if level == 0:
        return (f & np.uint64(lex.rows - 1)).astype(np.int64)  # a power of two, as are the classes
    own = lex.rows // lex.classes
    return cls[:, None] * own + (_mixed(f ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(own - 1)).astype(np.int64)


def rows_of(f: np.ndarray, cls: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    return rows_at(0, f, cls, lex), rows_at(1, f, cls, lex)


def softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Class probabilities; ``weights`` (FEATURES, rows, classes). The bias is a log
    share and a weight at most a few tens, so exponentials stay in range as they are."""
    logits = weights[0].take(rows[:, 0], axis=0)
    for t in range(1, FEATURES):
        logits += weights[t].take(rows[:, t], axis=0)
    logits += bias
    np.exp(logits, out=logits)
    logits *= 1 / (logits @ np.ones((logits.shape[1], 1), logits.dtype))
    return logits


def encoded(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """Word numbers of each text, its sums over the hot words (``score``: their log10
    probabilities inside their leaves), and its other words with their number of places."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, hot = lex.index.get, len(lex.words)
        base = np.append(lex.base(lex.counts), 0.0)
        for batch in (s for p in parts for s in text_slices(p)):
            words, n = words_of(batch.column("text"))
            coded = words.dictionary_encode()
            seen = [*coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist(), END]
            number = np.array([get(w, -1) for w in seen], dtype=np.int64)
            filled = np.array([hot + zlib.crc32(w) % OTHER_WORDS if k < 0 else k for w, k in zip(seen, number.tolist(), strict=True)], dtype="<i4")
            first = np.cumsum(n + 1) - n - 1
            code = np.full(int(n.sum()) + n.size, len(seen) - 1)  # an end token after each text's words
            within = np.ones(code.size, bool)
            within[first + n] = False
            code[within] = coded.indices.to_numpy()
            at, of_text = number[code], lambda x: np.add.reduceat(x, first)  # noqa: B023
            other = np.flatnonzero(at < 0)
            rare, tf = np.unique(np.repeat(np.arange(n.size), n + 1)[other] * len(seen) + code[other], return_counts=True)
            rare_words = pa.StructArray.from_arrays([pa.array(seen, pa.binary()).take(pa.array(rare % len(seen))), pa.array(tf, pa.int64())],
                                                    ["word", "tf"])
            ends = np.append(0, np.cumsum(n + 1) * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held"), pa.array(n + 1, pa.int64()), pa.array(of_text((at >= 0).astype(np.int64))),
                 pa.array(of_text(base[at])), pa.Array.from_buffers(pa.binary(), n.size, [None, pa.py_buffer(ends), pa.py_buffer(filled[code])]),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, np.arange(n.size + 1) * len(seen)), pa.int32()), rare_words),
                 pa.array(of_text(lex.inside[at]))],
                ["id", "held", "n_tokens", "n_known", "base_score", "ids", "rare", "score"])

    out = texts.select("id", "held", "text").mapInArrow(
        run, f"id {kind}, held boolean, n_tokens bigint, n_known bigint, base_score double, ids binary, "
             "rare array<struct<word:binary,tf:bigint>>, score double")
    return out.withColumn("row", F.monotonically_increasing_id())  # fixed once the table is written


def token_batches(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word numbers, places in the text, text numbers) of encoded texts, a part of
    one text or several texts at once. A part starts with the two words before it,
    marked by text number -1."""
    ids, place, owner, held = [], [], [], 0
    for n, text in enumerate(texts):
        x = np.frombuffer(text.as_py(), "<i4")
        for a in range(0, x.size, size):
            s = max(a - 2, 0)
            part = x[s:a + size]
            ids.append(part)
            place.append(np.arange(s, s + part.size))
            owner.append(np.where(place[-1] < a, -1, n))
            held += part.size
            if held >= size:
                yield tuple(np.concatenate(c) for c in (ids, place, owner))
                ids, place, owner, held = [], [], [], 0
    if held:
        yield tuple(np.concatenate(c) for c in (ids, place, owner))


def packed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int, kind: str) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True), kind)


#: The columns of a batch's tokens in one shard: the texts and their numbers of tokens
#: there, and of each token the two words before it and its leaf.
BLOBS = {"texts": "<i8", "held": "?", "sizes": "<i4", "one": "<u4", "two": "<u4", "leaf": "<u2"}


def dealt(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """Encoded texts' tokens by shard, some thousands a row; ``batch`` numbers the rows
    of the same texts."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, done = len(lex.words), TaskContext.get().partitionId() << 32
        for batch in parts:
            number, held = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for ids, place, owner in token_batches(batch.column(2), DEAL_TOKENS):
                own = owner >= 0
                one, two = (x[own] for x in histories(ids, place))
                leaf, owner = lex.leaf[np.minimum(ids[own], hot)], owner[own]
                shard = shard_of(one, two, lex)
                order = np.argsort(shard, kind="stable")
                shard, one, two, leaf, owner = (x[order] for x in (shard, one, two, leaf, owner))
                ends = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), shard.size]
                out: list[dict] = []
                for a, b in pairwise(ends):
                    first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
                    whose = owner[a:b][first]
                    cols = (number[whose], held[whose], np.diff(first, append=b - a), one[a:b], two[a:b], leaf[a:b])
                    out.append({"shard": int(shard[a]), "batch": done, "n": b - a, "m": whose.size}
                               | {c: packed(x.astype(k)) for (c, k), x in zip(BLOBS.items(), cols, strict=True)})
                done += 1
                yield pa.RecordBatch.from_pylist(out, pa.schema(
                    [*((c, pa.int64()) for c in ("shard", "batch", "n", "m")), *((c, pa.binary()) for c in BLOBS)]))

    return texts.select("row", "held", "ids").mapInArrow(
        run, "shard bigint, batch bigint, n bigint, m bigint, " + ", ".join(f"{c} binary" for c in BLOBS))


def first_weights(seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The mean of the features' smoothed log-odds against the leaves' shares."""
    return np.stack([np.log((x + PRIOR * share) / ((x.sum(axis=0) + PRIOR) * share)) / FEATURES for x in seen])


def shard_events(level: int, one: np.ndarray, two: np.ndarray, leaf: np.ndarray, lex) -> Iterator[tuple]:
    """For each batch of a shard's tokens: (rows, bias, targets) of a level."""
    for a in range(0, one.size, BATCH_TOKENS):
        b = slice(a, a + BATCH_TOKENS)
        cls, sub = np.divmod(leaf[b].astype(np.int64), lex.classes)
        at = rows_at(level, hashed(one[b].astype(np.uint64), two[b].astype(np.uint64)), cls, lex)
        yield (at, lex.bias[1][cls], sub) if level else (at, lex.bias[0], cls)


def distinct(one: np.ndarray, two: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The order of tokens by history and leaf, the number of each ordered token among
    the distinct ones, and these. Word numbers in histories take 25 bits, leaves 14."""
    key = one.astype(np.uint64)
    for x, bits in ((two, 25), (leaf, 14)):
        key <<= np.uint64(bits)
        key |= x
    order = np.argsort(key)
    key = key[order]
    new = runs(key)
    first = order[new]
    return order, np.cumsum(new, dtype=np.int32) - 1, (one[first], two[first], leaf[first])


def runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    same = np.logical_and.reduce([x[1:] == x[:-1] for x in columns])
    return np.append(True, ~same)[:columns[0].size]


def fit(level: int, one: np.ndarray, two: np.ndarray, leaf: np.ndarray, lex, rounds: int, times: np.ndarray | None = None) -> np.ndarray:
    """A level's weights (FEATURES, rows, classes) from all training tokens of a shard,
    each seen ``times`` times. Neighbours that share what the level predicts from (the
    history, and the class at the second level) have equal probabilities, which are
    computed once. Sums are kept class by class: (FEATURES, classes, rows)."""
    c, rows = lex.classes, lex.rows
    times = np.ones(one.size) if times is None else times
    at, target = np.zeros((one.size, FEATURES), np.int32), np.zeros(one.size, np.int32)
    for k, (x, _, y) in enumerate(shard_events(level, one, two, leaf, lex)):
        at[k * BATCH_TOKENS:][:y.size], target[k * BATCH_TOKENS:][:y.size] = x, y
    seen = np.stack([np.bincount(target * rows + x, times, rows * c).reshape(c, -1) for x in at.T])
    share = np.exp(lex.bias[level].astype(np.float64))
    weights = first_weights(seen, np.repeat(share, rows // c, axis=0).T if level else share[:, None])
    new = runs(one, two, leaf // c) if level else runs(one, two)
    at, cls, times = at[new], leaf[new] // c, np.bincount(np.cumsum(new) - 1, times)
    del target, new
    model = np.zeros_like(seen)
    for _ in range(rounds):
        now = np.ascontiguousarray(weights.swapaxes(1, 2), dtype=np.float32)
        model[:] = 0
        for a in range(0, times.size, SUM_TOKENS):
            own, n = at[a:a + SUM_TOKENS], times[a:a + SUM_TOKENS]
            p = np.empty((c, n.size))
            for b in range(0, n.size, BATCH_TOKENS):
                part = slice(b, b + BATCH_TOKENS)
                bias = lex.bias[1][cls[a:][part]] if level else lex.bias[0]
                np.multiply(softmax(now, own[part], bias).T, n[part], out=p[:, part])
            for t in range(FEATURES):
                row, q = np.ascontiguousarray(own[:, t]), p
                first = np.flatnonzero(runs(row))
                if 4 * first.size < row.size:
                    row, q = row[first], np.add.reduceat(p, first, axis=1)
                for k in range(c):
                    model[t, k] += np.bincount(row, q[k], rows)
        for w, o, e in zip(weights, seen, model, strict=True):
            w += np.clip(RATE * (o - e - SPREAD * w) / (e + SPREAD), -MOST, MOST)
    return np.ascontiguousarray(weights.swapaxes(1, 2), dtype=np.float32)


def shard_scores(tokens: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> DataFrame:
    """Train each shard on its training tokens and score all its tokens: the sums by
    text of the leaves' log10 probabilities."""
    lex = SimpleNamespace(classes=lex.classes, rows=lex.rows, bias=lex.bias)  # without the words

    def run(group: pa.Table) -> pa.Table:
        cols: dict[str, list] = {c: [] for c in BLOBS}
        whose, ends = [], [0]
        for r in group.to_batches(max_chunksize=64):
            for x in r.to_pylist():
                whose.append(x["batch"])
                ends.append(ends[-1] + x["m"])
                for c, kind in BLOBS.items():
                    cols[c].append(unpacked(x[c], x["m"] if c in ("texts", "held", "sizes") else x["n"], kind))
        texts, held, sizes, one, two, leaf = (np.concatenate(x) for x in cols.values())
        order, number, own = distinct(one, two, leaf)
        times = np.bincount(number, np.repeat(~held, sizes)[order])
        train, each = times > 0, np.zeros(times.size)
        del one, two, leaf, cols
        for level in range(2):
            if level:  # class by class, so that a batch needs few feature rows
                by_class = np.argsort((own[2] // lex.classes).astype(np.uint16), kind="stable")
                own, times, train, each = [x[by_class] for x in own], times[by_class], train[by_class], each[by_class]
                number = np.argsort(by_class)[number]
            weights, a = fit(level, *[x[train] for x in own], lex, rounds, times[train]), 0
            for at, bias, target in shard_events(level, *own, lex):
                p = softmax(weights, at, bias)[np.arange(target.size), target]
                each[a:a + p.size] += np.log10(np.maximum(p, 1e-30).astype(np.float64))
                a += p.size
        score = np.empty(order.size)
        score[order] = each[number]
        by_text = np.bincount(np.repeat(np.arange(texts.size), sizes), score, texts.size)
        parts = [slice(*x) for x in pairwise(ends)]
        return pa.table({"batch": pa.array(whose, pa.int64()), "m": pa.array([x.stop - x.start for x in parts], pa.int64()),
                         "texts": pa.array([packed(texts[x]) for x in parts], pa.binary()),
                         "s": pa.array([packed(by_text[x]) for x in parts], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        rows, inverse = np.unique(np.concatenate([unpacked(x["texts"], x["m"], "<i8") for x in group.select(["texts", "m"]).to_pylist()]),
                                  return_inverse=True)
        s = np.concatenate([unpacked(x["s"], x["m"], "<f8") for x in group.select(["s", "m"]).to_pylist()])
        return pa.table({"row": pa.array(rows), "s": pa.array(np.bincount(inverse, s, rows.size))})

    parts = tokens.groupBy("shard").applyInArrow(run, "batch bigint, m bigint, texts binary, s binary")
    return parts.groupBy("batch").applyInArrow(added, "row bigint, s double")


def hot_words(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, at most HOT_WORDS, and their counts. Counts are
    cut at an eighth of an octave, so that only a short histogram is needed. Words
    seen once stay outside: from them the model learns where unknown words stand."""
    counts = counts.where("c > 1")
    level = F.floor(F.log2("c") * 8)
    histogram = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, held = None, 0
    for r in histogram:
        held += r.n
        if held > HOT_WORDS:
            break
        least = r.level
    rows = counts.where(level >= least).collect() if least is not None else []
    rows = sorted(((-r.c, bytes(r.word)) for r in rows))
    return [w for _, w in rows], np.array([-c for c, _ in rows], dtype=np.int64)


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10) -> DataFrame:
    """Train on the texts that are not held out and score all: id, ``held_out``,
    ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (smoothed unigram)
    and ``score`` (the model), both log10 probabilities of the whole text."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    src = src.withColumn("held", held_out(F.col("id"), fold))
    counts = store(count_tokens(src.where(~F.col("held"))), "counts")
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    lex = Lexicon(*hot_words(counts), totals.n or 0, totals.v)
    texts = store(encoded(src, lex), "encoded")
    parts = shard_scores(dealt(texts, lex), lex)
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    known = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log = lambda total, n: F.log10((F.col("c") + SMOOTH) / F.lit(total + SMOOTH * (n + 1)))
    more = known.select(
        F.col("row").alias("at"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("k"),
        (F.col("tf") * log(lex.total, lex.distinct)).alias("b"),
        (F.col("tf") * log(lex.tail_total, lex.tail_words)).alias("s"))
    more = more.unionByName(parts.select(F.col("row").alias("at"), F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("b"), "s"))
    more = more.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("k", "b", "s")])
    out = texts.drop("rare", "ids").join(more, F.col("row") == F.col("at"), "left")
    add = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", add("n_known", "k"),
                      F.lit(lex.total).cast("long").alias("train_tokens"), add("base_score", "b"), add("score", "s"))
