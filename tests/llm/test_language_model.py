"""The maximum-entropy model against a brute-force version in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import maxent
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_base(docs):
    """{id: (held out, tokens, known, base score)} and the training tokens."""
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ws))
            for i, ws in words.items()}, words, held, c


def brute_model(words, held, c, rows, classes):
    """The model's log10 probabilities, token by token, with dictionaries."""
    order = sorted((w for w in c if c[w] > 1), key=lambda w: (-c[w], (w or "\n").encode()))
    hot = sum(c[w] for w in order)
    share, before = [], 0
    for w in order:
        share.append(int(before * ((classes ** 2 - 1) / max(hot, 1))))
        before += c[w]
    rank = {s: k for k, s in enumerate(sorted(set(share)))}
    leaf = {w: rank[s] for w, s in zip(order, share, strict=True)}
    tail = len(rank)
    number = {w: k for k, w in enumerate(order)}
    mass = defaultdict(float)
    for w in order:
        mass[leaf[w]] += c[w]
    once = [w for w in c if c[w] == 1]
    mass[tail] = len(once) + .1 * (len(once) + 1)
    by_class = defaultdict(float)
    for k, m in mass.items():
        by_class[k // classes] += m

    def events(ws):
        ids = np.array([number[w] if w in number else len(order) + zlib.crc32(w.encode()) % maxent.OTHER_WORDS for w in ws])
        f = maxent.features(ids, np.arange(ids.size))
        for w, h in zip(ws, f.tolist(), strict=True):
            k = leaf.get(w, tail)
            inside = maxent._mixed(np.array(h, np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).tolist()
            yield w, k, [(t, x % rows) for t, x in enumerate(h)], [(t, k // classes, x % (rows // classes)) for t, x in enumerate(inside)]

    def log_share(level, cls, j):
        if level == 0:
            return math.log(by_class[j] / sum(mass.values())) if by_class[j] else -40.0
        m = mass.get(cls * classes + j, 0)
        return math.log(m / by_class[cls]) if m else -40.0

    def probabilities(weights, level, cls, keys):
        x = [log_share(level, cls, j) + sum(weights.get((k, j), 0.0) for k in keys) for j in range(classes)]
        e = [math.exp(y - max(x)) for y in x]
        return [y / sum(e) for y in e]

    seen, total = Counter(), Counter()
    train = [ev for i, ws in words.items() if not held[i] for ev in events(ws)]
    for _, k, first, second in train:
        for keys, j in ((first, k // classes), (second, k % classes)):
            for key in keys:
                seen[key, j] += 1
                total[key] += 1
    weights = {}
    for key in total:
        for j in range(classes):
            s = math.exp(log_share(len(key) - 2, key[1] if len(key) == 3 else 0, j))
            weights[key, j] = math.log((seen[key, j] + maxent.PRIOR * s) / ((total[key] + maxent.PRIOR) * s)) / 3
    for _ in range(maxent.ROUNDS):
        expected = Counter()
        for _, k, first, second in train:
            for level, keys in enumerate((first, second)):
                for j, p in enumerate(probabilities(weights, level, k // classes, keys)):
                    for key in keys:
                        expected[key, j] += p
        for at, w in list(weights.items()):
            e = expected[at]
            step = (seen[at] - e - maxent.SPREAD * w) / (e + maxent.SPREAD) / 3
            weights[at] = w + max(-1.0, min(1.0, step))
    out = {}
    for i, ws in words.items():
        x = 0.0
        for w, k, first, second in events(ws):
            x += math.log10(probabilities(weights, 0, 0, first)[k // classes]) + math.log10(probabilities(weights, 1, k // classes, second)[k % classes])
            x += math.log10(c[w] / mass[k]) if w in leaf else math.log10((c[w] + .1) / mass[tail])
        out[i] = x
    return out


def test_tiny_corpus_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = {i: " ".join(f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 60)) % 40) for i in range(40)} | {100: "", 101: None, 102: "W1 new words"}
    base, words, held, c = brute_base(docs)
    lex = maxent.Lexicon(*maxent.hot_words(spark.createDataFrame([((w or "\n").encode(), n) for w, n in c.items()], "word binary, c long")),
                         sum(c.values()), len(c))
    want = brute_model(words, held, c, lex.rows, lex.classes)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.score_texts(df).collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known) == base[i][:3] and r.train_tokens == sum(c.values())
        assert r.base_score == pytest.approx(base[i][3], abs=1e-9) and r.score == pytest.approx(want[i], rel=1e-5)


def test_query_base_columns_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    base, _, _, c = brute_base(docs)
    for r in QUERIES["op10_lm_score"](spark, SF).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (*base[r.doc_id][:3], sum(c.values()))
        assert r.base_score == pytest.approx(base[r.doc_id][3], rel=1e-9) and r.score < 0


def test_probabilities_of_all_words_sum_to_one():
    words = [f"w{i}".encode() for i in range(300)]
    lex = maxent.Lexicon(words, np.sort(np.random.default_rng(2).zipf(1.3, 300).clip(2, 9999))[::-1].astype(np.int64), 10 ** 6, 500)
    weights = [np.random.default_rng(k).normal(size=(3, lex.rows, lex.classes)).astype(np.float32) for k in (0, 1)]
    ids = np.arange(301)  # the last stands for the tail
    cls, leaf = lex.targets(ids)
    f = np.repeat(maxent.features(np.array([5, 9, 0]), np.array([7, 8, 9]))[2:], 301, axis=0)
    first, second = maxent.rows_of(f, cls, lex)
    p = maxent.softmax(weights[0], first, lex.bias[0])[ids, cls] * maxent.softmax(weights[1], second, lex.bias[1][cls])[ids, leaf]
    assert (p * 10.0 ** lex.inside).sum() == pytest.approx(1, abs=1e-4)


def test_partitions_change_nothing_and_context_helps(spark):
    """One and eight partitions score alike; held-out texts gain on unigrams."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one, eight = ({r.doc_id: r for r in maxent.score_texts(df.repartition(n)).collect()} for n in (1, 8))
    assert all(eight[i].score == pytest.approx(r.score, rel=1e-6) for i, r in one.items())
    held = [r for r in one.values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0


def test_long_texts_are_scored_whole(spark, monkeypatch):
    """Batches cut a text anywhere and still see its two words before."""
    text = " ".join(f"w{i % 37}" for i in range(500))
    df = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in maxent.score_texts(df).collect()}
    monkeypatch.setattr(maxent, "BATCH_TOKENS", 64)
    assert {r.doc_id: pytest.approx(r.score, rel=1e-6) for r in maxent.score_texts(df).collect()} == whole
    assert maxent.score_texts(df.where("false")).withColumn("x", F.lit(1)).count() == 0


def test_feature_rows_follow_the_training_tokens(spark):
    """A row for some dozens of tokens at any size, within a task's memory by shards; on
    held-out texts the histories tell much more than one row for thousands of tokens."""
    for total in (10 ** 5, 10 ** 7, 10 ** 9):
        lex = maxent.Lexicon([b"a", b"b"], np.array([9, 5]), total, 2)
        assert lex.rows * getattr(lex, "shards", 1) >= total / 64 and lex.rows <= 1 << 15
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = maxent.score_texts(df).where("held_out").agg(F.sum(F.expr("score - base_score")).alias("gain"), F.sum("n_tokens").alias("n")).first()
    assert held.gain / held.n > 0.1


def test_shards_score_every_text_whole(spark, monkeypatch):
    """Many shards and texts cut into many batches: each text has one score, the same for
    any partitions, equal to training each shard's histories by brute force."""
    rng = np.random.default_rng(3)
    docs = {i: " ".join(f"w{x}" for x in rng.zipf(1.4, rng.integers(1, 400)) % 50) for i in range(60)} | {100: "", 101: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    monkeypatch.setattr(maxent, "SHARD_TOKENS", 1 << 10)
    one = {r.doc_id: r.score for r in maxent.score_texts(df.repartition(1)).collect()}
    monkeypatch.setattr(maxent, "DEAL_TOKENS", 64)
    assert {r.doc_id: pytest.approx(r.score, rel=1e-6) for r in maxent.score_texts(df.repartition(8)).collect()} == one
    _, words, held, c = brute_base(docs)
    lex = maxent.Lexicon(*maxent.hot_words(spark.createDataFrame([((w or "\n").encode(), n) for w, n in c.items()], "word binary, c long")),
                         sum(c.values()), len(c))
    assert lex.shards > 4
    number = {w: k for k, w in enumerate(lex.words)}
    tokens = []
    for i, ws in words.items():
        raw = [(w or "\n").encode() for w in ws]
        ids = np.array([number.get(w, len(lex.words) + zlib.crc32(w) % maxent.OTHER_WORDS) for w in raw])
        hist = maxent.histories(ids, np.arange(ids.size))
        tokens += list(zip([i] * ids.size, ids, *hist, maxent.shard_of(*hist, lex), ws, strict=True))
    want = defaultdict(float)
    for s in {t[4] for t in tokens}:
        own = [t for t in tokens if t[4] == s]
        train = [t for t in own if not held[t[0]]]
        columns = lambda part: [np.array([t[2] for t in part], np.uint64), np.array([t[3] for t in part], np.uint64),
                                lex.leaf[np.minimum(np.array([t[1] for t in part], np.int64), len(lex.words))]]
        for level in range(2):
            w = maxent.fit(level, *columns(train), lex, maxent.ROUNDS)
            for at, bias, target in maxent.shard_events(level, *columns(own), lex):
                p = maxent.softmax(w, at, bias)[np.arange(target.size), target]
                for t, x in zip(own, p.tolist(), strict=True):
                    want[t[0]] += math.log10(x)
    for i, k, _, _, _, w in tokens:
        want[i] += float(lex.inside[k]) if k < len(lex.words) else math.log10((c[w] + .1) / (lex.tail_total + .1 * (lex.tail_words + 1)))
    assert {i: pytest.approx(x, rel=1e-5) for i, x in want.items()} == one


def test_equal_histories_are_computed_once(monkeypatch):
    """Repeated histories, any share of them, cost no softmax of their own; the weights
    are those of the tokens in any order, one by one."""
    lex = maxent.Lexicon([f"w{i}".encode() for i in range(300)], np.arange(400, 100, -1), 10 ** 6, 1 << 10)
    rng = np.random.default_rng(4)
    one, two = rng.integers(1, 6, (2, 4000)).astype(np.uint32)
    leaf = rng.integers(0, lex.tail_leaf + 1, 4000).astype(np.uint16)
    rows, real = [], maxent.softmax
    monkeypatch.setattr(maxent, "softmax", lambda w, at, bias: rows.append(len(at)) or real(w, at, bias))
    order, number, own = maxent.distinct(one, two, leaf)
    assert all((x[number] == y[order]).all() for x, y in zip(own, (one, two, leaf), strict=True))
    for level, events in enumerate((25, 25 * lex.classes)):
        apart = maxent.fit(level, one, two, leaf, lex, 2)
        rows.clear()
        assert maxent.fit(level, one[order], two[order], leaf[order], lex, 2) == pytest.approx(apart, abs=1e-5)
        assert 0 < sum(rows) <= 2 * events
        assert maxent.fit(level, *own, lex, 2, np.bincount(number)) == pytest.approx(apart, abs=1e-5)


def test_words_of_odd_texts(monkeypatch):
    """White space at the ends, none, other separators, invalid bytes; slices of any size."""
    texts = [b"  A b\x0bC\x1cd \xc3\x89 x\t\n ", b"", None, b"   ", b"\xff Z\xc3 ( B", b"z" * 99 + b" Q"]
    want = [[bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in (t or b"").split()] for t in texts]
    batch = maxent.pa.record_batch([maxent.pa.array(texts, maxent.pa.binary())], ["text"])
    for size in (1, 10, 1 << 20):
        monkeypatch.setattr(maxent, "SLICE_BYTES", size)
        words, n = [], []
        for part in maxent.text_slices(batch):
            w, k = maxent.words_of(part.column(0))
            words += w.cast(maxent.pa.binary()).to_pylist()
            n += k.tolist()
        assert n == [len(w) for w in want] and words == sum(want, [])
    assert not list(maxent.text_slices(batch.slice(0, 0)))
