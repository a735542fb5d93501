"""Spelling variants, hard negatives, SimHash and components against brute force."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import graph, hardneg, simhash, spelling
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, word string, n int, id string, component_id long, `_m` int"
LONG = " ".join(f"word{i % 977}" for i in range(20_000))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows and clashing names."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three four"), (4, "One two three four"), (5, "one TWO three four"),
             (None, "one two three four"), (6, LONG), (7, "short text"), (8, "short text")]
    return spark.createDataFrame([(i, t, "x", 1, "y", 0, 0) for i, t in texts], SCHEMA)


# ---- components

def test_chain_of_a_thousand_links_takes_few_rounds(spark, monkeypatch):
    ids = np.random.default_rng(1).permutation(1001).tolist()
    for order in (list(range(1001)), ids):
        rounds = []
        monkeypatch.setattr(graph, "store", lambda df, name, real=graph.store: (rounds.append(name), real(df, name))[1])
        df = spark.createDataFrame(list(itertools.pairwise(order)), "a long, b long")
        got = graph.components(df).collect()
        monkeypatch.undo()
        assert {(r.id, r.root) for r in got} == {(i, 0) for i in range(1001)} and len(got) == 1001
        assert rounds.count("edges") <= 12 and len(rounds) <= 60


def test_components_brute_force(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    first, second = (spark.createDataFrame(part, "a long, b long") for part in (links[::2], links[1::2]))
    for got in (graph.components(first.union(second)), graph.components(second, graph.components(first))):
        assert {r.id: r.root for r in got.collect()} == {x: find(x) for x in linked}
    assert graph.components(first.where("false")).count() == 0


# ---- SimHash

def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_simhash(docs):
    """docs: (id, text) with ids; the rows' (id, fingerprint, component)."""
    fps = sorted({(i, brute_fingerprint(t)) for i, t in docs})
    part = {f: {i for i, g in fps if g == f} for _, f in fps}
    group = {f: {f} for f in part}
    for a, b in itertools.combinations(sorted(part), 2):
        if (a ^ b).bit_count() <= 2 and group[a] is not group[b]:
            merged = group[a] | group[b]
            for f in merged:
                group[f] = merged
    least = {f: min(min(part[g]) for g in group[f]) for f in part}
    return Counter((i, f"{brute_fingerprint(t):016x}", least[brute_fingerprint(t)]) for i, t in docs)


def results(df):
    return Counter(tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect())


def test_simhash_query_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert results(QUERIES["op13_simhash_near_dup"](spark, SF)) == brute_simhash(docs)


def test_simhash_edges(spark, edge):
    docs = [(r.doc_id, r.text) for r in edge.collect() if r.doc_id is not None]
    got = results(simhash.near_duplicates(edge))
    assert got == brute_simhash(docs)
    assert {i: c for i, _, c in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7}
    assert simhash.near_duplicates(edge.where("false")).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    for places in itertools.chain(itertools.combinations(range(64), 2), ((p,) for p in range(64))):
        x = sum(1 << p for p in places)
        missed = [t for t, m in enumerate(simhash.MASKS) if not m & x]
        assert missed and all(any(not m & x for m in simhash.FINER[t]) for t in missed)
    assert max(64 - m.bit_count() for ms in simhash.FINER for m in ms) <= 12


@pytest.mark.parametrize("bucket", [4096, 40])
def test_near_links_of_crowded_fingerprints(spark, monkeypatch, bucket):
    """Fingerprints in a few places only, with whole and refined buckets."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    places = rng.choice(64, 24, replace=False)
    fps = np.unique(np.array([sum(1 << int(p) for p in rng.choice(places, rng.integers(0, 9))) for _ in range(500)], dtype=np.uint64))
    rows = [(int(f), i) for i, f in enumerate(fps.view(np.int64))]
    links = simhash.near_links(spark.createDataFrame(rows, "fp long, id long"))
    got = {r.id: r.root for r in graph.components(links).collect()}
    near = [(i, j) for i in range(fps.size) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist() if i < j]
    assert got == {r.id: r.root for r in graph.components(spark.createDataFrame(near, "a long, b long")).collect()}


# ---- spelling variants

def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(docs):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in total.items() if len(w) >= 6 and c >= 5}
    by_gap = {}
    for w in n:
        for k in range(len(w)):
            by_gap.setdefault(w[:k] + w[k + 1:], set()).add(w)
    near = {w: {x for k in range(len(w)) for x in by_gap[w[:k] + w[k + 1:]] | ({w[:k] + w[k + 1:]} & n.keys())} | by_gap.get(w, set())
            for w in n}
    near = {w: {x for x in s if x != w and one_edit(w, x)} for w, s in near.items()}
    best = {w: min(s, key=lambda x: (-n[x], x)) for w, s in near.items() if s}
    form = {w: f for w, f in best.items() if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return {(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()}


def variants(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spelling_query_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want = brute_variants(docs)
    assert variants(QUERIES["op11_spelling_variants"](spark, SF01)) == want
    assert sum(f is not None for _, f, *_ in want) > 20


def test_spelling_edges(spark, edge):
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    assert variants(spelling.group_variants(edge)) == brute_variants(docs)
    assert spelling.group_variants(edge.where("false")).count() == 0


def test_chains_ties_and_long_words(spark):
    long = "ab" * 3000
    docs = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcxeg"] * 125 + ["zbcxeg"] * 625)),
            (2, " ".join(["stable"] * 5 + ["staple"] * 25 + ["stayle"] * 25)), (3, " ".join([long] * 5 + [long + "a"] * 30)),
            (4, "Éclair éclair " * 5), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_variants(docs)
    assert variants(spelling.group_variants(df)) == want
    assert {w: r for w, _, r, *_ in want}["abcdef"] == "zbcxeg" and {w: f for w, f, *_ in want}["stable"] == "staple"


@pytest.mark.parametrize("group", [20_000, 30])
def test_near_words_of_crowded_lists(spark, monkeypatch, group):
    """Whole groups, and groups taken apart down to single code points."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(6, 9))) for _ in range(900)})
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.near) for r in spelling.near_words(df).collect()]
    want = {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}
    assert len(got) == len(want) and set(got) == want


# ---- hard negatives

def brute_negatives(rows, low=30, high=90):
    ids, labels, v = zip(*sorted(rows), strict=True)
    v = [tuple(int(np.floor(256 * float(x))) for x in r) for r in v]
    out = set()
    score = lambda i, j: sum(x * y for x, y in zip(v[i], v[j], strict=True))
    for i in range(len(ids)):
        if ids[i] % 100:
            continue
        s = {j: score(i, j) for j in range(len(ids)) if j != i and len(v[j]) == len(v[i])}
        best = lambda js: sorted(js, key=lambda j: (-s[j], ids[j]))
        for p in best([j for j in s if labels[j] == labels[i]])[:5]:
            ok = best([j for j in s if labels[j] != labels[i] and low * s[p] <= 100 * s[j] <= high * s[p]])[:10]
            out |= {(ids[i], ids[p], k + 1, ids[j], s[p], s[j]) for k, j in enumerate(ok)}
    return out


def negatives(df):
    got = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("rows_at_once", [4096, 50])
def test_negatives_query_brute_force(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(hardneg, "ROWS", rows_at_once)
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert negatives(QUERIES["op12_hard_negatives"](spark, SF)) == brute_negatives(rows)


def test_negative_edges(spark):
    rng = np.random.default_rng(6)
    good = [(i, int(rng.integers(0, 3)), rng.integers(-2, 3, 5).astype(float).tolist()) for i in range(0, 700, 5)]
    good += [(100 * k + 3, 1, rng.normal(size=7).tolist()) for k in range(30)] + [(5000, 1, rng.normal(size=7).tolist()), (5001, 2, []), (6000, 1, [])]
    bad = [(7, None, [1.0] * 5), (8, 1, None), (9, 1, [1.0, None, 1.0, 1.0, 1.0]), (11, 1, [float("nan")] * 5), (None, 1, [1.0] * 5),
           (12, 1, [float("inf")] * 5), (13, 1, [65536.0] * 5)]
    again = [(0, good[0][1] + 1, [9.0] * 5), good[3]]
    schema = "vec_id long, label int, embedding array<double>, id string, block int, v int, kind int"
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in good + bad + again], schema)
    assert negatives(hardneg.mine(df)) == brute_negatives(good)
    assert hardneg.mine(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [1, 5, 64, 100])
def test_intervals_hold_the_scores(dim):
    rng = np.random.default_rng(dim)
    v = np.floor(256 * rng.normal(size=(300, dim)) * rng.choice([0.01, 1, 50], (300, 1)))
    v[:3] = 0
    code, align, resid = hardneg.encode(v, hardneg.rotation_of(dim))
    ids = np.arange(300)
    block = hardneg.Block(ids, ids, v.astype(np.int32), code, align.astype(np.float32), resid.astype(np.float32))
    q = hardneg.Anchors(ids[:40], ids[:40], v[:40])
    lower_, upper = hardneg.intervals(q, block, 0, 300)
    s = v[:40] @ v.T
    assert (lower_ <= s).all() and (s <= upper).all()
    across = np.sqrt((v[:40] ** 2).sum(axis=1))[:, None] * np.sqrt((v ** 2).sum(axis=1))
    assert dim == 1 or np.mean((upper - lower_)[3:, 3:] / across[3:, 3:]) < 1.6
    i, j, score = hardneg.exact(q, block, 0, rng.random((40, 300)) < 0.02)
    assert (score == s[i, j].astype(np.int64)).all()
