"""Tails, quantiles and intervals against published figures; ranks and adjusted
p-values of many groups, recoverable cells, funnels of hot entities, and lexicon
scans against brute force."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.stats import normal_tail, t_quantile
from plumbline.functions.text import number_figures
from plumbline.operators import audit as A
from plumbline.operators import cohort as C
from plumbline.operators import compare as K
from plumbline.operators import telemetry as E
from plumbline.operators import textscan as X
from plumbline.operators import uncertainty as U


def column(spark, values, fn, kind="double"):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select(
        "i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normal_tail_is_relative(spark):
    zs = [0, 0.5, 1, 1.959964, 3, 5, 8, 15, 30]
    for z, got in zip(zs, column(spark, [float(z) for z in zs], normal_tail), strict=True):
        assert got == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=2e-7)


def test_t_quantile_table(spark):
    """Two-sided 95 % points of the published tables."""
    table = {1: 12.7062, 2: 4.30265, 3: 3.18245, 4: 2.77645, 5: 2.57058, 7: 2.36462, 10: 2.22814, 20: 2.08596, 30: 2.04227,
             120: 1.97993, 1e9: 1.95996}
    for nu, got in zip(table, column(spark, [float(x) for x in table], t_quantile), strict=True):
        assert got == pytest.approx(table[nu], abs=1e-4)
    assert column(spark, [0.0], t_quantile) == [None]


def test_welch_by_hand(spark):
    """Small n, unequal variances: e1 = 20/12, e0 = 2/5, 4.42178 degrees."""
    a, b = [10.0, 12.0, 14.0, 16.0], [9.0, 11.0, 13.0, 11.0, 11.0]
    rows = [(1, x) for x in a] + [(0, x) for x in b] + [(1, None)]
    r = U.u_diff_means(spark.createDataFrame(rows, "arm int, v double"), "arm", "v").first()
    e1, e0 = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    nu = (e1 + e0) ** 2 / (e1 ** 2 / 3 + e0 ** 2 / 4)
    assert (r.n1, r.n0, r.mean1, r.mean0, r["diff"]) == (4, 5, 13.0, 11.0, 2.0) and r.degrees == pytest.approx(nu, abs=1e-6)
    assert nu == pytest.approx(4.42178, abs=1e-5)
    # between the table's 2.7764 (4 degrees) and 2.5706 (5), nearly linear in 1 / degrees
    t = 2.5706 + (1 / nu - 0.2) / 0.05 * (2.7764 - 2.5706)
    half = r.upper - r["diff"]
    assert half == pytest.approx(t * math.sqrt(e1 + e0), rel=2e-3) and r["diff"] - r.lower == pytest.approx(half, abs=2e-6)
    one = U.u_diff_means(spark.createDataFrame([(1, 1.0), (0, 2.0)], "arm int, v double"), "arm", "v").first()
    assert one.lower is None and one["diff"] == -1.0


def test_sign_test_tail(spark):
    """Exact up to 1000 trials, within 1 % beyond, far into the tail."""
    def exact(n, k):
        return float(Fraction(sum(math.comb(n, i) for i in range(k, n + 1)), 2 ** n))
    cases = [(5, 17), (0, 3), (500, 500), (499, 501), (380, 620), (1000, 1001), (1000, 1000), (900, 1300), (1500, 1900), (1, 1100)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a long, b long")
    one, two = E.sign_test(F.col("a"), F.col("b"))
    for r, (a, b) in zip(df.select("i", one.alias("p"), two.alias("q")).orderBy("i").collect(), cases, strict=True):
        assert r.p == pytest.approx(exact(a + b, max(a, b)), rel=1e-9 if a + b <= 1000 else 1e-2) and r.q == min(1, 2 * r.p)
    big = spark.createDataFrame([(5_000_000 + 11_100, 5_000_000 - 11_100)], "a long, b long").select(one.alias("p")).first().p
    z = (2 * 11_100 - 1) / math.sqrt(10_000_000)
    assert 1e-13 < big < 1e-11 and big == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-2)
    assert spark.createDataFrame([(0, 0)], "a long, b long").select(one.alias("p")).first().p is None


@pytest.mark.parametrize("hot_rows", [60, 2_000_000])
def test_multiplicity_and_league_brute_force(spark, hot_rows):
    rng = random.Random(2)
    groups = [(f"g{i}", rng.choice([0, 0, rng.randint(1, 40)]), 40 + rng.randint(0, 3)) for i in range(300)] + [("big", 600, 1000)]
    df = spark.createDataFrame(groups, "g string, x long, n long")
    tx, tn = sum(x for _, x, _ in groups), sum(n for *_, n in groups)
    p = {}
    for g, x, n in groups:
        q = tx / tn
        z = (x / n - (tx - x) / (tn - n)) / math.sqrt(q * (1 - q) * (1 / n + 1 / (tn - n)))
        p[g] = math.erfc(abs(z) / math.sqrt(2))
    order = sorted(p, key=lambda g: (p[g], g))
    bh = {g: min(min(1, p[h] * len(p) / (k + 1)) for k, h in enumerate(order) if k >= order.index(g)) for g in p}
    out = U.u_multiplicity(df, "g", "x", "n", hot_rows=hot_rows)
    for r in out.collect():
        assert r.p_bh == pytest.approx(bh[r.g], abs=2e-6) and r.p_bonferroni == pytest.approx(min(1, p[r.g] * len(p)), abs=3e-5)
        assert r.log10_p == (pytest.approx(math.log10(p[r.g]), abs=1e-5) if p[r.g] else None)
    for r in U.u_league(df, "g", "x", "n", hot_rows=hot_rows).collect():
        x, n = next((x, n) for g, x, n in groups if g == r.g)
        assert r.raw_rank == 1 + sum(round(100 * a / b, 6) > round(100 * x / n, 6) for _, a, b in groups)


def published(cells, hidden):
    """A two-way table with margins as published: (d1, d2) -> n, and hidden keys."""
    rows, cols = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    full = dict(cells) | {(r, None): sum(cells[r, c] for c in cols) for r in rows}
    full |= {(None, c): sum(cells[r, c] for r in rows) for c in cols} | {(None, None): sum(cells.values())}
    return [(r, c, None if (r, c) in hidden else n) for (r, c), n in full.items()], full


def brute_recoverable(full, hidden):
    """By linear algebra: a cell is fixed if no vector of the null space moves it."""
    names = sorted(full, key=str)
    at = {k: i for i, k in enumerate(names)}
    rows, cols = {r for r, _ in full if r}, {c for _, c in full if c}
    lines = [[(r, c) for c in [*cols, None]] for r in [*rows, None]] + [[(r, c) for r in [*rows, None]] for c in [*cols, None]]
    m = np.zeros((len(lines), len(names)))
    for i, line in enumerate(lines):
        for r, c in line:
            total = c is None if i < len(rows) + 1 else r is None
            m[i, at[r, c]] = -1 if total else 1
    free = [at[k] for k in sorted(hidden, key=str)]
    sub = m[:, free]
    _, s, vt = np.linalg.svd(sub)
    null = vt[int((s > 1e-9).sum()):]
    return {k for j, k in enumerate(sorted(hidden, key=str)) if not len(null) or np.abs(null[:, j]).max() < 1e-9}


HAND = {
    "two steps": {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "x")},
    "falls once its neighbour is known": {("a", "x"), ("a", "y"), ("b", "y")},
    "cycle": {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")},
    "bridge between two cycles": {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "z"), ("c", "w"), ("d", "z"), ("d", "w")},
    "margins": {("a", "x"), ("a", None), (None, "x"), (None, None), ("b", "y")}, "nothing": set()}


@pytest.mark.parametrize("name", [*HAND, "random 1", "random 2"])
def test_recoverable_cells(spark, name):
    cells = {(r, c): 10 + i for i, (r, c) in enumerate(itertools.product("abcd", "wxyz"))}
    hidden = HAND.get(name)
    if hidden is None:
        keys = sorted([*cells, *[(r, None) for r in "abcd"], *[(None, c) for c in "wxyz"]], key=str)
        hidden = set(random.Random(name).sample(keys, 9))
    rows, full = published(cells, hidden)
    out = U.u_recoverable(spark.createDataFrame(rows, "d1 string, d2 string, n long"), "d1", "d2", "n").collect()
    assert {(r.d1, r.d2) for r in out} == hidden
    assert {(r.d1, r.d2) for r in out if r.recoverable} == brute_recoverable(full, hidden)
    assert all(r.recoverable for r in out if r.lines_exposing)


def test_suppressed_rows_show_nothing(spark):
    df = spark.createDataFrame([("a", 3, 1), ("b", 40, 9)], "g string, n long, x long")
    r = {x.g: x for x in U.u_rate_block(df, "rate", "x", "n", F.lit(2), False, limit=F.lit(1.0) / F.col("n")).collect()}
    assert r["a"].value_text == "suppressed (n < 5)" and [r["a"][c] for c in ("n", "x", "lower_pct", "upper_pct", "detectable_pts")] == [None] * 5
    assert r["b"].n == 40 and r["b"].detectable_pts == 0.025
    units = spark.createDataFrame([("s", i % 2, i % 3 == 0) for i in range(60)] + [("t", 1, True)] * 3 + [("t", 0, True)] * 9, "s string, t int, y boolean")
    k = {x.s: x.asDict() for x in K.k_stratified(units, F.col("t") == 1, F.col("y"), "s").collect()}
    assert k["t"].pop("stability") == "suppressed" and set(k["t"].values()) == {"t", None} and k["s"]["n_treated"] == 30


@pytest.mark.parametrize("hot_rows", [30, 2_000_000])
def test_funnel_brute_force(spark, hot_rows):
    """Ordered times, ties in time, and an entity with a third of all events."""
    rng = random.Random(4)
    stages = ["a", "b", "c", "d", "e", "f"]
    ev = [(rng.choice(["hot", *map(str, range(30))]) if rng.random() < 0.7 else "hot", rng.randint(0, 25), rng.choice([*stages, "x"]))
          for _ in range(600)] + [(None, 1, "a")]
    want = {}
    for k in {k for k, _, s in ev if k and s in stages}:
        t, times = -1, []
        for s in stages:
            after = [u for j, u, x in ev if j == k and x == s and t is not None and u > t]
            t = min(after) if after else None
            times.append(t)
        want[k] = (*times, *[int(any(j == k and x == s for j, _, x in ev)) for s in stages])
    got = C.stage_times(spark.createDataFrame(ev, "k string, ts long, s string"), "k", "ts", "s", stages, hot_rows=hot_rows)
    assert {r.k: tuple(r[f"{c}_{i}"] for c in "ta" for i in range(1, 7)) for r in got.collect()} == want
    assert got.count() == len(want)


@pytest.mark.parametrize("compiled", [10_000, 1])
def test_term_hits_brute_force(spark, monkeypatch, compiled):
    monkeypatch.setattr(K, "MAX_FIRST_WORDS", compiled)
    rng = random.Random(5)
    terms = ["a", "b c", "b", "a b c d", "c c", "d a d a d"]
    docs = [(i, " ".join(rng.choice("abcdABX,") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "")]
    got = K.term_hits(spark.createDataFrame(docs, "id int, text string"), "id", "text", K.lexicon_frame(spark, [("k", t) for t in terms]))
    want = []
    for i, t in docs:
        w = [x for x in (t or "").lower().replace(",", " ").split()]
        want += [(i, p, t) for t in terms for p in range(len(w)) if w[p:p + len(t.split())] == t.split()]
    assert sorted((r.id, r.position, r.term) for r in got.collect()) == sorted(want)
    if compiled > 1:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan


def test_figures_after_separators(spark):
    texts = {"1.2,3.4;5.6": [1.2, 3.4, 5.6], "1,234,5.6": [1234.0, 5.6], "12,345.6": [12345.0], "1.2.3": [1.2], "v1.2": [], "1.25": [],
             "é1.2": [], "(1,234)": [1234.0], "-0.5%": [0.5], "1.2 3.4": [1.2, 3.4], "1,2345": [], "": []}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.t: r.f for r in df.select("t", number_figures("t").alias("f")).collect()} == texts


def test_assertions_of_both_shapes(spark):
    flat = spark.createDataFrame([("m", "ag", "sk", 1, "s", "e1", False, "t", 2, [2], [(1, "PASS"), (2, "FAIL")]),
                                  ("m", "ag", "sk", 1, "s", "e2", True, None, 0, [], [])], E.RESULT_SCHEMA)
    nested = spark.createDataFrame([("m", "ag", "sk", 1, {"s": [("e1", False, "t", 2.0, 2, [2], [(1, "PASS"), (2, "FAIL")]),
                                                               ("e2", True, None, 0.0, 0, [], [])]})], E.NESTED_SCHEMA)
    for df in (flat, nested):
        assert sorted((r.eval_id, r.assertion or 0, r.verdict or "") for r in E.e_assertions(df).collect()) == [
            ("e1", 1, "PASS"), ("e1", 2, "FAIL"), ("e2", 0, "")]


def test_schema_drift_reads_values(spark):
    df = spark.createDataFrame([("1", None, 2.0), ("x", 3, None)], "a string, b int, c double")
    doc = spark.createDataFrame([("t", "a", "INT"), ("t", "b", "INT"), ("t", "gone", "INT")], "table_name string, column_name string, data_type string")
    got = {r.column_name: (r.status, r.n_rows, r.null_share, r.n_not_castable)
           for r in A.a_schema_drift(doc, A.column_facts("t", df, {"a": "INT", "b": "INT", "gone": "INT"})).collect()}
    assert got == {"a": ("values_do_not_cast", 2, 0.0, 1), "b": ("as_documented", 2, 0.5, 0), "c": ("undocumented", 2, 0.5, None),
                   "gone": ("missing_in_data", None, None, None)}


def test_corrections_volume(spark):
    hits = spark.createDataFrame([("a", 1), ("a", 1), ("a", 3), ("b", 3)], "signal string, month int")
    turns = spark.createDataFrame([(1, 10), (2, 5), (3, 20)], "month int, n_turns long")
    got = sorted((r.signal, r.month, r.n_hits, r.per_1000_turns, r.change) for r in X.t_corrections_volume(hits, "month", turns).collect())
    assert got == [("a", 1, 2, 200.0, None), ("a", 3, 1, 50.0, -1), ("b", 3, 1, 50.0, None)]


def test_docs_folder_round_trip(spark, tmp_path):
    from plumbline.sources.tables import read_docs, split_docs, write_docs
    texts = {1: "a\nb\n", 2: "", 3: None, 4: "é\r\nline"}
    write_docs(spark.createDataFrame(list(texts.items()), "id int, text string"), f"file://{tmp_path}/docs", "id", "text")
    got = split_docs(read_docs(spark, f"file://{tmp_path}/docs")).collect()
    assert {int(r.id): r.text for r in got} == {k: t or "" for k, t in texts.items()} and len({r.path for r in got}) == 4
    assert all(r.modified is not None for r in got)


def test_docs_folder_of_many_small_files(spark, tmp_path, monkeypatch):
    """One file per row and nothing beside it, folders per task, few read tasks; the
    same through Spark's own writer; an empty table is an empty folder."""
    from plumbline.sources import tables
    texts = {i: f"text {i}\n" * (i % 5) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(8)
    monkeypatch.setattr(tables, "SCANS_PER_TASK", 16, raising=False)
    for kind, folder in (("own", tmp_path / "a"), ("spark", tmp_path / "b")):
        if kind == "spark":
            monkeypatch.setattr(tables, "local_path", lambda *_: None)
        tables.write_docs(df, f"file://{folder}", "id", "text")
        assert not [p for p in folder.iterdir() if p.is_file() and p.suffix == ".txt"]
        assert len([*folder.glob("part=*")]) == 8 and len([*folder.glob("part=*/[!.]*")]) == 600
        assert kind == "spark" or not [*folder.rglob(".*")]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
        try:
            docs = tables.read_docs(spark, f"file://{folder}")
            assert docs.rdd.getNumPartitions() <= max(4 * spark.sparkContext.defaultParallelism, 600 // 2 // 16 + 1)
            assert {int(r.id): r.text for r in tables.split_docs(docs).collect()} == texts
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        tables.write_docs(df.where("false"), f"file://{folder}-none", "id", "text")
        assert tables.read_docs(spark, f"file://{folder}-none").count() == 0


def test_src_docs_with_a_path_without_scheme(spark, tmp_path):
    from plumbline.sources.tables import local_path
    assert [local_path(spark, p) for p in ("file:/a/b", "file:///a/b", "/a/b")] == ["/a/b"] * 3
    assert [local_path(spark, p) for p in ("hdfs://n/a", "viewfs://store/a", "s3a://b/a")] == [None] * 3


def facts_of(docs):
    from pyspark.sql import functions as F
    return sorted(tuple(r) for r in docs.select("path", F.unix_micros("modified"), F.hex("text")).collect())


def test_docs_folder_is_listed_by_tasks(spark, tmp_path):
    """No list of the files in the driver, and the rows of Spark's own reader."""
    import string
    from plumbline.sources.tables import read_docs, scan_docs, write_docs
    write_docs(spark.range(300).selectExpr("id", "repeat('é\n', cast(id % 7 as int)) as text").repartition(5), f"file://{tmp_path}/w x%20", "id", "text")
    odd = "".join(c for c in string.printable if c.isprintable() and c not in "/:")  # Hadoop opens no name with a colon
    for name, text in {odd: b"odd", "empty": b"", "_hidden": b"h", ".hidden": b"h", "x._COPYING_": b"h", "_k=1": b"seen",
                       "bytes.txt": b"\xff\xfe\r\n", "bom.txt": b"\xef\xbb\xbfb"}.items():
        for folder in ("flat", "parts/part=3"):
            (tmp_path / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / name).write_bytes(text)
    (tmp_path / "parts" / "beside.txt").write_text("not read")
    for folder, n in (("w x%20", 300), ("flat", 4), ("parts", 4), ("parts/part=3/", 4)):
        docs = read_docs(spark, f"file://{tmp_path}/{folder}")
        assert docs.inputFiles() == [] and docs.schema.names == ["path", "modified", "text"]
        assert facts_of(docs) == facts_of(scan_docs(spark, f"file://{tmp_path}/{folder}")) and docs.count() == n


def test_docs_folder_of_other_shapes(spark, tmp_path):
    """Compressed files, names beyond ASCII, folders beside files and patterns stay with Spark's reader."""
    import gzip
    from plumbline.sources.tables import read_docs, scan_docs
    for name, text in {"a/x.gz": gzip.compress(b"packed"), "b/é.txt": b"e", "c/x.txt": b"x", "c/sub/y.txt": b"y", "d/k=1/x.txt": b"x",
                       "e/part=1/x.txt": b"x", "e/part=1/sub/y.txt": b"y"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text)
    for path, n in (("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 2), ("c/*.txt", 1), ("c/x.txt", 1)):
        path = f"file://{tmp_path}/{path}"
        assert facts_of(read_docs(spark, path)) == facts_of(scan_docs(spark, path)) and read_docs(spark, path).count() == n


def test_docs_folder_outside_the_local_file_system_is_read_in_groups(spark, tmp_path, monkeypatch):
    from plumbline.sources import tables
    monkeypatch.setattr(tables, "local_path", lambda *_: None)
    monkeypatch.setattr(tables, "FILES_PER_SCAN", 40, raising=False)
    monkeypatch.setattr(tables, "FILES_PER_FOLDER", 16, raising=False)
    path, texts = f"file://{tmp_path}/docs", {i: f"text {i}\n" * (i % 3) for i in range(150)}
    tables.write_docs(spark.createDataFrame(list(texts.items()), "id int, text string").repartition(2), path, "id", "text")
    sizes = [len([*p.glob("[!.]*")]) for p in (tmp_path / "docs").glob("part=*")]
    assert max(sizes) <= 16 and sum(sizes) == 150
    seen, scan = [], tables.scan_docs
    monkeypatch.setattr(tables, "scan_docs", lambda *a: seen.append((d := scan(*a)).count()) or d)
    docs = tables.read_docs(spark, path)
    assert max(seen) <= 40 and sum(seen) == 150 and facts_of(docs) == facts_of(scan(spark, path))
    assert {int(r.id): r.text for r in tables.split_docs(docs).collect()} == texts
    (tmp_path / "docs" / "other").mkdir()
    assert tables.folder_groups(spark, path) == []
