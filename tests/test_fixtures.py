"""Hand fixtures with known answers (FIXTURES.md §6)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions.dates import month_diff
from plumbline.functions.stats import wilson_bounds
from plumbline.operators import audit as A
from plumbline.operators import cohort as C
from plumbline.operators import compare as K
from plumbline.operators import telemetry as E
from plumbline.operators import uncertainty as U


def test_wilson_known_values(spark):
    df = spark.createDataFrame([(2, 11), (0, 5), (156, 1343)], "x long, n long")
    lo, hi = wilson_bounds("x", "n")
    got = [(round(r[0], 5), round(r[1], 5)) for r in df.select(lo, hi).collect()]
    assert got == [(0.05137, 0.47698), (0.0, 0.43448), (0.10011, 0.1344)]


def test_wilson_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(0, 0)], "x long, n long")
    lo, hi = wilson_bounds("x", "n")
    assert df.select(lo, hi).first() == (None, None)


def test_sign_test_published_run(spark):
    one, two = E.sign_test(F.lit(17), F.lit(5))
    r = spark.range(1).select(one.alias("a"), two.alias("b")).first()
    assert round(r.a, 5) == 0.00845 and round(r.b, 4) == 0.0169


def test_month_diff_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2024, 2, 1)),
                                (dt.date(2024, 1, 15), dt.date(2024, 2, 14))], "a date, b date")
    assert [r[0] for r in df.select(month_diff("a", "b")).collect()] == [1, 1]


def _units(spark, cells):
    """cells: (stratum, treated, n, events) -> one row per unit."""
    rows = []
    for s, t, n, e in cells:
        rows.append((s, t, n, e))
    df = spark.createDataFrame(rows, "s string, t int, n int, e int")
    return df.select("s", "t", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "e") \
        .select("s", (F.col("t") == 1).alias("t"), (F.col("i") <= F.col("e")).cast("int").alias("y"))


def test_standardised_replays_published_gap(spark):
    # (enrolled n, %, not n, %) per tier; events = round(n * pct)
    strata = [(59, 32.2, 604, 29.8), (336, 15.2, 1192, 19.3), (586, 11.4, 932, 13.8), (362, 5.2, 293, 7.5)]
    cells = []
    for i, (n1, p1, n0, p0) in enumerate(strata):
        cells += [(str(i), 1, n1, round(n1 * p1 / 100)), (str(i), 0, n0, round(n0 * p0 / 100))]
    u = _units(spark, cells)
    r = K.k_standardised(u, "t", "y", "s", round_strata=1).first()
    assert round(r.standardised_gap_pts, 4) == -2.251
    assert r.n_used == 4364 and r.strata_missing_arm == 0


def test_standardised_known_truth_zero(spark):
    # rates 10% / 30% in both arms, different mix
    u = _units(spark, [("a", 1, 80, 8), ("b", 1, 20, 6), ("a", 0, 20, 2), ("b", 0, 80, 24)])
    naive = K.k_naive_gap(u, "t", "y").first()
    assert (naive.treated_rate_pct, naive.control_rate_pct, naive.gap_pts) == (14.0, 26.0, -12.0)
    assert K.k_standardised(u, "t", "y", "s").first().standardised_gap_pts == 0.0


def test_standardised_omitted_confounder(spark):
    # stratum x hidden trait; 20x the FIXTURES counts so events are whole
    cells = [("1", "lo", 1, 1200, 60), ("1", "hi", 1, 400, 60), ("1", "lo", 0, 100, 5), ("1", "hi", 0, 300, 45),
             ("2", "lo", 1, 300, 75), ("2", "hi", 1, 100, 35), ("2", "lo", 0, 400, 100), ("2", "hi", 0, 1200, 420)]
    df = spark.createDataFrame(cells, "s string, h string, t int, n int, e int")
    u = df.select("s", "h", F.col("t") == 1, F.explode(F.sequence(F.lit(1), "n")).alias("i"), "e") \
        .toDF("s", "h", "t", "i", "e").withColumn("y", (F.col("i") <= F.col("e")).cast("int"))
    assert K.k_standardised(u, "t", "y", "s").first().standardised_gap_pts == -5.0
    u2 = u.withColumn("sh", F.concat_ws("/", "s", "h"))
    assert abs(K.k_standardised(u2, "t", "y", "sh").first().standardised_gap_pts) < 1e-9


def test_retention_censoring(spark):
    people = spark.createDataFrame([
        (dt.date(2020, 1, 15), dt.date(2020, 6, 10)),   # event at month 5
        (dt.date(2022, 9, 15), None),                   # censored at 8
        (dt.date(2020, 1, 15), None)],                  # observed 40
        "entry date, exit date")
    r = {x.horizon: (x.at_risk, x.cumulative_events)
         for x in C.c_retention(people, "entry", "exit", dt.date(2023, 5, 15), [6, 12]).collect()}
    assert r == {6: (2, 1), 12: (1, 1)}


def test_decompose_pure_mix(spark):
    rows = [(0, "A", 50, 5), (0, "B", 50, 15), (1, "A", 80, 8), (1, "B", 20, 6)]
    df = spark.createDataFrame(rows, "p int, s string, n int, e int")
    u = df.select("p", "s", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "e") \
        .withColumn("y", F.col("i") <= F.col("e"))
    r = C.c_decompose(u, F.col("p"), 0, 1, F.col("s"), F.col("y")).first()
    assert (r.base_pct, r.actual_pct, r.mix_effect, r.rate_effect, r.interaction) == (20.0, 14.0, -6.0, 0.0, 0.0)


def test_complementary_one_by_three(spark):
    cells = [("r", "a", 3), ("r", "b", 20), ("r", "c", 30)]
    df = spark.createDataFrame(cells, "d1 string, d2 string, n int")
    units = df.select("d1", "d2", F.explode(F.sequence(F.lit(1), "n")).alias("i")) \
        .withColumn("k", F.concat_ws("-", "d1", "d2", "i"))
    out = U.u_complementary(units, "d1", "d2", "k", 5)
    hidden = sorted((r.level, r.d2, r.n_shown) for r in out.where("hidden").collect())
    assert [x for x in hidden if x[0] == "cell"] == [("cell", "a", None), ("cell", "b", None)]
    assert "n_true" not in out.columns  # no column tells a hidden count
    assert out.count() == 8  # 3 cells + 1 row total + 3 column totals + grand total, all kept


def test_fanout_two_by_three(spark):
    left = spark.createDataFrame([("a",), ("a",)], "k string")
    right = spark.createDataFrame([("a",), ("a",), ("a",)], "k string")
    r = A.a_fanout(left, right, "k").first()
    assert (r.left_rows, r.joined_rows, r.inflation_factor) == (2, 6, 3.0)


def _scores(spark, rows):
    return spark.createDataFrame(rows, "mode string, slice string, eval_id string, negative boolean, "
                                       "trap string, total int, repeats int, n_runs long, passed double, "
                                       "n_lost long")


def test_compare_excludes_one_sided_evals(spark):
    a = _scores(spark, [("a", "s", "e1", False, "t", 2, 1, 1, 2.0, 0), ("a", "s", "e2", False, "t", 2, 1, 1, 0.0, 0)])
    b = _scores(spark, [("b", "s", "e1", False, "t", 2, 1, 1, 1.0, 0)])
    r = {x.slice: x for x in E.e_compare(a, b).collect()}
    assert r["s"].baseline_pct == 100.0 and r["s"].treated_pct == 50.0
    assert r["s"].excluded_evals == 1 and r["s"].matched_evals == 1


def test_compare_slice_without_matches_is_no_data(spark):
    a = _scores(spark, [("a", "only_a", "e1", False, "t", 2, 1, 1, 2.0, 0)])
    b = _scores(spark, [("b", "only_b", "e9", False, "t", 2, 1, 1, 2.0, 0)])
    r = {x.slice: x for x in E.e_compare(a, b).collect()}
    assert r["only_a"].baseline_pct is None and r["only_a"].treated_pct is None


def test_gt_drift(spark):
    pinned = spark.createDataFrame([("a.b", "1"), ("a.c", "2"), ("_meta.as_of", "x")], "path string, value string")
    same = spark.createDataFrame([("a.b", "1"), ("a.c", "2"), ("_meta.as_of", "y")], "path string, value string")
    changed = spark.createDataFrame([("a.b", "1"), ("a.c", "3")], "path string, value string")
    assert A.a_gt_drift(pinned, same).count() == 0
    assert [tuple(r) for r in A.a_gt_drift(pinned, changed).collect()] == [("a.c", "2", "3")]


def test_convert_currency_keeps_unknown(spark):
    from plumbline.operators.metrics import convert_currency, m_dist
    pay = spark.createDataFrame([(1, 100.0, "EUR"), (2, 200.0, "USD"), (3, 50.0, "XXX")],
                                "id int, amount double, cur string")
    rates = spark.createDataFrame([("EUR", 1.1), ("USD", 1.0)], "cur string, rate double")
    out = {r.id: r.value_base for r in convert_currency(pay, "amount", "cur", rates, "rate").collect()}
    assert out == {1: 110.00000000000001, 2: 200.0, 3: None}
    assert m_dist(pay, "amount", ["cur"]).count() == 3  # never pooled across currencies


def test_headcount_approx_opt_in(spark):
    from plumbline.operators.metrics import m_headcount
    from plumbline.operators.population import Population
    df = spark.range(20000).select((F.col("id") % 5000).alias("k"))
    exact = m_headcount(df, Population(None, "k", "all")).first().headcount
    approx = m_headcount(df, Population(None, "k", "all"), approx_rsd=0.02).first()
    assert exact == 5000 and abs(approx.headcount - 5000) < 5000 * 0.08 and approx.approx_rsd == 0.02


def test_kaplan_meier_hand_values(spark):
    people = spark.createDataFrame([
        (dt.date(2020, 1, 10), dt.date(2020, 3, 5)),    # event at month 2
        (dt.date(2020, 1, 10), None),                   # censored at month 3 (as-of)
        (dt.date(2019, 10, 10), dt.date(2020, 3, 1))],  # event at month 5
        "entry date, exit date")
    r = {x.months: (x.n_at_risk, x.events, x.survival)
         for x in C.c_km(people, "entry", "exit", dt.date(2020, 4, 30)).collect()}
    assert r[2] == (3, 1, round(2 / 3, 6))
    assert r[3] == (2, 0, round(2 / 3, 6))
    assert r[5] == (1, 1, 0.0)


def test_funnel_order_skip_and_reentry(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    ev = spark.createDataFrame([
        ("u1", t(1), "view"), ("u1", t(2), "click"), ("u1", t(3), "signup"), ("u1", t(4), "purchase"),
        ("u2", t(1), "click"), ("u2", t(2), "view"), ("u2", t(3), "click"),   # click before view, then again
        ("u3", t(1), "view"), ("u3", t(2), "signup"),                         # skips click
        ("u4", t(1), "purchase")],                                            # never entered
        "u string, ts timestamp, stage string")
    stages = ["view", "click", "signup", "purchase"]
    f = {r.stage: (r.entered, r.cumulative_pct) for r in C.c_funnel(ev, "u", "ts", "stage", stages).collect()}
    assert f == {"view": (3, 100.0), "click": (2, round(200 / 3, 6)), "signup": (1, round(100 / 3, 6)),
                 "purchase": (1, round(100 / 3, 6))}
    chk = {r.stage: (r.with_event, r.out_of_order, r.monotone)
           for r in C.c_funnel_checks(ev, "u", "ts", "stage", stages).collect()}
    assert chk == {"view": (3, 0, True), "click": (2, 0, True), "signup": (2, 1, True), "purchase": (2, 1, True)}


def test_recoverable_by_subtraction(spark):
    # published 1x3 table with margins; only the n=3 cell and its column total hidden
    pub = spark.createDataFrame([
        ("r", "a", None), ("r", "b", 20), ("r", "c", 30), ("r", None, 53),
        (None, "a", None), (None, "b", 20), (None, "c", 30), (None, None, 53)],
        "d1 string, d2 string, n_shown long")
    got = sorted((r.level, r.recoverable) for r in U.u_recoverable(pub, "d1", "d2", "n_shown").collect())
    assert got == [("cell", True), ("column_total", True)]
