"""Invariants that must hold on any data (run on the sf0.001 tables)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from plumbline.operators import audit as A
from plumbline.operators import uncertainty as U
from plumbline.plans.rehearsal import AS_OF, alive_at, spells
from plumbline.sources.tables import Tables
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_decomposition_sums_to_change(spark, q):
    r = q["c_decompose"](spark, SF_SMALL).first()
    assert abs(r.rate_effect + r.mix_effect + r.interaction - r.change_pts) < 1e-4


def test_shares_sum_to_one(spark, q):
    s = q["win_share"](spark, SF_SMALL).groupBy("yr").agg(F.sum("share").alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-4 for r in s)


def test_retention_monotone(spark, q):
    r = sorted((x.horizon, x.at_risk, x.cumulative_events) for x in q["c_retention"](spark, SF_SMALL).collect())
    assert all(a[1] >= b[1] for a, b in zip(r, r[1:]))
    assert all(a[2] <= b[2] for a, b in zip(r, r[1:]))


def test_wilson_contains_point(spark, q):
    for r in q["u_wilson"](spark, SF_SMALL).collect():
        assert 0 <= r.lower_pct <= r.rate_pct <= r.upper_pct <= 100


def test_suppression_keeps_rows(spark):
    s = spells(Tables(spark, SF_SMALL))
    g = s.groupBy("unit", "wtype").agg(F.count("*").alias("n"))
    out = U.u_suppress(g, "n", [], 5)
    assert out.count() == g.count()
    assert out.where(F.col("n").isNotNull() & (F.col("n") < 5)).count() == 0


def test_complementary_leaves_nothing_recoverable(spark, q):
    out = q["u_complementary"](spark, SF_SMALL)
    pub = out.select("unit", "wtype", "n_shown")
    assert U.u_recoverable(pub, "unit", "wtype", "n_shown").where("recoverable").count() == 0
    primary = out.where(F.col("reason") == "primary").count()
    live = q["u_small_cells"](spark, SF_SMALL).count()
    assert out.where((F.col("reason") == "primary") & (F.col("level") == "cell")).count() == live <= primary


def test_breakdown_reconciles(spark, q):
    assert q["a_breakdown_total"](spark, SF_SMALL).first().reconciles


def test_fanout_matches_actual_join(spark):
    t = Tables(spark, SF_SMALL)
    r = A.a_fanout(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")),
                   "o_orderkey").first()
    actual = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).count()
    assert r.joined_rows == actual


def test_standardised_equals_naive_when_mix_shared(spark):
    from plumbline.operators.compare import k_naive_gap, k_standardised
    rows = [("a", True, 1), ("a", True, 0), ("a", False, 1), ("a", False, 1),
            ("b", True, 0), ("b", True, 0), ("b", False, 1), ("b", False, 0)]
    u = spark.createDataFrame(rows, "s string, t boolean, y int")
    assert abs(k_standardised(u, "t", "y", "s").first().standardised_gap_pts
               - k_naive_gap(u, "t", "y").first().gap_pts) < 1e-9


def test_headcount_matches_alive_spells(spark, q):
    n = spells(Tables(spark, SF_SMALL)).where(alive_at(AS_OF.replace(year=2000, month=12, day=31))).count()
    assert q["m_headcount"](spark, SF_SMALL).first().headcount == n


def test_multiplicity_adjustments_ordered(spark, q):
    r = sorted(q["u_multiplicity"](spark, SF_SMALL).collect(), key=lambda x: (x.p_value, x.unit))
    for x in r:
        assert x.p_value - 1e-9 <= x.p_bh <= x.p_bonferroni + 1e-9
        assert x.comparisons == len(r)
    assert all(a.p_bh <= b.p_bh + 1e-9 for a, b in zip(r, r[1:]))


def test_shrinkage_pulls_toward_overall(spark, q):
    for x in q["u_shrink"](spark, SF_SMALL).collect():
        lo, hi = sorted([x.raw_pct, x.overall_pct])
        assert lo - 1e-6 <= x.shrunk_pct <= hi + 1e-6


def test_poisson_interval_contains_count(spark, q):
    for x in q["u_poisson"](spark, SF_SMALL).collect():
        assert x.count_lower <= x.events <= x.count_upper
