"""§2.11 comparisons and causal diagnostics on the rehearsal views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.functions.dates import in_range
from plumbline.operators import compare as K
from plumbline.operators.cohort import c_decompose
from plumbline.operators.etl import etl_eligibility
from plumbline.plans.rehearsal import AS_OF, SPELL_SQL, SURVEY_SQL, spells, survey, with_sql
from plumbline.plans.registry import query
from plumbline.plans.sqlfrag import hidden_sql, wilson_sql
from plumbline.sources.tables import Tables

TOKENS_SQL = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 0)"

# Fixed rehearsal lexicon: function words of the four document languages plus
# one two-word phrase (the invented prose carries no causal vocabulary).
FUNCTION_WORDS = [("article_en", "the"), ("article_de", "der"), ("article_fr", "les"),
                  ("article_es", "los"), ("phrase_fr_es", "de la")]
LEX_SQL = "lex(category, term, n_words) AS (VALUES " + ", ".join(
    f"('{c}', '{t}', {len(t.split())})" for c, t in FUNCTION_WORDS) + ")"
HITS_SQL = f"""d AS (SELECT doc_id, {TOKENS_SQL} AS t FROM documents),
u AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS position, 1 AS n_words FROM d),
b AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term,
             unnest(range(0, len(t) - 1)) AS position, 2 AS n_words FROM d),
hits AS (SELECT doc_id, CAST(position AS BIGINT) AS position, term, category
         FROM (SELECT * FROM u UNION ALL SELECT * FROM b) x JOIN lex USING (term, n_words))"""

ARM_SQL = """count(CASE WHEN treated = 1 THEN 1 END) AS n_treated,
       round(100.0 * count(CASE WHEN treated = 1 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN treated = 1 THEN 1 END), 0), 6) AS treated_rate_pct,
       count(CASE WHEN treated = 0 THEN 1 END) AS n_control,
       round(100.0 * count(CASE WHEN treated = 0 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN treated = 0 THEN 1 END), 0), 6) AS control_rate_pct,
       round(100.0 * count(CASE WHEN treated = 1 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN treated = 1 THEN 1 END), 0)
             - 100.0 * count(CASE WHEN treated = 0 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN treated = 0 THEN 1 END), 0), 6) AS gap_pts"""


def _sp(spark, sf):
    return spells(Tables(spark, sf)).withColumn("separated", F.col("sep").isNotNull())


@query("k_naive_gap", with_sql(SPELL_SQL) + f"SELECT {ARM_SQL} FROM spell")
def k_naive_gap(spark, sf):
    return K.k_naive_gap(_sp(spark, sf), F.col("treated") == 1, "separated")


_t_lo, _t_hi = wilson_sql("y1", "n1")
_c_lo, _c_hi = wilson_sql("y0", "n0")


@query("k_stratified", with_sql(SPELL_SQL) + f"""
, g AS (SELECT prio, count(CASE WHEN treated = 1 THEN 1 END) AS n1,
               count(CASE WHEN treated = 1 AND sep IS NOT NULL THEN 1 END) AS y1,
               count(CASE WHEN treated = 0 THEN 1 END) AS n0,
               count(CASE WHEN treated = 0 AND sep IS NOT NULL THEN 1 END) AS y0 FROM spell GROUP BY prio)
""" + hidden_sql(f"""SELECT prio, n1 AS n_treated, round(100.0 * y1 / NULLIF(n1, 0), 6) AS treated_rate_pct,
       round({_t_lo} * 100, 6) AS treated_lower_pct, round({_t_hi} * 100, 6) AS treated_upper_pct,
       n0 AS n_control, round(100.0 * y0 / NULLIF(n0, 0), 6) AS control_rate_pct,
       round({_c_lo} * 100, 6) AS control_lower_pct, round({_c_hi} * 100, 6) AS control_upper_pct,
       round(100.0 * y1 / NULLIF(n1, 0) - 100.0 * y0 / NULLIF(n0, 0), 6) AS gap_pts,
       CASE WHEN least(n1, n0) < 5 THEN 'suppressed' WHEN least(n1, n0) < 30 THEN 'unstable'
            ELSE 'stable' END AS stability
FROM g""", ["prio"], ["n_treated", "treated_rate_pct", "treated_lower_pct", "treated_upper_pct", "n_control",
                                       "control_rate_pct", "control_lower_pct", "control_upper_pct", "gap_pts"]))
def k_stratified(spark, sf):
    return K.k_stratified(_sp(spark, sf), F.col("treated") == 1, "separated", "prio")


@query("k_standardised", with_sql(SPELL_SQL) + """
, g AS (SELECT prio, count(CASE WHEN treated = 1 THEN 1 END) AS n1,
               count(CASE WHEN treated = 1 AND sep IS NOT NULL THEN 1 END) AS y1,
               count(CASE WHEN treated = 0 THEN 1 END) AS n0,
               count(CASE WHEN treated = 0 AND sep IS NOT NULL THEN 1 END) AS y0 FROM spell GROUP BY prio)
SELECT round(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (100.0 * y1 / n1 - 100.0 * y0 / n0) * (n1 + n0) END)
             / sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 + n0 END), 6) AS standardised_gap_pts,
       round(100.0 * sum(y1) / sum(n1) - 100.0 * sum(y0) / sum(n0), 6) AS naive_gap_pts,
       count(CASE WHEN n1 > 0 AND n0 > 0 THEN 1 END) AS strata_used,
       count(CASE WHEN NOT (n1 > 0 AND n0 > 0) THEN 1 END) AS strata_missing_arm,
       CAST(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 + n0 END) AS BIGINT) AS n_used,
       CAST(coalesce(sum(CASE WHEN NOT (n1 > 0 AND n0 > 0) THEN n1 + n0 END), 0) AS BIGINT) AS n_excluded
FROM g""")
def k_standardised(spark, sf):
    return K.k_standardised(_sp(spark, sf), F.col("treated") == 1, "separated", "prio")


@query("k_assignment", with_sql(SPELL_SQL) + """
, x AS (SELECT treated = 1 AS t, bal, CAST(date_diff('day', hire, DATE '2001-06-30') AS DOUBLE) AS tenure_days
        FROM spell),
w AS (SELECT count(CASE WHEN t THEN 1 END) AS n_treated, count(CASE WHEN NOT t THEN 1 END) AS n_control,
             avg(CASE WHEN t THEN bal END) AS b1, avg(CASE WHEN NOT t THEN bal END) AS b0,
             var_samp(CASE WHEN t THEN bal END) AS bv1, var_samp(CASE WHEN NOT t THEN bal END) AS bv0,
             avg(CASE WHEN t THEN tenure_days END) AS d1, avg(CASE WHEN NOT t THEN tenure_days END) AS d0,
             var_samp(CASE WHEN t THEN tenure_days END) AS dv1,
             var_samp(CASE WHEN NOT t THEN tenure_days END) AS dv0 FROM x)
SELECT 'bal' AS covariate, n_treated, n_control, round(b1, 6) AS mean_treated, round(b0, 6) AS mean_control,
       round((b1 - b0) / NULLIF(sqrt((bv1 + bv0) / 2), 0), 6) AS smd FROM w
UNION ALL
SELECT 'tenure_days', n_treated, n_control, round(d1, 6), round(d0, 6),
       round((d1 - d0) / NULLIF(sqrt((dv1 + dv0) / 2), 0), 6) FROM w
UNION ALL
SELECT 'wtype=' || coalesce(wtype, '<null>'), (SELECT n_treated FROM w), (SELECT n_control FROM w),
       round(k1 / (SELECT n_treated FROM w), 6), round(k0 / (SELECT n_control FROM w), 6),
       round((k1 / (SELECT n_treated FROM w) - k0 / (SELECT n_control FROM w))
             / NULLIF(sqrt((k1 / (SELECT n_treated FROM w) * (1 - k1 / (SELECT n_treated FROM w))
                            + k0 / (SELECT n_control FROM w) * (1 - k0 / (SELECT n_control FROM w))) / 2), 0), 6)
FROM (SELECT wtype, count(CASE WHEN treated = 1 THEN 1 END) AS k1, count(CASE WHEN treated = 0 THEN 1 END) AS k0
      FROM spell GROUP BY wtype) lv""")
def k_assignment(spark, sf):
    s = _sp(spark, sf).withColumn("tenure_days", F.datediff(F.lit(AS_OF), "hire").cast("double"))
    return K.k_assignment(s, F.col("treated") == 1, ["bal", "tenure_days"], categorical=["wtype"])


AWARD_DAYS = 1095


@query("k_immortal", with_sql(SPELL_SQL) + f"""
, a AS (SELECT *, CASE WHEN hire + INTERVAL {AWARD_DAYS} DAY <= DATE '2001-06-30'
                        AND (sep IS NULL OR sep > hire + INTERVAL {AWARD_DAYS} DAY) THEN 1 ELSE 0 END AS award
        FROM spell)
SELECT count(CASE WHEN award = 1 THEN 1 END) AS n_treated,
       round(100.0 * count(CASE WHEN award = 1 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN award = 1 THEN 1 END), 0), 6) AS treated_rate_pct,
       count(CASE WHEN award = 0 THEN 1 END) AS n_control,
       round(100.0 * count(CASE WHEN award = 0 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN award = 0 THEN 1 END), 0), 6) AS control_rate_pct,
       round(100.0 * count(CASE WHEN award = 1 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN award = 1 THEN 1 END), 0)
             - 100.0 * count(CASE WHEN award = 0 AND sep IS NOT NULL THEN 1 END)
             / NULLIF(count(CASE WHEN award = 0 THEN 1 END), 0), 6) AS gap_pts,
       {AWARD_DAYS} AS eligibility_horizon_days
FROM a""")
def k_immortal(spark, sf):
    """Award that requires surviving 1,095 days: the outcome is embedded in
    the eligibility rule, so the 'awarded' arm looks immune to exits."""
    s = _sp(spark, sf)
    el = etl_eligibility(s, "hire", "sep", AWARD_DAYS, AS_OF).select("k", F.lit(1).alias("award"))
    u = s.join(el, "k", "left").withColumn("award", F.coalesce("award", F.lit(0)))
    return K.k_naive_gap(u, F.col("award") == 1, "separated") \
        .withColumn("eligibility_horizon_days", F.lit(AWARD_DAYS))


LANDMARK = dt.date(1998, 12, 31)


@query("k_landmark", with_sql(SPELL_SQL) + f"""
, a AS (SELECT *, CASE WHEN hire + INTERVAL {AWARD_DAYS} DAY <= DATE '2001-06-30'
                        AND (sep IS NULL OR sep > hire + INTERVAL {AWARD_DAYS} DAY)
                       THEN CAST(hire + INTERVAL {AWARD_DAYS} DAY AS DATE) END AS award_date FROM spell),
l AS (SELECT award_date IS NOT NULL AND award_date <= DATE '1998-12-31' AS awarded, sep IS NOT NULL AS event
      FROM a WHERE hire <= DATE '1998-12-31' AND (sep IS NULL OR sep > DATE '1998-12-31'))
SELECT awarded, count(*) AS n, count(CASE WHEN event THEN 1 END) AS events,
       round(100.0 * count(CASE WHEN event THEN 1 END) / count(*), 6) AS rate_pct FROM l GROUP BY awarded""")
def k_landmark(spark, sf):
    s = _sp(spark, sf)
    el = etl_eligibility(s, "hire", "sep", AWARD_DAYS, AS_OF, name="award_date").select("k", "award_date")
    u = s.join(el, "k", "left")
    return K.k_landmark(u, "hire", "sep", "award_date", LANDMARK)


@query("k_survivorship", with_sql(SPELL_SQL) + """
SELECT CAST(year(hire) AS BIGINT) AS cohort, count(*) AS n_entered, count(CASE WHEN sep IS NULL THEN 1 END) AS n_survivors,
       round(avg(CASE WHEN sep IS NULL THEN bal END), 6) AS mean_survivors, round(avg(bal), 6) AS mean_entered,
       round(round(avg(CASE WHEN sep IS NULL THEN bal END), 6) - round(avg(bal), 6), 6) AS survivor_bias
FROM spell GROUP BY 1""")
def k_survivorship(spark, sf):
    s = _sp(spark, sf).withColumn("cohort", F.year("hire").cast("long"))
    return K.k_survivorship(s, "cohort", F.col("sep").isNull(), "bal")


WIDE_SQL = """, r AS (SELECT user_id, wave, item, (value - 1.0) / (scale_max - 1) AS v FROM survey),
uw AS (SELECT user_id, avg(CASE WHEN wave = 'W1' THEN v END) AS x1, avg(CASE WHEN wave = 'W2' THEN v END) AS x2
       FROM r GROUP BY user_id)"""


def _rescaled(spark, sf):
    return survey(Tables(spark, sf)).withColumn(
        "v", (F.col("value") - 1.0) / (F.col("scale_max") - 1))


@query("k_reg_to_mean", with_sql(SURVEY_SQL) + WIDE_SQL + """
, p AS (SELECT * FROM uw WHERE x1 IS NOT NULL AND x2 IS NOT NULL),
q AS (SELECT quantile_cont(x1, 1.0 / 3) AS c1, quantile_cont(x1, 2.0 / 3) AS c2, corr(x1, x2) AS r,
             avg(x1) AS m1 FROM p),
g AS (SELECT CASE WHEN x1 <= c1 THEN 1 WHEN x1 <= c2 THEN 2 ELSE 3 END AS baseline_group,
             count(*) AS n, avg(x1) AS a, avg(x2) AS b, any_value(r) AS r, any_value(m1) AS m1
      FROM p, q GROUP BY 1)
SELECT baseline_group, n, round(a, 6) AS mean_baseline, round(b, 6) AS mean_followup,
       round(b - a, 6) AS observed_change, round((1 - r) * (m1 - a), 6) AS expected_rtm_change,
       round(r, 6) AS r FROM g""")
def k_reg_to_mean(spark, sf):
    r = _rescaled(spark, sf)
    uw = r.groupBy("user_id").agg(F.avg(F.when(F.col("wave") == "W1", F.col("v"))).alias("x1"),
                                  F.avg(F.when(F.col("wave") == "W2", F.col("v"))).alias("x2"))
    return K.k_reg_to_mean(uw, "x1", "x2")


@query("k_range_restrict", """
SELECT 'pool' AS "group", count(*) AS n, round(stddev_samp(l_quantity), 6) AS sd_x,
       round(stddev_samp(l_extendedprice), 6) AS sd_y, round(corr(l_quantity, l_extendedprice), 6) AS corr_xy
FROM lineitem
UNION ALL
SELECT 'selected', count(*), round(stddev_samp(l_quantity), 6), round(stddev_samp(l_extendedprice), 6),
       round(corr(l_quantity, l_extendedprice), 6) FROM lineitem WHERE l_quantity >= 25""")
def k_range_restrict(spark, sf):
    li = Tables(spark, sf).lineitem
    return K.k_range_restrict(li, F.col("l_quantity") >= 25, "l_quantity", "l_extendedprice")


@query("k_composition", """
WITH j AS (
  SELECT o_orderpriority AS stratum,
         count(CASE WHEN year(o_orderdate) = 1998 THEN 1 END) AS n0,
         coalesce(sum(CASE WHEN year(o_orderdate) = 1998 THEN o_totalprice END), 0) AS e0,
         count(CASE WHEN year(o_orderdate) = 1999 THEN 1 END) AS n1,
         coalesce(sum(CASE WHEN year(o_orderdate) = 1999 THEN o_totalprice END), 0) AS e1
  FROM orders WHERE year(o_orderdate) IN (1998, 1999) GROUP BY 1),
m AS (SELECT *, n0 / (SELECT sum(n0) FROM j) AS s0, n1 / (SELECT sum(n1) FROM j) AS s1,
             e0 / NULLIF(n0, 0) AS r0, e1 / NULLIF(n1, 0) AS r1 FROM j)
SELECT round(sum(s0 * coalesce(r0, 0)), 6) AS base_pct, round(sum(s1 * coalesce(r1, 0)), 6) AS actual_pct,
       round(sum(s1 * coalesce(r1, 0)) - sum(s0 * coalesce(r0, 0)), 6) AS change_pts,
       round(sum(s0 * (coalesce(r1, 0) - coalesce(r0, 0))), 6) AS rate_effect,
       round(sum((s1 - s0) * coalesce(r0, 0)), 6) AS mix_effect,
       round(sum((s1 - s0) * (coalesce(r1, 0) - coalesce(r0, 0))), 6) AS interaction,
       count(*) AS strata, count(CASE WHEN n0 = 0 OR n1 = 0 THEN 1 END) AS strata_one_period_only
FROM m""")
def k_composition(spark, sf):
    """Mean order value 1998 -> 1999 decomposed into within-priority change
    and priority-mix change (c_decompose on a mean, scale 1)."""
    o = Tables(spark, sf).orders.where(in_range("o_orderdate", dt.date(1998, 1, 1),
                                                dt.date(2000, 1, 1)))
    return c_decompose(o, F.year("o_orderdate"), 1998, 1999, F.col("o_orderpriority"),
                       F.col("o_totalprice"), scale=1.0)


def _cramer_sql(other: str) -> str:
    return f"""SELECT '{other}' AS other, n, g AS groups, c AS categories,
       round(sqrt((s - n) / NULLIF(n * (least(g, c) - 1), 0)), 6) AS cramers_v,
       round(100.0 * one / g, 6) AS pct_groups_in_one_category
FROM (SELECT sum(O) AS n, count(DISTINCT unit) AS g, count(DISTINCT {other}) AS c,
             sum(O * O * (SELECT sum(O) FROM ct_{other}) / (R * C)) AS s,
             (SELECT count(*) FROM (SELECT unit FROM ct_{other} GROUP BY unit HAVING count(*) = 1)) AS one
      FROM (SELECT *, sum(O) OVER (PARTITION BY unit) AS R, sum(O) OVER (PARTITION BY {other}) AS C
            FROM ct_{other}) x) y"""


@query("k_confounded_groups", with_sql(
    SPELL_SQL, "ct_loc AS (SELECT unit, loc, count(*) AS O FROM spell GROUP BY unit, loc)",
    "ct_wtype AS (SELECT unit, wtype, count(*) AS O FROM spell GROUP BY unit, wtype)")
    + _cramer_sql("loc") + "\nUNION ALL\n" + _cramer_sql("wtype"))
def k_confounded_groups(spark, sf):
    """Unit against region (nested: fully confounded) and against segment."""
    return K.k_confounded_groups(spells(Tables(spark, sf)), "unit", ["loc", "wtype"])


PERSON_WAVE_SQL = """, pw AS (SELECT user_id, wave,
              avg(CASE WHEN item = 'click' THEN (value - 1.0) / (scale_max - 1) END) AS x,
              avg(CASE WHEN item = 'purchase' THEN (value - 1.0) / (scale_max - 1) END) AS y
       FROM survey GROUP BY user_id, wave)"""


def _person_wave(spark, sf):
    r = _rescaled(spark, sf)
    return r.groupBy("user_id", "wave").agg(
        F.avg(F.when(F.col("item") == "click", F.col("v"))).alias("x"),
        F.avg(F.when(F.col("item") == "purchase", F.col("v"))).alias("y"))


@query("k_reverse", with_sql(SURVEY_SQL) + PERSON_WAVE_SQL + """
, l AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY wave) AS xn,
               lead(y) OVER (PARTITION BY user_id ORDER BY wave) AS yn FROM pw)
SELECT round(corr(x, yn), 6) AS corr_x_then_y, round(corr(y, xn), 6) AS corr_y_then_x,
       round(corr(x, y), 6) AS corr_same_wave, count(yn) AS n_lagged_pairs FROM l""")
def k_reverse(spark, sf):
    return K.k_reverse(_person_wave(spark, sf), "user_id", "wave", "x", "y")


@query("k_common_method", with_sql(SURVEY_SQL) + """
, m AS (SELECT user_id, wave, item, any_value(scale_max) AS instrument FROM survey
        WHERE item IN ('click', 'purchase') GROUP BY ALL),
pairs AS (SELECT a.user_id AS a_person, a.wave AS a_wave, a.instrument AS a_instrument,
                 b.user_id AS b_person, b.wave AS b_wave, b.instrument AS b_instrument
          FROM m a JOIN m b ON a.user_id = b.user_id AND a.item = 'click' AND b.item = 'purchase')
SELECT count(*) AS n_pairs,
       count(CASE WHEN a_person = b_person AND a_wave = b_wave AND a_instrument = b_instrument THEN 1 END)
         AS n_same_source,
       round(100.0 * count(CASE WHEN a_person = b_person AND a_wave = b_wave
                                 AND a_instrument = b_instrument THEN 1 END) / count(*), 6) AS same_source_pct
FROM pairs""")
def k_common_method(spark, sf):
    """Compared pairs = each person's click measure in a wave against their
    purchase measure in the same or the other wave."""
    s = survey(Tables(spark, sf)).where(F.col("item").isin("click", "purchase"))
    m = s.groupBy("user_id", "wave", "item").agg(F.first("scale_max").alias("instrument"))
    return K.k_common_method(m, "user_id", ["wave", "instrument"], F.col("item") == "click", F.col("item") == "purchase")


ITEMS = ["click", "error", "purchase", "signup", "view"]


@query("k_comparability", with_sql(SURVEY_SQL) + """
, per AS (SELECT wave, user_id, """ + ", ".join(
    f"avg(CASE WHEN item = '{it}' THEN (value - 1.0) / (scale_max - 1) END) AS i{j}"
    for j, it in enumerate(ITEMS)) + """ FROM survey GROUP BY wave, user_id),
c AS (SELECT * FROM per WHERE """ + " AND ".join(f"i{j} IS NOT NULL" for j in range(5)) + """),
g AS (SELECT wave, count(*) AS n_complete, """ + ", ".join(
    [f"avg(i{j}) AS m{j}" for j in range(5)] + [f"var_samp(i{j}) AS v{j}" for j in range(5)]
    + ["var_samp(" + " + ".join(f"i{j}" for j in range(5)) + ") AS vt"]
    + [f"corr(i{a}, i{b}) AS c{a}_{b}" for a in range(5) for b in range(a + 1, 5)]) + """
      FROM c GROUP BY wave)
SELECT wave, n_complete, round((""" + " + ".join(f"m{j}" for j in range(5)) + """) / 5, 6) AS mean_item_mean,
       round((""" + " + ".join(f"v{j}" for j in range(5)) + """) / 5, 6) AS mean_item_var,
       round((""" + " + ".join(f"c{a}_{b}" for a in range(5) for b in range(a + 1, 5)) + """) / 10, 6)
         AS mean_inter_item_r,
       round(1.25 * (1 - (""" + " + ".join(f"v{j}" for j in range(5)) + """) / NULLIF(vt, 0)), 6)
         AS cronbach_alpha
FROM g""")
def k_comparability(spark, sf):
    return K.k_comparability(_rescaled(spark, sf), "wave", "user_id", "item", "v", ITEMS)


@query("k_did", """
WITH x AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS period, year(o_orderdate) >= 1998 AS post,
                  c_mktsegment = 'BUILDING' AS t, o_totalprice AS y
           FROM orders JOIN customer ON c_custkey = o_custkey),
c AS (SELECT (avg(CASE WHEN t AND post THEN y END) - avg(CASE WHEN t AND NOT post THEN y END))
             - (avg(CASE WHEN NOT t AND post THEN y END) - avg(CASE WHEN NOT t AND NOT post THEN y END)) AS did
      FROM x)
SELECT period, any_value(post) AS post, round(avg(CASE WHEN t THEN y END), 6) AS mean_treated,
       round(avg(CASE WHEN NOT t THEN y END), 6) AS mean_control,
       round(avg(CASE WHEN t THEN y END) - avg(CASE WHEN NOT t THEN y END), 6) AS gap,
       round((SELECT did FROM c), 6) AS did_estimate
FROM x GROUP BY period""")
def k_did(spark, sf):
    """Order value of the BUILDING segment vs the rest, before/after 1998."""
    t = Tables(spark, sf)
    o = t.orders.join(t.customer.select("c_custkey", "c_mktsegment"),
                      F.col("o_custkey") == F.col("c_custkey"))
    yr = F.year("o_orderdate")
    return K.k_did(o, F.col("c_mktsegment") == "BUILDING", yr.cast("long"), yr >= 1998, "o_totalprice")


@query("k_matched", with_sql(SPELL_SQL) + """
, s AS (SELECT unit, wtype, count(CASE WHEN treated = 1 THEN 1 END) AS n1,
               avg(CASE WHEN treated = 1 THEN CASE WHEN sep IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS m1,
               count(CASE WHEN treated = 0 THEN 1 END) AS n0,
               avg(CASE WHEN treated = 0 THEN CASE WHEN sep IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS m0
        FROM spell GROUP BY unit, wtype)
SELECT count(CASE WHEN n1 > 0 AND n0 > 0 THEN 1 END) AS strata_matched,
       CAST(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 ELSE 0 END) AS BIGINT) AS n_treated_matched,
       CAST(sum(CASE WHEN NOT (n1 > 0 AND n0 > 0) THEN n1 ELSE 0 END) AS BIGINT) AS n_treated_unmatched,
       round(sum(CASE WHEN n1 > 0 AND n0 > 0 THEN (m1 - m0) * n1 END)
             / sum(CASE WHEN n1 > 0 AND n0 > 0 THEN n1 END), 6) AS att
FROM s""")
def k_matched(spark, sf):
    return K.k_matched(_sp(spark, sf), F.col("treated") == 1, ["unit", "wtype"], "separated")


@query("k_rd", """
WITH d AS (SELECT o_totalprice - 150000.0 AS x, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y
           FROM orders WHERE abs(o_totalprice - 150000.0) <= 50000.0)
SELECT count(CASE WHEN x < 0 THEN 1 END) AS n_left, count(CASE WHEN x >= 0 THEN 1 END) AS n_right,
       round(avg(CASE WHEN x < 0 THEN y END), 6) AS mean_left, round(avg(CASE WHEN x >= 0 THEN y END), 6) AS mean_right,
       round(regr_intercept(CASE WHEN x < 0 THEN y END, CASE WHEN x < 0 THEN x END), 6) AS intercept_left,
       round(regr_intercept(CASE WHEN x >= 0 THEN y END, CASE WHEN x >= 0 THEN x END), 6) AS intercept_right,
       round(regr_intercept(CASE WHEN x >= 0 THEN y END, CASE WHEN x >= 0 THEN x END)
             - regr_intercept(CASE WHEN x < 0 THEN y END, CASE WHEN x < 0 THEN x END), 6) AS jump
FROM d""")
def k_rd(spark, sf):
    o = Tables(spark, sf).orders
    return K.k_rd(o, "o_totalprice", 150000.0, F.col("o_orderstatus") == "F", 50000.0)


@query("k_trigger_scan", with_sql(LEX_SQL, HITS_SQL) + "SELECT * FROM hits")
def k_trigger_scan(spark, sf):
    docs = Tables(spark, sf).documents
    return K.k_trigger_scan(docs, "doc_id", "text", K.lexicon_frame(spark, FUNCTION_WORDS))


DESIGN_RULE_SQL = """CASE WHEN CAST(substr(source, 4) AS INTEGER) < 5 THEN 'randomised'
            WHEN CAST(substr(source, 4) AS INTEGER) < 10 THEN 'difference-in-differences'
            ELSE 'observational' END"""
LICENSED = ["randomised", "difference-in-differences", "regression discontinuity", "matched comparison"]


@query("k_licence", with_sql(LEX_SQL, HITS_SQL) + f"""
, f AS (SELECT doc_id, count(h.term) AS n_causal_terms FROM documents LEFT JOIN hits h USING (doc_id)
        GROUP BY doc_id),
des AS (SELECT doc_id, {DESIGN_RULE_SQL} AS design FROM documents)
SELECT doc_id, coalesce(design, 'unknown') AS design, n_causal_terms,
       coalesce(design IN ({", ".join(f"'{x}'" for x in LICENSED)}), false) AS licensed,
       CASE WHEN n_causal_terms = 0 THEN 'no causal wording'
            WHEN design IN ({", ".join(f"'{x}'" for x in LICENSED)}) THEN 'causal wording licensed'
            ELSE 'downgrade wording' END AS verdict
FROM f LEFT JOIN des USING (doc_id)""")
def k_licence(spark, sf):
    """Findings = lexicon hits per document; the design of each finding comes
    from a rule on its source (sources 0-4 randomised, 5-9 DiD, rest
    observational)."""
    docs = Tables(spark, sf).documents
    hits = K.k_trigger_scan(docs, "doc_id", "text", K.lexicon_frame(spark, FUNCTION_WORDS))
    findings = docs.select("doc_id").join(
        hits.groupBy("doc_id").agg(F.count("*").alias("n_causal_terms")), "doc_id", "left") \
        .fillna(0, ["n_causal_terms"])
    n = F.substring("source", 4, 10).cast("int")
    designs = docs.select("doc_id", F.when(n < 5, "randomised").when(n < 10, "difference-in-differences")
                          .otherwise("observational").alias("design"))
    return K.k_licence(findings, "doc_id", designs, "design", LICENSED)
