"""Comparison and causal diagnostics (§2.11).

Group comparisons are conditional aggregates in one pass; per-stratum frames
are one row per stratum. Text scans tokenise whole documents JVM-side and
join the hits against a small, size-checked lexicon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import safe_div, wilson_bounds
from plumbline.functions.text import tokens
from plumbline.session import materialize_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def k_naive_gap(units: DataFrame, treated: str | Column, outcome: str | Column,
                dp: int = 6) -> DataFrame:
    """Outcome rate in the treated and untreated arms, with n, and the gap."""
    t, y = _c(treated).cast("boolean"), _c(outcome).cast("double")
    g = units.agg(F.count_if(t).alias("n_treated"), F.sum(F.when(t, y)).alias("__y1"),
                  F.count_if(~t).alias("n_control"), F.sum(F.when(~t, y)).alias("__y0"))
    r1 = safe_div(F.col("__y1") * 100, "n_treated")
    r0 = safe_div(F.col("__y0") * 100, "n_control")
    return g.select("n_treated", F.round(r1, dp).alias("treated_rate_pct"),
                    "n_control", F.round(r0, dp).alias("control_rate_pct"),
                    F.round(r1 - r0, dp).alias("gap_pts"))


def hide_suppressed(df: DataFrame, *labels: str) -> DataFrame:
    """All columns but ``labels`` and the stability nulled where that is "suppressed"."""
    shown = F.col("stability") != "suppressed"
    return df.select(*[F.col(c) if c in (*labels, "stability") else F.when(shown, F.col(c)).alias(c) for c in df.columns])


def k_stratified_frame(units: DataFrame, treated, outcome, stratum: str) -> DataFrame:
    t, y = _c(treated).cast("boolean"), _c(outcome).cast("double")
    return units.groupBy(stratum).agg(
        F.count_if(t).alias("n_treated"), F.coalesce(F.sum(F.when(t, y)), F.lit(0.0)).alias("y_treated"),
        F.count_if(~t).alias("n_control"), F.coalesce(F.sum(F.when(~t, y)), F.lit(0.0)).alias("y_control"))


def k_stratified(units: DataFrame, treated, outcome, stratum: str, dp: int = 6) -> DataFrame:
    """Per-stratum rates in both arms with n, Wilson ranges, the gap and a
    stability label on the smaller arm; a suppressed stratum shows no figure."""
    f = k_stratified_frame(units, treated, outcome, stratum)
    r1 = safe_div(F.col("y_treated") * 100, "n_treated")
    r0 = safe_div(F.col("y_control") * 100, "n_control")
    l1, u1 = wilson_bounds("y_treated", "n_treated")
    l0, u0 = wilson_bounds("y_control", "n_control")
    nmin = F.least("n_treated", "n_control")
    out = f.select(stratum, "n_treated", F.round(r1, dp).alias("treated_rate_pct"),
                    F.round(l1 * 100, dp).alias("treated_lower_pct"), F.round(u1 * 100, dp).alias("treated_upper_pct"),
                    "n_control", F.round(r0, dp).alias("control_rate_pct"),
                    F.round(l0 * 100, dp).alias("control_lower_pct"), F.round(u0 * 100, dp).alias("control_upper_pct"),
                    F.round(r1 - r0, dp).alias("gap_pts"),
                    F.when(nmin < 5, "suppressed").when(nmin < 30, "unstable").otherwise("stable")
                    .alias("stability"))
    return hide_suppressed(out, stratum)


def k_standardised(units: DataFrame, treated, outcome, stratum: str,
                   round_strata: int | None = None, dp: int = 6) -> DataFrame:
    """Gap averaged over strata weighted by total stratum size. Strata lacking
    an arm cannot contribute a gap: they are counted and reported, not
    silently dropped. ``round_strata`` rounds per-stratum percentages first
    (replays a published figure computed from rounded rates)."""
    f = k_stratified_frame(units, treated, outcome, stratum)
    r1 = safe_div(F.col("y_treated") * 100, "n_treated")
    r0 = safe_div(F.col("y_control") * 100, "n_control")
    if round_strata is not None:
        r1, r0 = F.round(r1, round_strata), F.round(r0, round_strata)
    both = (F.col("n_treated") > 0) & (F.col("n_control") > 0)
    w = (F.col("n_treated") + F.col("n_control")).cast("double")
    g = f.agg(F.sum(F.when(both, (r1 - r0) * w)).alias("__num"), F.sum(F.when(both, w)).alias("__w"),
              F.count_if(both).alias("strata_used"), F.count_if(~both).alias("strata_missing_arm"),
              F.sum(F.when(~both, w)).alias("__lost"),
              F.sum("n_treated").alias("__n1"), F.sum("y_treated").alias("__y1"),
              F.sum("n_control").alias("__n0"), F.sum("y_control").alias("__y0"))
    naive = safe_div(F.col("__y1") * 100, "__n1") - safe_div(F.col("__y0") * 100, "__n0")
    return g.select(F.round(safe_div("__num", "__w"), dp).alias("standardised_gap_pts"),
                    F.round(naive, dp).alias("naive_gap_pts"),
                    "strata_used", "strata_missing_arm",
                    F.col("__w").cast("long").alias("n_used"),
                    F.coalesce(F.col("__lost"), F.lit(0.0)).cast("long").alias("n_excluded"))


def k_assignment(units: DataFrame, treated, covariates: Sequence[str], categorical: Sequence[str] = (),
                 dp: int = 6) -> DataFrame:
    """How the arms differ before any outcome: for numeric covariates the
    means by arm and the standardised mean difference (m1 - m0) /
    sqrt((v1 + v0) / 2); for categorical ones the share of each level by arm
    and the standardised difference of proportions. Returned long, one row
    per covariate (or covariate=level)."""
    t = _c(treated).cast("boolean")
    aggs = []
    for c in covariates:
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(t, x)).alias(f"{c}__m1"), F.avg(F.when(~t, x)).alias(f"{c}__m0"),
                 F.var_samp(F.when(t, x)).alias(f"{c}__v1"), F.var_samp(F.when(~t, x)).alias(f"{c}__v0")]
    wide = units.agg(F.count_if(t).alias("n_treated"), F.count_if(~t).alias("n_control"), *aggs)
    rows = [F.struct(F.lit(c).alias("covariate"),
                     F.round(F.col(f"{c}__m1"), dp).alias("mean_treated"),
                     F.round(F.col(f"{c}__m0"), dp).alias("mean_control"),
                     F.round(safe_div(F.col(f"{c}__m1") - F.col(f"{c}__m0"),
                                      F.sqrt((F.col(f"{c}__v1") + F.col(f"{c}__v0")) / 2)), dp).alias("smd"))
            for c in covariates]
    out = wide.select("n_treated", "n_control", F.explode(F.array(*rows)).alias("r")) \
        .select("r.covariate", "n_treated", "n_control", "r.mean_treated", "r.mean_control", "r.smd")
    if categorical:
        n1 = wide.select("n_treated").scalar()
        n0 = wide.select("n_control").scalar()
        for c in categorical:
            lv = units.groupBy(F.col(c).cast("string").alias("__lv")).agg(
                F.count_if(t).alias("__k1"), F.count_if(~t).alias("__k0"))
            p1, p0 = safe_div("__k1", n1), safe_div("__k0", n0)
            sd = F.sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2)
            out = out.unionByName(lv.select(
                F.concat(F.lit(f"{c}="), F.coalesce("__lv", F.lit("<null>"))).alias("covariate"),
                n1.alias("n_treated"), n0.alias("n_control"), F.round(p1, dp).alias("mean_treated"),
                F.round(p0, dp).alias("mean_control"), F.round(safe_div(p1 - p0, sd), dp).alias("smd")))
    return out


def k_landmark(units: DataFrame, entry: str, exit_: str, award_date: str, landmark,
               dp: int = 6) -> DataFrame:
    """Landmark remedy for immortal time: keep units alive at the landmark,
    arm = awarded by the landmark, outcome = exit after it."""
    L = F.lit(landmark)
    alive = (F.col(entry) <= L) & (F.col(exit_).isNull() | (F.col(exit_) > L))
    arm = F.col(award_date).isNotNull() & (F.col(award_date) <= L)
    u = units.where(alive).select(arm.alias("awarded"), F.col(exit_).isNotNull().alias("event"))
    return u.groupBy("awarded").agg(F.count("*").alias("n"), F.count_if("event").alias("events")) \
        .withColumn("rate_pct", F.round(safe_div(F.col("events") * 100, "n"), dp))


def k_survivorship(units: DataFrame, cohort: str, survived: Column, metric: str,
                   dp: int = 6) -> DataFrame:
    """A metric measured on survivors only vs on the full entering cohort."""
    s = survived.cast("boolean")
    return units.groupBy(cohort).agg(
        F.count("*").alias("n_entered"), F.count_if(s).alias("n_survivors"),
        F.round(F.avg(F.when(s, F.col(metric))), dp).alias("mean_survivors"),
        F.round(F.avg(metric), dp).alias("mean_entered")) \
        .withColumn("survivor_bias", F.round(F.col("mean_survivors") - F.col("mean_entered"), dp))


def k_reg_to_mean(pairs: DataFrame, x1: str, x2: str, cuts: Sequence[float] = (1 / 3, 2 / 3),
                  dp: int = 6) -> DataFrame:
    """Change by baseline group vs the change regression to the mean alone
    predicts, (1 - r)(mean1 - group mean1), r = corr(x1, x2). Baseline groups
    come from exact quantile cut points of x1 (frequency pre-aggregate)."""
    from plumbline.operators.quantiles import exact_quantiles
    p = pairs.where(F.col(x1).isNotNull() & F.col(x2).isNotNull())
    qs = exact_quantiles(p, x1, [], list(cuts)).select("__q").scalar()
    r = p.select(F.corr(x1, x2)).scalar()
    m1 = p.select(F.avg(x1)).scalar()
    grp = None
    for i in range(len(cuts)):
        cond = F.col(x1) <= qs[i]
        grp = F.when(cond, i + 1) if grp is None else grp.when(cond, i + 1)
    grp = grp.otherwise(len(cuts) + 1)
    g = p.groupBy(grp.alias("baseline_group")).agg(
        F.count("*").alias("n"), F.avg(x1).alias("__a"), F.avg(x2).alias("__b"))
    return g.select("baseline_group", "n", F.round("__a", dp).alias("mean_baseline"),
                    F.round("__b", dp).alias("mean_followup"),
                    F.round(F.col("__b") - F.col("__a"), dp).alias("observed_change"),
                    F.round((1 - r) * (m1 - F.col("__a")), dp).alias("expected_rtm_change"),
                    F.round(r, dp).alias("r"))


def k_range_restrict(df: DataFrame, selected: Column, x: str, y: str, dp: int = 6) -> DataFrame:
    """SD of x and y and corr(x, y) in the full pool vs the selected group."""
    def block(label, d):
        return d.agg(F.lit(label).alias("group"), F.count("*").alias("n"),
                     F.round(F.stddev_samp(x), dp).alias("sd_x"), F.round(F.stddev_samp(y), dp).alias("sd_y"),
                     F.round(F.corr(x, y), dp).alias("corr_xy"))
    return block("pool", df).unionByName(block("selected", df.where(selected)))


def k_confounded_groups(df: DataFrame, group: str, others: Sequence[str], dp: int = 6) -> DataFrame:
    """Association of a grouping with each other label: Cramer's V from the
    contingency counts (chi2 = sum O^2 / E - N over observed cells) and the
    share of groups that sit entirely inside one category of the other."""
    out = None
    for o in others:
        ct = materialize_small(df.groupBy(group, o).agg(F.count("*").alias("O")))
        n = ct.select(F.sum("O")).scalar()
        r = ct.select(F.count_distinct(group)).scalar()
        c = ct.select(F.count_distinct(o)).scalar()
        R = F.sum("O").over(Window.partitionBy(group))
        C = F.sum("O").over(Window.partitionBy(o))
        x = ct.select(F.col("O"), R.alias("R"), C.alias("C"), F.col(group))
        chi = x.select((F.sum(F.col("O") * F.col("O") * n / (F.col("R") * F.col("C"))) - n).alias("chi2"))
        per_g = ct.groupBy(group).agg(F.count("*").alias("k"))
        one = per_g.select(safe_div(F.count_if(F.col("k") == 1) * 100, F.count("*"))).scalar()
        row = chi.select(F.lit(o).alias("other"), n.cast("long").alias("n"),
                         r.alias("groups"), c.alias("categories"),
                         F.round(F.sqrt(safe_div("chi2", n * (F.least(r, c) - 1))), dp).alias("cramers_v"),
                         F.round(one, dp).alias("pct_groups_in_one_category"))
        out = row if out is None else out.unionByName(row)
    return out


def k_reverse(df: DataFrame, key: str, wave: str, x: str, y: str, dp: int = 6) -> DataFrame:
    """Cross-lagged correlations: corr(x_t, y_t+1) vs corr(y_t, x_t+1), and
    the same-wave corr(x_t, y_t). Descriptive only. Lag per person by wave."""
    w = Window.partitionBy(key).orderBy(wave)
    d = df.select(key, wave, x, y, F.lead(x).over(w).alias("__xn"), F.lead(y).over(w).alias("__yn"))
    return d.agg(F.round(F.corr(x, "__yn"), dp).alias("corr_x_then_y"),
                 F.round(F.corr(y, "__xn"), dp).alias("corr_y_then_x"),
                 F.round(F.corr(x, y), dp).alias("corr_same_wave"),
                 F.count("__yn").alias("n_lagged_pairs"))


def k_common_method(measures: DataFrame, person: str, source: Sequence[str], is_a: Column, is_b: Column,
                    dp: int = 6) -> DataFrame:
    """Share of compared pairs whose two measures share the ``source`` columns
    (instrument, wave), null-safe. Compared are each person's ``is_a`` measures with
    their ``is_b`` measures; the pairs are counted from the counts of either kind per
    person and source and never made rows. Measures without a person are in no pair."""
    cell = measures.where(F.col(person).isNotNull()).groupBy(person, *source).agg(
        F.count_if(is_a).alias("__a"), F.count_if(is_b).alias("__b"))
    each = cell.groupBy(person).agg((F.sum("__a") * F.sum("__b")).alias("__pairs"), F.sum(F.col("__a") * F.col("__b")).alias("__same"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total("__pairs").alias("n_pairs"), total("__same").alias("n_same_source")) \
        .withColumn("same_source_pct", F.round(safe_div(F.col("n_same_source") * 100, "n_pairs"), dp))


def k_comparability(df: DataFrame, group: str, person: str, item: str, value: str,
                    items: Sequence[str], dp: int = 6) -> DataFrame:
    """Per group: respondents with every item, item means and variances, mean
    inter-item correlation and Cronbach's alpha = k/(k-1)(1 - sum var_i /
    var_total), before any comparison of group means. Item pairs are bounded
    by the item list, not by the data."""
    per = df.groupBy(group, person).agg(*[F.avg(F.when(F.col(item) == it, F.col(value))).alias(f"i{j}")
                                          for j, it in enumerate(items)])
    complete = per.dropna(subset=[f"i{j}" for j in range(len(items))])
    k = len(items)
    total = sum((F.col(f"i{j}") for j in range(k)), F.lit(0.0))
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    g = complete.withColumn("__t", total).groupBy(group).agg(
        F.count("*").alias("n_complete"),
        *[F.avg(f"i{j}").alias(f"m{j}") for j in range(k)],
        *[F.var_samp(f"i{j}").alias(f"v{j}") for j in range(k)],
        F.var_samp("__t").alias("__vt"),
        *[F.corr(f"i{a}", f"i{b}").alias(f"c{a}_{b}") for a, b in pairs])
    sum_v = sum((F.col(f"v{j}") for j in range(k)), F.lit(0.0))
    mean_r = sum((F.col(f"c{a}_{b}") for a, b in pairs), F.lit(0.0)) / len(pairs)
    alpha = (k / (k - 1)) * (1 - safe_div(sum_v, "__vt"))
    return g.select(group, "n_complete",
                    F.round(sum((F.col(f"m{j}") for j in range(k)), F.lit(0.0)) / k, dp).alias("mean_item_mean"),
                    F.round(sum_v / k, dp).alias("mean_item_var"),
                    F.round(mean_r, dp).alias("mean_inter_item_r"),
                    F.round(alpha, dp).alias("cronbach_alpha"))


def k_did(df: DataFrame, treated: Column, period: Column, post: Column, y: str,
          dp: int = 6) -> DataFrame:
    """Difference-in-differences with its pre-trend table: per period the
    treated and control means and gap, plus the 2x2 estimate
    (post gap - pre gap) from pooled pre/post means."""
    t = treated.cast("boolean")
    per = df.groupBy(period.alias("period")).agg(
        F.avg(F.when(t, F.col(y))).alias("__mt"), F.avg(F.when(~t, F.col(y))).alias("__mc"),
        F.first(post).alias("post"))
    cells = df.agg(*[F.avg(F.when((t == a) & (post == b), F.col(y))).alias(f"m{int(a)}{int(b)}")
                     for a in (True, False) for b in (True, False)])
    did = cells.select((F.col("m11") - F.col("m10")) - (F.col("m01") - F.col("m00"))).scalar()
    return per.select("period", "post", F.round("__mt", dp).alias("mean_treated"),
                      F.round("__mc", dp).alias("mean_control"),
                      F.round(F.col("__mt") - F.col("__mc"), dp).alias("gap"),
                      F.round(did, dp).alias("did_estimate"))


def k_matched(df: DataFrame, treated, on: Sequence[str], y, dp: int = 6) -> DataFrame:
    """Exact (or pre-coarsened) matching: strata on ``on`` with both arms;
    effect on the treated = treated-weighted mean of per-stratum differences.
    Unmatched treated units are counted, not dropped silently."""
    t, yy = _c(treated).cast("boolean"), _c(y).cast("double")
    s = df.groupBy(*on).agg(F.count_if(t).alias("n1"), F.avg(F.when(t, yy)).alias("m1"),
                            F.count_if(~t).alias("n0"), F.avg(F.when(~t, yy)).alias("m0"))
    both = (F.col("n1") > 0) & (F.col("n0") > 0)
    return s.agg(F.count_if(both).alias("strata_matched"),
                 F.sum(F.when(both, F.col("n1")).otherwise(0)).alias("n_treated_matched"),
                 F.sum(F.when(~both, F.col("n1")).otherwise(0)).alias("n_treated_unmatched"),
                 F.round(safe_div(F.sum(F.when(both, (F.col("m1") - F.col("m0")) * F.col("n1"))),
                                  F.sum(F.when(both, F.col("n1")))), dp).alias("att"))


def k_rd(df: DataFrame, running: str, cutoff: float, y, bandwidth: float, dp: int = 6) -> DataFrame:
    """Local linear fits on each side of a cutoff within the bandwidth (OLS
    moments via regr_slope / regr_intercept on the centred running variable);
    the jump is the difference of the two intercepts at the cutoff."""
    yy = _c(y).cast("double")
    xc = (F.col(running) - F.lit(cutoff)).cast("double")
    d = df.where(F.abs(xc) <= bandwidth).select(xc.alias("x"), yy.alias("y"))
    right = F.col("x") >= 0
    g = d.agg(F.count_if(~right).alias("n_left"), F.count_if(right).alias("n_right"),
              F.regr_intercept(F.when(~right, F.col("y")), F.when(~right, F.col("x"))).alias("__il"),
              F.regr_intercept(F.when(right, F.col("y")), F.when(right, F.col("x"))).alias("__ir"),
              F.avg(F.when(~right, F.col("y"))).alias("__ml"), F.avg(F.when(right, F.col("y"))).alias("__mr"))
    return g.select("n_left", "n_right", F.round("__ml", dp).alias("mean_left"),
                    F.round("__mr", dp).alias("mean_right"),
                    F.round("__il", dp).alias("intercept_left"), F.round("__ir", dp).alias("intercept_right"),
                    F.round(F.col("__ir") - F.col("__il"), dp).alias("jump"))


# Causal-language lexicon, six categories (parameter default).
CAUSAL_LEXICON = [
    ("direct causal verb", "causes"), ("direct causal verb", "drives"),
    ("direct causal verb", "leads to"), ("direct causal verb", "results in"),
    ("direct causal verb", "produces"), ("direct causal verb", "generates"),
    ("directional change verb", "improves"), ("directional change verb", "reduces"),
    ("directional change verb", "increases"), ("directional change verb", "decreases"),
    ("directional change verb", "boosts"), ("directional change verb", "lowers"),
    ("directional change verb", "moves the needle"),
    ("causal noun", "impact of"), ("causal noun", "effect of"), ("causal noun", "driver of"),
    ("causal noun", "lever"), ("causal noun", "root cause"), ("causal noun", "ROI of"),
    ("causal connective", "because"), ("causal connective", "due to"),
    ("causal connective", "as a result of"), ("causal connective", "therefore"),
    ("causal connective", "which is why"),
    ("counterfactual framing", "if we had"), ("counterfactual framing", "we would see"),
    ("counterfactual framing", "would have prevented"),
    ("implicit prescription", "we should"),
]


def lexicon_frame(spark, entries: Sequence[tuple[str, str]]) -> DataFrame:
    """(category, term) pairs -> lexicon frame with normalised term and its
    word count. A lexicon is a parameter, so it is small by construction."""
    df = spark.createDataFrame(list(entries), "category string, term string")
    t = F.array_join(tokens("term"), " ")
    return df.select("category", t.alias("term"), F.size(tokens("term")).alias("n_words"))


#: First words of a lexicon up to which they are compiled into the scan.
MAX_FIRST_WORDS = 10_000


def term_hits(docs: DataFrame, id_col: str, text: str, lexicon: DataFrame,
              extra: Sequence[str] = ()) -> DataFrame:
    """One row per lexicon hit: (id, position, term, category).

    Each whole text is tokenised once, JVM-side, and the first words of the terms,
    compiled into a hash set, pick the places where a term may start. Only these
    become rows, each with the words that the longest term can cover, so neither a
    row per word nor a text's token array leaves the scan. The terms then meet the
    places in a hash join on the first word, and a phrase matches if its words
    stand there. A lexicon with more first words than MAX_FIRST_WORDS is not
    compiled: every place meets the terms, with the same few words."""
    from plumbline.operators.joins import broadcast_bounded
    from plumbline.session import spread_small_scan
    words = F.split("term", " ")
    lex = lexicon.where("n_words > 0").select("term", "category", words.alias("__w"), F.get(words, F.lit(0)).alias("__first"))
    first = [r[0] for r in lex.select("__first").distinct().limit(MAX_FIRST_WORDS + 1).collect()]  # a parameter
    longest = lexicon.agg(F.max("n_words")).first()[0] or 1
    places = F.transform("__t", lambda w, i: F.struct(i.cast("long").alias("p"), w.alias("w")))
    if len(first) <= MAX_FIRST_WORDS:
        places = F.filter(places, lambda x: x["w"].isin(first))
    around = F.transform(places, lambda x: F.struct(x["p"], x["w"], F.slice(F.col("__t"), x["p"].cast("int") + 1, longest).alias("s")))
    base = spread_small_scan(docs).select(id_col, *extra, tokens(text).alias("__t"))
    each = base.select(id_col, *extra, F.explode(around).alias("__x")).select(
        id_col, *extra, F.col("__x.p").alias("position"), F.col("__x.w").alias("__first"), F.col("__x.s").alias("__s"))
    met = each.join(broadcast_bounded(lex, 100_000), "__first")
    return met.where(F.slice("__s", 1, F.size("__w")) == F.col("__w")).select(id_col, *extra, "position", "term", "category")


def k_trigger_scan(docs: DataFrame, id_col: str, text: str, lexicon: DataFrame) -> DataFrame:
    return term_hits(docs, id_col, text, lexicon)


def k_licence(findings: DataFrame, key: str, designs: DataFrame, design_col: str,
              licensed: Sequence[str]) -> DataFrame:
    """Causal wording is allowed only when the finding's design is in the
    licensed set; every finding is kept (left join) with a verdict."""
    j = findings.join(designs, key, "left")
    lic = F.col(design_col).isin(list(licensed))
    verdict = (F.when(F.col("n_causal_terms") == 0, "no causal wording")
               .when(lic, "causal wording licensed").otherwise("downgrade wording"))
    return j.select(key, F.coalesce(F.col(design_col), F.lit("unknown")).alias("design"),
                    "n_causal_terms", F.coalesce(lic, F.lit(False)).alias("licensed"),
                    verdict.alias("verdict"))
